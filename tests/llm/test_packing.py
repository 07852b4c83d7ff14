import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphmill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["0", "a0b", "<|endoftext|>x", "it's", "É́ ß", "tab\there\nline", " x y ", "汉字 漢", "Σίσυφος ΣΑΣ", "…", "a\x0bb\x1cc", "٣"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def test_chunk_tokenizer(reference, rows):
    texts = [r[1] or "" for r in rows] + ODD + [" ".join(ODD)]
    for memo in (packing.MEMO, 5):
        own = packing.ChunkTokenizer(PATH, memo)
        assert own.local
        for _ in range(2):
            got = [np.frombuffer(x, own.width).tolist() + [2] for x in own.encode(texts)]
            assert got == [reference(t) for t in texts]


@pytest.mark.parametrize("window", [64, 4096])
def test_pieces(docs, rows, none, reference, window):
    got = packing.pack_documents(docs, PATH, window).collect()
    ids = {r[0]: reference(r[1]) for r in rows}
    filled = {}
    tokens = 0
    for p in got:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        part = np.asarray(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
        tokens += p.length
    assert tokens == sum(len(ids[r[0]]) for r in rows)
    assert sorted(filled) == list(range(len(filled)))
    for s, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or s == len(filled) - 1
    assert packing.pack_documents(none, PATH).count() == 0


def test_chunks_of_odd_letters_and_punctuation(reference):
    rng = random.Random(5)
    letters = [*"abcxyzABCéßÉœŒİıſŉµªº'’.,;:!?#$%_-0123٣́<|>", "'s", "'ll", "<|endoftext|>", " ", "\n", "\t", "\x0b", "汉", "Σ", "ŀ"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(4000)]
    own = packing.ChunkTokenizer(PATH, 2000)
    assert own.parted
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        assert [np.frombuffer(x, own.width).tolist() + [2] for x in own.encode(some)] == [reference(t) for t in some]
