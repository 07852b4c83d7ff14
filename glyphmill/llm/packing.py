"""Concat-and-cut packing of tokenized documents into fixed windows.

Pass one tokenizes each input partition where it lies and stores every
document's ids with its token offset inside the partition. The partitions'
totals, prefix-summed, turn those into global offsets; pass two cuts at
multiples of the window, without a shuffle, and gives a boundary record per
piece. Only the last window is padded.

Defined results: null text is empty and yields the end id alone; a document
longer than a window is cut into as many pieces as it touches; repeated rows
are packed once each; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._tables import materialise, running_offsets

WINDOW = 4096
MEMO = 500_000
PART_BROADCAST = 1 << 20
PLAIN_END = 0x180
PLAIN_LAST = chr(PLAIN_END)
DOTTED = "\u0130"
PUNCTUATION = string.punctuation.replace("'", "")
TOKENS = "doc_id long, part int, local_start long, n long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


class ChunkTokenizer:
    """Ids of whole texts, with a bounded memo of chunks between ASCII blanks.

    For a tokenizer that drops white space, ids never depend on what stands
    beyond a blank, so a text's ids are its chunks' ids in order. Where a
    tokenizer also lowers case and parts letters from punctuation, as probes
    find, a chunk of plain letters with punctuation behind is looked up by its
    two parts, and new letters go to the tokenizer's model at once. Other new
    chunks are encoded together, parted by the digit 0, whose single id marks
    the borders; chunks that hold that digit or a special token are encoded one
    by one.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.mark = self._ids("0")
        self.width = np.dtype("<u4" if self.encoder.get_vocab_size() > 1 << 16 else "<u2")
        self.code = "I" if self.width.itemsize == 4 else "H"
        self.memo, self.young, self.old = memo, {}, {}
        self.letters = self._letters()
        self.local = self._local()
        self.parted = self.local and self._parted()

    def _ids(self, text: str) -> list[int]:
        return self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _letters(self) -> dict[int, str]:
        """What a byte-level model sees of the letters below ``PLAIN_END`` that are not ASCII."""
        from tokenizers.pre_tokenizers import ByteLevel

        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        codes = (i for i in range(0x80, PLAIN_END) if chr(i).isalpha())
        return {i: byte_level.pre_tokenize_str(chr(i))[0][0] for i in codes}

    def _local(self) -> bool:
        probe = ["ab", "c.", "d's", "1", "é", "é"]
        alone = [i for p in probe for i in self._ids(p)]
        return len(self.mark) == 1 and all(self._ids(s.join(probe)) == alone for s in (" ", "\n", "\t", "  "))

    def _parted(self) -> bool:
        words = ["ab", "hello", "xqzzv", "élan", "straße", "œuvre", "niño"]
        ends = [",", "...", "!?", "###", ")", "_", "&&&,"]
        return all(
            self._model(w) == self._ids(w) == self._ids(w.title()) == self._ids(w.upper() if w != "straße" else w)
            and all(self._ids(w + e) == self._ids(w) + self._ids(e) for e in ends)
            for w in words
        )

    def _model(self, letters: str) -> list[int]:
        seen = letters if letters.isascii() else letters.translate(self.letters)
        return [t.id for t in self.encoder.model.tokenize(seen)]

    def _packed(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.width).tobytes()

    def _learn(self, chunks: Iterable[str]) -> None:
        """Put chunks into the young memo, from the old one or by encoding them."""
        young, old = self.young, self.old
        plain, odd = [], []
        for c in chunks:
            known = old.get(c)
            if known is not None:
                young[c] = known
                continue
            word = c.rstrip(PUNCTUATION) if self.parted else ""
            if word.isalpha() and (word.isascii() or (max(word) < PLAIN_LAST and DOTTED not in word)):
                low = word.lower()
                ids = young.get(low) or old.get(low)
                if ids is None:
                    ids = young[low] = struct.pack(f"<{len(x)}{self.code}", *x) if (x := self._model(low)) else b""
                end = c[len(word) :]
                if end:
                    tail = young.get(end)
                    if tail is None:
                        tail = young[end] = self._packed(self._ids(end))
                    ids += tail
                young[c] = ids
            elif "0" in c or any(s in c for s in self.special):
                odd.append(c)
            else:
                plain.append(c)
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.asarray(self._ids(" 0 ".join(some)), self.width)
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(some) - 1:
                odd += some
                continue
            raw, w = ids.tobytes(), self.width.itemsize
            ends = [*(cuts * w).tolist(), len(raw)]
            begin = 0
            for c, end in zip(some, ends, strict=True):
                young[c] = raw[begin:end]
                begin = end + w
        for c in odd:
            young[c] = self._packed(self._ids(c))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``self.width``."""
        if not self.local:
            return [self._packed(self._ids(t)) for t in texts]
        if len(self.young) > self.memo:
            self.old, self.young = self.young, {}
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        self.young[""] = b""
        new = set().union(*split).difference(self.young)
        if new:
            self._learn(new)
        return [b"".join(map(self.young.__getitem__, s)) for s in split]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """``doc_id, part, local_start, n, ids``: ids end with ``end_id``."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _tokenizer(tokenizer_path)
        end = np.asarray([end_id], encoder.width).tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for block in blocks:
            for at in range(0, block.num_rows, 500):
                some = block.slice(at, 500)
                ids = [x + end for x in encoder.encode([t or "" for t in some.column(1).to_pylist()])]
                n = np.fromiter((len(x) // encoder.width.itemsize for x in ids), np.int64, len(ids))
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).cast(pa.int64()),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(starts),
                        pa.array(n),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "part", "local_start", "n", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def pieces_of(doc_start: int, n: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """``(start, length, sequence_id, offset)`` of a document at a global token offset."""
    at = 0
    while at < n:
        sequence, offset = divmod(doc_start + at, window)
        length = min(window - offset, n - at)
        yield at, length, sequence, offset
        at += length


def _cut(window: int, width: np.dtype):
    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for at in range(0, block.num_rows, 2000):
                out: list[list[int]] = [[] for _ in range(7)]
                doc, first, n, ids = (c.to_pylist() for c in block.slice(at, 2000).columns)
                for d, g, total, raw in zip(doc, first, n, ids, strict=True):
                    wide = np.frombuffer(raw, width).astype("<u4")
                    for start, length, sequence, offset in pieces_of(g, total, window):
                        crc = zlib.crc32(wide[start : start + length].tobytes())
                        for col, v in zip(out, (d, start, length, crc, total, sequence, offset), strict=True):
                            col.append(v)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 2
) -> DataFrame:
    """A boundary record for each piece of each document, see the module's text.

    The per-partition totals are broadcast while there are at most
    ``PART_BROADCAST`` of them (20 MB), else joined by Spark's own choice.
    """
    width = _tokenizer(tokenizer_path).width
    tokens = materialise(tokenized(docs, tokenizer_path, end_id), "pack-tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    starts = materialise(running_offsets(totals, [], "part", "n", "base").select("part", "base"), "pack-parts")
    side = F.broadcast(starts) if starts.count() <= PART_BROADCAST else starts
    placed = tokens.join(side, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("first"), "n", "ids")
    return placed.mapInArrow(_cut(window, width), PIECES)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
