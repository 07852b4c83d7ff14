"""Secret scan: fixed patterns, and strings that a primed zstandard cannot shorten.

Besides three kinds of patterns, a candidate is a run of 16 or more key
characters, letters with digits or of quickly changing case, that follows a
sensitive word closely.
Its novelty is what it adds to the compressed size when the compressor is
primed with dictionaries of identifiers and with the text around it:
identifiers, words of the text and repeated or regular strings shorten well;
keys do not. One dictionary is fixed, the other holds the commonest words of
the lines of the corpus's own documents with a sensitive word, counted by
distinct lines, so that a copied key is not taken for a word. Candidates at ``NOVEL`` bytes a character or more, as a whole or in
a slice of ``SLICE`` characters like it, are reported as kind
``novel``, unless they touch a pattern's span. Slices are short enough for the
measure not to sink with length: zstandard codes literals by their frequency
only from 64 bytes on.

A string's other places nearby are left out of the priming text, lest a key
that stands twice hide itself; so are those of its parts between equals signs.
Places in a pattern's span stay in: there the key is reported already.

The surroundings are ``around`` characters a side, or with ``around=None`` the
whole text, at a cost that then grows with its length for each candidate.

Defined results: null and empty texts have no spans; texts are scanned whole,
whatever their length; repeated rows are scanned alike; an empty table gives an
empty result; further columns of the input are ignored. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
NOVEL = 0.8
REACH = 64
AROUND = 256
SLICE = 32
MIN_LINES = 8
TOP_WORDS = 4096
_WORDS = "[A-Z]?[a-z]{4,30}"
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CONTEXT = (
    r"password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer"
    r"|authorization|client[_-]?id|signature|session[_-]?id"
)
_SENSITIVE = re.compile(_CONTEXT, re.I | re.A)
_PART = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT = re.compile("[0-9]")
_LETTER = re.compile("[A-Za-z]")
_CASE_RUN = re.compile("[A-Z]+|[a-z]+")
_IDENTIFIERS = (
    " public static final void string integer boolean function return class import export const let var "
    "self this null undefined true false None True False async await request response session config "
    "settings environment database connection server client username password secret token api_key apikey "
    "access_key secret_key private_key client_id client_secret authorization bearer credentials example "
    "placeholder changeme your_api_key_here YOUR_SECRET_KEY insert_token_here xxxxxxxxxxxxxxxx 0000000000000000 "
    "1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ getElementById "
    "addEventListener XMLHttpRequest createElement toString valueOf index length default application/json "
    "Content-Type Accept-Encoding User-Agent https://www.example.com/ http://localhost:8080/ utf-8 sha256 "
    "localhost 127.0.0.1 version timestamp created_at updated_at user_id account_id session_id request_id "
).encode()


def keylike(x: str) -> bool:
    """Letters with a digit, or with more changes of case than the words of an identifier have."""
    if not _LETTER.search(x):
        return False
    return _DIGIT.search(x) is not None or 5 * len(_CASE_RUN.findall(x)) >= 2 * len(x)


@dataclass(frozen=True)
class Novelty:
    """How strings are measured: bytes a character, context before them, surroundings a side, own dictionary."""

    novel: float = NOVEL
    reach: int = REACH
    around: int | None = AROUND
    words: bytes = b""


def novelty(candidate: str, around: str, words: bytes = b"") -> float:
    """Compressed bytes a character that ``candidate`` adds to its surroundings."""
    primed = zstandard.ZstdCompressionDict(
        words + _IDENTIFIERS + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)
    return (len(packer.compress(candidate.encode())) - len(packer.compress(b""))) / len(candidate)


def is_novel(candidate: str, around: str, how: Novelty = Novelty()) -> bool:
    """Whether the string or a slice of it is novel; slices overlap by half and the last ends with the string."""
    if novelty(candidate, around, how.words) >= how.novel:
        return True
    if len(candidate) <= SLICE:
        return False
    starts = [*range(0, len(candidate) - SLICE, SLICE // 2), len(candidate) - SLICE]
    parts = (candidate[a : a + SLICE] for a in starts)
    return any(keylike(x) and novelty(x, around, how.words) >= how.novel for x in parts)


def common_words(docs: DataFrame, min_lines: int = MIN_LINES, top: int = TOP_WORDS) -> bytes:
    """The own dictionary: words in ``min_lines`` distinct lines or more, the ``top`` commonest, rarest first.

    Counts cover all documents with a sensitive word; the dictionary's size is bounded by ``top``.
    """
    lines = (
        docs.where(F.col("text").rlike(f"(?i){_CONTEXT}"))
        .select(F.explode(F.split("text", "\n")).alias("line"))
        .distinct()
    )
    words = lines.select(F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(_WORDS), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_lines)
    best = [r.word for r in counts.orderBy(F.desc("n"), F.asc("word")).limit(top).collect()]
    return " ".join(reversed(best)).encode()


def patterns(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the fixed patterns."""
    found: list[tuple[str, int, int]] = []
    lowered = text.lower() if text.isascii() else text.casefold()
    if any(x in lowered for x in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def surroundings(text: str, a: int, b: int, spans: list[tuple[int, int]], around: int | None = AROUND) -> str:
    """``around`` characters on both sides, with the string's and its parts' other places outside ``spans`` blanked.

    ``spans`` are sorted and do not overlap. Only what both sides hold is
    searched, places that they cut included.
    """
    run = text[a:b]
    parts = {run, *(x for x in _PART.findall(run) if keylike(x))}
    sides = []
    width = len(text) if around is None else around
    for low, high in ((max(0, a - width), a), (b, min(len(text), b + width))):
        side = list(text[low:high])
        for part in parts:
            begin, end = (max(0, low - len(part) + 1), high) if high == a else (low, high + len(part) - 1)
            at = text.find(part, begin, end)
            while at >= 0:
                near = bisect_right(spans, (at, len(text)))
                held = (near and spans[near - 1][1] > at) or (near < len(spans) and spans[near][0] < at + len(part))
                if not held:
                    cut = slice(max(at, low) - low, min(at + len(part), high) - low)
                    side[cut] = " " * (cut.stop - cut.start)
                at = text.find(part, at + 1, end)
        sides.append("".join(side))
    return "".join(sides)


def disjoint(taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The spans' union."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in taken):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def novel(text: str, taken: list[tuple[str, int, int]], how: Novelty = Novelty()) -> list[tuple[str, int, int]]:
    """Incompressible strings in sensitive context that touch no span of ``taken``.

    The context is a sensitive word that ends at most ``reach`` characters
    before the string, or inside it with 16 characters or more to come.
    """
    words = [m.end() for m in _SENSITIVE.finditer(text)]
    if not words:
        return []
    spans = sorted((a, b) for _, a, b in taken)
    united = disjoint(taken)
    found = []
    at = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        near = bisect_left(words, a - how.reach)
        if near == len(words) or words[near] > b - 16:
            continue
        if not keylike(m[0]):
            continue
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        if any(x < b and a < y for x, y in spans[at : at + len(KINDS)]):
            continue
        if is_novel(m[0], surroundings(text, a, b, united, how.around), how):
            found.append(("novel", a, b))
    return found


def scan(text: str | None, how: Novelty = Novelty()) -> list[tuple[str, int, int]]:
    """All spans by start, then by kind."""
    text = text or ""
    base = patterns(text)
    return sorted(base + novel(text, base, how), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(how: Novelty):
    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for at in range(0, block.num_rows, 1000):
                some = block.slice(at, 1000)
                spans = [scan(t, how) for t in some.column(1).to_pylist()]
                kinds = [[k for k, _, _ in s] for s in spans]
                base = [joined([x for x in s if x[0] != "novel"]) for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).cast(pa.int64()),
                        *[pa.array([k.count(x) for k in kinds], pa.int64()) for x in KINDS[:3]],
                        pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                        pa.array([joined(s) for s in spans], pa.string()),
                    ],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return run


def scan_documents(docs: DataFrame, how: Novelty = Novelty()) -> DataFrame:
    """Counts, the base spans' digest and all spans for every row; no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(
        _scan(how), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def query(docs: DataFrame) -> DataFrame:
    return scan_documents(docs, Novelty(words=common_words(docs)))
