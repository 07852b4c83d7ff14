"""Line dedup across documents by pairwise patience alignment.

Postings of line hashes name the documents that overlap. A key is the hash of a
line, or of a run of lines with ``min_words`` words, so that blocks of common
short lines have rare keys too: from each line of under ``min_words`` words on
and up to it the shortest run of consecutive lines, and any two lines less than
``MAX_GAP`` + 1 apart that have as many. A key in at most ``rare`` documents
pairs each of them with every earlier one; a commoner key pairs them with its
earliest document alone, so that pairs grow with the corpus and not with the
square of a group.

Each pair is aligned on all lines that both documents hold, common or not: lines
that are unique on both sides are put in order by patience sorting, the parts
between them are stripped of equal ends and aligned again, lines that are unique
nowhere go by their occurrence. Blocks are runs on one diagonal with gaps below
``MAX_GAP`` lines; those of ``min_words`` words or more are deleted from the
later document. With ``every_copy``, as in the query, lines that are left over
seed further blocks where they stand in the earlier document, until none is
left, so that second and crossed copies go as well.

Not found: a block with gaps of which no line, run or pair of lines is in
``rare`` documents or fewer or has its earliest document with the whole block.

Defined results: null text is empty; lines without a word are neither matched
nor deleted; lines are compared without the blanks around them; later means a
larger ``doc_id``, with a null id first and then the text's hash; wholly
repeated rows are one document and fare alike; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._tables import lookup, materialise

MIN_WORDS = 10
MAX_GAP = 3
RARE = 32
DEPTH = 8
SEEDS = 8
SPREAD = 64
_FIRST = -(1 << 63)
_WIDTH = 16
LISTS = "did long, tkey long, hashes binary, words array<int>, lines array<int>"


def runs_of(words: list[int], min_words: int) -> Iterator[tuple[int, int, int]]:
    """``(first, step, length)`` of the runs with keys of their own, each once."""
    found = set()
    for i, n in enumerate(words):
        if n >= min_words:
            continue
        for way in (1, -1):
            at, total = i, n
            while total < min_words and 0 <= at + way < len(words):
                at += way
                total += words[at]
            if total >= min_words:
                found.add((min(i, at), 1, abs(at - i) + 1))
            for step in range(2, MAX_GAP + 1):
                at = i + way * step
                if 0 <= at < len(words) and n + words[at] >= min_words:
                    found.add((min(i, at), step, 2))
    yield from sorted(found)


def lines_of(text: str) -> tuple[bytes, list[int], list[int]]:
    """Hashes, word counts and numbers of a text's lines with a word."""
    hashes, words, lines = [], [], []
    for i, line in enumerate(text.encode().split(b"\n")):
        n = len(line.split())
        if n:
            hashes.append(xxhash.xxh3_128_digest(line.strip()))
            words.append(n)
            lines.append(i)
    return b"".join(hashes), words, lines


def cut(hashes: bytes) -> list[bytes]:
    return [hashes[i : i + _WIDTH] for i in range(0, len(hashes), _WIDTH)]


def keys_of(hashes: list[bytes], words: list[int], min_words: int = MIN_WORDS) -> set[bytes]:
    """The keys of a document: its lines' and its runs'."""
    out = set(hashes)
    for at, step, length in runs_of(words, min_words):
        part = b"".join(hashes[at : at + step * (length - 1) + 1 : step])
        out.add(xxhash.xxh3_128_digest(b"%d:" % step + part))
    return out


def increasing(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``points``, sorted by their first, whose second increases: patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(points)
    for i, (_, y) in enumerate(points):
        pile = bisect_left(tops, y)
        if pile == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[pile], piles[pile] = y, i
        back[i] = piles[pile - 1] if pile else -1
    chain = []
    i = piles[-1] if piles else -1
    while i >= 0:
        chain.append(points[i])
        i = back[i]
    chain.reverse()
    return chain


def anchors(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places of the lines that are unique in both; if there are none, of the k-th occurrences of each."""
    of_a, of_b = Counter(a), Counter(b)
    at = {x: j for j, x in enumerate(b)}
    unique = [(i, at[x]) for i, x in enumerate(a) if of_a[x] == 1 == of_b[x]]
    if unique:
        return unique
    places: dict[bytes, list[int]] = {}
    for j, x in enumerate(b):
        if x in of_a:
            places.setdefault(x, []).append(j)
    turn = {x: iter(p) for x, p in places.items()}
    out = []
    for i, x in enumerate(a):
        j = next(turn[x], None) if x in turn else None
        if j is not None:
            out.append((i, j))
    return out


def patience(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places of two documents' lines, increasing on both sides."""
    common = set(a) & set(b)
    i_of = [i for i, x in enumerate(a) if x in common]
    j_of = [j for j, x in enumerate(b) if x in common]
    a, b = [a[i] for i in i_of], [b[j] for j in j_of]
    found = []
    parts = [(0, len(a), 0, len(b), 0)]
    while parts:
        low_a, high_a, low_b, high_b, depth = parts.pop()
        while low_a < high_a and low_b < high_b and a[low_a] == b[low_b]:
            found.append((low_a, low_b))
            low_a, low_b = low_a + 1, low_b + 1
        while low_a < high_a and low_b < high_b and a[high_a - 1] == b[high_b - 1]:
            high_a, high_b = high_a - 1, high_b - 1
            found.append((high_a, high_b))
        if low_a == high_a or low_b == high_b or depth == DEPTH:
            continue
        chain = increasing(anchors(a[low_a:high_a], b[low_b:high_b]))
        last_a, last_b = low_a, low_b
        for i, j in chain:
            i, j = low_a + i, low_b + j
            found.append((i, j))
            parts.append((last_a, i, last_b, j, depth + 1))
            last_a, last_b = i + 1, j + 1
        if chain:
            parts.append((last_a, high_a, last_b, high_b, depth + 1))
    return sorted((i_of[i], j_of[j]) for i, j in found)


def blocks_of(chain: list[tuple[int, int]], words: list[int], min_words: int = MIN_WORDS) -> set[int]:
    """Places, on the later side, of the runs of one diagonal with ``min_words`` words or more."""
    out: set[int] = set()
    run: list[tuple[int, int]] = []
    for point in [*chain, None]:
        if run and (
            point is None or point[0] - run[-1][0] > MAX_GAP or point[0] - run[-1][0] != point[1] - run[-1][1]
        ):
            if sum(words[i] for i, _ in run) >= min_words:
                out.update(i for i, _ in run)
            run = []
        if point is not None:
            run.append(point)
    return out


def grown(a: list[bytes], b: list[bytes], words: list[int], min_words: int, gone: set[int]) -> set[int]:
    """Places in further blocks than those of ``gone``.

    A line outside ``gone`` is looked for at each of its places in ``b``, or at
    the first one if there are more than ``SEEDS``, and its diagonal is followed
    both ways while gaps stay below ``MAX_GAP``, into taken lines only until the
    block is long enough. A block that is takes its lines; one that is not is
    short. So the work is linear.
    """
    places: dict[bytes, list[int]] = {}
    for j, x in enumerate(b):
        held = places.setdefault(x, [])
        if len(held) <= SEEDS:
            held.append(j)
    taken = set(gone)
    for i, x in enumerate(a):
        held = places.get(x, ())
        for j in held if len(held) <= SEEDS else held[:1]:
            if i in taken:
                break
            block, total = [i], words[i]
            for way in (1, -1):
                at, gap = i, 0
                while gap < MAX_GAP:
                    at += way
                    if not (0 <= at < len(a) and 0 <= at + j - i < len(b)):
                        break
                    gap += 1
                    if a[at] == b[at + j - i]:
                        if total >= min_words and at in taken:
                            break
                        block.append(at)
                        total += words[at]
                        gap = 0
            if total >= min_words:
                taken.update(block)
    return taken


def overlap(
    a: list[bytes], b: list[bytes], words: list[int], min_words: int = MIN_WORDS, every_copy: bool = False
) -> set[int]:
    """Places of ``a`` that go, given the earlier document's lines ``b``."""
    if a == b:
        return set(range(len(a))) if sum(words) >= min_words else set()
    gone = blocks_of(patience(a, b), words, min_words)
    return grown(a, b, words, min_words, gone) if every_copy else gone


def _lists(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints = pa.list_(pa.int32())
    for block in blocks:
        for begin in range(0, block.num_rows, 500):
            some = block.slice(begin, 500)
            found = [lines_of(t or "") for t in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0),
                    some.column(1),
                    pa.array([h for h, _, _ in found], pa.binary()),
                    pa.array([w for _, w, _ in found], ints),
                    pa.array([n for _, _, n in found], ints),
                ],
                names=["did", "tkey", "hashes", "words", "lines"],
            )


def _keys(min_words: int):
    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for begin in range(0, block.num_rows, 500):
                out: list[list] = [[], [], []]
                columns = (c.to_pylist() for c in block.slice(begin, 500).columns)
                for did, tkey, hashes, words in zip(*columns, strict=True):
                    own = keys_of(cut(hashes), words, min_words)
                    out[0] += [did] * len(own)
                    out[1] += [tkey] * len(own)
                    out[2] += own
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["did", "tkey", "h"],
                )

    return run


def _deletions(min_words: int, every_copy: bool):
    """Rows sorted by document, its own lines (``own``) before those of its partners, to ``(did, tkey, removed)``."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: tuple | None = None
        hashes: list[bytes] = []
        words: list[int] = []
        lines: list[int] = []
        gone: set[int] = set()
        out: list[list] = [[], [], []]

        def close() -> None:
            if gone:
                for col, v in zip(out, (*doc, sorted(lines[i] for i in gone)), strict=True):
                    col.append(v)

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["did", "tkey", "removed"]
            )
            for col in out:
                col.clear()
            return made

        for block in blocks:
            for begin in range(0, block.num_rows, 500):
                columns = (c.to_pylist() for c in block.slice(begin, 500).columns)
                for did, tkey, own, raw, w, n in zip(*columns, strict=True):
                    if own:
                        close()
                        doc, hashes, words, lines, gone = (did, tkey), cut(raw), w, n, set()
                        continue
                    other = cut(raw)
                    shared = set(other)
                    if any(x in shared and i not in gone for i, x in enumerate(hashes)):
                        gone |= overlap(hashes, other, words, min_words, every_copy)
                if len(out[0]) > 5000:
                    yield batch()
        close()
        yield batch()

    return run


def keyed(docs: DataFrame) -> DataFrame:
    did = F.coalesce(F.col("doc_id"), F.lit(_FIRST)).alias("did")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", did, F.xxhash64(text).alias("tkey"), text.alias("text"))


def line_lists(docs: DataFrame) -> DataFrame:
    """``did, tkey, hashes, words, lines``: one row for each distinct document."""
    every = keyed(docs).select("did", "tkey", "text").mapInArrow(_lists, LISTS)
    same = [F.first(c).alias(c) for c in ("hashes", "words", "lines")]
    return every.groupBy("did", "tkey").agg(*same)


def document_pairs(lists: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """``did, tkey, o_did, o_tkey``: each document beside the earlier ones to align it with."""
    held = lists.select("did", "tkey", "hashes", "words")
    keys = materialise(held.mapInArrow(_keys(min_words), "did long, tkey long, h binary"), "line-keys")
    owners = (
        keys.groupBy("h")
        .agg(F.min(F.struct("did", "tkey")).alias("o"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h", "n", F.col("o.did").alias("o_did"), F.col("o.tkey").alias("o_tkey"))
    )
    owners = materialise(owners, "line-owners")
    shared = lookup(keys, owners, "h", ["n", "o_did", "o_tkey"], "n", keys.count()).where("n IS NOT NULL")
    shared = materialise(shared, "line-shared")
    common = shared.where((F.col("n") > rare) & ~((F.col("o_did") == F.col("did")) & (F.col("o_tkey") == F.col("tkey"))))
    # at most ``rare`` members a key
    members = shared.where(F.col("n") <= rare).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("did", "tkey"))).alias("m"))
    earlier = F.transform(
        "m",
        lambda x, i: F.transform(
            F.slice("m", F.lit(1), i),
            lambda y: F.struct(x["did"].alias("did"), x["tkey"].alias("tkey"), y["did"].alias("o_did"), y["tkey"].alias("o_tkey")),
        ),
    )
    pairs = members.select(F.inline(F.flatten(earlier)))
    return pairs.unionByName(common.select("did", "tkey", "o_did", "o_tkey")).distinct()


def removed_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, every_copy: bool = False, rare: int = RARE
) -> DataFrame:
    """``did, tkey, removed array<int>`` of the documents that lose lines.

    Earlier documents that are in over 1/1024 of the pairs, at most 1024 by
    counting, are laid out ``SPREAD`` times and their pairs dealt among the copies.
    """
    lists = materialise(line_lists(docs), "line-lists")
    pairs = materialise(document_pairs(lists, min_words, rare), "line-pairs")
    other = [F.col("did").alias("o_did"), F.col("tkey").alias("o_tkey")]
    hot = pairs.groupBy("o_did", "o_tkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 1024 > pairs.count())
    hot = F.broadcast(materialise(hot.select("o_did", "o_tkey", F.lit(True).alias("hot")), "line-hot"))
    on = ["o_did", "o_tkey"]
    dealt = F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("did", "tkey"), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("hot"), F.sequence(F.lit(1), F.lit(SPREAD))).otherwise(F.array(F.lit(0)))
    left = pairs.join(hot, on, "left").withColumn("copy", dealt)
    right = lists.select(*other, "hashes").join(hot, on, "left").select(*on, "hashes", F.explode(copies).alias("copy"))
    nothing = F.lit(None).cast("array<int>")
    partners = left.join(right, [*on, "copy"]).select(
        "did", "tkey", *on, F.lit(False).alias("own"), "hashes", nothing.alias("words"), nothing.alias("lines")
    )
    none = F.lit(None).cast("long")
    own = lists.select(
        "did", "tkey", none.alias("o_did"), none.alias("o_tkey"), F.lit(True).alias("own"), "hashes", "words", "lines"
    )
    return (
        own.unionByName(partners)
        .repartition("did", "tkey")
        .sortWithinPartitions("did", "tkey", F.desc("own"), *on)
        .select("did", "tkey", "own", "hashes", "words", "lines")
        .mapInArrow(_deletions(min_words, every_copy), "did long, tkey long, removed array<int>")
    )


def without_lines(text: str, removed: list[int] | None) -> str:
    if not removed:
        return text
    gone = set(removed)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def _strip(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks:
        for begin in range(0, block.num_rows, 500):
            some = block.slice(begin, 500)
            ids, texts, removed = (c.to_pylist() for c in some.columns)
            left = [without_lines(t, r) for t, r in zip(texts, removed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(left, pa.string()),
                    pa.array([t.count("\n") + 1 for t in texts], pa.int32()),
                    pa.array([r or [] for r in removed], pa.list_(pa.int32())),
                ],
                names=["doc_id", "text", "n_lines", "removed"],
            )


def line_dedup(
    docs: DataFrame, min_words: int = MIN_WORDS, every_copy: bool = False, rare: int = RARE
) -> DataFrame:
    """``doc_id, text`` without the deleted lines, ``n_lines`` before, ``removed`` line numbers.

    The deletions grow with the corpus, so texts meet them in a merge join at
    every size and not in a broadcast where the corpus happens to be small.
    """
    gone = materialise(removed_lines(docs, min_words, every_copy, rare), "removed-lines")
    joined = keyed(docs).join(gone.hint("merge"), ["did", "tkey"], "left").select("doc_id", "text", "removed")
    return joined.mapInArrow(_strip, "doc_id long, text string, n_lines int, removed array<int>")


def query(docs: DataFrame) -> DataFrame:
    return line_dedup(docs, every_copy=True).select(
        "doc_id",
        "n_lines",
        F.size("removed").alias("n_removed"),
        F.array_join("removed", ",").alias("removed_lines"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
