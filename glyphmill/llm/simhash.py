"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two that differ in at most three bits
share at least five of them: the guaranteed minimum. Of any five positions
three lie in one half, so a posting is keyed by three positional bytes of one
half (eight keys a fingerprint) and no linked pair can be missed. Inside a
posting the shared positional bytes of pairs are tallied, pairs that reach five
are verified by their differing bits, and what is emitted is a tree for each
connected part, not pairs. A posting above ``heavy`` members is split further
by two of the five other bytes (two must agree besides the three), after which
a posting can hold at most 2^24 fingerprints.

Equal fingerprints are collapsed first. Components are found by alternating
large-star and small-star joins, materialised after each round.

Defined results: null and word-free texts have fingerprint zero and link like
any other; fewer words than a shingle give one shingle of them all; words may
be of any length and texts are read in blocks; repeated rows share a component;
a null ``doc_id`` is kept and never names a component unless alone; of each
component exactly one row survives, repeated rows and repeated ids included; an
empty table gives an empty result; further columns of the input, whatever their
names, are ignored by decisions and kept by ``surviving``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm._tables import boxed, lookup, materialise, unboxed

SHINGLE = 3
SEED = 42
MAX_BITS = 3
MIN_MATCHES = 8 - MAX_BITS
HEAVY = 16_384
BLOCK = 1 << 20
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_SHIFT = np.arange(8, dtype=np.uint64) * np.uint64(8)
#: A byte's bits, most significant first, as eight counters of one byte each.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64)[:, 0]


def _blocks(raw: bytes) -> Iterator[list[bytes]]:
    """A text's words in bounded runs, each cut at a blank."""
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + BLOCK) if at + BLOCK < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end + 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is one if it is one in over half of the shingles' hashes."""
    total, ones, carry, met = 0, np.zeros(64, np.int64), [], 0
    hashed = xxhash.xxh64_intdigest
    for words in _blocks((text or "").encode().lower()):
        met += len(words)
        words = carry + words
        h = [hashed(b" ".join(g), SEED) for g in zip(*[words[i:] for i in range(shingle)])]
        carry = words[max(0, len(words) - shingle + 1) :]
        if h:
            total += len(h)
            ones += _bit_counts(h)
    if 0 < met < shingle:
        total, ones = 1, _bit_counts([hashed(b" ".join(carry), SEED)])
    out = 0
    for bit in (ones * 2 > total).tolist():
        out = out << 1 | bit
    return out


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How often each of 64 bits, most significant first, is one."""
    raw = np.asarray(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    sums = np.add.reduceat(_COUNTERS[raw], np.arange(0, len(raw), 255), axis=0)
    return np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def text_key(text: Column) -> Column:
    """Tells apart rows that share a ``doc_id``."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, fp``: the text's key, and the unsigned fingerprint's bits as a signed long."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for at in range(0, block.num_rows, 500):
                some = block.slice(at, 500)
                fps = np.asarray([fingerprint(t) for t in some.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).cast(pa.int64()), some.column(2), pa.array(fps.view(np.int64))],
                    names=["doc_id", "tkey", "fp"],
                )

    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("tkey"))
    return keyed.mapInArrow(run, "doc_id long, tkey long, fp long")


def tally(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Positional bytes shared by each pair."""
    differ = np.ascontiguousarray(a ^ b).view(np.uint8).reshape(-1, 8)
    return 8 - np.count_nonzero(differ, axis=1)


def linked(a: np.ndarray, b: np.uint64, max_bits: int = MAX_BITS) -> np.ndarray:
    """Which of ``a`` reach the minimum of shared bytes with ``b`` and then verify."""
    out = np.zeros(len(a), bool)
    near = np.flatnonzero(tally(a, b) >= 8 - max_bits)
    out[near] = np.bitwise_count(a[near] ^ b) <= max_bits
    return out


def trees(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """``(least, other)`` for the connected parts of distinct fingerprints.

    Those not yet reached are searched from each one reached, so that a dense
    ball costs little more than its size. Large inputs are first split on two
    further bytes, which keeps far-apart members from meeting at all.
    """
    if len(fps) > 2048:
        yield from _split_trees(fps)
        return
    left = np.sort(fps)
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = linked(left, queue.pop())
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                for x in found:
                    yield int(root), int(x)


def _split_trees(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    raw = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
    free = [p for p in range(8) if (raw[:, p] != raw[0, p]).any()]
    if len(free) < 5:  # shared bytes cannot tell members apart: search the ball itself
        left = np.sort(fps)
        while len(left):
            root, left = left[0], left[1:]
            queue = [root]
            while queue and len(left):
                near = np.bitwise_count(left ^ queue.pop()) <= MAX_BITS
                if near.any():
                    found, left = left[near], left[~near]
                    queue.extend(found)
                    for x in found:
                        yield int(root), int(x)
        return
    need = MIN_MATCHES - (8 - len(free))
    for chosen in combinations(free, max(1, min(2, need))):
        key = np.zeros(len(fps), np.uint64)
        for p in chosen:
            key = key << np.uint64(8) | raw[:, p]
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(fps[order], cuts):
            if len(part) == len(fps):
                raise AssertionError("a byte that varies cannot leave its group whole")
            if len(part) > 1:
                yield from trees(part)


def _postings(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, fp)`` sorted by key, to the trees of each key's members."""
    pairs: list[tuple[int, int]] = []

    def batch() -> pa.RecordBatch:
        found = np.asarray(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        pairs.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["u", "v"]
        )

    def search(members: list[np.ndarray]) -> None:
        if sum(map(len, members)) > 1:
            pairs.extend(trees(np.unique(np.concatenate(members).view(np.uint64))))

    held: list[np.ndarray] = []
    held_key: int | None = None
    for block in blocks:
        keys = block.column(0).to_numpy(zero_copy_only=False)
        fps = block.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if a == b:
                continue
            if keys[a] != held_key:
                search(held)
                held, held_key = [], keys[a]
            held.append(fps[a:b])
        held = [np.concatenate(held)] if held else []
        if len(pairs) > 20_000:
            yield batch()
    search(held)
    yield batch()


def links(distinct: DataFrame, n: int, heavy: int = HEAVY) -> DataFrame:
    """``(u, v)`` trees over distinct fingerprints (column ``fp``).

    Postings over ``max(heavy, n / 8192)`` members, of which there are at most
    65,536 by counting, are split; their keys are broadcast.
    """
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]

    def packed(tag: int, chosen: tuple[int, ...]):
        key = F.lit(tag).cast("long")
        for p in chosen:
            key = key * 256 + byte[p]
        return key

    keys = F.array(*[packed(t + 1, c) for t, c in enumerate(TRIPLES)])
    index = materialise(distinct.select("fp", F.explode(keys).alias("key")), "simhash-index")
    limit = max(heavy, n // 8192)
    big = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("key")
    big = F.broadcast(materialise(big, "simhash-heavy").withColumn("_big", F.lit(True)))
    marked = index.join(big, "key", "left")
    plain = marked.where(F.col("_big").isNull()).select("key", "fp")
    split = marked.where(F.col("_big").isNotNull())
    finer = []
    for t, chosen in enumerate(TRIPLES):
        rest = [p for p in range(8) if p not in chosen]
        for s, two in enumerate(combinations(rest, 2)):
            finer.append(F.struct(F.lit(t + 1).alias("t"), packed(64 + 16 * t + s, chosen + two).alias("k")))
    by_tag = F.filter(F.array(*finer), lambda x: x["t"] == F.shiftright("key", 24))
    split = split.select(F.explode(F.transform(by_tag, lambda x: x["k"])).alias("key"), "fp")
    together = plain.unionByName(split)
    return (
        together.repartition("key").sortWithinPartitions("key").mapInArrow(_postings, "u long, v long")
    )


def _signature(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(mixed), F.lit(0))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``; the root is the least node.

    Large-star and small-star rounds until the star edges no longer change.
    Hubs are met by map-side minima and by joins that AQE may split.
    """
    edges = materialise(
        edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).where("u <> v").distinct(),
        "cc",
    )
    sign = _signature(edges)
    for _ in range(max_rounds):
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
            edges.select(F.col("v").alias("a"), F.col("u").alias("b"))
        )
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("v"), F.col("m").alias("u"))
        large = large.where("u <> v").distinct()
        large = materialise(large, "cc-large")
        small_min = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(small_min, "v").select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u"))
        edges = materialise(small.where("u <> v").distinct(), "cc")
        now = _signature(edges)
        if sign == now:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node")


def _grouped(docs: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``doc_id, tkey, fp``; fingerprints ``fp, least, n, root``; components ``root, first``.

    ``first`` is the component's first row: ids before nulls, the least id, then the text's key.
    """
    rows = materialise(fingerprints(docs), "simhash-rows")
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tkey")
    groups = materialise(
        rows.groupBy("fp").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("n")), "simhash-groups"
    )
    n = groups.count()
    roots = components(links(groups.select("fp"), n, heavy))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialise(rooted, "simhash-rooted")
    return rows, rooted, rooted.groupBy("root").agg(F.min("least").alias("first"))


def near_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    rows, rooted, firsts = _grouped(docs, heavy)
    named = firsts.select("root", F.col("first.doc_id").alias("component_id"))
    known = rooted.join(named, "root").select("fp", "n", "component_id")
    return lookup(rows.drop("tkey"), known, "fp", ["component_id"], "n", rows.count())


def surviving(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row of ``docs`` for each component, with its columns.

    Only components' first rows meet the texts, by one key that also serves the
    pass over repeated rows; so texts are shuffled once.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keep = _grouped(docs, heavy)[2].select("first.*").select(name.alias("name"), F.col("tkey").alias("tkey"))
    tagged = boxed(docs, "doc_id", "text").select("own", name.alias("name"), text_key(F.col("text")).alias("tkey"))
    first = Window.partitionBy("name", "tkey").orderBy(F.lit(0))
    hit = tagged.join(keep, ["name", "tkey"], "left_semi").withColumn("copy", F.row_number().over(first))
    return unboxed(hit.where("copy = 1"), docs)


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
