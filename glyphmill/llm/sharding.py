"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Groups of equal texts are never split. Differencing runs in levels so that no
task and not the driver ever holds all groups: hash buckets of about
``bucket_rows`` groups are each differenced into ``3 * LUMPS`` lumps of three
grain sizes, lumps are differenced again while they are more than
``item_bound``, and one last differencing places the lumps, and those groups
that alone hold over 1/4096 of all bytes, into shards. The fine lumps let the
last differencing even out what the coarse ones leave.

Defined results: null text has no bytes and equals empty text; each row has
size bytes + 1; a group larger than a shard's fair share fills a shard by
itself; repeated rows stay together and get a slot each; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm._tables import lookup, materialise, running_offsets, sha256

LUMPS = 32
GRAINS = (0.9, 0.99)
PER_BUCKET = LUMPS * (len(GRAINS) + 1)
GIANT_SHARE = 4096
SLOT_BUCKETS = 1024


def difference(sizes: list[int], k: int) -> list[int]:
    """The bin, 0 to ``k - 1``, of each item after k-way largest differencing.

    A partial partition is a descending list of ``(sum, first, last)``: a bin's
    sum and the chain of its items. Bins that are still empty are left out.
    """
    if not sizes:
        return []
    chain = [-1] * len(sizes)
    heap: list[tuple[int, int, list[tuple[int, int, int]]]] = [
        (-s if k > 1 else 0, i, [(s, i, i)]) for i, s in enumerate(sizes)
    ]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            cut = len(a) - over
            merged = a[:cut]
            for (sa, fa, la), (sb, fb, lb) in zip(a[cut:], reversed(b[len(b) - over :]), strict=True):
                chain[la] = fb
                merged.append((sa + sb, fa, lb))
            merged += b[: len(b) - over]
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], serial, merged))
        serial += 1
    bins = [0] * len(sizes)
    for j, (_, item, _) in enumerate(heap[0][2]):
        while item >= 0:
            bins[item] = j
            item = chain[item]
    return bins


def into_lumps(sizes: list[int]) -> list[int]:
    """Lump numbers, below ``3 * LUMPS``: coarse ones of the large items, fine ones of the small."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    total, seen = sum(sizes), 0
    tiers: list[list[int]] = [[] for _ in range(len(GRAINS) + 1)]
    for i in order:
        tiers[sum(seen >= g * total for g in GRAINS)].append(i)
        seen += sizes[i]
    out = [0] * len(sizes)
    for t, members in enumerate(tiers):
        for i, b in zip(members, difference([sizes[i] for i in members], LUMPS), strict=True):
            out[i] = t * LUMPS + b
    return out


def _lump_bucket(group: pd.DataFrame) -> pd.DataFrame:
    ordered = group.sort_values(["bytes", "item"], kind="stable")
    lumps = into_lumps(ordered["bytes"].tolist())
    return pd.DataFrame(
        {
            "item": ordered["item"].to_numpy(),
            "bytes": ordered["bytes"].to_numpy(),
            "lump": ordered["bucket"].to_numpy() * PER_BUCKET + lumps,
        }
    )


def _level(items: DataFrame, kind: str, n: int, bucket_rows: int) -> DataFrame:
    """One level: ``(item, bytes)`` to ``(item, bytes, lump)``."""
    buckets = max(1, -(-n // bucket_rows))
    return materialise(
        items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("long"))
        .groupBy("bucket")
        .applyInPandas(_lump_bucket, f"item {kind}, bytes long, lump long"),
        "lumps",
    )


def assign_groups(
    groups: DataFrame, n_shards: int, bucket_rows: int = 20_000, item_bound: int = 1 << 18
) -> DataFrame:
    """``(gid binary, bytes long)``, a row per group, to ``(gid, shard int)``."""
    spark = groups.sparkSession
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    giant = F.col("bytes") * GIANT_SHARE > F.lit(total)
    giants = [(bytes(r.gid), r.bytes) for r in groups.where(giant).select("gid", "bytes").collect()]
    giants.sort(key=lambda x: (-x[1], x[0]))
    placed = _level(groups.where(~giant).select(F.col("gid").alias("item"), "bytes"), "binary", n, bucket_rows)
    sums = materialise(placed.groupBy("lump").agg(F.sum("bytes").alias("bytes")), "lump-sums")
    count = sums.count()
    while count > max(item_bound, PER_BUCKET):
        # buckets of several times the lumps that each is turned into, so that every level has fewer
        up = _level(sums.withColumnRenamed("lump", "item"), "long", count, max(bucket_rows, 4 * PER_BUCKET))
        step = up.select(F.col("item").alias("lump"), F.col("lump").alias("next"))
        placed = placed.join(step, "lump").select("item", "bytes", F.col("next").alias("lump"))
        sums = materialise(up.groupBy("lump").agg(F.sum("bytes").alias("bytes")), "lump-sums")
        count = sums.count()
    lumps = sorted(((r.lump, r.bytes) for r in sums.collect()), key=lambda x: (-x[1], x[0]))
    bins = difference([b for _, b in giants] + [b for _, b in lumps], n_shards)
    by_giant = [(g, s) for (g, _), s in zip(giants, bins, strict=False)]
    by_lump = [(x, s) for (x, _), s in zip(lumps, bins[len(giants) :], strict=True)]
    small = spark.createDataFrame(by_lump, "lump long, shard int")
    big = spark.createDataFrame(by_giant, "gid binary, shard int")
    return placed.join(F.broadcast(small), "lump").select(F.col("item").alias("gid"), "shard").unionByName(big)


def shard_documents(
    docs: DataFrame, n_shards: int = 8, bucket_rows: int = 20_000, item_bound: int = 1 << 18
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            sha256(text).alias("gid"),
        ),
        "shard-rows",
    )
    groups = materialise(
        rows.groupBy("gid").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups"
    )
    shards = groups.select("gid", "n").join(assign_groups(groups, n_shards, bucket_rows, item_bound), "gid")
    placed = lookup(rows, shards, "gid", ["shard"], "n", rows.count()).drop("gid")
    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int")
    placed = materialise(placed.withColumn("part", part), "shard-placed")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = running_offsets(counts, ["shard"], "part", "n", "start").drop("n")
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at") - 1).alias("slot"))
    )


def query(docs: DataFrame) -> DataFrame:
    return shard_documents(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def spread(bins: list[int], sizes: list[int], k: int) -> int:
    """Largest bin minus smallest, for tests and reports."""
    sums = [0] * k
    for b, s in zip(bins, sizes, strict=True):
        sums[b] += s
    return max(sums) - min(sums)

