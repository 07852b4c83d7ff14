import itertools
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), max_size=60), st.integers(1, 9))
def test_difference_is_a_partition(sizes, k):
    bins = sharding.difference(sizes, k)
    assert len(bins) == len(sizes) and all(0 <= b < k for b in bins)
    if sizes:
        sums = [sum(s for s, b in zip(sizes, bins) if b == j) for j in range(k)]
        assert max(sums) - min(sums) == sharding.spread(bins, sizes, k) <= max(sizes) * (1 if k > 1 else 99)


def greedy(sizes, k):
    """The largest first, each into the lightest bin."""
    sums, bins = [0] * k, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = min(range(k), key=sums.__getitem__)
        sums[bins[i]] += sizes[i]
    return bins


def least_spread(sizes, k):
    """The best of all assignments."""
    return min(sharding.spread(list(b), sizes, k) for b in itertools.product(range(k), repeat=len(sizes)))


def test_difference_beats_greedy():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100_000) for _ in range(4000)]
    assert sharding.spread(sharding.difference(sizes, 8), sizes, 8) <= 3
    assert sharding.spread(sharding.difference([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4], 2) == 2
    better = worse = 0
    for _ in range(50):
        sizes = [rng.randint(1, 10_000) for _ in range(rng.randint(20, 200))]
        own = sharding.spread(sharding.difference(sizes, 8), sizes, 8)
        other = sharding.spread(greedy(sizes, 8), sizes, 8)
        better, worse = better + (own < other), worse + (own > other)
    assert better >= 45 and worse <= 3


def test_difference_against_the_optimum():
    rng = random.Random(2)
    own = best = other = 0
    for _ in range(30):
        sizes = [rng.randint(1, 1000) for _ in range(8)]
        own += sharding.spread(sharding.difference(sizes, 3), sizes, 3)
        other += sharding.spread(greedy(sizes, 3), sizes, 3)
        best += least_spread(sizes, 3)
        assert sharding.spread(sharding.difference(sizes, 3), sizes, 3) >= least_spread(sizes, 3)
    assert best <= own < other


def test_shards_are_as_even_as_the_largest_group_allows(spark):
    rng = random.Random(3)
    texts = ["x" * rng.randint(0, 400) + str(i // 3) for i in range(3000)]  # groups of up to three
    texts = [texts[i - i % 3] if rng.random() < 0.5 else t for i, t in enumerate(texts)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"bucket_rows": 100, "item_bound": 200}):
        sums = [r.s for r in sharding.shard_documents(table, **options).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
        assert len(sums) == 8 and max(sums) - min(sums) <= 8


def test_shards(docs, rows, none):
    for options in ({}, {"bucket_rows": 10, "item_bound": 20}):  # one level, several levels
        got = sharding.shard_documents(docs, **options).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
        text = {r[0]: r[1] or "" for r in rows}
        group, slots, size = {}, {}, [0] * 8
        for r in got:
            raw = text[r.doc_id].encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
            assert group.setdefault(raw, r.shard) == r.shard
            slots.setdefault(r.shard, []).append(r.slot)
            size[r.shard] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        largest = max(size)
        others = sorted(size)[:-1]  # the very long text fills a shard by itself
        assert largest > 30_000 and others[-1] - others[0] < 0.1 * others[-1] + 2000
    assert sharding.query(none).count() == 0
    first = sharding.query(docs).first()
    assert first.law == "bytes" and first.grown_shard is None


def test_same_at_any_partitioning(docs):
    a = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(docs).collect()}
    assert a == {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(docs.repartition(7)).collect()}
