import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from glyphmill.llm import mixing
from glyphmill.llm.mixing import LEVELS, Mix


def share_out(budget, children):
    """``{name: (weight, cap)}`` to budgets: saturate and share again until nothing changes."""
    out, open_, rest = {}, dict(children), budget
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [k for k, (w, c) in open_.items() if c <= Fraction(rest * w, total)]
        if not full:
            return out | {k: rest * w // total for k, (w, _) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[1]
        rest = budget - sum(out.values())
    return out


def brute_budgets(leaves, total, mix):
    def weight(level, label):
        return getattr(mix, level).get(label, mix.other)

    def walk(depth, prefix, budget):
        if depth == 3:
            return {prefix: budget}
        below = defaultdict(int)
        for leaf, tokens in leaves.items():
            if leaf[:depth] == prefix:
                below[leaf[depth]] += tokens * mix.max_epochs
        shares = share_out(budget, {k: (weight(LEVELS[depth], k), c) for k, c in below.items()})
        out = {}
        for k, b in shares.items():
            out |= walk(depth + 1, (*prefix, k), b)
        return out

    return walk(0, (), total)


def check(docs, mix):
    drawn = mixing.draw(docs, mix).collect()
    key = F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), F.col("e"), F.col("doc_id")), 1)
    labels = mixing._labels()
    units = (
        docs.select("doc_id", *[v.alias(k) for k, v in labels.items()], mixing.word_count(F.col("text")).alias("n"))
        .groupBy("doc_id", *LEVELS)
        .agg(F.sum("n").alias("n"))
        .withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(mix.max_epochs))))
        .withColumn("key", key)
        .collect()
    )
    leaves, order = defaultdict(int), defaultdict(list)
    for u in units:
        leaf = (u.domain, u.lang, u.source)
        leaves[leaf] += u.n * (u.e == 0)
        order[leaf, u.e].append((u.key, u.doc_id is not None, u.doc_id or 0, u.doc_id, u.n))
    budgets = brute_budgets(leaves, int(sum(leaves.values()) * mix.share), mix)
    expected = []
    for leaf, tokens in leaves.items():
        whole, rest = divmod(budgets[leaf], tokens) if tokens else (0, -1)
        expected += [(x[3], *leaf, e) for e in range(whole) for x in order[leaf, e]]
        at, rest = 0, rest or -1
        for x in sorted(order[leaf, whole], key=lambda x: x[:3]):
            at += x[4]
            if at <= rest:
                expected.append((x[3], *leaf, whole))
    got = [(r.doc_id, r.domain, r.lang, r.source, r.epoch) for r in drawn]
    order_of = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(got, key=order_of) == sorted(expected, key=order_of)
    return drawn


def test_against_brute_force(docs, none):
    check(docs, Mix())
    epochs = {r.epoch for r in check(docs, Mix(share=1.4, domain={"dom2": 9}, source={"src1": 5}, max_epochs=2, seed=1))}
    assert epochs == {0, 1}
    assert {r.epoch for r in check(docs, Mix(share=50.0, max_epochs=2))} == {0, 1}
    assert mixing.query(none).count() == 0


def test_any_number_of_slices(docs, monkeypatch):
    for bits in (0, 7):
        monkeypatch.setattr(mixing, "MORE_BITS", bits)
        check(docs, Mix(share=0.7))


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    mix = Mix(domain={}, lang={}, max_epochs=1)
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 800, mix).collect()}
    assert got == {"1": 10, "2": 190, "3": 200, "4": 400}


def test_mixed_keeps_columns(docs):
    out = mixing.mixed(docs, Mix(share=1.4, max_epochs=2))
    assert out.columns == docs.columns
    assert out.count() >= mixing.draw(docs, Mix(share=1.4, max_epochs=2)).count()


def test_many_sources_of_one_parent(spark):
    rng = random.Random(6)
    for case in range(2):
        sizes = [rng.choice([0, 1, 7, 100, 10**12]) + rng.randint(0, 3) * case + rng.randint(0, 40) for _ in range(600)]
        rows = [("a", "x", f"s{i}", n) for i, n in enumerate(sizes)] + [("a", "y", "t", 50), ("b", "x", "u", 10**9)]
        leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
        mix = Mix(domain={"a": 3}, lang={}, source={f"s{i}": i % 4 + 1 for i in range(0, 600, 5)}, max_epochs=2)
        for share in (0.001, 0.9, 1.5):
            total = int(sum(r[3] for r in rows) * share)
            expected = brute_budgets({r[:3]: r[3] for r in rows}, total, mix)
            got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, total, mix).collect()}
            assert got == expected, (case, share)
