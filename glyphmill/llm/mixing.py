"""Mixing to target weights over a domain / language / source tree.

Every node may take at most ``max_epochs`` times its documents' tokens. From
the root down, a parent's budget is shared among its children by weight; what a
child cannot take goes to its siblings, and only what a whole subtree cannot
take reaches the level above. Within a leaf each epoch has its own seeded
order; whole epochs are taken while the budget lasts, then, if tokens are left,
the longest prefix that fits of the next one.

Prefix sums run in two steps, over slices of the order's hash and then inside
a slice. A leaf of n documents has some 4 to 8 times the root of n slices, so
that one with a third of all rows still spreads out, and neither its slices nor
the documents of one are many.

Defined results: null labels form the label ``(none)``; null and empty texts
have no tokens and come along where the prefix reaches them; rows that share
``doc_id`` and leaf are drawn together; shares are rounded down; a leaf without
tokens has no budget, and its documents are not drawn; an empty table gives an
empty result; further columns of the input, whatever their names, are ignored
by the draw and kept by ``mixed``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm._tables import boxed, lookup, materialise, unboxed

NONE = "(none)"
MORE_BITS = 2
BUCKETS_AN_OCTAVE = 1024
SLACK = 1e-9
LEVELS = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Mix:
    """Integer weights by level and label; labels that are not named weigh ``other``."""

    share: float = 0.5
    domain: dict[str, int] = field(default_factory=lambda: {"dom0": 4, "dom1": 3, "dom2": 2, "dom3": 1})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    source: dict[str, int] = field(default_factory=dict)
    other: int = 1
    max_epochs: int = 3
    seed: int = 17

    def weight(self, level: str, label: Column) -> Column:
        named: dict[str, int] = getattr(self, level)
        out = F.lit(self.other)
        for name, w in sorted(named.items()):
            out = F.when(label == name, F.lit(w)).otherwise(out)
        return out.cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo four, or ``other``."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(digits != "", F.concat(F.lit("dom"), (digits.cast("long") % 4).cast("string"))).otherwise(
        F.lit("other")
    )


def _share_out(children: DataFrame, parents: list[str], label: str, mix: Mix) -> DataFrame:
    """``children`` with ``cap`` and the parent's ``budget``, to their own ``budget``.

    In the order of ``cap / weight`` children are full while that ratio is at
    most what is left for each unit of weight; from the first that is over it,
    they share the rest. Up to there the rest for a unit only grows, so whole
    buckets of ratios are judged by their extremes, at most some 65,000 for a
    parent, and only the buckets between that may hold the first one are
    searched ratio by ratio. No task orders all children of a parent.
    """
    w = mix.weight(label, F.col(label)).cast("decimal(18,0)")
    rows = children.withColumns({"_w": w, "_c": F.col("cap").cast("decimal(19,0)")})
    rows = rows.withColumn("_x", F.col("cap") / F.col("_w").cast("double"))
    sums = [F.sum("_c").cast("decimal(19,0)").alias("_c"), F.sum("_w").cast("decimal(19,0)").alias("_w")]
    ratios = rows.groupBy(*parents, "budget", "_x").agg(*sums)
    ratios = ratios.withColumn("_bucket", F.floor(F.log2(F.col("_x") + 1) * BUCKETS_AN_OCTAVE))
    buckets = ratios.groupBy(*parents, "budget", "_bucket").agg(*sums, F.min("_x").alias("_low"), F.max("_x").alias("_high"))

    def before(name: str, order: str) -> Column:
        w = Window.partitionBy(*parents).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(w), F.lit(0).cast("decimal(29,0)"))

    whole = Window.partitionBy(*parents)
    buckets = buckets.withColumns(
        {
            "_r": (F.col("budget") - before("_c", "_bucket")).cast("decimal(19,0)"),
            "_sum": (F.sum("_w").over(whole) - before("_w", "_bucket")).cast("decimal(19,0)"),
        }
    )
    unit = F.col("_r").cast("double") / F.col("_sum").cast("double")
    may = F.when(F.col("_high") * (1 + SLACK) >= unit, F.col("_bucket"))
    must = F.when(F.col("_low") > F.greatest(unit, F.lit(0.0)) * (1 + SLACK), F.col("_bucket"))
    searched = buckets.withColumns({"_first": F.min(may).over(whole), "_last": F.min(must).over(whole)})
    searched = searched.where(F.col("_bucket") == F.col("_first")).select(*parents, "_first", "_last", "_r", "_sum")
    inner = _joined(ratios, searched.withColumnsRenamed({"_r": "_r0", "_sum": "_sum0"}), parents).where(
        F.col("_bucket").between(F.col("_first"), F.coalesce("_last", "_bucket"))
    )
    inner = inner.withColumns(
        {
            "_r": (F.col("_r0") - before("_c", "_x")).cast("decimal(19,0)"),
            "_sum": (F.col("_sum0") - before("_w", "_x")).cast("decimal(19,0)"),
        }
    )
    over = F.col("_c") * F.col("_sum") > F.col("_r") * F.col("_w")
    opened = inner.where(over).groupBy(*parents).agg(F.min(F.struct("_x", "_r", "_sum")).alias("_open"))
    part = F.expr("(_open._r * _w) div _open._sum").cast("long")
    own = F.when(F.col("_open").isNull() | (F.col("_x") < F.col("_open._x")), F.col("cap")).otherwise(
        F.least(F.col("cap"), part)
    )
    return _joined(rows, opened, parents).select(*parents, label, "cap", own.alias("budget"))


def _joined(rows: DataFrame, by_parent: DataFrame, parents: list[str]) -> DataFrame:
    """``rows`` with the columns of their parent's row, if there is one; without parents that is at most one."""
    if parents:
        return rows.join(by_parent, parents, "left")
    return rows.join(F.broadcast(by_parent), F.lit(True), "left")


def leaf_budgets(leaves: DataFrame, total: int, mix: Mix) -> DataFrame:
    """``domain, lang, source, tokens`` (a row per leaf) to the same with ``budget``.

    Each level is written, lest the plan grow by a factor with every one.
    """
    capped = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    level = capped.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("budget", F.lit(total).cast("long"))
    level = materialise(_share_out(level, [], "domain", mix), "mix-level")
    for depth in (1, 2):
        above, label = LEVELS[:depth], LEVELS[depth]
        below = capped.groupBy(*above, label).agg(F.sum("cap").alias("cap"))
        level = _share_out(below.join(level.select(*above, "budget"), above), above, label, mix)
        level = materialise(level, "mix-level")
    return leaves.join(level.select(*LEVELS, "budget"), LEVELS)


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _labels() -> dict[str, Column]:
    return {
        "domain": domain_of(F.col("source")),
        "lang": F.coalesce(F.col("lang"), F.lit(NONE)),
        "source": F.coalesce(F.col("source"), F.lit(NONE)),
    }


def draw(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, epoch``: a row per drawn document and epoch."""
    labels = _labels()
    units = materialise(
        docs.select(
            "doc_id", *[c.alias(k) for k, c in labels.items()], word_count(F.col("text")).alias("n_tokens")
        )
        .groupBy("doc_id", *LEVELS)
        .agg(F.sum("n_tokens").alias("n_tokens")),
        "mix-units",
    )
    leaves = materialise(
        units.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mix-leaves"
    )
    tokens, n = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    leaf = F.to_json(F.struct(*LEVELS)).alias("leaf")
    plan = leaf_budgets(leaves, int(tokens * mix.share), mix).select(
        leaf,
        "n",
        F.expr("if(tokens > 0, budget div tokens, 0)").cast("int").alias("whole"),
        F.expr("if(tokens > 0 AND budget % tokens > 0, budget % tokens, -1)").alias("rest"),
    )
    plan = materialise(plan, "mix-plan")
    rows = lookup(units.withColumn("leaf", leaf), plan, "leaf", ["whole", "rest", "n"], "n", n)
    key = F.xxhash64(F.lit(mix.seed), F.col("whole"), F.col("doc_id"))
    bits = (F.ceil(F.log2("n") / 2) + MORE_BITS).cast("int")
    rows = rows.withColumns({"key": F.shiftrightunsigned(key, 1), "bits": bits})
    rows = rows.withColumn("slice", F.expr("shiftright(key, 63 - bits)").cast("int")).drop("bits", "n")
    rows = materialise(rows, "mix-rows")
    sums = rows.groupBy("leaf", "slice").agg(F.sum("n_tokens").alias("s"))
    ahead = Window.partitionBy("leaf").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("leaf", "slice", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("leaf", "slice").orderBy("key", "doc_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = rows.join(sums, ["leaf", "slice"]).withColumn("upto", F.col("base") + F.sum("n_tokens").over(inside))
    copies = F.col("whole") + (F.col("upto") <= F.col("rest")).cast("int")
    return placed.where(copies > 0).select(
        "doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0), copies - 1)).alias("epoch")
    )


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The drawn rows of ``docs``, once per epoch, with their columns."""
    drawn = draw(docs, mix).select(
        F.col("doc_id").alias("drawn_doc"), *[F.col(c).alias(f"drawn_{c}") for c in LEVELS]
    )
    held = boxed(docs, "doc_id", "lang", "source")
    on = F.col("doc_id").eqNullSafe(F.col("drawn_doc"))
    for name, label in _labels().items():
        on &= label == F.col(f"drawn_{name}")
    return unboxed(held.join(drawn, on), docs)


def query(docs: DataFrame) -> DataFrame:
    return draw(docs)
