"""Sparse vectors as maps from index to value, and hashed vectors."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.tokenize import Tokenizer  # noqa: F401  (part of this module's surface)
from glyphmill.operators.corpus import exploded, let, no_nulls, sorted_runs
from glyphmill.operators.similarity import map_cosine, map_norm

EMPTY = "map<bigint,double>"


def _valid(k: Column, v: Column) -> Column:
    return (k >= 0) & (v != 0) & ~F.isnan(v)


def sparse_vector(entries: Mapping[int, float] | Column | None = None) -> Column:
    """A vector from a mapping or a map column; zeros, NaN and negative indices are left out."""
    if entries is None or (isinstance(entries, Mapping) and not entries):
        return F.create_map().cast(EMPTY)
    if isinstance(entries, Mapping):
        entries = F.create_map(*[F.lit(x) for k, v in entries.items() for x in (int(k), float(v))])
    return F.map_filter(entries.cast(EMPTY), _valid)


def vector_set(vector: Column, index: Column, value: Column) -> Column:
    """Zero deletes; a negative index or NaN changes nothing."""
    index, value = index.cast("long"), value.cast("double")
    rest = F.map_filter(vector, lambda k, v: k != index)
    ignored = (index < 0) | F.isnan(value)
    return F.when(ignored, vector).when(value == 0, rest).otherwise(F.map_concat(rest, F.create_map(index, value)))


def vector_get(vector: Column, index: Column) -> Column:
    return F.coalesce(F.try_element_at(vector, index.cast("long")), F.lit(0.0))


def vector_contains(vector: Column, index: Column) -> Column:
    return F.map_contains_key(vector, index.cast("long"))


def vector_clear(vector: Column) -> Column:
    return F.map_filter(vector, lambda k, v: F.lit(False))


def vector_size(vector: Column) -> Column:
    return F.size(vector)


def vector_pairs(vector: Column) -> Column:
    return F.map_entries(vector)


def vector_values(vector: Column) -> Column:
    return F.map_values(vector)


def vector_norm(vector: Column) -> Column:
    return map_norm(vector)


def cosine_similarity(a: Column, b: Column) -> Column:
    return map_cosine(a, b)


def array_to_vector(values: Column) -> Column:
    """A dense array as a sparse vector."""
    entries = F.transform(values, lambda v, i: F.struct(i.cast("long").alias("key"), v.cast("double").alias("value")))
    return F.map_filter(F.map_from_entries(entries), _valid)


# --- feature hashing

HashFn = Callable[[Column], Column]


def xx_hash(token: Column) -> Column:
    """A non-negative 63-bit hash."""
    return F.xxhash64(token).bitwiseAND(F.lit((1 << 63) - 1))


def md5_hash(token: Column) -> Column:
    """The first 32 bits of the MD5 digest, which other engines can compute too."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_bucket(token: Column, dim: int, hash_fn: HashFn = xx_hash) -> Column:
    if dim <= 0:
        raise ValueError(f"dim must be positive, not {dim}")
    return F.pmod(hash_fn(token), F.lit(dim).cast("long"))


def hash_sign(token: Column, hash_fn: HashFn = xx_hash) -> Column:
    """-1 or 1 from a second hash, of the token and a zero byte."""
    odd = hash_fn(F.concat(token, F.lit("\x00"))) % 2 == 1
    return F.when(odd, F.lit(-1.0)).otherwise(F.lit(1.0))


@dataclass(frozen=True)
class HashingVectorizer:
    """Stateless token hashing into ``dim`` buckets."""

    dim: int = 65536
    signed: bool = True
    hash_fn: HashFn = xx_hash

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError(f"dim must be positive, not {self.dim}")

    def entries(self, docs: DataFrame) -> DataFrame:
        """``doc_id, bucket, value``: sums per bucket, cancelled ones left out."""
        terms = exploded(docs, no_nulls(F.col("tokens")), "term", "doc_id")
        delta = hash_sign(F.col("term"), self.hash_fn) if self.signed else F.lit(1.0)
        return (
            terms.groupBy("doc_id", hash_bucket(F.col("term"), self.dim, self.hash_fn).alias("bucket"))
            .agg(F.sum(delta).alias("value"))
            .where("value <> 0")
        )

    def transform(self, tokens: Column) -> Column:
        """The vector of a token array inside its row, as a map; for streams too.

        A token becomes twice its bucket, and one more if its sign is positive;
        sorted, these are counted in runs, and a bucket's two runs are neighbours.
        """
        def key(t: Column) -> Column:
            plus = (hash_sign(t, self.hash_fn) > 0).cast("long") if self.signed else F.lit(1)
            return hash_bucket(t, self.dim, self.hash_fn) * 2 + plus

        def signed(run: Column) -> Column:
            return F.when(run["term"] % 2 == 1, run["tf"]).otherwise(-run["tf"]).cast("double")

        def sums(runs: Column) -> Column:
            def entry(run: Column, i: Column) -> Column:
                after = F.get(runs, i + 1)
                same = F.shiftright(after["term"], 1) == F.shiftright(run["term"], 1)
                value = signed(run) + F.when(same, signed(after)).otherwise(F.lit(0.0))
                before = F.when(i > 0, F.shiftright(F.get(runs, i - 1)["term"], 1))
                first = before.isNull() | (before != F.shiftright(run["term"], 1))
                return F.struct(F.shiftright(run["term"], 1).alias("key"), value.alias("value"), first.alias("first"))

            kept = F.filter(F.transform(runs, entry), lambda e: e["first"] & (e["value"] != 0))
            return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))

        keys = F.sort_array(F.transform(no_nulls(tokens), key))
        counted = let(keys, lambda k: sorted_runs(k, "array<struct<term:bigint,tf:bigint>>"))
        return let(counted, sums)


def transform_hashing(docs: DataFrame, dim: int = 65536, signed: bool = True, hash_fn: HashFn = xx_hash) -> DataFrame:
    return HashingVectorizer(dim, signed, hash_fn).entries(docs)
