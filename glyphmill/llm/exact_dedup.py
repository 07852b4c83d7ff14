"""Exact dedup against a persistent digest index (native: DataFrame operations only).

The index is a folder of runs, tables of SHA-256 digests that are bucketed and
sorted by digest with one file a bucket. A batch is reduced to one row per
digest with map-side combining and shuffled once, into the index's buckets;
sort-merge anti-joins then pass it by the runs, which are read in their stored
order with neither an exchange nor a sort, and its new digests become a run of
their own. ``MAX_RUNS`` runs are merged into one. A manifest, written anew for
each change, names the runs that count and keeps the bucket count.

Batches are named by the caller. One that is added again, as after a lost
driver, finds its own digests by that name and gives the same decisions. There
is one writer at a time.

Defined results: null text equals empty text; the row with the largest
``doc_id`` of equal texts stays; of wholly repeated rows (same ``doc_id`` and
text) exactly one is kept; a null ``doc_id`` loses to any other and ranks as
equal to other nulls; an empty batch gives an empty result; further columns of
the input, whatever their names, are ignored by decisions and kept by
``surviving``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm._tables import boxed, lookup, materialise, scratch_path, sha256, unboxed
from glyphmill.sources.scratch import drop, file_system
from glyphmill.sources.tables import load_settings, save_settings

FORMAT = 1
MAX_RUNS = 8
ROWS = "digest BINARY, keep_id BIGINT, batch STRING"
_SORTED_READ = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_AUTO_BUCKETS = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


class DigestIndex:
    """Digests of all batches so far, below the folder ``path``.

    ``buckets`` is decided when the index is created, by default as the
    session's shuffle partitions; later openings read it from the manifest and
    refuse another number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.manifest = self._latest()
        if self.manifest is None:
            count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._commit({"format": FORMAT, "buckets": count, "runs": []})
        if self.manifest["format"] != FORMAT:
            raise ValueError(f"index format {self.manifest['format']} is not {FORMAT}")
        self.buckets: int = self.manifest["buckets"]
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index has {self.buckets} buckets, not {buckets}")

    def _latest(self) -> tuple[int, dict | None]:
        fs, at = file_system(self.spark, f"{self.path}/manifest")
        if not fs.exists(at):
            return 0, None
        # a version counts once its settings are written to the end
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        for version in sorted((int(n) for n in names if n.isdigit()), reverse=True):
            marker = file_system(self.spark, f"{self.path}/manifest/{version}/settings/_SUCCESS")[1]
            if fs.exists(marker):
                return version, load_settings(self.spark, f"{self.path}/manifest/{version}")
        return 0, None

    def _commit(self, manifest: dict) -> None:
        self.version, self.manifest = self.version + 1, manifest
        save_settings(self.spark, f"{self.path}/manifest/{self.version}", manifest)

    def _run(self, name: str) -> str:
        """The catalog's name of a run; its folder holds the data in any session."""
        table = "digests_" + hashlib.sha256(f"{self.path}/{name}".encode()).hexdigest()
        location = f"{self.path}/runs/{name}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({ROWS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )
        return table

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(self._run(r["name"])) for r in self.manifest["runs"]]

    def read(self) -> DataFrame:
        """All of the index: ``digest, keep_id, batch``."""
        return reduce(DataFrame.unionByName, self.runs(), self.spark.createDataFrame([], ROWS))

    @contextmanager
    def in_stored_order(self) -> Iterator[None]:
        """Plans made and run inside use the runs' buckets and their order."""
        conf = self.spark.conf
        wanted = {_SORTED_READ: "true", _AUTO_BUCKETS: "false"}
        before = {k: conf.get(k) for k in wanted}
        for k, v in wanted.items():
            conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                conf.set(k, v)

    def bucketed(self, groups: DataFrame) -> DataFrame:
        """``groups`` in the runs' own layout, which joins with them keep."""
        return groups.repartition(self.buckets, "digest").sortWithinPartitions("digest")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` whose digest no run holds."""
        out = self.bucketed(groups)
        for run in self.runs():
            out = out.join(run.select("digest").hint("merge"), "digest", "left_anti")
        return out

    def resolved(self, groups: DataFrame) -> DataFrame:
        """``groups`` with the index's ``keep_id`` and ``batch``."""
        columns, known = groups.columns, None
        out = self.bucketed(groups)
        for i, run in enumerate(self.runs()):
            held = run.select("digest", F.struct("keep_id", "batch").alias(f"_run{i}"))
            out = out.join(held.hint("merge"), "digest", "left")
            known = F.col(f"_run{i}") if known is None else F.coalesce(known, F.col(f"_run{i}"))
        return out.select(*columns, known["keep_id"].alias("keep_id"), known["batch"].alias("batch"))

    def _write(self, rows: DataFrame) -> str:
        """A new run: one sorted file for each bucket."""
        name = uuid.uuid4().hex
        self.bucketed(rows.select("digest", "keep_id", "batch")).write.insertInto(self._run(name))
        self.spark.catalog.refreshTable(self._run(name))
        return name

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the new digests of ``groups (digest, keep_id)``; a batch already added adds nothing."""
        held = self.manifest["runs"]
        if any(batch in r["batches"] for r in held):
            return
        with self.in_stored_order():
            name = self._write(self.unseen(groups).withColumn("batch", F.lit(batch)))
        self._commit(self.manifest | {"runs": [*held, {"name": name, "batches": [batch]}]})
        if len(self.manifest["runs"]) > MAX_RUNS:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one."""
        old = self.manifest["runs"]
        merged = {"name": self._write(self.read()), "batches": [b for r in old for b in r["batches"]]}
        self._commit(self.manifest | {"runs": [merged]})
        for r in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._run(r['name'])}")
            drop(self.spark, f"{self.path}/runs/{r['name']}")

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate a batch and append its new digests.

        Returns one row per input row: ``doc_id, digest, keep_id, group_size,
        kept``. ``group_size`` counts equal texts of this batch. ``kept`` is
        false for every row whose text another batch already held. Without a
        name of its own a batch cannot be added again with the same result.
        """
        batch = batch or uuid.uuid4().hex
        # the row's number is stored with it, so that repeated rows can be told apart for good
        rows = docs.select(
            "doc_id", sha256(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")
        )
        rows = materialise(rows, "digests")
        groups = rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size")
        )
        groups = groups.select(
            "digest", "group_size", F.col("top.doc_id").alias("top_id"), F.col("top.row").alias("top_row")
        )
        groups = materialise(groups, "digest-groups")
        self.append(groups.select("digest", F.col("top_id").alias("keep_id")), batch)
        with self.in_stored_order():
            known = materialise(self.resolved(groups), "digests-resolved")
        own = known.select(
            "digest", "keep_id", "group_size", F.when(F.col("batch") == batch, F.col("top_row")).alias("kept_row")
        )
        out = lookup(rows, own, "digest", ["keep_id", "group_size", "kept_row"], "group_size", rows.count())
        kept = F.coalesce(F.col("row") == F.col("kept_row"), F.lit(False))
        return out.select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """Decisions of :meth:`DigestIndex.add`, against a fresh index if none is given."""
    spark = docs.sparkSession
    return (index or DigestIndex(spark, scratch_path(spark, "digest-index"))).add(docs, batch)


def surviving(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` keep, once each, with their columns.

    One key of digest and ``doc_id`` serves both the join and the pass over
    repeated rows, so that texts are shuffled once.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keep = decisions.where("kept").select(F.concat(F.lower(F.hex("digest")), F.lit(":"), name).alias("key"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    tagged = boxed(docs, "doc_id", "text").select("own", F.concat(digest, F.lit(":"), name).alias("key"))
    first = Window.partitionBy("key").orderBy(F.lit(0))
    hit = tagged.join(keep, "key", "left_semi").withColumn("copy", F.row_number().over(first))
    return unboxed(hit.where("copy = 1"), docs)


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def query(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
