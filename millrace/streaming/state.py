"""What a page stream remembers: versions of pages, by buckets of runs.

Each batch writes what it changed as a small delta of the buckets that it touched, and
reads only those. A bucket that has gathered ``MERGED`` deltas gets a snapshot of all
that it holds, which stands for the deltas before it. Runs get their numbers in the
order in which they start, so buckets are ranges of runs: a batch of new runs touches
new buckets, and what it reads doesn't grow with the stream's past.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.scaling import few_values
from millrace.sources.files import numbers, remove

#: Runs of a bucket, deltas until it is merged, and buckets that are named one by one in a read.
RUNS, MERGED, NAMED = 64, 8, 1000

VERSION = ["run", "page", "checksum_sha256"]
SCHEMA = "run bigint, page bigint, checksum_sha256 string, n bigint, size_bytes bigint, error string, batch bigint, loaded bigint"


def bucket_of(runs: int = RUNS):
    return F.floor(F.col("run") / F.lit(runs)).cast("bigint")


class PageState:
    """State below ``path``: ``deltas/bucket=<b>/at=<batch>`` and ``snapshots/bucket=<b>/at=<batch>``."""

    def __init__(self, path: str, runs: int = RUNS, merged: int = MERGED):
        self.path, self.runs, self.merged = path.rstrip("/"), runs, merged

    def touched(self, rows: DataFrame) -> list[int] | None:
        """Buckets of the runs in ``rows``; None if there are more than ``NAMED``."""
        return few_values(rows.select(bucket_of(self.runs).alias("bucket")), "bucket", NAMED)

    def _parts(self, spark: SparkSession, bucket: int, before: int) -> list[str]:
        """Folders that hold a bucket as it was before a batch: its newest snapshot and the deltas since."""
        base = [f"{self.path}/{kind}/bucket={bucket}" for kind in ("snapshots", "deltas")]
        snapshots = [k for k in numbers(spark, base[0], "at") if k < before]
        since = snapshots[-1] if snapshots else -1
        deltas = [k for k in numbers(spark, base[1], "at") if since < k < before]
        return [f"{base[0]}/at={k}" for k in snapshots[-1:]] + [f"{base[1]}/at={k}" for k in deltas]

    def read(self, spark: SparkSession, buckets: list[int] | None, before: int) -> DataFrame:
        """Versions in the buckets (None: in all) as batches before ``before`` left them, one row each."""
        if buckets is None:
            buckets = sorted({b for kind in ("snapshots", "deltas") for b in numbers(spark, f"{self.path}/{kind}", "bucket")})
        parts = [p for b in buckets for p in self._parts(spark, b, before)]
        if not parts:
            return spark.createDataFrame([], SCHEMA)
        return folded(spark.read.schema(SCHEMA).parquet(*parts))

    def write(self, changed: DataFrame, batch: int) -> None:
        """What a batch changed; a replay replaces it."""
        self._put(changed, "deltas", batch)

    def _put(self, rows: DataFrame, kind: str, batch: int) -> None:
        placed = rows.select("*", bucket_of(self.runs).alias("bucket"), F.lit(batch).alias("at")).repartition("bucket")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "at").parquet(f"{self.path}/{kind}")

    def merge(self, spark: SparkSession, buckets: list[int] | None, batch: int) -> list[int]:
        """Snapshots of those buckets that have gathered enough deltas, this batch's among them.

        What a replay of this batch reads stays: folders go when the snapshot before
        the last already stands for them.
        """
        if buckets is None:
            buckets = numbers(spark, f"{self.path}/deltas", "bucket")
        full = [b for b in buckets if len(self._parts(spark, b, batch + 1)) > self.merged]
        if full:
            self._put(self.read(spark, full, batch + 1), "snapshots", batch)
        for bucket in full:
            base = f"{self.path}/{{}}/bucket={bucket}"
            old = [k for k in numbers(spark, base.format("snapshots"), "at") if k < batch]
            for kind in ("snapshots", "deltas"):
                for k in numbers(spark, base.format(kind), "at"):
                    if old and (k < old[-1] or kind == "deltas" and k == old[-1]):
                        remove(spark, f"{base.format(kind)}/at={k}")
        return full


def folded(rows: DataFrame) -> DataFrame:
    """One row per version: the batch that stored it, and the one that loaded it, if any."""
    return rows.groupBy(*VERSION).agg(
        F.max("n").alias("n"), F.max("size_bytes").alias("size_bytes"), F.max("error").alias("error"),
        F.min("batch").alias("batch"), F.max("loaded").alias("loaded"),
    )
