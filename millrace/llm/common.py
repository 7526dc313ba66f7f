"""What the operators of this folder share: tables, Arrow batches, links to classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import cut_lineage, prepare, scratch_path

#: Rows that Spark hands to Python at once: long texts then stay within a few MB.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """Session settings for these operators."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_like(df: DataFrame, schema: StructType | str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def lists(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    """A list column from one flat array and the length of each list."""
    ends = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=kind))


def slices(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose ``sizes`` add up to about ``most`` or that hold one row."""
    first, total = 0, 0
    for row, size in enumerate(sizes):
        if row > first and total + size > most:
            yield first, row
            first, total = row, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


class BoundedCache(dict):
    """A dict that computes what it misses and starts anew when it is full."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def classes_of(links: DataFrame, round_limit: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b): one row ``node, component`` per linked node.

    The component is its smallest node. Alternating stars: first every node hangs
    its larger neighbours on the smallest node it sees, then every node hangs
    itself and its smaller neighbours there, until nothing changes; the rounds
    needed grow with the logarithm of the number of nodes. Minima combine before
    the shuffle, and the join that brings them back has one row per node on one
    side, so adaptive execution splits a node with very many links. Each round
    is written to the shared folder; two numbers per round reach the driver.
    """
    edges = (
        links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges = cut_lineage(edges)
    mark = _mark(edges)
    for _ in range(round_limit):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.distinct())
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(root.select("a", F.col("m").alias("b")).unionByName(rest).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components not settled after {round_limit} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Two numbers that change when the edges do."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
    )
