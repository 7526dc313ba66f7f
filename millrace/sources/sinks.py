"""Destinations: provisioned tables that only grow, written by appending."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.mapping import misfits
from millrace.schemas import DEFAULT_LOAD_BATCH


class LoadRefused(Exception):
    """A load that must not start; ``category`` says why and nothing was written."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category


def provision(spark: SparkSession, path: str, schema: StructType | str) -> None:
    """Create an empty table at ``path``; an existing one is left alone.

    Only this call creates tables; loads never do.
    """
    if destination_schema(spark, path) is None:
        spark.createDataFrame([], schema).write.mode("append").parquet(path)


def destination_schema(spark: SparkSession, path: str) -> StructType | None:
    """Schema of the table at ``path``, None when nothing was provisioned there."""
    try:
        return spark.read.parquet(path).schema
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def fit_to_table(rows: DataFrame, table: StructType) -> DataFrame:
    """Rows with the table's columns: cast by name, absent ones NULL."""
    given = {f.name: f.dataType.typeName() for f in rows.schema.fields}

    def column(field):
        if field.name not in given:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(field.name)
        if given[field.name] == "variant":
            value = F.variant_get(value, "$", field.dataType.simpleString())
        return value.cast(field.dataType).alias(field.name)

    return rows.select(*[column(f) for f in table.fields])


def append_load(rows: DataFrame, path: str, mode: str = "append") -> int:
    """Append rows to a provisioned table and return how many were written.

    No rows are no load, whether or not there is a table. Refusals come in a
    fixed order: mode, missing table, unknown columns, values that can't become
    their column's type. The
    count is observed while writing, so the rows are computed once. Spark's
    commit protocol publishes the files of a finished job only, and a repeated
    task replaces its own output.
    """
    if mode != "append":
        raise LoadRefused("UnsupportedCapability", f"only append is supported, not {mode!r}")
    if rows.isEmpty():
        return 0
    spark = rows.sparkSession
    table = destination_schema(spark, path)
    if table is None:
        raise LoadRefused("SchemaMismatchError", f"destination {path} does not exist")
    unknown = sorted(set(rows.columns) - set(table.names))
    if unknown:
        raise LoadRefused(
            "SchemaMismatchError",
            f"destination has no column(s) {unknown}; known columns: {sorted(table.names)}",
        )
    kinds = {f.name: f.dataType.simpleString() for f in table.fields}
    variants = {f.name: F.col(f.name) for f in rows.schema.fields if f.dataType.typeName() == "variant"}
    if variants and not rows.where(misfits(variants, {c: kinds[c] for c in variants})).isEmpty():
        raise LoadRefused("LoadFailed", f"a value doesn't fit its column among {sorted(variants)}")
    written = Observation()
    fitted = fit_to_table(rows, table).observe(written, F.count(F.lit(1)).alias("rows"))
    fitted.write.mode("append").parquet(path)
    return written.get["rows"]


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its number; a replay replaces what it wrote before."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def jdbc_options(
    url: str, table: str, batch_size: int = DEFAULT_LOAD_BATCH, connections: int = 8
) -> dict[str, str]:
    """Options for appending through JDBC: bounded insert batches, bounded connections."""
    return {
        "url": url,
        "dbtable": table,
        "batchsize": str(batch_size),
        "numPartitions": str(connections),
        "isolationLevel": "READ_COMMITTED",
    }


def append_jdbc(rows: DataFrame, options: dict[str, str]) -> None:
    """Append to an existing JDBC table; not run by the tests, which may start no database.

    Each task commits on its own, so a lost executor can leave rows that its
    repeat inserts again: delivery is at least once, see the duplicate report.
    """
    rows.write.format("jdbc").options(**options).mode("append").save()
