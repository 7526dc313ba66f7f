"""Destination tables with a log of their loads.

A table is a folder: ``data/load=<name>/`` holds the files of one load, ``log/`` an
entry per version, named by its number and created exclusively. Version 0 carries the
schema; each later one publishes one load with its batch and rows. What no entry
names is not there, whatever files a writer that died has left.

A load that is repeated under its batch finds that batch in the log and adds
nothing. Two writers that claim the same version go on like this: one has it, the other
looks at what is new and claims the next.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from millrace.operators.scaling import join_for
from millrace.sources.sinks import LoadRefused, fit_to_table

_ENTRY = "version bigint, batch string, load string, rows bigint, columns string"


class Log:
    """The entries of a table, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self.folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"

    def versions(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(self.folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def claim(self, version: int, entry: dict) -> bool:
        """Create a version with its entry; False if another writer has it.

        The entry is written aside and takes its name whole, by a link or a rename that
        fails on an existing name.
        """
        jvm = self.spark._jvm
        text = json.dumps({"version": version, **entry}).encode()
        self.fs.mkdirs(self.folder)
        name, aside = f"{version:020d}.json", f".{uuid.uuid4().hex}"
        if self.local:
            folder = self.folder.toUri().getPath()
            with open(f"{folder}/{aside}", "xb") as file:
                file.write(text)
            try:
                os.link(f"{folder}/{aside}", f"{folder}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{folder}/{aside}")
            return True
        source, target = (jvm.org.apache.hadoop.fs.Path(self.folder, n) for n in (aside, name))
        out = self.fs.create(source, False)
        out.write(text)
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(source, target, none)
        except Exception as exc:
            self.fs.delete(source, False)
            if self.fs.exists(target):
                return False
            raise exc
        return True

    def entries(self, above: int = -1) -> DataFrame:
        """Entries of versions beyond ``above``, read by Spark."""
        rows = self.spark.read.schema(_ENTRY).json(f"{self.path}/log/*.json")
        return rows.where(F.col("version") > above)

    def drop(self, load: str) -> None:
        """Remove the files of a load that was not published."""
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/load={load}"), True)


def create_table(spark: SparkSession, path: str, schema: StructType | str) -> None:
    """Create an empty table; one that is there is left alone. Loads never create tables."""
    log = Log(spark, path)
    if not log.versions():
        kind = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        log.claim(0, {"columns": kind.json()})


def table_schema(spark: SparkSession, path: str) -> StructType | None:
    log = Log(spark, path)
    if not log.versions():
        return None
    first = log.entries().where("version = 0").first()
    return StructType.fromJson(json.loads(first.columns))


def history(spark: SparkSession, path: str) -> DataFrame:
    """``version, batch, rows`` of every published load."""
    return Log(spark, path).entries(0).select("version", "batch", "rows")


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of all published loads, or of those up to a version."""
    log, schema = Log(spark, path), table_schema(spark, path)
    if schema is None:
        raise LoadRefused("SchemaMismatchError", f"table {path} does not exist")
    known = log.entries(0)
    if version is not None:
        known = known.where(F.col("version") <= version)
    if len(log.versions()) == 1:
        return spark.createDataFrame([], schema)
    loads = known.select("load")
    files = spark.read.schema(schema.add("load", StringType()) if "load" not in schema.names else schema).parquet(f"{log.path}/data")
    # One short row per load: the join prunes folders that no entry names.
    return join_for(loads)(files, loads, ["load"], [files.columns[0]], "left_semi").drop("load")


def _misfit(rows: DataFrame, table: StructType) -> Column:
    """Whether a row holds a VARIANT that is there but can't become its column's type."""
    unfit = F.lit(False)
    for field in rows.schema.fields:
        if field.dataType.typeName() == "variant":
            value, kind = F.col(field.name), table[field.name].dataType.simpleString()
            if kind != "variant":
                there = value.isNotNull() & ~F.is_variant_null(value)
                unfit = unfit | (there & F.try_variant_get(value, "$", kind).isNull())
    return unfit


def _softly(rows: DataFrame, table: StructType) -> DataFrame:
    """Rows with the table's columns; a VARIANT that doesn't fit is NULL, and :func:`_misfit` has told."""
    soft = {
        f.name: F.try_variant_get(F.col(f.name), "$", table[f.name].dataType.simpleString())
        for f in rows.schema.fields
        if f.dataType.typeName() == "variant" and table[f.name].dataType.simpleString() != "variant"
    }
    return fit_to_table(rows.withColumns(soft) if soft else rows, table)


def append(rows: DataFrame, path: str, batch: str | None = None, mode: str = "append", tries: int = 100) -> int:
    """Append rows as one load and return how many were added.

    Refusals in a fixed order: mode, missing table, unknown columns, values that
    can't become their column's type. No rows are no load, whether or not there is a
    table. A ``batch`` that the log knows adds nothing and returns 0, also when another
    writer publishes it at the same time.

    The rows are computed once: they are written to a folder of their own while rows
    and misfits are counted, and only a clean, non-empty load is published. A refused
    or repeated one has its files removed.
    """
    if mode != "append":
        raise LoadRefused("UnsupportedCapability", f"only append is supported, not {mode!r}")
    spark = rows.sparkSession
    log, table = Log(spark, path), table_schema(spark, path)
    known = [] if table is None else table.names
    unknown = sorted(set(rows.columns) - set(known))
    if table is None or unknown:
        if rows.isEmpty():
            return 0
        what = f"destination {path} does not exist" if table is None else f"destination has no column(s) {unknown}; known columns: {sorted(known)}"
        raise LoadRefused("SchemaMismatchError", what)
    seen = -1
    if batch is not None:
        seen = max(log.versions())
        if not log.entries().where(F.col("batch") == batch).isEmpty():
            return 0
    load, counted = uuid.uuid4().hex, Observation()
    told = rows.withColumn("_misfit", _misfit(rows, table)).observe(
        counted, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_misfit"), 1)).alias("misfits")
    )
    _softly(told.drop("_misfit"), table).write.parquet(f"{log.path}/data/load={load}")
    added = counted.get["rows"]
    if counted.get["misfits"] or not added:
        log.drop(load)
        if added:
            raise LoadRefused("LoadFailed", f"{counted.get['misfits']} row(s) hold a value that doesn't fit its column")
        return 0
    for _ in range(tries):
        last = max(log.versions())
        if batch is not None and last > seen:
            if not log.entries(seen).where(F.col("batch") == batch).isEmpty():
                log.drop(load)
                return 0
            seen = last
        if log.claim(last + 1, {"batch": batch, "load": load, "rows": added}):
            return added
    log.drop(load)
    raise LoadRefused("LoadFailed", f"no version of {path} could be claimed in {tries} tries")


def load_runs(loaded: DataFrame, path: str, batch: str) -> int:
    """Load the rows of an ingestion (:mod:`millrace.plans.ingestion`) under the batch of its runs."""
    table = table_schema(loaded.sparkSession, path)
    named = loaded.columns if table is None else [c for c in loaded.columns if c in table.names]
    return append(loaded.select(*named), path, batch)

