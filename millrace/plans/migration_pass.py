"""A migration pass that writes: in ranges of record ids, each published once.

A pass has a folder of its own with two tables (:mod:`millrace.sources.tables`): ``plan``, the
ranges, written once when it begins, and ``results``, a load per range that is done. A
pass that was cancelled, failed or lost its driver goes on behind the last range that
``results`` has; objects that the lost attempt copied are found again and reused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import object_uri, tenant_key
from millrace.operators.migration import (
    CONFLICT,
    MIGRATED,
    READY,
    SCHEMA_PREFIXED,
    UNPREFIXED,
    classify_generation,
    final_status,
    summarize,
)
from millrace.operators.scaling import number_rows
from millrace.session import cut_lineage
from millrace.sources import objects, tables

#: Records of one range: what is lost at most when a pass stops, and what lies between two polls for a cancel.
RANGE_RECORDS = 1_000_000

RESULTS = "record_id bigint, generation string, finding string, migrated boolean, storage_uri string"


@dataclass
class Pass:
    """Where a pass stands: its job status, the error that ended it, and what it found so far."""

    status: str
    category: str | None
    findings: DataFrame


def _plan(records: DataFrame, path: str, range_records: int) -> DataFrame:
    """``low, high`` of the ranges, by equal numbers of records; those of the first attempt, if there was one."""
    spark = records.sparkSession
    tables.create_table(spark, path, "low bigint, high bigint")
    if tables.history(spark, path).isEmpty():
        numbered = number_rows(records.select("record_id").where("record_id IS NOT NULL"), ["record_id"], "_at")
        ranges = numbered.groupBy(F.floor(F.col("_at") / range_records).alias("_range")).agg(
            F.min("record_id").alias("low"), F.max("record_id").alias("high")
        )
        tables.append(ranges.drop("_range"), path, "plan")
    return tables.read_table(spark, path)


def _done(results: DataFrame) -> DataFrame:
    """The id up to which records are done, from the log of loads alone."""
    return results.agg(F.max(F.substring_index("batch", ":", -1).cast("bigint")).alias("high"))


def _move(part: DataFrame, store: objects.Store, bucket: str, dry_run: bool) -> DataFrame:
    """Results of a range, with the error ``category`` of records that end the pass."""
    classified = classify_generation(part, bucket)
    legacy = F.col("generation").isin(UNPREFIXED, SCHEMA_PREFIXED)
    target = object_uri(bucket, tenant_key(F.col("tenant_uuid"), F.col("expected_key")))
    # Rows are thin and objects are not: a fixed number of tasks, which adaptive execution leaves alone.
    tasks = int(part.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moves = classified.where(legacy).withColumns({"target_uri": target, "promised": F.col("checksum_sha256")}).repartition(tasks, "record_id")
    moved = objects.copy_verified(moves, store, ["record_id", "generation", "target_uri"], write=not dry_run)
    finding = F.when(F.col("outcome") == "vanished", "missing").when(F.col("outcome") == "changed", "tampered").otherwise(READY)
    shifted = F.col("outcome").isin("created", "reused")
    looked_up = moved.select(
        "record_id", "generation", finding.alias("finding"), shifted.alias("migrated"),
        F.when(shifted, F.col("target_uri")).otherwise(F.col("storage_uri")).alias("storage_uri"), "category",
    )
    others = classified.where(~legacy).select(
        "record_id", "generation", F.when(F.col("generation") == CONFLICT, "unrecognised").otherwise(MIGRATED).alias("finding"),
        F.lit(False).alias("migrated"), "storage_uri", F.lit(None).cast("string").alias("category"),
    )
    return cut_lineage(looked_up.unionByName(others))


def migrate(
    records: DataFrame,
    store: objects.Store,
    bucket: str,
    path: str,
    dry_run: bool = False,
    cancelled: Callable[[], bool] = lambda: False,
    range_records: int = RANGE_RECORDS,
) -> Pass:
    """Inspect records in id order and copy ready ones to their tenant keys, or go on with a pass that stopped.

    ``records`` are those of :func:`classify_generation`, with unique ids; records without
    an id, and those that came after the pass began, are left to the next. ``path`` is the folder of this pass: a dry run
    and a real one need folders of their own. ``cancelled`` is asked after each range. A tenant key that holds other
    bytes ends the pass at the record that met it: records before it in id order are
    published, it and all later ones keep their key, and a repeated call begins with it.
    A bucket that was never provisioned ends the pass likewise.
    """
    spark = records.sparkSession
    plan, results = _plan(records, f"{path}/plan", range_records), f"{path}/results"
    tables.create_table(spark, results, RESULTS)
    category, cancel = None, False
    while category is None and not cancel:
        done = _done(tables.history(spark, results)).first().high
        ahead = plan if done is None else plan.where(F.col("high") > done)
        at = ahead.agg(F.min(F.struct("low", "high")).alias("next")).first().next
        if at is None:
            break
        low = at.low if done is None else max(at.low, done + 1)
        found = _move(records.where(F.col("record_id").between(low, at.high)), store, bucket, dry_run)
        worst = found.where("category IS NOT NULL").agg(F.min(F.struct("record_id", "category")).alias("first")).first().first
        high = at.high
        if worst is not None:
            category, high = worst.category, worst.record_id - 1
        added = tables.append(found.where(F.col("record_id") <= high).drop("category"), results, f"{low}:{high}")
        if not added and category is None and _done(tables.history(spark, results)).first().high == done:
            plan = plan.where(F.col("low") > at.low)  # records of this range are gone since it was planned
        cancel = cancelled()
    findings = tables.read_table(spark, results)
    job = summarize(findings).withColumns({"raised": F.lit(category is not None), "cancel_requested": F.lit(cancel), "dry_run": F.lit(dry_run)})
    return Pass(final_status(job).first().final_status, category, findings)


def repointed(records: DataFrame, findings: DataFrame) -> DataFrame:
    """Records with the addresses that a pass gave them."""
    moved = findings.where("migrated").select("record_id", F.col("storage_uri").alias("_moved"))
    return records.join(moved, "record_id", "left").withColumn("storage_uri", F.coalesce("_moved", "storage_uri")).drop("_moved")
