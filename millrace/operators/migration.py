"""Inspecting stored records by key generation and moving them to tenant keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import logical_key, object_uri, tenant_key, uri_key, uri_problem
from millrace.operators.scaling import number_rows, running_totals
from millrace.schemas import MIGRATION_BATCH, PROBLEM_SAMPLE
from millrace.session import cut_lineage

MIGRATED = "already_migrated"
UNPREFIXED = "legacy_unprefixed"
SCHEMA_PREFIXED = "schema_prefixed"
MISSING = "missing"
CONFLICT = "checksum_conflict"
READY = "ready"

# --- fixed values: what the operator is told about a problem record ---
REASONS = {
    "unrecognised": "storage_uri does not match any recognized key shape for this record",
    "missing": "object not found in storage at the legacy key",
    "tampered": "downloaded object checksum does not match the recorded checksum",
}

COUNTERS = [
    "records_inspected",
    "already_migrated",
    "legacy_unprefixed",
    "schema_prefixed",
    "missing_objects",
    "checksum_conflicts",
    "ready_for_migration",
    "records_skipped",
    "records_migrated",
]

# Keys that already begin with a tenant's identifier are never looked up by a pass.
_TENANT_KEY = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}/"


def classify_generation(records: DataFrame, bucket: str) -> DataFrame:
    """Key generation of each record, from its own columns rather than its URI.

    Records carry ``config_id, run, sequence, checksum_sha256, storage_uri,
    tenant_uuid, schema_name``.
    """
    uri = F.col("storage_uri")
    key = F.when(uri_problem(uri, bucket).isNull(), uri_key(uri))
    expected = logical_key(
        F.col("config_id"), F.col("run"), F.col("sequence"), F.col("checksum_sha256")
    )
    generation = (
        F.when(F.col("key") == tenant_key(F.col("tenant_uuid"), F.col("expected_key")), MIGRATED)
        .when(F.col("key") == F.concat("schema_name", F.lit("/"), "expected_key"), SCHEMA_PREFIXED)
        .when(F.col("key") == F.col("expected_key"), UNPREFIXED)
        .otherwise(CONFLICT)
    )
    return records.withColumns({"key": key, "expected_key": expected}).withColumn(
        "generation", generation
    )


def hash_objects(objects: DataFrame, body: str = "body") -> DataFrame:
    """Thin listing of an object table: key and actual checksum."""
    return objects.select("key", F.sha2(F.col(body).cast("binary"), 256).alias("actual_sha256"))


def absent_objects(records: DataFrame, objects: DataFrame, bucket: str) -> DataFrame:
    """Legacy records whose object isn't there, from the key listing alone: no body is read."""
    legacy = classify_generation(records, bucket).where(F.col("generation").isin(UNPREFIXED, SCHEMA_PREFIXED))
    return legacy.join(objects.select("key"), "key", "left_anti")


def inspect_records(records: DataFrame, objects: DataFrame, bucket: str) -> DataFrame:
    """Finding for every record: migrated, unrecognised, missing, tampered or ready.

    Only legacy records are looked up, and only checksums travel. Objects at
    tenant keys are left out before anything is hashed, so a store that is fully
    migrated costs a listing and not its bodies. Records that
    need no lookup get a key of their own that matches nothing, because a shared
    NULL would send them all to one task.
    """
    classified = classify_generation(records, bucket)
    legacy = F.col("generation").isin(UNPREFIXED, SCHEMA_PREFIXED)
    listing = hash_objects(objects.where(~F.col("key").rlike(_TENANT_KEY)))
    probe = classified.withColumn(
        "probe_key",
        F.when(legacy, F.col("key")).otherwise(F.concat(F.lit("#"), "record_id")),
    )
    found = probe.join(listing.withColumnRenamed("key", "probe_key"), "probe_key", "left")
    finding = (
        F.when(F.col("generation") == MIGRATED, MIGRATED)
        .when(F.col("generation") == CONFLICT, "unrecognised")
        .when(F.col("actual_sha256").isNull(), "missing")
        .when(F.col("actual_sha256") != F.col("checksum_sha256"), "tampered")
        .otherwise(READY)
    )
    return found.withColumn("finding", finding).drop("probe_key", "actual_sha256")


def _tests(migrated: bool) -> dict[str, Column]:
    finding, generation = F.col("finding"), F.col("generation")
    present = finding.isin("tampered", READY)
    return {
        "records_inspected": F.lit(True),
        "already_migrated": finding == MIGRATED,
        "legacy_unprefixed": present & (generation == UNPREFIXED),
        "schema_prefixed": present & (generation == SCHEMA_PREFIXED),
        "missing_objects": finding == "missing",
        "checksum_conflicts": finding.isin("unrecognised", "tampered"),
        "ready_for_migration": finding == READY,
        "records_skipped": finding != READY,
        "records_migrated": F.col("migrated") if migrated else F.lit(False),
    }


def summarize(findings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counters of one inspection, or one row per ``keys``; of a real pass if records say ``migrated``."""
    tests = _tests("migrated" in findings.columns)
    counts = [F.count_if(test).alias(name) for name, test in tests.items()]
    return findings.groupBy(*keys).agg(*counts)


def problem_sample(findings: DataFrame, limit: int = PROBLEM_SAMPLE) -> DataFrame:
    """The first problem records in id order: identifiers only, never payload bytes."""
    reason = F.lit(None).cast("string")
    for name, text in REASONS.items():
        reason = F.when(F.col("finding") == name, text).otherwise(reason)
    return (
        findings.where(F.col("finding").isin(*REASONS))
        .select(
            "record_id",
            "run",
            "sequence",
            F.left("checksum_sha256", F.lit(12)).alias("checksum_prefix"),
            F.when(F.col("finding") == "missing", MISSING).otherwise(CONFLICT).alias("category"),
            reason.alias("reason"),
        )
        .orderBy("record_id")
        .limit(limit)
    )


def _new_key() -> Column:
    return tenant_key(F.col("tenant_uuid"), F.col("expected_key"))


def moved_objects(findings: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects to append at tenant keys for ready records; old objects stay."""
    ready = findings.where(F.col("finding") == READY).select("key", _new_key().alias("new_key"))
    # Sources of one new key hold the same verified bytes, so any of them will do.
    once = ready.groupBy("new_key").agg(F.min("key").alias("key"))
    fresh = once.join(objects.select(F.col("key").alias("new_key")), "new_key", "left_anti")
    return (
        objects.join(fresh, "key")
        .drop("key")
        .withColumnRenamed("new_key", "key")
    )


def reuse_conflicts(findings: DataFrame, objects: DataFrame) -> DataFrame:
    """Ready records whose tenant key already holds other bytes than theirs.

    Such an object must not be taken for the migrated one; a pass that meets it
    ends with an integrity error, and the record keeps its legacy key. Only
    objects at keys that a ready record would reuse are hashed.
    """
    ready = findings.where(F.col("finding") == READY).select("record_id", "checksum_sha256", _new_key().alias("new_key"))
    reused = objects.join(ready.select(F.col("new_key").alias("key")).distinct(), "key", "left_semi")
    return (
        hash_objects(reused).withColumnRenamed("key", "new_key").join(ready, "new_key")
        .where("actual_sha256 <> checksum_sha256")
        .select("record_id", "new_key", "checksum_sha256", "actual_sha256", F.lit("RawPayloadIntegrityError").alias("category"))
    )


def repoint_records(findings: DataFrame, bucket: str, conflicts: DataFrame | None = None) -> DataFrame:
    """Records after a real pass: ready ones point at their tenant key, unless it is in ``conflicts``."""
    moves = F.col("finding") == READY
    if conflicts is not None:
        refused = conflicts.select("record_id", F.lit(True).alias("_refused"))
        findings = findings.join(refused, "record_id", "left")
        moves = moves & F.col("_refused").isNull()
    moved = findings.withColumn("migrated", moves).drop("_refused")
    return moved.withColumn(
        "storage_uri", F.when(F.col("migrated"), object_uri(bucket, _new_key())).otherwise(F.col("storage_uri"))
    )


def _batches(thin: DataFrame, batch: int) -> DataFrame:
    """Records with the number of their batch, in record-id order."""
    return number_rows(thin, ["record_id"], "_position").withColumn(
        "batch", F.floor(F.col("_position") / batch).cast("bigint")
    )


def progress_reports(findings: DataFrame, batch: int = MIGRATION_BATCH) -> DataFrame:
    """Counters as reported after each full batch of records, and once more at the end.

    Batches follow record-id order. The last report is sent however many records
    there are; it alone has the skipped count filled in, and stands behind the
    batches under the number that follows them. Records are folded to one row per
    batch before anything is added up in order.
    """
    thin = [c for c in ("record_id", "finding", "generation", "migrated") if c in findings.columns]
    numbered = cut_lineage(_batches(findings.select(*thin), batch))
    names = [n for n in COUNTERS if n != "records_skipped"]
    per_batch = summarize(numbered, ("batch",)).withColumn("full", F.col("records_inspected") == batch)
    running = running_totals(
        per_batch.withColumn("_all", F.lit(0)), ["_all"], "batch", {n: F.col(n) for n in names}
    ).where("full").select("batch", F.lit(False).alias("final"), *names, F.lit(0).cast("bigint").alias("records_skipped"))
    after = F.ceil(F.col("records_inspected") / batch).cast("bigint")
    whole = summarize(numbered).select(after.alias("batch"), F.lit(True).alias("final"), *names, "records_skipped")
    return running.unionByName(whole)


def cancelled_pass(
    records: DataFrame, objects: DataFrame, bucket: str, cancels: DataFrame, batch: int = MIGRATION_BATCH
) -> DataFrame:
    """Findings of a pass that stops after the first full batch polled with a cancel.

    ``cancels`` holds the batch numbers at whose end a cancel was pending. Record
    ids are numbered first; only records up to the stop are inspected, and only
    their objects looked at.
    """
    numbered = cut_lineage(_batches(records.select("record_id"), batch).select("record_id", "batch"))
    total = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
    stop = cancels.where((F.col("batch") + 1) * batch <= total).agg(F.min("batch")).scalar()
    polled = numbered.where(F.coalesce(F.col("batch") <= stop, F.lit(True)))
    return inspect_records(records.join(polled, "record_id"), objects, bucket)


def final_status(jobs: DataFrame) -> DataFrame:
    """How a migration job ends; a raised error beats everything, then a cancel."""
    problems = (F.col("missing_objects") > 0) | (F.col("checksum_conflicts") > 0)
    status = (
        F.when(F.col("raised"), "failed")
        .when(F.col("cancel_requested"), "cancelled")
        .when(F.col("dry_run"), "succeeded")
        .when(problems, "partially_failed")
        .otherwise("succeeded")
    )
    return jobs.withColumn("final_status", status)

