"""The raw payload store: content-addressed objects and their versioned records.

An object table holds ``key, body, content_type, size_bytes``; a record table
holds one row per ``run, sequence, checksum_sha256``. Bodies are hashed and
measured where they are read; only keys and row ids are shuffled to decide what
to write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import (
    key_checksum,
    key_tenant,
    logical_key,
    object_uri,
    tenant_key,
    uri_key,
    uri_problem,
)

VERSION_KEY = ["run", "sequence", "checksum_sha256"]


def address_payloads(payloads: DataFrame, body: str = "payload") -> DataFrame:
    """Add checksum, size and logical key to payload rows."""
    return payloads.withColumns(
        {
            "checksum_sha256": F.sha2(F.col(body).cast("binary"), 256),
            "size_bytes": F.octet_length(F.col(body)).cast("bigint"),
        }
    ).withColumn(
        "logical_key",
        logical_key(F.col("config_id"), F.col("run"), F.col("sequence"), F.col("checksum_sha256")),
    )


def tenant_uris(addressed: DataFrame, organizations: DataFrame, bucket: str) -> DataFrame:
    """Prefix keys with the tenant's identifier; a row without a tenant is an error.

    There is one organization row per tenant, so adaptive execution decides
    whether it is small enough to broadcast.
    """
    tenants = organizations.select("org_id", "tenant_uuid")
    key = tenant_key(F.col("tenant_uuid"), F.col("logical_key"))
    return (
        addressed.join(tenants, "org_id", "left")
        .withColumns(
            {
                "key": key,
                "storage_uri": object_uri(bucket, key),
                "category": F.when(F.col("tenant_uuid").isNull(), "ConfigurationError"),
            }
        )
        .drop("tenant_uuid")
    )


def put_if_absent(
    incoming: DataFrame, objects: DataFrame, arrival: str = "arrival"
) -> DataFrame:
    """Objects to append: the first arrival of each key that is not stored yet.

    Only keys and arrival numbers are aggregated; rows are matched on the unique
    arrival number, so copies of one key never meet in one task.
    """
    fresh = incoming.select("key", arrival).join(objects.select("key"), "key", "left_anti")
    winners = fresh.groupBy("key").agg(F.min(arrival).alias(arrival)).select(arrival)
    return incoming.join(winners, arrival, "left_semi")


def put_conflicts(incoming: DataFrame, objects: DataFrame) -> DataFrame:
    """Incoming rows whose key is stored with another size; an unknown size is accepted."""
    stored = objects.select("key", F.col("size_bytes").alias("stored_size"))
    return (
        incoming.join(stored, "key")
        .where(F.col("stored_size").isNotNull() & (F.col("stored_size") != F.col("size_bytes")))
        .withColumn("category", F.lit("RawPayloadIntegrityError"))
    )


def vanished_objects(reused: DataFrame, objects: DataFrame) -> DataFrame:
    """Keys reported as present by the write whose object is gone when checked."""
    return reused.join(objects.select("key"), "key", "left_anti").withColumn(
        "category", F.lit("RawPayloadIntegrityError")
    )


def new_records(incoming: DataFrame, records: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Record rows to append: first arrival of each version not recorded yet."""
    fresh = incoming.select(*VERSION_KEY, arrival).join(
        records.select(*VERSION_KEY), VERSION_KEY, "left_anti"
    )
    winners = fresh.groupBy(*VERSION_KEY).agg(F.min(arrival).alias(arrival)).select(arrival)
    return incoming.join(winners, arrival, "left_semi")


def payload_versions(records: DataFrame) -> DataFrame:
    """How many distinct contents each page of a run was stored with.

    Repeats are folded per version first, then versions are counted.
    """
    return (
        records.groupBy(*VERSION_KEY)
        .agg(F.count(F.lit(1)).alias("deliveries"))
        .groupBy("run", "sequence")
        .agg(F.count(F.lit(1)).alias("versions"), F.sum("deliveries").alias("deliveries"))
    )


def parse_uris(records: DataFrame, bucket: str) -> DataFrame:
    """Object key of each URI, or why access is denied."""
    problem = uri_problem(F.col("storage_uri"), bucket)
    return records.withColumns(
        {
            "problem": problem,
            "key": F.when(problem.isNull(), uri_key(F.col("storage_uri"))),
            "category": F.when(problem.isNotNull(), "RawPayloadAccessDenied"),
        }
    )


def authorize_reads(records: DataFrame, bucket: str, tenant: str = "tenant_uuid") -> DataFrame:
    """Only keys below the reader's own tenant may be read."""
    parsed = parse_uris(records, bucket)
    foreign = F.col("problem").isNull() & (key_tenant(F.col("key")) != F.col(tenant))
    return parsed.withColumns(
        {
            "problem": F.when(foreign, "other tenant").otherwise(F.col("problem")),
            "category": F.when(
                foreign | F.col("problem").isNotNull(), "RawPayloadAccessDenied"
            ),
        }
    )


def verify_objects(objects: DataFrame, body: str = "body") -> DataFrame:
    """Re-hash stored bytes against the checksum in their key; no checksum, no check."""
    expected = key_checksum(F.col("key"))
    actual = F.sha2(F.col(body).cast("binary"), 256)
    return objects.withColumns(
        {
            "expected": expected,
            "category": F.when(actual != expected, "RawPayloadIntegrityError"),
        }
    ).drop(body)


def mark_loaded(records: DataFrame, loaded: DataFrame) -> DataFrame:
    """Set the loaded flag on exactly the versions acted on; others keep theirs."""
    acted = loaded.select(*VERSION_KEY).distinct().withColumn("_loaded", F.lit(True))
    return (
        records.join(acted, VERSION_KEY, "left")
        .withColumn(
            "loaded_successfully",
            F.col("loaded_successfully") | F.coalesce("_loaded", F.lit(False)),
        )
        .drop("_loaded")
    )


def backfill_loaded(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Set the loaded flag on every record of a succeeded run."""
    done = runs.where("status = 'succeeded'").select("run", F.lit(True).alias("_done"))
    return (
        records.join(done, "run", "left")
        .withColumn(
            "loaded_successfully",
            F.col("loaded_successfully") | F.coalesce("_done", F.lit(False)),
        )
        .drop("_done")
    )


def list_records(records: DataFrame) -> DataFrame:
    """Records in their standing order."""
    return records.orderBy("sequence", "created_at", "record_id")
