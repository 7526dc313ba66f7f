"""Queries over storage-key inspection, migration and its jobs."""

from pyspark.sql import functions as F

from millrace.operators import migration
from millrace.plans.fixtures import fixture
from millrace.plans.registry import query

BUCKET = "pile"

_INSPECTED = """
WITH classified AS (
  SELECT *, CASE WHEN storage_uri = concat('s3://pile/', tenant_uuid, '/', lk) THEN 'already_migrated'
                 WHEN storage_uri = concat('s3://pile/', schema_name, '/', lk) THEN 'schema_prefixed'
                 WHEN storage_uri = concat('s3://pile/', lk) THEN 'legacy_unprefixed'
                 ELSE 'checksum_conflict' END AS generation
  FROM (SELECT *, concat(config_id, '/', run, '/', format('{:06d}', sequence), '-', checksum_sha256, '.raw') AS lk
        FROM storage_records) t),
inspected AS (
  SELECT c.*, CASE WHEN generation = 'already_migrated' THEN 'already_migrated'
                   WHEN generation = 'checksum_conflict' THEN 'unrecognised'
                   WHEN o.key IS NULL THEN 'missing'
                   WHEN sha256(o.body) <> c.checksum_sha256 THEN 'tampered' ELSE 'ready' END AS finding
  FROM classified c LEFT JOIN storage_objects o ON concat('s3://pile/', o.key) = c.storage_uri)
"""
_COUNTS = """
  count(*) AS records_inspected,
  count(*) FILTER (finding = 'already_migrated') AS already_migrated,
  count(*) FILTER (generation = 'legacy_unprefixed' AND finding IN ('tampered', 'ready')) AS legacy_unprefixed,
  count(*) FILTER (generation = 'schema_prefixed' AND finding IN ('tampered', 'ready')) AS schema_prefixed,
  count(*) FILTER (finding = 'missing') AS missing_objects,
  count(*) FILTER (finding IN ('unrecognised', 'tampered')) AS checksum_conflicts,
  count(*) FILTER (finding = 'ready') AS ready_for_migration"""


def _findings(spark, sf_dir):
    return migration.inspect_records(
        fixture(spark, sf_dir, "storage_records").drop("payload"),
        fixture(spark, sf_dir, "storage_objects"),
        BUCKET,
    )


@query("key_generation", _INSPECTED + "SELECT record_id, generation FROM classified")
def key_generation(spark, sf_dir):
    records = fixture(spark, sf_dir, "storage_records").drop("payload")
    return migration.classify_generation(records, BUCKET).select("record_id", "generation")


@query(
    "missing_objects",
    _INSPECTED + "SELECT record_id, generation, storage_uri FROM inspected WHERE finding = 'missing'",
)
def missing_objects(spark, sf_dir):
    return migration.absent_objects(
        fixture(spark, sf_dir, "storage_records").drop("payload"), fixture(spark, sf_dir, "storage_objects"), BUCKET
    ).select("record_id", "generation", "storage_uri")


@query(
    "checksum_conflicts",
    _INSPECTED
    + "SELECT record_id, finding, checksum_sha256 FROM inspected WHERE finding IN ('tampered', 'unrecognised')",
)
def checksum_conflicts(spark, sf_dir):
    return (
        _findings(spark, sf_dir)
        .where("finding IN ('tampered', 'unrecognised')")
        .select("record_id", "finding", "checksum_sha256")
    )


@query(
    "migration_summary",
    _INSPECTED
    + f"SELECT schema_name, {_COUNTS}, count(*) FILTER (finding <> 'ready') AS records_skipped"
    + ", CAST(0 AS BIGINT) AS records_migrated FROM inspected GROUP BY schema_name",
)
def migration_summary(spark, sf_dir):
    return migration.summarize(_findings(spark, sf_dir), ("schema_name",))


@query(
    "problem_sample",
    _INSPECTED
    + """SELECT record_id, run, sequence, substr(checksum_sha256, 1, 12) AS checksum_prefix,
           CASE WHEN finding = 'missing' THEN 'missing' ELSE 'checksum_conflict' END AS category,
           CASE finding WHEN 'missing' THEN 'object not found in storage at the legacy key'
                WHEN 'tampered' THEN 'downloaded object checksum does not match the recorded checksum'
                ELSE 'storage_uri does not match any recognized key shape for this record' END AS reason
         FROM inspected WHERE finding IN ('missing', 'tampered', 'unrecognised')
         ORDER BY record_id LIMIT 200""",
)
def problem_sample(spark, sf_dir):
    return migration.problem_sample(_findings(spark, sf_dir))


@query(
    "apply_migration",
    _INSPECTED
    + """SELECT record_id, finding = 'ready' AS migrated,
           CASE WHEN finding = 'ready' THEN concat('s3://pile/', tenant_uuid, '/', lk) ELSE storage_uri END
             AS storage_uri
         FROM inspected""",
)
def apply_migration(spark, sf_dir):
    return migration.repoint_records(_findings(spark, sf_dir), BUCKET).select(
        "record_id", "migrated", "storage_uri"
    )


@query(
    "moved_objects",
    _INSPECTED
    + """SELECT concat(c.tenant_uuid, '/', c.lk) AS key, o.content_type, sha256(o.body) AS body_sha256
         FROM inspected c JOIN storage_objects o ON concat('s3://pile/', o.key) = c.storage_uri
         WHERE c.finding = 'ready' AND concat(c.tenant_uuid, '/', c.lk) NOT IN (SELECT key FROM storage_objects)""",
)
def moved_objects(spark, sf_dir):
    moved = migration.moved_objects(
        _findings(spark, sf_dir), fixture(spark, sf_dir, "storage_objects")
    )
    return moved.select("key", "content_type", F.sha2("body", 256).alias("body_sha256"))


@query(
    "migration_progress",
    _INSPECTED
    + f""", numbered AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY record_id) - 1) / 100) AS BIGINT) AS batch
                        FROM inspected)
        SELECT b.batch, false AS final, {_COUNTS}, CAST(0 AS BIGINT) AS records_skipped,
               count(*) FILTER (finding = 'ready') AS records_migrated
        FROM (SELECT batch FROM numbered GROUP BY batch HAVING count(*) = 100) b JOIN numbered n ON n.batch <= b.batch
        GROUP BY b.batch
        UNION ALL
        SELECT CAST(ceil(count(*) / 100) AS BIGINT), true, {_COUNTS}, count(*) FILTER (finding <> 'ready'),
               count(*) FILTER (finding = 'ready')
        FROM inspected""",
)
def migration_progress(spark, sf_dir):
    return migration.progress_reports(migration.repoint_records(_findings(spark, sf_dir), BUCKET))


@query(
    "migration_reuse_conflict",
    _INSPECTED
    + """SELECT record_id, concat(tenant_uuid, '/', lk) AS new_key, checksum_sha256,
                'RawPayloadIntegrityError' AS category
         FROM inspected WHERE finding = 'ready' AND record_id % 7 = 2""",
)
def migration_reuse_conflict(spark, sf_dir):
    findings = _findings(spark, sf_dir)
    objects = fixture(spark, sf_dir, "storage_objects")
    # Some tenant keys are taken already, half of them by other bytes.
    taken = fixture(spark, sf_dir, "storage_records").where("record_id % 7 IN (2, 3) AND record_id % 5 IN (1, 2, 4)")
    lk = F.format_string("%s/%s/%06d-%s.raw", F.col("config_id").cast("string"), F.col("run").cast("string"), "sequence", "checksum_sha256")
    body = F.when(F.col("record_id") % 7 == 2, F.concat("payload", F.lit("?"))).otherwise(F.col("payload"))
    planted = taken.select(F.concat_ws("/", "tenant_uuid", lk).alias("key"), F.lit("application/json").alias("content_type"), body.alias("body"))
    return migration.reuse_conflicts(findings, objects.unionByName(planted)).drop("actual_sha256")


@query(
    "migration_rerun",
    _INSPECTED
    + """SELECT record_id, CASE WHEN finding = 'ready' THEN 'already_migrated' ELSE finding END AS finding FROM inspected""",
)
def migration_rerun(spark, sf_dir):
    records = fixture(spark, sf_dir, "storage_records").drop("payload")
    objects = fixture(spark, sf_dir, "storage_objects")
    found = migration.inspect_records(records, objects, BUCKET)
    grown = objects.unionByName(migration.moved_objects(found, objects).select(*objects.columns))
    moved = migration.repoint_records(found, BUCKET, migration.reuse_conflicts(found, objects))
    return migration.inspect_records(moved.select(*records.columns), grown, BUCKET).select("record_id", "finding")


@query(
    "migration_cancelled",
    _INSPECTED
    + """, numbered AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY record_id) - 1) / 100) AS BIGINT) AS batch
                        FROM inspected)
         SELECT record_id, batch, finding FROM numbered
         WHERE batch <= (SELECT min(CAST(floor(doc_id / 100) AS BIGINT)) FROM documents WHERE n_chars > 5000)""",
)
def migration_cancelled(spark, sf_dir):
    records = fixture(spark, sf_dir, "storage_records").drop("payload")
    cancels = (
        fixture(spark, sf_dir, "raw_payloads")
        .where("item_count > 5000")
        .select(F.floor(F.col("arrival") / 100).cast("bigint").alias("batch"))
        .distinct()
    )
    return migration.cancelled_pass(
        records, fixture(spark, sf_dir, "storage_objects"), BUCKET, cancels
    ).select("record_id", "batch", "finding")
