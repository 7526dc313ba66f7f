"""Queries over the raw payload store."""

from pyspark.sql import functions as F

from millrace.functions.keys import key_checksum
from millrace.operators import rawstore
from millrace.plans.fixtures import fixture
from millrace.plans.registry import query

BUCKET = "pile"


def _deliveries(spark, sf_dir):
    return rawstore.address_payloads(fixture(spark, sf_dir, "deliveries"))


def _objects(spark, sf_dir):
    return fixture(spark, sf_dir, "stored_objects")


def _records(spark, sf_dir):
    return fixture(spark, sf_dir, "storage_records")


@query(
    "payload_checksum",
    """SELECT doc_id, sha256(text) AS checksum_sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes
       FROM documents""",
)
def payload_checksum(spark, sf_dir):
    return rawstore.address_payloads(fixture(spark, sf_dir, "raw_payloads")).select(
        F.col("arrival").alias("doc_id"), "checksum_sha256", "size_bytes"
    )


@query(
    "storage_key",
    """SELECT doc_id, concat(doc_id % 20 % 6, '/', doc_id % 20, '/', format('{:06d}', doc_id * 5000 + 1), '-',
              sha256(text), '.raw') AS logical_key FROM documents""",
)
def storage_key(spark, sf_dir):
    payloads = fixture(spark, sf_dir, "raw_payloads").withColumn(
        "sequence", F.col("arrival") * 5000 + 1
    )
    return rawstore.address_payloads(payloads).select(
        F.col("arrival").alias("doc_id"), "logical_key"
    )


@query(
    "tenant_uri",
    """SELECT arrival, d.org_id, concat('s3://pile/', tenant_uuid || '/' || lkey) AS storage_uri, category
       FROM (SELECT d.arrival, d.org_id, d.lkey, o.tenant_uuid,
                    CASE WHEN o.tenant_uuid IS NULL THEN 'ConfigurationError' END AS category
             FROM delivery_keys d LEFT JOIN organizations o ON o.org_id = d.org_id) d
       WHERE category IS NULL
       UNION ALL
       SELECT arrival, d.org_id, NULL, 'ConfigurationError' FROM delivery_keys d
       WHERE d.org_id NOT IN (SELECT org_id FROM organizations)""",
)
def tenant_uri(spark, sf_dir):
    deliveries = _deliveries(spark, sf_dir)
    return rawstore.tenant_uris(
        deliveries, fixture(spark, sf_dir, "organizations"), BUCKET
    ).select("arrival", "org_id", "storage_uri", "category")


@query(
    "put_if_absent",
    """SELECT min(arrival) AS arrival, lkey AS key, CAST(octet_length(encode(any_value(payload))) AS BIGINT) AS size_bytes
       FROM delivery_keys WHERE lkey NOT IN (SELECT key FROM stored_objects) GROUP BY lkey""",
)
def put_if_absent(spark, sf_dir):
    incoming = _deliveries(spark, sf_dir).withColumnRenamed("logical_key", "key")
    return rawstore.put_if_absent(incoming, _objects(spark, sf_dir)).select(
        "arrival", "key", "size_bytes"
    )


@query(
    "put_size_conflict",
    """SELECT d.arrival, o.key, CAST(octet_length(encode(d.payload)) AS BIGINT) AS size_bytes,
              o.size_bytes AS stored_size, 'RawPayloadIntegrityError' AS category
       FROM delivery_keys d JOIN stored_objects o ON o.key = d.lkey
       WHERE o.size_bytes <> octet_length(encode(d.payload))""",
)
def put_size_conflict(spark, sf_dir):
    incoming = (
        _deliveries(spark, sf_dir).withColumnRenamed("logical_key", "key").drop("payload")
    )
    return rawstore.put_conflicts(incoming, _objects(spark, sf_dir)).select(
        "arrival", "key", "size_bytes", "stored_size", "category"
    )


@query(
    "raw_record_upsert",
    """SELECT run, sequence, sha AS checksum_sha256, min(arrival) AS arrival,
              min_by(source_path, arrival) AS source_path, min_by(item_count, arrival) AS item_count
       FROM delivery_keys d
       WHERE NOT EXISTS (SELECT 1 FROM delivery_keys r WHERE r.arrival % 5 = 2 AND r.run = d.run
                         AND r.sequence = d.sequence AND r.sha = d.sha)
       GROUP BY run, sequence, sha""",
)
def raw_record_upsert(spark, sf_dir):
    incoming = _deliveries(spark, sf_dir).drop("payload")
    recorded = incoming.where("arrival % 5 = 2")
    return rawstore.new_records(incoming, recorded).select(
        *rawstore.VERSION_KEY, "arrival", "source_path", "item_count"
    )


@query(
    "payload_versions",
    """SELECT run, sequence, count(DISTINCT sha) AS versions, count(*) AS deliveries
       FROM delivery_keys GROUP BY run, sequence""",
)
def payload_versions(spark, sf_dir):
    return rawstore.payload_versions(_deliveries(spark, sf_dir))


@query(
    "uri_parse",
    """SELECT record_id, CASE WHEN NOT starts_with(storage_uri, 's3://') OR split_part(storage_uri, '/', 3) = ''
                 OR length(storage_uri) <= 6 + length(split_part(storage_uri, '/', 3)) THEN 'not a raw payload URI'
              WHEN split_part(storage_uri, '/', 3) <> 'pile' THEN 'other bucket' END AS problem,
              CASE WHEN starts_with(storage_uri, 's3://pile/') AND length(storage_uri) > 10
                   THEN substr(storage_uri, 11) END AS key
       FROM storage_records""",
)
def uri_parse(spark, sf_dir):
    return rawstore.parse_uris(_records(spark, sf_dir), BUCKET).select(
        "record_id", "problem", "key"
    )


@query(
    "tenant_read_check",
    """SELECT record_id, CASE WHEN NOT starts_with(storage_uri, 's3://') OR storage_uri = 's3://pile/'
                  THEN 'not a raw payload URI'
              WHEN split_part(storage_uri, '/', 3) <> 'pile' THEN 'other bucket'
              WHEN split_part(storage_uri, '/', 4) <> tenant_uuid THEN 'other tenant' END AS problem
       FROM storage_records""",
)
def tenant_read_check(spark, sf_dir):
    return rawstore.authorize_reads(_records(spark, sf_dir), BUCKET).select("record_id", "problem")


@query(
    "key_checksum",
    """SELECT record_id, CASE record_id % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL
              WHEN 3 THEN NULL ELSE checksum_sha256 END AS checksum FROM storage_records""",
)
def key_checksum_query(spark, sf_dir):
    sha, which = F.col("checksum_sha256"), F.col("record_id") % 7
    key = (
        F.when(which == 0, F.concat(F.lit("a/b/000001-"), sha, F.lit(".json")))
        .when(which == 1, F.concat(F.lit("a/b/000001"), sha, F.lit(".raw")))
        .when(which == 2, F.concat(F.lit("a/b/000001-x-"), sha, F.lit(".raw")))
        .when(which == 3, F.concat(F.lit("a-"), sha, F.lit(".raw/000001-short.raw")))
        .when(which == 4, F.concat(F.lit("-"), sha, F.lit(".raw")))
        .otherwise(F.concat(F.lit("a-b/c/000001-"), sha, F.lit(".raw")))
    )
    return _records(spark, sf_dir).select("record_id", key_checksum(key).alias("checksum"))


@query(
    "verified_read",
    """SELECT key, regexp_extract(key, '-([0-9a-f]{64})[.]raw$', 1) AS expected,
              CASE WHEN sha256(body) <> regexp_extract(key, '-([0-9a-f]{64})[.]raw$', 1)
                   THEN 'RawPayloadIntegrityError' END AS category
       FROM storage_objects""",
)
def verified_read(spark, sf_dir):
    return rawstore.verify_objects(fixture(spark, sf_dir, "storage_objects")).select(
        "key", "expected", "category"
    )


@query(
    "mark_loaded",
    """SELECT record_id, run, sequence, record_id % 11 = 0 OR record_id % 3 = 1 AS loaded_successfully
       FROM storage_records""",
)
def mark_loaded(spark, sf_dir):
    records = _records(spark, sf_dir).withColumn(
        "loaded_successfully", F.col("record_id") % 11 == 0
    )
    acted = records.where("record_id % 3 = 1")
    return rawstore.mark_loaded(records, acted).select(
        "record_id", "run", "sequence", "loaded_successfully"
    )


@query(
    "backfill_loaded",
    """SELECT s.record_id, s.run, s.record_id % 11 = 0 OR r.status = 'succeeded' AS loaded_successfully
       FROM storage_records s JOIN runs r ON r.run_id = s.run""",
)
def backfill_loaded(spark, sf_dir):
    records = _records(spark, sf_dir).withColumn(
        "loaded_successfully", F.col("record_id") % 11 == 0
    )
    runs = fixture(spark, sf_dir, "runs").select(F.col("run_id").alias("run"), "status")
    return rawstore.backfill_loaded(records, runs).select(
        "record_id", "run", "loaded_successfully"
    )


@query(
    "raw_listing",
    "SELECT record_id, run, sequence, checksum_sha256 FROM storage_records ORDER BY sequence, record_id",
)
def raw_listing(spark, sf_dir):
    records = _records(spark, sf_dir).withColumn("created_at", F.col("record_id"))
    return rawstore.list_records(records).select("record_id", "run", "sequence", "checksum_sha256")
