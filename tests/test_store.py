"""Raw payload store and key migration."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.operators import migration, rawstore

TENANT, SCHEMA = "0a-uuid", "acme"
PAYLOAD = "arrival bigint, config_id bigint, run bigint, sequence bigint, payload string, org_id bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def addressed(spark, payloads):
    rows = [(i, 7, r, s, p, 1) for i, (r, s, p) in enumerate(payloads)]
    return rawstore.address_payloads(spark.createDataFrame(rows, PAYLOAD))


def test_key_pads_but_never_cuts_the_sequence(spark):
    got = addressed(spark, [(3, 1, "a"), (3, 1234567, "a")]).orderBy("sequence").collect()
    assert [r.logical_key for r in got] == [
        f"7/3/000001-{sha('a')}.raw", f"7/3/1234567-{sha('a')}.raw",
    ]


def test_identical_retry_is_one_record_and_conflicting_retry_two(spark, rows):
    incoming = addressed(spark, [(1, 1, "a"), (1, 1, "a"), (1, 1, "b")])
    nothing = incoming.limit(0)
    assert rows(rawstore.new_records(incoming, nothing), "arrival") == [(0,), (2,)]
    assert rows(rawstore.payload_versions(incoming), "versions", "deliveries") == [(2, 3)]


def test_putting_twice_is_putting_once(spark, rows):
    incoming = addressed(spark, [(1, 1, "a"), (1, 2, "b"), (1, 2, "b")]).withColumnRenamed("logical_key", "key")
    stored = incoming.limit(0)
    first = rawstore.put_if_absent(incoming, stored)
    assert rows(first, "arrival") == [(0,), (1,)]
    assert rawstore.put_if_absent(incoming, first).count() == 0


def test_reuse_with_another_size_is_an_integrity_error(spark, rows):
    incoming = addressed(spark, [(1, 1, "a"), (1, 2, "bb"), (1, 3, "c")]).withColumnRenamed("logical_key", "key")
    change = F.when(F.col("sequence") == 1, 99).when(F.col("sequence") == 2, F.col("size_bytes"))
    objects = incoming.select("key", change.cast("bigint").alias("size_bytes"))
    assert rows(rawstore.put_conflicts(incoming, objects), "sequence", "stored_size", "category") == [
        (1, 99, "RawPayloadIntegrityError")
    ]


@pytest.mark.parametrize(
    "uri, problem",
    [
        ("s3://pile/k", None), ("http://pile/k", "not a raw payload URI"), ("s3://", "not a raw payload URI"),
        ("s3:///k", "not a raw payload URI"), ("s3://pile", "not a raw payload URI"),
        ("s3://pile/", "not a raw payload URI"), ("s3://other/k", "other bucket"), ("s3://pile//k", None),
    ],
)
def test_uri_shapes(spark, uri, problem):
    df = spark.createDataFrame([(uri,)], "storage_uri string")
    assert rawstore.parse_uris(df, "pile").first().problem == problem


def test_reads_stay_inside_the_tenant(spark, rows):
    df = spark.createDataFrame([(f"s3://pile/{TENANT}/k",), ("s3://pile/other/k",)], "storage_uri string")
    got = rawstore.authorize_reads(df.withColumn("tenant_uuid", F.lit(TENANT)), "pile")
    assert rows(got, "problem", "category") == [
        ("other tenant", "RawPayloadAccessDenied"), (None, None),
    ]


@pytest.mark.parametrize(
    "key, found",
    [
        (f"a/000001-{'f' * 64}.raw", True), (f"a/-{'f' * 64}.raw", True), (f"a/{'f' * 64}.raw", False),
        (f"a/1-{'f' * 63}.raw", False), (f"a/1-{'f' * 64}.json", False), (f"a/1-x-{'f' * 62}.raw", True),
    ],
)
def test_checksum_in_key(spark, key, found):
    row = spark.createDataFrame([(key,)], "key string").select(keys.key_checksum(F.col("key")).alias("c")).first()
    assert (row.c is not None) is found


def test_tampered_object_fails_on_read(spark, rows):
    objects = spark.createDataFrame(
        [(f"a/1-{sha('x')}.raw", "x"), (f"a/2-{sha('x')}.raw", "y"), ("a/free", "z")], "key string, body string"
    )
    assert rows(rawstore.verify_objects(objects), "key", "category")[1:] == [
        (f"a/2-{sha('x')}.raw", "RawPayloadIntegrityError"), ("a/free", None),
    ]


def test_only_the_version_acted_on_is_marked(spark, rows):
    records = addressed(spark, [(1, 1, "a"), (1, 1, "b")]).withColumn("loaded_successfully", F.lit(False))
    marked = rawstore.mark_loaded(records, records.where("arrival = 1"))
    assert rows(marked, "arrival", "loaded_successfully") == [(0, False), (1, True)]


def test_backfill_touches_succeeded_runs_only(spark, rows):
    records = spark.createDataFrame(
        [(1, 1, False), (2, 2, False), (3, 3, True), (4, 9, False)], "record_id int, run int, loaded_successfully boolean"
    )
    runs = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, "running")], "run int, status string")
    assert rows(rawstore.backfill_loaded(records, runs), "record_id", "loaded_successfully") == [
        (1, True), (2, False), (3, True), (4, False),
    ]


# --- migration -----------------------------------------------------------------


def stored(spark, kinds):
    """One record per kind, and the objects that exist."""
    records, objects = [], []
    for i, kind in enumerate(kinds):
        body, logical = f"body{i}", f"7/1/{i:06d}-{sha(f'body{i}')}.raw"
        key = {"uuid": f"{TENANT}/{logical}", "schema": f"{SCHEMA}/{logical}"}.get(kind.split("-")[0], logical)
        uri = f"s3://{'other' if kind == 'foreign' else 'pile'}/{key}"
        if kind == "odd":
            uri = "s3://pile/elsewhere.raw"
        records.append((i, 7, 1, i, sha(body), uri, TENANT, SCHEMA))
        if kind not in ("plain-missing", "foreign", "odd"):
            objects.append((key, "application/json", body + ("!" if kind.endswith("tampered") else "")))
    return (
        spark.createDataFrame(
            records,
            "record_id bigint, config_id bigint, run bigint, sequence bigint, checksum_sha256 string,"
            " storage_uri string, tenant_uuid string, schema_name string",
        ),
        spark.createDataFrame(objects, "key string, content_type string, body string"),
    )


KINDS = ["uuid", "schema", "plain", "plain", "plain-missing", "schema-tampered", "foreign", "odd"]


def test_summary_adds_up(spark):
    total = migration.summarize(migration.inspect_records(*stored(spark, KINDS), "pile")).first().asDict()
    assert total == {
        "records_inspected": 8, "already_migrated": 1, "legacy_unprefixed": 2, "schema_prefixed": 2,
        "missing_objects": 1, "checksum_conflicts": 3, "ready_for_migration": 3, "records_skipped": 5, "records_migrated": 0,
    }
    assert total["records_inspected"] == total["records_skipped"] + total["ready_for_migration"]


def test_second_pass_finds_everything_migrated(spark, rows):
    records, objects = stored(spark, ["uuid", "schema", "plain"])
    found = migration.inspect_records(records, objects, "pile")
    grown = objects.unionByName(migration.moved_objects(found, objects).select(*objects.columns))
    moved = migration.repoint_records(found, "pile")
    assert grown.count() == 5
    again = migration.inspect_records(moved.select(*records.columns), grown, "pile")
    assert rows(again.groupBy("finding").count()) == [("already_migrated", 3)]
    assert migration.moved_objects(again, grown).count() == 0


def test_problem_sample_is_bounded_ordered_and_free_of_bodies(spark):
    found = migration.inspect_records(*stored(spark, KINDS), "pile")
    sample = migration.problem_sample(found, limit=2).collect()
    assert [(r.record_id, r.category) for r in sample] == [(4, "missing"), (5, "checksum_conflict")]
    assert all(len(r.checksum_prefix) == 12 for r in sample) and "body" not in sample[0].asDict()


def test_progress_and_cancel_follow_batches(spark, rows):
    records, objects = stored(spark, KINDS)
    found = migration.repoint_records(migration.inspect_records(records, objects, "pile"), "pile")
    reports = rows(migration.progress_reports(found, batch=3), "batch", "final", "records_inspected", "records_migrated", "records_skipped")
    assert reports == [(0, False, 3, 2, 0), (1, False, 6, 3, 0), (3, True, 8, 3, 5)]
    # A count that is a multiple of the batch gets its last report as well.
    assert rows(migration.progress_reports(found, batch=4), "batch", "final") == [(0, False), (1, False), (2, True)]
    cancels = spark.createDataFrame([(1,), (2,)], "batch bigint")
    assert migration.cancelled_pass(records, objects, "pile", cancels, batch=3).count() == 6
    # The last batch is not full, so a cancel pending there comes too late.
    assert migration.cancelled_pass(records, objects, "pile", cancels.where("batch = 2"), batch=3).count() == 8


def test_other_bytes_at_the_new_key_are_no_migration(spark, rows):
    records, objects = stored(spark, KINDS)
    found = migration.inspect_records(records, objects, "pile")
    new = migration.moved_objects(found, objects).select(*objects.columns)
    spoiled = objects.unionByName(new.withColumn("body", F.lit("corrupt").cast(objects.schema["body"].dataType)))
    conflicts = migration.reuse_conflicts(found, spoiled)
    assert conflicts.count() == 3 and migration.reuse_conflicts(found, objects.unionByName(new)).isEmpty()
    assert migration.repoint_records(found, "pile", conflicts).where("migrated").isEmpty()


@pytest.mark.parametrize(
    "job, status",
    [
        ((True, True, True, 1, 1), "failed"), ((False, True, True, 1, 1), "cancelled"),
        ((False, False, True, 1, 1), "succeeded"), ((False, False, False, 1, 0), "partially_failed"),
        ((False, False, False, 0, 2), "partially_failed"), ((False, False, False, 0, 0), "succeeded"),
    ],
)
def test_final_status(spark, job, status):
    df = spark.createDataFrame(
        [job], "raised boolean, cancel_requested boolean, dry_run boolean, missing_objects int, checksum_conflicts int"
    )
    assert migration.final_status(df).first().final_status == status
