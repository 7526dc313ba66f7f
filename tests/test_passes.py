"""Passes over the store: migration in ranges that goes on, and verification of what changed."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators.migration import inspect_records, progress_reports, reuse_conflicts, repoint_records
from millrace.plans.migration_pass import migrate, repointed
from millrace.sources import ledger, objects, tables

RECORD = "record_id bigint, config_id int, run int, sequence int, checksum_sha256 string, storage_uri string, tenant_uuid string, schema_name string"
TENANT = "0a0a0a0a-1b1b-2c2c-3d3d-4e4e4e4e4e4e"


def sha(body):
    return hashlib.sha256(body.encode()).hexdigest()


def logical(k, body):
    return f"1/2/{k:06d}-{sha(body)}.raw"


def stocked(tmp_path, n):
    """Records 10, 20, …: legacy, schema-prefixed, migrated, missing, tampered and unrecognised in turn."""
    store = objects.FolderStore(f"{tmp_path}/store")
    store.provision("pile")
    rows = []
    for k in range(n):
        body = f"body {k}"
        key = {0: logical(k, body), 1: f"old/{logical(k, body)}", 2: f"{TENANT}/{logical(k, body)}", 3: logical(k, body), 4: logical(k, body), 5: f"x/{logical(k, body)}"}[k % 6]
        if k % 6 != 3:
            store.create("pile", key, (body + ("!" if k % 6 == 4 else "")).encode())
        rows.append((k * 10, 1, 2, k, sha(body), f"s3://pile/{key}", TENANT, "old"))
    return store, rows


def found(done):
    return sorted((r.record_id, r.finding, r.migrated, r.storage_uri) for r in done.findings.collect())


def by_loop(store, rows):
    """The pass record by record: what it finds and moves, and the record that ends it."""
    out = []
    for record, *_, k, checksum, uri, tenant, schema in sorted(rows):
        key, lk = uri.removeprefix("s3://pile/"), f"1/2/{k:06d}-{checksum}.raw"
        if key == f"{tenant}/{lk}":
            out.append((record, "already_migrated", False, uri))
        elif key not in (lk, f"{schema}/{lk}"):
            out.append((record, "unrecognised", False, uri))
        elif (data := store.read("pile", key)) is None:
            out.append((record, "missing", False, uri))
        elif hashlib.sha256(data).hexdigest() != checksum:
            out.append((record, "tampered", False, uri))
        elif store.read("pile", f"{tenant}/{lk}") not in (None, data):
            return out, record
        else:
            out.append((record, "ready", True, f"s3://pile/{tenant}/{lk}"))
    return out, None


def test_a_pass_equals_the_loop_and_moves_the_bytes(spark, tmp_path):
    store, rows = stocked(tmp_path, 40)
    want, _ = by_loop(store, rows)
    records = spark.createDataFrame(rows[::-1], RECORD)
    done = migrate(records, store, "pile", f"{tmp_path}/pass", range_records=7)
    assert found(done) == want and (done.status, done.category) == ("partially_failed", None)
    for _, _, moved, uri in want:
        if moved:
            key = uri.removeprefix("s3://pile/")
            assert sha(store.read("pile", key).decode()) == key.rsplit("-", 1)[1].removesuffix(".raw")
    assert tables.history(spark, f"{tmp_path}/pass/results").count() == 6
    after = repointed(records, done.findings)
    again = migrate(after, store, "pile", f"{tmp_path}/second")
    assert [r[1] for r in found(again)] == ["already_migrated" if r[1] == "ready" else r[1] for r in want]
    reports = {r.batch: r for r in progress_reports(done.findings, 16).collect()}
    assert [reports[k].records_inspected for k in (0, 1, 3)] == [16, 32, 40]


def test_a_pass_agrees_with_the_plain_inspection(spark, tmp_path):
    store, rows = stocked(tmp_path, 30)
    records = spark.createDataFrame(rows, RECORD)
    listed = objects.list_objects(spark, store, "pile").select("key")
    bodies = spark.createDataFrame([(r.key, store.read("pile", r.key)) for r in listed.collect()], "key string, body binary")
    plain = inspect_records(records, bodies, "pile")
    want = repoint_records(plain, "pile", reuse_conflicts(plain, bodies))
    done = migrate(records, store, "pile", f"{tmp_path}/pass")
    assert found(done) == sorted((r.record_id, r.finding, r.migrated, r.storage_uri) for r in want.collect())


def test_a_dry_run_writes_no_object(spark, tmp_path):
    store, rows = stocked(tmp_path, 12)
    before = {r.key for r in objects.list_objects(spark, store, "pile").collect()}
    done = migrate(spark.createDataFrame(rows, RECORD), store, "pile", f"{tmp_path}/dry", dry_run=True)
    assert done.status == "succeeded" and not any(r[2] for r in found(done))
    assert {r.key for r in objects.list_objects(spark, store, "pile").collect()} == before


def test_a_cancel_during_the_pass_stops_it_and_it_goes_on(spark, tmp_path):
    store, rows = stocked(tmp_path, 30)
    want, _ = by_loop(store, rows)
    records, polls = spark.createDataFrame(rows, RECORD), []

    def cancelled():
        polls.append(1)
        return len(polls) == 2

    done = migrate(records, store, "pile", f"{tmp_path}/pass", cancelled=cancelled, range_records=8)
    assert done.status == "cancelled" and found(done) == want[:16]
    late = spark.createDataFrame([(5, 1, 2, 99, sha("late"), "s3://pile/none", TENANT, "old"), (999, 1, 2, 99, sha("late"), "s3://pile/none", TENANT, "old")], RECORD)
    on = migrate(records.unionByName(late), store, "pile", f"{tmp_path}/pass", range_records=3)
    assert on.status == "partially_failed" and found(on) == want
    assert [r.batch for r in tables.history(spark, f"{tmp_path}/pass/results").orderBy("version").collect()] == ["0:70", "80:150", "160:230", "240:290"]


def test_a_driver_that_dies_between_copy_and_publication(spark, tmp_path, monkeypatch):
    store, rows = stocked(tmp_path, 24)
    want, _ = by_loop(store, rows)
    records, real = spark.createDataFrame(rows, RECORD), tables.append

    def dies(rows, path, batch=None, **more):
        if batch == "80:150":
            raise RuntimeError("gone")
        return real(rows, path, batch, **more)

    monkeypatch.setattr(tables, "append", dies)
    with pytest.raises(RuntimeError, match="gone"):
        migrate(records, store, "pile", f"{tmp_path}/pass", range_records=8)
    monkeypatch.setattr(tables, "append", real)
    assert found(migrate(records, store, "pile", f"{tmp_path}/pass", range_records=8)) == want


@pytest.mark.parametrize("at", [0, 13])
def test_a_conflict_ends_the_pass_at_its_record(spark, tmp_path, at):
    store, rows = stocked(tmp_path, 24)
    store.create("pile", f"{TENANT}/{logical(at, f'body {at}')}", b"other bytes")
    store.create("pile", f"{TENANT}/{logical(18, 'body 18')}", b"others, too")
    want, met = by_loop(store, rows)
    assert met == at * 10
    records = spark.createDataFrame(rows, RECORD)
    for _ in range(2):
        done = migrate(records, store, "pile", f"{tmp_path}/pass", range_records=10)
        assert (done.status, done.category) == ("failed", objects.INTEGRITY)
        assert found(done) == want
    os.unlink(f"{store.root}/pile/{TENANT}/{logical(at, f'body {at}')}")
    on = migrate(records, store, "pile", f"{tmp_path}/pass", range_records=10)
    assert on.status == "failed" and found(on) == by_loop(store, rows)[0] and len(found(on)) == 18


def test_no_records_a_bucket_that_is_absent_and_a_range_that_is_gone(spark, tmp_path):
    store, rows = stocked(tmp_path, 12)
    records = spark.createDataFrame(rows, RECORD)
    empty = migrate(records.limit(0), store, "pile", f"{tmp_path}/empty")
    assert (empty.status, empty.category, found(empty)) == ("succeeded", None, [])
    absent = migrate(records.withColumn("storage_uri", F.replace("storage_uri", F.lit("pile"), F.lit("none"))), store, "none", f"{tmp_path}/absent")
    assert (absent.status, absent.category, found(absent)) == ("failed", objects.CONFIGURATION, [])
    first = migrate(records, store, "pile", f"{tmp_path}/pass", cancelled=lambda: True, range_records=4)
    assert len(found(first)) == 4
    rest = migrate(records.where("record_id >= 80"), store, "pile", f"{tmp_path}/pass")
    assert [r[0] for r in found(rest)] == [0, 10, 20, 30, 80, 90, 100, 110]


def test_only_what_changed_is_read(spark, tmp_path, monkeypatch):
    store, _ = stocked(tmp_path, 0)
    for k in range(6):
        store.create("pile", f"a/{logical(k, f'body {k}')}", f"body {k}".encode())
    store.create("pile", "plain", b"no checksum in the key")
    path = f"{tmp_path}/ledger"

    def rows(number, **more):
        return sorted((r.key, r.outcome) for r in ledger.verify_changed(spark, store, "pile", path, number, **more).collect())

    keys = [f"a/{logical(k, f'body {k}')}" for k in range(6)] + ["plain"]
    assert rows(1) == sorted((k, "there") for k in keys)
    assert rows(2) == []
    with open(f"{store.root}/pile/{keys[0]}", "wb") as file:
        file.write(b"body X")  # same size, another time
    os.utime(f"{store.root}/pile/{keys[0]}", (1, 1))
    os.unlink(f"{store.root}/pile/{keys[1]}")
    assert rows(3) == sorted([(keys[0], "changed"), (keys[1], "vanished")])
    assert rows(3) == sorted([(keys[0], "changed"), (keys[1], "vanished")])
    assert rows(4) == []
    store.create("pile", keys[1], b"body 1")
    assert rows(5) == [(keys[1], "there")]
    assert rows(6, everything=True) == sorted([(keys[0], "changed"), *[(k, "there") for k in keys[1:]]])


def test_a_pass_over_a_store_that_outgrew_the_file_scan(spark, tmp_path, monkeypatch):
    store, _ = stocked(tmp_path, 0)
    parts, cut = [], ledger.cut_lineage
    monkeypatch.setattr(ledger, "cut_lineage", lambda rows: parts.append(rows.rdd.getNumPartitions()) or cut(rows))
    keys = [f"{k % 9}/{logical(k, f'body {k}')}" for k in range(1100)]
    for number, (first, last) in enumerate([(0, 900), (900, 1100)], 1):
        for k in range(first, last):
            store.create("pile", keys[k], f"body {k}".encode())
        found = ledger.verify_changed(spark, store, "pile", f"{tmp_path}/ledger", number).collect()
        assert sorted((r.key, r.outcome) for r in found) == sorted((key, "there") for key in keys[first:last])
    assert parts[1] <= 4
    assert ledger.verify_changed(spark, store, "pile", f"{tmp_path}/ledger", 3).count() == 0


def test_a_pass_writes_down_only_what_changed(spark, tmp_path, monkeypatch):
    store, _ = stocked(tmp_path, 0)
    held, cut = [], ledger.cut_lineage
    monkeypatch.setattr(ledger, "cut_lineage", lambda rows: held.append((done := cut(rows)).count()) or done)
    keys = [f"{k % 9}/{logical(k, f'body {k}')}" for k in range(1100)]
    for k in range(1050):
        store.create("pile", keys[k], f"body {k}".encode())
    path = f"{tmp_path}/ledger"
    assert ledger.verify_changed(spark, store, "pile", path, 1).count() == 1050
    os.unlink(f"{store.root}/pile/{keys[0]}")
    for k in range(1050, 1100):
        store.create("pile", keys[k], f"body {k}".encode())
    found = ledger.verify_changed(spark, store, "pile", path, 2).collect()
    assert sorted((r.key, r.outcome) for r in found) == sorted([(keys[0], "vanished"), *((key, "there") for key in keys[1050:])])
    assert ledger.verify_changed(spark, store, "pile", path, 3).count() == 0
    assert held == [1050, 51, 0]
    assert ledger.verify_changed(spark, store, "pile", path, 4, everything=True).count() == 1099


def test_contents_are_not_scanned_to_find_what_changed(spark, tmp_path):
    store, _ = stocked(tmp_path, 3)
    plan = ledger.changed_objects(objects.list_objects(spark, store, "pile"), spark.createDataFrame([], ledger.COLUMNS))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan
