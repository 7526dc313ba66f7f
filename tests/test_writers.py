"""Objects whose names are taken once, and tables with a log of their loads."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from millrace.plans.ingestion import ingest, store_and_load
from millrace.sources import objects, tables
from millrace.sources.sinks import LoadRefused

PAYLOAD = "storage_uri string, payload string, arrival int"


def files(root):
    return sorted(os.path.relpath(p, root) for p in glob.glob(f"{root}/**", recursive=True, include_hidden=True) if os.path.isfile(p))


@pytest.fixture
def store(tmp_path):
    made = objects.FolderStore(f"file://{tmp_path}/store")
    made.provision("pile")
    return made


def put(spark, store, rows, **more):
    return objects.store_payloads(spark.createDataFrame(rows, PAYLOAD), store, **more)


def outcomes(found):
    return sorted(tuple(r) for r in found.select("storage_uri", "outcome", "category", "stored_size").collect())


def test_a_name_is_taken_once(store):
    with ThreadPoolExecutor(16) as writers:
        made = list(writers.map(lambda k: store.create("pile", "a/b.raw", b"x" * k), range(1, 200)))
    assert made.count(True) == 1
    assert store.size("pile", "a/b.raw") == made.index(True) + 1
    assert files(store.root) == ["pile/a/b.raw"]


def test_outcomes(spark, store):
    first = put(spark, store, [("s3://pile/a", "one", 1), ("s3://pile/b/c", "", 2), ("s3://pile/n", None, 3), ("s3://none/a", "x", 4), ("http://pile/a", "x", 5), (None, "x", 6)])
    wrong = objects.DENIED
    assert outcomes(first.where("storage_uri IS NOT NULL")) == sorted([
        ("s3://pile/a", "created", None, 3), ("s3://pile/b/c", "created", None, 0), ("s3://pile/n", "refused", wrong, None),
        ("s3://none/a", "absent", objects.CONFIGURATION, None), ("http://pile/a", "refused", wrong, None),
    ])
    assert first.where("storage_uri IS NULL").first().outcome == "refused"
    again = put(spark, store, [("s3://pile/a", "two", 1), ("s3://pile/a", "three", 2)], columns=["arrival"])
    assert sorted((r.arrival, r.outcome, r.stored_size) for r in again.collect()) == [(1, "reused", 3), (2, "conflict", 3)]
    assert store.read("pile", "a") == b"one" and not os.path.exists(f"{store.root}/none")
    assert put(spark, store, []).collect() == []


def test_outcomes_write_once_however_often_they_are_read(spark, store):
    found = put(spark, store, [(f"s3://pile/k{k % 50}", f"{k % 50:04d}", k) for k in range(500)])
    assert found.groupBy("outcome").count().count() == found.groupBy("outcome").count().count() == 2
    assert found.where("outcome = 'created'").count() == 50 == len(files(store.root))


def test_a_task_that_runs_again_leaves_one_object(spark, store):
    rows = [(f"s3://pile/k{k}", f"body {k}", k) for k in range(40)]
    crashed = spark.createDataFrame(rows, PAYLOAD).repartition(4)
    broken = crashed.withColumn("payload", F.when(F.col("arrival") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="lost"):
        objects.store_payloads(broken, store)
    objects.store_payloads(crashed, store)
    assert len(files(store.root)) == 40
    assert {store.read("pile", f"k{k}") for k in range(40)} == {f"body {k}".encode() for k in range(40)}


def test_no_key_leads_out_of_its_bucket(spark, store):
    for key in ("../x", "a/../../x", "a//b", ".parts/x", "."):
        with pytest.raises(ValueError, match="not an object key"):
            store.create("pile", key, b"x")
    with pytest.raises(ValueError, match="not a folder"):
        objects.FolderStore("hdfs://host/store")


def test_checks_find_what_is_gone_or_changed(spark, store):
    import hashlib

    good = hashlib.sha256(b"good").hexdigest()
    rows = [(f"s3://pile/1-{good}.raw", "good", 1), (f"s3://pile/2-{good}.raw", "evil", 2), ("s3://pile/plain", "any", 3)]
    put(spark, store, rows)
    asked = spark.createDataFrame([*rows, ("s3://pile/gone", "", 4), ("nowhere", "", 5)], PAYLOAD)
    found = objects.check_objects(asked, store, ["arrival"], read=True)
    assert sorted((r.arrival, r.outcome) for r in found.collect()) == [(1, "there"), (2, "changed"), (3, "there"), (4, "vanished"), (5, "refused")]
    thin = objects.check_objects(asked, store, ["arrival"])
    assert sorted((r.arrival, r.outcome) for r in thin.collect())[1] == (2, "there")
    listed = objects.list_objects(spark, store, "pile").collect()
    assert sorted((r.key.split("-")[0], r.size_bytes) for r in listed) == [("1", 4), ("2", 4), ("plain", 3)]


def test_a_large_bucket_is_listed_by_tasks(spark, store, monkeypatch):
    keys = [f"t{k % 5}/{k % 3}/{'deep/' * (k % 4)}{k}.raw" for k in range(1200)]
    for k, key in enumerate(keys):
        store.create("pile", key, b"x" * (1 + k % 7))
    os.makedirs(f"{store.root}/pile/empty/folder")
    for hidden in ("_part", "t0/.part", "_folder/x", "t1/x._COPYING_"):
        os.makedirs(os.path.dirname(f"{store.root}/pile/{hidden}"), exist_ok=True)
        open(f"{store.root}/pile/{hidden}", "w").close()
    store.create("pile", "_k=1", b"x")
    listed = objects.list_objects(spark, store, "pile")
    assert listed.rdd.getNumPartitions() <= 4  # Spark's own scan: one for some thirty files
    found = sorted(tuple(r) for r in listed.collect())
    assert [r[:2] for r in found] == sorted([("_k=1", 1), *((key, 1 + k % 7) for k, key in enumerate(keys))])
    monkeypatch.setattr(objects, "FEW_NAMES", 10_000)
    assert sorted(tuple(r) for r in objects.list_objects(spark, store, "pile").collect()) == found
    os.unlink(f"{store.root}/pile/{keys[0]}")
    assert listed.count() == 1200


@pytest.mark.parametrize("names, rounds", [(10_000, 1), (400, 3), (1, 12)])
def test_levels_of_folders_share_a_round(spark, store, monkeypatch, names, rounds):
    keys = [f"a/b{k % 3}/c{k % 7}/{'deep/' * (k % 4)}{k}.raw" for k in range(1100)]
    for key in keys:
        store.create("pile", key, b"x")
    cuts, cut = [], objects.cut_lineage
    monkeypatch.setattr(objects, "cut_lineage", lambda rows: cuts.append(1) or cut(rows))
    monkeypatch.setattr(objects, "NAMES", names)
    assert sorted(r.key for r in objects.list_objects(spark, store, "pile").collect()) == sorted(keys)
    assert len(cuts) <= rounds


def test_an_empty_object_is_listed(spark, store):
    store.create("pile", "a/empty", b"")
    store.create("pile", "a/full", b"x")
    assert sorted((r.key, r.size_bytes) for r in objects.list_objects(spark, store, "pile").collect()) == [("a/empty", 0), ("a/full", 1)]


def test_a_conflict_ends_the_pass_before_a_row_is_loaded(spark, store, tmp_path):
    run = "run bigint, config_id bigint, start_page bigint, page_size bigint, max_pages bigint, cursor string, retain_empty boolean"
    landed = spark.createDataFrame([(1, 1, '{"rows":[{"id":1},{"id":2}]}'), (1, 2, '{"rows":[{"id":3}]}'), (1, 1, '{"rows":[{"id":1},{"id":2}]}')], "run bigint, page bigint, body string")
    result = ingest(landed, spark.createDataFrame([(1, 7, 1, 2, 9, None, False)], run), "rows", {"id": "id"}, {"id": "bigint"}, bucket="pile")
    path = str(tmp_path / "table")
    tables.create_table(spark, path, "id bigint")
    uri = result.raw_records.orderBy("sequence").first().storage_uri
    store.create("pile", uri.removeprefix("s3://pile/"), b"other")
    with pytest.raises(objects.PassEnded) as ended:
        store_and_load(result, store, path, "b")
    assert ended.value.category == objects.INTEGRITY and tables.read_table(spark, path).count() == 0
    os.unlink(f"{store.root}/pile/{uri.removeprefix('s3://pile/')}")
    assert store_and_load(result, store, path, "b")[1] == 3 and store_and_load(result, store, path, "b")[1] == 0
    assert sorted(r.id for r in tables.read_table(spark, path).collect()) == [1, 2, 3]
    told = {r.storage_uri: r.size_bytes for r in result.raw_records.collect()}
    assert {f"s3://pile/{r.key}": r.size_bytes for r in objects.list_objects(spark, store, "pile").collect()} == told


# --- tables ------------------------------------------------------------------------------


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id int")


@pytest.fixture(params=["link", "rename"])
def claims(request, monkeypatch):
    """Both ways of claiming a version, on a local folder."""
    if request.param == "rename":
        made = tables.Log.__init__

        def as_elsewhere(self, *args):
            made(self, *args)
            self.local = False

        monkeypatch.setattr(tables.Log, "__init__", as_elsewhere)


def test_loads_replays_and_versions(spark, tmp_path, claims):
    path = str(tmp_path / "table")
    tables.create_table(spark, path, "id bigint, note string")
    tables.create_table(spark, path, "other int")
    assert tables.read_table(spark, path).columns == ["id", "note"] and tables.read_table(spark, path).count() == 0
    assert tables.append(numbers(spark, 1, 2), path, "a") == 2
    assert tables.append(numbers(spark, 1, 2, 3), path, "a") == 0
    assert tables.append(numbers(spark), path, "b") == 0
    assert tables.append(numbers(spark, 4), path, "b") == 1
    assert tables.append(numbers(spark, 4), path) == 1 and tables.append(numbers(spark, 4), path) == 1
    assert sorted(r.id for r in tables.read_table(spark, path).collect()) == [1, 2, 4, 4, 4]
    assert sorted(r.id for r in tables.read_table(spark, path, version=1).collect()) == [1, 2]
    assert [tuple(r) for r in tables.history(spark, path).orderBy("version").collect()] == [(1, "a", 2), (2, "b", 1), (3, None, 1), (4, None, 1)]
    assert not [f for f in files(path) if "/." in f and "crc" not in f]


def test_writers_at_one_time(spark, tmp_path, claims):
    path = str(tmp_path / "table")
    tables.create_table(spark, path, "id bigint")
    with ThreadPoolExecutor(6) as writers:
        added = list(writers.map(lambda k: tables.append(numbers(spark, k // 3), path, f"b{k // 3}"), range(12)))
    assert sum(added) == 4
    assert sorted(r.id for r in tables.read_table(spark, path).collect()) == [0, 1, 2, 3]
    assert sorted(r.version for r in tables.history(spark, path).collect()) == [1, 2, 3, 4]
    assert len(glob.glob(f"{path}/data/load=*")) == 4


def test_a_claim_is_exclusive(spark, tmp_path):
    log = tables.Log(spark, str(tmp_path / "table"))
    with ThreadPoolExecutor(8) as writers:
        assert sum(writers.map(lambda k: log.claim(5, {"batch": str(k)}), range(40))) == 1
    assert log.versions() == [5]


def test_what_no_entry_names_is_not_there(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.create_table(spark, path, "id bigint")
    tables.append(numbers(spark, 1), path, "a")
    spark.createDataFrame([(9,)], "id bigint").write.parquet(f"{path}/data/load=dead")
    (tmp_path / "table" / "log" / ".half").write_text("{")
    assert [r.id for r in tables.read_table(spark, path).collect()] == [1]
    assert tables.append(numbers(spark, 2), path, "b") == 1


def test_refusals_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(LoadRefused) as refused:
        tables.append(numbers(spark, 1), path, mode="upsert")
    assert refused.value.category == "UnsupportedCapability"
    assert tables.append(numbers(spark), path) == 0
    with pytest.raises(LoadRefused) as refused:
        tables.append(numbers(spark, 1), path)
    assert refused.value.category == "SchemaMismatchError"
    tables.create_table(spark, path, "id bigint, tag string")
    with pytest.raises(LoadRefused, match=r"no column\(s\) \['zeta'\]; known columns: \['id', 'tag'\]"):
        tables.append(numbers(spark, 1).withColumn("zeta", F.lit(1)), path)
    doc = spark.createDataFrame([('{"id":7,"tag":null}',), ('{"id":"x"}',), ("{}",)], "j string").select(F.parse_json("j").alias("v"))
    values = doc.select(F.try_variant_get("v", "$.id", "variant").alias("id"), F.try_variant_get("v", "$.tag", "variant").alias("tag"))
    with pytest.raises(LoadRefused, match=r"1 row\(s\)"):
        tables.append(values, path, "a")
    assert not glob.glob(f"{path}/data/load=*") and tables.history(spark, path).count() == 0
    good = values.where("try_variant_get(id, '$', 'string') IS DISTINCT FROM 'x'")
    assert tables.append(good, path, "a") == 2
    assert sorted(map(tuple, tables.read_table(spark, path).collect()), key=str) == [(7, None), (None, None)]


def test_a_load_computes_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.create_table(spark, path, "id bigint")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).mapInArrow(counted, "id bigint")
    assert tables.append(rows, path, "a") == 1000 and seen.value == 1000
