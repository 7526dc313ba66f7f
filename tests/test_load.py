"""Loads, sinks, sources, streams and whole ingestion runs."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import load
from millrace.plans.ingestion import ingest
from millrace.sources import landed, sinks
from millrace.streaming import pages as stream

MAPPING = {"policy_id": "id", "premium": "premium"}
TYPES = {"policy_id": "string", "premium": "bigint"}
RUN = "run bigint, start_page bigint, page_size bigint, max_pages bigint, cursor string, retain_empty boolean"


def body(*records):
    return json.dumps({"results": list(records)})


def policy(i):
    return {"id": f"P{i}", "premium": i * 100}


# --- destination ---------------------------------------------------------------


def test_tables_are_provisioned_explicitly_and_only_grow(spark, tmp_path):
    path = str(tmp_path / "dest")
    rows_ = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    with pytest.raises(sinks.LoadRefused) as refused:
        sinks.append_load(rows_, path)
    assert refused.value.category == "SchemaMismatchError"
    sinks.provision(spark, path, "id bigint, name string, note string")
    sinks.provision(spark, path, "other int")
    assert sinks.append_load(rows_, path) == 2
    assert sinks.append_load(rows_.select("id"), path) == 2
    got = spark.read.parquet(path)
    assert got.columns == ["id", "name", "note"] and got.count() == 4


def test_refusals(spark, tmp_path):
    path = str(tmp_path / "dest")
    sinks.provision(spark, path, "id bigint")
    bad = spark.createDataFrame([(1, 2, 3)], "id int, zeta int, alpha int")
    with pytest.raises(sinks.LoadRefused) as refused:
        sinks.append_load(bad, path, mode="upsert")
    assert refused.value.category == "UnsupportedCapability"
    with pytest.raises(sinks.LoadRefused, match=r"\['alpha', 'zeta'\]; known columns: \['id'\]"):
        sinks.append_load(bad, path)
    assert sinks.append_load(bad.select("id").limit(0), path) == 0
    assert spark.read.parquet(path).count() == 0


def test_variant_columns_are_cast_to_the_table(spark, tmp_path):
    path = str(tmp_path / "dest")
    sinks.provision(spark, path, "id bigint, tag string")
    doc = spark.createDataFrame([('{"id": 7, "tag": null}',)], "j string").select(F.parse_json("j").alias("v"))
    sinks.append_load(
        doc.select(F.variant_get("v", "$.id", "variant").alias("id"), F.variant_get("v", "$.tag", "variant").alias("tag")), path
    )
    assert tuple(spark.read.parquet(path).first()) == (7, None)


@pytest.mark.parametrize(
    "name, valid",
    [("orders", True), ("_x1", True), ("9a", False), ("a b", False), ("a;--", False), ("", False), (None, False),
     ("a" * 128, True), ("a" * 129, False), ("é", False), ("ok\n", True), ("ok ", False)],
)
def test_identifiers(spark, name, valid):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(load.is_identifier(F.col("n")).alias("ok")).first().ok is valid


def test_five_rows_make_three_batches_of_two(spark, rows):
    df = spark.createDataFrame([(1, 1, i) for i in range(5)], "run int, page int, pos int")
    assert rows(load.load_batches(df, 2), "batch", "batch_rows") == [(0, 2), (1, 2), (2, 1)]


def test_duplicates_are_reported_and_the_first_kept(spark, rows):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), ("m", 3, "only")], "key string, batch int, v string")
    assert rows(load.duplicate_exposure(df, ["key"])) == [("k", 2)]
    assert rows(load.keep_first(df, ["key"], ["batch"]), "key", "v") == [("k", "early"), ("m", "only")]


def test_jdbc_options_bound_batches_and_connections():
    options = sinks.jdbc_options("jdbc:x", "dbo.t", batch_size=2, connections=3)
    assert (options["batchsize"], options["numPartitions"]) == ("2", "3")


# --- landed pages ----------------------------------------------------------------


def land(root, pages):
    for (run, page), text in pages.items():
        folder = root / f"run={run}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"page-{page}.json").write_text(text)


def test_both_readers_see_the_same_pages(spark, tmp_path, rows):
    land(tmp_path, {(1, 1): body(policy(1)), (1, 2): body(), (2, 10): "not json"})
    (tmp_path / "run=1" / "notes.txt").write_text("ignored")
    native = landed.read_landed(spark, str(tmp_path))
    spark.dataSource.register(landed.paged_source("landed_pages"))
    custom = spark.read.format("landed_pages").option("path", str(tmp_path)).option("block", 1).option("groups", 3).option("ways", 2).load()
    columns = ["run", "page", "size_bytes", F.col("body").cast("string")]
    assert rows(native, *columns) == rows(custom, *columns)
    assert custom.rdd.getNumPartitions() == 6
    late = spark.read.format("landed_pages").option("path", str(tmp_path)).option("start", 2).load()
    assert rows(late, "run", "page") == [(1, 2), (2, 10)]


def test_a_hot_run_is_read_by_several_tasks_and_nothing_is_listed_by_the_driver(spark, tmp_path, rows, monkeypatch):
    land(tmp_path, {(7, k): body() for k in range(1, 41)} | {(k, 1): body() for k in range(8, 12)})
    spark.dataSource.register(landed.paged_source("hot_pages"))
    read = spark.read.format("hot_pages").option("path", str(tmp_path)).option("block", 5).option("groups", 2).option("ways", 4)
    monkeypatch.setattr(landed.os, "scandir", None)
    frame = read.load()
    assert frame.rdd.getNumPartitions() == 8
    monkeypatch.undo()
    assert rows(frame, "run", "page") == rows(landed.read_landed(spark, str(tmp_path)), "run", "page")
    per_task = frame.where("run = 7").groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in per_task) == [10, 10, 10, 10]
    empty = tmp_path / "none"
    empty.mkdir()
    assert rows(spark.read.format("hot_pages").option("path", str(empty)).load()) == []


# --- whole runs --------------------------------------------------------------------


COUNTED = ["pages_extracted", "records_extracted", "records_loaded", "raw_payload_count"]


def ingested(spark, pages, strict=False, saved=None, mapping=MAPPING, troubles=None, extra=None, **settings):
    rows = [(r, p, t, *(troubles or {}).get((r, p), (None, None))) for (r, p), t in pages.items()]
    df = spark.createDataFrame(rows, "run bigint, page bigint, body string, fetch_error string, load_error string")
    setting = {"page_size": None, "max_pages": 500, "cursor": saved and saved.last_successful_cursor, **settings}
    counters = [saved[c] if saved else 0 for c in COUNTED]
    runs = spark.createDataFrame(
        [(1, 1, setting["page_size"], setting["max_pages"], setting["cursor"], False, *counters)],
        RUN + "".join(f", {c} bigint" for c in COUNTED),
    )
    result = ingest(df, runs if saved else runs.drop(*COUNTED), "results", mapping, TYPES, strict, **(extra or {}))
    return result, result.states.first()


def test_saved_cursor_survives_a_run_without_a_page(spark):
    _, state = ingested(spark, {(1, 3): body(policy(3)), (1, 4): "not json"}, cursor="4")
    assert (state.status, state.category, state.last_successful_cursor, state.pages_extracted) == (
        "failed", "MalformedResponseError", "4", 0,
    )


def test_nothing_is_read_without_a_mapping(spark):
    result, state = ingested(spark, {(1, 1): body(policy(1))}, mapping={}, cursor="1")
    assert (state.status, state.category, state.last_successful_cursor) == ("failed", "MappingError", "1")
    assert result.raw_records.isEmpty() and result.loaded.isEmpty()


def test_misfit_fails_the_load_and_keeps_the_raw_page(spark, rows):
    pages = {(1, 1): body(policy(1)), (1, 2): body(policy(2), {"id": "P9", "premium": "abc"}), (1, 3): body(policy(3))}
    result, state = ingested(spark, pages)
    assert (state.status, state.category, state.pages_extracted, state.last_successful_cursor) == ("failed", "LoadFailed", 1, "2")
    assert rows(result.raw_records, "sequence", "loaded_successfully") == [(1, True), (2, False)]
    assert rows(result.loaded, "policy_id", "premium") == [("P1", 100)]


def test_fetch_and_load_errors_end_a_run(spark, rows):
    pages = {(1, p): body(policy(p)) for p in range(1, 5)}
    lost, state = ingested(spark, pages, troubles={(1, 3): ("FetchFailed", None)})
    assert (state.category, state.pages_extracted, lost.raw_records.count()) == ("FetchFailed", 2, 2)
    refused, state = ingested(spark, pages, troubles={(1, 3): (None, "LoadFailed")})
    assert (state.category, state.pages_extracted, refused.raw_records.count(), refused.loaded.count()) == ("LoadFailed", 2, 3, 2)


def test_both_ways_of_joining_give_the_same(spark, rows):
    pages = {(1, p): body(policy(p), policy(10 + p)) for p in range(1, 6)}
    few, _ = ingested(spark, pages, max_pages=4)
    many, _ = ingested(spark, pages, max_pages=4, extra={"broadcast_rows": 0})
    for one, other in ((few.states, many.states), (few.raw_records, many.raw_records), (few.loaded, many.loaded)):
        assert rows(one, *sorted(one.columns)) == rows(other, *sorted(one.columns))


def test_pages_are_cut_before_they_are_parsed(spark):
    pages = spark.createDataFrame([(1, 1, body(policy(1)))], "run bigint, page bigint, body string")
    runs = spark.createDataFrame([(1, 1, None, 5, "1", False)], RUN)
    result = ingest(pages, runs, "results", MAPPING, TYPES)
    plan = result.loaded._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    assert plan.index("parsejson") < plan.index("join")


def test_short_last_page_succeeds_and_leaves_its_own_cursor(spark, rows):
    result, state = ingested(spark, {(1, 1): body(policy(1), policy(2)), (1, 2): body(policy(3))}, page_size=2)
    assert (state.status, state.pages_extracted, state.records_loaded, state.last_successful_cursor) == ("succeeded", 2, 3, "2")
    assert rows(result.loaded, "policy_id", "premium") == [("P1", 100), ("P2", 200), ("P3", 300)]
    assert rows(result.raw_records, "sequence", "item_count", "loaded_successfully") == [(1, 2, True), (2, 1, True)]


def test_page_limit_keeps_its_pages_and_the_next_cursor(spark):
    pages = {(1, p): body(policy(p)) for p in range(1, 6)}
    result, state = ingested(spark, pages, max_pages=3)
    assert (state.status, state.category) == ("failed", "PageLimitExceededError")
    assert (state.pages_extracted, state.last_successful_cursor, result.loaded.count()) == (3, "4", 3)
    again, resumed = ingested(spark, {**pages, (1, 6): body()}, saved=state)
    assert (resumed.status, resumed.pages_extracted, resumed.records_extracted) == ("succeeded", 5, 5)
    assert sorted(r.sequence for r in again.raw_records.collect()) == [4, 5]


def test_malformed_page_stores_nothing(spark):
    result, state = ingested(spark, {(1, 1): body(policy(1)), (1, 2): "not json", (1, 3): body(policy(3))})
    assert (state.category, result.raw_records.count(), result.loaded.count()) == ("MalformedResponseError", 1, 1)


def test_mapping_failure_keeps_the_raw_page_unloaded(spark, rows):
    pages = {(1, 1): body(policy(1)), (1, 2): body(policy(2), {"id": "P9"}), (1, 3): body(policy(3))}
    result, state = ingested(spark, pages, strict=True)
    assert (state.status, state.category, state.pages_extracted) == ("failed", "MappingError", 1)
    assert rows(result.raw_records, "sequence", "loaded_successfully") == [(1, True), (2, False)]
    assert rows(result.loaded, "policy_id") == [("P1",)]
    loose, _ = ingested(spark, {**pages, (1, 4): body()})
    assert loose.loaded.where("premium IS NULL").count() == 1


# --- streams -----------------------------------------------------------------------

PAGES = "run bigint, page bigint, body string"


def land_table(spark, path, pages):
    df = spark.createDataFrame(pages, PAGES)
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def stream_runs(spark, **settings):
    setting = {"page_size": None, "max_pages": 500, **settings}
    return spark.createDataFrame([(1, 1, setting["page_size"], setting["max_pages"], None, False)], RUN)


def test_stream_equals_batch_and_resumes(spark, tmp_path, rows):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    schema = land_table(spark, landing, [(1, p, body(policy(p))) for p in (1, 2, 4)])

    def run():
        handler = stream.ingest_batches(f"{out}/raw", f"{out}/loaded", "results", MAPPING, TYPES, stream_runs(spark))
        stream.drain(stream.file_stream(spark, landing, schema, 1), handler, f"{out}/progress")

    run()
    # Page 4 waits for page 3.
    assert rows(spark.read.parquet(f"{out}/loaded/rows"), "page") == [(1,), (2,)]
    land_table(spark, landing, [(1, 2, body(policy(2))), (1, 3, body(policy(3)))])
    run()
    run()
    facts, loaded = spark.read.parquet(f"{out}/raw/facts"), spark.read.parquet(f"{out}/loaded/rows")
    assert rows(stream.stored_pages(facts), "page", "n") == [(1, 1), (2, 1), (3, 1), (4, 1)]
    # Page 2 was delivered twice, stored once and loaded once.
    assert facts.count() == 4 and rows(loaded, "policy_id") == [("P1",), ("P2",), ("P3",), ("P4",)]
    state = stream.newest_updates(spark.read.parquet(f"{out}/loaded/states"), ["run"]).first()
    assert (state.status, state.pages_extracted, state.last_successful_cursor) == ("incomplete", 4, "5")


def test_stream_loads_nothing_beyond_an_error(spark, tmp_path, rows):
    out = str(tmp_path)
    handle = stream.ingest_batches(f"{out}/raw", f"{out}/loaded", "results", MAPPING, TYPES, stream_runs(spark))
    handle(spark.createDataFrame([(1, 1, body(policy(1))), (1, 3, body(policy(3)))], PAGES), 0)
    handle(spark.createDataFrame([(1, 2, body(policy(2), "no object"))], PAGES), 1)
    assert rows(spark.read.parquet(f"{out}/loaded/rows"), "page") == [(1,)]
    state = stream.newest_updates(spark.read.parquet(f"{out}/loaded/states"), ["run"]).first()
    assert (state.status, state.category, state.pages_extracted) == ("failed", "MappingError", 1)


def test_replayed_batch_replaces_what_it_wrote(spark, tmp_path):
    handle = stream.ingest_batches(str(tmp_path / "raw"), str(tmp_path / "loaded"), "results", MAPPING, TYPES, stream_runs(spark))
    batch = spark.createDataFrame([(1, 1, body(policy(1), policy(2)))], PAGES)
    handle(batch, 0)
    handle(batch, 0)
    assert spark.read.parquet(str(tmp_path / "loaded" / "rows")).count() == 2
    assert spark.read.parquet(str(tmp_path / "raw" / "bodies")).count() == 1


def test_failed_batch_is_repeated_under_its_number(spark, tmp_path):
    landing = str(tmp_path / "landing")
    schema = land_table(spark, landing, [(1, 1, body(policy(1)))])
    seen = []

    def failing(pages, batch_id):
        seen.append(batch_id)
        if len(seen) == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream.drain(stream.file_stream(spark, landing, schema), failing, str(tmp_path / "progress"))
    stream.drain(stream.file_stream(spark, landing, schema), failing, str(tmp_path / "progress"))
    assert seen == [0, 0]

