"""Repeated pages, and runs of pipelines with settings of their own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.paths import literal_path, lookup, lookup_at
from millrace.operators.paging import first_versions, scan_outcomes
from millrace.plans.ingestion import destination_rows, ingest, ingest_pipelines

RUN = "run bigint, config_id bigint, start_page bigint, page_size bigint, max_pages bigint, cursor string, retain_empty boolean"
LANDED = "run bigint, page bigint, body string, arrival bigint"
PIPELINE = "config_id bigint, records_path string, mapping map<string,string>, types map<string,string>, strict boolean"


def page(*ids, key="rows"):
    return json.dumps({key: [{"id": i, "who": {"name": f"n{i}"}, "amount": i} for i in ids]})


def one_run(spark, number=1, page_size=2):
    return spark.createDataFrame([(number, 1, 1, page_size, 50, None, False)], RUN)


def read(spark, pages, runs=None, **more):
    landed = spark.createDataFrame(pages, LANDED)
    return ingest(landed, runs or one_run(spark), "rows", {"id": "id"}, {"id": "bigint"}, **more)


def state(result):
    return result.states.first().asDict()


@pytest.mark.parametrize("limit", [500_000, 0])
def test_a_repeat_counts_once(spark, limit):
    pages = [(1, 1, page(1, 2), 0), (1, 1, page(1, 2), 1), (1, 2, page(3), 2), (1, 1, page(1, 2), 3)]
    got = read(spark, pages, broadcast_rows=limit)
    assert state(got)["status"] == "succeeded" and state(got)["pages_extracted"] == 2 and state(got)["records_loaded"] == 3
    assert sorted(r.id for r in got.loaded.collect()) == [1, 2, 3]
    assert sorted(r.sequence for r in got.raw_records.collect()) == [1, 2]


def test_a_repeat_hides_no_missing_page(spark):
    got = read(spark, [(1, 1, page(1, 2), 0), (1, 1, page(1, 2), 1), (1, 3, page(5), 2)])
    assert state(got)["status"] == "incomplete" and state(got)["last_successful_cursor"] == "2"
    assert sorted(r.id for r in got.loaded.collect()) == [1, 2]
    thin = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (1, 4, 2), (1, 4, 2)], "run bigint, page bigint, n bigint")
    assert scan_outcomes(thin, one_run(spark)).first().outcome == "incomplete"


def test_the_first_version_counts(spark):
    pages = [(1, 1, page(7, 8), 5), (1, 1, "{broken", 9), (1, 2, "{broken", 1), (1, 2, page(9), 2)]
    got = read(spark, pages)
    assert state(got)["category"] == "MalformedResponseError" and sorted(r.id for r in got.loaded.collect()) == [7, 8]


def test_without_arrival_the_smallest_checksum_counts(spark):
    landed = spark.createDataFrame([(1, 1, page(1)), (1, 1, page(2)), (1, 1, page(1))], "run bigint, page bigint, body string")
    got = ingest(landed, one_run(spark), "rows", {"id": "id"}, {"id": "bigint"})
    chosen = min((F_sum(page(k)), k) for k in (1, 2))[1]
    assert [r.id for r in got.loaded.collect()] == [chosen] and got.raw_records.count() == 1


def F_sum(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_first_versions_takes_each_column_from_one_row(spark):
    rows = spark.createDataFrame([(1, 1, 3, "x", None), (1, 1, 2, "y", "E"), (1, 2, 9, "z", None)], "run int, page int, arrival int, checksum_sha256 string, error string")
    got = sorted(tuple(r) for r in first_versions(rows).select("page", "arrival", "checksum_sha256", "error", "copies").collect())
    assert got == [(1, 2, "y", "E", 2), (2, 9, "z", None, 1)]


# --- settings in rows ------------------------------------------------------------------


@pytest.mark.parametrize("path", ["a", "a.b", "a.x?y", "a.it's", "a..b", "", "a.b.c", "l", "l.0", 'q"q'])
def test_paths_in_columns_are_paths(spark, path):
    docs = ['{"a":{"b":1,"x?y":null,"it\'s":2,"":{"b":3}},"l":[1],"":4,"q\\"q":5}', '{"a":null}', "[1]", "3", "{}", None]
    rows = spark.createDataFrame([(k, d, path) for k, d in enumerate(docs)], "k int, d string, p string").select(
        "k", F.try_parse_json("d").alias("v"), "p"
    )
    told = rows.select(
        "k", F.to_json(lookup(F.col("v"), path)).alias("want"),
        F.to_json(lookup_at(F.col("v"), literal_path(F.col("p")), F.split("p", r"\."))).alias("got"),
    )
    assert all(r.want == r.got for r in told.collect())


PIPELINES = [
    (1, "rows", {"id": "id", "name": "who.name"}, {"id": "bigint"}, False),
    (2, "data", {"number": "id", "paid": "amount"}, {"number": "bigint", "paid": "boolean"}, False),
    (3, "rows", {"id": "id", "extra": "extra"}, {}, True),
    (4, "rows", {}, {}, False),
    (5, None, {"id": "id"}, None, False),
    (6, "rows", None, None, None),
]


def mixed_landing(seed=3):
    rng = random.Random(seed)
    bodies = [lambda: page(*range(rng.randrange(3))), lambda: page(1, 2, key="data"), lambda: "[]", lambda: "{", lambda: '[{"id":1,"extra":null,"amount":"x"},{"id":"y","extra":2}]', lambda: "[3]"]
    pages = [(run, n, rng.choice(bodies)(), n) for run in range(1, 29) for n in range(1, rng.randrange(2, 7)) if rng.random() < 0.95]
    runs = [(run, run % 7 + 1, 1, rng.choice([None, 2]), rng.choice([2, 50]), None, run % 2 == 0) for run in range(1, 29)]
    return pages, runs


def test_mixed_pipelines_run_as_each_alone(spark):
    pages, runs = mixed_landing()
    landed, all_runs = spark.createDataFrame(pages, LANDED), spark.createDataFrame(runs, RUN)
    got = ingest_pipelines(landed, all_runs, spark.createDataFrame(PIPELINES, PIPELINE))
    states = {r.run: r for r in got.states.collect()}
    # A list on top is the records whatever the path, also where a pipeline names none.
    listed = [run for run, config, *_ in runs if config <= 3]
    raw = sorted(tuple(r) for r in got.raw_records.drop("logical_key").collect() if r.run in listed)
    want_raw, seen = [], set()
    for config, path, mapping, types, strict in PIPELINES:
        if path is None or not mapping:
            continue
        own = all_runs.where(F.col("config_id") == config)
        alone = ingest(landed, own, path, mapping, types, strict)
        for r in alone.states.collect():
            assert tuple(states[r.run]) == tuple(r)
            seen.add(r.status)
        want_raw += [tuple(r) for r in alone.raw_records.drop("logical_key").collect()]
        want = sorted(map(str, alone.loaded.select("run", "page", "pos", *[F.col(c) for c in types]).collect()))
        assert sorted(map(str, destination_rows(got.loaded, config, types).collect())) == want
    assert raw == sorted(want_raw) and seen >= {"succeeded", "failed"}
    for run, config, *_ in runs:
        if config in (4, 6, 7):  # no mapping, or no such pipeline
            assert (states[run].status, states[run].category) == ("failed", "MappingError")


def test_unknown_types_are_refused(spark):
    pages, runs = mixed_landing()
    bad = spark.createDataFrame([(1, "rows", {"id": "id"}, {"id": "money"}, False)], PIPELINE)
    with pytest.raises(Exception, match="types must be of"):
        ingest_pipelines(spark.createDataFrame(pages, LANDED), spark.createDataFrame(runs, RUN), bad).states.collect()


def test_pipelines_share_one_plan(spark):
    from millrace.plans import ingestion

    pages, runs = mixed_landing()
    got = ingest_pipelines(spark.createDataFrame(pages, LANDED), spark.createDataFrame(runs, RUN), spark.createDataFrame(PIPELINES, PIPELINE))
    plan = got.loaded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") <= 2 and "CartesianProduct" not in plan and ingestion.RULE_COLUMNS
