"""What a stream reads in each batch, and what its merged state holds."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.plans.ingestion import ingest
from millrace.streaming import pages as stream
from millrace.streaming.state import PageState, folded

MAPPING, TYPES = {"id": "id"}, {"id": "bigint"}
PAGES = "run bigint, page bigint, body string"
RUN = "run bigint, config_id bigint, start_page bigint, page_size bigint, max_pages bigint, cursor string, retain_empty boolean, tenant_uuid string, pages_extracted bigint"


def body(*ids):
    return json.dumps({"results": [{"id": i} for i in ids]})


def all_runs(spark, n=40):
    return spark.createDataFrame([(k, k % 3, 1, None, 500, None, False, "t" if k % 2 else None, 0) for k in range(n)], RUN)


def size(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True))


class Watched(PageState):
    """A state that notes the bytes of the folders it reads for a batch."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.bytes, self.folders = {}, {}

    def read(self, spark, buckets, before):
        parts = [p for b in buckets or [] for p in self._parts(spark, b, before)]
        self.bytes[before] = sum(map(size, parts))
        self.folders[before] = len(parts)
        return super().read(spark, buckets, before)


def handler(spark, out, state=None):
    return stream.ingest_batches(f"{out}/raw", f"{out}/loaded", "results", MAPPING, TYPES, all_runs(spark), state=state)


def test_batches_of_new_runs_read_nothing_of_older_ones(spark, tmp_path):
    state = Watched(f"{tmp_path}/state", runs=1)
    handle = handler(spark, tmp_path, state)
    for k in range(4):  # two batches a run, the second needs what the first left
        first, run = k % 2 == 0, k // 2
        handle(spark.createDataFrame([(run, 2 if first else 1, body(10 * run + k % 2)), (run, 3 if first else 4, body(k))], PAGES), k)
    assert state.bytes[0] == state.bytes[2] == 0
    assert state.folders[1] == state.folders[3] == 1
    assert 0 < state.bytes[3] < 1.2 * state.bytes[1]  # like rows don't compress to the same byte
    assert spark.read.parquet(f"{tmp_path}/loaded/rows").count() == 8


def test_a_long_run_is_merged(spark, tmp_path):
    state = Watched(f"{tmp_path}/state", merged=2)
    handle = handler(spark, tmp_path, state)
    for k in range(7):
        handle(spark.createDataFrame([(1, k + 1, body(k))], PAGES), k)
        if k == 4:
            handle(spark.createDataFrame([(1, k + 1, body(k))], PAGES), k)  # replayed
    assert max(state.folders.values()) <= 3
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/loaded/rows").collect()) == list(range(7))
    left = state.read(spark, [0], 7).orderBy("page").collect()
    assert [(r.page, r.batch, r.loaded) for r in left] == [(k + 1, k, k) for k in range(7)]
    assert len(glob.glob(f"{tmp_path}/state/deltas/bucket=0/at=*")) < 7


def test_many_buckets_are_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("millrace.streaming.state.NAMED", 1)
    handle = handler(spark, tmp_path, PageState(f"{tmp_path}/state", runs=1))
    handle(spark.createDataFrame([(k, 2, body(k)) for k in range(4)], PAGES), 0)
    handle(spark.createDataFrame([(k, 1, body(10 + k)) for k in range(4)], PAGES), 1)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/loaded/rows").collect()) == [0, 1, 2, 3, 10, 11, 12, 13]


def test_folding_keeps_first_batch_and_loading(spark):
    schema = "run bigint, page bigint, checksum_sha256 string, n bigint, size_bytes bigint, error string, batch bigint, loaded bigint"
    rows = [(1, 1, "a", 2, 9, None, 3, None), (1, 1, "a", 2, 9, None, 3, 5), (1, 1, "b", 1, 8, "E", 4, None)]
    got = sorted(tuple(r) for r in folded(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1, "a", 2, 9, None, 3, 5), (1, 1, "b", 1, 8, "E", 4, None)]


@pytest.mark.parametrize("seed", [1])
def test_any_dealing_of_pages_to_batches_loads_what_a_batch_loads(spark, tmp_path, seed):
    rng = random.Random(seed)
    pages = [(run, n, rng.choice([body(run, n), body(n), "{", body()]) if rng.random() < 0.2 else body(100 * run + n)) for run in range(5) for n in range(1, 7)]
    pages = [p for p in pages if rng.random() < 0.95]
    landed = pages + rng.sample(pages, 6)
    rng.shuffle(landed)
    handle = handler(spark, tmp_path, PageState(f"{tmp_path}/state", runs=2, merged=2))
    for k in range(0, len(landed), 9):
        handle(spark.createDataFrame(landed[k : k + 9], PAGES), k // 9)
    alone = ingest(spark.createDataFrame(pages, PAGES), all_runs(spark, 5), "results", MAPPING, TYPES)
    read = spark.read.parquet
    assert sorted(map(str, read(f"{tmp_path}/loaded/rows").drop("batch").select("run", "page", "pos", "id").collect())) == sorted(
        map(str, alone.loaded.select("run", "page", "pos", "id").collect())
    )
    states = {r.run: r for r in stream.newest_updates(read(f"{tmp_path}/loaded/states"), ["run"]).collect()}
    for r in alone.states.collect():
        if r.run in states:
            assert (states[r.run].status, states[r.run].records_loaded, states[r.run].last_successful_cursor) == (r.status, r.records_loaded, r.last_successful_cursor)
    addresses = {(r.run, r.page): (r.sequence, r.storage_uri) for r in read(f"{tmp_path}/raw/facts").collect()}
    for r in alone.raw_records.collect():
        assert addresses[r.run, r.page] == (r.sequence, r.storage_uri)
    assert read(f"{tmp_path}/raw/bodies").count() == len(pages) == read(f"{tmp_path}/raw/facts").where(F.col("size_bytes") > 0).count()
