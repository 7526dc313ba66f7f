"""Run state: claims, attempts, continuations, requests, jobs, access."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.outcomes import backoff_seconds, jittered_backoff_seconds
from millrace.operators import access, dispatch, jobs, runs

EVENT = "run bigint, seq bigint, kind string, task string"


def fold(events):
    """The claim rules, one event after another."""
    status, owner, attempt, out = "pending", None, 0, []
    for seq, kind, task in events:
        if kind == "claim":
            if status == "settled":
                out.append((seq, False, None, "finished"))
            elif status == "running" and owner != task:
                out.append((seq, False, None, "owned by another task"))
            else:
                status, owner, attempt = "running", task, attempt + 1
                out.append((seq, True, attempt, None))
        elif status == "running":
            status = "settled"
        else:
            out.append((seq, "invalid", status, None))
    return out


def test_random_claims_match_the_fold(spark):
    rng = random.Random(3)
    events, want = [], []
    for run in range(300):
        log = []
        for seq in range(rng.randint(1, 9)):
            kind = rng.choice(["claim", "claim", "claim", "succeed", "fail"])
            log.append((seq, kind, rng.choice(["t1", "t2", None]) if kind == "claim" else None))
        events += [(run, *e) for e in log]
        want += [(run, *o) for o in fold(log)]
    df = spark.createDataFrame(events, EVENT)
    claims = [(r.run, r.seq, r.accepted, r.attempt, r.reason) for r in runs.claim_outcomes(df).collect()]
    invalid = [(r.run, r.seq, "invalid", r.from_status, None) for r in runs.invalid_transitions(df).collect()]
    assert sorted(claims + invalid, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_unknown_run_cannot_be_claimed(spark):
    df = spark.createDataFrame([(1, 0, "claim", "a"), (2, 0, "claim", "a")], EVENT)
    got = runs.claim_outcomes(df, spark.createDataFrame([(1,)], "run bigint")).orderBy("run").collect()
    assert [(r.accepted, r.reason) for r in got] == [(True, None), (False, "not found")]


def test_counters_and_cursor(spark):
    pages = spark.createDataFrame(
        [(1, 1, 2, 2, "1", "2"), (1, 2, 1, 1, "2", None), (2, 3, 1, 1, "3", "4")],
        "run bigint, page bigint, n bigint, loaded bigint, cursor_used string, next_cursor string",
    )
    got = runs.run_counters(pages).orderBy("run").collect()
    assert [tuple(r)[1:] for r in got] == [(2, 3, 3, 2, "2"), (1, 1, 1, 1, "4")]


def test_attempts_end_with_the_settling_one(spark, rows):
    log = [(1, a, "FetchFailed", True) for a in range(1, 8)]
    log += [(2, 1, "FetchFailed", True), (2, 2, None, None), (2, 3, "FetchFailed", True)]
    log += [(3, 1, "MappingError", False), (3, 2, None, None)]
    df = spark.createDataFrame(log, "run int, attempt int, category string, retryable boolean")
    history = runs.attempt_history(df)
    assert rows(history.groupBy("run").agg(F.count("*"))) == [(1, 5), (2, 2), (3, 1)]
    assert rows(runs.latest_attempts(history), "run", "status") == [
        (1, "failed"), (2, "succeeded"), (3, "failed"),
    ]
    assert history.where("run = 1 AND attempt = 2").first().status == "running"


def test_backoff_doubles_to_the_cap_and_jitters_within_a_quarter(spark):
    retry = F.col("id").cast("int")
    got = spark.range(8).select(backoff_seconds(retry).alias("b"), jittered_backoff_seconds(retry, F.lit(9)).alias("j"))
    rows_ = got.collect()
    assert [r.b for r in rows_] == [10, 20, 40, 80, 160, 300, 300, 300]
    assert all(r.b <= r.j <= 1.25 * r.b for r in rows_)


RUNS = (
    "run_id bigint, config_id bigint, status string, error_category string, continued_from bigint,"
    " last_successful_cursor string, pages_extracted bigint, records_extracted bigint,"
    " records_loaded bigint, raw_payload_count bigint"
)
LIMIT = "PageLimitExceededError"


def history(spark, *items):
    return spark.createDataFrame([(*i, "4", 3, 3, 3, 3) for i in items], RUNS)


def test_only_page_limit_failures_continue_and_only_once(spark, rows):
    df = history(
        spark, (1, 1, "failed", LIMIT, None), (2, 1, "failed", "FetchFailed", None),
        (3, 1, "succeeded", None, None), (4, 1, "failed", LIMIT, None), (5, 1, "pending", None, 4),
    )
    assert rows(runs.continuable_runs(df), "run_id") == [(1,), (4,)]
    assert rows(runs.open_continuations(df), "run_id") == [(1,)]
    seed = runs.continuation_seeds(df).orderBy("continued_from").first()
    assert (seed.last_successful_cursor, seed.pages_extracted, seed.attempt, seed.status) == ("4", 3, 0, "pending")


def test_lineage_of_long_chains_and_hot_roots(spark):
    chain = [(i, 1, "failed", LIMIT, i - 1 if i else None) for i in range(150)]
    fans = [(1000 + i, 1, "pending", None, 0) for i in range(50)]
    got = {r.run_id: (r.root_run, r.depth) for r in runs.continuation_lineage(history(spark, *chain, *fans)).collect()}
    assert got[149] == (0, 149) and got[0] == (0, 0) and got[1049] == (0, 1)
    assert len(got) == 200


def requested(spark, items, claimed=()):
    req = spark.createDataFrame(
        items, "request_id bigint, config_id bigint, is_active boolean, idempotency_key string, continue_from bigint"
    )
    known = history(spark, (100, 1, "failed", LIMIT, None), (101, 1, "failed", "FetchFailed", None))
    claims = spark.createDataFrame(list(claimed), "request_id bigint, claimed_order bigint")
    got = dispatch.trigger_outcomes(req, known, claims).orderBy("request_id").collect()
    return [(r.outcome, r.created_by, r.dispatched, r.problem) for r in got]


def test_requests_with_a_key_create_once(spark):
    got = requested(
        spark,
        [(1, 1, True, "k", None), (2, 1, True, "k", None), (5, 1, True, "k", None), (6, 2, True, "k", None),
         (7, 1, True, None, None), (8, 1, True, "", None)],
        claimed=[(1, 4)],
    )
    assert got == [
        ("created", 1, True, None), ("reused", 1, True, None), ("reused", 1, False, None),
        ("refused", None, False, "key of another configuration"), ("created", 7, True, None), ("created", 8, True, None),
    ]


def test_refused_requests_do_not_take_the_key(spark):
    got = requested(
        spark,
        [(1, 1, False, "k", None), (2, 2, True, "k", 100), (3, 1, True, "k", 101), (4, 1, True, "k", 999),
         (5, 1, True, "k", 100)],
    )
    assert [g[3] for g in got] == ["inactive", "other configuration", "not continuable", "unknown run", None]
    assert got[-1][:3] == ("created", 5, True)


T0 = dt.datetime(2024, 1, 1)


def job_table(spark, *items):
    rows_ = [(i, org, status, T0, T0 - dt.timedelta(minutes=age)) for i, (org, status, age) in enumerate(items)]
    return spark.createDataFrame(
        rows_, "job_id bigint, org_id bigint, status string, created_at timestamp_ntz, updated_at timestamp_ntz"
    )


def test_job_actions(spark):
    df = job_table(
        spark, (1, "running", 15), (2, "running", 16), (3, "pending", 99), (4, "failed", 1),
        (5, "failed", 1), (5, "pending", 1), (6, "running", 20), (6, "running", 20),
    )
    as_of = F.lit(T0).cast("timestamp_ntz")
    got = jobs.job_actions(df, as_of).orderBy("job_id").collect()
    assert [(r.stale, r.retry, r.cancel) for r in got] == [
        (False, "refused", "requested"), (True, "cancelled, new", "requested"), (False, "existing", "requested"),
        (False, "new", "refused"), (False, "existing", "refused"), (False, "existing", "requested"),
        (True, "cancelled, existing", "requested"), (True, "cancelled, existing", "requested"),
    ]


def test_active_job_is_shown_before_a_newer_finished_one(spark, rows):
    df = job_table(spark, (1, "pending", 0), (1, "succeeded", 0), (2, "failed", 0), (2, "succeeded", 0))
    assert rows(jobs.shown_jobs(df), "org_id", "job_id") == [(1, 0), (2, 3)]


@pytest.mark.parametrize(
    "role, staff, want",
    [("owner", False, (True, True, True, False)), ("engineer", False, (True, True, False, False)),
     ("analyst", False, (True, False, False, False)), (None, False, (False, False, False, False)),
     (None, True, (True, True, True, True))],
)
def test_roles(spark, role, staff, want):
    df = spark.createDataFrame([(role, staff)], "role string, is_staff boolean")
    assert tuple(access.role_access(df).first())[2:] == want


def test_organizations_of_one_user(spark, rows):
    orgs = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "org_id int, name string")
    members = spark.createDataFrame([(9, 1, "admin"), (9, 2, "analyst"), (8, 3, "owner")], "user_id int, org_id int, role string")
    assert rows(access.organizations_of(orgs, members, 9, False), "name") == [("b",)]
    assert [r.name for r in access.organizations_of(orgs, members, 9, True).collect()] == ["a", "b", "c"]


def test_identifiers_are_filled_once_and_unique(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.lit("kept")).alias("u"))
    first = access.fill_identifiers(df, "u", ["id"], "ns").cache()
    assert first.where("id % 2 = 1").select("u").distinct().count() == 1000
    assert first.where("u = 'kept'").count() == 1000
    assert first.where("id % 2 = 1 AND u RLIKE '^[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'").count() == 1000
    assert first.exceptAll(access.fill_identifiers(df.repartition(7), "u", ["id"], "ns")).count() == 0
