"""Queries over runs: counters, claims, attempts, continuations, requests."""

from pyspark.sql import functions as F

from millrace.functions.outcomes import backoff_seconds, jittered_backoff_seconds
from millrace.operators import dispatch, paging, runs
from millrace.plans.fixtures import fixture, table
from millrace.plans.registry import query
from millrace.plans.scan_queries import FULL_ENDING
from millrace.schemas import BACKOFF_JITTER

# Pages processed by whole runs: everything visited up to the last good page.
_PROCESSED = (
    FULL_ENDING
    + """, processed AS (
  SELECT v.run, v.page, v.n, v.n - v.page % 2 * (CASE WHEN v.n > 0 THEN 1 ELSE 0 END) AS loaded, e.start,
         CAST(v.page AS VARCHAR) AS cursor_used,
         CASE WHEN NOT v.ends THEN CAST(v.page + 1 AS VARCHAR) END AS next_cursor
  FROM visited v JOIN ending e ON e.run = v.run AND v.page <= e.last_page)
"""
)


def _processed(spark, sf_dir):
    pages = fixture(spark, sf_dir, "page_log")
    outcomes = paging.scan_outcomes(pages, fixture(spark, sf_dir, "run_config"))
    kept = paging.kept_pages(pages, outcomes)
    short = F.when(F.col("n") > 0, F.col("page") % 2).otherwise(0)
    return kept.withColumn("loaded", F.col("n") - short)


@query(
    "run_counters",
    _PROCESSED
    + """SELECT run, count(*) AS pages_extracted, CAST(sum(n) AS BIGINT) AS records_extracted,
                CAST(sum(loaded) AS BIGINT) AS records_loaded, count(*) AS raw_payload_count,
                max_by(coalesce(nullif(next_cursor, ''), cursor_used), page) AS last_successful_cursor
         FROM processed GROUP BY run""",
)
def run_counters(spark, sf_dir):
    return runs.run_counters(_processed(spark, sf_dir))


@query(
    "run_progress",
    """SELECT run, page, count(*) OVER w AS pages_extracted, CAST(sum(n) OVER w AS BIGINT) AS records_extracted,
              CAST(sum(n - page % 2) OVER w AS BIGINT) AS records_loaded
       FROM page_log WINDOW w AS (PARTITION BY run ORDER BY page)""",
)
def run_progress(spark, sf_dir):
    pages = fixture(spark, sf_dir, "page_log").withColumn("loaded", F.col("n") - F.col("page") % 2)
    return runs.run_progress(pages).select(
        "run", "page", "pages_extracted", "records_extracted", "records_loaded"
    )


@query(
    "saved_cursor",
    _PROCESSED
    + """SELECT run, coalesce(nullif(next_cursor, ''), cursor_used) AS cursor FROM processed
         QUALIFY row_number() OVER (PARTITION BY run ORDER BY page DESC) = 1""",
)
def saved_cursor(spark, sf_dir):
    return runs.run_counters(_processed(spark, sf_dir)).select(
        "run", F.col("last_successful_cursor").alias("cursor")
    )


@query(
    "sequence_continuation",
    _PROCESSED
    + """SELECT run, page, run % 10 + row_number() OVER (PARTITION BY run ORDER BY page) AS sequence
         FROM processed""",
)
def sequence_continuation(spark, sf_dir):
    pages = fixture(spark, sf_dir, "page_log")
    outcomes = paging.scan_outcomes(pages, fixture(spark, sf_dir, "run_config"))
    seeds = outcomes.select("run", "start", (F.col("run") % 10).alias("pages_extracted"))
    return runs.number_pages(paging.kept_pages(pages, outcomes), seeds).select(
        "run", "page", "sequence"
    )


@query(
    "raw_not_loaded",
    """SELECT run, sequence, count(*) AS versions FROM deliveries d
       WHERE NOT EXISTS (SELECT 1 FROM deliveries l WHERE l.run = d.run AND l.sequence = d.sequence
                         AND l.arrival % 6 = 1)
       GROUP BY run, sequence""",
)
def raw_not_loaded(spark, sf_dir):
    raw = fixture(spark, sf_dir, "deliveries").select("run", "sequence", "arrival")
    missing = runs.raw_not_loaded(raw, raw.where("arrival % 6 = 1"))
    return missing.groupBy("run", "sequence").agg(F.count(F.lit(1)).alias("versions"))


_CLAIMS = """
WITH firsts AS (SELECT run, min(seq) FILTER (kind = 'claim') AS first_claim FROM claim_events GROUP BY run),
bounds AS (
  SELECT f.run, f.first_claim, (SELECT task FROM claim_events c WHERE c.run = f.run AND c.seq = f.first_claim) AS owner,
         (SELECT min(seq) FROM claim_events c WHERE c.run = f.run AND c.kind <> 'claim' AND c.seq > f.first_claim)
           AS settled_by
  FROM firsts f)
"""


@query(
    "claim_outcomes",
    _CLAIMS
    + """, judged AS (
           SELECT c.run, c.seq, c.task, b.first_claim = c.seq AS starts_run,
                  CASE WHEN c.run % 50 = 7 THEN 'not found' WHEN b.settled_by < c.seq THEN 'finished'
                       WHEN c.task IS DISTINCT FROM b.owner THEN 'owned by another task' END AS reason
           FROM claim_events c JOIN bounds b ON b.run = c.run WHERE c.kind = 'claim')
         SELECT run, seq, task, reason IS NULL AS accepted,
                CAST(CASE WHEN reason IS NULL THEN count(*) FILTER (reason IS NULL)
                     OVER (PARTITION BY run ORDER BY seq) END AS BIGINT) AS attempt, starts_run, reason
         FROM judged""",
)
def claim_outcomes(spark, sf_dir):
    events = fixture(spark, sf_dir, "claim_events")
    known = events.where("run % 50 <> 7").select("run")
    return runs.claim_outcomes(events, known)


@query(
    "invalid_transitions",
    _CLAIMS
    + """SELECT c.run, c.seq, c.kind, CASE WHEN b.settled_by < c.seq THEN 'settled' ELSE 'pending' END AS from_status,
                'InvalidRunTransition' AS category
         FROM claim_events c JOIN bounds b ON b.run = c.run
         WHERE c.kind <> 'claim' AND c.seq IS DISTINCT FROM b.settled_by""",
)
def invalid_transitions(spark, sf_dir):
    return runs.invalid_transitions(fixture(spark, sf_dir, "claim_events"))


_DECIDED = """
WITH decided AS (
  SELECT *, CASE WHEN category IS NULL THEN 'succeed' WHEN attempt >= 5 OR NOT retryable THEN 'fail'
                 ELSE 'retry' END AS decision FROM attempt_log)
"""


@query("retry_decision", _DECIDED + "SELECT run, attempt, decision FROM decided")
def retry_decision(spark, sf_dir):
    return runs.retry_decisions(fixture(spark, sf_dir, "attempt_log")).select(
        "run", "attempt", "decision"
    )


_HISTORY = (
    _DECIDED
    + """, happened AS (
  SELECT run, attempt, category, started_at,
         CASE decision WHEN 'succeed' THEN 'succeeded' WHEN 'fail' THEN 'failed' ELSE 'running' END AS status,
         decision <> 'retry' AS has_finish
  FROM (SELECT *, coalesce(sum(CASE WHEN decision <> 'retry' THEN 1 ELSE 0 END) OVER (PARTITION BY run
               ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS settled FROM decided) t
  WHERE settled = 0)
"""
)


@query(
    "attempt_history",
    _HISTORY + "SELECT run, attempt, category, started_at, status, has_finish FROM happened",
)
def attempt_history(spark, sf_dir):
    return runs.attempt_history(fixture(spark, sf_dir, "attempt_log")).select(
        "run", "attempt", "category", "started_at", "status", "has_finish"
    )


@query(
    "latest_attempts",
    _HISTORY
    + """SELECT run, attempt, status, category FROM happened
         QUALIFY row_number() OVER (PARTITION BY run ORDER BY attempt DESC) = 1""",
)
def latest_attempts(spark, sf_dir):
    return runs.latest_attempts(runs.attempt_history(fixture(spark, sf_dir, "attempt_log")))


@query(
    "backoff_schedule",
    """SELECT run, attempt, CAST(least(10 * pow(2, attempt - 1), 300) AS DOUBLE) AS base_seconds, true AS in_range
       FROM attempt_log WHERE category IS NOT NULL AND retryable AND attempt < 5""",
)
def backoff_schedule(spark, sf_dir):
    waiting = runs.retry_decisions(fixture(spark, sf_dir, "attempt_log")).where("decision = 'retry'")
    retry = F.col("attempt") - 1
    base, full = backoff_seconds(retry), jittered_backoff_seconds(retry, F.col("run"))
    return waiting.select(
        "run",
        "attempt",
        base.alias("base_seconds"),
        full.between(base, base * (1 + BACKOFF_JITTER)).alias("in_range"),
    )


@query(
    "run_latest_status",
    """SELECT run, status, changed_at, count(*) OVER (PARTITION BY run) AS changes FROM status_changes
       QUALIFY row_number() OVER (PARTITION BY run ORDER BY seq DESC) = 1""",
)
def run_latest_status(spark, sf_dir):
    return runs.latest_status(fixture(spark, sf_dir, "status_changes"))


@query(
    "error_taxonomy",
    """SELECT run_id, error_category, CASE WHEN error_category = 'KeyError' THEN 'UnexpectedError'
              ELSE error_category END AS folded_category,
              CASE WHEN error_category IN ('FetchFailed', 'LoadFailed') THEN NULL
                   WHEN error_category IS NOT NULL THEN false END AS fixed_retryable
       FROM runs""",
)
def error_taxonomy(spark, sf_dir):
    history = fixture(spark, sf_dir, "runs").select("run_id", "error_category")
    return runs.classify_errors(history, "error_category")


_CONTINUABLE = "status = 'failed' AND error_category = 'PageLimitExceededError'"


@query("continuable_runs", f"SELECT run_id, config_id FROM runs WHERE {_CONTINUABLE}")
def continuable_runs(spark, sf_dir):
    return runs.continuable_runs(fixture(spark, sf_dir, "runs")).select("run_id", "config_id")


@query(
    "continuation_seed",
    f"""SELECT run_id AS continued_from, config_id, last_successful_cursor, pages_extracted, records_extracted,
               records_loaded, raw_payload_count, 'pending' AS status, CAST(0 AS BIGINT) AS attempt
        FROM runs WHERE {_CONTINUABLE}""",
)
def continuation_seed(spark, sf_dir):
    return runs.continuation_seeds(fixture(spark, sf_dir, "runs"))


@query(
    "continuation_open",
    f"""SELECT run_id, config_id FROM runs r WHERE {_CONTINUABLE}
        AND NOT EXISTS (SELECT 1 FROM runs c WHERE c.continued_from = r.run_id)""",
)
def continuation_open(spark, sf_dir):
    return runs.open_continuations(fixture(spark, sf_dir, "runs")).select("run_id", "config_id")


@query(
    "continuation_lineage",
    """SELECT run_id, CASE WHEN run_id % 5 = 0 THEN CAST(floor(run_id / 400) AS BIGINT) * 400 ELSE run_id END AS root_run,
              CASE WHEN run_id % 5 = 0 THEN CAST(floor(run_id % 400 / 5) AS BIGINT) ELSE 0 END AS depth
       FROM runs""",
)
def continuation_lineage(spark, sf_dir):
    return runs.continuation_lineage(fixture(spark, sf_dir, "runs"))


@query(
    "chain_totals",
    """WITH RECURSIVE chain AS (
         SELECT run_id, run_id AS root_run, 0 AS depth, pages_extracted FROM runs WHERE continued_from IS NULL
         UNION ALL
         SELECT r.run_id, c.root_run, c.depth + 1, r.pages_extracted
         FROM runs r JOIN chain c ON r.continued_from = c.run_id)
       SELECT root_run, count(*) AS chain_runs, max(depth) AS longest, CAST(sum(pages_extracted) AS BIGINT) AS pages
       FROM chain GROUP BY root_run HAVING count(*) > 1""",
)
def chain_totals(spark, sf_dir):
    history = fixture(spark, sf_dir, "runs")
    return (
        runs.continuation_lineage(history)
        .join(history.select("run_id", "pages_extracted"), "run_id")
        .groupBy("root_run")
        .agg(
            F.count(F.lit(1)).alias("chain_runs"),
            F.max("depth").alias("longest"),
            F.sum("pages_extracted").alias("pages"),
        )
        .where("chain_runs > 1")
    )


@query(
    "recent_runs",
    """SELECT * FROM (SELECT o_custkey % 40 AS config_id, o_orderkey AS run_id, o_orderdate AS created_at,
              CAST(row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER)
              AS position FROM orders) t WHERE position <= 50""",
)
def recent_runs(spark, sf_dir):
    history = fixture(spark, sf_dir, "runs").select(
        (F.col("config_id") % 40).alias("config_id"), "run_id", "created_at"
    )
    return runs.recent_runs(history)


@query(
    "run_detail",
    f"""SELECT r.run_id, r.config_id, s.p_name AS source_name, d.p_name AS destination_name, r.status,
               (SELECT min(run_id) FROM runs c WHERE c.continued_from = r.run_id) AS child_run,
               {_CONTINUABLE} AS continuable,
               {_CONTINUABLE} AND (SELECT min(run_id) FROM runs c WHERE c.continued_from = r.run_id) IS NULL
                 AS offer_continue
        FROM (SELECT *, coalesce(error_category, '') AS ec FROM runs) r
        JOIN customer u ON u.c_custkey = r.config_id
        LEFT JOIN part s ON s.p_partkey = u.c_custkey % 100 * 2
        LEFT JOIN part d ON d.p_partkey = u.c_custkey % 90 * 2 + 1""".replace(
        "error_category =", "coalesce(error_category, '') ="
    ),
)
def run_detail(spark, sf_dir):
    configs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("config_id"),
        (F.col("c_custkey") % 100 * 2).alias("source_connection"),
        (F.col("c_custkey") % 90 * 2 + 1).alias("destination_connection"),
    )
    details = runs.run_details(
        fixture(spark, sf_dir, "runs"), configs, fixture(spark, sf_dir, "connections")
    )
    return details.select(
        "run_id", "config_id", "source_name", "destination_name", "status", "child_run",
        "continuable", "offer_continue",
    )


@query(
    "config_listing",
    "SELECT c_custkey AS config_id, c_name AS name, c_mktsegment AS schedule FROM customer ORDER BY name",
)
def config_listing(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.col("c_custkey").alias("config_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("schedule"),
        )
        .orderBy("name", "config_id")
    )


@query(
    "trigger_dedupe",
    """WITH checked AS (
         SELECT q.*, CASE WHEN NOT is_active THEN 'inactive'
                  WHEN continue_from IS NOT NULL AND s.run_id IS NULL THEN 'unknown run'
                  WHEN continue_from IS NOT NULL AND s.config_id <> q.config_id THEN 'other configuration'
                  WHEN continue_from IS NOT NULL AND NOT (s.status = 'failed'
                       AND coalesce(s.error_category, '') = 'PageLimitExceededError') THEN 'not continuable' END AS problem
         FROM trigger_requests q LEFT JOIN continuable_source s ON s.run_id = q.continue_from),
       keyed AS (
         SELECT *, first_value(request_id) OVER w AS created_by, first_value(config_id) OVER w AS owner
         FROM checked WHERE problem IS NULL AND idempotency_key IS NOT NULL AND idempotency_key <> ''
         WINDOW w AS (PARTITION BY idempotency_key ORDER BY request_id))
       SELECT k.request_id, CASE WHEN k.request_id = created_by THEN 'created' WHEN owner <> config_id THEN 'refused'
                ELSE 'reused' END AS outcome,
              CASE WHEN owner = config_id THEN created_by END AS created_by,
              k.request_id = created_by OR (owner = config_id AND coalesce(c.claimed_order > k.request_id, true))
                AS dispatched,
              CASE WHEN owner <> config_id THEN 'key of another configuration' END AS problem
       FROM keyed k LEFT JOIN run_claim_times c ON c.request_id = k.created_by
       UNION ALL
       SELECT request_id, CASE WHEN problem IS NULL THEN 'created' ELSE 'refused' END,
              CASE WHEN problem IS NULL THEN request_id END, problem IS NULL, problem
       FROM checked WHERE problem IS NOT NULL OR idempotency_key IS NULL OR idempotency_key = ''""",
)
def trigger_dedupe(spark, sf_dir):
    return dispatch.trigger_outcomes(
        fixture(spark, sf_dir, "trigger_requests"),
        fixture(spark, sf_dir, "continuable_source"),
        fixture(spark, sf_dir, "run_claim_times"),
    )
