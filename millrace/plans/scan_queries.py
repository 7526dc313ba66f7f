"""Queries over page scans, responses and source settings."""

from pyspark.sql import functions as F

from millrace.functions.outcomes import clamp, over_size
from millrace.operators import config, paging, records
from millrace.operators.scaling import computed_once
from millrace.plans.fixtures import fixture, table
from millrace.plans.registry import query
from millrace.schemas import BODY_CEILING_BYTES, TIMEOUT_CEILING_SECONDS

RECORDS_PATH = "data.items"

# Pages a scan visits, in the checking engine's own terms: consecutive landed pages
# from the resume page, up to and including the first one that ends the scan.
WALK = """
WITH started AS (
  SELECT *, CASE WHEN cursor IS NULL OR cursor = '' THEN start_page
                 ELSE TRY_CAST(cursor AS BIGINT) END AS start FROM run_config),
readable AS (
  SELECT l.run, l.page, l.n, l.error, s.page_size, s.max_pages, s.start, s.retain_empty,
         (n = 0 OR coalesce(n < page_size, false)) AS ends,
         row_number() OVER (PARTITION BY l.run ORDER BY l.page) AS rn
  FROM page_log l JOIN started s ON s.run = l.run AND l.page >= s.start),
chained AS (
  SELECT *, coalesce(sum(CASE WHEN {stop} THEN 1 ELSE 0 END) OVER (
            PARTITION BY run ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped
  FROM readable WHERE page = start + rn - 1),
visited AS (SELECT * FROM chained WHERE stopped = 0 AND rn <= {budget})
"""
FULL_WALK = WALK.format(stop="error IS NOT NULL OR ends", budget="max_pages")
FREE_WALK = WALK.format(stop="ends", budget="1000000000")
LIMIT_WALK = WALK.format(stop="ends", budget="max_pages")

# One row per run: how the walk ends.
ENDING = """
, ending AS (
  SELECT s.run, s.start,
         CASE WHEN s.start IS NULL THEN 'failed' WHEN v.run IS NULL THEN 'incomplete'
              WHEN {error} THEN 'failed' WHEN v.ends THEN 'succeeded'
              WHEN v.rn = v.max_pages THEN 'failed' ELSE 'incomplete' END AS outcome,
         CASE WHEN s.start IS NULL THEN 'UnexpectedError' WHEN v.run IS NULL THEN NULL
              WHEN {error} THEN v.error WHEN v.ends THEN NULL
              WHEN v.rn = v.max_pages THEN 'PageLimitExceededError' END AS category,
         CASE WHEN s.start IS NULL THEN NULL WHEN v.run IS NULL THEN s.start - 1
              WHEN {error} THEN v.page - 1
              WHEN v.n = 0 AND NOT s.retain_empty THEN v.page - 1 ELSE v.page END AS last_page
  FROM started s LEFT JOIN (
    SELECT * FROM visited QUALIFY row_number() OVER (PARTITION BY run ORDER BY rn DESC) = 1) v
  ON v.run = s.run)
"""
FULL_ENDING = FULL_WALK + ENDING.format(error="v.error IS NOT NULL")
LIMIT_ENDING = LIMIT_WALK + ENDING.format(error="false")


def _log(spark, sf_dir):
    return fixture(spark, sf_dir, "page_log")


def _runs(spark, sf_dir):
    return fixture(spark, sf_dir, "run_config")


@query(
    "page_cut",
    """SELECT o_orderkey, CAST(floor(o_orderkey / 100) AS BIGINT) + 1 AS page,
              o_orderkey % 100 AS pos FROM orders""",
)
def page_cut(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return paging.cut_pages(rows, "o_orderkey", 100).withColumn(
        "pos", F.col("o_orderkey") % 100
    )


@query(
    "page_cut_by_order",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, page, count(*) AS copies FROM (
         SELECT *, CAST(floor((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                  l_extendedprice, l_shipdate) - 1) / 250) AS BIGINT) + 1 AS page FROM lineitem) t
       GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, page""",
)
def page_cut_by_order(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").select(*order)
    shown = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "page"]
    return (
        paging.cut_pages_by_order(rows, order, 250)
        .groupBy(*shown)
        .agg(F.count(F.lit(1)).alias("copies"))
    )


@query(
    "paged_scan",
    """SELECT run, page, CAST(page AS VARCHAR) AS cursor_used, 'application/json' AS content_type,
              CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes,
              CAST(CASE WHEN variant IN (47, 48, 49) THEN NULL WHEN variant = 45 THEN 0
                   ELSE json_array_length(CASE WHEN variant = 46 THEN body ELSE body->'data'->'items' END)
                   END AS BIGINT) AS n
       FROM page_bodies""",
)
def paged_scan(spark, sf_dir):
    pages = fixture(spark, sf_dir, "page_bodies")
    return records.page_facts(pages, RECORDS_PATH).select(
        "run",
        "page",
        F.col("page").cast("string").alias("cursor_used"),
        F.lit("application/json").alias("content_type"),
        "size_bytes",
        "n",
    )


@query(
    "terminal_page",
    WALK.format(stop="false", budget="1000000000")
    + """SELECT run, min(CASE WHEN ends THEN page END) AS terminal_page, count(*) AS landed_pages
         FROM readable GROUP BY run""",
)
def terminal_page(spark, sf_dir):
    return paging.terminal_pages(_log(spark, sf_dir), _runs(spark, sf_dir))


def _free_scan(spark, sf_dir, retain):
    pages = _log(spark, sf_dir).drop("error")
    runs = _runs(spark, sf_dir).withColumn("max_pages", F.lit(1_000_000_000))
    if not retain:
        runs = runs.withColumn("retain_empty", F.lit(False))
    return paging.kept_pages(pages, paging.scan_outcomes(pages, runs))


@query(
    "page_cursors",
    FREE_WALK
    + """SELECT run, page, n, CAST(page AS VARCHAR) AS cursor_used,
                CASE WHEN NOT ends THEN CAST(page + 1 AS VARCHAR) END AS next_cursor
         FROM visited WHERE n > 0""",
)
def page_cursors(spark, sf_dir):
    return _free_scan(spark, sf_dir, retain=False).select(
        "run", "page", "n", "cursor_used", "next_cursor"
    )


@query(
    "retain_empty_terminal",
    FREE_WALK
    + """SELECT run, page, n, CASE WHEN NOT ends THEN CAST(page + 1 AS VARCHAR) END AS next_cursor
         FROM visited WHERE n > 0 OR retain_empty""",
)
def retain_empty_terminal(spark, sf_dir):
    return _free_scan(spark, sf_dir, retain=True).select("run", "page", "n", "next_cursor")


@query(
    "page_limit_guard",
    LIMIT_ENDING + "SELECT run, start, outcome, category, last_page FROM ending",
)
def page_limit_guard(spark, sf_dir):
    pages = _log(spark, sf_dir).drop("error")
    return paging.scan_outcomes(pages, _runs(spark, sf_dir)).select(
        "run", "start", "outcome", "category", "last_page"
    )


@query(
    "resume_scan",
    WALK.format(stop="false", budget="1000000000")
    + """SELECT s.run, s.start, s.start IS NULL AS bad_cursor, count(r.page) AS readable_pages,
                min(r.page) AS first_page
         FROM started s LEFT JOIN readable r ON r.run = s.run GROUP BY s.run, s.start""",
)
def resume_scan(spark, sf_dir):
    pages, runs = _log(spark, sf_dir), _runs(spark, sf_dir)
    seen = (
        paging.pages_from_resume(pages, runs)
        .groupBy("run")
        .agg(F.count(F.lit(1)).alias("readable_pages"), F.min("page").alias("first_page"))
    )
    return (
        paging.resume_runs(runs)
        .select("run", "start", "bad_cursor")
        .join(seen, "run", "left")
        .fillna(0, ["readable_pages"])
    )


@query(
    "first_error_cutoff",
    FULL_ENDING + "SELECT run, start, outcome, category, last_page FROM ending",
)
def first_error_cutoff(spark, sf_dir):
    return paging.scan_outcomes(_log(spark, sf_dir), _runs(spark, sf_dir)).select(
        "run", "start", "outcome", "category", "last_page"
    )


_EFFECTIVE = """
WITH chosen AS (
  SELECT a.run, a.page,
         CASE WHEN a.status IN (401, 403) AND a.has_provider AND b.page IS NOT NULL THEN 2 ELSE 1 END AS try,
         CASE WHEN a.status IN (401, 403) AND a.has_provider AND b.page IS NOT NULL
              THEN b.status ELSE a.status END AS status
  FROM (SELECT * FROM response_log WHERE try = 1) a
  LEFT JOIN (SELECT * FROM response_log WHERE try = 2) b ON a.run = b.run AND a.page = b.page)
"""


@query("effective_response", _EFFECTIVE + "SELECT run, page, try, status FROM chosen")
def effective_response(spark, sf_dir):
    return records.effective_responses(fixture(spark, sf_dir, "response_log"), ["run", "page"])


@query(
    "response_outcome",
    _EFFECTIVE
    + """SELECT run, page, status,
           CASE WHEN status IS NULL THEN 'FetchFailed' WHEN status >= 300 AND status < 400
                THEN 'OutboundRequestBlockedError' WHEN status >= 400 THEN 'FetchFailed' END AS category,
           CASE WHEN status IS NULL OR status = 429 OR (status >= 500 AND status < 600) THEN true
                WHEN status >= 300 THEN false END AS retryable
         FROM chosen""",
)
def response_outcome(spark, sf_dir):
    chosen = records.effective_responses(fixture(spark, sf_dir, "response_log"), ["run", "page"])
    return records.classify_responses(chosen).drop("try")


@query(
    "body_size_cap",
    """SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
              octet_length(encode(text)) > least(coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 * 1000 END,
                       10485760), 10485760) AS blocked
       FROM documents""",
)
def body_size_cap(spark, sf_dir):
    size = F.octet_length("text").cast("bigint")
    requested = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 * 1000)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        size.alias("size_bytes"),
        over_size(size, requested, BODY_CEILING_BYTES).alias("blocked"),
    )


@query(
    "limit_clamp",
    """SELECT p_partkey,
              CAST(least(coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_size * 400000 END, 10485760), 10485760)
                   AS BIGINT) AS max_bytes,
              CAST(least(coalesce(CASE WHEN p_partkey % 5 > 0 THEN p_size * 4 END, 120), 120) AS BIGINT)
                   AS timeout_seconds
       FROM part""",
)
def limit_clamp(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        clamp(F.when(key % 4 > 0, size * 400_000), BODY_CEILING_BYTES)
        .cast("bigint")
        .alias("max_bytes"),
        clamp(F.when(key % 5 > 0, size * 4), TIMEOUT_CEILING_SECONDS)
        .cast("bigint")
        .alias("timeout_seconds"),
    )


@query(
    "malformed_pages",
    """SELECT run, page, CASE variant WHEN 47 THEN 'invalid JSON' WHEN 48 THEN 'records field missing'
              ELSE 'records field not a list' END AS problem, 'MalformedResponseError' AS error
       FROM page_bodies WHERE variant IN (47, 48, 49)""",
)
def malformed_pages(spark, sf_dir):
    pages = fixture(spark, sf_dir, "page_bodies")
    return (
        records.page_facts(pages, RECORDS_PATH)
        .where("error IS NOT NULL")
        .select("run", "page", "problem", "error")
    )


@query(
    "extract_records",
    """SELECT run, page, CAST(row_number() OVER (PARTITION BY run, page ORDER BY o_orderkey) - 1 AS INTEGER) AS pos,
              o_orderkey, o_custkey, cents
       FROM order_pages
       WHERE variant NOT IN (45, 47, 48, 49) AND (variant NOT BETWEEN 40 AND 44 OR o_orderkey % 100 < 60)""",
)
def extract_records(spark, sf_dir):
    found = records.extract_records(fixture(spark, sf_dir, "page_bodies"), RECORDS_PATH)
    return found.select(
        "run",
        "page",
        "pos",
        F.try_variant_get("record", "$.o_orderkey", "bigint").alias("o_orderkey"),
        F.try_variant_get("record", "$.cust.id", "bigint").alias("o_custkey"),
        F.try_variant_get("record", "$.cents", "bigint").alias("cents"),
    )


@query(
    "records_path_choice",
    """SELECT connection_id, coalesce(nullif(config->>'records_path', ''), config->>'records_key', 'results')
              AS records_path FROM source_configs""",
)
def records_path_choice(spark, sf_dir):
    parsed = computed_once(
        fixture(spark, sf_dir, "source_configs"), _config=F.try_parse_json("config")
    )
    return parsed.select(
        "connection_id", records.choose_records_path(F.col("_config")).alias("records_path")
    )


@query(
    "source_config_audit",
    """WITH parsed AS (
         SELECT connection_id, config,
                json_type(config, '$.path') AS path_type, json_type(config, '$.method') AS method_type,
                json_type(config, '$.max_pages') AS mp, json_type(config, '$.start_page') AS sp,
                json_type(config, '$.timeout_seconds') AS ts, json_type(config, '$.max_response_bytes') AS mb
         FROM source_configs)
       SELECT connection_id, problem, CASE WHEN problem IS NOT NULL THEN 'ConfigurationError' END AS category
       FROM (SELECT connection_id, CASE
           WHEN coalesce(config->>'base_url', '') = '' THEN 'base_url'
           WHEN path_type IS NULL OR path_type = 'NULL' OR config->>'path' IN ('', '[]') THEN 'path'
           WHEN method_type IS NOT NULL AND upper(config->>'method') NOT IN ('GET', 'POST') THEN 'method'
           WHEN mp IS NOT NULL AND NOT (mp IN ('BIGINT', 'UBIGINT') AND TRY_CAST(config->>'max_pages' AS DOUBLE) > 0)
             THEN 'max_pages'
           WHEN sp IS NOT NULL AND NOT (sp IN ('BIGINT', 'UBIGINT') AND TRY_CAST(config->>'start_page' AS DOUBLE) > 0)
             THEN 'start_page'
           WHEN ts IS NOT NULL AND NOT (ts IN ('BIGINT', 'UBIGINT', 'DOUBLE')
                AND TRY_CAST(config->>'timeout_seconds' AS DOUBLE) > 0) THEN 'timeout_seconds'
           WHEN mb IS NOT NULL AND NOT (mb IN ('BIGINT', 'UBIGINT')
                AND TRY_CAST(config->>'max_response_bytes' AS DOUBLE) > 0) THEN 'max_response_bytes'
         END AS problem FROM parsed) t""",
)
def source_config_audit(spark, sf_dir):
    return config.audit_configs(fixture(spark, sf_dir, "source_configs")).select(
        "connection_id", "problem", "category"
    )


@query(
    "effective_config",
    """SELECT o.config_id, o.connection_id, o.extraction_config->>'tag' AS tag,
         CASE WHEN json_type(o.extraction_config, '$.path') IS NOT NULL THEN o.extraction_config->>'path'
              ELSE c.config->>'path' END AS path,
         CASE WHEN json_type(o.extraction_config, '$.max_pages') IS NOT NULL THEN o.extraction_config->>'max_pages'
              ELSE c.config->>'max_pages' END AS max_pages,
         CAST(list_unique(list_concat(json_keys(o.extraction_config), json_keys(c.config))) AS INTEGER) AS n_keys
       FROM config_overrides o JOIN source_configs c ON c.connection_id = o.connection_id""",
)
def effective_config(spark, sf_dir):
    merged = config.effective_configs(
        fixture(spark, sf_dir, "config_overrides"), fixture(spark, sf_dir, "source_configs")
    )

    def setting(key):
        return F.try_element_at("effective", F.lit(key)).cast("string").alias(key)

    return merged.select(
        "config_id",
        "connection_id",
        setting("tag"),
        setting("path"),
        setting("max_pages"),
        F.size("effective").alias("n_keys"),
    )


@query(
    "connector_resolution",
    """SELECT connection_id, name, kind, connector_type, kind || connector_type IN ('sourcerest_api', 'destinationsqlserver')
              AS known, CASE WHEN kind || connector_type IN ('sourcerest_api', 'destinationsqlserver') THEN NULL
              WHEN kind = 'source' THEN 'rest_api' ELSE 'sqlserver' END AS available,
              CASE WHEN kind || connector_type NOT IN ('sourcerest_api', 'destinationsqlserver')
                   THEN 'UnexpectedError' END AS category
       FROM connections""",
)
def connector_resolution(spark, sf_dir):
    return config.resolve_connectors(fixture(spark, sf_dir, "connections"))
