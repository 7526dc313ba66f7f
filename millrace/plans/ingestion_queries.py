"""Queries over whole ingestion runs, loads and streams."""

import re

from pyspark.sql import functions as F

from millrace.operators import rawstore
from millrace.operators.config import effective_configs
from millrace.operators.mapping import type_failures
from millrace.operators.records import extract_records
from millrace.operators.rules import records_paths
from millrace.plans.fixtures import fixture
from millrace.plans.ingestion import destination_rows, ingest, ingest_pipelines
from millrace.plans.registry import query
from millrace.plans.scan_queries import RECORDS_PATH
from millrace.session import scratch_path
from millrace.sources import sinks
from millrace.streaming import pages as stream

# --- fixed values ---
MAPPING = {"order_id": "o_orderkey", "customer_id": "cust.id", "cents": "cents", "note": "note"}
TYPES = {"order_id": "bigint", "customer_id": "bigint", "cents": "bigint", "note": "string"}

# The page loop in the checking engine, from the rules of a run: read page after page from the
# saved cursor; a page that can't be fetched or read fails the run; a page is stored, then mapped
# and loaded, and only a loaded page counts and moves the cursor; an empty page is stored only if
# kept; the scan ends with an empty or a short page, or fails when its page budget is used up.
_LOOP = """
WITH facts AS (
  SELECT run, page, variant, body, fetch_error, load_error,
         CASE WHEN variant IN (47, 48, 49) THEN NULL WHEN variant = 45 THEN 0
              ELSE json_array_length(CASE WHEN variant = 46 THEN body ELSE body->'data'->'items' END) END AS n,
         CASE WHEN fetch_error IS NOT NULL THEN fetch_error
              WHEN variant IN (47, 48, 49) THEN 'MalformedResponseError'
              WHEN variant <> 45 AND contains(body, '"cents":"n/a"') THEN 'LoadFailed'
              ELSE load_error END AS error
  FROM @pages),
started AS (SELECT *, CASE WHEN cursor IS NULL THEN start_page ELSE CAST(cursor AS BIGINT) END AS start FROM landed_runs),
readable AS (
  SELECT f.*, s.start, s.page_size, s.max_pages, s.retain_empty, s.config_id, s.tenant_uuid, s.pages_extracted,
         error IS NOT NULL AS broken, coalesce(n = 0 OR n < page_size, false) AS ends,
         row_number() OVER (PARTITION BY f.run ORDER BY page) AS rn
  FROM facts f JOIN started s ON s.run = f.run AND f.page >= s.start),
visited AS (
  SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN broken OR ends THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY rn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped
         FROM readable WHERE page = start + rn - 1) t
  WHERE stopped = 0 AND rn <= max_pages),
processed AS (SELECT * FROM visited WHERE NOT broken AND (n > 0 OR retain_empty)),
kept_raw AS (SELECT *, NOT broken AS loaded FROM visited
             WHERE (NOT broken AND (n > 0 OR retain_empty))
                OR (broken AND fetch_error IS NULL AND variant NOT IN (47, 48, 49)))
"""
_STATES = """, last AS (SELECT * FROM visited QUALIFY row_number() OVER (PARTITION BY run ORDER BY rn DESC) = 1),
      done AS (SELECT run, count(*) AS pages, CAST(sum(n) AS BIGINT) AS records, max(page) AS page,
                      max_by(CASE WHEN ends THEN CAST(page AS VARCHAR) ELSE CAST(page + 1 AS VARCHAR) END, page) AS cursor
               FROM processed GROUP BY run)
      SELECT s.run, CASE WHEN l.run IS NULL THEN 'incomplete' WHEN l.broken THEN 'failed' WHEN l.ends THEN 'succeeded'
               WHEN l.rn = l.max_pages THEN 'failed' ELSE 'incomplete' END AS status,
             CASE WHEN l.run IS NULL THEN NULL WHEN l.broken THEN l.error WHEN l.ends THEN NULL
               WHEN l.rn = l.max_pages THEN 'PageLimitExceededError' END AS category,
             s.pages_extracted + coalesce(d.pages, 0) AS pages_extracted,
             s.records_extracted + coalesce(d.records, 0) AS records_extracted,
             s.records_loaded + coalesce(d.records, 0) AS records_loaded,
             s.raw_payload_count + coalesce(d.pages, 0) AS raw_payload_count,
             coalesce(d.cursor, s.cursor) AS last_successful_cursor, coalesce(d.page, s.start - 1) AS last_page
      FROM started s LEFT JOIN last l ON l.run = s.run LEFT JOIN done d ON d.run = s.run"""
_RAW = """SELECT run, pages_extracted + page - start + 1 AS sequence, page, sha256(body) AS checksum_sha256,
                CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes, CAST(n AS BIGINT) AS item_count,
                loaded AS loaded_successfully,
                concat(config_id, '/', run, '/', format('{:06d}', pages_extracted + page - start + 1), '-', sha256(body), '.raw') AS logical_key,
                concat('s3://raw/', CASE WHEN tenant_uuid IS NULL THEN '' ELSE concat(tenant_uuid, '/') END,
                       config_id, '/', run, '/', format('{:06d}', pages_extracted + page - start + 1), '-', sha256(body), '.raw') AS storage_uri
         FROM kept_raw"""
_LOADED = """SELECT p.run, p.page, o.o_orderkey AS order_id, o.o_custkey AS customer_id, o.cents,
                CASE WHEN o.o_orderkey % 7 > 1 THEN concat('n', o.o_orderkey % 10) END AS note
         FROM processed p JOIN order_pages o ON o.run = p.run AND o.page = p.page
         WHERE p.variant <> 45 AND (p.variant NOT BETWEEN 40 AND 44 OR o.o_orderkey % 100 < 60)"""


def _loop(pages: str) -> str:
    plain = "(SELECT *, CAST(NULL AS VARCHAR) AS fetch_error, CAST(NULL AS VARCHAR) AS load_error FROM page_bodies) b"
    return _LOOP.replace("@pages", plain if pages == "page_bodies" else pages)


def _ingest(spark, sf_dir, pages="troubled_pages"):
    landed = fixture(spark, sf_dir, pages).drop("variant")
    return ingest(landed, fixture(spark, sf_dir, "landed_runs"), RECORDS_PATH, MAPPING, TYPES)


@query("run_execution", _loop("page_bodies") + _STATES)
def run_execution(spark, sf_dir):
    return _ingest(spark, sf_dir, "page_bodies").states


@query("run_raw_records", _loop("troubled_pages") + _RAW)
def run_raw_records(spark, sf_dir):
    return _ingest(spark, sf_dir).raw_records


@query("run_loaded_rows", _loop("troubled_pages") + _LOADED)
def run_loaded_rows(spark, sf_dir):
    return _ingest(spark, sf_dir).loaded.drop("pos")


@query("load_failure_cutoff", _loop("troubled_pages") + _STATES)
def load_failure_cutoff(spark, sf_dir):
    return _ingest(spark, sf_dir).states


def _numbered(sql: str, k: int) -> str:
    """The loop's tables under names of their own."""
    return re.sub(r"\b(facts|started|readable|visited|processed|kept_raw|last|done)\b", rf"\1_{k}", sql)


# A first attempt over pages in which things went wrong, then a second one of the runs that failed,
# over the mended pages and from the state that the first one left.
@query(
    "resumed_execution",
    _numbered(_loop("troubled_pages") + _STATES.replace("SELECT s.run, CASE", "states_1 AS (SELECT s.run, CASE", 1).replace(
        "GROUP BY run)", "GROUP BY run),", 1), 1)
    + """),
      retried AS (
        SELECT r.run, r.config_id, r.start_page, r.page_size, r.max_pages, s.last_successful_cursor AS cursor, r.retain_empty,
               s.pages_extracted, s.records_extracted, s.records_loaded, s.raw_payload_count, r.tenant_uuid
        FROM landed_runs r JOIN states_1 s ON s.run = r.run WHERE s.status = 'failed'),"""
    + _numbered(_loop("page_bodies").replace("WITH facts", "facts").replace("FROM landed_runs", "FROM retried") + _STATES, 2),
)
def resumed_execution(spark, sf_dir):
    runs = fixture(spark, sf_dir, "landed_runs")
    states = _ingest(spark, sf_dir).states
    again = (
        runs.drop("cursor", "pages_extracted", "records_extracted", "records_loaded", "raw_payload_count")
        .join(states.where("status = 'failed'").withColumnRenamed("last_successful_cursor", "cursor"), "run")
        .drop("status", "category", "last_page")
    )
    landed = fixture(spark, sf_dir, "page_bodies").select("run", "page", "body")
    return ingest(landed, again, RECORDS_PATH, MAPPING, TYPES).states


# A page counts once, as it arrived first; what never landed stops its run, repeats or not.
_FIRST = """(SELECT run, page, arg_min(variant, arrival) AS variant, arg_min(body, arrival) AS body,
             CAST(NULL AS VARCHAR) AS fetch_error, CAST(NULL AS VARCHAR) AS load_error FROM relanded_pages GROUP BY run, page) b"""


def _relanded(spark, sf_dir):
    landed = fixture(spark, sf_dir, "relanded_pages").drop("variant")
    return ingest(landed, fixture(spark, sf_dir, "landed_runs"), RECORDS_PATH, MAPPING, TYPES)


@query("repeated_pages", _loop(_FIRST) + _STATES)
def repeated_pages(spark, sf_dir):
    return _relanded(spark, sf_dir).states


@query("repeated_pages_raw", _loop(_FIRST) + _RAW)
def repeated_pages_raw(spark, sf_dir):
    return _relanded(spark, sf_dir).raw_records


@query("repeated_pages_loaded", _loop(_FIRST) + _LOADED)
def repeated_pages_loaded(spark, sf_dir):
    return _relanded(spark, sf_dir).loaded.drop("pos")


# The loop again, for pipelines that read other fields of the same pages: what a page holds, and whether it
# maps and fits, goes by the pipeline of its run; pipeline 3 has no mapping and reads nothing.
_MIXED = (
    _loop("mixed_pages")
    .replace(
        "CASE WHEN variant IN (47, 48, 49) THEN NULL WHEN variant = 45 THEN 0",
        """CASE WHEN run % 5 = 4 THEN CASE WHEN variant IN (46, 48) THEN json_array_length(CASE WHEN variant = 46 THEN body ELSE body->'payload' END) END
              WHEN variant IN (47, 48, 49) THEN NULL WHEN variant = 45 THEN 0""",
    )
    .replace(
        "WHEN variant IN (47, 48, 49) THEN 'MalformedResponseError'",
        """WHEN run % 5 <> 4 AND variant IN (47, 48, 49) OR run % 5 = 4 AND variant NOT IN (46, 48) THEN 'MalformedResponseError'
              WHEN run % 5 = 2 AND contains(body, '"state"') THEN 'MappingError'""",
    )
    .replace("WHEN variant <> 45 AND contains", "WHEN run % 5 = 0 AND variant <> 45 AND contains")
    .replace("AND f.page >= s.start)", "AND f.page >= s.start AND s.run % 5 <> 3)")
)


def _mixed(spark, sf_dir):
    """Settings as pipelines have them: their own over those of their source, mappings as text."""
    settings = fixture(spark, sf_dir, "pipeline_settings")
    as_map = "filter(transform(split({0}, ';'), p -> split(p, ':')), p -> size(p) = 2)"

    def pairs(name):
        return F.expr(f"map_from_entries(transform({as_map.format(name)}, p -> struct(p[0], p[1])))")

    sources = settings.select(F.col("config_id").alias("connection_id"), F.col("base").alias("config"))
    own = settings.select(
        "config_id", F.col("config_id").alias("connection_id"), F.col("override").alias("extraction_config"), "strict",
        pairs("mapping").alias("mapping"), pairs("types").alias("types"),
    )
    pipelines = records_paths(effective_configs(own, sources)).select("config_id", "records_path", "mapping", "types", "strict")
    return ingest_pipelines(fixture(spark, sf_dir, "mixed_pages").drop("variant"), fixture(spark, sf_dir, "landed_runs"), pipelines)


@query(
    "run_mixed_pipelines",
    _MIXED + _STATES.replace("CASE WHEN l.run IS NULL THEN 'incomplete'", "CASE WHEN s.run % 5 = 3 THEN 'failed' WHEN l.run IS NULL THEN 'incomplete'")
    .replace("CASE WHEN l.run IS NULL THEN NULL", "CASE WHEN s.run % 5 = 3 THEN 'MappingError' WHEN l.run IS NULL THEN NULL"),
)
def run_mixed_pipelines(spark, sf_dir):
    return _mixed(spark, sf_dir).states


@query(
    "mixed_pipeline_rows",
    _MIXED
    + """, records AS (
         SELECT p.run, p.page, p.run % 5 AS config_id, o.*, CASE WHEN (p.run * 12 + p.page) % 29 = 9 THEN 'n/a' ELSE CAST(o.cents AS VARCHAR) END AS money,
                CASE WHEN (p.run * 12 + p.page) % 17 <> 5 THEN o.o_orderstatus END AS state
         FROM processed p JOIN order_pages o ON o.run = p.run AND o.page = p.page
         WHERE p.variant <> 45 AND (p.variant NOT BETWEEN 40 AND 44 OR o.o_orderkey % 100 < 60))
       SELECT run, page, config_id, name, CAST(value AS VARCHAR) AS value FROM (
         SELECT run, page, config_id, unnest(CASE config_id WHEN 0 THEN ['cents', 'customer_id', 'note', 'order_id']
                  WHEN 1 THEN ['number', 'state'] WHEN 2 THEN ['order_id', 'state'] ELSE ['client', 'key'] END) AS name,
                unnest(CASE config_id
                  WHEN 0 THEN [money, CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 7 > 1 THEN concat('n', o_orderkey % 10) END, CAST(o_orderkey AS VARCHAR)]
                  WHEN 4 THEN [CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)]
                  ELSE [CAST(o_orderkey AS VARCHAR), state] END) AS value
         FROM records) t""",
)
def mixed_pipeline_rows(spark, sf_dir):
    loaded = _mixed(spark, sf_dir).loaded
    cells = loaded.select("run", "page", "config_id", F.explode("row").alias("name", "_value"))
    return cells.select("run", "page", "config_id", "name", F.try_variant_get("_value", "$", "string").alias("value"))


@query(
    "mixed_pipeline_destination",
    _MIXED
    + """SELECT p.run, p.page, CAST(o.o_orderkey AS BIGINT) AS number,
                CASE WHEN (p.run * 12 + p.page) % 17 <> 5 THEN o.o_orderstatus END AS state
         FROM processed p JOIN order_pages o ON o.run = p.run AND o.page = p.page
         WHERE p.run % 5 = 1 AND p.variant <> 45 AND (p.variant NOT BETWEEN 40 AND 44 OR o.o_orderkey % 100 < 60)""",
)
def mixed_pipeline_destination(spark, sf_dir):
    return destination_rows(_mixed(spark, sf_dir).loaded, 1, {"number": "bigint", "state": "string"}).drop("pos")


@query(
    "map_type_failures",
    """SELECT run, page, count(*) AS bad_records, 0 AS first_pos, 'LoadFailed' AS category
       FROM troubled_pages JOIN order_pages USING (run, page)
       WHERE (run * 12 + page) % 29 = 9 AND troubled_pages.variant NOT IN (45, 47, 48, 49)
         AND (troubled_pages.variant NOT BETWEEN 40 AND 44 OR o_orderkey % 100 < 60)
       GROUP BY run, page""",
)
def map_type_failures(spark, sf_dir):
    pages = fixture(spark, sf_dir, "troubled_pages").select("run", "page", "body")
    return type_failures(extract_records(pages, RECORDS_PATH), MAPPING, TYPES)


@query(
    "append_load",
    """SELECT run, count(*) AS rows, CAST(sum(cents) AS BIGINT) AS cents, CAST(NULL AS VARCHAR) AS remark
       FROM order_pages GROUP BY run""",
)
def append_load(spark, sf_dir):
    path = scratch_path(spark, "destination")
    sinks.provision(
        spark, path, "run bigint, page bigint, o_orderkey bigint, cents bigint, remark string"
    )
    rows = fixture(spark, sf_dir, "order_pages").select("run", "page", "o_orderkey", "cents")
    sinks.append_load(rows.where("page % 2 = 0"), path)
    sinks.append_load(rows.where("page % 2 = 1"), path)
    return (
        spark.read.parquet(path)
        .groupBy("run")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("cents").alias("cents"),
            F.max("remark").alias("remark"),
        )
    )


def _events_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return stream.file_stream(spark, path, spark.read.parquet(path).schema)


@query(
    "stream_run_counters",
    """SELECT user_id AS run, count(*) AS pages, CAST(sum(event_id % 10) AS BIGINT) AS records,
              max(event_id) AS last_page
       FROM events GROUP BY user_id""",
)
def stream_run_counters(spark, sf_dir):
    pages = _events_stream(spark, sf_dir).select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("page"),
        (F.col("event_id") % 10).alias("n"),
    )
    out = scratch_path(spark, "stream-counters")
    stream.drain(
        stream.page_totals(pages),
        stream.save_updates(f"{out}/updates"),
        f"{out}/progress",
        output_mode="update",
    )
    return stream.newest_updates(spark.read.parquet(f"{out}/updates"), ["run"])


@query(
    "stream_dedupe",
    """SELECT DISTINCT doc_id % 20 AS run, CAST(floor(doc_id / 20) AS BIGINT) % 10 + 1 AS sequence,
              sha256(text) AS checksum_sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes
       FROM documents""",
)
def stream_dedupe(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    documents = stream.file_stream(spark, path, spark.read.parquet(path).schema)
    deliveries = rawstore.address_payloads(
        documents.select(
            (F.col("doc_id") % 20).alias("run"),
            F.lit(0).alias("config_id"),
            (F.floor(F.col("doc_id") / 20) % 10 + 1).cast("bigint").alias("sequence"),
            F.col("text").alias("payload"),
        )
    ).select("run", "sequence", "checksum_sha256", "size_bytes")
    out = scratch_path(spark, "stream-dedupe")
    stream.drain(
        stream.first_deliveries(deliveries), stream.save_updates(f"{out}/pages"), f"{out}/progress"
    )
    return spark.read.parquet(f"{out}/pages").drop("batch")


def _stream_ingest(spark, sf_dir):
    """Land page bodies as files, then ingest them as a stream of several batches."""
    out = scratch_path(spark, "stream-ingest")
    landing = fixture(spark, sf_dir, "page_bodies").select("run", "page", "body")
    landing.repartition(8, "run", "page").write.parquet(f"{out}/landing")
    source = stream.file_stream(spark, f"{out}/landing", landing.schema, files_per_batch=3)
    runs = fixture(spark, sf_dir, "landed_runs")
    stream.drain(
        source,
        stream.ingest_batches(f"{out}/raw", f"{out}/loaded", RECORDS_PATH, MAPPING, TYPES, runs),
        f"{out}/progress",
    )
    return out


@query(
    "stream_pages",
    """SELECT run, count(*) AS pages, count(*) FILTER (variant IN (47, 48, 49)) AS malformed,
              CAST(sum(octet_length(encode(body))) AS BIGINT) AS size_bytes
       FROM page_bodies GROUP BY run""",
)
def stream_pages(spark, sf_dir):
    raw = spark.read.parquet(f"{_stream_ingest(spark, sf_dir)}/raw/facts")
    return raw.groupBy("run").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count("error").alias("malformed"),
        F.sum("size_bytes").alias("size_bytes"),
    )


# The stream loads what the runs of a batch over the same pages load.
@query("stream_load", _loop("page_bodies") + _LOADED)
def stream_load(spark, sf_dir):
    return spark.read.parquet(f"{_stream_ingest(spark, sf_dir)}/loaded/rows").drop("pos", "batch")


@query("stream_run_status", _loop("page_bodies") + _STATES + " WHERE s.run IN (SELECT run FROM page_bodies)")
def stream_run_status(spark, sf_dir):
    states = spark.read.parquet(f"{_stream_ingest(spark, sf_dir)}/loaded/states")
    return stream.newest_updates(states, ["run"])
