"""Whole ingestion runs: landed pages in, raw records, loaded rows and run states out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import logical_key, object_uri, tenant_key
from millrace.operators.paging import first_versions, kept_pages, resume_runs, scan_outcomes
from millrace.operators.records import MALFORMED, parse_body
from millrace.operators.rules import RULE_COLUMNS, FixedRules, RowRules, Rules, pipeline_rules
from millrace.operators.runs import COUNTERS, run_counters
from millrace.operators.scaling import BROADCAST_ROWS, Join, computed_once, join_for
from millrace.schemas import DEFAULT_MAX_PAGES
from millrace.session import cut_lineage
from millrace.sources.objects import Store, end_on_conflict, store_payloads
from millrace.sources.tables import load_runs

#: Failures after a page's payload was stored; all others leave no raw record.
AFTER_STORAGE = ["MappingError", "LoadFailed"]


@dataclass(frozen=True)
class Ingestion:
    """What a set of runs leaves behind."""

    states: DataFrame
    raw_records: DataFrame
    loaded: DataFrame
    #: ``run, page, storage_uri, payload`` of every raw record, where its body landed.
    payloads: DataFrame


def with_settings(runs: DataFrame) -> DataFrame:
    """Runs with the columns that may be left out: pipeline, tenant and saved counters.

    A run without ``config_id`` stands for a pipeline of its own; saved counters
    start at 0; a run without ``tenant_uuid`` has keys without a tenant.
    """
    given = set(runs.columns)
    added = {}
    if "config_id" not in given:
        added["config_id"] = F.col("run")
    if "tenant_uuid" not in given:
        added["tenant_uuid"] = F.lit(None).cast("string")
    for name in COUNTERS:
        added[name] = F.coalesce(F.col(name), F.lit(0)).cast("bigint") if name in given else F.lit(0).cast("bigint")
    return runs.withColumns(added)


def within_budget(landed: DataFrame, runs: DataFrame, join: Join, carried: list[str] | None = None) -> DataFrame:
    """Landed pages that a run may read at all: from its resume page on, as many as its budget.

    Applied before anything is parsed, so that a run which resumes near the end
    of a long landing reads only what is left. Columns of the runs named in
    ``carried`` come along.
    """
    started = resume_runs(runs).where(~F.col("bad_cursor"))
    last = F.col("start") + F.coalesce(F.col("max_pages"), F.lit(DEFAULT_MAX_PAGES)) - 1
    bounds = started.select("run", F.col("start").alias("_first"), last.alias("_last"), *(carried or []))
    return join(landed, bounds, ["run"], ["page"]).where("page BETWEEN _first AND _last").drop("_first", "_last")


def judged_pages(landed: DataFrame, rules: Rules) -> DataFrame:
    """Thin facts of every landed row, bodies read once and left behind.

    A page fails for the first of: a fetch error that came with it, a malformed
    body, a record that can't be mapped, a value that doesn't fit its column, a
    load error that came with it. The last three leave a raw record.
    """
    parsed = computed_once(landed, _data=parse_body(F.col("body")))
    parsed = computed_once(parsed, _records=rules.records(F.col("_data")))
    unmappable = F.exists("_records", rules.unmappable)
    unfit = F.exists("_records", rules.unfit)
    malformed = rules.problem(F.col("_data")).isNotNull()

    def given(name: str) -> Column:
        return F.col(name) if name in landed.columns else F.lit(None).cast("string")

    error = (
        F.when(given("fetch_error").isNotNull(), given("fetch_error"))
        .when(malformed, MALFORMED)
        .when(unmappable, "MappingError")
        .when(unfit, "LoadFailed")
        .otherwise(given("load_error"))
    )
    judged = computed_once(parsed, error=error, _stored=given("fetch_error").isNull() & ~malformed)
    return judged.select(
        "run",
        "page",
        F.size("_records").cast("bigint").alias("n"),
        F.octet_length("body").cast("bigint").alias("size_bytes"),
        F.sha2(F.col("body").cast("binary"), 256).alias("checksum_sha256"),
        "error",
        (F.col("_stored") & F.col("error").isNotNull()).alias("fails_after_storage"),
        *[F.col(c) for c in ("arrival",) if c in landed.columns],
    )


def page_states(
    landed: DataFrame,
    records_path: str,
    mapping: dict[str, str],
    strict: bool,
    types: dict[str, str] | None = None,
) -> DataFrame:
    """:func:`judged_pages` under one set of rules."""
    return judged_pages(landed, FixedRules(records_path, mapping, types or {}, strict))


def run_states(outcomes: DataFrame, kept: DataFrame, runs: DataFrame) -> DataFrame:
    """Status, counters and cursor of each run: what was saved, and what its pages add.

    A run that processed no page keeps its saved cursor and counters.
    """
    # run_counters folds per run; every kept page was loaded in full.
    done = run_counters(kept.withColumn("loaded", F.col("n")))
    done = done.select("run", "last_successful_cursor", *[F.col(c).alias(f"_{c}") for c in COUNTERS])
    saved = runs.select("run", "cursor", *COUNTERS)
    return (
        outcomes.select("run", F.col("outcome").alias("status"), "category", "last_page")
        .join(saved, "run")
        .join(done, "run", "left")
        .select(
            "run", "status", "category", "last_page",
            *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in COUNTERS],
            F.coalesce("last_successful_cursor", "cursor").alias("last_successful_cursor"),
        )
    )


def ingest(
    landed: DataFrame,
    runs: DataFrame,
    records_path: str,
    mapping: dict[str, str],
    types: dict[str, str],
    strict: bool = False,
    bucket: str = "raw",
    broadcast_rows: int = BROADCAST_ROWS,
) -> Ingestion:
    """Run the page loop of every run of one pipeline's settings at once.

    ``landed`` holds ``run, page, body`` and may hold the categories of a
    ``fetch_error`` or ``load_error`` of a page, and its ``arrival``; ``runs`` the scan
    settings of :mod:`millrace.operators.paging` and those of :func:`with_settings`, so
    that the states of one call are the saved state of the next.

    A page may land more than once: its first version counts, once, by ``arrival`` or
    else by checksum. Without a mapping every run fails before a page is read. Page
    facts and run outcomes are materialised once, because raw records, counters and
    rows all need them and none needs a body. Bodies are cut to the pages of a run
    before they are parsed, in both passes: up to ``broadcast_rows`` runs that takes no
    shuffle of bodies, beyond that they are spread; the rows are the same. Only bodies
    of pages that landed more than once are shuffled, to load one of them.
    """
    return _ingest(landed, with_settings(runs), FixedRules(records_path, mapping, types, strict), bucket, broadcast_rows)


def ingest_pipelines(
    landed: DataFrame, runs: DataFrame, pipelines: DataFrame, bucket: str = "raw", broadcast_rows: int = BROADCAST_ROWS
) -> Ingestion:
    """Run the page loop of runs whose pipelines have settings of their own, all in one pass.

    Like :func:`ingest`, with the settings of ``runs.config_id`` in ``pipelines``: a row
    ``config_id, records_path, mapping, types, strict`` each, see
    :func:`millrace.operators.rules.pipeline_rules`. Loaded rows have the columns of
    different destinations, so they come as a map ``row`` beside ``config_id``;
    :func:`destination_rows` gives those of one destination. A run whose pipeline is
    not there has no mapping and fails.
    """
    settings = pipeline_rules(pipelines)
    return _ingest(landed, with_settings(runs).join(settings, "config_id", "left"), RowRules(), bucket, broadcast_rows)


def destination_rows(loaded: DataFrame, config_id, types: dict[str, str]) -> DataFrame:
    """Rows that one pipeline loads, ``run, page, pos`` and the columns of ``types``."""
    own = loaded.where(F.col("config_id") == config_id)
    return own.select("run", "page", "pos", *[F.try_variant_get(F.try_element_at("row", F.lit(c)), "$", k).alias(c) for c, k in types.items()])


def _one_of_each(pages: DataFrame, facts: DataFrame, broadcast_rows: int) -> DataFrame:
    """Landed pages without repeats: of a page that landed more than once, one row of the version that counts."""
    repeated = facts.where("copies > 1").select("run", "page", F.col("checksum_sha256").alias("_sum"))
    if repeated.isEmpty():
        return pages
    join = join_for(repeated, broadcast_rows)
    told = join(pages, repeated, ["run", "page"], ["run", "page"], "left")
    single = told.where("_sum IS NULL")
    several = told.where(F.col("_sum") == F.sha2(F.col("body").cast("binary"), 256)).dropDuplicates(["run", "page"])
    return single.unionByName(several).drop("_sum")


def _ingest(landed: DataFrame, runs: DataFrame, rules: Rules, bucket: str, broadcast_rows: int) -> Ingestion:
    runs = cut_lineage(runs.withColumn("_unmapped", rules.unmapped()))
    own_rules = [c for c in RULE_COLUMNS if c in runs.columns]
    join = join_for(runs, broadcast_rows)
    readable = runs.where(~F.col("_unmapped"))
    versions = judged_pages(within_budget(landed, readable, join, own_rules), rules)
    facts = cut_lineage(first_versions(versions).drop("arrival"))
    outcomes = scan_outcomes(facts.select("run", "page", "n", "error"), runs.drop(*own_rules), folded=True)
    unmapped = runs.select("run", "_unmapped")
    outcomes = cut_lineage(
        outcomes.join(unmapped, "run").withColumns(
            {
                "outcome": F.when(F.col("_unmapped"), "failed").otherwise(F.col("outcome")),
                "category": F.when(F.col("_unmapped"), "MappingError").otherwise(F.col("category")),
            }
        ).drop("_unmapped")
    )
    kept = kept_pages(facts, outcomes, join)
    states = run_states(outcomes, kept, runs)
    bounds = outcomes.select("run", "start", "last_page", "stop_page").join(
        runs.select("run", "config_id", "tenant_uuid", "pages_extracted"), "run"
    )
    addressed = {
        "sequence": F.col("pages_extracted") + F.col("page") - F.col("start") + 1,
        "logical_key": logical_key(F.col("config_id"), F.col("run"), F.col("sequence"), F.col("checksum_sha256")),
        "_key": F.when(F.col("tenant_uuid").isNull(), F.col("logical_key")).otherwise(tenant_key(F.col("tenant_uuid"), F.col("logical_key"))),
        "storage_uri": object_uri(bucket, F.col("_key")),
    }

    def with_address(pages: DataFrame) -> DataFrame:
        for name, value in addressed.items():
            pages = pages.withColumn(name, value)
        return pages

    kept_raw = join(facts, bounds, ["run"], ["page"]).where(
        F.col("page").between(F.col("start"), F.col("last_page"))
        | ((F.col("page") == F.col("stop_page")) & F.col("fails_after_storage"))
    )
    stored = with_address(kept_raw).select(
        "run",
        "sequence",
        "page",
        "checksum_sha256",
        "size_bytes",
        F.col("n").alias("item_count"),
        (F.col("page") <= F.col("last_page")).alias("loaded_successfully"),
        "logical_key",
        "storage_uri",
    )
    # A run stores one page beyond its last at most, the one that failed after it was stored.
    beyond = kept_raw.where("page > last_page").select("run", F.col("page").alias("_beyond"))
    storing = bounds.drop("stop_page").join(beyond, "run", "left")
    bodies = join(landed.select("run", "page", "body"), storing, ["run"], ["page"]).where(
        F.col("page").between(F.col("start"), F.col("last_page")) | F.coalesce(F.col("page") == F.col("_beyond"), F.lit(False))
    )
    bodies = computed_once(_one_of_each(bodies, facts, broadcast_rows), checksum_sha256=F.sha2(F.col("body").cast("binary"), 256))
    payloads = with_address(bodies).select("run", "page", "storage_uri", F.col("body").alias("payload"))
    per_run = outcomes.select("run", "start", "last_page").join(runs.select("run", "config_id", *own_rules), "run") if own_rules else bounds.select("run", "start", "last_page")
    inside = (
        join(landed.select("run", "page", "body"), per_run, ["run"], ["page"])
        .where(F.col("page").between(F.col("start"), F.col("last_page")))
        .drop("start", "last_page")
    )
    inside = _one_of_each(inside, kept, broadcast_rows)
    parsed = computed_once(inside, _data=parse_body(F.col("body")))
    carried = ["run", *(["config_id", *own_rules] if own_rules else []), "page"]
    records = parsed.select(*carried, F.posexplode(rules.records(F.col("_data"))).alias("pos", "record"))
    columns = [c for c in carried if c not in own_rules]
    loaded = records.select(*columns, "pos", *[v.alias(c) for c, v in rules.row(F.col("record")).items()])
    return Ingestion(states=states, raw_records=stored, loaded=loaded, payloads=payloads)


def store_and_load(result: Ingestion, store: Store, table: str, batch: str) -> tuple[DataFrame, int]:
    """Write what a set of runs leaves behind: payloads to their objects, then rows to their table.

    Payloads come first, and one that can't be stored ends the pass before a row is
    loaded. Objects and the batch are taken once, so a pass that is repeated after a
    failure adds what is missing and nothing else. Gives the outcome of each payload and
    the number of rows that this call loaded.
    """
    outcomes = end_on_conflict(store_payloads(result.payloads, store, columns=["run", "page"]))
    return outcomes, load_runs(result.loaded, table, batch)
