"""Run state over history and event tables: counters, claims, attempts, continuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.outcomes import is_final
from millrace.operators.scaling import running_totals, spread_join
from millrace.schemas import CONTINUABLE_ERROR, ERROR_CLASSES, RECENT_RUNS, UNEXPECTED_ERROR
from millrace.session import cut_lineage

COUNTERS = ["pages_extracted", "records_extracted", "records_loaded", "raw_payload_count"]


# --- counters and cursors ---------------------------------------------------


def number_pages(kept: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sequence numbers of processed pages, continuing each run's saved count.

    Processed pages are consecutive from ``start``, so no window is needed.
    """
    return spread_join(kept, seeds, ["run"], ["page"]).withColumn(
        "sequence", F.col("pages_extracted") + F.col("page") - F.col("start") + 1
    )


def saved_cursor(next_cursor: Column, cursor_used: Column) -> Column:
    return F.coalesce(F.nullif(next_cursor, F.lit("")), cursor_used)


def run_counters(pages: DataFrame) -> DataFrame:
    """Counters and cursor of each run after its last processed page."""
    cursor = saved_cursor(F.col("next_cursor"), F.col("cursor_used"))
    return pages.groupBy("run").agg(
        F.count(F.lit(1)).alias("pages_extracted"),
        F.sum("n").alias("records_extracted"),
        F.sum("loaded").alias("records_loaded"),
        F.count(F.lit(1)).alias("raw_payload_count"),
        F.max(F.struct("page", cursor.alias("cursor")))["cursor"].alias("last_successful_cursor"),
    )


def run_progress(pages: DataFrame) -> DataFrame:
    """Counters after every processed page."""
    return running_totals(
        pages,
        ["run"],
        "page",
        {
            "pages_extracted": F.lit(1),
            "records_extracted": F.col("n"),
            "records_loaded": F.col("loaded"),
        },
    )


# --- claims and transitions --------------------------------------------------


def _claim_bounds(events: DataFrame) -> DataFrame:
    """Per run: its owner, its first claim and the finish that settles it."""
    claim = F.col("kind") == "claim"
    firsts = events.groupBy("run").agg(
        F.min(F.when(claim, F.struct("seq", "task"))).alias("first")
    )
    finishes = (
        events.where(~claim)
        .select("run", "seq")
        .join(firsts, "run")
        .where(F.col("seq") > F.col("first.seq"))
    )
    settled = finishes.groupBy("run").agg(F.min("seq").alias("settled_by"))
    return firsts.join(settled, "run", "left").select(
        "run",
        F.col("first.seq").alias("first_claim"),
        F.col("first.task").alias("owner"),
        "settled_by",
    )


def claim_outcomes(events: DataFrame, known_runs: DataFrame | None = None) -> DataFrame:
    """Which claims win, which attempt they start, and why the others lose.

    A run belongs to the task of its first claim until its first finish after
    that; a settled run never reopens.
    """
    bounds = _claim_bounds(events)
    if known_runs is not None:
        known = known_runs.select("run", F.lit(True).alias("_known")).distinct()
        bounds = bounds.join(known, "run", "left")
    claims = events.where("kind = 'claim'").join(bounds, "run")
    reason = F.when(F.col("settled_by") < F.col("seq"), "finished").when(
        ~F.col("task").eqNullSafe(F.col("owner")), "owned by another task"
    )
    if known_runs is not None:
        reason = F.when(F.col("_known").isNull(), "not found").otherwise(reason)
    judged = claims.withColumn("reason", reason).withColumn(
        "accepted", F.col("reason").isNull()
    )
    counted = running_totals(
        judged, ["run"], "seq", {"attempt": F.col("accepted").cast("bigint")}
    )
    return counted.select(
        "run",
        "seq",
        "task",
        "accepted",
        F.when(F.col("accepted"), F.col("attempt")).alias("attempt"),
        (F.col("seq") == F.col("first_claim")).alias("starts_run"),
        "reason",
    )


def invalid_transitions(events: DataFrame) -> DataFrame:
    """Finishes of runs that were not running at that moment."""
    finishes = events.where("kind <> 'claim'")
    judged = finishes.join(_claim_bounds(events), "run")
    status_before = F.when(F.col("settled_by") < F.col("seq"), "settled").otherwise("pending")
    return judged.where(~F.col("seq").eqNullSafe(F.col("settled_by"))).select(
        "run", "seq", "kind", status_before.alias("from_status"),
        F.lit("InvalidRunTransition").alias("category"),
    )


def latest_status(changes: DataFrame) -> DataFrame:
    """Current status of each run from its change log."""
    return changes.groupBy("run").agg(
        F.max(F.struct("seq", "status", "changed_at")).alias("_last"),
        F.count(F.lit(1)).alias("changes"),
    ).select("run", "_last.status", "_last.changed_at", "changes")


# --- attempts ------------------------------------------------------------------


def retry_decisions(attempts: DataFrame) -> DataFrame:
    """Whether a failed attempt settles its run or is tried again."""
    failed = F.col("category").isNotNull()
    final = is_final(F.col("attempt"), F.col("retryable"))
    return attempts.withColumn(
        "decision",
        F.when(~failed, "succeed").when(final, "fail").otherwise("retry"),
    )


def attempt_history(attempts: DataFrame) -> DataFrame:
    """One row per attempt that took place.

    Attempts after the settling one never happened. A failed attempt that is
    retried keeps the status running and no finish time.
    """
    decided = retry_decisions(attempts)
    settled = decided.groupBy("run").agg(
        F.min(F.when(F.col("decision") != "retry", F.col("attempt"))).alias("settled_at")
    )
    happened = decided.join(settled, "run").where(
        F.col("settled_at").isNull() | (F.col("attempt") <= F.col("settled_at"))
    )
    status = (
        F.when(F.col("decision") == "succeed", "succeeded")
        .when(F.col("decision") == "fail", "failed")
        .otherwise("running")
    )
    return happened.withColumns(
        {"status": status, "has_finish": F.col("decision") != "retry"}
    ).drop("settled_at", "decision")


def latest_attempts(history: DataFrame) -> DataFrame:
    """The last attempt of each run and the run status it leaves behind."""
    return history.groupBy("run").agg(
        F.max(F.struct("attempt", "status", "category")).alias("_last")
    ).select("run", "_last.attempt", "_last.status", "_last.category")


def classify_errors(errors: DataFrame, category: str = "category") -> DataFrame:
    """Fold unknown categories and state whether a retry is ever allowed."""
    known = F.create_map(
        *[
            part
            for name, retryable in ERROR_CLASSES.items()
            for part in (F.lit(name), F.lit(retryable).cast("boolean"))
        ]
    )
    is_known = F.col(category).isin(*ERROR_CLASSES)
    fixed = F.when(is_known, F.try_element_at(known, F.col(category))).otherwise(False)
    return errors.withColumns(
        {
            "folded_category": F.when(
                F.col(category).isNotNull(),
                F.when(is_known, F.col(category)).otherwise(UNEXPECTED_ERROR),
            ),
            "fixed_retryable": F.when(F.col(category).isNotNull(), fixed),
        }
    )


# --- continuations ---------------------------------------------------------------


def is_continuable() -> Column:
    """Only a page-limit failure carries a safe resume point."""
    return (F.col("status") == "failed") & F.coalesce(
        F.col("error_category") == CONTINUABLE_ERROR, F.lit(False)
    )


def continuable_runs(runs: DataFrame) -> DataFrame:
    return runs.where(is_continuable())


def continuation_seeds(runs: DataFrame) -> DataFrame:
    """What a continuing run starts with; it is linked to its source and unattempted."""
    return continuable_runs(runs).select(
        F.col("run_id").alias("continued_from"),
        "config_id",
        "last_successful_cursor",
        *COUNTERS,
        F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("attempt"),
    )


def children(runs: DataFrame) -> DataFrame:
    """First continuation of each run that has one."""
    return (
        runs.where("continued_from IS NOT NULL")
        .groupBy(F.col("continued_from").alias("run_id"))
        .agg(F.min("run_id").alias("child_run"))
    )


def open_continuations(runs: DataFrame) -> DataFrame:
    """Continuable runs nobody has continued yet."""
    return continuable_runs(runs).join(children(runs).select("run_id"), "run_id", "left_anti")


def continuation_lineage(runs: DataFrame) -> DataFrame:
    """First run of every continuation chain and how far each run is from it.

    Pointer doubling: every round joins each unfinished link to the link of the
    run it points at, so a chain of any length takes its logarithm in rounds.
    What is still open when the longest possible chain would have ended runs in a
    circle: it has no first run, and both columns are NULL. Each round is
    materialised in the checkpoint folder.
    """
    links = runs.where("continued_from IS NOT NULL").select(
        "run_id", F.col("continued_from").alias("root_run"), F.lit(1).cast("bigint").alias("depth"),
        F.lit(True).alias("open"),
    )
    state = cut_lineage(links)
    rounds = state.count().bit_length() + 1
    while rounds and not state.where("open").isEmpty():
        rounds -= 1
        ahead = state.select(
            F.col("run_id").alias("root_run"),
            F.col("root_run").alias("_root"),
            F.col("depth").alias("_depth"),
        )
        moved = state.where("open").join(ahead, "root_run", "left").select(
            "run_id",
            F.coalesce("_root", "root_run").alias("root_run"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.col("_root").isNotNull().alias("open"),
        )
        state = cut_lineage(state.where("NOT open").unionByName(moved))
    return (
        runs.select("run_id")
        .join(state, "run_id", "left")
        .select(
            "run_id",
            F.when(~F.coalesce("open", F.lit(False)), F.coalesce("root_run", "run_id")).alias("root_run"),
            F.when(~F.coalesce("open", F.lit(False)), F.coalesce("depth", F.lit(0))).alias("depth"),
        )
    )


def recent_runs(runs: DataFrame, limit: int = RECENT_RUNS) -> DataFrame:
    """Newest runs of each configuration; Spark cuts to ``limit`` before the shuffle."""
    newest = Window.partitionBy("config_id").orderBy(F.col("created_at").desc(), "run_id")
    return runs.withColumn("position", F.row_number().over(newest)).where(
        F.col("position") <= limit
    )


def run_details(runs: DataFrame, configs: DataFrame, connections: DataFrame) -> DataFrame:
    """Runs with configuration, both connections and continuation state."""
    ends = connections.select("connection_id", "name")
    sources = ends.toDF("source_connection", "source_name")
    destinations = ends.toDF("destination_connection", "destination_name")
    described = configs.join(sources, "source_connection", "left").join(
        destinations, "destination_connection", "left"
    )
    return (
        runs.join(described, "config_id")
        .join(children(runs), "run_id", "left")
        .withColumn("continuable", is_continuable())
        .withColumn("offer_continue", F.col("continuable") & F.col("child_run").isNull())
    )


def raw_not_loaded(raw_records: DataFrame, loaded_pages: DataFrame) -> DataFrame:
    """Stored pages whose records never reached the destination."""
    return raw_records.join(
        loaded_pages.select("run", "sequence").distinct(), ["run", "sequence"], "left_anti"
    )
