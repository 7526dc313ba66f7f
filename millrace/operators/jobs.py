"""Migration jobs of an organization: the one shown, the stale ones, what may be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.scaling import spread_join
from millrace.schemas import ACTIVE_JOB_STATUSES, STALE_AFTER_MINUTES


def is_active() -> Column:
    return F.col("status").isin(*ACTIVE_JOB_STATUSES)


def is_stale(as_of: Column) -> Column:
    """Running without an update for longer than the threshold."""
    silence = F.expr(f"INTERVAL {STALE_AFTER_MINUTES} MINUTES")
    return (F.col("status") == "running") & (as_of - F.col("updated_at") > silence)


def shown_jobs(jobs: DataFrame) -> DataFrame:
    """Per organization its newest active job, else its newest job."""
    best = F.max(F.struct(is_active().alias("active"), "created_at", "job_id", "status"))
    return jobs.groupBy("org_id").agg(best.alias("_shown")).select("org_id", "_shown.*")


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Per organization the active job a submission gets back, and how many there are.

    More than one is a violation.
    """
    newest = F.max(F.struct("created_at", "job_id"))
    return (
        jobs.where(is_active())
        .groupBy("org_id")
        .agg(newest["job_id"].alias("job_id"), F.count(F.lit(1)).alias("active_jobs"))
        .withColumn("violation", F.col("active_jobs") > 1)
    )


def stale_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.where(is_stale(as_of))


def job_actions(jobs: DataFrame, as_of: Column) -> DataFrame:
    """What a retry and a cancel of each job would do.

    A retry of a live running job is refused; a stale one is cancelled first.
    Any other active job of the organization is returned instead of a new one.
    """
    counts = active_jobs(jobs).select("org_id", "active_jobs")
    known = spread_join(jobs, counts, ["org_id"], ["job_id"], how="left")
    stale = is_stale(as_of)
    own = F.when(stale, 1).otherwise(0)
    others = F.coalesce("active_jobs", F.lit(0)) - own
    return known.withColumns(
        {
            "stale": stale,
            "retry": F.when((F.col("status") == "running") & ~stale, "refused")
            .when(others > 0, F.when(stale, "cancelled, existing").otherwise("existing"))
            .otherwise(F.when(stale, "cancelled, new").otherwise("new")),
            "cancel": F.when(is_active(), "requested").otherwise("refused"),
        }
    ).drop("active_jobs")


def _moment(value: Column) -> Column:
    """A UTC moment as text, without a fraction when it has none."""
    whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    fraction = F.date_format(value, ".SSSSSS")
    text = F.concat(
        whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00")
    )
    return F.coalesce(text, F.lit("-"))


def export_jobs(jobs: DataFrame) -> DataFrame:
    """A plain-text summary of each job, lines in a fixed order."""
    display = F.concat(
        F.upper(F.left("status", F.lit(1))),
        F.replace(F.expr("substr(status, 2)"), F.lit("_"), F.lit(" ")),
    )
    lines = [
        F.concat(F.lit("Raw payload migration job "), F.col("job_id").cast("string")),
        F.concat(F.lit("Organization: "), "name", F.lit(" ("), "schema_name", F.lit(")")),
        F.concat(F.lit("Mode: "), F.when(F.col("dry_run"), "dry-run").otherwise("migration")),
        F.concat(F.lit("Status: "), display),
        F.concat(F.lit("Started: "), _moment(F.col("started_at"))),
        F.concat(F.lit("Finished: "), _moment(F.col("finished_at"))),
        F.lit(""),
    ]
    # --- fixed values: labels of the counter lines ---
    labels = {
        "Records inspected:   ": "records_inspected",
        "Already migrated:    ": "already_migrated",
        "Legacy unprefixed:   ": "legacy_unprefixed",
        "Schema-prefixed:     ": "schema_prefixed",
        "Missing objects:     ": "missing_objects",
        "Checksum conflicts:  ": "checksum_conflicts",
        "Ready for migration: ": "ready_for_migration",
        "Records migrated:    ": "records_migrated",
        "Records skipped:     ": "records_skipped",
    }
    lines += [F.concat(F.lit(t), F.col(c).cast("string")) for t, c in labels.items()]
    error = F.when(
        F.col("error_message") != "", F.concat(F.lit("\n\nError: "), "error_message")
    )
    body = F.concat(F.concat_ws("\n", *lines), F.coalesce(error, F.lit("")), F.lit("\n"))
    return jobs.withColumn("summary", body)
