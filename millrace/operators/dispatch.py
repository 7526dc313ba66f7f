"""Run requests: idempotent triggering and its refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.runs import is_continuable


def request_problems(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Why a request is refused before its key is looked at.

    ``runs`` gives the state of runs that a request may continue from.
    """
    sources = runs.select(
        F.col("run_id").alias("continue_from"),
        F.col("config_id").alias("_source_config"),
        is_continuable().alias("_continuable"),
    )
    continues = F.col("continue_from").isNotNull()
    # Requests that continue nothing need no lookup and stay out of the join.
    plain = requests.where(~continues).withColumns(
        {"_source_config": F.lit(None).cast("bigint"), "_continuable": F.lit(None).cast("boolean")}
    )
    looked_up = requests.where(continues).join(sources, "continue_from", "left")
    problem = F.when(~F.col("is_active"), "inactive")
    problem = (
        problem.when(continues & F.col("_source_config").isNull(), "unknown run")
        .when(continues & (F.col("_source_config") != F.col("config_id")), "other configuration")
        .when(continues & ~F.col("_continuable"), "not continuable")
    )
    return (
        plain.unionByName(looked_up)
        .withColumn("problem", problem)
        .drop("_source_config", "_continuable")
    )


def trigger_outcomes(requests: DataFrame, runs: DataFrame, claims: DataFrame) -> DataFrame:
    """Which requests create a run, reuse one or are refused.

    The first sound request per key creates; a later one with the same
    configuration reuses that run and is dispatched again only while the run is
    unclaimed; another configuration is refused. A request without key always
    creates. ``claims`` holds ``request_id`` of creating requests and the
    request order at which their run was claimed.
    """
    checked = request_problems(requests, runs)
    keyed = F.col("problem").isNull() & F.coalesce(F.col("idempotency_key") != "", F.lit(False))
    firsts = (
        checked.where(keyed)
        .groupBy("idempotency_key")
        .agg(F.min(F.struct("request_id", "config_id")).alias("_first"))
        .select(F.concat(F.lit("k"), "idempotency_key").alias("_key"), "_first")
    )
    # Requests outside the key rule get a key of their own that matches nothing:
    # a shared NULL would gather them in one task.
    own_key = F.concat(F.lit("r"), F.col("request_id").cast("string"))
    placed = checked.withColumn(
        "_key", F.when(keyed, F.concat(F.lit("k"), "idempotency_key")).otherwise(own_key)
    )
    matched = placed.join(firsts, "_key", "left").select(
        "request_id",
        "config_id",
        "problem",
        F.col("_first.config_id").alias("_owner"),
        F.coalesce("_first.request_id", "request_id").alias("created_by"),
    )
    claimed = claims.select(F.col("request_id").alias("created_by"), "claimed_order")
    judged = matched.join(claimed, "created_by", "left")
    is_first = F.col("created_by") == F.col("request_id")
    clash = F.coalesce(F.col("_owner") != F.col("config_id"), F.lit(False))
    problem = F.when(clash, "key of another configuration").otherwise(F.col("problem"))
    pending = F.coalesce(F.col("claimed_order") > F.col("request_id"), F.lit(True))
    sound = problem.isNull()
    return judged.select(
        "request_id",
        F.when(~sound, "refused").when(is_first, "created").otherwise("reused").alias("outcome"),
        F.when(sound, F.col("created_by")).alias("created_by"),
        (sound & (is_first | pending)).alias("dispatched"),
        problem.alias("problem"),
    )
