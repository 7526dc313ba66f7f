"""Landed pages as a stream: page by page progress, replay-safe writes, live counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.functions.keys import logical_key, object_uri, tenant_key
from millrace.operators.mapping import map_records
from millrace.operators.paging import kept_pages, resume_runs, scan_outcomes
from millrace.operators.records import extract_records
from millrace.operators.scaling import computed_once, few_values, join_for, spread_join
from millrace.plans.ingestion import page_states, run_states, with_settings
from millrace.session import cut_lineage
from millrace.sources.files import remove
from millrace.sources.sinks import write_batch
from millrace.streaming.state import NAMED, VERSION, PageState


def file_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000
) -> DataFrame:
    """New parquet files below ``path`` as a stream.

    The last path letter is written as a pattern, which lets ``path`` be a
    folder of files or one file.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(pattern)
    )


def drain(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    output_mode: str = "append",
) -> StreamingQuery:
    """Feed all available input to ``handle`` in micro-batches and stop.

    Progress lies in ``checkpoint``: a restart repeats at most the batch in
    flight, under the same number.
    """
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def page_totals(pages: DataFrame) -> DataFrame:
    """Streaming counters per run; changed runs come out of every batch."""
    return pages.groupBy("run").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("n").alias("records"),
        F.max("page").alias("last_page"),
    )


def save_updates(path: str) -> Callable[[DataFrame, int], None]:
    """Handler that keeps each batch's changed rows under the batch number."""

    def handle(changed: DataFrame, batch_id: int) -> None:
        write_batch(changed, path, batch_id)

    return handle


def newest_updates(saved: DataFrame, keys: list[str]) -> DataFrame:
    """The latest saved row of each key."""
    values = [c for c in saved.columns if c not in keys and c != "batch"]
    return (
        saved.groupBy(*keys)
        .agg(F.max(F.struct("batch", *values)).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}") for c in values])
    )


def first_deliveries(pages: DataFrame) -> DataFrame:
    """Streaming dedupe: an identical page delivered again is dropped."""
    return pages.dropDuplicates(["run", "sequence", "checksum_sha256"])


def ingest_batches(
    raw_path: str,
    loaded_path: str,
    records_path: str,
    mapping: dict[str, str],
    types: dict[str, str],
    runs: DataFrame,
    strict: bool = False,
    bucket: str = "raw",
    state: PageState | None = None,
) -> Callable[[DataFrame, int], None]:
    """Handler that applies the rules of a run to pages that arrive batch by batch.

    Each batch stores what it brought first, bodies included, unless the same
    version is stored already. Then the scans of the runs it touches are decided
    anew over the versions of these runs, which are thin and lie in ``state`` by
    buckets of runs: where each run stops, and how. The pages that a run may now load
    and hasn't loaded are read from the batches that stored them, mapped and loaded,
    so that a page which came early loads once the ones before it are there, and
    nothing loads beyond an error, a terminal page or the page budget. Statuses and
    loaded pages are written beside the rows; raw facts carry the sequence, key and
    address that a page has in its run.

    So a batch reads its own pages, the state of the buckets it touches, and bodies of
    pages that waited; decisions fall on thin rows, and bodies are met by what is small
    enough to broadcast, or spread.

    All writes carry the batch number, and a batch looks at earlier ones only, so
    a replay after a failure replaces what the failed one wrote. The page that
    arrived first is a run's page, the smallest checksum first where two arrive at once;
    a later version is stored, not loaded.
    """
    state = state or PageState(f"{raw_path}/state")
    settings = cut_lineage(with_settings(runs))

    def handle(pages: DataFrame, batch_id: int) -> None:
        spark = pages.sparkSession

        def kept_aside(rows: DataFrame, name: str) -> DataFrame:
            """Thin rows of this batch, computed once: written under its number and read again."""
            path = f"{raw_path}/work/{name}"
            write_batch(rows, path, batch_id)
            return spark.read.schema(rows.schema).parquet(f"{path}/batch={batch_id}")

        judged = page_states(pages, records_path, mapping, strict, types)
        thin = kept_aside(judged.groupBy(*VERSION).agg(
            F.max("n").alias("n"), F.max("size_bytes").alias("size_bytes"), F.max("error").alias("error"),
            F.bool_or("fails_after_storage").alias("fails_after_storage"), F.count(F.lit(1)).alias("copies"),
        ), "arrived")
        buckets = state.touched(thin)
        touched = thin.select("run").distinct()
        known = state.read(spark, buckets, batch_id).join(touched, "run", "left_semi")
        new = kept_aside(thin.join(known.select(*VERSION), VERSION, "left_anti"), "new")
        open_runs = settings.join(touched, "run", "left_semi")
        came = new.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("copies"), F.lit(0)).alias("copies")).first()
        write_batch(_addressed(new.drop("copies"), open_runs, bucket), f"{raw_path}/facts", batch_id)
        write_batch(_bodies(pages, new, came.n, came.copies > 1), f"{raw_path}/bodies", batch_id)

        fields = ["n", "size_bytes", "error", "batch", "loaded"]
        arrived = new.withColumns({"batch": F.lit(batch_id).cast("bigint"), "loaded": F.lit(None).cast("bigint")})
        every = known.unionByName(arrived.select(*VERSION, *fields))
        first = every.groupBy("run", "page").agg(
            F.min(F.struct("batch", "checksum_sha256", "n", "size_bytes", "error", "loaded")).alias("_first")
        ).select("run", "page", "_first.*")
        outcomes = kept_aside(scan_outcomes(first.select("run", "page", "n", "error"), open_runs, folded=True), "outcomes")
        kept = kept_aside(kept_pages(first, outcomes), "kept")
        write_batch(run_states(outcomes, kept, open_runs), f"{loaded_path}/states", batch_id)
        fresh = kept.where("loaded IS NULL")
        size = fresh.agg(F.count(F.lit(1)).alias("n")).first().n
        if size:
            # Bodies lie by the batch that stored them; where pages of very many batches waited, all are looked at.
            waited = few_values(fresh, "batch", NAMED)
            stored = spark.read.parquet(*[f"{raw_path}/bodies{part}" for part in ([""] if waited is None else [f"/batch={k}" for k in waited])])
            ready = join_for(fresh, counted=size)(stored, fresh.select(*VERSION), VERSION, ["page"], "left_semi").select("run", "page", "body")
        else:
            ready = pages.select("run", "page", "body").where("false")
        write_batch(map_records(extract_records(ready, records_path), mapping, types), f"{loaded_path}/rows", batch_id)
        write_batch(fresh.select("run", "page"), f"{loaded_path}/pages", batch_id)
        loaded = fresh.select(*VERSION, "n", "size_bytes", "error", "batch", F.lit(batch_id).cast("bigint").alias("loaded"))
        state.write(arrived.select(*VERSION, *fields).unionByName(loaded), batch_id)
        state.merge(spark, buckets, batch_id)
        for name in ("arrived", "new", "outcomes", "kept"):
            remove(spark, f"{raw_path}/work/{name}/batch={batch_id - 1}")

    return handle


def _bodies(pages: DataFrame, new: DataFrame, size: int, repeated: bool) -> DataFrame:
    """Bodies of new versions, each once; only those that came more than once in a batch are shuffled."""
    summed = computed_once(pages.select("run", "page", "body"), checksum_sha256=F.sha2(F.col("body").cast("binary"), 256))
    told = join_for(new, counted=size)(summed, new.select(*VERSION, "copies"), VERSION, ["page"])
    single = told.where("copies = 1")
    if repeated:
        single = single.unionByName(told.where("copies > 1").dropDuplicates(VERSION))
    return single.select(*VERSION, "body")


def _addressed(facts: DataFrame, runs: DataFrame, bucket: str) -> DataFrame:
    """Raw facts with the sequence, key and address of their page; NULL for a page before its run's start."""
    started = resume_runs(runs).select("run", "config_id", "tenant_uuid", "pages_extracted", "start")
    told = spread_join(facts, started, ["run"], ["page"], "left")
    sequence = F.when(F.col("page") >= F.col("start"), F.col("pages_extracted") + F.col("page") - F.col("start") + 1)
    key = F.when(F.col("sequence").isNotNull(), logical_key(F.col("config_id"), F.col("run"), F.col("sequence"), F.col("checksum_sha256")))
    whole = F.when(F.col("tenant_uuid").isNull(), F.col("logical_key")).otherwise(tenant_key(F.col("tenant_uuid"), F.col("logical_key")))
    told = told.withColumn("sequence", sequence).withColumn("logical_key", key).withColumn("storage_uri", object_uri(bucket, whole))
    return told.drop("config_id", "tenant_uuid", "pages_extracted", "start")


def stored_pages(raw: DataFrame) -> DataFrame:
    """Raw facts of a streamed landing, each version once, in the batch that came first."""
    version = ["run", "page", "checksum_sha256"]
    return raw.groupBy(*version).agg(
        F.min("batch").alias("batch"), F.max("n").alias("n"), F.max("size_bytes").alias("size_bytes")
    )
