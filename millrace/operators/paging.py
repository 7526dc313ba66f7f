"""Page scans: where a scan starts, where it stops, and which pages it keeps.

Inputs are thin page facts, one row per landed page of a run:
``run, page, n`` and an optional ``error`` category; and one row per run of
settings: ``run, start_page, page_size, max_pages, cursor, retain_empty``.
Bodies stay out of these joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.scaling import Join, number_rows, spread_join
from millrace.schemas import CONTINUABLE_ERROR, DEFAULT_MAX_PAGES, DEFAULT_START_PAGE

_INTEGER_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def resume_page(cursor: Column, start_page: Column) -> Column:
    """First page to read; NULL when the saved cursor is not an integer."""
    digits = F.trim(F.regexp_replace(cursor, r"[_\s]", ""))
    return (
        F.when(
            cursor.isNull() | (cursor == ""),
            F.coalesce(start_page, F.lit(DEFAULT_START_PAGE)).cast("bigint"),
        )
        .when(cursor.rlike(_INTEGER_TEXT), digits.try_cast("bigint"))
    )


def cut_pages(rows: DataFrame, key: str, page_size: int, start_page: int = 1) -> DataFrame:
    """Add the page number of each row from a key that is dense from 0."""
    return rows.withColumn(
        "page", F.floor(F.col(key) / F.lit(page_size)).cast("bigint") + F.lit(start_page)
    )


def cut_pages_by_order(
    rows: DataFrame, order: list[str], page_size: int, start_page: int = 1
) -> DataFrame:
    """Add page numbers in a unique order when no dense key exists."""
    return cut_pages(number_rows(rows, order, "_position"), "_position", page_size, start_page).drop(
        "_position"
    )


def resume_runs(runs: DataFrame) -> DataFrame:
    """Per run: the first page to read and whether its cursor is unusable."""
    return runs.withColumn(
        "start", resume_page(F.col("cursor"), F.col("start_page"))
    ).withColumn("bad_cursor", F.col("start").isNull())


def pages_from_resume(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Landed pages at or after each run's resume page, with the run settings."""
    started = resume_runs(runs).where(~F.col("bad_cursor"))
    return spread_join(pages, started, ["run"], ["page"]).where("page >= start")


def first_versions(pages: DataFrame) -> DataFrame:
    """One row per run and page: the version that came first, and how many rows landed as ``copies``.

    First is the smallest ``arrival`` where there is one, then the smallest
    ``checksum_sha256``, then the other columns; copies of a page combine before
    the shuffle, so a page that landed very often is no hot key.
    """
    keys = ["run", "page"]
    rest = [c for c in pages.columns if c not in keys]
    ordered = sorted(rest, key=lambda c: {"arrival": 0, "checksum_sha256": 1}.get(c, 2))
    folded = pages.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_first"), F.count(F.lit(1)).alias("copies"))
    return folded.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest], "copies")


def _is_terminal(n: Column, page_size: Column) -> Column:
    return (n == 0) | F.coalesce(n < page_size, F.lit(False))


def _first_gaps(read: DataFrame, broken: DataFrame) -> DataFrame:
    """First page at or after ``start`` that never landed, for runs with a hole."""
    holed = spread_join(read, broken.select("run"), ["run"], ["page"], how="left_semi")
    landed = holed.select(
        "run",
        F.explode(
            F.array(
                F.struct(F.col("page").alias("page"), F.lit(True).alias("here")),
                F.struct((F.col("page") + 1).alias("page"), F.lit(False).alias("here")),
                F.struct(F.col("start").alias("page"), F.lit(False).alias("here")),
            )
        ).alias("spot"),
    )
    return (
        landed.groupBy("run", "spot.page")
        .agg(F.bool_or("spot.here").alias("here"))
        .where(~F.col("here"))
        .groupBy("run")
        .agg(F.min("page").alias("hole"))
    )


def scan_outcomes(pages: DataFrame, runs: DataFrame, folded: bool = False) -> DataFrame:
    """One row per run: how its scan ends and the last page it processes.

    A page that landed more than once counts once, as its first version
    (:func:`first_versions`; done already for ``folded`` pages).

    The stopping point is the first error, terminal page or missing page at or
    after the resume page; the page budget counts from the resume page, so a
    stop beyond it is a page-limit failure. An error wins a tie.

    One numeric aggregate per run finds all stops; runs whose pages are
    consecutive, known from count and maximum, need no search for a hole.
    """
    if "error" not in pages.columns:
        pages = pages.withColumn("error", F.lit(None).cast("string"))
    started = resume_runs(runs)
    if not folded:
        seen = [c for c in ("arrival", "checksum_sha256") if c in pages.columns]
        pages = first_versions(pages.select("run", "page", "n", "error", *seen))
    read = pages_from_resume(
        pages.select("run", "page", "n", "error"),
        runs.select("run", "start_page", "page_size", "cursor"),
    )
    fails = F.col("error").isNotNull()
    ends = ~fails & _is_terminal(F.col("n"), F.col("page_size"))
    stops = read.groupBy("run").agg(
        F.min(F.when(fails, F.col("page"))).alias("error_page"),
        F.min(F.when(ends, F.col("page"))).alias("terminal_page"),
        F.min(F.when(ends & (F.col("n") == 0), F.col("page"))).alias("empty_page"),
        F.max("page").alias("top_page"),
        (F.max("page") - F.max("start") + 1 == F.count(F.lit(1))).alias("consecutive"),
    )
    categories = (
        read.where(fails).groupBy("run").agg(F.min(F.struct("page", "error")).alias("first_error"))
    )
    holes = _first_gaps(read, stops.where(~F.col("consecutive")))
    gap_page = F.when(F.col("top_page").isNull(), F.col("start")).otherwise(
        F.coalesce(F.col("hole"), F.col("top_page") + 1)
    )
    facts = (
        started.join(stops, "run", "left")
        .join(categories, "run", "left")
        .join(holes, "run", "left")
        .withColumns(
            {
                "limit_page": F.col("start")
                + F.coalesce(F.col("max_pages"), F.lit(DEFAULT_MAX_PAGES))
                - 1,
                "gap_page": gap_page,
                "error_category": F.col("first_error.error"),
                "retain_empty": F.coalesce("retain_empty", F.lit(False)),
            }
        )
        .withColumn("stop_page", F.least("error_page", "terminal_page", "gap_page"))
    )
    outcome = (
        F.when(F.col("bad_cursor"), "failed")
        .when(F.col("stop_page") > F.col("limit_page"), "failed")
        .when(F.col("stop_page") == F.col("error_page"), "failed")
        .when(F.col("stop_page") == F.col("terminal_page"), "succeeded")
        .otherwise("incomplete")
    )
    category = (
        F.when(F.col("bad_cursor"), "UnexpectedError")
        .when(F.col("stop_page") > F.col("limit_page"), CONTINUABLE_ERROR)
        .when(F.col("stop_page") == F.col("error_page"), F.col("error_category"))
    )
    drops_terminal = F.coalesce(
        F.col("empty_page") == F.col("terminal_page"), F.lit(False)
    ) & ~F.col("retain_empty")
    last = (
        F.when(F.col("stop_page") > F.col("limit_page"), F.col("limit_page"))
        .when(F.col("stop_page") == F.col("error_page"), F.col("stop_page") - 1)
        .when(
            F.col("stop_page") == F.col("terminal_page"),
            F.col("stop_page") - F.when(drops_terminal, 1).otherwise(0),
        )
        .otherwise(F.col("stop_page") - 1)
    )
    return facts.select(
        "run",
        "start",
        "page_size",
        "limit_page",
        "terminal_page",
        outcome.alias("outcome"),
        category.alias("category"),
        last.alias("last_page"),
        F.when(F.col("stop_page") <= F.col("limit_page"), F.col("stop_page")).alias("stop_page"),
    )


def kept_pages(pages: DataFrame, outcomes: DataFrame, join: Join = spread_join) -> DataFrame:
    """Pages a scan yields, with the cursor used and the next cursor; one row in per run and page."""
    bounds = outcomes.select("run", "start", "last_page", "page_size")
    inside = join(pages, bounds, ["run"], ["page"]).where(
        F.col("page").between(F.col("start"), F.col("last_page"))
    )
    last_of_source = _is_terminal(F.col("n"), F.col("page_size"))
    return inside.withColumns(
        {
            "cursor_used": F.col("page").cast("string"),
            "next_cursor": F.when(~last_of_source, (F.col("page") + 1).cast("string")),
        }
    ).drop("start", "last_page", "page_size")


def terminal_pages(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """First empty or short page per run."""
    read = pages_from_resume(pages, runs)
    return read.groupBy("run").agg(
        F.min(
            F.when(_is_terminal(F.col("n"), F.col("page_size")), F.col("page"))
        ).alias("terminal_page"),
        F.count(F.lit(1)).alias("landed_pages"),
    )
