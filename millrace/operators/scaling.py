"""Joins, running totals and numbering that stay balanced under hot keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

#: Salts for a key at least; more where shuffles have many partitions.
LEAST_SALTS = 16
BUCKET_ROWS = 250_000
BROADCAST_ROWS = 500_000

_SALT = "_salt"
_BUCKET = "_bucket"


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    The optimizer copies a projected expression into every later expression and
    filter that names it; a costly one, such as parsing JSON, would run once per
    mention. It does not look through a generator, so the columns come out of
    one that yields a single row.
    """
    packed = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return rows.select("*", F.inline(F.array(packed)))


def spread_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Join many rows to one row per key, splitting each key over ``salts`` tasks.

    ``per_key`` is repeated once per salt, so a key holding a third of ``rows``
    is divided by ``salts`` (an eighth of the shuffle partitions unless given); ``spread_by`` must vary inside a key. ``how`` may be
    inner, left, left_semi or left_anti. Meant for a ``per_key`` side far smaller
    than ``rows``, such as one row per run against its pages; where the sides are
    of like size the repetition would cost more than the skew, and a plain join
    is left to adaptive execution. A ``per_key`` side that turns out small is
    broadcast by adaptive execution either way.
    """
    keys = list(keys)
    if salts is None:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = max(LEAST_SALTS, partitions // 8)
    salted = rows.withColumn(
        _SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    )
    copies = per_key.withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(copies, [*keys, _SALT], how).drop(_SALT)


Join = Callable[..., DataFrame]


def join_for(per_key: DataFrame, limit: int = BROADCAST_ROWS, counted: int | None = None) -> Join:
    """How to join to a materialised table of one thin row per key.

    Its rows are counted: up to ``limit`` it is broadcast, which spares the
    other side its shuffle; beyond that the join is spread. Adaptive execution
    alone would find out only after shuffling both sides. ``counted`` are its rows
    where they are known already.
    """
    if (per_key.limit(limit + 1).count() if counted is None else counted) > limit:
        return spread_join

    def small(rows, per_key, keys, spread_by, how="inner"):
        return rows.join(F.broadcast(per_key), list(keys), how)

    return small


def few_values(rows: DataFrame, column: str, most: int) -> list | None:
    """The distinct values of a column in order, if there are at most ``most``; else None. Never more reach the driver."""
    found = rows.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1)
    values = found.agg(F.sort_array(F.collect_list(column)).alias("v")).first().v
    return values if len(values) <= most else None


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column],
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Inclusive running sums per key in ``order``, never sorting a whole key at once.

    ``order`` is an integer that is unique inside a key. Each key is cut into
    ranges of ``bucket_rows`` order values; ranges are summed first, their
    totals carried forward, and only rows of one range are sorted together.
    """
    keys = list(keys)
    terms = {f"_term_{name}": expr for name, expr in sums.items()}
    cut = rows.withColumns(
        {_BUCKET: F.floor(F.col(order) / F.lit(bucket_rows)), **terms}
    )
    totals = cut.groupBy(*keys, _BUCKET).agg(
        *[F.sum(f"_term_{n}").alias(f"_total_{n}") for n in sums]
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(_BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *keys,
        _BUCKET,
        *[
            F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_carry_{n}")
            for n in sums
        ],
    )
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cut.withColumns(
        {f"_term_{n}": F.sum(f"_term_{n}").over(inside) for n in sums}
    )
    return (
        local.join(carried, [*keys, _BUCKET])
        .withColumns({n: F.col(f"_term_{n}") + F.col(f"_carry_{n}") for n in sums})
        .drop(_BUCKET, *terms, *[f"_carry_{n}" for n in sums])
    )


def number_rows(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number rows 0, 1, 2 … in a global order without a global window.

    Rows are range-partitioned on ``order`` (which must be unique, so that equal
    values cannot pile up), sorted inside partitions and materialised; the only
    single-task step adds up one count per partition. There are as many counts
    as partitions, whatever the data, so they are broadcast.
    """
    ordered = cut_lineage(
        rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    )
    low_bits = (1 << 33) - 1
    placed = ordered.withColumn("_spot", F.monotonically_increasing_id()).withColumns(
        {
            "_part": F.shiftright("_spot", 33),
            "_local": F.col("_spot").bitwiseAND(F.lit(low_bits)),
        }
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_spot", "_part", "_local", "_start")
    )
