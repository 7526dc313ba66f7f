"""Loading mapped rows: request checks, column checks, batches and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.paths import lookup, variant_kind
from millrace.operators.scaling import computed_once
from millrace.schemas import DEFAULT_DESTINATION_SCHEMA, DEFAULT_LOAD_BATCH, IDENTIFIER_PATTERN


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike("(?d)" + IDENTIFIER_PATTERN), F.lit(False))


def _text_setting(config: Column, key: str) -> Column:
    value = lookup(config, key)
    return F.when(variant_kind(value) == "string", value.cast("string"))


def destination_tables(columns: DataFrame) -> DataFrame:
    """One row per table with its known columns, sorted."""
    return columns.groupBy("schema_name", "table_name").agg(
        F.sort_array(F.collect_set("column_name")).alias("known_columns")
    )


def audit_requests(requests: DataFrame, tables: DataFrame) -> DataFrame:
    """First failed check of each load request, in the order a load makes them.

    ``requests``: ``load_id, mode, n_records, config, record_columns``;
    ``tables``: ``schema_name, table_name, known_columns``. An empty load stops
    after the mode check and touches nothing.
    """
    requests = computed_once(requests, _config=F.try_parse_json("config"))
    config = F.col("_config")
    schema_set = lookup(config, "schema_name").isNotNull()
    table_set = lookup(config, "table_name").isNotNull()
    size = lookup(config, "batch_size")
    size_ok = size.isNull() | F.coalesce(
        (variant_kind(size) == "integer") & (F.try_variant_get(size, "$", "double") >= 1),
        F.lit(False),
    )
    named = requests.withColumns(
        {
            "schema_name": F.when(
                schema_set, _text_setting(config, "schema_name")
            ).otherwise(DEFAULT_DESTINATION_SCHEMA),
            "table_name": _text_setting(config, "table_name"),
            "_table_set": table_set,
            "_size_ok": size_ok,
        }
    )
    joined = named.join(tables, ["schema_name", "table_name"], "left").withColumn(
        "unknown_columns",
        F.array_except(F.array_sort(F.array_distinct("record_columns")), "known_columns"),
    )
    problem = (
        F.when(F.col("mode") != "append", "mode")
        .when(F.col("n_records") == 0, "empty")
        .when(~is_identifier(F.col("schema_name")), "schema_name")
        .when(~F.col("_table_set"), "table_name unset")
        .when(~is_identifier(F.col("table_name")), "table_name")
        .when(~F.col("_size_ok"), "batch_size")
        .when(F.col("known_columns").isNull(), "no such table")
        .when(F.size("unknown_columns") > 0, "unknown columns")
    )
    category = (
        F.when(F.col("problem") == "mode", "UnsupportedCapability")
        .when(F.col("problem").isin("schema_name", "table_name", "batch_size"), "ConfigurationError")
        .when(F.col("problem") == "table_name unset", "UnexpectedError")
        .when(F.col("problem").isin("no such table", "unknown columns"), "SchemaMismatchError")
    )
    return (
        joined.withColumn("problem", problem)
        .withColumns(
            {
                "category": category,
                "loaded": F.when(F.col("problem").isNull(), F.col("n_records"))
                .when(F.col("problem") == "empty", 0)
                .cast("bigint"),
            }
        )
        .drop("_config", "_table_set", "_size_ok")
    )


def check_columns(request_columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns of each load that its table lacks; missing table or columns is a mismatch.

    Distinct column names are folded before grouping, so the collected set is
    never larger than the width of the rows.
    """
    keys = ["load_id", "schema_name", "table_name"]
    used = (
        request_columns.select(*keys, "column")
        .distinct()
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("column")).alias("columns"))
    )
    unknown = F.array_except("columns", "known_columns")
    return used.join(tables, ["schema_name", "table_name"], "left").select(
        *keys,
        F.col("known_columns").isNotNull().alias("table_exists"),
        F.array_join(unknown, ", ").alias("unknown_columns"),
        F.array_join("known_columns", ", ").alias("known_columns"),
        F.when(
            F.col("known_columns").isNull() | (F.size(unknown) > 0), "SchemaMismatchError"
        ).alias("category"),
    )


def load_batches(rows: DataFrame, batch_size: int = DEFAULT_LOAD_BATCH) -> DataFrame:
    """Insert batches of each page: number and size, the last one possibly short."""
    return (
        rows.withColumn("batch", F.floor(F.col("pos") / batch_size).cast("bigint"))
        .groupBy("run", "page", "batch")
        .agg(F.count(F.lit(1)).alias("batch_rows"))
    )


def duplicate_exposure(loaded: DataFrame, keys: list[str]) -> DataFrame:
    """Keys loaded more than once."""
    return loaded.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def keep_first(loaded: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first loaded row of each key in load order.

    Every task keeps its first row of a key before the shuffle, so a key with
    many copies never reaches one task as a whole. Rows that tie in ``order`` are
    told apart by their other columns, as far as those have an order; VARIANT and
    map columns are carried along.
    """
    unordered = ("variant", "map")
    rest = [f.name for f in loaded.schema if f.name not in [*keys, *order] and f.dataType.typeName() not in unordered]
    first = Window.partitionBy(*keys).orderBy(*order, *rest)
    return loaded.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")
