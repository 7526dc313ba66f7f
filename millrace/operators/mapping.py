"""Mapping records to destination columns: one source path per column, nothing more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import is_object, lookup
from millrace.operators.scaling import computed_once


def map_columns(record: Column, mapping: dict[str, str]) -> dict[str, Column]:
    """Destination columns as VARIANT: missing is SQL NULL, null is a variant null."""
    return {column: lookup(record, path) for column, path in mapping.items()}


def map_records(
    records: DataFrame,
    mapping: dict[str, str],
    types: dict[str, str] | None = None,
    record: str = "record",
) -> DataFrame:
    """Permissive mapping of every record; other columns are carried along.

    ``types`` casts destination columns on the way; the rest stay VARIANT.
    """
    types = types or {}
    mapped = map_columns(F.col(record), mapping)
    typed = [
        (F.try_variant_get(value, "$", types[c]) if c in types else value).alias(c)
        for c, value in mapped.items()
    ]
    return records.select(*[c for c in records.columns if c != record], *typed)


def misfits(values: dict[str, Column], types: dict[str, str]) -> Column:
    """Whether a value is there but can't become its column's type.

    Missing and null values fit every column. A destination refuses such a
    record, so its page fails to load; it is never loaded as NULL.
    """
    unfit = F.lit(False)
    for column, kind in types.items():
        if column in values:
            value = values[column]
            there = value.isNotNull() & ~F.is_variant_null(value)
            unfit = unfit | (there & F.try_variant_get(value, "$", kind).isNull())
    return unfit


def type_failures(
    records: DataFrame, mapping: dict[str, str], types: dict[str, str], record: str = "record"
) -> DataFrame:
    """Pages that hold a value which doesn't fit its column, with the first such record."""
    unfit = misfits(map_columns(F.col(record), mapping), types)
    return (
        computed_once(records, _unfit=unfit)
        .where("_unfit")
        .groupBy("run", "page")
        .agg(F.count(F.lit(1)).alias("bad_records"), F.min("pos").alias("first_pos"))
        .withColumn("category", F.lit("LoadFailed"))
    )


def mapping_problem(record: Column, mapping: dict[str, str], strict: bool) -> Column:
    """Why a record cannot be mapped, NULL when it can."""
    problem = F.when(~is_object(record), "not an object")
    if strict:
        for column, path in mapping.items():
            problem = problem.when(
                lookup(record, path).isNull(), f"missing {path} for {column}"
            )
    return problem


def mapping_failures(
    records: DataFrame, mapping: dict[str, str], strict: bool, record: str = "record"
) -> DataFrame:
    """Pages that hold a record which cannot be mapped, with the first such record."""
    judged = computed_once(records, problem=mapping_problem(F.col(record), mapping, strict))
    return (
        judged.select("run", "page", "pos", "problem")
        .where(F.col("problem").isNotNull())
        .groupBy("run", "page")
        .agg(
            F.count(F.lit(1)).alias("bad_records"),
            F.min(F.struct("pos", "problem")).alias("_first"),
        )
        .select(
            "run",
            "page",
            "bad_records",
            F.col("_first.pos").alias("first_pos"),
            F.col("_first.problem").alias("first_problem"),
        )
    )


def unmapped(configs: DataFrame, mapping: str = "mapping") -> DataFrame:
    """Configurations that must fail before any fetch, having no mapping."""
    return configs.where(F.col(mapping).isNull() | (F.size(mapping) == 0)).withColumn(
        "category", F.lit("MappingError")
    )
