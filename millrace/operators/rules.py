"""How a run reads its pages: where records lie, how they map, which types columns have.

Rules are given once for all runs (:class:`FixedRules`), or lie in columns beside
each page (:class:`RowRules`), so that runs of pipelines with different settings
share one pass. Both answer the same questions with column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import as_list, is_object, literal_path, lookup, lookup_at
from millrace.operators.mapping import map_columns, mapping_problem, misfits
from millrace.operators.records import body_problem, choose_records_path, page_records

#: Destination types that a setting may name; a value of another type is taken as it is.
KINDS = ["bigint", "int", "double", "string", "boolean", "date", "timestamp", "decimal(38,9)"]

#: Settings of a pipeline as columns, as :func:`pipeline_rules` makes them.
RULE_COLUMNS = ["_path", "_fields", "_strict"]


@dataclass(frozen=True)
class FixedRules:
    """One records path, mapping and set of types for all runs."""

    records_path: str
    mapping: dict[str, str]
    types: dict[str, str] = field(default_factory=dict)
    strict: bool = False

    def unmapped(self) -> Column:
        return F.lit(not self.mapping)

    def records(self, data: Column) -> Column:
        return page_records(data, self.records_path)

    def problem(self, data: Column) -> Column:
        return body_problem(data, self.records_path)

    def unmappable(self, record: Column) -> Column:
        return mapping_problem(record, self.mapping, self.strict).isNotNull()

    def unfit(self, record: Column) -> Column:
        return misfits({c: lookup(record, p) for c, p in self.mapping.items()}, self.types)

    def row(self, record: Column) -> dict[str, Column]:
        """Destination columns; those without a type stay VARIANT."""
        mapped = map_columns(record, self.mapping)
        return {c: F.try_variant_get(v, "$", self.types[c]) if c in self.types else v for c, v in mapped.items()}


class RowRules:
    """Rules in the columns ``RULE_COLUMNS`` of the same row."""

    def unmapped(self) -> Column:
        return F.coalesce(F.size("_fields") == 0, F.lit(True))

    def _at_path(self, data: Column) -> Column:
        return lookup_at(data, F.col("_path.literal"), F.col("_path.steps"))

    def records(self, data: Column) -> Column:
        return F.coalesce(as_list(data), as_list(F.when(is_object(data), self._at_path(data))))

    def problem(self, data: Column) -> Column:
        at_path = self._at_path(data)
        return (
            F.when(data.isNull(), "invalid JSON")
            .when(as_list(data).isNotNull(), F.lit(None).cast("string"))
            .when(~is_object(data), "not an object or list")
            .when(at_path.isNull(), "records field missing")
            .when(as_list(at_path).isNull(), "records field not a list")
        )

    def unmappable(self, record: Column) -> Column:
        missing = F.exists("_fields", lambda f: lookup_at(record, f["literal"], f["steps"]).isNull())
        return ~is_object(record) | (F.col("_strict") & missing)

    def unfit(self, record: Column) -> Column:
        def refused(f: Column) -> Column:
            value = lookup_at(record, f["literal"], f["steps"])
            there = value.isNotNull() & ~F.is_variant_null(value)
            return there & ~_fits(value, f["kind"])

        return F.exists("_fields", refused)

    def row(self, record: Column) -> dict[str, Column]:
        """One column ``row``: destination columns by name; missing is NULL, null a variant null."""
        pairs = F.transform("_fields", lambda f: F.struct(f["column"], lookup_at(record, f["literal"], f["steps"])))
        return {"row": F.map_from_entries(pairs)}


Rules = FixedRules | RowRules


def _fits(value: Column, kind: Column) -> Column:
    """Whether a value becomes a column of the named type; without one of ``KINDS`` it stays as it is."""
    cases: Callable = lambda fits, k: F.when(kind == k, F.try_variant_get(value, "$", k).isNotNull()).otherwise(fits)
    return reduce(cases, KINDS, F.lit(True))


def _path(path: Column) -> Column:
    return F.struct(literal_path(path).alias("literal"), F.split(path, r"\.").alias("steps"))


def pipeline_rules(pipelines: DataFrame) -> DataFrame:
    """``config_id`` and ``RULE_COLUMNS`` of ``config_id, records_path, mapping, types, strict``.

    ``mapping`` and ``types`` are maps from column names to paths and to types. A
    pipeline without a mapping has no fields. A null records path finds no records.
    Types beyond ``KINDS`` are an error of the caller, raised when rows are read.
    """
    named = F.transform(
        F.array_sort(F.map_entries("mapping")),
        lambda e: F.struct(
            e["key"].alias("column"), literal_path(e["value"]).alias("literal"), F.split(e["value"], r"\.").alias("steps"),
            F.element_at("types", e["key"]).alias("kind"),
        ),
    )
    known = F.forall(F.map_values("types"), lambda t: t.isin(KINDS))
    fields = F.when(F.coalesce(known, F.lit(True)), F.coalesce(named, F.array())).otherwise(
        F.raise_error(F.concat(F.lit(f"types must be of {KINDS}, pipeline "), F.col("config_id").cast("string")))
    )
    return pipelines.select("config_id", _path(F.col("records_path")).alias("_path"), fields.alias("_fields"), F.coalesce("strict", F.lit(False)).alias("_strict"))


def records_paths(effective: DataFrame, config: str = "effective") -> DataFrame:
    """Merged settings (a map from keys to VARIANT) with the ``records_path`` they name."""
    return effective.withColumn("records_path", choose_records_path(F.to_variant_object(F.col(config))))
