"""Dotted-path lookups in VARIANT values that keep *missing* and *null* apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(step: str) -> str | None:
    """``step`` as a literal path key, or None where the path syntax has no spelling."""
    if not step or "?" in step:
        return None
    if "'" not in step:
        return f"['{step}']"
    return f'["{step}"]' if '"' not in step else None


def lookup(value: Column, path: str, sep: str = ".") -> Column:
    """Value at ``path``: SQL NULL when missing, a variant null when explicitly null.

    Every step is a literal object key. Arrays are never indexed.
    """
    literal = ""
    for step in path.split(sep):
        quoted = _quoted(step)
        if quoted is not None:
            literal += quoted
            continue
        if literal:
            value, literal = F.try_variant_get(value, "$" + literal, "variant"), ""
        members = F.try_variant_get(value, "$", "map<string,variant>")
        value = F.try_element_at(members, F.lit(step))
    return F.try_variant_get(value, "$" + literal, "variant") if literal else value


def literal_path(path: Column) -> Column:
    """A dotted path in a column as the text of a VARIANT path; NULL where the syntax has no spelling for a step."""
    steps = F.split(path, r"\.")
    spelled = F.forall(steps, lambda s: (s != "") & ~s.rlike("[?']"))
    return F.when(spelled, F.concat(F.lit("$['"), F.array_join(steps, "']['"), F.lit("']")))


def lookup_at(value: Column, literal: Column, steps: Column) -> Column:
    """Like :func:`lookup`, with the path in columns: its text if it has one, and its steps."""

    def member(found: Column, step: Column) -> Column:
        return F.try_element_at(F.try_variant_get(found, "$", "map<string,variant>"), step)

    return F.when(literal.isNotNull(), F.try_variant_get(value, literal, "variant")).otherwise(F.aggregate(steps, value, member))


def is_found(value: Column, path: str) -> Column:
    return lookup(value, path).isNotNull()


def is_object(value: Column) -> Column:
    """Whether a variant holds a JSON object."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def as_list(value: Column) -> Column:
    """The elements of a JSON array, NULL for any other value."""
    return F.try_variant_get(value, "$", "array<variant>")


def variant_kind(value: Column) -> Column:
    """JSON kind of a variant: object, list, string, boolean, integer, number, null.

    ``2.0`` is a number; its decimal has fewer digits than an integer that no
    longer fits 64 bits.
    """
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(name == "VOID", "null")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "list")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when((name == "BIGINT") | name.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer")
        .otherwise("number")
    )
