"""Source configuration: audit, merge and connector lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import lookup, variant_kind
from millrace.operators.scaling import computed_once
from millrace.schemas import ALLOWED_METHODS, CONNECTORS, UNEXPECTED_ERROR


def _is_truthy(value: Column) -> Column:
    """Neither missing nor null, empty, zero or false."""
    text = value.cast("string")
    kind = variant_kind(value)
    return (
        F.when(value.isNull() | (kind == "null"), False)
        .when(kind == "boolean", text == "true")
        .when(kind.isin("integer", "number"), text.try_cast("double") != 0)
        .otherwise(~text.isin("", "[]", "{}"))
    )


def _positive(value: Column, kinds: list[str], default_ok: bool = True) -> Column:
    number = F.try_variant_get(value, "$", "double")
    good = variant_kind(value).isin(*kinds) & (number > 0)
    return F.when(value.isNull(), default_ok).otherwise(F.coalesce(good, F.lit(False)))


def config_problem(config: Column) -> Column:
    """First failed rule of a source configuration, NULL when it is sound."""
    method = lookup(config, "method")
    method_text = F.upper(F.try_variant_get(method, "$", "string"))
    return (
        F.when(~_is_truthy(lookup(config, "base_url")), "base_url")
        .when(~_is_truthy(lookup(config, "path")), "path")
        .when(
            method.isNotNull() & ~F.coalesce(method_text.isin(ALLOWED_METHODS), F.lit(False)),
            "method",
        )
        .when(~_positive(lookup(config, "max_pages"), ["integer"]), "max_pages")
        .when(~_positive(lookup(config, "start_page"), ["integer"]), "start_page")
        .when(
            ~_positive(lookup(config, "timeout_seconds"), ["integer", "number"]),
            "timeout_seconds",
        )
        .when(
            ~_positive(lookup(config, "max_response_bytes"), ["integer"]),
            "max_response_bytes",
        )
    )


def audit_configs(connections: DataFrame, config: str = "config") -> DataFrame:
    """Every connection with the setting that makes it unusable, if any."""
    parsed = computed_once(connections, _config=F.try_parse_json(F.col(config)))
    judged = computed_once(parsed, problem=config_problem(F.col("_config"))).drop("_config")
    return judged.withColumn(
        "category", F.when(F.col("problem").isNotNull(), "ConfigurationError")
    )


def merge_configs(base: Column, override: Column) -> Column:
    """Shallow merge of two JSON objects as map<string,variant>; the override wins, null included."""
    as_map = "map<string,variant>"
    below = F.try_variant_get(base, "$", as_map)
    above = F.try_variant_get(override, "$", as_map)
    return F.map_concat(
        F.map_filter(below, lambda key, _: ~F.map_contains_key(above, key)), above
    )


def effective_configs(configs: DataFrame, connections: DataFrame) -> DataFrame:
    """Settings each ingestion uses: its own over those of its source connection."""
    parsed = computed_once(
        configs.join(connections, "connection_id"),
        _base=F.try_parse_json(F.col("config")),
        _override=F.try_parse_json(F.col("extraction_config")),
    )
    merged = computed_once(parsed, effective=merge_configs(F.col("_base"), F.col("_override")))
    return merged.drop("_base", "_override")


def resolve_connectors(
    connections: DataFrame, registry: dict[str, list[str]] | None = None
) -> DataFrame:
    """Connections with whether their type is registered for their kind.

    A run on an unregistered type fails as unexpected; the available types are
    listed in order. The registry is code, not data, so no join is needed.
    """
    known, available = F.lit(False), F.lit("")
    for kind, types in (registry or CONNECTORS).items():
        is_kind = F.col("kind") == kind
        known = F.when(is_kind, F.col("connector_type").isin(types)).otherwise(known)
        available = F.when(is_kind, ", ".join(sorted(types))).otherwise(available)
    return connections.withColumn("known", known).withColumns(
        {
            "available": F.when(~F.col("known"), available),
            "category": F.when(~F.col("known"), UNEXPECTED_ERROR),
        }
    )
