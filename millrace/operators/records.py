"""From response bodies to records: parse, classify, extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.outcomes import response_category, response_retryable
from millrace.functions.paths import as_list, is_object, lookup
from millrace.operators.scaling import computed_once
from millrace.schemas import DEFAULT_RECORDS_PATH

MALFORMED = "MalformedResponseError"


def parse_body(body: Column) -> Column:
    """Body as VARIANT; NULL when it is not valid UTF-8 JSON. A leading BOM is dropped."""
    text = F.try_validate_utf8(body.cast("string"))
    return F.try_parse_json(F.regexp_replace(text, "^﻿", ""))


def page_records(data: Column, path: str) -> Column:
    """Records of a parsed body as array<variant>; NULL when the body is malformed.

    A top-level list is the records whatever the path says.
    """
    return F.coalesce(as_list(data), as_list(F.when(is_object(data), lookup(data, path))))


def body_problem(data: Column, path: str) -> Column:
    """Why a body yields no records, first matching rule; NULL for a good body."""
    at_path = lookup(data, path)
    return (
        F.when(data.isNull(), "invalid JSON")
        .when(as_list(data).isNotNull(), F.lit(None).cast("string"))
        .when(~is_object(data), "not an object or list")
        .when(at_path.isNull(), "records field missing")
        .when(as_list(at_path).isNull(), "records field not a list")
    )


def choose_records_path(config: Column) -> Column:
    """Configured path, else configured key, else the default; only an empty path falls through.

    A key that is there as null gives no path at all, so that the run fails.
    """
    path = F.try_variant_get(config, "$.records_path", "string")
    key = F.try_variant_get(config, "$.records_key", "string")
    nulled = F.is_variant_null(F.try_variant_get(config, "$.records_key", "variant"))
    return F.when(path != "", path).when(
        F.coalesce(nulled, F.lit(False)), F.lit(None).cast("string")
    ).otherwise(F.coalesce(key, F.lit(DEFAULT_RECORDS_PATH)))


def page_facts(pages: DataFrame, path: str, body: str = "body") -> DataFrame:
    """Replace bodies by thin facts: record count, size, checksum and parse problem."""
    parsed = computed_once(pages, _data=parse_body(F.col(body)))
    return (
        parsed.withColumns(
            {
                "n": F.size(page_records(F.col("_data"), path)).cast("bigint"),
                "problem": body_problem(F.col("_data"), path),
                "size_bytes": F.octet_length(F.col(body)).cast("bigint"),
                "checksum_sha256": F.sha2(F.col(body).cast("binary"), 256),
            }
        )
        .withColumn("error", F.when(F.col("problem").isNotNull(), MALFORMED))
        .drop("_data", body)
    )


def extract_records(pages: DataFrame, path: str, body: str = "body") -> DataFrame:
    """One row per record with its position in the page; malformed pages give none."""
    keep = [c for c in pages.columns if c != body]
    parsed = computed_once(pages, _data=parse_body(F.col(body)))
    found = page_records(F.col("_data"), path)
    return parsed.select(*keep, F.posexplode(found).alias("pos", "record"))


def effective_responses(responses: DataFrame, keys: list[str]) -> DataFrame:
    """One response per request: the second try replaces a 401/403 when a provider is set.

    Two conditional aggregates instead of a window, so partial results combine
    before the shuffle.
    """
    first = F.col("try") == 1
    second = F.col("try") == 2
    seen = responses.groupBy(*keys).agg(
        F.max(F.when(first, F.struct("status", "has_provider"))).alias("first"),
        F.max(F.when(second, F.struct("status"))).alias("second"),
    )
    renewed = (
        F.coalesce(F.col("first.status").isin(401, 403), F.lit(False))
        & F.col("first.has_provider")
        & F.col("second").isNotNull()
    )
    return seen.select(
        *keys,
        F.when(renewed, 2).otherwise(1).alias("try"),
        F.when(renewed, F.col("second.status")).otherwise(F.col("first.status")).alias("status"),
    )


def classify_responses(responses: DataFrame) -> DataFrame:
    status = F.col("status")
    return responses.withColumns(
        {"category": response_category(status), "retryable": response_retryable(status)}
    )
