"""Outbound policy over tables of URLs, resolved addresses and allowed hosts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.addresses import ipv4_category
from millrace.functions.urls import admission_problem, split_url
from millrace.operators.scaling import spread_join


def normalize_host(host: Column) -> Column:
    return F.lower(F.trim(host))


def host_lists(policy: DataFrame) -> DataFrame:
    """One row per host with the lists it is on.

    ``policy`` holds ``host, list``, list being deployment_private,
    tenant_private, unsafe or insecure_http.
    """
    on = {
        "private_listed": F.col("list").isin("deployment_private", "tenant_private"),
        "unsafe_listed": F.col("list") == "unsafe",
        "http_listed": F.col("list") == "insecure_http",
    }
    return policy.groupBy(normalize_host(F.col("host")).alias("host")).agg(
        *[F.bool_or(test).alias(name) for name, test in on.items()]
    )


def admit_urls(urls: DataFrame, policy: DataFrame, key: str, allow_http: bool = False) -> DataFrame:
    """Every URL with the first rule it breaks; plain http needs its host listed."""
    hosted = urls.withColumn("host", split_url(F.col("url")).host)
    lists = host_lists(policy).select("host", "http_listed")
    http_allowed = F.lit(allow_http) | F.coalesce("http_listed", F.lit(False))
    return (
        spread_join(hosted, lists, ["host"], [key], how="left")
        .withColumn("problem", admission_problem(F.col("url"), http_allowed))
        .drop("http_listed")
    )


def decide_addresses(
    addresses: DataFrame,
    policy: DataFrame,
    key: str,
    category: Callable[[Column], Column] = ipv4_category,
) -> DataFrame:
    """Category of every resolved address and whether the lists let it pass.

    A private address passes when its host is on a private list; any category
    passes when it is on the unsafe list.
    """
    lists = host_lists(policy).drop("http_listed")
    named = addresses.withColumn("host", normalize_host(F.col("host"))).withColumn(
        "category", category(F.col("address"))
    )
    listed = spread_join(named, lists, ["host"], [key], how="left")
    passes = (
        F.col("category").isNull()
        | ((F.col("category") == "private") & F.coalesce("private_listed", F.lit(False)))
        | F.coalesce("unsafe_listed", F.lit(False))
    )
    return listed.withColumn("allowed", passes).drop("private_listed", "unsafe_listed")


def host_verdicts(hosts: DataFrame, decisions: DataFrame, order: str) -> DataFrame:
    """A host is blocked when any address is, or when it has none.

    The reported category is that of its first blocked address.
    """
    blocked = F.when(~F.col("allowed"), F.struct(F.col(order), F.col("category")))
    judged = decisions.groupBy("host").agg(
        F.count(F.lit(1)).alias("addresses"),
        F.count_if(~F.col("allowed")).alias("blocked_addresses"),
        F.min(blocked)["category"].alias("category"),
    )
    return (
        hosts.join(judged, "host", "left")
        .fillna(0, ["addresses", "blocked_addresses"])
        .withColumns(
            {
                "blocked": (F.col("addresses") == 0) | (F.col("blocked_addresses") > 0),
                "category": F.when(F.col("addresses") == 0, "unresolved").otherwise(
                    F.col("category")
                ),
            }
        )
    )
