"""Categories of addresses by rules in a table, as a join on prefixes.

A rule's network is the first bits of its addresses. Every distinct address is
cut once for each prefix length that occurs among the rules, of which there are
at most 33 and 129, and meets the rules on equal prefixes: no range comparison,
and no plan that grows with the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.addresses import INVALID, address_bits
from millrace.operators.scaling import computed_once, few_values, spread_join

#: Prefix lengths that there can be, the family counted in.
LENGTHS = 33 + 129


def read_rules(rules: DataFrame) -> DataFrame:
    """Rules with the ``prefix`` of their ``cidr``, and the ``problem`` of those that name no network.

    Problems: ``address`` (not one), ``length`` (missing, no number or beyond
    the address) and ``host bits`` (set behind the prefix). A network of mapped
    IPv4 addresses is an IPv4 network. A ``cidr`` that is NULL has no address.
    """
    parts = F.split("cidr", "/")
    network, length = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    stated = F.when((F.size(parts) == 2) & length.rlike("^(0|[1-9][0-9]{0,2})$"), length.cast("int"))
    read = computed_once(rules, _bits=address_bits(network), _stated=stated)
    mapped = F.col("cidr").contains(":") & F.col("_bits").startswith("4")
    read = computed_once(read, _length=F.col("_stated") - F.when(mapped, 96).otherwise(0))
    whole = F.length("_bits") - 1
    rest = F.expr("substring(_bits, _length + 2)")
    problem = (
        F.when(F.col("_bits").isNull(), "address")
        .when(F.col("_length").isNull() | (F.col("_length") > whole), "length")
        .when((F.col("_length") < 0) | rest.contains("1"), "host bits")
    )
    return (
        read.withColumn("problem", problem)
        .withColumn("prefix", F.when(F.col("problem").isNull(), F.expr("substring(_bits, 1, _length + 1)")))
        .drop("_bits", "_stated", "_length")
    )


def categories_by_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Every row of ``addresses`` with the ``category`` and ``priority`` of the first rule its ``address`` lies in.

    ``rules`` holds ``cidr, priority, category``. The least priority wins; of
    equal ones the longer prefix, then the lesser category, NULL before any.
    A rule's category may be NULL, which lets an address out of a wider network.
    Where no rule fits, both are NULL; text that is no address, or NULL, is
    ``invalid`` without a priority. Rules that name no network fit nothing
    (:func:`read_rules` tells them). Other columns of the rules are not looked at.
    """
    read = read_rules(rules.select("cidr", "priority", "category")).where("problem IS NULL")
    first = read.groupBy("prefix").agg(F.min(F.struct("priority", "category")).alias("_own"))
    lengths = few_values(
        first.select(F.concat(F.substring("prefix", 1, 1), F.length("prefix").cast("string")).alias("_shape")), "_shape", LENGTHS
    )
    by_family = {family: [int(x[1:]) for x in lengths or [] if x[0] == family] for family in "46"}
    known = computed_once(addresses.select("address").distinct(), _bits=address_bits(F.col("address")))
    own = F.when(F.col("_bits").startswith("4"), _numbers(by_family["4"])).otherwise(_numbers(by_family["6"]))
    tried = known.where("_bits IS NOT NULL").select(
        "address", F.explode(F.transform(own, lambda n: F.substr("_bits", F.lit(1), n))).alias("prefix")
    )
    best = F.min(F.struct(F.col("_own.priority"), -F.length("prefix"), F.col("_own.category"))).alias("_rule")
    found = spread_join(tried, first, ["prefix"], ["address"]).groupBy("address").agg(best)
    judged = known.join(found, "address", "left").select(
        "address", F.col("_bits").isNotNull().alias("_valid"), "_rule"
    )
    category = F.when(F.col("_valid"), F.col("_rule.category")).otherwise(INVALID)
    return (
        addresses.join(judged, "address", "left")
        .withColumns({"category": category, "priority": F.col("_rule.priority")})
        .drop("_valid", "_rule")
    )


def _numbers(values: list[int]):
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")
