"""URL filters: rules for hosts and paths, and trust along host links where no rule speaks.

Hosts are nodes; an edge leads from a page's host to each host its links name, with
the number of such links, and both ways between a host and the domain directly above
it where both occur, with one link's weight. Two propagations run over these edges in
Spark: personalised PageRank from the hosts whose pages rules allow, and the same over
reversed edges from those whose pages rules block, so that a host that links to
blocked ones is distrusted. A host whose distrust exceeds its trust by ``THRESHOLD``
is blocked.

Scores are whole numbers of which ``UNIT`` is what a seed gets, and every division
rounds down: sums then don't depend on the order of rows, and a task that runs again
gives the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.operators.scaling import spread_join

#: A seed's own score, what is passed on of a score per round in hundredths, and rounds, of which some are written at once.
UNIT, PASSED_ON, ROUNDS, WRITTEN = 1_000_000, 85, 12, 4
#: Distrust beyond trust from which a host is blocked: without links, that half of its pages are blocked.
THRESHOLD = UNIT // 2
#: What an href names up to the end of its host.
LINK = r"(?i)href[\x09-\x0D\x20]*=[\x09-\x0D\x20]*[\"']?[\x09-\x0D\x20]*((?:[a-z][a-z0-9+.-]*:)?//[^\x00-\x20\"'<>/?#]+)"
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"


class Rule(NamedTuple):
    """``verdict`` (allow or block) for a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(_lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null if none does.

    The rules are tried from the longest to the shortest; of equally long ones the
    first in the list counts, and of rules for one host and path too.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """``a, b, n`` of ``host, html``: links from host to host, none to itself or to an empty host.

    Links of one page to one host are added up before the shuffle. Domains are linked
    with the hosts directly below them, if both have pages or links.
    """
    named = pages.select(F.col("host").alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    named = named.select("a", _lower(F.regexp_extract("link", r"//([^/?#]*)$", 1)).alias("b")).where("a <> '' AND b <> '' AND a <> b")
    links = stored(named.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "host-links")
    hosts = pages.select("host").unionByName(links.select(F.col("b").alias("host"))).where("host <> ''").distinct()
    above = hosts.select("host", F.regexp_replace("host", r"^[^.]*\.?", "").alias("domain"))
    family = spread_join(above, hosts.select(F.col("host").alias("domain")), ["domain"], ["host"]).select("host", "domain")
    both = family.select(F.col("host").alias("a"), F.col("domain").alias("b")).unionByName(
        family.select(F.col("domain").alias("a"), F.col("host").alias("b"))
    )
    return links.unionByName(both.withColumn("n", F.lit(1).cast("bigint"))).groupBy("a", "b").agg(F.sum("n").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``host, score``: personalised PageRank of ``a, b, n`` from ``host, seed``.

    Each round a host's score is its own seed and what came in: hosts pass on
    ``PASSED_ON`` hundredths of their score to those they link to, by numbers of links.
    A host without links passes on nothing. What goes to one host is summed up before
    the shuffle, and a host that links to many is met by a spread join.
    """
    out = edges.groupBy("a").agg(F.sum("n").alias("total"))
    weighed = stored(spread_join(edges, out, ["a"], ["b"]), "host-edges")
    score = seeds.select("host", F.col("seed").alias("score"))
    share = f"score * {PASSED_ON} div 100"
    for turn in range(1, rounds + 1):
        own = score.select(F.col("host").alias("a"), F.expr(share).alias("score"))
        passed = spread_join(weighed, own, ["a"], ["b"]).select(
            F.col("b").alias("host"), F.expr("(score div total) * n + (score % total) * n div total").alias("score")
        )
        score = passed.unionByName(seeds.select("host", F.col("seed").alias("score"))).groupBy("host").agg(F.sum("score").alias("score"))
        if turn % WRITTEN == 0 or turn == rounds:
            score = stored(score, "host-score")
    return score


def _seeds(judged: DataFrame, verdict: str) -> DataFrame:
    """``host, seed``: hosts of pages that rules give ``verdict``, with that part of ``UNIT`` which these pages are of all its pages."""
    part = judged.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("verdict") == verdict, 1)).alias("own"))
    return stored(part.where("host <> '' AND own > 0").select("host", F.expr(f"{UNIT} * own div pages").alias("seed")), f"seeds-{verdict}")


def host_scores(judged: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` of every host that either propagation reaches."""
    edges = stored(edges, "host-graph")
    trust = propagated(edges, _seeds(judged, "allow"), rounds)
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    distrust = propagated(turned, _seeds(judged, "block"), rounds)
    return (
        trust.select("host", F.col("score").alias("trust"), F.lit(0).cast("bigint").alias("distrust"))
        .unionByName(distrust.select("host", F.lit(0).cast("bigint").alias("trust"), F.col("score").alias("distrust")))
        .groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    )


def judge(
    pages: DataFrame, rules: Sequence[Rule], rounds: int = ROUNDS, threshold: int = THRESHOLD,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``id, host, path, rule, verdict, trust, distrust``, one row per row in.

    The verdict is that of the longest rule that fits; else block where a host's
    distrust is ``threshold`` or more above its trust, and allow where not, hosts
    that no propagation reaches included. Null urls and those without ``://`` have an empty
    host and path, no rule and no trust, and are allowed. A null html has no links. Rows
    may repeat and ids may be null: every row is judged. Other columns, whatever
    their names, are not looked at. An empty table gives an empty table. ``rules`` is a
    list of settings; they are tried one by one, so it should hold hundreds at most.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    named = rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = named.select("id", "host", "path", matched(F.col("host"), F.col("path"), rules).alias("_m"))
    judged = judged.select("id", "host", "path", F.col("_m.rule").alias("rule"), F.col("_m.verdict").alias("verdict"))
    scores = stored(host_scores(judged.select("host", "verdict"), host_edges(named.select("host", "html")), rounds), "host-scores")
    told = spread_join(judged, scores, ["host"], ["path"], "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0)) for c in ("trust", "distrust"))
    own = F.when(distrust - trust >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return told.select("id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
