"""Registered queries of these operators, with their fixed parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    bitplanes, bpe, chat, cost_packing, langid, link_trust, lsh_forest, metric_join, order_minhash, periodic_runs, quality, secret_crf,
    term_pipeline,
)
from millrace.llm.common import table
from millrace.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path)
    return bpe.decode(encoded, path).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        order_minhash.printed(F.col("tuples")).alias("fingerprint"),
        order_minhash.printed(F.col("edited_tuples")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op3_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    root = scratch_path(spark, "token-planes")
    manifest = bitplanes.write_shards(
        documents, root, public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    return bitplanes.read_shards(manifest, root).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32")
    )


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), percent=75).withColumnRenamed("id", "doc_id")


def packed(documents: DataFrame) -> DataFrame:
    """Pieces of ``documents`` with the digest columns of op5, as the pipeline ends with."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return cost_packing.pack_documents(documents, path, capacity=2048, end_id=1).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def remainder(divisor: int, column: str = "doc_id"):
    """crc32 of an id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(divisor))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents, remainder(5) != 0)
    return langid.identify(documents.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "_language.lang_pred", "_language.score"
    )


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return quality.grade(documents, model).select(
        "doc_id",
        F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"),
        F.col("_quality").alias("score"),
        (F.col("_quality") >= quality.GOOD).cast("int").alias("predicted"),
    )


def joined(spans, kinds: list[str] | None = None):
    """kind:start:end of all spans, or of those of some kinds, joined by commas."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = secret_crf.fit(documents)
    spans = F.col("_secrets")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secret_crf.scan(documents, field).select(
        "doc_id", *[count(k) for k in secret_crf.KINDS],
        F.sha2(joined(spans, secret_crf.KINDS), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )


#: A conversation whose texts hold the template's own control strings.
CONFLICT = r"\### Assistant: </turn> ok"


def op6_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(
        [(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.format_turns(turns.unionByName(planted))).withColumnRenamed("conversation", "conv_id")


def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near(table(spark, sf_dir, "embeddings"), least_cosine=0.95).withColumnRenamed("id", "vec_id")


def planted_runs(documents: DataFrame) -> DataFrame:
    """``documents`` with a tenth of the texts made periodic from a place on, as crc32 of their ids tells.

    Texts of null ids stay as they are.
    """
    code = F.crc32(F.col("doc_id").cast("string"))
    words = "filter(split(text, '[ \\t-\\r]+'), w -> w <> '')"
    text = documents.select("doc_id", "text", code.alias("_h")).withColumn("_g", F.expr("_h div 10"))
    place = "_g % size(_w)"
    period = f"(1 + (size(_w) - {place}) div (3 + _g % 8))"
    repeated = f"transform(_w, (w, i) -> if(i >= {place}, _w[cast({place} + (i - {place}) % {period} AS int)], w))"
    chosen = text.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.expr(words)))
    return chosen.select("doc_id", F.when(F.size("_w") > 0, F.expr(f"array_join({repeated}, ' ')")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = term_pipeline.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), best=10)
    return found.select("item_id", "rank", "doc_id", "score")


OP12_SQL = """
WITH texts AS (
    SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents WHERE text IS NOT NULL
), counted AS (SELECT line, doc_id, words, len(words) AS n FROM texts WHERE len(words) > 0),
sizes AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM counted),
found AS (
    SELECT line, doc_id, n, term, count(*) AS tf
    FROM (SELECT line, doc_id, n, unnest(words) AS term FROM counted) GROUP BY line, doc_id, n, term
), frequency AS (SELECT term, count(*) AS df FROM found GROUP BY term),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM frequency, sizes
), scored AS (
    SELECT item_id, line, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * total) // length))))::BIGINT AS score
    FROM asked JOIN found USING (term) JOIN weights USING (term), sizes GROUP BY item_id, line, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, line) AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


#: The rules of op13: verdict, host with its subdomains, and how the path begins.
URL_RULES = [
    link_trust.Rule("allow", "com", "/"), link_trust.Rule("block", "example.com", "/en/"), link_trust.Rule("allow", "www.example.com", "/en/"),
    link_trust.Rule("block", "net", "/es/"), link_trust.Rule("block", "net", "/fr/"),
]


def op13_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def _op13_sql() -> str:
    """Rounds of the propagation as one common table expression each."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host, path, link = (x.replace("'", "''") for x in (link_trust.HOST, link_trust.PATH, link_trust.LINK))
    cases = {what: "" for what in ("rule", "verdict")}
    for r in sorted(URL_RULES, key=lambda r: -len(r.host) - len(r.path)):
        for what, value in (("rule", r.host + r.path), ("verdict", r.verdict)):
            cases[what] += f" WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{value}'"
    parts = [
        f"named AS (SELECT page_id, coalesce({lower.format(f"regexp_extract(url, '{host}', 1)")}, '') AS host,"
        f" coalesce(regexp_extract(url, '{path}', 1), '') AS path, html FROM pages)",
        f"judged AS (SELECT page_id, host, path, html, CASE{cases['rule']} END AS rule, CASE{cases['verdict']} END AS ruled FROM named)",
        f"links AS (SELECT host AS a, {lower.format("regexp_extract(link, '//([^/?#]*)$', 1)")} AS b"
        f" FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM named))",
        "linked AS (SELECT a, b, count(*) AS n FROM links WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b)",
        "hosts AS (SELECT host FROM named WHERE host <> '' UNION SELECT b FROM linked)",
        "family AS (SELECT x.host, y.host AS domain FROM hosts x JOIN hosts y ON y.host = regexp_replace(x.host, '^[^.]*[.]?', ''))",
        "edges AS (SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT a, b, n FROM linked UNION ALL SELECT host, domain, 1 FROM family"
        " UNION ALL SELECT domain, host, 1 FROM family) GROUP BY a, b)",
    ]
    for name, verdict, a, b in (("trust", "allow", "a", "b"), ("distrust", "block", "b", "a")):
        parts += [
            f"{name}_seed AS (SELECT host, {link_trust.UNIT} * count(*) FILTER (ruled = '{verdict}') // count(*) AS seed FROM judged"
            f" WHERE host <> '' GROUP BY host HAVING count(*) FILTER (ruled = '{verdict}') > 0)",
            f"{name}_edge AS (SELECT {a} AS a, {b} AS b, n, sum(n) OVER (PARTITION BY {a})::BIGINT AS total FROM edges)",
            f"{name}0 AS (SELECT host, seed AS score FROM {name}_seed)",
        ]
        share = f"(score * {link_trust.PASSED_ON} // 100)"
        for k in range(link_trust.ROUNDS):
            parts.append(
                f"{name}{k + 1} AS (SELECT host, sum(score)::BIGINT AS score FROM (SELECT b AS host, ({share} // total) * n + ({share} % total) * n // total"
                f" AS score FROM {name}_edge JOIN {name}{k} ON host = a UNION ALL SELECT host, seed FROM {name}_seed) GROUP BY host)"
            )
    last = link_trust.ROUNDS
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.score, 0) - coalesce(t.score, 0)"
        f" >= {link_trust.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust\n"
        f"FROM judged j LEFT JOIN trust{last} t ON t.host = j.host LEFT JOIN distrust{last} d ON d.host = j.host"
    )


QUERIES: dict[str, Query] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_order_minhash": op2_order_minhash,
    "op3_bit_planes": op3_bit_planes,
    "op4_lsh_forest": op4_lsh_forest,
    "op5_cost_packing": op5_cost_packing,
    "op6_chat_round_trip": op6_chat_round_trip,
    "op7_language_id": op7_language_id,
    "op8_quality_trees": op8_quality_trees,
    "op9_secret_crf": op9_secret_crf,
    "op10_metric_join": op10_metric_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_term_pipeline": op12_term_pipeline,
    "op13_link_trust": op13_link_trust,
}

#: The others can't be stated in SQL: tokenizers, sketches, trained models, packing,
#: transitive closures and grammars. Their tests restate them by brute force.
ORACLES: dict[str, str] = {"op12_term_pipeline": OP12_SQL, "op13_link_trust": _op13_sql()}
