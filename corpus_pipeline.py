"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept. Between stages the documents are written as Parquet and read again, so that
a lost executor costs tasks of one stage. All stages but the last return the
columns of ``docs``.

Rows may hold nulls in any column and repeat; a text that is null, empty or
without a letter has no language and goes in the first stage. Columns beyond
those of ``documents`` are kept as they are, whatever their names. An empty table
passes through all stages as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import langid, lsh_forest, quality, secret_crf
from millrace.llm.common import ready, stored, table
from millrace.llm.queries import packed

#: A document goes if operator 8 would not predict good quality for it: the threshold is that of ``op8_quality_trees``.
LEAST_QUALITY = quality.GOOD


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't use."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (7). Learns from all documents that name theirs.

    If none does, no language can be told, and documents with a letter stay.
    """
    ready(spark)
    model = langid.fit(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.udf(langid.has_letter, "boolean")("text"))
    name = _free(docs, "_language")
    found = langid.identify(docs, model, name=name)
    return found.where(F.col(f"{name}.lang_pred") != langid.NO_LANGUAGE).drop(name)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score is below ``LEAST_QUALITY`` (8). Learns from all labels of documents that are left."""
    ready(spark)
    name = _free(docs, "_quality")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.grade(docs, model, name=name).where(F.col(name) >= LEAST_QUALITY).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (4), that with the smallest id.

    Of several rows with that id, the first by text, language, source and length stays. Rows without an id are
    linked with nothing and stay.
    """
    ready(spark)
    rank = _free(docs, "_rank")
    kept = lsh_forest.near_duplicates(docs).where("kept AND id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()
    first = Window.partitionBy("doc_id").orderBy("text", *[c for c in ("lang", "source", "n_chars") if c in docs.columns])
    chosen = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    chosen = chosen.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    return chosen.unionByName(docs.where("doc_id IS NULL"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark (9) and counts their characters anew."""
    ready(spark)
    name = _free(docs, "_secrets")
    clean = secret_crf.redact(docs, secret_crf.fit(docs), name=name)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col(name) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences (5)."""
    ready(spark)
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("packing", packing),
]

#: Trained models and a transitive closure can't be stated in SQL; the tests restate the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
