"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams are summed per language in Spark; the smoothed
log-probability matrix (n-gram buckets by languages, a fixed size) travels to the
tasks, where numpy multiplies it with the sparse counts of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import texts_of

#: Buckets that n-grams are hashed into, and the lengths of n-grams.
BUCKETS, ORDERS = 1 << 14, (1, 2, 3)
#: About so many labelled texts of each language are learned from, chosen by a hash of their ids.
PER_LANGUAGE = 4000
#: Languages that a model may hold; the matrix then stays below 64 MB.
MAX_LANGUAGES = 512
#: Characters that numpy takes at once.
STEP = 1 << 20
#: What texts without a letter are.
NO_LANGUAGE = "und"

_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # bucket x language


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text in lower case, runs of white space as one space."""
    text = f" {' '.join(text.lower().split())} "
    counts = np.zeros(BUCKETS)
    for start in range(0, len(text), STEP):
        # The last characters of a step are the context of the next.
        part = text[max(0, start - max(ORDERS) + 1) : start + STEP]
        fresh = start - max(0, start - max(ORDERS) + 1)
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        mixed = codes * np.uint32(0x9E3779B1)
        gram = np.zeros(len(codes), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if n > len(codes):
                break
            # An n-gram is the (n-1)-gram before it and its last character.
            gram = gram if n == 1 else gram[:-1]
            gram = (gram * np.uint32(0x85EBCA6B)) ^ mixed[n - 1 :]
            if n in ORDERS:
                ending = np.arange(n - 1, len(codes)) >= fresh if fresh else slice(None)
                slots = ((gram ^ (gram >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 14)
                counts += np.bincount(slots[ending], minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def fit(
    documents: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    smoothing: float = 0.5,
) -> LanguageModel:
    """Learn from the rows of ``documents`` where ``usable`` holds and text and language are there.

    About ``per_language`` rows of each language count, those whose hashed id
    falls below a share; the number of languages is bounded by ``MAX_LANGUAGES``.
    Only sums by language and bucket reach the driver. Texts without a letter
    teach nothing. Without a usable row the model knows no language, and every
    text is then ``und``.
    """
    rows = documents.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS, 0)))
    languages = sorted(sizes)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                if has_letter(text):
                    sums[lang] = sums.get(lang, 0) + gram_counts(text)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"]
            )

    counted = chosen.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = sorted(found["lang"].unique())
    at = {k: i for i, k in enumerate(languages)}
    totals = np.zeros((BUCKETS, len(languages)))
    totals[found["bucket"].to_numpy(dtype=int), found["lang"].map(at).to_numpy(dtype=int)] = found["n"]
    totals += smoothing
    weights = np.array([sizes[k] for k in languages], dtype=float)
    return LanguageModel(languages, np.log(weights / max(weights.sum(), 1)), np.log(totals / totals.sum(axis=0)))


def predict_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language of each text and its share of the posterior."""
    names, scores = [], []
    for text in texts:
        if not model.languages or not has_letter(text):
            names.append(NO_LANGUAGE)
            scores.append(0.0)
            continue
        counts = gram_counts(text)
        at = np.flatnonzero(counts)
        logs = model.log_prior + counts[at] @ model.log_prob[at]
        best = int(logs.argmax())
        names.append(model.languages[best])
        scores.append(float(1 / np.exp(logs - logs[best]).sum()))
    return names, scores


def identify(documents: DataFrame, model: LanguageModel, text_col: str = "text", name: str = "_language") -> DataFrame:
    """``documents`` with a column ``name``: struct of lang_pred and score.

    A text that is null or holds no letter is ``und`` with score 0, as is every
    text if the model knows no language. Equal shares go to the language first
    in alphabetical order. All columns and rows stay; a column called ``name`` is
    replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            names, scores = predict_texts(shared.value, series.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return documents.withColumn(name, predicted(F.col(text_col)))
