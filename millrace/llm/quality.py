"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text form a fixed vector. Trees are grown level by level
on the driver from a bounded sample of labelled rows, with gradients summed into
histograms of quantile bins, and are flattened into arrays (feature, threshold,
leaf value) that numpy walks for a batch of texts and all trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import texts_of

#: Scores from which on quality is predicted to be good.
GOOD = 0.7
#: Labelled rows that a model learns from at most: those whose hashed ids are smallest.
LEARN_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15

STATISTICS = [
    "chars", "words", "word_length", "word_length_spread", "upper", "digits", "symbols", "spaces", "distinct_words",
    "top_word", "lines", "repeated_lines", "line_length", "odd_ends", "letterless", "bars", "shouts", "ended_lines",
    "entropy", "short_words", "repeated_triples", "stops", "top_char",
]

_CLASS = np.zeros((257, 4), dtype=bool)  # upper, digit, symbol, space; beyond Latin-1 all is a letter
for _c in range(256):
    _CLASS[_c] = (chr(_c).isupper(), chr(_c).isdigit(), not chr(_c).isalnum() and not chr(_c).isspace(), chr(_c).isspace())
_COMMON_ENDS = set(".,;:?)\"'")


def statistics(text: str) -> np.ndarray:
    """The vector of ``STATISTICS`` of a whole text; all zero for an empty one."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = np.bincount(np.minimum(codes, 256), minlength=257)
    n = len(codes)
    upper, digits, symbols, spaces = counts @ _CLASS / n
    share = counts[counts > 0] / n
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    m = len(words)
    out[[0, 1, 4, 5, 6, 7]] = np.log1p(n), np.log1p(m), upper, digits, symbols, spaces
    out[18], out[22] = -(share * np.log(share)).sum(), counts.max() / n
    if not m:
        return out
    lengths = np.fromiter(map(len, words), dtype=float, count=m)
    often = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    out[2], out[3] = min(lengths.mean(), 100), min(lengths.std(), 100)
    out[8], out[9] = len(often) / m, max(often.values()) / m
    out[10], out[11], out[12] = np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines))
    out[13] = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in _COMMON_ENDS) / m
    out[14] = sum(1 for w in words if not any(map(str.isalpha, w))) / m
    out[15], out[16], out[21] = counts[ord("|")] / m, counts[ord("!")] / m, counts[ord(".")] / m
    out[17] = sum(1 for x in lines if x.rstrip()[-1] in ".!?") / len(lines)
    out[19] = (lengths <= 3).mean()
    out[20] = 1 - len(triples) / max(m - 2, 1) if m > 2 else 0
    return out


@dataclass(frozen=True)
class Trees:
    """All trees as arrays: a row per tree, inner nodes level by level, then leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(rows), self.base)
        trees = np.arange(len(self.feature))
        node = np.zeros((len(rows), len(trees)), dtype=np.int64)
        at = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            right = rows[at, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -30, 30)))


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss. One class alone, or no rows, give a constant."""
    count = float(len(labels))
    share = (labels.sum() + 1) / (count + 2)
    base = float(np.log(share / (1 - share)))
    if not count or labels.min() == labels.max():
        return Trees(base, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)), depth)
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(len(labels), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = labels - p, p * (1 - p)
        node = np.zeros(len(labels), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            here = node - first
            g_all, h_all = np.bincount(here, gradient, width), np.bincount(here, curve, width)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                slot = here * (len(cut) + 1) + binned[:, f]
                size = width * (len(cut) + 1)
                g = np.bincount(slot, gradient, size).reshape(width, -1).cumsum(axis=1)[:, :-1]
                h = np.bincount(slot, curve, size).reshape(width, -1).cumsum(axis=1)[:, :-1]
                rest_g, rest_h = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + l2) + rest_g**2 / (rest_h + l2) - (g_all**2 / (h_all + l2))[:, None]
                gain[(h < 1) | (rest_h < 1)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                feature[t, first : first + width][better] = f
                threshold[t, first : first + width][better] = cut[top[better]]
            right = rows[np.arange(len(labels)), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        at = node - inner
        leaf[t] = rate * np.bincount(at, gradient, inner + 1) / (np.bincount(at, curve, inner + 1) + l2)
        margin += leaf[t, at]
    return Trees(base, feature, threshold, leaf, depth)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    learn_rows: int = LEARN_ROWS,
) -> Trees:
    """Learn from labelled documents whose label row satisfies ``usable``.

    At most ``learn_rows`` labelled ids are used, the smallest by a hash, so that
    what is broadcast and what reaches the driver is bounded. Several labels of
    one id count by their mean; null labels and ids count as absent.
    """
    chosen = (
        labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.col("id").cast("string")), "id")
        .limit(learn_rows)
    )
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [statistics(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x.tolist() for x in own], type=pa.list_(pa.float64()))],
                names=["id", "label", "own"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    found = (
        rows.mapInArrow(measure, f"id {kind}, label int, own array<double>")
        .groupBy("id").agg(F.min("label").alias("label"), F.min("own").alias("own"))
        .toPandas()
        .sort_values("id")
    )
    if not len(found):
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return grow(np.stack(found["own"].to_numpy()), found["label"].to_numpy(dtype=float))


def grade(documents: DataFrame, model: Trees, text_col: str = "text", name: str = "_quality") -> DataFrame:
    """``documents`` with a column ``name``: the share, 0 to 1, that the trees give to label 1.

    Null texts score as empty ones. All rows and columns stay; a column called
    ``name`` is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def graded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            own = [statistics(t or "") for t in series.tolist()]
            yield pd.Series(shared.value.score(np.stack(own)) if own else [], dtype=float)

    return documents.withColumn(name, graded(F.col(text_col)))
