"""Ranked lexical search by pipelined term partitioning.

Terms are owned by stages, from the rarest to the most frequent. Each item is a bundle
that carries its terms and a sparse accumulator: the documents it has met and their
sums so far. Bundles go through the owners one after the other; at each, a cogroup of
bundles with that owner's postings adds whole-number contributions. After the last
owner the bundles give up their best documents, and the best of these are the result.

Documents are dealt to blocks of about ``BLOCK``, and items to groups of about
``GROUP``; a bundle exists once for each block, and the key of the cogroup is the
block and the group, so that a task holds the postings of some thousands of documents,
however many there are, and a term that all documents hold is spread over all blocks.

A bundle drops, exactly, documents that can't be among the best any more: those whose
sum with the most that later owners could add stays below the sum of the block's last
wanted document. A new document is taken up only while later owners could bring it
there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import slices, stored
from millrace.operators.scaling import join_for, number_rows

#: Documents of a block and items of a group, about.
BLOCK, GROUP = 2048, 256
#: Owners hold the terms of at most one document in so many, and the last one the rest.
OWNERS = (64, 12, 4)
#: More than a posting can add for a weight of 1.
MOST = 1_000_000

#: ASCII letters as lower case, digits as they are, other ASCII as a blank; all bytes of other characters stay.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal stretches of ASCII letters, digits and characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLDED).split()


def counted(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id, n, term, tf``: a row per distinct term of each row, and one with null term and tf for each row.

    ``row`` tells rows apart, also those of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(batch, [len(t or "") for t in texts], 1 << 20):
                own = [Counter(terms_of(t)) for t in texts[a:b]]
                sizes = np.array([len(c) + 1 for c in own])
                at = np.repeat(np.arange(a, b), sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.repeat(np.arange(b - a), sizes), pa.int64()), ids.take(pa.array(at)),
                        pa.array(np.repeat([c.total() for c in own], sizes), pa.int64()),
                        pa.array([t for c in own for t in (None, *c)], pa.binary()),
                        pa.array([t for c in own for t in (None, *c.values())], pa.int64()),
                    ],
                    names=["row", "id", "n", "term", "tf"],
                )
                row += b - a

    source = rows.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"cast(`{text_col}` as string) AS text")
    return source.mapInArrow(run, "row bigint, id bigint, n bigint, term binary, tf bigint")


def stage_of(df: str, total: str) -> str:
    """SQL for a term's owner by the number of documents that hold it."""
    cases = " ".join(f"WHEN {df} * {part} <= {total} THEN {k}" for k, part in enumerate(OWNERS))
    return f"CASE {cases} ELSE {len(OWNERS)} END"


def postings(hits: DataFrame, weights: DataFrame, total: int, length: int, blocks: int) -> DataFrame:
    """``owner, block, team, tid, row, id, part``: what a document's term adds, for each group of items that asks for the term."""
    m = f"(100 - 90 + ((90 * n * {total}L) div {length}L))"
    part = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 8 * {m}))").alias("part")
    joined = join_for(weights)(hits, weights, ["tid"], ["row"])
    return joined.select(
        "owner", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.explode("teams").alias("team"), "tid", "row", "id", part
    ).where("part > 0")


def bundles(asked: DataFrame, blocks: int) -> DataFrame:
    """``block, team, item, item_id, tids, ws, owners, rows, ids, sums``: every item in every block, with nothing met so far."""
    own = asked.groupBy("team", "item", "item_id").agg(F.sort_array(F.collect_list(F.struct("tid", "w", "owner"))).alias("_t"))
    return own.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "team", "item", "item_id",
        F.col("_t.tid").alias("tids"), F.col("_t.w").alias("ws"), F.col("_t.owner").alias("owners"),
        *[F.array().cast("array<bigint>").alias(c) for c in ("rows", "ids", "sums")],
    )


BUNDLE = "block int, team int, item bigint, item_id bigint, tids array<bigint>, ws array<bigint>, owners array<int>, rows array<bigint>, ids array<bigint>, sums array<bigint>"


def through(carried: DataFrame, owned: DataFrame, owner: int, best: int) -> DataFrame:
    """The bundles after the stage that owns the postings ``owned``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        left, right = left.combine_chunks(), right.combine_chunks()
        items = left.num_rows
        cells = {c: _cells(left.column(c)) for c in ("tids", "ws", "owners", "rows", "sums")}
        # The documents of this block that a bundle carries or a posting names, in one order.
        carried_rows, new_rows = cells["rows"][0], right.column("row").to_numpy()
        known, first = np.unique(np.concatenate([carried_rows, new_rows]), return_index=True)
        id_values = pa.concat_arrays([_flat(left.column("ids")), *right.column("id").chunks]).take(pa.array(first))
        sums = np.zeros((items, len(known)), np.int64)
        owner_of_cell = np.repeat(np.arange(items), np.diff(cells["rows"][1]))
        sums[owner_of_cell, np.searchsorted(known, carried_rows)] = cells["sums"][0]
        # Postings by term, and the items that ask for each.
        tid = right.column("tid").to_numpy()
        order = np.argsort(tid, kind="stable")
        tid, at, part = tid[order], np.searchsorted(known, new_rows)[order], right.column("part").to_numpy()[order]
        asks = np.repeat(np.arange(items), np.diff(cells["tids"][1]))
        mine = cells["owners"][0] == owner
        wanted, asking = cells["tids"][0][mine], asks[mine]
        by_term = np.argsort(wanted, kind="stable")
        wanted, asking = wanted[by_term], asking[by_term]
        for term in np.unique(tid):
            a, b = np.searchsorted(tid, [term, term + 1])
            x, y = np.searchsorted(wanted, [term, term + 1])
            sums[asking[x:y, None], at[None, a:b]] += part[None, a:b]
        # What later owners could add at most, and the block's last wanted sum.
        later = np.zeros(items, np.int64)
        after = cells["owners"][0] > owner
        np.add.at(later, asks[after], cells["ws"][0][after] * MOST)
        if sums.shape[1] > best:
            last = np.partition(sums, sums.shape[1] - best, axis=1)[:, sums.shape[1] - best]
        else:
            last = np.zeros(items, np.int64)
        keep = (sums > 0) & (sums + later[:, None] >= last[:, None])
        who, where = np.nonzero(keep)
        ends = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])
        columns = {
            "rows": _lists(ends, pa.array(known[where])), "ids": _lists(ends, id_values.take(pa.array(where))),
            "sums": _lists(ends, pa.array(sums[who, where])),
        }
        return pa.table([columns.get(c, left.column(c)) for c in left.column_names], names=left.column_names)

    keys = ["block", "team"]
    return carried.groupBy(*keys).cogroup(owned.groupBy(*keys)).applyInArrow(run, BUNDLE)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in column.chunks])


def _cells(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a list column, and where each list begins and ends."""
    lengths = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in column.chunks])
    return _flat(column).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def search(
    documents: DataFrame, items: DataFrame, best: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The ``best`` documents of each item by lexical score: ``item, item_id, rank, doc_id, score``.

    Terms, weights and scores are whole numbers as in the README; a document counts with
    a score above 0, equal scores go by ascending document id, null ids last, and rows
    of one id by their order in the table. A null or empty text has no term: such a
    document is never found and not counted, such an item finds nothing. Every row of
    ``items`` is asked for itself, also where ids repeat or are null; ``item`` tells
    them apart. Empty tables give an empty result. Texts are taken whole; only their
    distinct terms travel. Other columns, whatever their names, are not looked at.
    """
    spark = documents.sparkSession
    asked = stored(counted(items, item_col, item_text_col).where("term IS NOT NULL").select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term"), "items")
    vocabulary = stored(number_rows(asked.select("term").distinct(), ["term"], "tid"), "vocabulary")
    all_rows = counted(documents, id_col, text_col)
    find = join_for(vocabulary)
    hits = stored(find(all_rows, vocabulary, ["term"], ["row"], "left").where("tid IS NOT NULL OR term IS NULL").drop("term"), "hits")
    sizes = hits.where("tid IS NULL").agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("total"), F.sum("n").alias("length"), F.count(F.lit(1)).alias("rows")
    ).first()
    empty = spark.createDataFrame([], "item bigint, item_id bigint, rank int, doc_id bigint, score bigint")
    if not sizes.total:
        return empty
    total, length, blocks = int(sizes.total), int(sizes.length), -(-int(sizes.rows) // BLOCK)
    found = hits.where("tid IS NOT NULL")
    teams = -(-asked.select("item").distinct().count() // GROUP)
    if not teams:
        return empty
    teamed = find(asked, vocabulary, ["term"], ["item"]).select("item", "item_id", "tid", F.pmod(F.xxhash64("item"), F.lit(teams)).cast("int").alias("team"))
    df = found.groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    weights = stored(
        teamed.groupBy("tid").agg(F.collect_set("team").alias("teams")).join(df, "tid").select(
            "tid", "teams", F.expr(stage_of("df", f"{total}L")).alias("owner"),
            F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.col("df") + 1))).cast("bigint").alias("w"),
        ),
        "weights",
    )
    weighed = join_for(weights)(teamed, weights.drop("teams"), ["tid"], ["item"])
    parts = stored(postings(found, weights, total, length, blocks), "postings")
    carried = bundles(weighed, blocks)
    for owner in range(len(OWNERS) + 1):
        carried = through(carried, parts.where(F.col("owner") == owner).select("block", "team", "tid", "row", "id", "part"), owner, best)
    met = carried.select("item", "item_id", F.explode(F.arrays_zip("rows", "ids", "sums")).alias("d"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    scored = met.select("item", "item_id", F.col("d.rows").alias("row"), F.col("d.ids").alias("doc_id"), F.col("d.sums").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("item", "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
