"""Embedding near-duplicates by an exact metric range join.

Vectors are compared by the angle between them, which is a metric. Pivots drawn
from the vectors cut the space into cells: a vector is at home with its nearest
pivot. Two vectors within an angle ``r`` of each other differ by at most ``r`` in
their distance to any pivot, so a vector is also sent to each cell where it may
have a partner: where its distance to the pivot is at most the cell's radius plus
``r``, and at most its distance to its own pivot plus ``2 r``. Cells are then
joined independently, and each vector finds all its partners in its home cell.

Vectors of one direction and length are compared once, as a class with a size.
A cell with many vectors at home is split into chunks, each of which meets all
vectors sent to the cell as a stream, so that a task holds one chunk and one
batch. Per vector a task gives a count and one link to the group it belongs to in
that chunk, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import classes_of, stored
from millrace.operators.scaling import spread_join

#: Vectors for each pivot, and the most pivots there may be: they are broadcast.
PER_PIVOT, MAX_PIVOTS = 8192, 4096
#: Vectors at home in a chunk.
CHUNK = 4096
#: Allowance for rounding when cells are chosen; the comparison itself needs none.
SLACK = 1e-6


def usable(vector) -> bool:
    """Whether a vector has a direction: there, finite, not zero."""
    return vector is not None and len(vector) > 0 and bool(np.isfinite(vector).all()) and bool(np.any(vector))


def _vectors(column: pa.ListArray) -> list[np.ndarray | None]:
    return [None if v is None or any(x is None for x in v) else np.array(v, dtype=np.float64) for v in column.to_pylist()]


def unit(vector: np.ndarray) -> np.ndarray:
    """The direction, scaled first so that no square overflows or vanishes."""
    scaled = vector / np.abs(vector).max()
    return scaled / math.sqrt(float(scaled @ scaled))


def directions(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, direction`` with a null direction where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [unit(v).tobytes() if v is not None and usable(v) else None for v in _vectors(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, type=pa.binary())], names=["id", "direction"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "id bigint, direction binary")


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def near(
    vectors: DataFrame,
    least_cosine: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    per_pivot: int = PER_PIVOT,
    chunk: int = CHUNK,
) -> DataFrame:
    """Links between all vectors: ``id, n_links, component_id, kept``, one row per row in.

    ``n_links`` counts the other rows whose cosine, in double precision, is at
    least ``least_cosine``; ``component_id`` is the smallest id reachable by
    links, ``kept`` whether that is the row's own. Vectors that are null, empty,
    zero, or hold a null or a component that isn't finite link with nothing;
    neither do vectors of different length. Rows with one id count as rows of
    their own but stand for one node. A row without an id is kept, counts for
    others, and is its own component (null). Other columns are not looked at.
    """
    spark = vectors.sparkSession
    radius = math.acos(least_cosine) + SLACK
    rows = stored(directions(vectors, id_col, vector_col), "directions")
    classes = stored(
        rows.where("direction IS NOT NULL").groupBy("direction").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
        .select("direction", "size", "least", F.xxhash64("direction").alias("node"), F.length("direction").alias("width")),
        "directions-classes",
    )
    pivots = _pivots(classes, per_pivot)
    shared = spark.sparkContext.broadcast(pivots)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, distances = _homes(batch.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(cells, pa.int32()), pa.array(distances, pa.float64())],
                names=["direction", "size", "node", "width", "cell", "distance"],
            )

    homes = stored(
        classes.mapInArrow(at_home, "direction binary, size bigint, node bigint, width int, cell int, distance double"),
        "directions-homes",
    )
    # One number per cell: pivots are at most MAX_PIVOTS for each length of vectors.
    sizes = {
        (r["width"], r["cell"]): (r["far"], r["n"])
        for r in homes.groupBy("width", "cell").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    }
    extent = spark.sparkContext.broadcast(sizes)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once to a chunk of its home cell, and to every chunk of cells where it may have partners."""
        for batch in batches:
            own, size, node, width, cell, distance = (batch.column(k).to_pylist() for k in range(6))
            out = {"direction": [], "size": [], "node": [], "width": [], "cell": [], "chunk": [], "guest": []}

            def put(k: int, where: int, part: int, guest: int, out=out, own=own, size=size, node=node, width=width) -> None:
                for name, value in zip(out, (own[k], size[k], node[k], width[k], where, part, guest), strict=True):
                    out[name].append(value)

            for w in sorted(set(width)):
                rows_at = [k for k in range(len(own)) if width[k] == w]
                cells = sorted(c for v, c in extent.value if v == w)
                far = np.array([extent.value[w, c][0] for c in cells])
                if w in shared.value:
                    angles = _angles(np.stack([np.frombuffer(own[k]) for k in rows_at]), shared.value[w])[:, cells]
                    mine = np.array([distance[k] for k in rows_at])[:, None]
                    meets = (angles <= far + radius) & (angles <= mine + 2 * radius)
                else:
                    meets = np.ones((len(rows_at), len(cells)), dtype=bool)
                for k, row in zip(rows_at, meets, strict=True):
                    put(k, cell[k], node[k] % _chunks(extent.value[w, cell[k]][1], chunk), 0)
                    for c in np.flatnonzero(row):
                        for part in range(_chunks(extent.value[w, cells[c]][1], chunk)):
                            put(k, cells[c], part, 1)
            for a in range(0, len(own) and len(out["node"]), 2000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[a : a + 2000], type=t) for v, t in zip(out.values(), _SENT, strict=True)], names=list(out)
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts and groups of each chunk; rows come sorted by chunk, those at home first."""
        current = None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True))
            guest = batch.column(6).to_numpy()
            cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if current is None or current.key != keys[a]:
                    if current is not None:
                        yield from current.results()
                    current = _Chunk(keys[a], least_cosine)
                part = batch.slice(a, b - a)
                own = np.stack([np.frombuffer(x) for x in part.column(0).to_pylist()])
                size, node, is_guest = part.column(1).to_numpy(), part.column(2).to_numpy(), guest[a:b] == 1
                current.add_home(own[~is_guest], size[~is_guest], node[~is_guest])
                if is_guest.any():
                    yield from current.meet(own[is_guest], size[is_guest], node[is_guest])
        if current is not None:
            yield from current.results()

    found = stored(
        homes.mapInArrow(sent, "direction binary, size bigint, node bigint, width int, cell int, chunk int, guest int")
        .repartition("width", "cell", "chunk")
        .sortWithinPartitions("width", "cell", "chunk", "guest", "node")
        .mapInArrow(joined, "node bigint, other bigint, n bigint"),
        "directions-links",
    )
    counts = found.where("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    parts = classes_of(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    # A class that links with no other is its own component; components are named by their smallest id.
    named = classes.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    per_class = spread_join(named, least, ["part"], ["node"]).join(counts, "node", "left").select("direction", "component_id", "n")
    alone = rows.where("direction IS NULL").select("id", F.lit(None).cast("bigint").alias("component_id"), F.lit(None).cast("bigint").alias("n"))
    return (
        rows.where("direction IS NOT NULL").join(per_class, "direction").select("id", "component_id", "n").unionByName(alone)
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
        .select(
            "id", F.coalesce(F.col("n") - 1, F.lit(0)).cast("bigint").alias("n_links"), "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


_SENT = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]


def _chunks(count: int, chunk: int) -> int:
    return max(1, -(-count // chunk))


def _pivots(classes: DataFrame, per_pivot: int) -> dict[int, np.ndarray]:
    """Pivots by the bytes of a direction: those with the smallest hashes, as many as the vectors ask, within a bound."""
    found = {}
    for r in classes.groupBy("width").count().orderBy(F.desc("count")).limit(16).collect():
        wanted = min(MAX_PIVOTS, max(1, -(-r["count"] // per_pivot)))
        rows = classes.where(F.col("width") == r["width"]).select("direction", F.xxhash64("node").alias("_o")).orderBy("_o").limit(wanted)
        found[r["width"]] = np.stack([np.frombuffer(x["direction"]) for x in rows.collect()])
    return found


def _homes(own: list[bytes], pivots: dict[int, np.ndarray]) -> tuple[list[int], list[float]]:
    """The nearest pivot of each direction and the angle to it; lengths without pivots have one cell."""
    cells, distances = [0] * len(own), [0.0] * len(own)
    for width in set(map(len, own)) & set(pivots):
        at = [k for k, x in enumerate(own) if len(x) == width]
        angles = _angles(np.stack([np.frombuffer(own[k]) for k in at]), pivots[width])
        for k, row in zip(at, angles, strict=True):
            cells[k] = int(row.argmin())
            distances[k] = float(row[cells[k]])
    return cells, distances


class _Chunk:
    """The vectors at home in a chunk, and what has been found of them so far."""

    def __init__(self, key: tuple, least_cosine: float):
        self.key, self.least = key, least_cosine
        self.parts: list[tuple] = []
        self.own = None

    def add_home(self, own: np.ndarray, size: np.ndarray, node: np.ndarray) -> None:
        if len(node):
            self.parts.append((own, size, node))

    def _settle(self) -> None:
        if self.own is None:
            self.own = np.concatenate([p[0] for p in self.parts])
            self.node = np.concatenate([p[2] for p in self.parts])
            self.count = np.zeros(len(self.node), dtype=np.int64)
            self.root = np.arange(len(self.node))

    def meet(self, own: np.ndarray, size: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count guests near the vectors at home, and hang the groups that a guest connects together."""
        if not self.parts:
            return
        self._settle()
        linked = self.own @ own.T >= self.least
        self.count += linked @ size
        touched = np.flatnonzero(linked.any(axis=0))
        if not len(touched):
            return
        first = linked[:, touched].argmax(axis=0)
        outside = node[touched] != self.node[first]
        if outside.any():
            yield _batch(node[touched][outside], self.node[first][outside], None)
        # Each pair of groups that some guest connects, once.
        for column in touched[linked[:, touched].sum(axis=0) > 1]:
            roots = np.unique(self.root[linked[:, column]])
            if len(roots) > 1:
                self.root[np.isin(self.root, roots[1:])] = roots[0]

    def results(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self._settle()
        yield _batch(self.node, None, self.count)
        moved = self.root != np.arange(len(self.root))
        if moved.any():
            yield _batch(self.node[moved], self.node[self.root[moved]], None)


def _batch(node: np.ndarray, other: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(node), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.int64()), none if other is None else pa.array(other, pa.int64()), none if n is None else pa.array(n, pa.int64())],
        names=["node", "other", "n"],
    )
