"""MinHash near-duplicates with an LSH forest.

A document's set of word shingles gets a signature of ``FUNCTIONS`` one-byte
minima. The forest is ``ORDERS`` sorted orders of all signatures, each by the
bytes of another random choice of functions: documents alike have long common
prefixes in many orders and stand next to each other. Sorting is by range, so
that a region of very many like signatures lies in many tasks.

First each document is paired with its neighbours in each order that share at
least ``LEAST_DEPTH`` bytes with it. Pairs that the full sets confirm join
documents to groups. Then every region, the classes that share ``LEAST_DEPTH``
bytes in an order, is searched for what is still apart: the classes outside a
region's largest group are compared with the whole region by signatures, and
pairs between different groups whose signatures nearly suffice by their full sets,
which come to where the pairs meet; of the pairs only links come out, one for a class
and a group in a slice at most, since more of them join nothing. No region is cut: a
large one is dealt to slices, and each slice meets all classes outside the largest group. So a dense region costs what its stragglers ask, not all
its pairs; a crowd that is alike but not enough has no large group, and there work
grows with the square of the region.

Copies of one set are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BoundedCache, classes_of, stored
from millrace.operators.scaling import spread_join

WORDS = 5
FUNCTIONS, ORDERS, DEPTH, LEAST_DEPTH = 512, 32, 16, 4
#: Comparisons of signatures from which a region is dealt to several slices.
COMPARED = 1 << 22
#: A pair is compared by its sets if its signatures agree in a share not below the
#: least similarity by more than four standard deviations (0.0191 at 512 functions).
MARGIN = 0.0766
#: Rows of a region that a slice has at home, about.
GATHERED = 8192
CACHED = 400_000
HAND_ON = 2_000_000

_random = np.random.default_rng(20240117)
_MULTIPLY = _random.integers(0, 2**32, size=(FUNCTIONS, 1), dtype=np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 2**32, size=(FUNCTIONS, 1), dtype=np.uint32)
_PLACES = _random.integers(1, 2**63, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The functions of each order, no function in two.
_PICKED = _random.permutation(FUNCTIONS)[: ORDERS * DEPTH].reshape(ORDERS, DEPTH)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets of hashed word shingles; the hashes of words are cached."""

    def __init__(self):
        self.word = BoundedCache(xxhash.xxh3_64_intdigest, CACHED)

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted set of 48-bit hashes of a whole text's shingles.

        A-Z become lower case, words are what ASCII white space leaves. With
        fewer than ``WORDS`` words the whole sequence is the one shingle.
        """
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        codes = np.fromiter(map(self.word.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(words) - WORDS + 1)
        total = np.zeros(n, dtype=np.uint64)
        for k in range(min(WORDS, len(words))):
            total += codes[k : k + n] * _PLACES[k]
        if len(words) < WORDS:
            total += np.uint64(len(words))
        return np.unique(_mixed(total) >> np.uint64(16))


def signature(shingles: np.ndarray) -> bytes:
    """One byte of each function's minimum over a set."""
    low = np.full((FUNCTIONS, 1), 2**32 - 1, dtype=np.uint32)
    folded = (shingles ^ (shingles >> np.uint64(24))).astype(np.uint32)
    for k in range(0, len(folded), 1024):
        x = folded[None, k : k + 1024] * _MULTIPLY + _ADD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(low, x.min(axis=1, keepdims=True), out=low)
    return ((low.ravel() * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def packed(shingles: np.ndarray) -> bytes:
    return (shingles & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (shingles >> np.uint64(32)).astype("<u2").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | (np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def signatures(documents: DataFrame) -> DataFrame:
    """``id, n, node, sig`` of ``id, text``: set size, a hash of the set (null if empty), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = [shingler.shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(x) for x in own], pa.int64()),
                    pa.array([_node(x) for x in own], pa.int64()),
                    pa.array([signature(x) if len(x) else None for x in own], pa.binary()),
                ],
                names=["id", "n", "node", "sig"],
            )

    return documents.mapInArrow(run, "id bigint, n bigint, node bigint, sig binary")


def _node(shingles: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63 if len(shingles) else None


def sets(documents: DataFrame) -> DataFrame:
    """``node, shingles`` of ``id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            own = [shingler.shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(x) for x in own], pa.int64()), pa.array([packed(x) for x in own], pa.binary())],
                names=["node", "shingles"],
            )

    return documents.mapInArrow(run, "node bigint, shingles binary")


def dealt(classes: DataFrame, columns: list[str], depth: int) -> DataFrame:
    """A row per order and class, ``tree, key`` (the first ``depth`` bytes) and the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sig")).to_pylist()), np.uint8).reshape(-1, FUNCTIONS)
            rest = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            for tree in range(ORDERS):
                keys = np.ascontiguousarray(sig[:, _PICKED[tree, :depth]]).tobytes()
                key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(depth), len(sig), [None, pa.py_buffer(keys)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sig), tree, np.int32)), key.cast(pa.binary()), *rest], names=["tree", "key", *columns]
                )

    schema = ", ".join(f"{c} {classes.schema[c].dataType.simpleString()}" for c in columns)
    return classes.mapInArrow(run, f"tree int, key binary, {schema}")


def entries(classes: DataFrame, columns: list[str]) -> DataFrame:
    """A row per order and class, ``tree, key`` and the named columns, sorted by range."""
    return dealt(classes, columns, DEPTH).repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """Order and key bytes of a batch as one matrix."""
    key = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, DEPTH)
    return np.hstack([batch.column(0).to_numpy().astype(np.uint8)[:, None], key])


def neighbours(sorted_entries: DataFrame) -> DataFrame:
    """Pairs of classes next to each other with a long enough common prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = np.empty((0, DEPTH + 1), np.uint8), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.vstack([keys[-1:], _keys(batch)])
            nodes = np.concatenate([nodes[-1:], batch.column(2).to_numpy()])
            same = (keys[1:, : LEAST_DEPTH + 1] == keys[:-1, : LEAST_DEPTH + 1]).all(axis=1)
            at = np.flatnonzero(same)
            pairs = np.stack([nodes[at], nodes[at + 1]], axis=1)
            yield _pairs(pairs)

    return sorted_entries.mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(pairs.max(axis=1) if len(pairs) else [], pa.int64()), pa.array(pairs.min(axis=1) if len(pairs) else [], pa.int64())],
        names=["a", "b"],
    )


def regions(labelled: DataFrame) -> DataFrame:
    """``tree, key, most, slices`` of regions with more than one group: the largest group, and how many slices to deal to.

    Slices hold about ``GATHERED`` rows at most. Smaller ones share out comparisons,
    as long as copies for them don't outnumber the region's own rows.
    """
    counted = dealt(labelled, ["label"], LEAST_DEPTH).groupBy("tree", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    found = (
        counted.groupBy("tree", "key")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("groups"))
        .where("groups > 1")
        .withColumn("few", F.col("n") - F.col("most.n"))
    )
    work = F.least(F.ceil(F.col("n") * F.col("few") / COMPARED), F.floor(F.col("n") / F.col("few")) + 1)
    return found.select(
        "tree", "key", F.col("most.label").alias("most"), F.greatest(F.ceil(F.col("n") / GATHERED), work).cast("int").alias("slices")
    )


def straggler_links(labelled: DataFrame, classes: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between different groups of a region: one at least for each class and group of which there are any.

    One of the two is outside the region's largest group. It meets the other
    in the slice where that one is at home, in the first of the orders that have
    both in one region. First slices find the classes of which a pair's signatures
    nearly suffice; these alone meet there again with their full sets.
    """
    found = stored(regions(labelled), "forest-regions")
    members = dealt(labelled, ["node", "label"], LEAST_DEPTH).join(found, ["tree", "key"]).select(
        "node", "tree", "key", "slices", (F.col("label") != F.col("most")).alias("few")
    )
    home = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    sent = members.join(labelled, "node").select(
        "tree", "key", "node", "label", "size", "sig", "few", home.alias("home"),
        F.explode(F.when(F.col("few"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(home))).alias("slice"),
    )
    at = ["tree", "key", "slice"]
    thin = sent.select(*at, (F.col("slice") != F.col("home")).alias("guest"), "few", "node", "label", "size", "sig")
    taking_part = stored(_met(thin, percent, False).distinct(), "forest-stragglers")
    nodes = taking_part.select("node").distinct()
    own = stored(_sets_of(nodes, classes, documents), "straggler-sets")
    again = taking_part.join(labelled, "node").join(own, "node").select(
        *at, "guest", "few", "node", "label", "size", "sig", "shingles"
    )
    return _met(again, percent, True)


def _met(rows: DataFrame, percent: int, by_sets: bool) -> DataFrame:
    """What comes of the slices of ``rows``: links by full sets, or the classes that take part in likely pairs."""
    dealt_out = rows.repartition("tree", "key", "slice").sortWithinPartitions("tree", "key", "slice", "guest", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slice, those at home first: these are held, then guests meet them."""
        current = None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True))
            cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if current is None or current.key != keys[a]:
                    if current is not None:
                        yield from current.ended()
                    current = _Slice(keys[a], percent, by_sets)
                yield from current.add(batch.slice(a, b - a))
        if current is not None:
            yield from current.ended()

    return dealt_out.mapInArrow(run, "a bigint, b bigint" if by_sets else "tree int, key binary, slice int, guest boolean, few boolean, node bigint")


class _Slice:
    """Classes of a region that are at home in a slice, as few, node, label, size, signature and set."""

    def __init__(self, key: tuple, percent: int, by_sets: bool):
        self.key, self.percent, self.least, self.by_sets, self.parts, self.home = key, percent, percent / 100, by_sets, [], None

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        guest = rows.column(3).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(rows.column(8).to_pylist()), np.uint8).reshape(-1, FUNCTIONS)
        own = np.empty(len(sig), object)
        if self.by_sets:
            own[:] = rows.column(9).to_pylist()
        part = (rows.column(4).to_numpy(zero_copy_only=False), *(rows.column(k).to_numpy() for k in (5, 6, 7)), sig, own)
        if not guest.all():
            self.parts.append(tuple(x[~guest] for x in part))
        if guest.any():
            yield from self.closed()
            yield from self.meet(tuple(x[guest] for x in part), True)

    def closed(self) -> Iterator[pa.RecordBatch]:
        """All at home are there; compares them with each other."""
        if self.home is None:
            self.home, self.parts = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (), []
            if self.home:
                self.prefixes = _prefixes(self.home[4])
                self.met = np.zeros(len(self.home[1]), bool)
                yield from self.meet(tuple(x[self.home[0]] for x in self.home), False)

    def ended(self) -> Iterator[pa.RecordBatch]:
        yield from self.closed()
        if self.home and not self.by_sets and self.met.any():
            few, nodes = (x[self.met] for x in self.home[:2])
            yield self._taking_part(few, nodes, False)

    def _taking_part(self, few: np.ndarray, nodes: np.ndarray, guest: bool) -> pa.RecordBatch:
        n = len(nodes)
        tree, key, place = self.key
        columns = [pa.array([tree] * n, pa.int32()), pa.array([key] * n, pa.binary()), pa.array([place] * n, pa.int32())]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([guest] * n, pa.bool_()), pa.array(few, pa.bool_()), pa.array(nodes, pa.int64())],
            names=["tree", "key", "slice", "guest", "few", "node"],
        )

    def meet(self, some: tuple, guests: bool) -> Iterator[pa.RecordBatch]:
        """Compares some classes outside the largest group with those at home."""
        if not self.home or not len(some[1]):
            return
        tree, (few, nodes, labels, sizes, sig, _) = self.key[0], self.home
        own_few, own, groups, n, sig_own, _ = some
        prefixes = _prefixes(sig_own)
        took_part = np.zeros(len(own), bool)
        for k in range(0, len(own), 16):
            at = slice(k, k + 16)
            alike = groups[at, None] != labels[None]
            # Two outside the largest group meet twice, and count where the larger number is asked for.
            alike &= ~few[None] | (own[at, None] > nodes[None])
            alike &= np.minimum(n[at, None], sizes[None]) >= self.least * np.maximum(n[at, None], sizes[None])
            i, j = np.nonzero(alike)
            for c in range(0, len(i), 2048):
                x, y = k + i[c : c + 2048], j[c : c + 2048]
                if tree:
                    first = ~(prefixes[x, :tree] == self.prefixes[y, :tree]).any(axis=1)
                    x, y = x[first], y[first]
                near = _agreeing(sig_own[x], sig[y]) / FUNCTIONS >= self.least - MARGIN
                x, y = x[near], y[near]
                if not len(x):
                    continue
                if self.by_sets:
                    yield self._linked(some, x, y)
                else:
                    took_part[x] = True
                    self.met[y] = True
        if not self.by_sets and guests and took_part.any():
            yield self._taking_part(own_few[took_part], own[took_part], True)
        elif not self.by_sets and took_part.any():  # those at home, in the order of the home
            self.met[np.flatnonzero(few)[took_part]] = True

    def _linked(self, some: tuple, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        """Links among pairs by their full sets; once a class is linked with a group, its other pairs with it are passed over."""
        links, done, last, mine = [], set(), None, None
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            group = (i, int(self.home[2][j]))
            if group in done:
                continue
            if i != last:
                last, mine = i, unpacked(some[5][i])
            other = unpacked(self.home[5][j])
            both = len(np.intersect1d(mine, other, assume_unique=True))
            if 100 * both >= self.percent * (len(mine) + len(other) - both):
                done.add(group)
                links.append((int(some[1][i]), int(self.home[1][j])))
        return _pairs(np.array(links, np.int64).reshape(-1, 2))


def _prefixes(sig: np.ndarray) -> np.ndarray:
    """The first ``LEAST_DEPTH`` bytes of each order as one number."""
    return np.ascontiguousarray(sig[:, _PICKED[:, :LEAST_DEPTH]]).view(np.uint32)[:, :, 0]


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes agree in each row: sums of eight bytes at once, of 64 words at most, so that none overflows."""
    words = (x == y).view(np.uint64)
    return sum(words[:, k : k + 64].sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64) for k in range(0, words.shape[1], 64))


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs whose sizes allow, and whose signatures do not speak against, a similarity of ``least``."""
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, FUNCTIONS) for k in (2, 3))
            on = pa.array((x == y).mean(axis=1) >= least - MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], names=["a", "b"])

    sized = pairs.join(left, "a").join(right, "b").where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def _sets_of(nodes: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """``node, shingles`` of distinct ``node``, made anew from one document of each class."""
    wanted = classes.join(nodes, "node", "left_semi").select(F.col("least").alias("id"))
    return sets(documents.join(wanted, "id", "left_semi")).join(nodes, "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, classes: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough; sets are made anew for the documents that occur."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = stored(_sets_of(nodes, classes, documents), "shingle-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
                keep.append(100 * both >= percent * ((len(x) + len(y)) // 6 - both))
            on = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], names=["a", "b"])

    left = own.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = own.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicates: ``id, n_shingles, component_id, kept``, one row per row in.

    Two documents are linked where 100 times the intersection of their sets of
    five-word shingles is at least ``percent`` times the union; the component is
    the smallest id reachable by links, and its own document is kept. Documents
    with null or empty texts, or without words, have no shingle, are linked with
    nothing and kept. A row without an id is kept, linked with nothing, and has
    no component. Rows with one id stand for one node: each has that node's
    component. Other columns are not looked at.
    """
    least = percent / 100
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(signatures(rows), "signatures")
    named = signed.where("id IS NOT NULL AND node IS NOT NULL")
    classes = stored(
        named.groupBy("node").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.min("sig").alias("sig")), "signature-classes"
    )
    known = rows.where("id IS NOT NULL")
    first = stored(likely(neighbours(entries(classes, ["node"])), classes, least), "forest-pairs")
    links = stored(confirmed(first, classes, known, percent), "forest-links")
    labels = classes_of(links)
    # Who has no likely neighbour may still have a partner further on in a region.
    labelled = stored(
        classes.join(labels, "node", "left")
        .select("node", F.coalesce("component", "node").alias("label"), F.col("n").alias("size"), "sig"),
        "forest-labels",
    )
    more = straggler_links(labelled, classes, known, percent)
    links = stored(links.unionByName(more).distinct(), "forest-all-links")
    # One id may stand for several sets; they are then one node.
    spread = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    same_id = named.join(spread.select("id", "a"), "id").select("a", F.col("node").alias("b"))
    parts = classes_of(links.select("a", "b").unionByName(same_id))
    whole = classes.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    component = whole.groupBy("part").agg(F.min("least").alias("component_id"))
    found = spread_join(whole, component, ["part"], ["node"]).select("node", "component_id")
    linked = named.select("id", "n", "node").join(found, "node").select("id", "n", "component_id")
    alone = signed.where("id IS NULL OR node IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        "id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
