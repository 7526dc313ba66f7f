"""Periodic runs of words, found with a recompression grammar.

A run is a stretch of words with smallest period ``q`` that no neighbouring word
extends keeping it, at least ``LEAST_LENGTH`` words and ``LEAST_PERIODS`` periods
long. A worker takes documents together, each behind a separator of its own, so
that nothing is ever equal across documents.

Candidates lie on a harmonic grid: a run of period ``q`` repeats the words of its
first two periods, so that at one multiple of ``q`` (of ``WINDOW`` for smaller
periods) the next ``WINDOW`` words are the words ``q`` further on. Only grid points
where a hash of these words agrees are asked about; equal words have equal hashes,
so that none is missed.

The documents with candidates are compressed to a run-length grammar. Rounds
alternate: blocks of one symbol become a symbol each, then the symbols are divided
into left and right ones and each left one followed by a right one becomes a
symbol with it. What is equal is compressed alike but near its ends, so how far two
places agree is found by climbing the grammar where both are at the beginning of
equal symbols, stepping over equal symbols or over what two blocks share, and
descending where symbols differ. That answers exactly how far a candidate extends
in both directions, in steps that grow with the height of the grammar.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_LENGTH, LEAST_PERIODS = 24, 3
#: Words that must agree at a grid point; a run of period ``q`` has at least ``max(24 - q, 2 * q)`` places where the word
#: ``q`` further on is the same, hence a multiple of 8 (of ``q``, from 8 on) with 8 such places from there.
WINDOW = 8
#: Words of documents that are worked on together, and grid points at once.
TOGETHER, GRID = 1 << 18, 1 << 22

_MULTIPLY = np.random.default_rng(11).integers(1, 2**62, size=WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Grammar:
    """A run-length grammar of a sequence whose first and last symbols occur once.

    The symbols of all rounds lie in one array, round after round. ``parent`` is the
    place of the symbol that a symbol went into (-1 in the last round), ``head`` and
    ``tail`` those of a symbol's first and last part, ``reach`` and ``since`` the last
    and first place of the block that a symbol lies in.
    """

    def __init__(self, codes: np.ndarray):
        symbols, parents, heads, tails, reach, since, base = [], [], [], [], [], [], 0
        level, first, last = np.unique(codes, return_inverse=True)[1].astype(np.int64), None, None
        blocks, idle = True, 0
        while True:
            size = len(level)
            start = self._blocks(level) if blocks else self._pairs(level, len(symbols) + idle)
            whole = len(start) == size
            if whole and size > 1 and idle < 2:  # nothing to compress in this round
                blocks, idle = not blocks, idle + 1
                continue
            idle = 0
            place = np.arange(base, base + size)
            ends = np.append(start[1:], size)
            symbols.append(level)
            heads.append(place if first is None else first)
            tails.append(place if last is None else last)
            parent = np.repeat(np.arange(len(start)), ends - start)
            if blocks:
                reach.append(base + ends[parent] - 1)
                since.append(base + start[parent])
            else:
                reach.append(place)
                since.append(place)
            if whole:
                parents.append(np.full(size, -1))
                break
            parents.append(base + size + parent)
            first, last = base + start, base + ends - 1
            parts = (ends - start) if blocks else np.where(ends - start == 2, level[ends - 1] + 1, 0)
            level = np.unique(level[start] * (parts.max() + 1) + parts, return_inverse=True)[1]
            base, blocks = base + size, not blocks
        kind = np.int64 if base > 2**31 - 2**20 else np.int32
        self.symbol, self.parent, self.head, self.tail, self.reach, self.since = (
            np.concatenate(x).astype(kind) for x in (symbols, parents, heads, tails, reach, since)
        )
        self.rounds = len(symbols)
        self.first = np.zeros(len(self.symbol), bool)
        self.last = np.zeros(len(self.symbol), bool)
        inner = np.flatnonzero(self.parent >= 0)
        self.first[inner] = self.head[self.parent[inner]] == inner
        self.last[inner] = self.tail[self.parent[inner]] == inner

    @staticmethod
    def _blocks(level: np.ndarray) -> np.ndarray:
        """Where each block of one symbol starts."""
        return np.flatnonzero(np.append(True, level[1:] != level[:-1]))

    @staticmethod
    def _pairs(level: np.ndarray, turn: int) -> np.ndarray:
        """Where each pair or single symbol starts, for a division that joins a quarter of the neighbours, or the best of some."""
        best = None
        for salt in range(8 * turn, 8 * turn + 8):
            mixed = (level.astype(np.uint64) + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left = (mixed >> np.uint64(40)) & np.uint64(1) == 1
            for side in (left, ~left):
                joined = side[:-1] & ~side[1:]
                count = np.count_nonzero(joined)
                if best is None or count > best[0]:
                    best = count, joined
            if 4 * best[0] >= len(level) - 1:
                break
        return np.flatnonzero(np.append(True, ~best[1]))

    def _agreement(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols of the first round agree from ``x`` and ``y`` on, these included.

        Both go through the same rounds; where they end, they have come to different
        symbols of the first round, so that the way of ``x`` is the answer.
        """
        edge, part, stop = (self.first, self.head, self.reach) if forward else (self.last, self.tail, self.since)
        symbol, parent = self.symbol, self.parent
        a, b = x.astype(np.int64), y.astype(np.int64)
        found, active = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(active):
            p, q = parent[a], parent[b]
            up = edge[a] & edge[b] & (symbol[p] == symbol[q])
            same = symbol[a] == symbol[b]
            step = same & ~up
            if forward:
                way = np.minimum(stop[a] - a, stop[b] - b) + 1
            else:
                way = -np.minimum(a - stop[a], b - stop[b]) - 1
            down = ~same
            ended = down & (part[a] == a)
            a, b = (np.where(up, p, np.where(step, a + way, np.where(down, part[a], a))), np.where(up, q, np.where(step, b + way, np.where(down, part[b], b))))
            if ended.any():
                found[active[ended]] = a[ended]
                going = ~ended
                a, b, active = a[going], b[going], active[going]
        return np.abs(found - x)

    def after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the longest common stretches that begin at ``x`` and ``y``, which differ."""
        return self._agreement(x, y, True)

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the longest common stretches that end at ``x`` and ``y``, which differ."""
        return self._agreement(x, y, False)


def grid(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid points of one document whose next ``WINDOW`` words agree with those a period on: places and periods."""
    n = len(codes)
    if n < LEAST_LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    window = np.zeros(n - WINDOW + 1, np.uint64)
    own = codes.astype(np.uint64) + np.uint64(1)
    for k in range(WINDOW):
        window += own[k : k + len(window)] * _MULTIPLY[k]
    window ^= window >> np.uint64(32)
    periods = np.arange(1, n // LEAST_PERIODS + 1)
    spacing = np.maximum(periods, WINDOW)
    counts = (len(window) - 1 - periods) // spacing + 1
    periods, spacing, counts = periods[counts > 0], spacing[counts > 0], counts[counts > 0]
    ends = np.cumsum(counts)
    places, found, at = [], [], 0
    while at < len(periods):  # so many periods at once as GRID points allow
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GRID)))
        own = counts[at:to]
        turn = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        place = turn * np.repeat(spacing[at:to], own)
        period = np.repeat(periods[at:to], own)
        on = window[place] == window[place + period]
        places.append(place[on])
        found.append(period[on])
        at = to
    return np.concatenate(places or [np.empty(0, np.int64)]), np.concatenate(found or [np.empty(0, np.int64)])


def runs_of(documents: list[np.ndarray]) -> list[np.ndarray]:
    """For each document, given as codes of its words, its runs as rows start, length, period by start, then period."""
    none = np.empty((0, 3), np.int64)
    result = [none] * len(documents)
    asked = [(k, *grid(codes)) for k, codes in enumerate(documents)]
    asked = [x for x in asked if len(x[1])]
    if not asked:
        return result
    top = max(int(documents[k].max()) for k, *_ in asked) + 1
    parts, offsets, at = [], [], 0
    for turn, (k, *_) in enumerate(asked):
        parts += [np.array([top + turn]), documents[k]]
        offsets.append(at + 1)
        at += len(documents[k]) + 1
    grammar = Grammar(np.concatenate([*parts, [top + len(asked)]]))
    start = np.repeat(offsets, [len(x[1]) for x in asked])
    owner = np.repeat(np.arange(len(asked)), [len(x[1]) for x in asked])
    period = np.concatenate([x[2] for x in asked])
    x = start + np.concatenate([x[1] for x in asked])
    right, left = grammar.after(x, x + period), grammar.before(x - 1, x - 1 + period)
    length = left + right + period
    on = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period)
    rows = np.stack([owner, x - left - start, length, period], axis=1)[on]
    rows = np.unique(rows, axis=0)  # by owner, start, length, period
    if len(rows):  # a multiple of the period finds the same stretch again
        rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))]
    for turn in np.unique(rows[:, 0]):
        own = rows[rows[:, 0] == turn][:, 1:]
        result[asked[turn][0]] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return result


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [w for w, inside in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not inside]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods; of equal ones that with the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _results(ids: list, texts: list[bytes]) -> pa.RecordBatch:
    codes: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    numbers = [np.array([codes.setdefault(w, len(codes)) for w in own], np.int64) for own in words]
    runs = runs_of(numbers)
    named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()] for own in runs]
    best = [strongest([tuple(r) for r in own.tolist()]) for own in runs]
    collapsed = [b" ".join(kept_words(own, r)) for own, r in zip(words, runs, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(named, pa.list_(_RUN)),
            pa.array([None if b is None else dict(zip(("start", "length", "period"), b, strict=True)) for b in best], _RUN),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ],
        names=["id", "n_words", "runs", "strongest", "collapsed"],
    )


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of each text's words: ``id, n_words, runs, strongest, collapsed``, one row per row in.

    Words are what ASCII white space leaves, numbered from 0. ``runs`` holds ``start,
    length, period`` by start, then period; ``strongest`` the one with most periods
    (ties: smallest start, then period), null without runs; ``collapsed`` the words that
    no run holds after its first period, joined by one space. A null text counts as
    empty: no words, no runs, an empty ``collapsed``. Rows may repeat and ids may be
    null; each row stands alone. Other columns, whatever their names, are not looked
    at. An empty table gives an empty table. Texts are taken whole: a worker holds
    about 100 bytes for each word of the longest text that has candidates. Nothing is
    shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = (text or "").encode("utf-8", "surrogatepass")
                if texts and size + len(own) > 6 * TOGETHER:
                    yield _results(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(key)
                texts.append(own)
                size += len(own)
            if texts:
                yield _results(ids, texts)

    rows = documents.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"cast(`{text_col}` as string) AS text")
    run_type = "struct<start: bigint, length: bigint, period: bigint>"
    return rows.mapInArrow(run, f"id bigint, n_words bigint, runs array<{run_type}>, strongest {run_type}, collapsed string")
