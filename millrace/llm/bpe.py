"""BPE encoding and decoding with a contiguous rank array.

A word is a short array of parts with the rank of every adjacent pair beside
it. The lowest rank is found by scanning, the boundary it stands for is
deleted, and the one or two neighbouring ranks are looked up again. Words of
like length are rows of one matrix, so numpy takes a step for thousands of words
at once. Words of more than ``SHORT_WORD`` symbols, for which scanning would take
quadratic time, take the same merges in the same order from a heap.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.common import lists, slices, texts_of

SHORT_WORD = 128
#: Entries that the caches of white-space-free chunks and of words may hold in a
#: Python worker before they start anew.
CACHED = 400_000
#: Characters, or tokens, after which a batch is handed on.
HAND_ON = 1_000_000

_NEVER = np.int32(2**31 - 1)
_SPACE = regex.compile(r"\p{White_Space}+")
#: Python splits at the information separators, the tokenizer's pattern does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Beyond these letters the Unicode versions of libraries differ, so that the
#: tokenizer's own normalizer and pattern are asked.
_FAR = regex.compile("[^\x00-\u024f]")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PairRanks:
    """Rank of a pair of ids, looked up for whole arrays: a hash table in two numpy arrays."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NEVER, dtype=np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        slots = self._slots(keys)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots.tolist(), strict=True)):
            while self.keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(keys.shape, _NEVER, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys[todo]
        slots = self._slots(keys)
        while len(todo):
            there = self.keys[slots]
            hit = there == keys
            out[todo[hit]] = self.ranks[slots[hit]]
            on = ~hit & (there != -1)
            todo, keys = todo[on], keys[on]
            slots = (slots[on] + 1) & ((1 << self.bits) - 1)
        return out


class WordBpe:
    """A lower-casing byte-pair vocabulary with word ends, read from a tokenizer file.

    The file's parts that matter here: vocabulary, merges, the suffix of a
    word's last symbol, the pattern of a word, and the special tokens, which are
    found in the raw text before anything else.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        own = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = own.normalizer, own.pre_tokenizer
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        suffix: str = model["end_of_word_suffix"] or ""
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        pairs = [(vocab[a], vocab[b]) for a, b in model["merges"]]
        self.pairs = PairRanks(pairs)
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.result = np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int32)
        shown = byte_symbols()
        self.byte_of = {c: b for b, c in shown.items()}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[shown[b] + suffix] for b in range(256)], dtype=np.int32)
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.tokens = pa.array([names.get(i, "") for i in range(max(names) + 1)])
        # Ids as the bytes of 32-bit integers, by word or chunk.
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    # ---- one word, or many of like length

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as the bytes of 32-bit integers."""
        found: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_width.setdefault((len(word) - 1).bit_length(), []).append(k)
        for bits, group in by_width.items():
            width = 1 << bits
            step = max(1, 500_000 // width) if width <= SHORT_WORD else 1
            for k in range(0, len(group), step):
                part = group[k : k + step]
                ids = self.merge_matrix([words[i] for i in part], width) if width <= SHORT_WORD else [self.merge_long(words[part[0]])]
                for i, x in zip(part, ids, strict=True):
                    found[i] = x
        return found

    def merge_matrix(self, words: list[bytes], width: int) -> list[bytes]:
        """Parts and ranks of words of up to ``width`` symbols, a row each."""
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(-1, width)
        columns = np.arange(width)
        parts = np.where(columns < (sizes - 1)[:, None], self.inner[data], self.last[data])
        parts = np.where(columns < sizes[:, None], parts, -1).astype(np.int32)
        parts = np.hstack([parts, np.full((len(words), 1), -1, np.int32)])
        ranks = self.pairs.of(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(-1, width)
        live = np.arange(len(words))
        done = np.empty_like(parts)
        shift = np.arange(width + 1)
        while len(live):
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(live)), at]
            on = low != _NEVER
            if not on.all():
                done[live[~on]] = parts[~on]
                live, parts, ranks, at, low = live[on], parts[on], ranks[on], at[on], low[on]
                if not len(live):
                    break
            row = np.arange(len(live))
            # Delete the boundary: what stands to its right moves one place left.
            take = np.minimum(shift + (shift > at[:, None]), width)
            parts = np.take_along_axis(parts, take, axis=1)
            parts[:, -1] = -1
            parts[row, at] = self.result[low]
            ranks = np.take_along_axis(ranks, np.minimum(take[:, :-1], width - 1), axis=1)
            ranks[:, -1] = _NEVER
            # The two neighbouring ranks.
            ranks[row, at] = self.pairs.of(parts[row, at], parts[row, at + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.of(parts[left, at[left] - 1], parts[left, at[left]])
        ends = np.cumsum(4 * (done >= 0).sum(axis=1)).tolist()
        flat = done[done >= 0].tobytes()
        return [flat[start:end] for start, end in zip([0, *ends], ends, strict=False)]

    def merge_long(self, word: bytes) -> bytes:
        """The same merges, lowest rank first and leftmost on ties, from a heap."""
        data = np.frombuffer(word, dtype=np.uint8)
        parts = self.inner[data].tolist()
        parts[-1] = int(self.last[data[-1]])
        get, end = self.rank.get, len(parts)
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        heap = []
        for i in range(end - 1):
            if (rank := get((parts[i], parts[i + 1]))) is not None:
                heap.append((rank, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        while heap:
            low, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else end
            if j >= end or parts[j] != right:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = int(self.result[low]), -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < end:
                    pair = parts[k], parts[after[k]]
                    if (rank := get(pair)) is not None:
                        heapq.heappush(heap, (rank, k, *pair))
        return np.array([p for p in parts if p >= 0], dtype=np.int32).tobytes()

    # ---- whole texts

    def split(self, chunk: str) -> list[bytes]:
        """The words of a chunk, as bytes."""
        if not chunk.isascii() and _FAR.search(chunk):
            return [bytes(self.byte_of[c] for c in w) for w, _ in self.pre_tokenizer.pre_tokenize_str(chunk)]
        return [w.encode() for w in self.word.findall(chunk)]

    def chunked(self, text: str) -> list[str]:
        """A normalized text's pieces between white space; no word reaches across it."""
        if _FAR.search(text):
            text = self.normalizer.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).lower()
        return _SPACE.split(text) if _SEPARATORS.search(text) else text.split()

    def learn(self, chunks: set[str]) -> None:
        """Put into the caches what of ``chunks`` isn't there."""
        if len(self.chunks) > CACHED:
            self.chunks.clear()
        if len(self.words) > CACHED // 2:
            self.words.clear()
        new = chunks.difference(self.chunks)
        plain = [c for c in new if c.isalpha() and (c.isascii() or not _FAR.search(c))]
        self.chunks.update(zip(plain, self.merge_words([c.encode() for c in plain]), strict=True))
        mixed = {c: self.split(c) for c in new.difference(plain)}
        words = list(set(chain.from_iterable(mixed.values())).difference(self.words))
        self.words.update(zip(words, self.merge_words(words), strict=True))
        get = self.words.__getitem__
        for chunk, own in mixed.items():
            self.chunks[chunk] = b"".join(map(get, own))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of whole texts."""
        plan = []
        for text in texts:
            pieces, start = [], 0
            for found in self.special.finditer(text) if self.special and "<" in text else ():
                pieces += [self.chunked(text[start : found.start()]), np.int32(self.specials[found[0]]).tobytes()]
                start = found.end()
            plan.append([*pieces, self.chunked(text[start:] if start else text)])
        self.learn(set().union(*(p for pieces in plan for p in pieces if isinstance(p, list))))
        get = self.chunks.__getitem__
        return [
            np.frombuffer(b"".join(b"".join(map(get, p)) if isinstance(p, list) else p for p in pieces), dtype="<i4")
            for pieces in plan
        ]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token names joined by spaces, as a file without a decoder asks; no ids give an empty text."""
        start, end = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
        names = self.tokens.take(ids.values.slice(start, end - start))
        return pc.binary_join(pa.ListArray.from_arrays(pc.subtract(ids.offsets, start), names), " ")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> WordBpe:
    """One vocabulary and its caches per Python worker."""
    return WordBpe(path)


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: ``id, ids array<int>``.

    One row out for each row in, repeated rows included. Null and empty texts
    give an empty array; a null id stays null. Other columns are not looked at,
    whatever their names. ``path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = texts_of(batch, "text")
            for first, last in slices(batch, [len(t) for t in texts], HAND_ON):
                ids = bpe.encode(texts[first:last])
                flat = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), lists(flat, [len(x) for x in ids], pa.int32())],
                    names=["id", "ids"],
                )

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of the ids that ``encode`` gave: ``id, ids, decoded string``.

    Special tokens are kept. An empty or null array gives an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = batch.column(1)
            if ids.null_count:
                ids = pa.array([x or [] for x in ids.to_pylist()], type=pa.list_(pa.int32()))
            sizes = pc.list_value_length(ids).to_pylist()
            for first, last in slices(batch, sizes, HAND_ON):
                part = ids.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), part, bpe.decode(part)],
                    names=["id", "ids", "decoded"],
                )

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
