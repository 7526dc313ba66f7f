"""Secret scan: fixed patterns, and a linear-chain conditional random field beside them.

The field tags white-space-delimited tokens of a text as outside, begin or inside
of a secret. A token's features are its shape, the shapes and key words of its
neighbours, and statistics of the whole text. Weights are learned on the driver
from a bounded sample of windows, labelled by the fixed patterns, and from windows
with planted secrets of several tokens and of forms that the patterns miss; the
best tag sequence is found by the Viterbi recursion.

Scores of a token depend on its form and its neighbours' forms, which are cached.
Where "outside" beats the other tags by more than all transitions could make up
for, the best sequence passes through "outside" for certain; the recursion then
runs exactly on the short stretches between such tokens.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BoundedCache, texts_of

# --- fixed values: the base patterns ------------------------------------------
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex"]
LEAST = {"assign": 6, "access": 20, "hex": 24}
# -------------------------------------------------------------------------------

#: Kind of the spans that the field adds.
ADDED = "crf"
#: Texts with and without a base span that windows are learned from, at most, and tokens of a window.
LEARN_TEXTS, WINDOW = 600, 16
#: Rows that are searched for texts to learn from, as a multiple of these texts.
DRAWN = 64
FORMS = 200_000

_SIGNS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`,;:.()[]{}<>"
_HEXADECIMAL = re.compile("[0-9a-fA-F]+")
_KEYS = ("pass", "secret", "token", "key", "auth", "bearer", "credential", "pwd")

OUTSIDE, BEGIN, INSIDE = 0, 1, 2

#: Shape bits of a token.
SHAPES = [
    "len<8", "len8-15", "len16-23", "len24-39", "len40+", "digit", "upper", "lower", "digit+letter", "upper+lower+digit",
    "hex only", "base64 signs", "many digits", "many forms", "assigns", "key word", "quoted", "letters only", "no letter",
    "dictionary-like",
]


def has_any(text: str, words: tuple[str, ...]) -> bool:
    """Whether a text holds one of some words, in either case."""
    low = text.lower()
    return any(w in low for w in words)


def shape(token: str) -> tuple[int, ...]:
    """Numbers of the shape bits that a token has."""
    core = token.strip(_EDGE)
    if core.isalpha() and "=" not in token and token[-1] != ":" and token[0] not in "\"'":
        return word_shape(core, token)
    if "=" in core.rstrip("="):
        core = core.rstrip("=").rpartition("=")[2].strip(_EDGE)
    n = len(core)
    digits = 0 if core.isalpha() else sum(map(str.isdigit, core))
    letters = n if core.isalpha() else sum(map(str.isalpha, core))
    upper, lower = core != core.lower(), core != core.upper()
    changes = sum(1 for a, b in zip(core, core[1:], strict=False) if a.isdigit() != b.isdigit()) if digits else 0
    bits = [
        n < 8, 8 <= n < 16, 16 <= n < 24, 24 <= n < 40, n >= 40, digits > 0, upper, lower, digits > 0 and letters > 0,
        upper and lower and digits > 0, n >= 8 and _HEXADECIMAL.fullmatch(core) is not None, any(c in core for c in "+/_-"),
        n > 0 and digits >= 0.25 * n, changes >= 4, "=" in token or token[-1:] == ":", n > 2 and has_any(token, _KEYS),
        token[:1] in "\"'" and n > 0, n > 0 and letters == n, letters == 0, 0 < letters == n < 16,
    ]
    return tuple([k for k, b in enumerate(bits) if b])


def word_shape(core: str, token: str) -> tuple[int, ...]:
    """The same for a token of letters and punctuation around them, as most are."""
    n = len(core)
    bits = [0 if n < 8 else 1 if n < 16 else 2 if n < 24 else 3 if n < 40 else 4]
    if core != core.lower():
        bits.append(6)
    if core != core.upper():
        bits.append(7)
    if n >= 8 and _HEXADECIMAL.fullmatch(core):
        bits.append(10)
    if n > 2 and has_any(token, _KEYS):
        bits.append(15)
    bits.append(17)
    if n < 16:
        bits.append(19)
    return tuple(bits)


def core_of(token: str, start: int) -> tuple[int, int]:
    """Where a token's own text lies, without quotes, punctuation and a key before ``=``."""
    left = len(token) - len(token.lstrip(_EDGE))
    core = token.strip(_EDGE)
    body = core.rstrip("=")
    if "=" in body:
        cut = body.rindex("=") + 1
        left += cut + len(core[cut:]) - len(core[cut:].lstrip(_EDGE))
        core = core[cut:].strip(_EDGE)
    return start + left, start + left + len(core)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start and then by kind."""
    found = []
    if has_any(text, _SIGNS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


N_SHAPE = len(SHAPES)
#: Own shape, shape of the token before, of the one after; statistics of the text.
N_FILE = 4
N_FEATURES = 3 * N_SHAPE + N_FILE


def file_bits(text: str, tokens: int) -> tuple[int, ...]:
    """Which statistics of the whole text hold: short, many signs of assignment, lines of code, a key word."""
    signs = text.count("=") + text.count(":")
    bits = [tokens < 50, signs >= 0.05 * max(tokens, 1), text.count(";") + text.count("{") >= 3, has_any(text, _KEYS)]
    return tuple(k for k, b in enumerate(bits) if b)


@dataclass(frozen=True)
class Field:
    """Weights by feature and tag, and by a tag and the one after it."""

    emit: np.ndarray
    move: np.ndarray


class Tagger:
    """A field with the shapes of tokens cached; one per task."""

    def __init__(self, field: Field):
        self.field = field
        self.shapes: dict[tuple[int, ...], int] = {}
        self.table = np.zeros((64, 9))
        self.forms = BoundedCache(self._shape, FORMS)
        # Making a token outside changes two transitions, and a third where the token
        # after it must then begin what it was inside of.
        allowed = field.move[field.move > -1e3]
        self.reach = 3 * (allowed.max() - allowed.min())

    def _shape(self, token: str) -> int:
        """The row of the token's shape: its scores as the token, as the one before and as the one after."""
        bits = shape(token)
        if bits not in self.shapes:
            if len(self.shapes) == len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            at, emit = np.array(bits, dtype=int), self.field.emit
            self.table[len(self.shapes)] = np.concatenate([emit[at + k * N_SHAPE].sum(axis=0) for k in range(3)])
            self.shapes[bits] = len(self.shapes)
        return self.shapes[bits]

    def emissions(self, tokens: list[str], text: str) -> np.ndarray:
        own = np.fromiter(map(self.forms.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        own = self.table[own]
        out = own[:, :3].copy()
        out[1:] += own[:-1, 3:6]
        out[:-1] += own[1:, 6:]
        for k in file_bits(text, len(tokens)):
            out += self.field.emit[3 * N_SHAPE + k]
        return out

    def tags(self, tokens: list[str], text: str) -> dict[int, int]:
        """Tags of the tokens that aren't outside."""
        if not tokens:
            return {}
        emit = self.emissions(tokens, text)
        reach = self.reach + max(0.0, (emit[:, INSIDE] - emit[:, BEGIN]).max())
        open_ = np.flatnonzero(emit[:, OUTSIDE] - emit[:, 1:].max(axis=1) <= reach)
        found = {}
        for stretch in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else ():
            first, last = int(stretch[0]), int(stretch[-1])
            path = viterbi(emit[first : last + 1], self.field.move, first > 0, last < len(tokens) - 1)
            found.update({first + k: t for k, t in enumerate(path) if t != OUTSIDE})
        return found

    def added(self, text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        """Spans of the field, whole, that base spans don't cover."""
        tokens = text.split()
        tags = self.tags(tokens, text)
        if not tags:
            return []
        spans: list[list[int]] = []
        for k, m in enumerate(_TOKEN.finditer(text)):
            tag = tags.get(k, OUTSIDE)
            if tag == OUTSIDE:
                continue
            start, end = core_of(m[0], m.start())
            if tag == INSIDE and spans and tags.get(k - 1, OUTSIDE) != OUTSIDE:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([start, end])
        return [(a, ADDED, b) for a, b in spans if not covered(text, a, b, base)]


def covered(text: str, start: int, end: int, base: list[tuple[int, str, int]]) -> bool:
    """Whether base spans, which come by start, hold all from ``start`` to ``end``, but for a closing quote and signs after it."""
    first = start
    for a, _, b in base:
        if a <= start < b:
            start = b
    rest = text[start:end]
    return not rest or start > first and rest[0] in "\"'`" and not any(map(str.isalnum, rest))


def viterbi(emit: np.ndarray, move: np.ndarray, before: bool, after: bool) -> list[int]:
    """The best tags of a stretch whose neighbours, where it has them, are outside."""
    score = emit[0] + (move[OUTSIDE] if before else np.array([0.0, 0.0, -1e9]))
    back = []
    for row in emit[1:]:
        total = score[:, None] + move
        back.append(total.argmax(axis=0))
        score = total.max(axis=0) + row
    if after:
        score = score + move[:, OUTSIDE]
    path = [int(score.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


Window = tuple[list[tuple[int, ...]], list[int]]


def features(tokens: list[str], file: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Of each token its own shape, its neighbours' shapes, and the statistics ``file`` of its text."""
    shapes = [shape(t) for t in tokens]
    base = tuple(3 * N_SHAPE + k for k in file)
    rows = []
    for k, own in enumerate(shapes):
        row = own
        if k:
            row += tuple(N_SHAPE + b for b in shapes[k - 1])
        if k + 1 < len(shapes):
            row += tuple(2 * N_SHAPE + b for b in shapes[k + 1])
        rows.append(row + base)
    return rows


def labelled(text: str) -> tuple[list[str], list[int]]:
    """A text's tokens, and the tags that base spans give them."""
    marks = base_spans(text)
    found = list(_TOKEN.finditer(text))
    tags = [OUTSIDE] * len(found)
    for start, _, end in marks:
        inside = [k for k, m in enumerate(found) if m.start() < end and m.end() > start]
        # The secret is in the last token that a pattern touches; before it stand the key and the sign.
        if inside:
            tags[inside[-1]] = BEGIN
    return [m[0] for m in found], tags


def windows_of(text: str) -> list[Window]:
    """Windows of a text's tokens as features and tags: around base spans, else at even distances."""
    tokens, tags = labelled(text)
    if not tokens:
        return []
    rows = features(tokens, file_bits(text, len(tokens)))
    hits = [k for k, t in enumerate(tags) if t]
    starts = {max(0, k - WINDOW // 2) for k in hits[:4]} | {max(0, len(tokens) * j // 5) for j in range(5)}
    return [(rows[s : s + WINDOW], tags[s : s + WINDOW]) for s in sorted(starts)]


_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ALPHABETS = ("0123456789ABCDEF", "0123456789abcdef", _BASE64[:-2], _BASE64)
_LEADS = (["api_key", "="], ["auth", "="], ["auth:"], ["token", "="], ["credential:"], ["key", ":"], ["password", "="], ["pwd:"])


def _letters(draw: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(draw.choices(alphabet, k=draw.randint(least, most)))


def _with_digit(draw: random.Random, letters: str) -> str:
    at = draw.randrange(len(letters))
    return letters[:at] + draw.choice("0123456789") + letters[at + 1 :]


def _key_block(draw: random.Random) -> tuple[list[str], list[int]]:
    """A key over several lines between its marks."""
    kind = draw.choice([["RSA", "PRIVATE"], ["EC", "PRIVATE"], ["PRIVATE"], ["OPENSSH", "PRIVATE"]])
    lines = [_letters(draw, _BASE64, 64, 64) for _ in range(draw.randint(1, 5))] + [_letters(draw, _BASE64, 20, 62) + draw.choice(["", "=", "=="])]
    head, foot = ["-----BEGIN", *kind, "KEY-----"], ["-----END", *kind, "KEY-----"]
    return [*head, *lines, *foot], [OUTSIDE] * len(head) + [BEGIN] + [INSIDE] * (len(lines) - 1) + [OUTSIDE] * len(foot)


def _broken_key(draw: random.Random) -> tuple[list[str], list[int]]:
    """A key broken by spaces into pieces of one length, behind its name, in quotes or not."""
    lead, alphabet, size = draw.choice(_LEADS), draw.choice(_ALPHABETS), draw.choice([4, 5, 6, 8, 16])
    # A digit in each piece: pieces of letters alone have the shapes of words.
    parts = [_with_digit(draw, _letters(draw, alphabet, size, size)) for _ in range(draw.randint(3, 7))]
    if draw.random() < 0.5:
        parts[0], parts[-1] = f'"{parts[0]}', f'{parts[-1]}"'
    return [*lead, *parts], [OUTSIDE] * len(lead) + [BEGIN] + [INSIDE] * (len(parts) - 1)


def _one_token(draw: random.Random) -> tuple[list[str], list[int]]:
    """An upper-case or mixed key, or a password with other signs, behind its name."""
    lead = draw.choice(_LEADS)
    own = draw.choice([lambda: _letters(draw, draw.choice(_ALPHABETS), 20, 48), lambda: _letters(draw, _BASE64[:-2], 4, 10) + _letters(draw, _BASE64[:-2] + "!#$%&*@", 6, 12)])()
    return [*lead, draw.choice(['"{}"', "{}"]).format(own)], [OUTSIDE] * len(lead) + [BEGIN]


def _no_secret(draw: random.Random) -> tuple[list[str], list[int]]:
    """A word or number over and over, which is no key."""
    word = draw.choice([str.title, str.upper, str.lower])(_letters(draw, _BASE64[26:52], 2, 9))
    word = draw.choice([word, word, word, _letters(draw, _BASE64[52:62], 1, 5)]) + draw.choice(["", "", ".", ",", ":"])
    own = draw.choice([[], *_LEADS]) + [word] * draw.randint(4, 12)
    return own, [OUTSIDE] * len(own)


#: Kinds of planted secrets, and of what looks like them.
PLANTED: tuple[Callable[[random.Random], tuple[list[str], list[int]]], ...] = (_key_block, _broken_key, _one_token, _no_secret)


def planted_windows(text: str) -> list[Window]:
    """Windows of a text with a secret of each kind put between its tokens, drawn by a hash of the text."""
    tokens, tags = labelled(text)
    draw = random.Random(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
    found = []
    for kind in PLANTED if tokens else ():
        own, own_tags = kind(draw)
        at = draw.randint(0, len(tokens))
        near, after = slice(max(0, at - WINDOW), at), slice(at, at + WINDOW)
        file = file_bits(f"{text} {' '.join(own)}", len(tokens) + len(own))
        rows = features(tokens[near] + own + tokens[after], file)
        every = tags[near] + own_tags + tags[after]
        start = max(0, len(tokens[near]) - draw.randint(1, WINDOW // 2 - 2))
        found.append((rows[start : start + WINDOW], every[start : start + WINDOW]))
    return found


def train(windows: list[Window], rounds: int = 120, rate: float = 0.3, l2: float = 1e-3) -> Field:
    """Maximum likelihood by full-batch Adam; forward and backward sums run over all windows at once.

    Without a window that holds a secret, the field tags everything outside.
    """
    move = np.zeros((3, 3))
    move[OUTSIDE, INSIDE] = -1e3  # inside only follows begin or inside
    if not any(any(tags) for _, tags in windows):
        emit = np.zeros((N_FEATURES, 3))
        emit[:, 1:] = -1.0
        return Field(emit, move)
    n, width = len(windows), WINDOW
    real = np.zeros((n, width), dtype=bool)
    gold = np.zeros((n, width), dtype=int)
    at, feature = [], []
    for i, (rows, tags) in enumerate(windows):
        real[i, : len(rows)] = True
        gold[i, : len(tags)] = tags
        for j, row in enumerate(rows):
            at += [i * width + j] * len(row)
            feature += row
    at, feature = np.array(at), np.array(feature)
    bias = 3 * N_SHAPE  # file bits carry the bias; every window has at least its own shapes
    emit, free = np.zeros((N_FEATURES, 3)), np.ones((3, 3), dtype=bool)
    free[OUTSIDE, INSIDE] = False
    emit[:bias, 1:] = -0.1
    moment, square = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    seen = np.stack([np.bincount(feature, gold.ravel()[at] == t, N_FEATURES) for t in range(3)], axis=1)
    pairs = real[:, 1:] & real[:, :-1]
    seen_move = np.zeros((3, 3))
    np.add.at(seen_move, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    for step in range(1, rounds + 1):
        score = np.stack([np.bincount(at, emit[feature, t], n * width) for t in range(3)], axis=1).reshape(n, width, 3)
        score *= real[:, :, None]
        forward = np.empty((n, width, 3))
        forward[:, 0] = score[:, 0] + np.array([0.0, 0.0, -1e9])
        for j in range(1, width):
            nxt = np.logaddexp.reduce(forward[:, j - 1, :, None] + move, axis=1) + score[:, j]
            forward[:, j] = np.where(real[:, j, None], nxt, forward[:, j - 1])
        backward = np.zeros((n, width, 3))
        for j in range(width - 2, -1, -1):
            nxt = np.logaddexp.reduce(move + (score[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2)
            backward[:, j] = np.where(real[:, j + 1, None], nxt, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        # The last real position carries the total forward, so marginals are right where tokens are.
        share = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
        flat = share.reshape(-1, 3)
        expect = np.stack([np.bincount(feature, flat[at, t], N_FEATURES) for t in range(3)], axis=1)
        expect_move = np.zeros((3, 3))
        for j in range(width - 1):
            on = real[:, j + 1]
            joint = forward[on, j][:, :, None] + move + (score[on, j + 1] + backward[on, j + 1])[:, None, :] - total[on][:, None, None]
            expect_move += np.exp(joint).sum(axis=0)
        for k, (weight, gradient) in enumerate(((emit, (seen - expect) / n - l2 * emit), (move, (seen_move - expect_move) / n * free))):
            moment[k] = 0.9 * moment[k] + 0.1 * gradient
            square[k] = 0.99 * square[k] + 0.01 * gradient**2
            weight += rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
        move[OUTSIDE, INSIDE] = -1e3
    return Field(emit, np.maximum(move, -1e3))


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_texts: int = LEARN_TEXTS) -> Field:
    """Learn a field from at most ``learn_texts`` texts with a base span and as many without.

    First about ``DRAWN`` times as many rows are drawn by a hash, whatever the size of
    the table; only their texts are searched for the patterns, and of these the texts
    whose hashes are smallest are taken. The windows of a text number nine at most and
    one more for each kind of planted secrets, so what reaches the driver is bounded.
    """
    rows = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(
        F.length("text") > 0
    )
    sign = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    order = [F.xxhash64("id", F.lit("secrets")), F.xxhash64("text")]
    share = min(1.0, DRAWN * learn_texts / max(1, documents.count()))
    rows = rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = [
        rows.where(part).select("text", *[o.alias(f"_o{k}") for k, o in enumerate(order)])
        .orderBy("_o0", "_o1", "text").limit(learn_texts).select("text")
        for part in (sign, ~sign)
    ]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [w for t in texts_of(batch, "text") for w in windows_of(t) + planted_windows(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[list(r) for r in rows] for rows, _ in own], type=pa.list_(pa.list_(pa.int32()))), pa.array([t for _, t in own], type=pa.list_(pa.int32()))],
                names=["rows", "tags"],
            )

    found = drawn[0].unionByName(drawn[1]).mapInArrow(cut, "rows array<array<int>>, tags array<int>").collect()
    return train(sorted(([tuple(r) for r in x["rows"]], list(x["tags"])) for x in found))


def scan(documents: DataFrame, field: Field, text_col: str = "text", name: str = "_secrets") -> DataFrame:
    """``documents`` with a column ``name``: array of (kind, start, end) of every whole text.

    Offsets count code points, the end is exclusive. Base spans come as the fixed
    patterns give them (leftmost, not overlapping within a kind); the field adds
    spans of kind ``crf`` that reach beyond them, and may overlap them. Sorted by
    start, then base kinds before added ones. Null and empty texts hold none. All rows and columns
    stay; a column called ``name`` is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field)
    order = {k: i for i, k in enumerate([*KINDS, ADDED])}

    def spans(column: Column) -> Column:
        @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
        def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tagger = Tagger(shared.value)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            for batch in batches:
                out = []
                for text in batch.to_pylist():
                    base = base_spans(text) if text else []
                    every = base + (tagger.added(text, base) if text else [])
                    every.sort(key=lambda x: (x[0], order[x[1]], x[2]))
                    out.append([{"kind": k, "start": a, "end": b} for a, k, b in every])
                yield pa.array(out, type=kind)

        return scanned(column)

    return documents.withColumn(name, spans(F.col(text_col)))


def without_spans(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """A text with its spans replaced by ``mark``; spans that overlap are replaced as one."""
    parts, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(documents: DataFrame, field: Field, text_col: str = "text", name: str = "_secrets", mark: str = "[secret]") -> DataFrame:
    """``documents`` with the spans that ``scan`` finds replaced by ``mark``, and their number in a column ``name``.

    Found and replaced in one pass over the texts. Null texts stay null.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("struct<text:string,spans:int>")
    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(shared.value)
        for batch in batches:
            texts, counts = [], []
            for text in batch.to_pylist():
                base = base_spans(text) if text else []
                every = [(a, b) for a, _, b in (base + tagger.added(text, base) if text else [])]
                texts.append(without_spans(text, every, mark) if every else text)
                counts.append(len(every))
            yield pa.StructArray.from_arrays([pa.array(texts, type=pa.string()), pa.array(counts, type=pa.int32())], names=["text", "spans"])

    found = documents.withColumn(name, cleaned(F.col(text_col)))
    return found.withColumns({text_col: F.col(f"{name}.text"), name: F.col(f"{name}.spans")})
