"""Ids of whole texts from the tokenizers library, with repeated pieces looked up.

A text is cut where no token can reach across, each distinct piece goes to the
library once per worker, and its ids are put together again. Most pieces of a
corpus repeat, so that this is several times as fast as handing over whole texts.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Pieces in each of the two generations that a Python worker keeps; longer ones are not kept.
KEPT, KEPT_LENGTH = 300_000, 48
#: Pieces that go to the library as one text.
JOINED = 1000
#: Letters of the Latin blocks up to U+024F; U+0130 is no longer one letter in lower case.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
WORD = re.compile(f" ?[{LETTERS}]+").fullmatch
#: Punctuation after a word; the two are never one token and never change each other.
ENDS = ".,!?;:$%&*#"


def is_word(piece: str) -> bool:
    """Whether ``WORD`` fits a piece; most are ASCII, which is told without a pattern."""
    if piece.isascii():
        return piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha())
    return WORD(piece) is not None


class PieceTokenizer:
    """A tokenizer file, read once, and the ids of pieces as bytes of 32-bit integers.

    Two kinds of files are known: those whose words never hold white space are
    cut at it, and byte-level ones, whose words may begin with one space, are cut
    before single spaces. Texts with white space in other places, which might
    then be cut inside a run of it, go to the library whole. Pieces that were in
    use lately survive when the older generation is let go.
    """

    def __init__(self, path: str):
        own = Tokenizer.from_file(path)
        own.no_padding()
        own.no_truncation()
        self.own = own
        self.drops_space = own.encode(" ", add_special_tokens=False).ids == []
        # Texts on both sides of a special token are tokenized apart, so many go to the library between such tokens.
        special = [(t.content, k) for k, t in own.get_added_tokens_decoder().items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark, self.mark_id = special[-1] if special else (None, None)
        self.added = [t.content for t in own.get_added_tokens_decoder().values()]
        suffix = own.model.end_of_word_suffix or ""
        vocabulary = own.get_vocab()
        #: Bytes that an id stands for, where a character of a token is a byte.
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            self.width[k] = len(token) - len(suffix) if suffix and token.endswith(suffix) else len(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str] | None:
        """The text's pieces; None if it must stay whole."""
        if self.drops_space:  # Python splits at the information separators, the tokenizer doesn't
            return None if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        if "\0" in text:
            return None
        if "\n" in text and not any(c in text for c in ("\n\n", "\n ", " \n", "\t", "\r", "\v", "\f")) and text[0] != "\n" != text[-1]:
            text = text.replace("\n", "\0\n\0")  # one line feed between words is a piece of its own
        return text.replace(" ", "\0 ").split("\0")

    def _loose(self, piece: str) -> bool:
        """Whether a byte-level piece ends or goes on with white space, so that a cut beside it was wrong."""
        return piece != "\n" and (piece[-1:].isspace() or (piece[:1] == " " and piece[1:2].isspace()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [self.cut(t) for t in texts]
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young
        new = set().union(*(c for c in cuts if c)).difference(self.young)
        if not self.drops_space and (loose := {p for p in new if not p[-1:].isalnum() and self._loose(p) or p[1:2].isspace()}):
            cuts = [c if c is None or loose.isdisjoint(c) else None for c in cuts]
            new -= loose
        passing = self._learn(new)
        whole = [k for k, c in enumerate(cuts) if c is None]
        found = dict(zip(whole, self._bytes([texts[k] for k in whole]), strict=True))
        get = self.young.__getitem__
        ids = [
            np.frombuffer(found[k] if c is None else b"".join(map(get, c)), dtype="<u4")
            for k, c in enumerate(cuts)
        ]
        for piece in passing:
            del self.young[piece]
        return ids

    def _learn(self, pieces: set[str]) -> list[str]:
        """Takes ids of pieces over from the older generation or asks for them; gives the pieces too long to be kept."""
        young, old = self.young, self.old
        if old:
            again = pieces & old.keys()
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            pieces = pieces - again
        parts, ended, words = [], [], []
        for piece in pieces:
            word = piece.rstrip(ENDS)
            if len(word) < len(piece) and is_word(word):
                ended.append(piece)
                words.append(word)
            else:
                parts.append(piece)
        tails = [piece[len(word) :] for piece, word in zip(ended, words, strict=True)]
        apart = {*words, *tails} - young.keys()
        if old:
            again = apart & old.keys()
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            apart -= again
        parts = list(apart.union(parts))
        young.update(self._bytes_joined(parts))
        young.update(zip(ended, map(bytes.__add__, map(young.__getitem__, words), map(young.__getitem__, tails)), strict=True))
        return [p for p in {*pieces, *parts} if len(p) > KEPT_LENGTH]

    def _bytes_joined(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of short texts, many of them handed over as one."""
        known = self._bytes_of_words(list(filter(is_word, pieces)))
        rest = [p for p in pieces if p not in known]
        known.update(zip(rest, self._bytes_between_marks(rest), strict=True))
        return known

    def _bytes_of_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that stand in one text as in any other; they are told apart by the bytes that ids stand for.

        A word without its space follows a line feed in a byte-level text, whose id
        is then left out. Words of a text whose ids don't end where its words do
        are not among the result.
        """
        known: dict[str, bytes] = {}
        if self.drops_space:
            shown, skip, gap = words, [0] * len(words), " "
            wide = [len(w) if w.isascii() else len(w.lower().encode()) for w in words]
        else:
            skip = [0 if w[0] == " " else 1 for w in words]
            shown, gap = ["\n" + w if s else w for w, s in zip(words, skip, strict=True)], ""
            wide = [len(w) if w.isascii() else len(w.encode()) for w in shown]
        texts = [gap.join(shown[k : k + JOINED]) for k in range(0, len(words), JOINED)]
        for k, encoding in enumerate(self.own.encode_batch_fast(texts, add_special_tokens=False)):
            part = slice(k * JOINED, (k + 1) * JOINED)
            ids = np.array(encoding.ids, dtype="<u4")
            ends, wanted = np.cumsum(self.width[ids]), np.cumsum(wide[part])
            if not len(ids) or ends[-1] != wanted[-1]:
                continue
            last = np.searchsorted(ends, wanted)
            if (ends[last] != wanted).any():
                continue
            data, at = ids.tobytes(), 0
            for word, s, end in zip(words[part], skip[part], ((last + 1) * 4).tolist(), strict=True):
                known[word] = data[at + 4 * s : end]
                at = end
        return known

    def _bytes_between_marks(self, pieces: list[str]) -> list[bytes]:
        """Ids of short texts, many of them handed over as one with a special token between them."""
        if self.mark is None or "" in pieces or any(a in p for a in self.added for p in pieces if "<" in p or a[0] != "<"):
            return self._bytes(pieces)
        found: list[bytes] = []
        texts = [self.mark.join(pieces[k : k + JOINED]) for k in range(0, len(pieces), JOINED)]
        for encoding in self.own.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(encoding.ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)) * 4
            data, at = ids.tobytes(), 0
            for end in ends.tolist():
                found.append(data[at:end])
                at = end + 4
        return found

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer and its pieces per Python worker and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return PieceTokenizer(path)
