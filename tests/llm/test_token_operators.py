"""Tokens: BPE round trip, bit-plane files, packing."""

import collections
import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import edge
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import bitplanes, bpe, cost_packing, tokens
from millrace.llm.common import ready
from millrace.llm.tokens import PieceTokenizer
from millrace.session import scratch_path

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PARTS = [*"aбΣḉé \n\t'sdll12中😀 .!&\x1c İ\x00", "<|endoftext|>", "'s", "the", " the", "  ", " \n", "\n "]


def random_texts(count):
    draw = random.Random(5)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 50))) for _ in range(count)]


@pytest.fixture(scope="module")
def own(spark):
    return ready(spark)


def test_bpe_equals_the_library_on_random_texts():
    library, mine = Tokenizer.from_file(WORD), bpe.WordBpe(WORD)
    texts = [*random_texts(1500), "".join(random.Random(1).choice("abcdefg") for _ in range(3000))]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        got = mine.decode(pa.array([want], type=pa.list_(pa.int32())))[0].as_py()
        assert got == library.decode(want, skip_special_tokens=False)


def test_words_and_white_space_of_every_code_point():
    library, mine = Tokenizer.from_file(WORD), bpe.WordBpe(WORD)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b1 " for c in points[k : k + 400]) for k in range(0, len(points), 400)]
    # One text per slice for the near ones; far ones take the tokenizer's own pattern anyway.
    for text in [*texts[:3], *texts[::40]]:
        assert mine.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_and_their_punctuation_are_told_apart_in_joined_texts(path):
    library, mine = Tokenizer.from_file(path), PieceTokenizer(path)
    draw = random.Random(5)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    ends = ["", "", ".", ",", "!!", ",***", ".$$$", "'s", "'re.", "\u0307.", ";\u0301", "<|endoftext|>", "…", "9.", "-b."]
    texts = ["", " ", "\n", "a", " İ. İstanbul, ẞ. Ⱥ! ǅ; "]
    for size in (3, 300, 5000):
        texts.append("".join(draw.choice(" \n ") + "".join(draw.choices(letters, k=draw.randint(1, 9))) + draw.choice(ends) for _ in range(size)))
    for given in ([texts[-1]], texts, texts[::-1]):
        for text, ids in zip(given, mine.encode(given), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_whole_texts(path):
    mine = PieceTokenizer(path)
    texts = random_texts(2000)
    for k in range(0, len(texts), 50):
        part = texts[k : k + 50]
        for ids, want in zip(mine.encode(part), mine.own.encode_batch(part, add_special_tokens=False), strict=True):
            assert ids.tolist() == want.ids


def test_bpe_over_edge_rows(own):
    library = Tokenizer.from_file(WORD)
    got = bpe.decode(bpe.encode(edge.documents(own), WORD), WORD).collect()
    assert len(got) == len(edge.TEXTS)
    want = collections.Counter()
    for i, t in edge.TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r["id"], tuple(r["ids"]), r["decoded"]) for r in got) == want


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_are_an_exact_round_trip(kind):
    draw = np.random.default_rng(1)
    for ids in (draw.integers(0, 2**32, 1000, dtype=np.uint32), np.arange(9, dtype=np.uint32), np.zeros(70_000, np.uint32)):
        assert (bitplanes.ids_of(bitplanes.planes_of(ids, kind), len(ids), kind) == ids).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_files_hold_documents_in_order(own, kind, monkeypatch):
    root = scratch_path(own, "planes-test")
    manifest = bitplanes.write_shards(edge.documents(own), root, BYTE, end_id=2, kind=kind)
    got = bitplanes.read_shards(manifest, root, kind=kind).orderBy("start").collect()
    library, start = Tokenizer.from_file(BYTE), 0
    order = sorted(edge.TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert [r["id"] for r in got] == [i for i, _ in order]
    for row, (_, text) in zip(got, order, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (row["start"], row["n_tokens"], bytes(row["ids_le"])) == (start, len(ids), ids.tobytes())
        start += len(ids)


def test_pack_covers_everything_and_balances():
    draw = random.Random(3)
    lengths = [draw.choice([1, 5, 300, 900, 2047, 2048, 2049, 7000]) for _ in range(400)]
    pieces = cost_packing.pack(lengths, 2048, 1 / 4096)
    covered, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for document, start, length, sequence, offset in pieces:
        covered[document].append((start, length))
        sequences[sequence].append((offset, length))
    for document, total in enumerate(lengths):
        at = 0
        for start, length in sorted(covered[document]):
            assert start == at
            at += length
        assert at == total
    assert sum(2048 - sum(n for _, n in x) for x in sequences.values()) < 2048
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    costs = [sum(cost_packing.cost_of(n, 1 / 4096) for _, n in x) for x in sequences.values() if len(x) > 1]
    assert max(costs) <= 2048 + 2048**2 / 4096


def test_packing_over_edge_rows_and_an_empty_table(own):
    got = cost_packing.pack_documents(edge.documents(own), WORD, window_tokens=5000)
    library = Tokenizer.from_file(WORD)
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in edge.TEXTS)
    assert got.agg(F.sum("length")).first()[0] == total
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    none = edge.documents(own, [])
    assert cost_packing.pack_documents(none, WORD).isEmpty()
    assert bpe.decode(bpe.encode(none, WORD), WORD).isEmpty()
    root = scratch_path(own, "planes-empty")
    assert bitplanes.read_shards(bitplanes.write_shards(none, root, BYTE), root).isEmpty()


def test_queries_against_the_library(own):
    from millrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = own.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").collect()
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    first = {r["doc_id"]: r for r in QUERIES["op1_bpe_round_trip"](own, sf).collect()}
    planes = {r["doc_id"]: r for r in QUERIES["op3_bit_planes"](own, sf).collect()}
    pieces = collections.defaultdict(list)
    for r in QUERIES["op5_cost_packing"](own, sf).collect():
        pieces[r["doc_id"]].append(r)
    start = 0
    for row in rows:
        ids = word.encode(row["text"], add_special_tokens=False).ids
        got = first[row["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == (
            len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False)),
        )
        ended = np.array([*byte.encode(row["text"], add_special_tokens=False).ids, 2], dtype="<u4")
        got = planes[row["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ended), zlib.crc32(ended.tobytes()))
        start += len(ended)
        own_ids, at = np.array([*ids, 1], dtype="<u4"), 0
        for piece in sorted(pieces[row["doc_id"]], key=lambda r: r["start"]):
            assert piece["start"] == at and piece["doc_tokens"] == len(own_ids)
            assert piece["ids_crc32"] == zlib.crc32(own_ids[at : at + piece["length"]].tobytes())
            at += piece["length"]
        assert at == len(own_ids)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_plain_words_need_no_pattern(path, monkeypatch):
    asked, fits = [], tokens.WORD
    monkeypatch.setattr(tokens, "WORD", lambda piece: asked.append(piece) or fits(piece))
    text = "One two, three. Four!? Straße naïve... x1 (five) six;seven -- eight. ."
    (got,) = PieceTokenizer(path).encode([text])
    assert list(got) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert not [piece for piece in asked if piece.isascii()] and len(asked) > 0
    for piece in ("", " ", "  a", " a", "a ", "a.", "a1", " é", "İ", "ab\n", "Ⅷ", "ª"):
        assert tokens.is_word(piece) == bool(fits(piece))
