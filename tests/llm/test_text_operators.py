"""Chat formatting, language, quality and secrets."""

import collections
import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import edge

from millrace.llm import chat, langid, quality, secret_crf
from millrace.llm.common import ready
from millrace.llm.queries import CONFLICT, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def own(spark):
    return ready(spark)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat ------------------------------------------------------------------------


def test_any_turn_parses_back():
    draw = random.Random(2)
    roles = ["\\", "###", ":", "\n", " ", "a", "</turn>"]
    texts = [*roles, "#", "</turn", ": ", "### User: ", "x", ">"]
    for _ in range(5000):
        role = "".join(draw.choice(roles) for _ in range(draw.randint(0, 4)))
        text = "".join(draw.choice(texts) for _ in range(draw.randint(0, 7)))
        one, two = chat.render(role, text), chat.render(text, role)
        turns = chat.parse(one[0] + two[0])
        assert [t[:2] for t in turns] == [(role, text), (text, role)]
        assert turns[0][2:] == one[1:]


def test_chat_over_edge_rows(own):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", CONFLICT), (3, 0, "assistant", edge.LONG), (3, 1, "assistant", "")]
    turns = own.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, rendered string, conversation string")
    got = {r["conversation"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 1, 3: 2, None: 1}
    assert got[None]["loss_sha256"] == sha(CONFLICT) and got[3]["loss_chars"] == len(edge.LONG)
    assert chat.read_back(chat.format_turns(turns.limit(0))).isEmpty()


def test_chat_query(own):
    rows = own.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    rows = [(r["conv_id"], r["role"] or "", r["text"] or "") for r in rows] + [(-7, "user", CONFLICT), (-7, "assistant", CONFLICT)]
    want = collections.defaultdict(list)
    for conversation, role, text in rows:
        want[conversation].append((role, text))
    got = {r["conv_id"]: r for r in QUERIES["op6_chat_round_trip"](own, SF).collect()}
    assert set(got) == set(want)
    for conversation, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conversation]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss))


# --- language --------------------------------------------------------------------


def test_gram_counts_do_not_depend_on_steps(monkeypatch):
    text = "".join(random.Random(4).choice("abc déf\n") for _ in range(5000))
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "STEP", 77)
    assert (langid.gram_counts(text) == whole).all()
    n = len(" ".join(text.split())) + 2
    assert whole.sum() == n + (n - 1) + (n - 2)


def test_language_query_on_held_out_texts(own):
    truth = {r["doc_id"]: r["lang"] for r in own.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_language_id"](own, SF).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_language_over_edge_rows_and_empty_tables(own):
    documents = edge.documents(own)
    model = langid.fit(documents, F.lit(True))
    got = langid.identify(documents, model).select("text", "_language.*").collect()
    assert len(got) == len(edge.TEXTS)
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    none = langid.fit(documents.limit(0), F.lit(True))
    assert {r[0] for r in langid.identify(documents, none).select("_language.lang_pred").collect()} == {"und"}
    assert langid.identify(documents.limit(0), model).isEmpty()


# --- quality ---------------------------------------------------------------------


def test_trees_learn_a_rule_and_walk_alike():
    draw = np.random.default_rng(0)
    rows = draw.normal(size=(3000, 6))
    labels = ((rows[:, 0] > 0.2) ^ (rows[:, 3] > -0.1)).astype(float)
    trees = quality.grow(rows[:2000], labels[:2000], trees=40)
    scores = trees.score(rows[2000:])
    assert ((scores > 0.5) == (labels[2000:] > 0.5)).mean() > 0.95
    # The flattened walk against one row and one tree at a time.
    for row, score in zip(rows[2000:2020], scores, strict=False):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-9


def test_quality_query_on_held_out_texts(own):
    labels = {r["doc_id"]: r["quality"] for r in own.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op8_quality_trees"](own, SF).collect()
    assert len(rows) == own.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_quality_over_edge_rows_and_empty_tables(own):
    documents = edge.documents(own)
    labels = own.createDataFrame([(1, 1), (1, None), (4, 0), (None, 1), (99, 1)], "doc_id bigint, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.grade(documents, quality.fit(documents, known, F.lit(True))).select("_quality").collect()
        assert len(got) == len(edge.TEXTS) and all(0 <= r[0] <= 1 for r in got)
    assert quality.grade(documents.limit(0), quality.fit(documents, labels, F.lit(True))).isEmpty()


# --- secrets ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    key = random.Random(7)
    texts = []
    for i in range(200):
        secret = "".join(key.choice("0123456789abcdef") for _ in range(40))
        words = " ".join(key.choice(["alpha", "beta", "gamma", "12", "delta,"]) for _ in range(40))
        texts.append(f'{words} token = "{secret}" {words}' if i % 2 else words)
    return secret_crf.train([w for t in texts for w in secret_crf.windows_of(t)])


def test_base_spans():
    text = 'API_KEY: "abcdef" Password=short1x secret=12345 AKIA' + "A" * 16 + " ſecret=abcdefgh " + "0a" * 12 + " " + "f" * 23
    got = [(k, text[a:b]) for a, k, b in secret_crf.base_spans(text)]
    assert got == [("assign", 'API_KEY: "abcdef'), ("assign", "Password=short1x"), ("access", "AKIA" + "A" * 16), ("hex", "0a" * 12)]


def test_stretches_give_the_path_of_the_whole_text(field):
    tagger, draw = secret_crf.Tagger(field), random.Random(9)
    parts = ["alpha", "token", "=", '"9F8E7D6C5B4A39281706F5E4D3C2B1A0FFEEDDCC"', "x=1", "12", "key:", "0123456789abcdef0123", "Beta,"]
    for _ in range(300):
        tokens = [draw.choice(parts) for _ in range(draw.randint(1, 60))]
        text = " ".join(tokens)
        path = secret_crf.viterbi(tagger.emissions(tokens, text), field.move, False, False)
        assert tagger.tags(tokens, text) == {k: t for k, t in enumerate(path) if t}


def test_the_field_adds_what_the_patterns_miss(field):
    tagger = secret_crf.Tagger(field)
    text = 'alpha beta auth = "9F8E7D6C5B4A39281706F5E4D3C2B1A0FFEEDDCC" gamma delta, alpha'
    assert secret_crf.base_spans(text) == []
    assert [text[a:b] for a, _, b in tagger.added(text, [])] == ["9F8E7D6C5B4A39281706F5E4D3C2B1A0FFEEDDCC"]
    plain = "alpha beta gamma 12 delta, alpha beta"
    assert tagger.added(plain, []) == []


def test_a_learned_field_finds_secrets_of_several_tokens(own):
    draw = random.Random(11)
    words = lambda n: " ".join(draw.choice(["alpha", "beta", "gamma", "12", "delta,", "key", "Token."]) for _ in range(n))
    secret = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40))
    texts = [(k, f'{words(40)} token = "{secret()}" {words(40)}' if k % 2 else words(80)) for k in range(300)]
    learned = secret_crf.fit(own.createDataFrame(texts, "doc_id bigint, text string"))
    tagger = secret_crf.Tagger(learned)
    lines = ["".join(draw.choices(secret_crf._BASE64, k=64)) for _ in range(3)]
    for hidden in ("9F8E7D 1B4A39 28F706 E5D3C2", "q7Rt 9xLm 2Vb8 Zk4P", "\n".join(lines)):
        lead = "-----BEGIN RSA PRIVATE KEY-----\n{}\n-----END RSA PRIVATE KEY-----" if "\n" in hidden else "auth = {}"
        text = f"{words(30)} {lead.format(hidden)} {words(30)}"
        assert hidden in [text[a:b] for a, _, b in tagger.added(text, secret_crf.base_spans(text))]
    for plain in (words(200), f"{words(30)} {'Der ' * 30}{'Ating. ' * 30}{words(30)}"):
        assert tagger.added(plain, []) == []


def test_what_a_pattern_leaves_of_a_secret_is_added(field, monkeypatch):
    text = "password = hunter2!Xk9#Qw and token = abcdef12"
    base = secret_crf.base_spans(text)
    assert [text[a:b] for a, _, b in base] == ["password = hunter2", "token = abcdef12"]
    tagger = secret_crf.Tagger(field)
    monkeypatch.setattr(tagger, "tags", lambda tokens, text: {2: secret_crf.BEGIN, 6: secret_crf.BEGIN})
    added = tagger.added(text, base)
    assert [text[a:b] for a, _, b in added] == ["hunter2!Xk9#Qw"]
    assert secret_crf.without_spans(text, [(a, b) for a, _, b in base + added], "*") == "* and *"


def test_scan_and_redact_over_edge_rows(own, field):
    secret = "token = " + "ab12" * 10
    documents = edge.documents(own, [*edge.TEXTS, (50, secret), (50, secret), (51, "é" * 1000 + secret)])
    scanned = secret_crf.scan(documents, field)
    rows = {r["doc_id"]: r["_secrets"] for r in scanned.select("doc_id", "_secrets").collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in rows[51]] == [("assign", 1000, 1048), ("hex", 1008, 1048)]
    assert rows[3] == [] and rows[4] == []
    clean = {r["doc_id"]: r["text"] for r in secret_crf.redact(documents, field).select("doc_id", "text").collect()}
    assert clean[50] == "[secret]" and clean[51] == "é" * 1000 + "[secret]" and clean[2] == edge.SAME and clean[3] is None
    assert secret_crf.scan(documents.limit(0), field).isEmpty()
    empty = secret_crf.fit(documents.limit(0))
    assert not secret_crf.Tagger(empty).added(secret, secret_crf.base_spans(secret))


def test_secret_query(own):
    texts = {r["doc_id"]: r["text"] or "" for r in own.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op9_secret_crf"](own, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = [f"{k}:{a}:{b}" for a, k, b in secret_crf.base_spans(texts[r["doc_id"]])]
        assert r["base_sha256"] == sha(",".join(base))
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("crf:")] == base
        assert [r[f"n_{k}"] for k in secret_crf.KINDS] == [sum(s.startswith(k) for s in base) for k in secret_crf.KINDS]
