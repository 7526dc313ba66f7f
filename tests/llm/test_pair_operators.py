"""Fingerprints, near-duplicates, embeddings and the pipeline, against brute force."""

import collections
import hashlib
import itertools
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import edge

from millrace.llm import lsh_forest, metric_join, order_minhash
from millrace.llm.common import classes_of, ready
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def own(spark):
    return ready(spark)


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_classes_of_random_and_long_chains(own):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)]
    order = list(range(1000, 1100))
    draw.shuffle(order)
    links += list(zip(order, order[1:], strict=False)) + [(5000, k) for k in range(5001, 5100)]
    got = {r["node"]: r["component"] for r in classes_of(own.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = groups({n for p in links for n in p}, links)
    assert all(got.get(n, n) == c for n, c in want.items())


# --- fingerprints ----------------------------------------------------------------


def test_next_text_and_fingerprints_over_edge_rows(own):
    for shuffle in ("1", "4"):
        own.conf.set("spark.sql.shuffle.partitions", shuffle)
        rows = order_minhash.compare(edge.documents(own)).collect()
        own.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(rows) == len(edge.TEXTS)
        with_id = sorted((x for x in edge.TEXTS if x[0] is not None), key=lambda x: -x[0])
        by_id = collections.defaultdict(list)
        for r in rows:
            by_id[r["id"]].append(r)
        for (i, text), (_, after) in zip(with_id, with_id[1:], strict=False):
            text, after = text or "", after or ""
            third = len(text) // 3
            want = hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
            assert want in {r["edited_sha256"] for r in by_id[i]}
            assert by_id[i][0]["n_chars"] == len(text)
        same = {tuple(r["tuples"]) for r in rows if r["id"] in (1, 2)}
        assert len(same) == 1
        assert {tuple(r["tuples"]) for r in rows if r["id"] in (3, 4, 5)} == {(0,) * order_minhash.SLOTS}
    assert order_minhash.compare(edge.documents(own, [])).isEmpty()
    alone = order_minhash.compare(edge.documents(own, [(5, edge.SAME)])).collect()
    assert alone[0]["near_next"] == 1


def test_likeness_falls_with_edits_and_knows_order(own):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(600)]
    few, many = words[:], words[:]
    few[100], many[:300] = "other", ["".join(draw.choice("ijkl") for _ in range(6)) for _ in range(300)]
    turned = words[300:] + words[:300]
    texts = [(k, " ".join(w)) for k, w in enumerate([words, few, turned, many])]
    frame = own.createDataFrame(texts, "doc bigint, text string").repartition(1)
    found = collections.defaultdict(dict)
    for r in order_minhash.tuples_of(frame, ["doc"], slots=128).collect():
        found[r["doc"]][r["slot"]] = r["tuple"]
    like = [sum(found[0].get(s) == found[k].get(s) for s in range(128)) / 128 for k in range(4)]
    # The same k-mers in another order agree less: half of the pairs change their order.
    assert like[0] == 1 and like[1] > 0.9 and 0.3 < like[2] < 0.75 and like[3] < 0.35


def test_fingerprint_query(own):
    rows = own.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).orderBy(F.desc("doc_id")).collect()
    got = {r["doc_id"]: r for r in QUERIES["op2_order_minhash"](own, SF).collect()}
    by_text = collections.defaultdict(set)
    for (i, text), (j, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        third = len(text) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(text)
        by_text[text].add(got[i]["fingerprint"])
        parts = [[got[k][c][x : x + 8] for x in range(0, 8 * order_minhash.SLOTS, 8)] for k, c in ((i, "fingerprint"), (i, "edited_fingerprint"), (j, "fingerprint"))]
        for name, other in (("near_edited", parts[1]), ("near_next", parts[2])):
            assert abs(got[i][name] - sum(a == b for a, b in zip(parts[0], other, strict=True)) / order_minhash.SLOTS) < 1e-9
    assert all(len(x) == 1 for x in by_text.values())
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.9 * len(got)


# --- near-duplicates -------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    where = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    links = set()
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                links.add((i, j))
    return {i: (len(sets[i]), c, c == i) for i, c in groups(sets, links).items()}


def planted():
    """A dense group whose members are alike to different degrees, and others around it."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = []
    for k in range(400):
        words = base[:]
        for _ in range(draw.choice([0, 1, 2, 4, 6, 8])):
            words[draw.randrange(len(words))] = word()
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join([*base[:60], *[word() for _ in range(200)]])) for k in range(50)]
    rows += [(2000 + k, rows[k][1].upper()) for k in range(20)]
    return rows


def test_near_duplicates_of_a_dense_group(own):
    rows = planted()
    got = lsh_forest.near_duplicates(own.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute(rows)


def test_near_duplicates_with_small_regions(own, monkeypatch):
    """Regions split at greater depth find the same groups."""
    monkeypatch.setattr(lsh_forest, "COMPARED", 1 << 15)
    rows = planted()
    got = lsh_forest.near_duplicates(own.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute(rows)


def hangers_on():
    """A dense group, and copies of its members that are alike enough to one member only."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = []
    for k in range(300):
        words = base[:]
        words[5 + draw.randrange(140)] = word()
        rows.append((k, words))
    for k in range(80):
        words = rows[k][1][:]
        for at in draw.sample(range(10, 140, 6), 4):
            words[at] = word()
        rows.append((1000 + k, words))
    return [(k, " ".join(words)) for k, words in rows]


def test_near_duplicates_of_regions_beyond_what_a_task_holds(own, monkeypatch):
    """A region is searched as a whole, however few of its rows are held at once."""
    rows = hangers_on()
    monkeypatch.setattr(lsh_forest, "GATHERED", 20)
    batch = own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = lsh_forest.near_duplicates(own.createDataFrame(rows, "doc_id bigint, text string")).collect()
    finally:
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(rows)


@pytest.mark.parametrize("first_search", [True, False])
def test_near_duplicates_in_a_crowd_with_a_shared_passage(own, monkeypatch, first_search):
    """All are alike by about 0.59, some pairs by 0.76: found also where no neighbour gave a hint."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    passage, rows = [word() for _ in range(90)], []
    for k in range(240):
        tail = [word() for _ in range(30)]
        rows.append((k, " ".join([*passage, *tail])))
        if k < 40:
            rows.append((1000 + k, " ".join([*passage, *tail[:16], *[word() for _ in range(14)]])))
    if not first_search:
        monkeypatch.setattr(lsh_forest, "neighbours", lambda entries: entries.sparkSession.createDataFrame([], "a bigint, b bigint"))
    got = lsh_forest.near_duplicates(own.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute(rows)
    assert sum(not kept for _, _, kept in want.values()) == 40
    assert {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == want


def test_near_duplicates_over_edge_rows(own):
    rows = lsh_forest.near_duplicates(edge.documents(own)).collect()
    assert len(rows) == len(edge.TEXTS)
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r["id"]].append((r["component_id"], r["kept"]))
    assert by_id[1] == [(1, True)] * 2 and by_id[2] == [(1, False)]
    assert by_id[3] == [(3, True)] and by_id[4] == [(4, True)] and by_id[5] == [(5, True)]
    assert by_id[None] == [(None, True)] * 2
    assert lsh_forest.near_duplicates(edge.documents(own, [])).isEmpty()
    twice = [(1, edge.SAME), (1, "quite another text of more than five words"), (2, "Quite another text of more than five words")]
    got = {(r["id"], r["component_id"]) for r in lsh_forest.near_duplicates(own.createDataFrame(twice, "doc_id bigint, text string")).collect()}
    assert got == {(1, 1), (2, 1)}


def test_near_duplicate_query(own):
    rows = [(r["doc_id"], r["text"]) for r in own.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op4_lsh_forest"](own, SF).collect()}
    assert got == brute(rows)


# --- embeddings ------------------------------------------------------------------


def links_of(rows, least=0.95):
    usable = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)}
    unit = {k: v / np.abs(v).max() for k, v in usable.items()}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    return [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]


@pytest.mark.parametrize("sizes", [(8192, 4096), (20, 16)])
def test_vectors_against_all_pairs(own, sizes):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    vectors = [(centres[k % 12] + 0.13 * draw.normal(size=16)).tolist() for k in range(240)] + [draw.normal(size=16).tolist() for _ in range(60)]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[1]]]
    rows = list(enumerate(vectors)) + [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e300, 2e300]), (909, [1e-300, 2e-300])]
    frame = own.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<double>, id string, cell string")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in metric_join.near(frame, per_pivot=sizes[0], chunk=sizes[1]).collect()}
    links = links_of(rows)
    ids = [r[0] for r in rows]
    count = collections.Counter(x for p in links for x in p)
    part = groups(ids, [(ids[a], ids[b]) for a, b in links])
    assert got == {i: (count[k], part[i], part[i] == i) for k, i in enumerate(ids)}


def test_vectors_without_ids_repeated_and_none(own):
    kind = "vec_id bigint, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None), (2, [0.0, 1.0])]
    got = sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in metric_join.near(own.createDataFrame(rows, kind)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (None, 0, None, True), (2, 0, 2, True)], key=str)
    assert metric_join.near(own.createDataFrame([], kind)).isEmpty()


def test_vector_query(own):
    rows = [(r["vec_id"], r["embedding"]) for r in own.read.parquet(f"{SF}/embeddings.parquet").collect()]
    links = links_of(rows)
    got = QUERIES["op10_metric_join"](own, SF).collect()
    assert len(got) == len(rows) and sum(r["n_links"] for r in got) == 2 * len(links)


# --- pipeline --------------------------------------------------------------------


def test_stages_over_edge_rows(own):
    docs = edge.documents(own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(own, docs, SF)
        assert got.columns == docs.columns, name
        assert stage(own, docs.limit(0), SF).isEmpty(), name
    kept = [r[0] for r in corpus_pipeline.near_duplicates(own, docs, SF).select("doc_id").collect()]
    assert sorted(kept, key=str) == sorted([1, 3, 4, 5, 6, 7, 8, 9, 10, None, None], key=str)
    assert corpus_pipeline.packing(own, docs.limit(0), SF).isEmpty()


def test_quality_stage_decides_like_its_operator(own, monkeypatch):
    docs = edge.documents(own)
    for score, kept in ((0.6, 0), (0.7, len(edge.TEXTS))):
        monkeypatch.setattr(corpus_pipeline.quality, "grade", lambda docs, model, name, score=score: docs.withColumn(name, F.lit(score)))
        assert corpus_pipeline.good_quality(own, docs, SF).count() == kept


def test_language_stage_without_a_known_language(own):
    """Where no document names its language, those with letters stay."""
    docs = edge.documents(own).withColumn("lang", F.lit(None).cast("string"))
    kept = [r["text"] for r in corpus_pipeline.language(own, docs, SF).select("text").collect()]
    assert sorted(kept) == sorted(t for _, t in edge.TEXTS if t and any(map(str.isalpha, t)))


def test_pipeline_against_its_stages(own):
    documents = {r["doc_id"]: r for r in own.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = own.read.parquet(f"{SF}/documents.parquet")
    quality_labels = {r["doc_id"]: r["quality"] for r in own.read.parquet(f"{SF}/labels.parquet").collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = own.createDataFrame(stage(own, docs, SF).collect(), docs.schema)
        after[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(after["language"]) == {i for i, r in documents.items() if r["text"] and any(map(str.isalpha, r["text"]))}
    judged = [i for i in after["language"] if i in quality_labels]
    assert sum((i in after["quality"]) == bool(quality_labels[i]) for i in judged) >= 0.98 * len(judged)
    want = brute([(i, r["text"]) for i, r in after["quality"].items()])
    assert set(after["near_duplicates"]) == {i for i, (_, _, kept) in want.items() if kept}
    for i, r in after["secrets"].items():
        assert "token = \"" not in r["text"] and r["n_chars"] == len(r["text"])
    total = sum(r["length"] for r in corpus_pipeline.run(own, SF).collect())
    assert total == sum(r["length"] for r in corpus_pipeline.packing(own, docs, SF).collect())
