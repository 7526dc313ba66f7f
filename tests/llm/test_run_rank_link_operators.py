"""Periodic runs, ranked search and link trust against step-by-step restatements."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import edge
import numpy as np
import pytest

from millrace.llm import link_trust, periodic_runs, queries, term_pipeline
from millrace.llm.common import ready

WHITE = b" \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def plain_runs(own):
    """Runs by comparing each word with the word a period on, smallest period first."""
    found = {}
    for q in range(1, len(own) // 3 + 1):
        i = 0
        while i + q < len(own):
            if own[i] != own[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(own) and own[j] == own[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(key, own):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(own)
    if key is None or h % 10 or not n:
        return own
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [own[a + (i - a) % p] if i >= a else own[i] for i in range(n)]


def plain_row(key, own):
    runs = plain_runs(own)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(own) if i not in drop)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    one = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (key, len(runs), *one, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_random_texts():
    rng = random.Random(5)
    texts = []
    for _ in range(250):
        few = rng.choice([1, 2, 2, 3, 30])
        own = [rng.randrange(few) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            at, period = rng.randrange(len(own) + 1), [rng.randrange(few) for _ in range(rng.randrange(1, 25))]
            own[at:at] = (period * rng.randrange(1, 12))[: rng.randrange(120)]
        texts.append(np.array(own, np.int64))
    for together in (1, 40, len(texts)):
        for k in range(0, len(texts), together):
            some = texts[k : k + together]
            for runs, own in zip(periodic_runs.runs_of(some), some, strict=True):
                assert [tuple(r) for r in runs.tolist()] == plain_runs(own.tolist())


def test_grid_in_pieces(monkeypatch):
    own = np.array(([1, 2, 3] * 40 + list(range(10, 90)) + [7] * 50) * 2)
    whole = [tuple(r) for r in periodic_runs.runs_of([own])[0].tolist()]
    monkeypatch.setattr(periodic_runs, "GRID", 16)
    assert [tuple(r) for r in periodic_runs.runs_of([own])[0].tolist()] == whole == plain_runs(own.tolist())


def test_grammar_answers():
    rng = np.random.default_rng(3)
    own = np.concatenate([[100], np.tile(rng.integers(0, 3, 40), 5), np.ones(60, np.int64), rng.integers(0, 2, 200), [101]])
    grammar = periodic_runs.Grammar(own)
    x, y = rng.integers(1, len(own) - 1, (2, 3000))
    x, y = x[x != y], y[x != y]
    after, before = grammar.after(x, y), grammar.before(x, y)
    for a, b, n, m in zip(x, y, after, before, strict=True):
        want = next(k for k in range(len(own)) if max(a, b) + k >= len(own) or own[a + k] != own[b + k])
        back = next(k for k in range(len(own)) if min(a, b) - k < 0 or own[a - k] != own[b - k])
        assert (n, m) == (want, back)


def test_grammar_is_flat_for_long_blocks_and_periods():
    block = periodic_runs.Grammar(np.array([5, *[1] * 100_000, 6]))
    assert block.rounds < 8
    period = periodic_runs.Grammar(np.array([10**6, *list(range(40)) * 5000, 10**6 + 1]))
    assert period.rounds < 80 and len(period.symbol) < 200_000 * 8


def test_planted_query_against_brute_force(spark, tmp_path):
    rows = [(k, " ".join(random.Random(k).choices("a b c d e f g h".split(), k=k % 170))) for k in range(400)]
    rows += [(500, "  x\ty\n" * 40), (501, None), (502, ""), (None, "a b " * 30), (500, "again and again " * 9), (503, "é 中 " * 30)]
    edge.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = [plain_row(k, planted(k, words(t))) for k, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.n_runs > 0 for r in got) > 20


def test_runs_of_edge_rows(spark):
    ready(spark)
    got = periodic_runs.find(edge.documents(spark)).collect()
    want = [(k, len(words(t)), [(0, 48_000, 4)] if t == edge.LONG else plain_runs(words(t))) for k, t in edge.TEXTS]
    assert sorted(((r.id, r.n_words, [tuple(x) for x in r.runs]) for r in got), key=str) == sorted(want, key=str)
    long = next(r for r in got if r.id == 6)
    assert long.strongest.period == 4 and long.collapsed.endswith("end of it") and len(long.collapsed) < 60
    assert periodic_runs.find(edge.documents(spark, [])).collect() == []


def plain_terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in folded).split(" ")


def plain_search(documents, items, best):
    docs = [(line, key, Counter(t for t in plain_terms(text) if t)) for line, (key, text) in enumerate(documents)]
    total, length = sum(bool(c) for *_, c in docs), sum(c.total() for *_, c in docs)
    df = Counter(t for *_, c in docs for t in c)
    found = []
    for key, text in items:
        scores = []
        for line, doc, c in docs:
            m = 10 + 90 * c.total() * total // length if length else 0
            score = 0
            for t in {t for t in plain_terms(text) if t} & set(c):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                scores.append((-score, doc is None, doc or 0, line, doc))
        found += [(key, k + 1, s[-1], -s[0]) for k, s in enumerate(sorted(scores)[:best])]
    return sorted(found, key=str)


ITEM_SCHEMA = "item_id bigint, text string, row string, term string, id string"


@pytest.mark.parametrize(("block", "group", "joined"), [(2048, 256, True), (30, 6, True), (60, 8, False)])
def test_search_against_brute_force(spark, monkeypatch, block, group, joined):
    ready(spark)
    monkeypatch.setattr(term_pipeline, "BLOCK", block)
    monkeypatch.setattr(term_pipeline, "GROUP", group)
    if not joined:
        monkeypatch.setattr("millrace.operators.scaling.BROADCAST_ROWS", 3)
        monkeypatch.setattr(term_pipeline, "join_for", lambda per_key: term_pipeline_join(per_key))
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(k // 2 if k % 7 == 0 else k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(60)))) for k in range(150)]
    rows += edge.TEXTS[:5] + edge.TEXTS[7:] + [(900, "W1 w2;W3"), (901, "naïve Ünder\u00a0x")]
    items = [(k % 9, " ".join(rng.choices(vocabulary, k=12))) for k in range(10)]
    items += [(50, None), (51, ""), (52, "nothing here matches zzz"), (53, "w0 w0 w1"), (None, "the cat"), (54, "naïve ünder")]
    tables = spark.createDataFrame([(*r, "x", "y", "z") for r in items], ITEM_SCHEMA)
    got = term_pipeline.search(edge.documents(spark, rows), tables, best=4).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == plain_search(rows, items, 4)


def term_pipeline_join(per_key):
    from millrace.operators.scaling import spread_join

    return spread_join


def test_search_of_empty_tables(spark):
    ready(spark)
    items = spark.createDataFrame([(1, "a b", "", "", "")], ITEM_SCHEMA)
    assert term_pipeline.search(edge.documents(spark, []), items).collect() == []
    assert term_pipeline.search(edge.documents(spark, [(1, None), (2, " ")]), items).collect() == []
    assert term_pipeline.search(edge.documents(spark), items.where("false")).collect() == []


PAGES = [
    (1, "https://A.com/en/x?q#f", '<a href="http://bad.net/fr/1">x</a> <A HREF=\'//Other.org/z\'>'),
    (2, "http://bad.net/fr/1", '<a href="/rel">'), (3, "http://bad.net/en/1", None), (4, "http://other.org/a", '<a href=http://farm.org/1>'),
    (5, "http://farm.org/1", '<a href="http://bad.net/"> <a href="http://bad.net/2"> <a href="https://x.bad.net/">'),
    (6, "http://www.example.com/en/1", ""), (7, "http://example.com/en/1", ""), (8, "http://example.com/de/1", ""),
    (9, "http://shop.example.com/en/", ""), (10, "http://notexample.com/en/", ""), (11, "http://com", ""), (12, None, None),
    (13, "no address", '<a href="http://bad.net/">'), (14, "http://x.org?a://b/c", ""), (15, "http://", ""), (2, "http://bad.net/fr/1", ""),
    (None, "http://bad.net:80/es/2#es", "x"), (16, "ftp://farm.org/es/", ""), (17, "//a.com/x", ""),
]


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def plain_judge(pages, rounds=link_trust.ROUNDS):
    import re

    named, edges = [], Counter()
    for key, url, html in pages:
        host, path = plain_host_path(url)
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        named.append((key, host, path, max(fits, key=lambda r: len(r.host + r.path), default=None)))
        for quoted in re.findall(r"href=[\"']?([^\"'> ]*)", html or "", re.I):
            to = re.match(r"(?:[a-z]+:)?//([^/?#]+)", quoted)
            if to and host and to[1].lower() != host:
                edges[host, to[1].lower()] += 1
    hosts = {h for _, h, *_ in named if h} | {b for _, b in edges}
    for h in hosts:
        above = h.partition(".")[2]
        if above in hosts:
            edges[h, above] += 1
            edges[above, h] += 1

    def spread(links, verdict):
        own, all_pages = Counter(h for _, h, _, r in named if r and r.verdict == verdict), Counter(h for _, h, *_ in named)
        seeds = {h: 10**6 * c // all_pages[h] for h, c in own.items() if h}
        total = defaultdict(int)
        for (a, _), n in links.items():
            total[a] += n
        score = dict(seeds)
        for _ in range(rounds):
            new = defaultdict(int, seeds)
            for (a, b), n in links.items():
                new[b] += score.get(a, 0) * 85 // 100 * n // total[a] if a in score else 0
            score = {h: s for h, s in new.items()}
        return score

    trust, distrust = spread(edges, "allow"), spread({(b, a): n for (a, b), n in edges.items()}, "block")
    result = []
    for key, host, path, rule in named:
        t, d = trust.get(host, 0), distrust.get(host, 0)
        own = "block" if d - t >= 500_000 else "allow"
        result.append((key, host, path, rule and rule.host + rule.path, rule.verdict if rule else own, t, d))
    return sorted(result, key=str)


@pytest.mark.parametrize("rounds", [3])
def test_judge_against_brute_force(spark, rounds):
    ready(spark)
    extra = "page_id bigint, url string, html string, host string, a string, score string, id string"
    pages = spark.createDataFrame([(*p, "x", "x", "x", "x") for p in PAGES], extra)
    got = link_trust.judge(pages, queries.URL_RULES, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=str) == plain_judge(PAGES, rounds)


def test_links_lend_distrust_and_trust(spark):
    ready(spark)
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    verdicts = {r.id: r.verdict for r in link_trust.judge(pages, queries.URL_RULES, rounds=2, threshold=100_000).collect()}
    assert verdicts[5] == "block"  # only links to a blocked host
    assert verdicts[14] == "allow" and verdicts[6] == "allow" and verdicts[7] == "block" and verdicts[8] == "allow" and verdicts[9] == "block"
    assert link_trust.judge(pages.where("false"), queries.URL_RULES, rounds=1).collect() == []
