"""Where scans start and stop."""

import random

import pytest

from millrace.operators import paging

RUN = "run bigint, start_page bigint, page_size bigint, max_pages bigint, cursor string, retain_empty boolean"
PAGE = "run bigint, page bigint, n bigint, error string"


def scan(spark, sizes, page_size=None, max_pages=500, cursor=None, retain=False, start=1, errors=None):
    errors = errors or {}
    pages = [(1, start + i, n, errors.get(start + i)) for i, n in enumerate(sizes)]
    page_df = spark.createDataFrame(pages, PAGE)
    run_df = spark.createDataFrame([(1, start, page_size, max_pages, cursor, retain)], RUN)
    outcomes = paging.scan_outcomes(page_df, run_df)
    kept = paging.kept_pages(page_df, outcomes).orderBy("page")
    return outcomes.first(), [(r.page, r.n, r.cursor_used, r.next_cursor) for r in kept.collect()]


def test_short_page_ends_the_scan(spark):
    end, kept = scan(spark, [2, 1, 2], page_size=2)
    assert (end.outcome, end.last_page) == ("succeeded", 2)
    assert kept == [(1, 2, "1", "2"), (2, 1, "2", None)]


def test_without_page_size_only_an_empty_page_ends_it(spark):
    end, kept = scan(spark, [1, 0, 5])
    assert (end.outcome, end.last_page) == ("succeeded", 1)
    assert kept == [(1, 1, "1", "2")]


def test_empty_terminal_page_is_kept_on_request(spark):
    _, kept = scan(spark, [1, 0], retain=True)
    assert kept == [(1, 1, "1", "2"), (2, 0, "2", None)]


def test_full_page_at_the_limit_fails_and_keeps_its_pages(spark):
    end, kept = scan(spark, [1, 1, 1], max_pages=3)
    assert (end.outcome, end.category, end.last_page) == ("failed", "PageLimitExceededError", 3)
    assert kept[-1] == (3, 1, "3", "4")


@pytest.mark.parametrize("sizes, page_size", [([2, 1], 2), ([1, 0], None)])
def test_natural_end_at_the_limit_succeeds(spark, sizes, page_size):
    end, _ = scan(spark, sizes, page_size=page_size, max_pages=2)
    assert end.outcome == "succeeded"


def test_resumed_scan_has_a_fresh_budget(spark):
    end, kept = scan(spark, [1, 1, 1, 1, 0], max_pages=2, cursor="3")
    assert (end.start, end.category) == (3, "PageLimitExceededError")
    assert [k[0] for k in kept] == [3, 4]


@pytest.mark.parametrize(
    "cursor, start", [("", 1), (None, 1), (" 4 ", 4), ("+2", 2), ("1_0", 10), ("-1", -1)]
)
def test_cursor_is_read_as_an_integer(spark, cursor, start):
    run = spark.createDataFrame([(1, 1, None, 5, cursor, False)], RUN)
    assert paging.resume_runs(run).first().start == start


@pytest.mark.parametrize("cursor", ["abc", "4.5", "1__0", "4x", "0x1"])
def test_other_cursors_fail_as_unexpected(spark, cursor):
    end, kept = scan(spark, [1, 0], cursor=cursor)
    assert (end.outcome, end.category, kept) == ("failed", "UnexpectedError", [])


def test_first_error_cuts_off_later_pages(spark):
    end, kept = scan(spark, [2, 2, 2, 0], errors={2: "MappingError", 3: "LoadFailed"})
    assert (end.category, end.last_page, len(kept)) == ("MappingError", 1, 1)


def test_error_beats_a_short_page_and_the_limit(spark):
    end, _ = scan(spark, [2, 1], page_size=2, max_pages=2, errors={2: "LoadFailed"})
    assert end.category == "LoadFailed"


def test_run_without_pages_is_incomplete(spark):
    end, kept = scan(spark, [1, 1], cursor="7")
    assert (end.outcome, end.last_page, kept) == ("incomplete", 6, [])


def walk(pages, start, page_size, max_pages, retain):
    """The page loop, one page after another."""
    page, done = start, 0
    while True:
        if page not in pages:
            return "incomplete", None, page - 1
        n, error = pages[page]
        if error:
            return "failed", error, page - 1
        if n == 0:
            return "succeeded", None, page if retain else page - 1
        if page_size is not None and n < page_size:
            return "succeeded", None, page
        done += 1
        if done >= max_pages:
            return "failed", "PageLimitExceededError", page
        page += 1


def test_random_scans_match_the_page_loop(spark):
    rng = random.Random(7)
    pages, runs, want = [], [], {}
    for run in range(400):
        size = rng.choice([None, 1, 2, 3])
        start, limit, retain = rng.randint(1, 3), rng.randint(1, 6), rng.random() < 0.5
        landed = {}
        for page in range(1, rng.randint(1, 10)):
            if rng.random() < 0.95:
                error = rng.choice(["A", "B"]) if rng.random() < 0.08 else None
                landed[page] = (rng.choice([0, 1, 2, 3, 3, 3]), error)
        pages += [(run, p, n, e) for p, (n, e) in landed.items()]
        runs.append((run, start, size, limit, None, retain))
        want[run] = walk(landed, start, size, limit, retain)
    outcomes = paging.scan_outcomes(
        spark.createDataFrame(pages, PAGE), spark.createDataFrame(runs, RUN)
    )
    got = {r.run: (r.outcome, r.category, r.last_page) for r in outcomes.collect()}
    assert got == want


def test_pages_are_numbered_without_a_dense_key(spark):
    rows = spark.createDataFrame([(f"k{i:03d}",) for i in random.Random(1).sample(range(100), 100)], "k string")
    cut = {r.k: r.page for r in paging.cut_pages_by_order(rows, ["k"], 30).collect()}
    assert [cut[f"k{i:03d}"] for i in (0, 29, 30, 89, 90, 99)] == [1, 1, 2, 3, 4, 4]
