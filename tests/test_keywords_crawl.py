"""A4-A6 against Python's tokenizer, C3 against the crawl loop (brute force)."""

import random
import re
from collections import Counter

from sitesift.functions.text import STOP_WORDS
from sitesift.operators import analytics as A
from sitesift.plans import crawl as C


def py_counts(texts):
    words = [w for t in texts for w in re.findall(r"\b\w+\b", t.lower())]
    return Counter(w for w in words if w not in STOP_WORDS)


def test_tokens_match_python(spark):
    texts = ["Héllo wörld_1 N/A the Ærø", "ÉCOLE école 42 x_y", "naïve café; déjà-vu 3.14"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r.n for r in A.keyword_counts(df, "text").collect()}
    assert got == dict(py_counts(texts))


def test_low_keywords_rules(spark):
    def low(texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        return [r.word for r in A.low_keywords(A.keyword_counts(df, "text")).orderBy("rank").collect()]
    assert low(["alpha beta gamma"]) == []                    # exactly three distinct: nothing
    assert low(["alpha beta gamma delta"]) == ["gamma", "delta", "beta"]  # all counts 1: last three
    # with repeated words, only words seen more than once are candidates
    assert low(["x x x y y z z w"]) == ["z", "y", "x"]


def crawl_loop(items, max_empty=5):
    empty, kept = 0, []
    for page, n in items:
        kept.append(page)
        if n == 0:
            empty += 1
            if empty >= max_empty:
                return kept, page
        else:
            empty = 0
    return kept, None


def test_crawl_halt_matches_loop(spark):
    rnd = random.Random(7)
    grid, want = [], {}
    for site in range(60):
        items = [(p, rnd.choice([0, 0, 0, 1, 2])) for p in range(1, 31)]
        grid += [(site, p, n) for p, n in items]
        want[site] = crawl_loop(items)
    df = spark.createDataFrame(grid, "site int, page int, items long")
    out = C.crawl_halt(df).collect()
    got = {}
    for r in out:
        got.setdefault(r.site, ([], r.stop_page))[0].append(r.page)
    for site, (pages, stop) in want.items():
        assert sorted(got[site][0]) == pages and got[site][1] == stop, site


def test_concentration_and_outliers(spark):
    df = spark.createDataFrame([("g", e) for e in "aaaabbc"], "g string, e string")
    r = A.concentration(df, "e", ["g"]).collect()[0]
    assert (r.n_entities, r.n_records, r.top_entity) == (3, 7, "a")
    assert abs(r.hhi - (16 + 4 + 1) / 49) < 1e-6
    assert abs(r.top3_share - 1.0) < 1e-9 and abs(r.top_share - 4 / 7) < 1e-6
    vals = [("t", float(v)) for v in [10] * 30 + [1000]]
    od = spark.createDataFrame(vals, "g string, v double")
    assert [r.v for r in A.outliers(od, "v", ["g"]).collect()] == [1000.0]


def test_crawl_run_matches_loop(spark):
    rnd = random.Random(11)
    frontier, recs, want = [], [], {}
    rid = 0
    for site in range(40):
        pages = []
        for p in range(1, 26):
            n = rnd.choice([0, 0, 0, 1, 3])
            frontier.append((site, p))
            ids = list(range(rid, rid + n))
            rid += n
            recs += [(site, p, i) for i in ids]
            pages.append((p, ids))
        # the loop: accumulate page by page, halt on 5 empty pages or at the limit
        acc, empty = [], 0
        for p, ids in pages:
            if len(acc) >= 7:
                break
            if not ids:
                empty += 1
                if empty >= 5:
                    break
            else:
                empty = 0
                acc += ids[: 7 - len(acc)]
        want[site] = acc
    f = spark.createDataFrame(frontier, "site int, page int")
    r = spark.createDataFrame(recs, "site int, page int, ordinal long")
    got = {}
    for row in C.crawl_run(f, r, 7).collect():
        got.setdefault(row.site, []).append(row.ordinal)
    assert {s: sorted(v) for s, v in got.items()} == {s: v for s, v in want.items() if v}
