"""Operators on documents: defined cases and brute force on small data."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from sitesift.llm import license_join, minhash, ngram_trie, quality_rules, resample, toxicity, winnow
from sitesift.llm import _text as T
from sitesift.session import ship_package

DOCS = "doc_id bigint, text string, th string, kept int"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empties, ties, repeated rows, a long text and
    extra columns whose names clash with the operators' own."""
    ship_package(spark)
    long = " ".join(f"w{i} the x{i % 7}" for i in range(20_000))
    one = " ".join(f"alpha{i} beta{i % 5}" for i in range(40))
    near = one.replace("alpha7 ", "changed ")
    rows = [(1, one), (2, near), (3, one), (3, one), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, "few words only"),
            (None, one), (None, None), (9, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
            (10, "under the\nMIT license " * 3), (11, "été Ünder über straße " * 30), (12, "a b c d e f g h i j k l m n o p q"),
            (13, "x a b c d e f g h i j k l m y z " + "pad " * 200), (14, "ab cd")]
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    ship_package(spark)
    return spark.createDataFrame([], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingle_set(text):
    w = space_words(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_words_follow_the_byte_rules():
    texts = ["", None, "a  b\tc", "é x y", " \n ", "Ab aB AB", "x" * 5000 + " y"]
    column = pa.array(texts)
    got = [0] * len(texts)
    same = None
    for s in T.slices(column, slice_bytes=16):
        words, doc = s.words(lower=True)
        for d in doc:
            got[s.first + d] += 1
        if s.first <= 5 < s.first + s.n:
            same = words[doc == 5 - s.first]
    assert got == [len(space_words(t)) for t in texts]
    assert len(set(same.tolist())) == 1


@pytest.mark.parametrize("group", [128, 2])
def test_near_duplicates_against_brute_force(spark, docs, group, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", group)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(components(rows), key=key)


def test_mixed_large_buckets_lose_no_link(spark, monkeypatch):
    """A family of texts in chains of small edits, with groups of two only."""
    monkeypatch.setattr(minhash, "GROUP", 2)
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(40):
        words = list(base)
        for k in rng.integers(0, 60, size=int(rng.integers(0, 4))):
            words[k] = f"e{rng.integers(0, 5)}"
        rows.append((i, " ".join(words)))
        if i % 10 == 9:
            base = words
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()]
    assert sorted(got) == sorted(components(rows))


def test_one_row_of_each_group_stays(spark, docs, none):
    kept = minhash.unique_rows(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, None]      # the null with the copy goes, the empty one stays
    assert minhash.unique_rows(none).count() == 0 and minhash.near_duplicates(none).count() == 0


def brute_quality(text):
    words = space_words(text)
    lines = [x for x in (text or "").split("\n") if space_words(x)]
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_ledger_policies_and_ablations(docs, none):
    led = quality_rules.verdicts(quality_rules.ledger(docs)).collect()
    want = sorted(((r.doc_id, *brute_quality(r.text)) for r in docs.collect()), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in led), key=key) == want
    for r in led:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    stays = quality_rules.kept_rows(docs)
    assert stays.columns == docs.columns and stays.count() == sum(r.kept for r in led)
    table = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(docs)).collect()}
    assert table["too_few_words"].n_fail == sum(r.n_words < 50 for r in led)
    assert quality_rules.ledger(none).count() == 0 and quality_rules.kept_rows(none).count() == 0


def test_winnowing_against_brute_force(spark, docs, none):
    items = spark.createDataFrame(
        [(1, "A b c, d e f g h i j k l m"), (2, "ab cd"), (3, None), (None, "few WORDS only"), (5, "alpha3 beta3 alpha4 beta4 alpha5 beta0 alpha6"),
         (5, "alpha3 beta3 alpha4 beta4 alpha5 beta0 alpha6"), (6, "...")], "item_id bigint, text string")
    wins = set()
    for r in items.collect():
        w = alnum_words(r.text)
        size = min(13, len(w))
        wins |= {("" if r.item_id is None else str(r.item_id), tuple(w[i:i + size])) for i in range(len(w) - size + 1) if w}
    want = []
    for r in docs.collect():
        w, hit, found = alnum_words(r.text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        want.append((r.doc_id, len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w)))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in winnow.decontaminate(docs, items).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    clean = winnow.clean_rows(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)
    assert winnow.decontaminate(none, items).count() == 0
    assert winnow.decontaminate(docs, items.limit(0)).filter("contaminated or n_hit > 0").count() == 0


def test_winnowing_of_random_texts(spark, monkeypatch):
    """Few words, so that hashes tie and fingerprints repeat; items of every
    length from 1 to 40; one fingerprint that many items share, in blocks."""
    rnd = random.Random(11)
    some = lambda n, kinds: " ".join(rnd.choice("abcdefghijklmnop"[:kinds]) for _ in range(n))
    items = [(i, some(1 + i % 40, 2 + i % 9)) for i in range(80)]
    items += [(100 + i, f"what is the capital of {i} " + some(9, 12)) for i in range(60)]
    texts = [some(rnd.randint(0, 120), 2 + i % 14) for i in range(60)]
    for i in range(60):     # passages of items, whole and cut, between other words
        words = rnd.choice(items)[1].split()
        cut = words[rnd.randint(0, len(words) - 1) // 3:]
        texts.append(" ".join([some(rnd.randint(0, 60), 16), *cut, some(rnd.randint(0, 60), 16)]))
    want = []
    for i, text in enumerate(texts):
        w, hit, found = text.split(), set(), set()
        for item, t in items:
            t = t.split()
            size = min(13, len(t))
            wins = {tuple(t[j:j + size]) for j in range(len(t) - size + 1)}
            for j in range(len(w) - size + 1):
                if tuple(w[j:j + size]) in wins:
                    hit |= set(range(j, j + size))
                    found.add(str(item))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(found), ids))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    pick = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    assert sorted(map(tuple, winnow.decontaminate(d, b).select(*pick).collect())) == want
    long = [x for x in items if len(x[1].split()) >= 13]    # one span: the usual plan
    b13 = spark.createDataFrame(long, "item_id long, text string")
    whole = sorted(map(tuple, winnow.decontaminate(d, b13).select(*pick).collect()))
    for n, (i, t) in enumerate(zip(want, texts)):
        w = t.split()
        wins = {tuple(x[1].split()[j:j + 13]) for x in long for j in range(len(x[1].split()) - 12)}
        hit = {k for j in range(len(w) - 12) if tuple(w[j:j + 13]) in wins for k in range(j, j + 13)}
        assert whole[n][2] == len(hit)
    monkeypatch.setattr(winnow, "BLOCK", 40)
    assert sorted(map(tuple, winnow.decontaminate(d, b13).select(*pick).collect())) == whole


def test_winnowing_in_blocks_gives_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"alpha{i} beta{i % 5}" for i in range(k, k + 9))) for k in range(12)],
                                  "item_id bigint, text string")
    whole = sorted(map(tuple, winnow.decontaminate(docs, items).collect()), key=key)
    monkeypatch.setattr(winnow, "BLOCK", 20)
    assert sorted(map(tuple, winnow.decontaminate(docs, items).collect()), key=key) == whole


def test_license_scan(docs, none):
    rows = license_join.scan(docs).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=key)
    want = []
    for r in docs.collect():
        w, places, labels = alnum_words(r.text), [], set()
        for text, label in license_join.PHRASES:
            p = text.split()
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        want.append((r.doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert got == sorted(want, key=key)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_join.scan(none).count() == 0


def test_language_model_against_counts(spark, docs, none):
    trie = ngram_trie.build(docs, order=2, cutoff=2)
    rows = docs.collect()
    tokens = [[*space_words(lower(r.text)), None] for r in rows]
    train = [t for r, t in zip(rows, tokens) if r.doc_id is None or crc32(str(r.doc_id).encode()) % 10]
    count = Counter(w for t in train for w in t)
    total, size = sum(count.values()), len(count)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    left = Counter()
    for (a, _), c in pairs.items():
        left[a] += c
    kept = {p: (c - 0.75) / left[p[0]] for p, c in pairs.items() if c >= 2}
    spent = Counter()
    for (a, _), p in kept.items():
        spent[a] += p

    def p1(w):
        return (count[w] + 0.1) / (total + 0.1 * (size + 1))

    def p2(a, w):
        return kept.get((a, w), 0) + (1 - spent[a]) * p1(w)

    want = sorted(((r.doc_id, len(t), sum(count[w] > 0 for w in t), total, sum(math.log10(p1(w)) for w in t),
                    sum(math.log10(p2(a, w)) for a, w in zip(["<s>", *t], t))) for r, t in zip(rows, tokens)), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_trie.score(docs, trie).collect()), key=key)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
        assert abs(a[5] - b[5]) <= 0.05 * b[1]          # a byte per probability
    empty = ngram_trie.build(none)
    assert ngram_trie.score(none, empty).count() == 0
    assert all(r.score == 0 for r in ngram_trie.score(docs, empty).collect())


def test_language_model_of_order_three_against_counts(spark, docs, none, monkeypatch):
    """As the registered query builds it: every successor, three levels, and here several shards of the third."""
    monkeypatch.setattr(ngram_trie, "SHARD_PAIRS", 1 << 14)
    trie = ngram_trie.build(docs)
    rows = docs.collect()
    tokens = [["<s>", *space_words(lower(r.text)), None] for r in rows]
    train = [t for r, t in zip(rows, tokens) if r.doc_id is None or crc32(str(r.doc_id).encode()) % 10]
    count = Counter(w for t in train for w in t[1:])
    total, size = sum(count.values()), len(count)

    def level(n):
        grams = Counter(g for t in train for g in zip(*(t[k:] for k in range(n))))
        seen, kinds = Counter(), Counter()
        for g, c in grams.items():
            seen[g[:-1]] += c
            kinds[g[:-1]] += 1
        return lambda context, w, lower_p: lower_p if not seen[context] else (
            max(grams[(*context, w)] - 0.75, 0) + 0.75 * kinds[context] * lower_p) / seen[context]

    two, three = level(2), level(3)

    def logs(t):
        for i in range(1, len(t)):
            p = two((t[i - 1],), t[i], (count[t[i]] + 0.1) / (total + 0.1 * (size + 1)))
            yield math.log10(three((t[i - 2], t[i - 1]), t[i], p) if i > 1 else p)

    want = sorted(((r.doc_id, len(t) - 1, sum(logs(t))) for r, t in zip(rows, tokens)), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.score) for r in ngram_trie.score(docs, trie).collect()), key=key)
    assert sum(trie.pairs) > ngram_trie.SHARD_PAIRS
    assert sum(trie.pairs) == len({p for t in train for p in zip(t, t[1:])})
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 0.05 * b[1]
    assert all(r.score == 0 for r in ngram_trie.score(docs, ngram_trie.build(none, order=3, cutoff=1)).collect())


def test_elias_fano_round_trip():
    from sitesift.llm import elias_fano
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (5000, 1 << 60), (3000, 100), (2049, 10_000)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        seq = elias_fano.Sequence(np.frombuffer(elias_fano.encode(values) + bytes(8), np.uint8))
        assert (seq.take(np.arange(n)) == values).all()
        distinct = np.unique(values)
        seq = elias_fano.Sequence(np.frombuffer(elias_fano.encode(distinct), np.uint8))
        probe = np.unique(np.concatenate([distinct[::3], distinct[::5] + np.uint64(1)]))
        at = seq.search(probe)
        assert ((at >= 0) == np.isin(probe, distinct)).all() and (distinct[at[at >= 0]] == probe[at >= 0]).all()


def test_toxicity_learns_and_locates(spark, none):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        said = [" ".join(f"c{rng.integers(0, 50)}" for _ in range(8)) for _ in range(6)]
        if i % 4 == 0:
            said[int(rng.integers(0, 6))] += f" nasty{'ness' if i % 8 else ''} vile"
        rows.append((i, ". ".join(said)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "c1 c2")], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, marks).collect()}
    held = [(r.predicted, int(i % 4 == 0)) for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert got[1000].score == got[1001].score == 0 and got[None].held_out is False
    found = toxicity.offending(docs, toxicity.fit(docs, marks)).collect()
    assert found and all("nasty" in r.text or "vile" in r.text for r in found)
    assert toxicity.mild_rows(docs, marks).columns == docs.columns
    assert toxicity.scores(none, marks).count() == 0
    assert all(r.score == 0 for r in toxicity.scores(docs, marks.limit(0)).collect())


def test_toxicity_fits_on_one_row_of_each_text(spark, monkeypatch):
    ship_package(spark)
    rows = [(1, "a"), (1, "a"), (1, "b"), (1, None), (1, None), (2, "a"), (3, "c"), (None, "d"), (9, "e")] + [(4, "hot")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    sample = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (7, 1)], "doc_id bigint, label int")
    got = sorted(map(tuple, toxicity.chosen_texts(docs, sample).collect()), key=key)
    assert got == sorted([("a", 0), ("b", 0), (None, 0), ("a", 0), ("c", 1), ("hot", 1)], key=key)
    monkeypatch.setattr(toxicity, "PER_CLASS", 2)
    got = [r.label for r in toxicity.chosen_texts(docs, sample).collect()]
    assert sorted(got) == [0, 0, 1, 1]
    # Copies don't change the weights.
    once = spark.createDataFrame(sorted(set(r for r in rows if r[0] and r[1])), docs.schema)
    text = [(i, f"calm{i % 5} plain{i % 3}" + (" vile nasty" if i % 2 else "")) for i in range(20, 80)]
    more = spark.createDataFrame(text, docs.schema)
    marks = spark.createDataFrame([(i, i % 2) for i in range(20, 80)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "PER_CLASS", 100)
    one, many = toxicity.fit(once.union(more), marks), toxicity.fit(once.union(more).union(more.filter("doc_id < 30")), marks)
    assert one.any() and np.allclose(one, many, atol=1e-3)


def test_toxicity_sample_is_not_cut_for_memory():
    assert toxicity.PER_CLASS >= 4000


def test_resampling_prefers_the_target(spark, docs, none):
    marks = spark.createDataFrame([(i, 1 if i < 4 else 0) for i in range(1, 15)], "doc_id bigint, quality int")
    rows = resample.resample(docs, marks, keep=0.5).collect()
    assert len(rows) == docs.count()
    keys = sorted((r.gumbel_key for r in rows), reverse=True)
    k = math.ceil(0.5 * len(rows))
    assert {r.kept for r in rows if r.gumbel_key >= keys[k - 1]} == {True}
    assert not any(r.kept for r in rows if r.gumbel_key < keys[k - 1])
    assert {r.log_weight for r in rows if r.n_grams == 0} == {0.0}
    good = [r.log_weight for r in rows if r.doc_id in (1, 2, 3)]
    assert min(good) > max(r.log_weight for r in rows if r.doc_id in (7, 11))
    assert resample.resample(none, marks).count() == 0


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(2)
    values = [float(x) for x in np.round(rng.normal(size=30_000), 3)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    values.sort(reverse=True)
    for k in (1, 777, 15_000, 30_000):
        assert resample.kth_largest(df, "v", k) == values[k - 1]
