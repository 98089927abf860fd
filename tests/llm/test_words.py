"""Different words stay different: hashes, and the operators built on them."""

import numpy as np
import pyarrow as pa
import pytest

from sitesift.llm import _text as T
from sitesift.llm import minhash, ngram_trie, pieces, quality_rules
from sitesift.session import ship_package


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


PAIRS = [(thue_morse(n, 0), thue_morse(n, 1)) for n in (16, 64, 1024, 4096)]


def spans(texts):
    s = next(T.slices(pa.array(texts), 1 << 30))
    return s, *s.spans(T.SPACE_SEP)[:2]


@pytest.mark.parametrize("pair", PAIRS, ids=lambda p: str(len(p[0])))
def test_the_words_that_collide_modulo_a_power_of_two(pair):
    s, begin, end = spans(list(pair))
    assert len(set(s.hashes(begin, end, False).tolist())) == 2


def test_equal_words_and_only_they_have_equal_hashes():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abAB"), rng.integers(1, 90))) for _ in range(5000)] + ["a", "a\0", "\0", "é", "É"]
    s, begin, end = spans([" ".join(words)])
    for lower in (False, True):
        seen = {}
        for word, h in zip([w.translate(str.maketrans("AB", "ab")) for w in words] if lower else words, s.hashes(begin, end, lower).tolist()):
            assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_kinds_are_told_apart_by_bytes(monkeypatch):
    words = ["abc", "abd", "abc", "x" * 100, "x" * 99 + "y", "x" * 100, "0123456789", "012345678_"] * 3
    s, begin, end = spans([" ".join(words)])
    for hashes in (s.hashes, lambda b, e, lower: np.zeros(len(b), np.uint64), lambda b, e, lower: (e - b).astype(np.uint64)):
        monkeypatch.setattr(s, "hashes", hashes, raising=False)
        at, which = s.distinct(begin, end)
        assert [words[k] for k in np.array(at)[which]] == words


def test_operators_keep_such_words_apart(spark):
    ship_package(spark)
    one, two = PAIRS[2]
    rows = [(1, f"{one} b c d e f"), (2, f"{two} b c d e f"), (3, f"{one}\n{two}\n{one}"), (4, two), (21, one)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    quality = {r.doc_id: r for r in quality_rules.verdicts(quality_rules.ledger(df)).collect()}
    assert quality[3].n_dup_lines == 1 and quality[3].n_repeat_words == 0
    same = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert same == {1: 1, 2: 2, 3: 3, 4: 4, 21: 21}
    # The model learns only from rows with the first word: the second is unknown to it.
    train = [r for r in rows if r[0] not in (2, 3, 4)]
    trie = ngram_trie.build(spark.createDataFrame(train, "doc_id bigint, text string"))
    known = {r.doc_id: r.n_known for r in ngram_trie.score(df, trie).collect()}
    assert known[1] == 7 and known[2] == 6 and known[4] == 1
    data = pieces.load()
    import sentencepiece
    spm = sentencepiece.SentencePieceProcessor(model_proto=data)
    for r in pieces.encoded(df, data).collect():
        assert r.round_trip and r.parity and r.ids == spm.encode(r.text)


def test_a_wrong_id_is_seen():
    codec = pieces.codec(pieces.load())
    texts = ["one two three", "", "  spaced out ", "é😀 mixed\nlines", "x" * 3000]
    s = next(T.slices(pa.array(texts)))
    ids, size, trip, parity = codec.encode_slice(s)
    assert trip.all() and parity.all()
    last = np.cumsum(size)
    for k in (0, 2, 3, 4):
        bad = ids.copy()
        bad[last[k] - 1] = (bad[last[k] - 1] + 7) % len(codec.says)
        assert codec.reads_back(s, bad, size).tolist() == [j != k for j in range(len(texts))]
    assert pieces.cuts(pieces.Model(codec.model.pieces, pieces.MERGES, False, b"", True, False, True)) is None


def test_a_text_of_many_megabytes_takes_bounded_memory():
    import tracemalloc
    text = pa.array(["some words of a rather long text " * 600_000])         # 20 MB
    tracemalloc.start()
    for s in T.slices(text):
        s.words(lower=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * 20e6


def test_license_labels_need_the_word_that_tells(spark):
    from sitesift.llm import license_join
    ship_package(spark)
    mit, bsd = (next(t for t, label in license_join.TEMPLATES if label == want and len(t.split()) > 60) for want in ("mit", "bsd"))
    cut = " ".join(w for i, w in enumerate(mit.split()) if i % 12)          # about a twelfth of the words lost
    filler = " ".join(f"w{i}" for i in range(150))
    texts = {1: ("Released under the Apache License", ""), 2: ("licensed under cc by 4 0", ""), 3: ("licensed under the BSD license version 2 0", ""),
             4: ("Released under the MIT License", "mit"), 5: (f"{filler} {cut} {filler}", "mit"), 6: (" ".join(mit.split()[:80]), "mit"),
             7: (f"{filler} {bsd.upper()}\n{filler}", "bsd"), 8: (filler, "")}
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in license_join.scan(df).collect()}
    assert got == {i: want for i, (_, want) in texts.items()}


def test_warc_requests_and_sizes(spark):
    from sitesift.llm import warc
    from sitesift.llm._runtime import scratch
    ship_package(spark)
    urls = ["http://a.org", "http://a.org?q=1", "http://a.org/x?y=2#frag", "http://a.org#top", None, "no scheme", "http://a.org/\r\nHost: b"]
    sizes = [10, 70_000, 2_000_000, 20_000_000]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(100 + i, "http://b.org/", f"{i}" + "é" * (n // 2)) for i, n in enumerate(sizes)]
    path = scratch(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    found = warc.read_records(spark, path)
    assert found.select("id").distinct().count() == 3 * len(rows)
    lines = {r.page_id: r.line for r in warc.captures(found).selectExpr("metadata.page_id", "split(request.block, '\r\n')[0] AS line").collect()}
    assert [lines[i] for i in range(len(urls))] == [f"GET {p} HTTP/1.1" for p in ("/", "/?q=1", "/x?y=2", "/", "/", "/no%20scheme", "/%0D%0AHost:%20b")]
    got = {r.page_id: r.payload_bytes for r in warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: len(h.encode()) for i, _, h in rows}
    folders = {r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).selectExpr("regexp_extract(path, '(upto-[0-9]+)', 1)").collect()}
    assert len(folders) == 4


def test_an_archive_is_read_in_pieces():
    import zlib
    from sitesift.llm import warc
    records = [b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in (b"", b"a\r\n\r\nWARC/1.1\r\n", b"z" * 5_000_000)]
    def gzip(data):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()
    for data in (gzip(b"".join(records)), b"".join(map(gzip, records))):        # one member, or one a record
        pieces = list(warc.inflated(data))
        assert max(map(len, pieces)) <= warc.PIECE and b"".join(pieces) == b"".join(records)
        assert [len(block) for _, block in warc.parse(iter(pieces))] == [0, 15, 5_000_000]
    with pytest.raises(ValueError):
        list(warc.parse(iter([records[2][:-10]])))
