"""Chat, WARC, tokenizer and pipeline."""

import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sitesift.llm import chat, pieces, warc
from sitesift.llm._runtime import scratch, table
from sitesift.session import ship_package

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def turns(spark):
    ship_package(spark)
    odd = "a <|im_end|>\n<\\|im_start|> <\\\\| x"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", odd), (2, 0, "user", "hi"), (2, 1, "assistant", None), (2, 2, "user", ""),
            (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 0, "sys\ntem\\<|", odd), (4, 0, "user", "hi"), (4, 0, "user", "hi"),
            (None, 0, None, "no id"), (5, 0, "assistant", "word " * 30_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, path string")


def _by_conv(turns):
    out = {}
    for r in turns.collect():
        out.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    return {c: [(role, text) for _, role, text in sorted(rows)] for c, rows in out.items()}


def _check_reading(by_conv, rows):
    got = {r.conv_id: r for r in rows}
    assert set(got) == set(by_conv) and len(rows) == len(got)
    for conv, said in by_conv.items():
        loss = "".join(t for role, t in said if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(said) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        formatted = "".join(f"{chat.START}{chat.escape_role(a)}\n{chat.escape(t)}{chat.END}\n" for a, t in said)
        assert r.formatted_chars == len(formatted)


def _check_tree(by_conv, tree, segments, leaves):
    """Against the tree of all prefixes: each is one node, the stream is depth-
    first, positions count the ancestors' tokens, intervals are the segments."""
    code = chat.coder(chat.load_ranks())
    through = collections.Counter(tuple(said[:k]) for said in by_conv.values() for k in range(1, len(said) + 1))
    nodes = sorted(tree.collect(), key=lambda r: r.at)
    assert len(nodes) == len(through)
    ends = itertools.accumulate((len(n.tokens) for n in nodes), initial=0)
    assert [n.at for n in nodes] == list(ends)[:-1]
    attends = {r.segment: [(x["from"], x.to, x.nodes) for x in r.attends] for r in segments.collect()}
    in_segment = {}
    for n in nodes:
        in_segment.setdefault(n.segment, []).append(n)
    at = {}
    for r in leaves.collect():
        said, spans = by_conv[r.conv_id], attends[r.segment]
        path = [n for a, _, _ in spans for n in in_segment[a]]
        assert [code.turns(n.tokens)[0] for n in path] == said and [n.depth for n in path] == list(range(1, len(said) + 1))
        assert [(a, b, k) for a, b, k in spans] == [
            (s[0].at, s[-1].at + len(s[-1].tokens), len(s)) for s in (in_segment[a] for a, _, _ in spans)]
        sizes = [len(n.tokens) for n in path]
        assert [n.first_position for n in path] == list(itertools.accumulate(sizes, initial=0))[:-1]
        prefixes = [tuple(said[:k]) for k in range(1, len(said) + 1)]
        heads = [n.at for n, p in zip(path, prefixes) if len(p) == 1 or through[p] != through[p[:-1]]]
        assert [a for a, _, _ in spans] == heads
        for n, p in zip(path, prefixes):
            assert at.setdefault(p, n.at) == n.at
    rank = {a: i for i, a in enumerate(sorted(at.values()))}
    below = {}
    for p, a in at.items():
        for k in range(1, len(p) + 1):
            below.setdefault(p[:k], []).append(rank[a])
    for p, ranks in below.items():                     # a node is followed by all that is below it
        assert min(ranks) == rank[at[p]] and max(ranks) - min(ranks) == len(ranks) - 1


def test_chat_reads_back_every_turn_and_loss(turns):
    ranks = chat.load_ranks()
    _check_reading(_by_conv(turns), chat.read_back(*chat.prefix_tree(turns, ranks), ranks).collect())


def test_chat_tree_is_one_depth_first_stream(turns):
    tree, segments, leaves = chat.prefix_tree(turns, chat.load_ranks())
    _check_tree(_by_conv(turns), tree, segments, leaves)
    assert sum(n.depth == 1 for n in tree.collect()) < 6            # the shared first turn is one node


@pytest.mark.parametrize("popular,piece", [(1000, 1000), (3, 2)])
def test_chat_random_trees(spark, monkeypatch, popular, piece):
    monkeypatch.setattr(chat, "POPULAR", popular)
    monkeypatch.setattr(chat, "PIECE", piece)
    rng = random.Random(popular)
    rows, said = [], [[]]
    for conv in range(60):
        line = rng.choice(said)[:rng.randint(0, 9)] + [(rng.choice(["user", "assistant", "a\\n\n"]), rng.choice("xyz") * rng.randint(0, 3))
                                                       for _ in range(rng.randint(1, 4))]
        said.append(line)
        rows += [(conv or None, k, *t) for k, t in enumerate(line)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    ranks = chat.load_ranks()
    tree, segments, leaves = chat.prefix_tree(df, ranks)
    _check_tree(_by_conv(df), tree, segments, leaves)
    _check_reading(_by_conv(df), chat.read_back(tree, segments, leaves, ranks).collect())


def test_chat_long_conversations_are_few_intervals(spark):
    ship_package(spark)
    n = spark.range(100_000).select(F.lit(None).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                    F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    one = spark.range(50_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"),
                                     F.concat(F.lit("t"), F.col("id") % 5).alias("text"))
    short = one.filter("turn < 20000").withColumn("conv_id", F.lit(2).cast("bigint"))
    ranks = chat.load_ranks()
    df = n.unionByName(one).unionByName(short)
    tree, segments, leaves = chat.prefix_tree(df, ranks)
    assert sorted(len(r.attends) for r in segments.collect()) == [1, 1, 2] and tree.count() == 150_000
    _check_reading(_by_conv(df), chat.read_back(tree, segments, leaves, ranks).collect())


def test_chat_reads_positions_and_intervals_from_the_written_stream(turns):
    ranks = chat.load_ranks()
    tree, segments, leaves = chat.prefix_tree(turns, ranks)
    files = {}
    for r in tree.select(F.input_file_name().alias("file"), "at").collect():
        files.setdefault(r.file, []).append(r.at)
    assert all(files) and all(v == sorted(v) for v in files.values())
    ranges = sorted((v[0], v[-1]) for v in files.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    attends = {r.segment: r.attends for r in segments.collect()}
    leaf = {r.conv_id: r.segment for r in leaves.collect()}
    got = {r.conv_id: r for r in chat.read_back(tree, segments, leaves, ranks).collect()}
    assert set(got) == set(leaf)
    for conv, r in got.items():
        above = attends[leaf[conv]]
        assert r.n_tokens == sum(x["to"] - x["from"] for x in above)
        assert r.positions_sha256 == hashlib.sha256(b"".join(i.to_bytes(8, "little") for i in range(r.n_tokens))).hexdigest()
        assert r.attends_sha256 == hashlib.sha256(",".join(f"{x['from']}:{x['to']}" for x in above).encode()).hexdigest()
    # Without its last interval a conversation loses its last turns; elsewhere in the stream there is no node.
    cut = segments.withColumn("attends", F.expr("slice(attends, 1, greatest(1, size(attends) - 1))"))
    less = chat.read_back(tree, cut, leaves, ranks).collect()
    assert {r.conv_id for r in less if r.turns_sha256 != got[r.conv_id].turns_sha256} == {c for c in got if len(attends[leaf[c]]) > 1}
    for broken in (tree.withColumn("at", F.col("at") + 1), tree.withColumn("segment", F.col("segment") + 1), tree.filter("depth != 2")):
        with pytest.raises(Exception, match="an interval is not in the stream"):
            chat.read_back(broken, segments, leaves, ranks).collect()


def test_chat_empty_table(turns):
    ranks = chat.load_ranks()
    tree, segments, leaves = chat.prefix_tree(turns.limit(0), ranks)
    assert tree.count() == 0 and segments.count() == 0 and chat.read_back(tree, segments, leaves, ranks).count() == 0


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|", "<<||", "<|im_start|><|im_end|>"])
def test_escape_is_reversible_and_hides_control_strings(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert "\n" not in chat.escape_role(text + "\n") and chat.unescape_role(chat.escape_role(text + "\n")) == text + "\n"


def test_warc_round_trip(spark):
    ship_package(spark)
    big = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é" * 1000
    rows = [(1, "http://a.org/x y\n", big), (2, None, big), (3, "http://b.org", "short"), (4, "http://b.org", "short"),
            (5, "http://c.org/", None), (6, "http://c.org/", "z" * 1000), (6, "http://c.org/", "z" * 1000), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == big and i != 2
        want.append((i or 0, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want)
    path = scratch(spark, "warc-test")
    warc.write_archive(pages, path)
    whole = warc.captures(warc.read_records(spark, path, with_payload=True)).collect()
    assert len(whole) == len(rows)
    for r in whole:
        assert r.request.id != r.response.id != r.metadata.id
        if r.metadata.page_id == 2:
            assert bytes(r.response.payload).decode() == big
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pieces_match_the_library_and_round_trip(spark):
    import sentencepiece
    ship_package(spark)
    data = pieces.load()
    texts = ["", None, "plain words, and 3.14!", "  two  spaces ", "a\n\nb\tc", "x▁y mark", "日本語 text \U0001f600", "%%% ### the%%%",
             "<s> </s> <0x41>", "w" * 3000, "same", "same", "long " * 20_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    out = pieces.encoded(df, data)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "round_trip", "parity"]
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    for r in out.collect():
        assert list(r.ids) == model.encode(r.text or "") and r.parity and r.round_trip and r.n_tokens == len(r.ids)
    back = {r.doc_id: r.text for r in pieces.decoded(out, data).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.encoded(df.limit(0), data).count() == 0


def test_pipeline_stages_keep_columns_and_rows(spark):
    import corpus_pipeline as P
    docs = table(spark, SMALL, "documents")
    rows, columns = docs.count(), docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality_rules", "near_dedup", "decontamination", "sentencepiece"]
    from sitesift.llm._runtime import written
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SMALL), "test")
        n = docs.count()
        assert n <= rows and (n == rows) == (name == "sentencepiece") or name in ("toxicity", "decontamination")
        assert docs.columns[:len(columns)] == columns
        rows = n
    assert docs.filter("not round_trip or not parity").isEmpty() and rows > 50


def test_queries_are_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(E.oracle_sql()) <= set(names)
