"""Payloads that can't be read, and the routed stream through failures."""

import hashlib
import os

import pytest

from sitesift.operators.extract_json import extract_json
from sitesift.operators.quality import good_records, quality_rows
from sitesift.operators.route import extract_records
from sitesift.session import ship_package
from sitesift.sources import master_log as L
from sitesift.sources.site_schema import load_site_schema
from sitesift.streaming.ingest import stream_routed

SITES = {"api": {"strategy": "json", "container": "list", "fields": {"t": "t"}},
         "feed": {"strategy": "rss", "container": "item", "fields": {"title": "title"}},
         "html": {"strategy": "detail", "container": "article", "fields": {"title": "h1"}}}
FEED = "<rss><channel><item><title>{}</title></item><item><title>more</title></item></channel></rss>"
PAGES = [(1, "http://api/1", '{"list":[{"t":"a"},{"t":"b"}]}'), (2, "http://api/2", '{"list":'), (3, "http://api/3", '{"list":1,"list":2}'),
         (4, "http://api/4", None), (5, "http://api/5", "\n\t "), (6, "http://api/6", '{"list":[]}'), (7, "http://feed/1", FEED.format("x")),
         (8, "http://feed/2", FEED.format("y")[:-16]), (9, "http://feed/3", ""), (10, "http://html/1", "<article><h1>h</h1></article>"),
         (11, "http://html/2", None), (12, "http://html/3", "<p>none</p>"), (13, "http://api/7", '{"list":[{"t":"' + "x" * 300 + '"}]}')]
KIND = "page_id long, url string, html string"
WANT = {(2, "unparsable"), (3, "duplicate_key"), (4, "missing"), (5, "missing"), (8, "malformed_feed"), (9, "missing"), (11, "missing")}


def test_reasons_and_records_of_one_pass(spark):
    ship_package(spark)
    sites, pages = load_site_schema(SITES), spark.createDataFrame(PAGES, KIND)
    rows = extract_records(pages, sites, quality=True)
    bad = quality_rows(rows).collect()
    assert {(r.page_id, r.reason) for r in bad} == WANT and len(bad) == len(WANT)
    for r in bad:
        body = dict((p, b) for p, _, b in PAGES)[r.page_id]
        assert r.body_bytes == (None if body is None else len(body.encode()))
        assert r.body_sha256 == (None if body is None else hashlib.sha256(body.encode()).hexdigest())
    plain = extract_records(pages.filter("html is not null"), sites)
    good = good_records(rows)
    assert sorted(good.columns) == sorted(plain.columns)
    order = sorted(plain.columns)
    assert sorted(map(str, good.select(order).collect())) == sorted(map(str, plain.select(order).collect()))


def test_oversize_is_not_parsed(spark):
    pages = spark.createDataFrame([(*p, "api") for p in PAGES if "api" in p[1]], KIND + ", domain string")
    rows = extract_json(pages, load_site_schema(SITES), quality=True, max_bytes=200).collect()
    assert {(r.page_id, r.reason) for r in rows if r.page_id == 13} == {(13, "oversize")}
    assert extract_json(pages.limit(0), load_site_schema(SITES), quality=True).count() == 0


@pytest.mark.parametrize("dies_at", [1, 2, 3])
def test_a_replayed_epoch_changes_only_what_it_had_not(spark, tmp_out, monkeypatch, dies_at):
    ship_package(spark)
    source, roots = os.path.join(tmp_out, "in"), {t: os.path.join(tmp_out, t) for t in ("master", "quality", "metrics")}
    for part in (PAGES[:7], PAGES[7:]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
    args = (spark, source, roots, os.path.join(tmp_out, "ckpt"), load_site_schema(SITES), ["domain", "source_url", "ordinal"])
    merge, calls = L.merge, []

    def dying(*a, **k):
        calls.append(1)
        if len(calls) == dies_at:
            raise RuntimeError("killed between two sinks")
        return merge(*a, **k)

    monkeypatch.setattr(L, "merge", dying)
    with pytest.raises(Exception, match="killed"):
        stream_routed(*args)
    monkeypatch.setattr(L, "merge", merge)
    stream_routed(*args)
    master = L.read(spark, roots["master"], ["domain", "source_url", "ordinal"], "page_id")
    assert {(r.page_id, r.ordinal) for r in master.collect()} == {(1, 0), (1, 1), (7, 0), (7, 1), (8, 0), (8, 1), (10, 0), (13, 0)}
    failed = L.read(spark, roots["quality"], ["domain", "page_id", "reason"], "page_id").collect()
    assert {(r.page_id, r.reason) for r in failed} == WANT and len(failed) == len(WANT)
    metrics = L.read(spark, roots["metrics"], ["domain", "epoch"], "epoch").collect()
    assert sum(r.n_records for r in metrics) == 8 and sum(r.n_failed for r in metrics) == len(WANT)
    assert {t: L.state(spark, r)["version"] for t, r in roots.items()} == dict.fromkeys(roots, 2)      # two epochs, each once
