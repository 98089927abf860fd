"""The crawl run over landed pages vs the crawl loop in plain Python."""

import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from sitesift import fixtures as fx
from sitesift.plans.run import run_crawl


def test_run_crawl_matches_loop(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url", "html")
    rows = sorted((r.url.split("//")[-1].split("/")[0], r.page_id, r.url) for r in pages.collect())
    rnd = random.Random(5)
    frontier, by_target = [], {}
    for host, _, url in rows:
        by_target.setdefault(host, []).append(url)
    plan = {}
    for host, urls in by_target.items():
        seq, n = [], 0
        for url in urls:
            # 0-6 pages that never landed before each landed page
            for _ in range(rnd.choice([0, 0, 1, 3, 6])):
                n += 1
                seq.append((n, f"https://missing.example/{host}/{n}", False))
            n += 1
            seq.append((n, url, True))
        plan[host] = seq
        frontier += [(host, p, u) for p, u, _ in seq]
    limit = 2

    def loop(seq):  # one record per landed page
        kept, empty = [], 0
        for p, _, landed in seq:
            if len(kept) >= limit:
                break
            if not landed:
                empty += 1
                if empty >= 5:
                    break
            else:
                empty = 0
                kept.append(p)
        return kept

    want = {(h, p) for h, seq in plan.items() for p in loop(seq)}
    fr = spark.createDataFrame(frontier, "target string, page_no int, page_url string")
    landed = pages.select(F.col("url").alias("page_url"), "html",
                          F.expr("timestampadd(MINUTE, page_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
                          .alias("fetched_at"))
    index_site = {"example": {**fx.ARTICLE_TEXT_SITE["example"], "strategy": "index"}}
    res = run_crawl(fr, landed, fx.sites(index_site), limit)
    got = {(r.target, r.page_no) for r in res.records.collect()}
    assert got == want
    assert res.records.filter(F.col("scraped_at").isNull()).count() == 0
    assert {"keywords", "anomalies_and_gaps"} <= set(res.brief)


def test_detail_sites_follow_listing_links(spark):
    from sitesift.sources.site_schema import load_site_schema
    site = {"shop.test": {"strategy": "detail", "container": "div.grid",
                          "fields": {"title": "h1", "price": "span.p"}}}

    def listing(*items):
        links = "".join(f'<a href="/item/{i}">{i}</a>' for i in items)
        return f'<body><div class="grid">{links}</div><a href="/item/99">outside</a></body>'

    def item(i):
        return f'<body><div class="grid"><h1>{i} Item {i}</h1><span class="p">${i}.00</span></div></body>'

    landed = [("https://shop.test/list/1", listing(1, 2)), ("https://shop.test/list/2", listing(7)),
              ("https://shop.test/list/3", listing(3)), ("https://shop.test/item/99", item(99))]
    landed += [(f"https://shop.test/item/{i}", item(i)) for i in (1, 2, 3)]
    frontier = [("shop", p, f"https://shop.test/list/{p}") for p in (1, 2, 3)]
    lf = spark.createDataFrame(landed, "page_url string, html string")
    fr = spark.createDataFrame(frontier, "target string, page_no int, page_url string")
    res = run_crawl(fr, lf, load_site_schema(site), 10, fetched_col=None)
    got = sorted((r.page_no, r.source_url, r.title, r.price) for r in res.records.collect())
    assert got == [(1, "https://shop.test/item/1", "Item 1", "$1.00"), (1, "https://shop.test/item/2", "Item 2", "$2.00"),
                   (3, "https://shop.test/item/3", "Item 3", "$3.00")]
    capped = run_crawl(fr, lf, load_site_schema(site), 2, fetched_col=None).records
    assert sorted(r.source_url for r in capped.collect()) == ["https://shop.test/item/1", "https://shop.test/item/2"]


def test_newest_copy_counts_and_no_body_is_shuffled(spark):
    import datetime as dt
    from sitesift.plans.run import crawl_records
    from sitesift.sources.site_schema import load_site_schema
    cfgs = load_site_schema({"a.com": {"strategy": "index", "container": "p", "fields": {"title": ""}}})
    day = [dt.datetime(2024, 1, d) for d in range(1, 4)]
    landed = [("https://a.com/1", "<p>old</p>", day[0]), ("https://a.com/1", "<p>new</p><p>two</p>", day[1]),
              ("https://a.com/1", "<p>new</p><p>two</p>", day[1]), ("https://a.com/9", "<p>off</p>", day[2])]
    lf = spark.createDataFrame(landed, "page_url string, html string, fetched_at timestamp")
    fr = spark.createDataFrame([("a", 1, "https://a.com/1"), ("a", 2, "https://a.com/2")], "target string, page_no int, page_url string")
    out = crawl_records(fr, lf, cfgs, 500)
    assert sorted((r.page_no, r.ordinal, r.title, r.scraped_at) for r in out.collect()) == [(1, 0, "new", day[1]), (1, 1, "two", day[1])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("_html" in line for line in plan.splitlines() if "Join" in line or "Aggregate" in line)
