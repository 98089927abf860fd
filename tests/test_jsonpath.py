"""X1/X2 on documents whose values at each path are given."""

import pytest
from pyspark.sql import functions as F

from sitesift.functions.jsonpath import json_path_text
from sitesift.operators.extract_json import extract_json
from sitesift.sources.site_schema import load_site_schema

DOCS = [
    '{"a": {"b": [{"c": 1}, {"c": "x y"}], "s": {"0": "zero"}}, "t": true, "n": null}',
    '[10, 20, {"c": 3}]',
    '{"a": {"b": "not a list"}}',
    '{bad json',
    '{"a": {"b": [[1, 2], [3, 4]]}}',
]
PATHS = ["a.b.0.c", "a.b.1.c", "a.b.-1.c", "a.b.5.c", "a.s.0", "t", "n", "missing", "0", "-1.c",
         "a.b.1.0", "a.b.-1.-1", "a.b", "a"]


# What each document gives; every path that is not listed is missing.
FOUND = [
    {"a.b.0.c": "1", "a.b.1.c": "x y", "a.b.-1.c": "x y", "a.s.0": "zero", "t": "true",
     "a.b": '[{"c":1},{"c":"x y"}]', "a": '{"b":[{"c":1},{"c":"x y"}],"s":{"0":"zero"}}'},
    {"0": "10", "-1.c": "3"},
    {"a.b": "not a list", "a": '{"b":"not a list"}'},
    {},
    {"a.b.1.0": "3", "a.b.-1.-1": "4", "a.b": "[[1,2],[3,4]]", "a": '{"b":[[1,2],[3,4]]}'},
]


def test_dot_paths(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "i int, p string")
    v = F.call_function("try_parse_json", F.col("p"))
    rows = df.select("i", *[json_path_text(v, p).alias(f"c{k}") for k, p in enumerate(PATHS)]).collect()
    for r in rows:
        for k, p in enumerate(PATHS):
            assert r[f"c{k}"] == FOUND[r["i"]].get(p, "N/A"), (DOCS[r["i"]], p)


def test_numbers_are_written_out(spark):
    df = spark.createDataFrame([('{"a": 1e7, "b": 12345678.9, "c": 2.5e-4, "d": "1.0E7", "e": -3e10, "f": 5}',)], "p string")
    v = F.call_function("try_parse_json", F.col("p"))
    got = df.select(*[json_path_text(v, k).alias(k) for k in "abcdef"]).first()
    assert tuple(got) == ("10000000.0", "12345678.9", "0.00025", "1.0E7", "-30000000000.0", "5")


def test_json_records_wrap_rules(spark):
    pages = spark.createDataFrame([
        (1, "u1", '{"d": {"items": [{"title": "3 Apples", "p": " 1.5 "}, {"title": "1984"}]}}'),
        (2, "u2", '{"d": {"items": {"title": "single"}}}'),
        (3, "u3", '{"d": {"items": null}}'),
        (4, "u4", '{"d": {"items": 0}}'),
        (5, "u5", '{"d": {"items": []}}'),
        (6, "u6", '{broken'),
        (7, "u7", '[{"title": "top list"}]'),
    ], "page_id long, url string, html string").withColumn("domain", F.lit("x"))
    cfg = load_site_schema({"x": {"strategy": "json", "container": "d.items",
                                  "fields": {"title": "title", "price": "p"}}})
    got = sorted(tuple(r) for r in extract_json(pages, cfg).select("page_id", "ordinal", "title", "price").collect())
    assert got == [(1, 0, "Apples", "1.5"), (1, 1, "N/A", "N/A"), (2, 0, "single", "N/A")]
    top = load_site_schema({"x": {"strategy": "json", "container": "", "fields": {"title": "title"}}})
    got = [tuple(r) for r in extract_json(pages.filter("page_id = 7"), top).select("page_id", "title").collect()]
    assert got == [(7, "top list")]
