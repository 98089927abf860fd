"""V1-V3 and T1/T2 on handmade rows, compared with the reference rules in Python."""

import re

from sitesift.functions import text as tx
from sitesift.operators import validate as V

RECS = [("ok", "l", "c"), ("", "l", None), ("N/A", None, None), ("  ", None, "co"), (None, "", ""),
        ("N/A", "N/A", None)]


def test_soft_validate(spark):
    df = spark.createDataFrame(RECS, "title string, link string, company string")
    key = lambda x: tuple("" if v is None else v for v in x)
    got = sorted(((r.title, r.link, r.company) for r in V.soft_validate(df, "title").collect()), key=key)
    want = []
    for t, l, c in RECS:
        bad = t is None or t.strip() in ("", "N/A")
        if bad and not (l or c):
            continue
        want.append(("N/A - Pending Review" if bad else t, l, c))
    assert got == sorted(want, key=key)


def test_soft_validate_intent_mode(spark):
    df = spark.createDataFrame([("N/A", "N/A", None)], "title string, link string, company string")
    assert V.soft_validate(df, "title", na_is_fallback=False).count() == 0
    assert V.soft_validate(df, "title", na_is_fallback=True).count() == 1


def test_required_keys(spark):
    df = spark.createDataFrame([("a", "b"), ("a", " none "), ("n/a", "b"), (None, "b"), ("a", "")],
                               "x string, y string")
    assert [tuple(r) for r in V.required_keys(df, ["x", "y"]).collect()] == [("a", "b")]
    assert V.required_keys(df, []).count() == 5
    assert V.required_keys(df, ["nope"]).count() == 0


def py_money(s):
    digits = re.sub(r"[^\d.]", "", str(s)).strip()
    try:
        return float(digits)
    except ValueError:
        return None


def test_money_matches_python(spark):
    vals = ["£51.77", "$1,234.50", "5.", ".5", "1.2.3", ".", "", "N/A", "-5", "1.234,50", "1e20", None]
    df = spark.createDataFrame([(v,) for v in vals], "p string")
    got = [tuple(r) for r in df.select(tx.money_report("p"), tx.money_silver("p")).collect()]
    for v, (rep, sil) in zip(vals, got):
        want = py_money(v) if v is not None else None
        assert rep == want, v
        assert sil == (want if want is not None else 0.0), v


def test_text_normalise_and_title(spark):
    df = spark.createDataFrame([("  12.5  Big  deal \n",), ("1984",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.clean_field("title", "t")).collect()]
    assert got == ["Big deal", "N/A", "N/A", "N/A"]
    got = [r[0] for r in df.select(tx.clean_field("text", "t")).collect()]
    assert got == ["12.5 Big deal", "1984", "N/A", "N/A"]


def test_soft_validate_missing_key_column(spark):
    df = spark.createDataFrame([("l", None), (None, None)], "link string, company string")
    out = V.soft_validate(df, "title").collect()
    assert [(r.title, r.link) for r in out] == [("N/A - Pending Review", "l")]


def test_metrics_count_a_missing_required_column(spark):
    from sitesift.operators.validate import required_keys, validation_metrics
    df = spark.createDataFrame([("a", "t1"), ("a", "t2")], "g string, title string")
    row = validation_metrics(df, "title", ["company"], ["g"]).first()
    assert row.n_key_failed == 2 and required_keys(df, ["company"]).count() == 0
