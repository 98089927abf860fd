"""Handmade HTML inputs for the parser + selector helper (FIXTURES.md section 3)."""

from conftest import html_records
from sitesift.operators import html_tree as H
from sitesift.operators.extract_html import links_from_html
from sitesift.sources.site_schema import load_site_schema


def cfg(container, fields, strategy="detail"):
    return load_site_schema({"x": {"strategy": strategy, "container": container, "fields": fields}})[0]


PAGE = """<html><head><title> T &amp; T </title><script>var s = "</p><div class='c'>";</script>
<style>.c{}</style></head><body>
<!-- <div class="c">comment</div> -->
<div class="c other" id="one" data-x="abc"><h2>1984</h2><p>Hello <b>World</b></p><a href="/a?x=1">A</a></div>
<div class="c"><p>Second<br>line</div>
<section><span class="price">£1,234.50</span><p>unclosed <p>next</section>
</body></html>"""


def test_first_matching_container_part_vs_union(spark):
    c_static = cfg("section, div.c", {"p": "p"})
    # static: first comma part that matches anything -> only the section
    assert [r[0] for r in html_records(spark, PAGE, "http://h/", c_static, "static")] == ["unclosednext"]
    c_dom = cfg("section, div.c", {"p": "p"}, "index")
    # dom: union of all parts in document order (two divs, then the section)
    assert len(html_records(spark, PAGE, "http://h/", c_dom, "dom")) == 3


def test_text_modes_nested_tags(spark):
    c = cfg("div#one", {"text": "p"})
    assert html_records(spark, PAGE, "u", c, "static") == [["HelloWorld"]]
    assert html_records(spark, PAGE, "u", c, "dom") == [["Hello World"]]


def test_attribute_on_container_itself_and_missing(spark):
    c = cfg("div#one", {"x": {"attribute": "data-x"}, "missing": "span.none",
                        "miss_attr": {"selector": "h2", "attribute": "href"}})
    assert html_records(spark, PAGE, "u", c, "static") == [["abc", "N/A", "N/A"]]


def test_multi_valued_class_and_title_number(spark):
    c = cfg("div.other", {"title": "h2", "heading": "h2"})
    # title fields lose a leading number: "1984" becomes empty -> N/A
    assert html_records(spark, PAGE, "u", c, "static") == [["N/A", "1984"]]


def test_href_as_written_vs_absolute(spark):
    c = cfg("div#one", {"link": {"selector": "a", "attribute": "href"}})
    assert html_records(spark, PAGE, "http://h/dir/p", c, "static") == [["/a?x=1"]]
    c2 = cfg("div#one", {"link": {"selector": "a", "attribute": "href"}}, "index")
    assert html_records(spark, PAGE, "http://h/dir/p", c2, "dom") == [["http://h/a?x=1"]]


def test_void_unclosed_comment_script_entities():
    root = H.parse(PAGE, "static")
    # the comment does not create an element, the script text is not markup
    assert len(H.select(root, "div.c")) == 2
    assert H.static_text(H.select_one(root, "title")) == "T & T"
    # static: unclosed <p> nests; dom: a new <p> closes the open one
    assert len(H.select(H.parse(PAGE, "static"), "section p p")) == 1
    assert len(H.select(H.parse(PAGE, "dom"), "section p p")) == 0
    # br is void: text after it stays in the same p
    assert H.static_text(H.select(root, "div.c")[1]) == "Secondline"


def test_selector_forms():
    root = H.parse(PAGE, "static")
    assert H.select_one(root, "[data-x]").attrs["id"] == "one"
    assert H.select_one(root, "div[data-x=abc]") is not None
    assert H.select_one(root, "div[data-x*=b]") is not None
    assert H.select_one(root, "div[data-x^=ab]") is not None
    assert H.select_one(root, "div[data-x$=bc]") is not None
    assert H.select_one(root, "span[class*='pri']").attrs["class"] == "price"
    assert len(H.select(root, "body > div")) == 2
    assert len(H.select(root, "div > p")) == 2
    assert H.select(root, "*") and H.select_one(root, "#one").tag == "div"


def test_links_distinct_absolute():
    html = '<body><a href="/x">1</a><a href="/x">2</a><a href="y">3</a><a>no</a></body>'
    assert links_from_html(html, "http://h/d/p?q=1", "body") == ["http://h/x", "http://h/d/y"]


def test_broken_markup_does_not_raise():
    for bad in ["", None, "<div", "</p></p><p", "<a href='x'>&bogus; &#xZZ;</a>"]:
        H.parse(bad, "static")
        H.parse(bad, "dom")


def test_repeated_attribute_per_mode():
    html = '<div id="a" id="b">x</div>'
    assert H.select_one(H.parse(html, "static"), "div").attrs["id"] == "b"
    assert H.select_one(H.parse(html, "dom"), "div").attrs["id"] == "a"


def test_entity_references_per_mode():
    html = "<h1>a &amp; b &amp</h1><p>x &foo; y &#128; &ampz &lt3</p>"
    static = [H.static_text(n) for n in H.select(H.parse(html, "static"), "h1, p")]
    dom = [H.dom_text(n) for n in H.select(H.parse(html, "dom"), "h1, p")]
    # known names decode with or without ';'; unknown names stay (lenient parser)
    assert static == ["a & b &", "x &foo y € &ampz &lt3"]
    # a browser also decodes legacy names that run into letters or digits
    assert dom == ["a & b &", "x &foo; y € &z <3"]


def test_native_entity_decoder(spark):
    from sitesift.functions.text import decode_entities
    df = spark.createDataFrame([("a &amp; b &amp",), ("&copy 2024 &middot;x &ampz",)], "t string")
    assert [r[0] for r in df.select(decode_entities("t")).collect()] == ["a & b &", "© 2024 ·x &ampz"]


def test_bad_selectors_fail_when_the_schema_is_loaded():
    import pytest
    with pytest.raises(ValueError, match="x: unsupported"):
        load_site_schema({"x": {"fields": {"t": "p:first-child"}}})
    load_site_schema({"x": {"strategy": "rss", "container": "item", "fields": {"t": "dc:creator"}}})
