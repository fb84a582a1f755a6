"""The element table against a tolerant tree, its derived rows against hand-written pages."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell import queries
from inkwell.operators import elements as E
from inkwell.parsers import html as H

PAGE = """<!doctype html><html><head><title>A &amp; B</title></head><body><h1>He &eacute;&#233;&#x1F600; <b>llo</h1><p>one<p>two
<a href='x y' HREF=no title="a > b">li&nbsp;nk</a><br>x<ul><li>a<ol start=3><li>b<li>c<ul><li>d</ul></ol> tail<li>e</ul>
<table><tr><td colspan=2>1<td>*2*<tr><th>3<th colspan=x>4</table><script>var a="<h2>x</h2>"</script>
<a href=https://u:p@Ex.com/a%20b/c+d?q=1#f>https://ex.com</a><a href="http://a.b/">http://a.b</a><a href="javascript:x">no</a><pre><a href=q>in</a></pre><a href=e></a><h3></h3>"""


def of(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "doc_id long, html string").repartition(2)


def test_rows_of_a_page(spark):
    found = E.elements(of(spark, PAGE))
    assert [(r.level, r.text, r.markdown) for r in E.headings(found).orderBy("elem_no").collect()] == [(1, "He éé😀 llo", "# He éé😀 llo"), (3, "", "###")]
    shown = [r.markdown for r in E.links(found).orderBy("elem_no").collect()]
    assert shown == ['[li\xa0nk](x y "a > b")', "[https://ex.com](https://ex.com/a%20b/c%2Bd?q=1#f)", "<http://a.b>", "no", "in", ""]
    assert [r.line for r in E.list_items(found).orderBy("elem_no").collect()] == ["* a tail", "  3. b", "  4. c", "     * d", "* e"]
    assert [tuple(r)[2:] for r in E.table_cells(found).orderBy("row", "col").collect()] == [(0, 0, 2, False, "1"), (0, 2, 1, False, "*2*"), (1, 0, 1, True, "3"), (1, 1, 1, True, "4")]
    assert [r.markdown for r in E.tables(found).collect()] == ["|  |  |  |\n| --- | --- | --- |\n| 1 | | \\*2\\* |\n| 3 | 4 |"]


def test_tables(spark):
    pages = ["<table></table>", "<table><caption>c</caption><tr><td>a</table>", "<table><thead><tr><th>h</thead><tbody><tr><td><table><tr><td>in</table></tbody></table>", "<table><caption>c<tbody><tr><td>x</table>"]
    got = [(r.doc_id, r.markdown) for r in E.tables(E.elements(of(spark, *pages))).orderBy("doc_id", "table_no").collect()]
    assert got[:2] == [(0, "|\n|  |"), (1, "|  |\n| --- |\n| a |")]
    assert got[2:4] == [(2, "| h |\n| --- |\n| in |"), (2, "|  |\n| --- |\n| in |")]
    assert got[4] == (3, "| x |\n| --- |")  # its body isn't the first thing in it


def test_odd_pages(spark):
    deep = "<i>" * 300 + "end"
    pages = [None, "", "plain & text", "</p><b>x" * 3, deep, "<p a=1 a=2>&unknown; &#0; &#x80; &#99999999;<", "<!-- <p> --><!x><title>t", "<p>" + "<b>w</b> " * 3000]
    found = E.elements(of(spark, *pages))
    tags = {d: [(r.tag, r.text) for r in found.where(F.col("doc_id") == d).orderBy("elem_no").collect()] for d in range(len(pages))}
    assert tags[0] == tags[1] == tags[2] == []
    assert tags[3] == [("b", "x x x"), ("b", "x x"), ("b", "x")]
    assert len(tags[4]) == 300 and tags[4][0] == ("i", "end") and tags[4][-1] == ("i", "")
    assert tags[5] == [("p", "&unknown; \ufffd € \ufffd<")]
    assert tags[6] == [("title", "t")]
    assert len(tags[7]) == 3001 and tags[7][0] == ("p", " ".join(["w"] * 3000))
    assert found.where("doc_id = 5").first().attrs == {"a": "1"}
    assert E.elements(of(spark, "<p>x").where("false")).collect() == []
    clash = of(spark, "<p>x").selectExpr("doc_id", "html", "1 as toks", "'y' as text", "2 as lists")
    assert [(r.tag, r.text) for r in E.elements(clash).collect()] == [("p", "x")]


def test_roots(spark):
    pages = ["<html><head></head><body><p>x</p></body></html>", "<html><body>a<html><body><p>inner</p></body></html></body></html>", "<html><body></body></html>", "<p>bare</p>", "<div></div><p>"]
    got = {r.doc_id: (r.tag, r.elem_no) for r in E.content_roots(E.elements(of(spark, *pages))).collect()}
    assert got == {0: ("body", 3), 1: ("body", 4), 2: ("html", 0), 3: ("p", 0), 4: ("div", 0)}


def random_page(i):
    r = random.Random(i)
    tags = ["p", "b", "ul", "ol", "li", "table", "tr", "td", "th", "div", "a", "h2", "br", "tbody"]
    return "".join(r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", "w%d " % r.randint(0, 9), f"<{r.choice(tags)} x='1'>"]) for _ in range(r.randint(0, 60)))


@pytest.mark.parametrize("start", [0, 150])
def test_nesting_against_a_tree(spark, start):
    """Tags, ancestors and texts of random tag soup as the tree of the converter has them."""
    pages = [random_page(i) for i in range(start, start + 150)]
    got = {}
    for r in E.elements(of(spark, *pages)).orderBy("doc_id", "elem_no").collect():
        got.setdefault(r.doc_id, []).append((r.tag, [x.tag for x in r.path]))
    for i, page in enumerate(pages):
        want = []
        for node in H.parse(page).walk():
            if node.tag in ("head", "body"):
                continue
            path, up = [], node.parent
            while up is not None and up.tag not in ("html", "body", "head"):
                path.insert(0, up.tag)
                up = up.parent
            want.append((node.tag, path))
        empty = [("p", path) for tag, path in want if tag == "p"]
        own = got.get(i, [])
        if own != want:  # the tree makes an empty paragraph of an end tag without a start
            assert len(want) >= len(own) and [x for x in own if x not in empty] == [x for x in want if x not in empty], page


def test_titles_cut_inside_a_reference(spark, tmp_path):
    """HTML reads a reference without its semicolon; the queries show what their SQL reads."""
    assert [r.text for r in E.headings(E.elements(of(spark, "<h1>a &amp</h1>"))).collect()] == ["a &"]
    page = "<html><head><title>{0}</title></head><body><h1>{0}</h1><article><p>x</p></article><footer>{0}</footer></body></html>"
    cut = ["x &amp; y &amp", "x &am", "x&lt", "x &ndash; &#39; &copy; &copy", "&", "a &amp;lt; b"]
    spark.createDataFrame([(i, f"https://a.b/{i}", page.format(t)) for i, t in enumerate(cut)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.doc_id: r.title for r in queries.QUERIES["src_html"](spark, str(tmp_path)).collect()} == dict(enumerate(cut))
    read = ["x & y &amp", "x &am", "x&lt", "x &ndash; ' © &copy", "&", "a &lt; b"]
    got = {(r.doc_id, r.level): r.text for r in queries.QUERIES["md_heading"](spark, str(tmp_path)).collect()}
    assert got == {(i, k): "" if k == 6 else t for i, t in enumerate(read) for k in (1, 3, 6)}


def test_tables_read_elements_once(spark):
    """A join would cut and fold the pages anew for each of its sides."""
    plan = E.tables(E.elements(of(spark, PAGE)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1
