"""Converters on files built here, and the assertions that the formats' descriptions ask for."""

import json

import pytest

from inkwell import providers as P
from inkwell import writers as W
from inkwell.operators.routing import Registry, Route
from inkwell.parsers import charset as C
from inkwell.parsers import compound, html, office, omml, package, pdf, sheets, textual
from inkwell.parsers.xmltree import parse_xml
from inkwell.api import convert_file
from inkwell.plans.convert import Options

REGISTRY = Registry()


@pytest.fixture(autouse=True)
def _session(spark):
    """Single files are tables of one row: they need a session."""


def run(data, options=None, registry=REGISTRY, **info):
    return tuple(convert_file(data, info, options, registry))[1:]


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<p>bare", "bare"),
        ("<input type=checkbox checked> done", "[x]  done"),
        ('<img src="data:image/png;base64,AAAA" alt=x>', "![x](data:image/png;base64...)"),
        ('<a href="javascript:alert(1)">go</a>', "go"),
        ("<table><tr><td>1</td><td>2</td></tr></table>", "|  |  |\n| --- | --- |\n| 1 | 2 |"),
        ("<table><tr><td colspan=3>H</td></tr><tr><td>Body</td></tr></table>", "|  |  |  |\n| --- | --- | --- |\n| H | | |\n| Body |"),
        ('<a href="#purpose">1. Purpose</a>', "[1. Purpose](#purpose)"),
        ('<a href="https://example.com">https://example.com</a>', "<https://example.com>"),
        ('<a href="https://e.org/foo%20bar">x</a>', "[x](https://e.org/foo%20bar)"),
        (r"<p>$$\frac{1}{2}$$</p>", r"$$\frac{1}{2}$$"),
        ("<ul><li>a<ul><li>b</li></ul></li></ul>", "* a\n  + b"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<pre><code class='language-py'>a\n b</code></pre>", "```py\na\n b\n```"),
        ("<blockquote>q</blockquote><hr>", "> q\n\n* * *"),
        ("<b>bold </b>x <i>it</i> <code>a`b</code>", "**bold** x *it* ``a`b``"),
        ("<table></table>", "|\n|  |"),
        ("<script>x</script><style>y</style>z", "z"),
    ],
)
def test_html(page, wanted):
    assert html.page(page)[0] == wanted


def test_html_keeps_data_uris_and_survives_depth():
    assert html.page('<img src="data:image/png;base64,AAAA">', keep_data_uris=True)[0] == "![](data:image/png;base64,AAAA)"
    assert html.page("<div><b>" * 3000 + "deep")[0].strip("*") == "deep"
    assert html.page("<title> T </title><h1>H</h1>") == ("# H", "T")


def test_charsets():
    assert C.detect(b"\xef\xbb\xbfabc") == "utf-8" and C.decode(b"\xef\xbb\xbfabc") == "abc"
    assert C.detect("你好 world".encode()) == "utf-8"
    assert (C.detect(bytes.fromhex("C4E3BAC3")), C.decode(bytes.fromhex("C4E3BAC3CAC0BDE7"))) == ("gb18030", "你好世界")
    assert (C.detect(bytes.fromhex("82A082A282A4")), C.decode(bytes.fromhex("82A082A282A4"))) == ("shift_jis", "あいう")
    assert C.decode(b"caf\xe9 \x81", "latin1") == "café \x81"
    assert C.detect(b"\x80\x81", lambda sample: ("Windows-1252", 0.95)) == "windows-1252" and C.label("GBK", 0.5) is None and C.label("gb2312") == "gb18030"
    assert C.detect(("a" * 4095 + "é" * 10).encode()) == "utf-8"  # the sample cuts a character


def test_csv_and_text():
    out = run("名前,年齢,住所\n佐藤太郎,30,東京\n髙橋淳,35,名古屋\n".encode("cp932"), extension=".csv", charset="cp932")
    assert "| 佐藤太郎 | 30 | 東京 |" in out[0] and "| 髙橋淳 | 35 | 名古屋 |" in out[0]
    assert textual.csv_rows('a,"b ""x""\ny"\r\n\n1') == [["a", 'b "x"\ny'], [""], ["1"]]
    assert textual.csv_markdown("") == ""
    assert run(bytes.fromhex("C4E3BAC3CAC0BDE7"), extension=".txt", mimetype="text/plain")[:3] == ("你好世界", None, "text")


def test_notebook_and_fallback():
    book = {"nbformat": 4, "nbformat_minor": 5, "metadata": {}, "cells": [{"cell_type": "markdown", "source": ["# Title\n", "x"]}, {"cell_type": "code", "source": "1", "outputs": []}, {"cell_type": "raw", "source": "r"}]}
    assert run(json.dumps(book).encode(), extension=".ipynb")[:3] == ("# Title\nx\n\n```python\n1\n```\n\n```\nr\n```", "Title", "ipynb")
    out = run(b"{broken", extension=".ipynb", mimetype="application/json")
    assert out[2:4] == ("text", "ok") and out[4][0]["converter"] == "ipynb"
    assert run(b'{"a": 1}', mimetype="application/json")[2:] == ("text", "ok", [])
    assert run(b"\0\1", extension=".bin")[3] == "unsupported"
    assert run(b"no zip", extension=".docx")[3] == "failed"


def test_feeds():
    atom = '<feed><title>Test Feed</title><entry><title>Entry One</title><updated>now</updated><summary>&lt;p&gt;Hi&lt;/p&gt;</summary></entry></feed>'
    assert run(atom.encode(), extension=".xml")[:3] == ("# Test Feed\n\n## Entry One\nUpdated on: now\nHi", "Test Feed", "rss")
    rss = "<rss><channel><title>C</title><description>D</description><item><title>I</title><pubDate>p</pubDate><description>plain</description></item></channel></rss>"
    assert run(rss.encode(), extension=".rss")[0] == "# C\nD\n\n## I\nPublished on: p\nplain"
    assert run(b"<a/>", extension=".xml")[2] == "text"


def test_sites():
    wiki = "<title>x</title><span class=mw-page-title-main>Python</span><div id=mw-content-text><p>Body</p></div>"
    assert run(wiki.encode(), extension=".html", url="https://en.wikipedia.org/wiki/P")[:3] == ("# Python\n\nBody", "Python", "wikipedia")
    serp = '<div class=b_algo><a href="https://www.bing.com/ck/a?x">Hit</a><p>Said</p></div>'
    out = run(serp.encode(), extension=".html", url="https://www.bing.com/search?q=a+b")
    assert out[2] == "bing" and "/ck/a" not in out[0] and "'a b'" in out[0]
    video = '<title>V</title><meta property="og:description" content="D"><meta itemprop=duration content=PT1M>'
    given = Options(providers=P.Providers(transcript=lambda v, _: f"words of {v}"))
    out = run(video.encode(), given, extension=".html", url="https://www.youtube.com/watch?v=abc")
    assert out[2] == "youtube" and "## V" in out[0] and "**Runtime:** PT1M" in out[0] and out[0].endswith("### Transcript\nwords of abc")
    assert textual.find_key([{"a": {"k": None}}, {"b": [{"k": 1}]}], "k") == 1


def test_archives_and_books():
    inner = W.zip_bytes({"b.txt": "deep"})
    data = W.zip_bytes({"readme.txt": "hello", "broken.bin": b"\0\1\2", "A.csv": "x,y", "in.zip": inner})
    out = run(data, extension=".zip", filename="all.zip")
    assert out[0].startswith("Content from the zip file `all.zip`:\n\n## File: A.csv\n\n| x | y |") and "broken" not in out[0] and "deep" in out[0]
    book = W.epub_bytes({"title": "T", "creator": "A", "language": "en"}, ["<h1>One</h1><p>x</p>", "<p>two</p>"])
    assert run(book, extension=".epub")[:2] == ("**Title:** T\n**Authors:** A\n**Language:** en\n\n# One\n\nx\n\ntwo", "T")
    assert [x for x in run(W.zip_bytes({"b.txt": "1", "A.txt": "2", "a.txt": "3", "_.txt": "4"}), extension=".zip")[0].split("\n") if x.startswith("##")] == [f"## File: {n}.txt" for n in "_aAb"]
    assert [n for n, _ in package.each(W.zip_bytes({"b": "", "A": ""}))] == ["b", "A"]


def test_workbooks():
    rows = [["Name", "Score", "Score"], ["Alice", 95, 1.5], ["Bob", 88, None], ["NA", 7, 2]]
    wanted = "## S\n| Name | Score | Score.1 |\n| --- | --- | --- |\n| Alice | 95 | 1.5 |\n| Bob | 88 | NaN |\n| NaN | 7 | 2.0 |"
    assert run(W.xlsx_bytes({"S": rows}), extension=".xlsx")[0] == wanted
    assert run(W.xls_bytes({"S": rows}), extension=".xls")[0] == wanted
    assert run(W.xlsx_bytes({"E": []}), extension=".xlsx")[0] == "## E\n|\n|  |"
    assert sheets.number_text(1.23456789) == "1.234568" and sheets.timestamp_text(45000.5) == "2023-03-15 12:00:00"


def test_slides():
    slides = [W.shape("Body\nline", None, 200) + W.shape("Head", "title", 100) + W.slide_table([["a", "b"], ["", ""], ["1", "2"]], 300), W.slide_chart("rId9")]
    data = W.pptx_bytes(slides, {1: "said"}, {2: W.chart_xml("Harvest", ["North", "South"], {"Pears": [31, 42], "Plums": [5]})})
    assert run(data, extension=".pptx")[0] == (
        "<!-- Slide number: 1 -->\n# Head\nBody\nline\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n### Notes:\nsaid\n\n"
        "<!-- Slide number: 2 -->\n\n### Chart: Harvest\n\n| Category | Pears | Plums |\n| --- | --- | --- |\n| North | 31 | 5 |\n| South | 42 |  |"
    )


FRACTION = "<m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f>"


def test_documents():
    body = W.paragraph("Head", "Heading1") + f"<w:p><w:r><w:t>in </w:t></w:r><m:oMath>{FRACTION}</m:oMath></w:p><m:oMathPara><m:oMath>{FRACTION}</m:oMath></m:oMathPara>"
    body += "<w:tbl><w:tr><w:tc>" + W.paragraph("c") + "</w:tc></w:tr></w:tbl><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>fat</w:t></w:r></w:p>"
    notes = '<w:footnotes xmlns:w="w"><w:footnote w:id="0"/><w:footnote w:id="2"><w:p><w:r><w:t>unseen</w:t></w:r></w:p></w:footnote></w:footnotes>'
    out = run(W.docx_bytes(body, styles='<w:styles xmlns:w="w"><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>', footnotes=notes), extension=".docx")
    assert out[0] == "# Head\n\nin $\\frac{1}{2}$\n\n$$\\frac{1}{2}$$\n\n|  |\n| --- |\n| c |\n\n**fat**\n\nunseen"


def math(xml):
    return omml.latex(parse_xml(f'<m:oMath xmlns:m="m">{xml}</m:oMath>').children[0])


def test_formulas():
    run_ = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
    assert math(FRACTION) == "\\frac{1}{2}"
    assert math(f"<m:sSup><m:e>{run_('𝑥')}</m:e><m:sup>{run_('2')}</m:sup></m:sSup>") == "x^{2}"
    assert math(f"<m:rad><m:deg>{run_('3')}</m:deg><m:e>{run_('𝛼')}</m:e></m:rad>") == "\\sqrt[3]{\\alpha }"
    assert math(f"<m:func><m:fName>{run_('sin')}</m:fName><m:e>{run_('y')}</m:e></m:func>") == "\\sin(y)"
    assert math(f'<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>{run_("i")}</m:sub><m:e>{run_("i")}</m:e></m:nary>') == "\\sum_{i}i"
    assert math(f'<m:d><m:dPr><m:begChr m:val="["/><m:endChr m:val=""/></m:dPr><m:e>{run_("a_b")}</m:e></m:d>') == "\\left[a\\_b\\right."
    assert math(f"<m:limLow><m:e>{run_('lim')}</m:e><m:lim>{run_('n→∞')}</m:lim></m:limLow>") == "\\lim_{n\\to \\infty }"
    assert math(f"<m:m><m:mr><m:e>{run_('a')}</m:e><m:e>{run_('b')}</m:e></m:mr></m:m>") == "\\begin{matrix}\\\\a&b\\end{matrix}"
    assert math(f"<m:acc><m:e>{run_('x')}</m:e></m:acc>") == "\\hat{x}"
    with pytest.raises(omml.Unsupported):
        math(f"<m:func><m:fName>{run_('foo')}</m:fName><m:e/></m:func>")
    assert omml.escape("a_b\\_c%") == "a\\_b\\_c\\%"


def test_mail():
    data = W.message_bytes("Subject", "from@x", ["to@y", "cc@z"], "Body\ntext")
    assert run(data)[:3] == ("# Email Message\n\n**From:** from@x\n**To:** to@y, cc@z\n**Subject:** Subject\n\n## Content\n\nBody\ntext", "Subject", "msg")
    assert run(data, extension=".xls")[3] == "failed"
    big = compound.Compound(W.compound_bytes({"big": b"x" * 70_000, "s": b"tiny"}))
    assert big.stream("big") == b"x" * 70_000 and big.stream("s") == b"tiny"


def test_pdf():
    data = W.pdf_bytes([[(50, 100, "Hello world"), (50, 112, "Next (line)")], [(50, 100, "two")]])
    assert run(data, extension=".pdf")[0] == "Hello world\nNext (line)\n\ntwo"
    assert [(w[1], round(w[2]), round(w[3])) for w in pdf.words(data)][:2] == [("Hello", 50, 80), ("world", 86, 116)]
    assert run(b"%PDF-1.4 /Encrypt 1 0 R", extension=".pdf")[3] == "failed"


def test_media_and_providers():
    given = Options(providers=P.Providers(metadata=lambda d, i: {"Title": "t", "Odd": "o", "ImageSize": "1x1"}, caption=lambda d, i: " seen ", transcribe=lambda d, i: "said"))
    assert run(b"x", given, extension=".png")[0] == "ImageSize: 1x1\nTitle: t\n\n# Description:\nseen"
    assert run(b"x", given, extension=".wav")[0] == "Title: t\n\n### Audio Transcript:\nsaid"
    assert P.caption_request(b"hi", {"extension": ".PNG"}, "m")["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,aGk="
    assert P.parse_wav(W.wav_bytes(b"\1\0\2\0" * 10, 8000, 2)) == (b"\1\0\2\0" * 10, 8000, 2)
    with pytest.raises(ValueError, match="Invalid WAV"):
        P.parse_wav(b"RIFF")
    assert P.speech_text('{"result":[]}\nbad\n{"result":[{"alternative":[{"transcript":" a "}]},{"alternative":[{"transcript":"b"}]}]}') == "a b"
    assert run(b"x", Options(providers=P.Providers(analyze=lambda d, i: "analyzed")), extension=".pdf")[0] == "analyzed"


def test_registry_order():
    own = Registry()
    own.register(Route("rtf", (".rtf",)), lambda data, info: (data.decode(), None))
    own.register(Route("later", (".rtf",)), lambda data, info: ("later", None))
    assert run(b"{\\rtf1 test}", registry=own, extension=".rtf")[:3] == ("later", None, "later")
    assert [r.name for r in Registry().ordered()][-3:] == ["html", "zip", "text"]
    assert office.docx(W.docx_bytes(W.paragraph("x")))[0] == "x"


def test_classifier_guesses():
    given = Options(providers=P.Providers(classify=lambda data: {"mimetype": "text/csv", "extensions": ["csv"], "charset": "utf-8"}))
    assert run(b"a,b", given)[2] == "csv"
    out = run(b"a,b", given, extension=".docx")
    assert out[2] == "csv" and out[4][0]["converter"] == "docx"
    assert run(b"a,b", Options(providers=P.Providers(classify=lambda data: None)), extension=".txt")[2] == "text"
