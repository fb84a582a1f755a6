"""The engine around the parsers: every query against its SQL on the smallest tables, sources, streams, plugins, command line."""

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from inkwell import cli, cloud, plugins, queries
from inkwell import writers as W
from inkwell.functions import text as T
from inkwell.operators import layout
from inkwell.operators.routing import Registry, Route
from inkwell.plans.convert import Options, convert, routed
from inkwell.providers import Providers
from inkwell.sources import files
from inkwell.streaming.files import convert_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    if name in queries.ORACLE_SQL:
        found = duck.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})")
        assert sorted(found.columns) == columns and sorted(repr(tuple(map(plain, r))) for r in found.fetchall()) == rows
    else:
        assert rows


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, "a \t\r\n\n\n\n　b﻿\n(#footnote-ref-1)\n\n1. n", T.normalize_markdown(x))[0] == "a\n\n　b\n(#footnote-ref-1)\n1. n"
    again = T.normalize_markdown(T.normalize_markdown(x))
    assert one(spark, " a \r\n\r\n\r\n\r\nb", (again == T.normalize_markdown(x)))[0]
    assert one(spark, "a   b  c", T.pair_spaces(x))[0] == "a\xa0\xa0 b\xa0\xa0c"
    assert one(spark, "DATA:text/html;charset=gbk,%C3%A9+", T.data_uri(x).data.cast("string"), T.data_uri(x).charset)[:] == ("é+", "gbk")
    assert one(spark, "data:;base64,aGk=", T.data_uri(x).mimetype, T.data_uri(x).data.cast("string"))[:] == ("text/plain", "hi")
    assert one(spark, "nothing", T.data_uri(x))[0] is None
    assert one(spark, "file:///C:/a%20b", T.file_uri_path(x))[0] == "C:/a b" and one(spark, "file://far/x", T.file_uri_path(x))[0] is None
    assert one(spark, "docu-\n  ment Docu-\nMent", T.merge_hyphenated(x))[0] == "document Docu-\nMent"
    assert one(spark, "title", T.capitalized(x), T.alt_text(F.lit("a[b]\n c")), T.picture_name(F.lit("Pic 1.é")))[:] == ("Title", "a b c", "Pic1.jpg")
    assert one(spark, "x", T.markdown_table(F.array(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("1"), F.lit("2")))))[0] == "| A | B |\n| --- | --- |\n| 1 | 2 |"
    assert one(spark, "x", T.fit_row(F.array(x), F.lit(3)), T.fit_row(F.array(x, x, x), F.lit(2)))[:] == (["x", "", ""], ["x", "x"])


def words(spark, rows, width=612.0):
    return spark.createDataFrame([(1, 0, t, float(a), float(a + 6 * len(t)), float(y), width) for t, a, y in rows], "doc_id long, page int, text string, x0 double, x1 double, top double, page_width double")


def test_layout(spark):
    table = [(t, x, y) for y, row in ((100, ("Item", "Qty", "Price")), (120, ("Bolt", "7", "1.5")), (140, ("Nut", "8", "2.5"))) for t, x in zip(row, (50, 200, 350))]
    assert layout.form_pages(words(spark, table)).first().text == "| Item | Qty | Price |\n| ---- | --- | ----- |\n| Bolt | 7   | 1.5   |\n| Nut  | 8   | 2.5   |"
    prose = [("Hello", 50, 100), ("world", 86, 100), ("Next", 50, 112), ("line", 86, 112)]
    assert layout.prose_pages(words(spark, prose)).first().text == "Hello world\nNext line"
    assert not layout.form_pages(words(spark, prose)).first().is_form
    letters = [(c, 40 + 90 * i, 100) for i, c in enumerate("ABCDEF")]
    assert not layout.form_pages(words(spark, letters)).first().is_form
    assert layout.form_pages(words(spark, [])).count() == 0
    texts = [[".1", "", "Title", "x", ".2"], [".1", ".2", "", ".3", "a"], ["", ".1", ".2", ".3"], [".7", " "], ["a", "", "b"], []]
    lines = spark.createDataFrame([(d, i, t) for d, text in enumerate(texts) for i, t in enumerate(text)], "doc_id long, n int, line string")
    joined = {}
    for r in layout.partial_numbers_joined(lines).orderBy("n").collect():
        joined.setdefault(r.doc_id, []).append(r.line)
    assert joined == {0: [".1 Title", "x", ".2"], 1: [".1 .2", "", ".3 a"], 2: ["", ".1 .2", ".3"], 3: [".7", " "], 4: ["a", "", "b"]}
    heads = [("Head", 60, 90), ("Right", 260, 90), *table]
    assert layout.form_pages(words(spark, heads)).first().text.startswith("Head  Right\n| Item |")


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2")
    (tmp_path / "in" / "b.zip").write_bytes(W.zip_bytes({"c.txt": "hello"}))
    (tmp_path / "in" / "big.txt").write_text("z" * 5000)
    small = files.from_folder(spark, str(tmp_path / "in"), most_bytes=1000)
    assert {r.converter for r in convert(small).collect()} == {"csv", "zip"}
    query = convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None
    out = {r.converter: r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(out) == {"csv", "zip", "text"} and out["csv"] == "| x | y |\n| --- | --- |\n| 1 | 2 |"
    urls = spark.createDataFrame([(1, "https://x.y/a.csv"), (2, "https://x.y/fail")], "id long, url string")

    def fetch(url):
        if url.endswith("fail"):
            raise OSError("no")
        return b"p,q", {"Content-Type": "text/csv; charset=utf-8"}

    got = {r.doc_id: r for r in convert(files.fetched(urls, "id", "url", fetch)).collect()}
    assert got[1].converter == "csv" and got[2].status == "unsupported"


def test_conversion_is_total_and_strict(spark):
    rows = [(1, b"text", ".txt"), (2, b"\0", ".bin"), (3, None, ".txt"), (4, b"no zip", ".xlsx"), (4, b"no zip", ".xlsx"), (None, b"a,b", ".CSV")]
    table = spark.createDataFrame(rows, "id long, b binary, e string")
    f = files.from_table(table, "id", "b", files.info(extension=F.col("e")))
    got = convert(f).collect()
    assert sorted(r.status for r in got) == ["failed", "failed", "ok", "ok", "unsupported", "unsupported"]
    assert convert(f.limit(0)).count() == 0
    assert "Python" not in routed(f)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="not converted"):
        convert(f, Options(strict=True)).collect()


def test_files_with_many_parts(spark):
    """Files taken apart together give what each gives alone, and what an archive inside an archive gives."""
    from inkwell.api import convert_file

    book = W.epub_bytes({"title": "T_1", "creator": "A", "identifier": "7"}, ["<h1>one</h1>", "<p>two</p>"])
    sheet = W.xlsx_bytes({"S": [["a", "b  c", "a"], [1, None, "NA"], [None, 2.5, "x*y"]], "Empty": []})
    inner = W.zip_bytes({"z.txt": "deep", "b.csv": "p,q\n1,2"})
    archive = W.zip_bytes({"B.txt": "second", "a.xlsx": sheet, "in.zip": inner, "skip.bin": b"\0", "_x.epub": book})
    pages = W.pdf_bytes([[(50, 100, "one"), (50, 120, ".1"), (50, 140, "two")], []])
    group = f"<p:grpSp>{W.shape('in b', None, 60)}{W.shape('in a', None, 50)}</p:grpSp>"
    picture = '<p:pic><p:nvPicPr><p:cNvPr name="Pic 1" descr="a [b]"/></p:nvPicPr></p:pic>'
    first = W.shape("body # x", None, 20) + W.shape(" Title", "title", 10) + W.slide_table([["a", "b"], ["1", ""], ["", ""]], 30) + group + picture
    deck = W.pptx_bytes([first, W.shape("late", "title", 90) + W.slide_chart("rId9"), W.shape(" ", None, 5), W.slide_chart("rId3")], {1: "note", 3: ""}, {2: W.chart_xml("Harvest", ["North"], {"Pears": [1, 2], "Plums": []})})
    rows = [(10, deck, ".pptx"), (11, W.zip_bytes({"ppt/slides/slide2.xml": "<x><t>b</t></x>", "ppt/slides/slide10.xml": "<x><t>c</t></x>"}), ".pptx"), (12, b"", ".pptx")]
    rows += [(1, book, ".epub"), (2, sheet, ".xlsx"), (3, archive, ".zip"), (4, pages, ".pdf"), (5, b"PK", ".zip"), (6, W.zip_bytes({"a": "b"}), ".epub"), (7, b"x", ".pdf"), (8, sheet, ".xlsx"), (8, sheet, ".xlsx"), (None, book, ".epub"), (9, W.zip_bytes({}), ".zip")]
    f = files.from_table(spark.createDataFrame(rows, "id long, b binary, e string"), "id", "b", files.info(extension=F.col("e")))
    got = sorted(((r.doc_id or 0, r.status, r.markdown, r.title) for r in convert(f).collect()), key=str)
    plain = []
    for i, data, ext in rows:
        out = convert_file(data, {"extension": ext})
        plain.append((i or 0, out.status, out.markdown, out.title))
    assert got == sorted(plain, key=str)
    assert {r.doc_id: [a.converter for a in r.attempts] for r in convert(f).where("status = 'failed'").collect()} == {5: ["zip"], 6: ["epub"], 7: ["pdf"], 12: ["pptx"]}
    by_id = {i: (m, t) for i, _, m, t in got}
    assert by_id[1] == ("**Title:** T\\_1\n**Authors:** A\n**Identifier:** 7\n\n# one\n\ntwo", "T_1") or by_id[1][0].endswith("# one\n\ntwo")
    assert by_id[4][0] == "one\n.1 two"
    assert by_id[2][0] == "## S\n| a | b\xa0\xa0c | a.1 |\n| --- | --- | --- |\n| 1.0 | NaN | NaN |\n| NaN | 2.5 | x\\*y |\n\n## Empty\n|\n|  |"
    assert "## File: in.zip\n\nContent from the zip file `in.zip`:\n\n## File: b.csv\n\n| p | q |" in by_id[3][0] and "## File: z.txt\n\ndeep" in by_id[3][0] and "skip.bin" not in by_id[3][0]
    wanted = ["# Title", "body # x", "| a | b |\n| --- | --- |\n| 1 |  |", "in a\nin b", "![a b](Pic1.jpg)", "### Notes:\nnote", "\nlate", "### Chart: Harvest", "[unsupported chart]"]
    places = [by_id[10][0].find(w) for w in wanted]
    assert -1 not in places and by_id[10][0].startswith("<!-- Slide number: 1 -->")


def _form(extra=()):
    table = [(x, y, t) for y, row in ((100, ("Item", "Qty", "Price")), (120, ("Bolt", "7", "1.5")), (140, ("Nut", "8", "2.5"))) for x, t in zip((50.0, 200.0, 350.0), row)]
    return W.pdf_bytes([[*table, *extra]])


def test_one_file_one_result(spark):
    """A PDF gives the same table by itself, in archives of any depth, beside providers, and alone."""
    from inkwell.api import Converter, convert_file
    from inkwell.plans import shared

    data = _form()
    once = W.zip_bytes({"a.pdf": data})
    twice = W.zip_bytes({"in.zip": once, "b.pdf": data})
    table = "| Item | Qty | Price |\n| ---- | --- | ----- |\n| Bolt | 7   | 1.5   |\n| Nut  | 8   | 2.5   |"
    rows = [(1, data, ".pdf"), (2, once, ".zip"), (3, twice, ".zip"), (4, W.zip_bytes({"x.zip": twice}), ".zip")]
    f = files.from_table(spark.createDataFrame(rows, "id long, b binary, e string"), "id", "b", files.info(extension=F.col("e")))
    given = [Providers(), Providers(detect_charset=lambda b: ("utf-8", 0.9)), Providers(classify=lambda b: None), Providers(analyze=lambda b, i: None)]
    for p in given:
        got = {r.doc_id: r.markdown for r in convert(f, Options(providers=p)).collect()}
        assert got[1] == table and got[2].endswith(table) and got[3].count(table) == 2 and got[4].count(table) == 2, p
    assert Converter().convert(data, extension=".pdf").markdown == convert_file(data, {"extension": ".pdf"}).markdown == table
    out = convert(f)
    assert out.count() == 4
    shared.clear()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist|FAILED_READ_FILE"):
        out.collect()
    deep = once
    for _ in range(9):
        deep = W.zip_bytes({"n.zip": deep})
    assert table not in convert_file(deep, {"extension": ".zip"}).markdown


def test_rounds_of_converters(spark):
    """What fails goes to its next converter, guess by guess, whether Spark or a parser reads it."""
    hints = lambda e, m: files.info(extension=e, mimetype=m)
    rows = [(1, b"no workbook", ".xlsx", "text/plain"), (2, b"no book", ".epub", None), (3, W.xlsx_bytes({"S": [["a"], [1]]}), ".xlsx", "text/plain"), (4, b"a,b", ".pdf", "text/csv"), (5, b"x", ".zip", "application/pdf"), (6, W.zip_bytes({"a": "b"}), ".epub", "text/plain")]
    f = files.from_table(spark.createDataFrame(rows, "id long, b binary, e string, m string"), "id", "b", hints(F.col("e"), F.col("m")))
    got = {r.doc_id: (r.status, r.converter, r.markdown, [a.converter for a in r.attempts]) for r in convert(f).collect()}
    assert got[1] == ("ok", "text", "no workbook", ["xlsx"])
    assert got[2] == ("failed", None, None, ["epub"])
    assert got[3] == ("ok", "xlsx", "## S\n| a |\n| --- |\n| 1 |", [])
    assert got[4] == ("ok", "csv", "| a | b |\n| --- | --- |", [])
    assert got[5] == ("failed", None, None, ["pdf", "zip"])
    assert got[6][:2] == ("ok", "text") and got[6][3] == ["epub"]
    said = {"mimetype": "application/pdf", "extensions": ["pdf"]}
    given = Options(providers=Providers(classify=lambda b: said if b.startswith(b"%PDF") else None))
    rows = [(1, _form(), ".docx", None), (2, b"%PDF broken", ".txt", None), (3, b"plain", ".txt", None), (4, None, ".txt", None)]
    f = files.from_table(spark.createDataFrame(rows, "id long, b binary, e string, m string"), "id", "b", hints(F.col("e"), F.col("m")))
    got = {r.doc_id: (r.status, r.converter, [a.converter for a in r.attempts]) for r in convert(f, given).collect()}
    assert got == {1: ("ok", "pdf", ["docx"]), 2: ("ok", "text", []), 3: ("ok", "text", []), 4: ("unsupported", None, [])}
    given = Options(providers=Providers(analyze=lambda b, i: 1 / 0 if b == b"x" else None))
    f = files.from_table(spark.createDataFrame([(1, b"x"), (2, b"y")], "id long, b binary"), "id", "b", hints(F.lit(".pdf"), F.lit("text/plain")))
    got = {r.doc_id: (r.converter, [a.converter for a in r.attempts]) for r in convert(f, given).collect()}
    assert got == {1: ("text", ["analyze", "pdf"]), 2: ("text", ["pdf"])}


def test_pictures_of_slides(spark):
    """Pictures meet their media parts by relationship; bytes become data URIs, an injected function describes them."""
    from inkwell.api import convert_file

    picture = '<p:pic><p:nvPicPr><p:cNvPr name="Pic 1" descr="a [b]"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId{0}"/></p:blipFill></p:pic>'
    data = W.pptx_bytes([picture.format(7) + picture.format(8)])
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            if not n.startswith("ppt/slides/_rels"):
                new.writestr(n, old.read(n))
        new.writestr("ppt/slides/_rels/slide1.xml.rels", '<Relationships><Relationship Id="rId7" Target="../media/p.JPG"/></Relationships>')
        new.writestr("ppt/media/p.JPG", b"\x01\x02\xff" * 100)
    import base64

    uri = "data:image/jpeg;base64," + base64.b64encode(b"\x01\x02\xff" * 100).decode()
    kept = convert_file(out.getvalue(), {"extension": ".pptx"}, Options(keep_data_uris=True)).markdown
    assert kept == f"<!-- Slide number: 1 -->\n\n![a b]({uri})\n\n![a b](Pic1.jpg)"
    given = Options(providers=Providers(caption=lambda b, i: f"{len(b)} bytes of {i['extension']}"))
    assert "![300 bytes of .jpg a b](Pic1.jpg)" in convert_file(out.getvalue(), {"extension": ".pptx"}, given).markdown


def test_form_pages_by_words(spark):
    """Words near a column count, not the starts of clusters alone; lines that start with a part of a number are no rows."""
    wide = [(50, 120, "Boltlong"), (110, 120, "eightish"), (350, 120, "10.5"), (200, 120, "7")]
    page = [(50.0, 100.0, "Item"), (200.0, 100.0, "Qty"), (350.0, 100.0, "Price"), *wide, (50, 140, "Nut"), (200, 140, "8"), (350, 140, "2.25"), (50, 160, ".1"), (200, 160, "9"), (350, 160, "3.25")]
    words = spark.createDataFrame([(1, 0, t, float(x), x + 5.0 * len(t) + (45 if t == "eightish" else 0), float(y), 612.0) for x, y, t in page], "doc_id long, page int, text string, x0 double, x1 double, top double, page_width double")
    text = layout.form_pages(words).first().text
    assert text.split("\n") == ["| Item              | Qty | Price |", "| ----------------- | --- | ----- |", "| Boltlong eightish | 7   | 10.5  |", "| Nut               | 8   | 2.25  |", ".1  9  3.25"]
    tall = [(50, 100, "x𝒜𝒜𝒜𝒜"), (200, 100, "mmm"), (350, 100, "nnn"), (50, 120, "yyy"), (200, 120, "mmm"), (350, 120, "nnn")]
    tall = spark.createDataFrame([(1, 0, t, float(x), x + 10.0, float(y), 612.0) for x, y, t in tall], words.schema)
    assert layout.form_pages(tall).first().text.split("\n")[1].startswith("| --------- |")  # nine UTF-16 units


def test_charsets_by_expression(spark):
    said = [("é".encode(), None), (b"\xef\xbb\xbfmark", None), ("é".encode("utf-16"), None), ("你好世界".encode("gbk"), None), ("é".encode("latin1"), "latin1"), (b"\xff\xfe", "UTF_8"), (b"", None), ("ａ".encode("cp932"), "shift_jis"), (b"x", "nonsense")]
    f = files.from_table(spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(said)], "id long, b binary, c string"), "id", "b", files.info(extension=F.lit(".txt"), charset=F.col("c")))
    from inkwell.plans.convert import convert_one

    for r in convert(f).collect():
        info = {"extension": ".txt", "charset": said[r.doc_id][1]}
        alone = convert_one(said[r.doc_id][0], [{"name": "text", "info": info}], Options(), Registry())
        assert (r.markdown, r.status, r.converter) == (alone[0], alone[3], alone[2]), said[r.doc_id]
    plan = convert(f)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and plan.count("ArrowEvalPython") == 1  # contents are read once


def test_notebooks_by_expression(spark):
    from inkwell.plans.convert import convert_one

    cell = lambda kind, source: {"cell_type": kind, "source": source}
    books = [
        {"cells": [cell("code", ["a\n", "b"]), cell("markdown", "x\n#  Head \u00e9"), cell("markdown", ["# Late"]), cell("raw", "[1, 2]"), cell("odd", "no"), {"cell_type": "code"}], "nbformat": 4},
        {"cells": [], "metadata": {"title": "Own"}}, {"cells": [cell("markdown", "# A")], "metadata": {"title": ""}}, {"nbformat": 4}, [1], {"cells": [cell("markdown", "[\"a\"]")]},
    ]
    texts = [json.dumps(b).encode() for b in books] + [b"no json", b"\xef\xbb\xbf" + json.dumps(books[0]).encode()]
    f = files.from_table(spark.createDataFrame(list(enumerate(texts)), "id long, b binary"), "id", "b", files.info(extension=F.lit(".ipynb")))
    for r in convert(f).collect():
        markdown, title, used, status, attempts = convert_one(texts[r.doc_id], [{"name": n, "info": {"extension": ".ipynb", "mimetype": "application/json"}} for n in ("ipynb", "text")], Options(), Registry())
        assert (r.markdown, r.title, r.converter, r.status, len(r.attempts)) == (markdown, title, used, status, len(attempts)), r.doc_id


def test_options_of_a_call_and_rules_of_plugins(spark):
    base, call = Options(keep_data_uris=True, strict=True), Options(style_map={"a": "b"})
    assert call.over(base) == Options(True, {"a": "b"}, strict=True) and Options().over(base) == base
    assert Options(strict=False, keep_data_uris=False).over(base) == Options(False, strict=False) and Options(style_map=None).over(call).style_map is None
    assert Options(strict=False).over(base).over(Options(keep_data_uris=False)) == Options(True, strict=False)
    registry = Registry()
    registry.register_page_converter(Route("shout", rule=lambda data, info: data.startswith(b"!") or 1 / (info["extension"] != ".err")), lambda data, info: (data.decode().upper(), None))
    f = files.from_table(spark.createDataFrame([(1, b"!a", None), (2, b"b", ".err"), (3, b"!c", ".txt")], "id long, b binary, e string"), "id", "b", files.info(extension=F.col("e")))
    assert {r.doc_id: (r.markdown, r.converter) for r in convert(f, registry=registry).collect()} == {1: ("!A", "shout"), 2: (None, None), 3: ("!C", "shout")}


def test_plugins():
    plugins.clear()

    def rtf(registry):
        registry.register(Route("rtf", (".rtf",)), lambda data, info: ("RTF:" + data.decode(), None))

    def broken(registry):
        registry.register(Route("half", (".half",)), None)
        raise RuntimeError("no")

    plugins.register(rtf)
    plugins.register(broken)
    registry, errors = plugins.enabled(True)
    assert [r.name for r in registry.routes][:2] == ["rtf", "csv"] and len(errors) == 1
    assert len(plugins.enabled(False)[0].routes) == len(Registry().routes) and len(plugins.registered()) == 2
    plugins.clear()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    source = tmp_path / "a.csv"
    source.write_text("x,y\n1,2")
    assert cli.main([str(source)]) == 0 and capsys.readouterr().out == "| x | y |\n| --- | --- |\n| 1 | 2 |\n"
    assert cli.main([str(source), "-o", str(tmp_path / "o.md"), "-x", "TXT"]) == 0 and (tmp_path / "o.md").read_text().startswith("x,y")
    for wrong in (["-m", "text"], ["-c", "nope"], ["-e", "u", "--cu-endpoint", "v"], ["--use-cu"], ["-e", "u"], ["--cu-file-types", "odd"]):
        monkeypatch.delenv("AZURE_CONTENT_UNDERSTANDING_ENDPOINT", raising=False)
        assert cli.main([*wrong, *([str(source)] if wrong != ["-e", "u"] else [])]) == 1 and "Error" in capsys.readouterr().err
    assert cli.main([str(tmp_path / "missing")]) == 1
    source = tmp_path / "a.pdf"
    source.write_bytes(b"x")
    monkeypatch.setenv("AZURE_API_KEY", "k")

    def client(method, url, headers, body):
        return (202, {"Operation-Location": "poll"}, b"") if method == "POST" else (200, {}, b'{"status":"succeeded","analyzeResult":{"content":"# Doc<!-- x -->"}}')

    assert cli.main([str(source), "-e", "https://svc/"], client=client) == 0 and capsys.readouterr().out == "# Doc\n"


def test_cloud_results(spark):
    assert cloud.result_markdown({"analyzeResult": {"fields": {"a": {"value": None}, "b": [1]}, "content": "x"}}) == "---\na: null\nb: [1]\n---\n\nx"
    assert cloud.result_markdown({"odd": 1}).startswith("```yaml")
    results = [{"analyzeResult": {"fields": {"a": {"value": None}, "b": [1]}, "content": "x"}}, {"fields": {"q": 'say "hi" \\', "n": 1.5, "o": {"x": 1}}, "contents": [{"markdown": " p ", "pageNumber": 3}, {"fields": {"q": {"content": "late"}}}]}, {"markdown": " "}]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(results[:2])], "i int, j string").select("i", cloud.markdown_of(F.col("j")).alias("m")).collect()
    assert [r.m for r in rows] == [cloud.result_markdown(r) for r in results[:2]]
    failing = cloud.Service(lambda kind: "u", lambda *a: (500, {}, b""), lambda: {"k": "v"})
    given = Options(providers=Providers(analyze=failing))
    from inkwell.api import convert_file

    out = convert_file(b"t", {"extension": ".txt"}, given)
    assert (out.converter, out.status, out.attempts[0].converter) == ("text", "ok", "analyze")
    assert failing(b"", {"extension": ".odd"}) is None
    assert cloud.content_service("e/", None, own="mine").submit("png") == "e/contentunderstanding/analyzers/mine:analyze?api-version=2025-05-01-preview"
    assert "prebuilt-videoSearch" in cloud.content_service("e", None, own="mine").submit("mp4")
    assert cloud.auth_headers("k") == {"Ocp-Apim-Subscription-Key": "k"} and cloud.auth_headers(provider=lambda: {"a": "b"}) == {"a": "b"}


def test_entry_lists_are_complete(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "markdown", "title", "converter", "status"]


def test_single_files(spark, tmp_path):
    from inkwell.api import Converter, Failed, Unsupported

    source = tmp_path / "a.CSV"
    source.write_text("x,y")
    table = "| x | y |\n| --- | --- |"
    answer = (200, {"Content-Type": "text/csv; charset=utf-8", "Content-Disposition": 'attachment; filename="q.csv"'}, b"x,y", "https://h/p")
    c = Converter(fetch=lambda url, headers: answer if "markdown" in headers["Accept"] else None)
    assert str(c.convert(str(source))) == c.convert(source).text_content == c.convert(f"file://{source}").markdown == table
    assert c.convert("https://h/p").markdown == c.convert_url(" https://h/p ").markdown == table
    assert c.convert("data:text/csv,x%2Cy").markdown == c.convert("data:text/csv;charset=utf-8;base64,eCx5").markdown == table
    with source.open("rb") as f:
        assert c.convert(f, extension=".txt").markdown == "x,y"
    for wrong, kind in ((b"\0", Unsupported), ("ftp:x", OSError), ("file://far/x", ValueError), (3, TypeError)):
        with pytest.raises(kind):
            c.convert(wrong)
    with pytest.raises(Failed, match="docx"):
        c.convert(b"x", extension=".docx")
    with pytest.raises(ValueError, match="HTTP 404"):
        c.convert_response(404, {}, b"", "u")
    with pytest.raises(ValueError, match="no fetcher"):
        Converter().convert("http://x")
