"""Queries and parsers over whole inputs: nothing behind a prefix is lost in silence."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell import queries
from inkwell.functions import text as T
from inkwell.parsers import charset, pdf


def test_data_uris_carry_whole_texts(spark, tmp_path):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("ab +%;,=&é日😀\n\t") for _ in range(n)) + "."
    rows = [(i, text(n)) for i, n in enumerate([0, 10, 199, 200, 201, 5000, 5001, 300_000, 300_001, 300_002, 300_003, 300_004])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {x.doc_id: x for x in queries.QUERIES["src_data_uri"](spark, str(tmp_path)).collect()}
    assert {i: (x.mimetype, x.charset, x.payload) for i, x in found.items()} == {i: ("text/plain", None if i % 2 else "utf-8", t) for i, t in rows}


def test_pdf_stream_over_the_limit_fails(monkeypatch):
    import zlib

    page = b"BT /F1 12 Tf 50 700 Td (first) Tj ET " + b" " * 5000 + b"BT /F1 12 Tf 50 600 Td (last) Tj ET"
    packed = zlib.compress(page)
    head = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 >> >> >> >>\nendobj\n"
    data = head + b"4 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream\nendobj\n"
    assert [w[1] for w in pdf.words(data)] == ["first", "last"]
    monkeypatch.setattr(pdf, "LIMIT", len(page))
    assert [w[1] for w in pdf.words(data)] == ["first", "last"]
    monkeypatch.setattr(pdf, "LIMIT", 2000)
    with pytest.raises(ValueError, match="more than 2000 bytes"):
        pdf.words(data)


def test_charsets_are_told_by_whole_values():
    """A character beyond the first thousands of bytes counts."""
    for text, codec, name in (("你好世界" * 40, "gbk", "gb18030"), ("あいうえお" * 40, "cp932", "shift_jis"), ("naïve", "utf-8", "utf-8")):
        data = b"a" * 5000 + text.encode(codec)
        assert charset.detect(data) == name and charset.decode(data) == "a" * 5000 + text


def test_a_data_uri_is_made_once(spark):
    """Every mention of the URI inside its parser would else make and trim a whole text anew."""
    df = queries._data_uris(spark.createDataFrame([(1, "a, b;base64 ")], "doc_id long, text string"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 0
    uris = ["　 data:;charset=x;base64,aGk=\n", "data:text/a,%E4%BD%A0+,;b\n", "data:a;b,x", "data:a", "DATA:,", "data:a\n,x", None]
    rows = spark.createDataFrame(list(enumerate(uris)), "i int, u string").coalesce(1).select("i", T.data_uri(F.col("u")).alias("d")).orderBy("i").collect()
    got = [r.d and (r.d.mimetype, r.d.charset, bytes(r.d.data).decode()) for r in rows]
    assert got == [("text/plain", "x", "hi"), ("text/a", None, "你+,;b"), None, None, ("text/plain", None, ""), ("a\n", None, "x"), None]
