"""Functions that Catalyst cannot express, on Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as S


def _record(**fields: S.DataType) -> S.StructType:
    return S.StructType([S.StructField(name, kind) for name, kind in fields.items()])


def _list(**fields: S.DataType) -> S.ArrayType:
    return S.ArrayType(_record(**fields))


@F.pandas_udf(S.StringType())
def decode_text(content: pd.Series, label: pd.Series) -> pd.Series:
    """Text of bytes in the labelled charset, detected where the label is null."""
    from inkwell.parsers import charset

    return pd.Series([None if b is None else charset.decode(bytes(b), c) for b, c in zip(content, label, strict=True)], dtype=object)


@F.pandas_udf(S.ArrayType(S.ArrayType(S.StringType())))
def csv_rows(text: pd.Series) -> pd.Series:
    """Rows of a CSV text, quotes anywhere in a field."""
    from inkwell.parsers import textual

    return text.map(lambda t: None if t is None else textual.csv_rows(t))


@F.pandas_udf(S.StructType().add("markdown", S.StringType()).add("title", S.StringType()))
def html_to_markdown(html: pd.Series) -> pd.DataFrame:
    """Markdown and title of HTML texts."""
    from inkwell.parsers import html as H

    rows = [(None, None) if h is None else H.page(h) for h in html]
    return pd.DataFrame(rows, columns=["markdown", "title"])


def markdown_of(keep_data_uris: bool = False):
    """A function of HTML texts that gives their Markdown."""

    @F.pandas_udf(S.StringType())
    def run(html: pd.Series) -> pd.Series:
        from inkwell.parsers import html as H

        return html.map(lambda h: None if h is None else H.page(h, keep_data_uris)[0])

    return run


@F.pandas_udf(S.StringType())
def book_path(content: pd.Series) -> pd.Series:
    """The path of the package document that an EPUB's container names; null if it names none or isn't XML."""
    from inkwell.parsers.xmltree import parse_xml

    def path(data):
        try:
            root = parse_xml(bytes(data)).first("rootfile")
        except ValueError:
            return None
        return root.attrs.get("full-path") if root is not None else None

    return content.map(path)


BOOK = _record(about=_list(name=S.StringType(), value=S.StringType()), title=S.StringType(), items=_list(idref=S.StringType(), href=S.StringType()), spine=S.ArrayType(S.StringType()), error=S.StringType())


@F.pandas_udf(BOOK)
def book(content: pd.Series) -> pd.DataFrame:
    """What a package document says of its book, its manifest and its spine."""
    from inkwell.parsers.xmltree import parse_xml

    def one(data):
        try:
            opf = parse_xml(bytes(data))
        except ValueError as e:
            return None, None, None, None, str(e)
        about = [("Title", opf.text_of("dc:title")), ("Authors", ", ".join(n.content().strip() for n in opf.all("dc:creator")))]
        about += [(k.capitalize(), opf.text_of(f"dc:{k}")) for k in ("language", "publisher", "date", "description", "identifier")]
        items = [{"idref": n.attrs["id"], "href": n.attrs["href"]} for n in opf.all("item") if n.attrs.get("id") and n.attrs.get("href")]
        return [{"name": k, "value": v} for k, v in about], opf.text_of("dc:title"), items, [n.attrs.get("idref", "") for n in opf.all("itemref")], None

    return pd.DataFrame([one(d) for d in content], columns=["about", "title", "items", "spine", "error"])


@F.pandas_udf(_list(name=S.StringType(), rel_id=S.StringType(), from_1904=S.BooleanType()))
def sheet_list(content: pd.Series) -> pd.Series:
    """The sheets of a workbook part, with the ids of their relationships."""
    from inkwell.parsers.xmltree import parse_xml

    def one(data):
        book = parse_xml(bytes(data))
        properties = book.one("workbookPr")
        early = properties is not None and properties.attrs.get("date1904") in ("1", "true")
        return [{"name": s.attrs.get("name", ""), "rel_id": s.attr("id"), "from_1904": early} for s in book.named("sheet")]

    return content.map(lambda d: _or_none(one, d))


@F.pandas_udf(_list(rel_id=S.StringType(), target=S.StringType(), external=S.BooleanType()))
def relationships(content: pd.Series) -> pd.Series:
    """The relationships of a part, in order."""
    from inkwell.parsers.xmltree import parse_xml

    def one(data):
        return [{"rel_id": n.attrs.get("Id"), "target": n.attrs.get("Target", ""), "external": n.attrs.get("TargetMode") == "External"} for n in parse_xml(bytes(data)).named("Relationship")]

    return content.map(lambda d: _or_none(one, d))


@F.pandas_udf(S.ArrayType(S.StringType()))
def slide_ids(content: pd.Series) -> pd.Series:
    """The relationships of a presentation's slides, in order."""
    from inkwell.parsers import office

    return content.map(lambda d: _or_none(office.slide_ids, bytes(d)))


SHAPES = _list(
    place=_list(top=S.LongType(), left=S.LongType(), stored=S.IntegerType()), kind=S.StringType(), text=S.StringType(), is_title=S.BooleanType(), name=S.StringType(), rel_id=S.StringType(), rows=S.ArrayType(S.ArrayType(S.StringType()))
)


@F.pandas_udf(SHAPES)
def slide_shapes(content: pd.Series) -> pd.Series:
    """The shapes of a slide part."""
    from inkwell.parsers import office

    def one(data):
        return [{f: shape.get(f) for f in SHAPES.elementType.fieldNames()} for shape in office.slide_shapes(bytes(data))]

    return content.map(lambda d: None if d is None else _or_none(one, d))


@F.pandas_udf(_record(title=S.StringType(), names=S.ArrayType(S.StringType()), labels=S.ArrayType(S.StringType()), columns=S.ArrayType(S.ArrayType(S.StringType())), known=S.BooleanType()))
def chart_parts(content: pd.Series) -> pd.DataFrame:
    """The cached series of a chart part; `known` is null for a part that can't be read, false without series."""
    from inkwell.parsers import office

    def one(data):
        found = _or_none(office.chart_parts, bytes(data)) if data is not None else None
        broken = data is None or (found is None and _or_none(lambda d: office.parse_xml(d) and True, bytes(data)) is None)
        return (found["title"], found["names"], found["labels"], found["columns"], True) if found else (None, None, None, None, None if broken else False)

    return pd.DataFrame([one(d) for d in content], columns=["title", "names", "labels", "columns", "known"])


@F.pandas_udf(S.StringType())
def note_text(content: pd.Series) -> pd.Series:
    """The text of a notes part's first body."""
    from inkwell.parsers import office

    return content.map(lambda d: None if d is None else _or_none(office.note_text, bytes(d)))


@F.pandas_udf(S.ArrayType(S.StringType()))
def shared_strings(content: pd.Series) -> pd.Series:
    """The strings of a workbook's string table, without phonetic runs."""
    from inkwell.parsers.xmltree import parse_xml

    return content.map(lambda d: _or_none(lambda x: ["".join(t.content() for t in s.named("t") if not t.inside("rPh")) for s in parse_xml(bytes(x)).named("si")], d))


def classified(classify):
    """A function of contents that gives a classifier's answer, `known` being null where it has none or fails."""

    @F.pandas_udf("mimetype string, extensions array<string>, charset string, known boolean")
    def run(content: pd.Series) -> pd.DataFrame:
        def one(data):
            try:
                found = classify(bytes(data)) if data is not None else None
            except Exception:  # noqa: BLE001  a classifier that fails says nothing
                found = None
            return (found.get("mimetype"), found.get("extensions") or [], found.get("charset"), True) if found else (None, None, None, None)

        return pd.DataFrame([one(d) for d in content], columns=["mimetype", "extensions", "charset", "known"])

    return run.asNondeterministic()  # asked once for each file: no later step takes the call into itself


def described(caption):
    """A function of pictures and their extensions that gives what an injected function says of them."""

    @F.pandas_udf(S.StringType())
    def run(content: pd.Series, extension: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else caption(bytes(b), {"extension": e}) for b, e in zip(content, extension, strict=True)], dtype=object)

    return run


@F.pandas_udf(S.ArrayType(S.BooleanType()))
def date_styles(content: pd.Series) -> pd.Series:
    """Whether each cell style of a workbook shows numbers as dates."""
    from inkwell.parsers import sheets

    return content.map(lambda d: _or_none(sheets.date_styles, bytes(d)))


@F.pandas_udf(_list(r=S.IntegerType(), c=S.IntegerType(), kind=S.StringType(), text=S.StringType(), serial=S.DoubleType(), style=S.IntegerType()))
def sheet_cells(content: pd.Series) -> pd.Series:
    """The cells of a sheet part; kind i marks places in the string table, given in `text`."""
    from inkwell.parsers import sheets

    return content.map(lambda d: _or_none(sheets.cell_rows, bytes(d)))


def _or_none(f, data):
    """What a part parser gives, null for a part that isn't well formed."""
    try:
        return f(data)
    except (ValueError, KeyError, AttributeError):
        return None
