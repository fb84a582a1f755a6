"""HTML as a table of elements, in Catalyst: tags are cut by patterns, nesting is a stack folded over the tags of a page, and
headings, links, table grids and list items are rows. No page meets another one until rows are grouped, and no Python runs.

Elements: (doc_id, elem_no, end_no, tag, path, attrs, text). elem_no and end_no are places in the page's tokens, so an element
holds what lies between its two; path holds its ancestors from the outermost inwards, as struct<n, tag>.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T

# Fixed values of HTML: elements without content, and those whose content holds no tags.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script style title textarea".split()
#: Start tags that end open elements: (tags, open elements that they end, elements beyond which they don't reach).
ENDS = [
    (
        "address article aside blockquote center dir div dl fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr isindex main menu nav noframes ol p pre section table ul",
        "p",
        "table td th button object",
    ),
    ("li", "li", "ul ol menu"),
    ("dt dd", "dt dd", "dl"),
    ("option", "option", "select"),
    ("tr", "tr td th caption colgroup", "table"),
    ("td th", "td th", "tr table"),
    ("thead tbody tfoot", "thead tbody tfoot tr td th caption colgroup", "table"),
]
CELLS, LISTS = ["td", "th"], ["ul", "ol", "menu"]
HEADINGS = [f"h{i}" for i in range(1, 7)]
#: Elements nested deeper hold nothing. Tags that are folded into one list, and lists into one of the next level: as a fold
#: copies its state at every step, long pages would else take the square of their tags.
DEEPEST, CHUNK = 200, 64

_REST = r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>"
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})(?=[\s/>]){_REST}.*?(?:</\1\s*>|\z)|</?[a-z]{_REST}|<[!?/][^>]*+>|[^<]++|<"
NAMED = r"(?s)^</?([A-Za-z][^\s/>]*).*"
ENTITY = r"(?s)&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31});?|[^&]+|&"
ATTRIBUTE = r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
_EDGE = rf"(?i)^</?(?:br|li|d[dt]|t[rdh]|tbody|thead|tfoot|caption|option|body|{'|'.join(ENDS[0][0].split())})[\s/>]"
_PATH = "array<struct<n:int,tag:string>>"
_ELEMENT = f"struct<n:int,end:int,tag:string,path:{_PATH}>"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _words(*words: str) -> Column:
    return F.array(*map(F.lit, words))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


# Named character references, common ones first; a constant map made of two constant texts.
_COMMON = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;", "mdash;", "ndash;", "hellip;"]
_ORDER = [*_COMMON, *(k for k in html5 if k not in _COMMON)]
_CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")  # what numbers of that range stand for


def _references() -> Column:
    return F.map_from_arrays(F.split(F.lit(" ".join(_ORDER)), " "), F.split(F.lit("\x1e".join(html5[k] for k in _ORDER)), "\x1e"))


def decoded(text: Column) -> Column:
    """Text with its character references resolved; unknown ones stay as they are."""

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^&#([0-9]+);?$", 1)
        hexed = F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]+);?$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(digits != "", digits)
        code = F.when(code.isNotNull(), F.coalesce(code.try_cast("int"), F.lit(0)))
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        number = F.when(code.between(0x80, 0x9F), F.substr(F.lit(_CP1252), code - 0x7F, F.lit(1))).when(valid, char).otherwise("�")
        return F.when(~part.startswith("&"), part).when(code.isNotNull(), number).otherwise(F.coalesce(F.try_element_at(_references(), F.substr(part, F.lit(2))), part))

    parts = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.when(~F.contains(text, F.lit("&")), text).otherwise(F.array_join(F.transform(parts, one), ""))


def collapsed(text: Column) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def tokens(html: Column) -> Column:
    """A page as array<string>: tags, comments, raw elements whole, and the texts between them, in order."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def attributes(tag: Column) -> Column:
    """The attributes of a start tag as a map, names in lower case, the first of repeated ones."""
    inside = F.regexp_replace(F.regexp_extract(tag, rf"(?is)^<[a-z][^\s/>]*({_REST})", 1), ">$", "")
    names = F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    bare = lambda v: F.when(v.rlike("(?s)^[\"'].*[\"']$"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    values = F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(2)), lambda v: decoded(bare(v)))
    return _let(F.struct(names.alias("k"), values.alias("v")), lambda a: F.map_from_entries(F.filter(F.arrays_zip(a["k"], a["v"]), lambda e, i: F.array_position(a["k"], e["k"]) == i + 1)))


def _tags(toks: Column) -> Column:
    """The tags among tokens: (n, kind 1 start, 2 end, 3 without content, tag, rule), rule being a place in ENDS from 1."""

    def one(tok: Column, i: Column) -> Column:
        return _let(F.lower(F.regexp_extract(tok, NAMED, 1)), lambda name: named(tok, i, name))

    def named(tok: Column, i: Column, name: Column) -> Column:
        kind = F.when(name == "", 0).when(tok.startswith("</"), 2).when(name.isin(*VOID, *RAW), 3).otherwise(1)
        rule = F.lit(0)
        for k, (starts, _, _) in enumerate(ENDS):
            rule = F.when(name.isin(*starts.split()), k + 1).otherwise(rule)
        return F.struct(i.alias("n"), kind.alias("kind"), name.alias("tag"), rule.alias("rule"))

    return F.filter(F.transform(F.when(F.size(toks) > 0, toks), one), lambda t: t["kind"] > 0)


def _last(stack: Column, tags: Column) -> Column:
    """The place of the innermost open element with one of the tags, -1 without."""
    return F.coalesce(F.array_max(F.transform(stack, lambda x, i: F.when(F.array_contains(tags, x["tag"]), i))), F.lit(-1))


def _closed(stack: Column, keep: Column, end: Column) -> Column:
    """The elements of a stack from a place on, ended at a token."""
    gone = F.slice(stack, keep + 1, F.size(stack))
    return F.transform(gone, lambda g, i: F.struct(g["n"].alias("n"), end.alias("end"), g["tag"].alias("tag"), F.slice(stack, F.lit(1), keep + i).alias("path")))


def _step(state: Column, tag: Column) -> Column:
    """One tag: ends the open elements that it ends, then opens its own."""
    stack, size = state["stack"], F.size(state["stack"])
    own = _last(stack, F.array(tag["tag"]))
    wall = F.when(tag["tag"].isin("table", "tr", "tbody", "thead", "tfoot", "td", "th"), -1).otherwise(_last(stack, _words("td", "th", "table")))
    first = lambda tags, stop: F.array_min(F.transform(stack, lambda x, i: F.when((i > stop) & F.array_contains(tags, x["tag"]), i)))
    ended = F.element_at(F.array(*(_words(*e.split()) for _, e, _ in ENDS)), tag["rule"])
    beyond = F.element_at(F.array(*(_words(*b.split()) for _, _, b in ENDS)), tag["rule"])
    keep = F.when(size == 0, 0).when(tag["kind"] == 2, F.when((own >= 0) & (own > wall), own).otherwise(size)).when(tag["rule"] > 0, F.coalesce(first(ended, _last(stack, beyond)), size)).otherwise(size)

    def after(state: Column, keep: Column) -> Column:
        stack = state["stack"]
        kept = F.slice(stack, F.lit(1), keep)
        opens = (tag["kind"] == 1) & (keep < DEEPEST)
        leaf = F.array(F.struct(tag["n"].alias("n"), (tag["n"] + 1).alias("end"), tag["tag"].alias("tag"), kept.alias("path")))
        new = F.when(opens, F.concat(kept, F.array(F.struct(tag["n"].alias("n"), tag["tag"].alias("tag"))))).otherwise(kept)
        out = F.concat(state["out"], _closed(stack, keep, tag["n"]), F.when((tag["kind"] != 2) & ~opens, leaf).otherwise(_empty(f"array<{_ELEMENT}>")))
        return F.struct(new.alias("stack"), out.alias("out"))

    return F.aggregate(F.array(keep), state, after)


def _folded(stack: Column, tags: Column, levels: int = 0) -> Column:
    """struct(stack, out) after a list of tags, or of lists of them: the open elements, and those that ended."""
    if not levels:
        return F.aggregate(tags, F.struct(stack.alias("stack"), _empty(f"array<{_ELEMENT}>").alias("out")), _step)
    start = F.struct(stack.alias("stack"), _empty(f"array<array<{_ELEMENT}>>").alias("out"))
    put = lambda s, v: F.struct(v["stack"].alias("stack"), F.concat(s["out"], F.array(v["out"])).alias("out"))
    one = lambda s, some: F.aggregate(F.array(_folded(s["stack"], some, levels - 1)), s, put)
    return F.aggregate(tags, start, one, lambda s: F.struct(s["stack"].alias("stack"), F.flatten(s["out"]).alias("out")))


def _chunks(items: Column) -> Column:
    """An array as an array of arrays of CHUNK items."""
    none = F.transform(items, lambda x: F.array(x))  # of no items
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))).otherwise(none)


def nested(toks: Column) -> Column:
    """The elements of a page's tokens as array<struct<n, end, tag, path>>, in document order.

    End tags that nothing is open for are left out, an end tag doesn't reach out of a table cell, elements without an end
    tag end with their parent, and paragraphs, items, rows and cells where the next one starts.
    """
    whole = lambda s: F.array_sort(F.concat(s["out"], _closed(s["stack"], F.lit(0), F.size(toks))))
    return _let(_tags(toks), lambda tags: _let(_folded(_empty(_PATH), _chunks(_chunks(tags)), 2), whole))


def _texts(toks: Column) -> Column:
    """What each token adds to a text: texts decoded, a space for br and at the edges of blocks, the contents of titles and
    text areas, else nothing."""

    def one(tok: Column) -> Column:
        raw = F.regexp_extract(tok, rf"(?is)^<(?:title|textarea){_REST}(.*?)(?:</(?:title|textarea)\s*>)?$", 1)
        return F.when(~tok.startswith("<") | (tok == "<"), decoded(tok)).when(tok.rlike(_EDGE), " ").when(tok.rlike(r"(?i)^<(title|textarea)[\s/>]"), decoded(raw)).otherwise("")

    return F.transform(toks, one)


def elements(pages: DataFrame, tags: list[str] | None = None, html: str = "html") -> DataFrame:
    """(doc_id, elem_no, end_no, tag, path, attrs, text) of pages (doc_id, html): all elements, or those of some tags.

    The text is all text inside, white space collapsed; of list items only what is in no list inside them. Pages of null
    or without tags have no elements; every other column is left out. One projection: rows stay where they are.
    """
    cut = pages.select("doc_id", tokens(F.col(html).cast("string")).alias("toks"))
    cut = cut.select("doc_id", "toks", _texts(F.col("toks")).alias("texts"), nested(F.col("toks")).alias("all"))
    cut = cut.withColumn("lists", F.filter("all", lambda e: e["tag"].isin(*LISTS)))
    wanted = F.filter("all", lambda e: e["tag"].isin(*tags)) if tags is not None else F.col("all")

    def full(e: Column) -> Column:
        inside = F.sequence(e["n"], e["end"] - 1)
        outer = lambda inner: F.filter(inside, lambda i: ~F.exists(inner, lambda x: (i >= x["n"]) & (i < x["end"])))
        own = _let(F.filter("lists", lambda x: (x["n"] > e["n"]) & (x["n"] < e["end"])), outer)
        text = collapsed(F.array_join(F.transform(F.when(e["tag"] == "li", own).otherwise(inside), lambda i: F.get("texts", i)), ""))
        return F.struct(e["n"].alias("elem_no"), e["end"].alias("end_no"), e["tag"].alias("tag"), e["path"].alias("path"), attributes(F.get("toks", e["n"])).alias("attrs"), text.alias("text"))

    return cut.select("doc_id", F.inline(F.transform(wanted, full)))


def parent(path: Column, up: int = 1) -> Column:
    """The ancestor so many steps up, null beyond the outermost."""
    return F.get(path, F.size(path) - up)


def within(path: Column, *tags: str) -> Column:
    return F.exists(path, lambda x: x["tag"].isin(*tags))


def content_roots(found: DataFrame) -> DataFrame:
    """(doc_id, elem_no, end_no, tag) of the element that holds a page's content: the first body inside a page that stands in
    another one's body, else the first body, if anything is in it, else the outermost element."""
    body_at = F.array_position(F.transform("path", lambda x: x["tag"]), F.lit("body"))
    inner = (body_at > 0) & F.exists(F.slice("path", F.greatest(body_at, F.lit(1)).cast("int"), F.greatest(F.size("path"), F.lit(1))), lambda x: x["tag"] == "html")
    body, full = F.col("tag") == "body", F.col("end_no") > F.col("elem_no") + 1
    rank = F.when(body & inner, 0).when(body & (body_at == 0) & full, 1).when(F.size("path") == 0, 2)
    ranked = found.select("doc_id", "elem_no", "end_no", "tag", rank.alias("rank")).where("rank is not null")
    return ranked.groupBy("doc_id").agg(F.min(F.struct("rank", "elem_no", "end_no", "tag")).alias("r")).select("doc_id", "r.elem_no", "r.end_no", "r.tag")


def headings(found: DataFrame) -> DataFrame:
    """(doc_id, elem_no, level, text, markdown) of the headings among elements; one without text keeps its marks."""
    h = found.where(F.col("tag").isin(*HEADINGS)).withColumn("level", F.substring("tag", 2, 1).cast("int"))
    marks = F.repeat(F.lit("#"), F.col("level"))
    return h.select("doc_id", "elem_no", "level", "text", F.when(F.col("text") == "", marks).otherwise(F.concat(marks, F.lit(" "), T.escape_markdown(F.col("text")))).alias("markdown"))


def normal_href(href: Column) -> Column:
    """Absolute references with their path encoded anew, without user info and a bare slash; other schemes than web and
    file give ''. Fragments and relative references, and what can't be decoded, stay as they are."""
    parts = r"(?is)^\s*([a-z][a-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda n: F.regexp_extract(href, parts, n)
    scheme = F.lower(part(1))
    steps = F.transform(F.split(F.when(part(3) == "", "/").otherwise(part(3)), "/"), lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
    coded = lambda s: T.replace_all(F.url_encode(s), [("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")])
    path = F.array_join(F.transform(steps, coded), "/")
    tail = F.concat(part(4), F.trim(part(5)))
    whole = F.concat(scheme, F.lit("://"), F.lower(F.regexp_replace(part(2), "^.*@", "")), F.when((path == "/") & (tail == ""), "").otherwise(path), tail)
    return F.when(href.startswith("#") | ~href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(~scheme.isin("http", "https", "file"), "").when(F.exists(steps, lambda s: s.isNull()), href).otherwise(whole)


def links(found: DataFrame) -> DataFrame:
    """(doc_id, elem_no, href, title, text, markdown) of the anchors with an address among elements.

    Without text nothing is shown; inside preformatted text, and for schemes that aren't allowed, only the text; an
    address that is its own text as an automatic link.
    """
    a = found.where(F.col("tag") == "a").withColumn("given", F.try_element_at("attrs", F.lit("href"))).where(F.coalesce("given", F.lit("")) != "")
    a = a.withColumn("href", normal_href(F.col("given"))).withColumn("title", F.nullif(F.try_element_at("attrs", F.lit("title")), F.lit("")))
    bare = lambda c: F.regexp_replace(c, "/$", "")
    label = F.coalesce(F.concat(F.lit(' "'), F.replace("title", F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit(""))
    shown = (
        F.when(F.col("text") == "", "")
        .when(within(F.col("path"), "pre") | (F.col("href") == ""), T.escape_markdown(F.col("text")))
        .when((bare(F.col("text")) == bare(F.col("href"))) & F.col("title").isNull(), F.concat(F.lit("<"), "href", F.lit(">")))
        .otherwise(F.concat(F.lit("["), T.escape_markdown(F.col("text")), F.lit("]("), F.col("href"), label, F.lit(")")))
    )
    return a.select("doc_id", "elem_no", "href", "title", "text", shown.alias("markdown"))


def _colspan(attrs: Column) -> Column:
    given = F.regexp_extract(F.coalesce(F.try_element_at(attrs, F.lit("colspan")), F.lit("1")), r"^\s*\+?(\d{1,9})", 1)
    return F.greatest(F.lit(1), F.least(F.lit(1000), F.coalesce(F.nullif(given, F.lit("")).cast("int"), F.lit(1))))


def _in_tables(found: DataFrame) -> DataFrame:
    """Elements with k, 0 for rows and 1 for cells, table_no, section and row_no; null for what is no part of a table."""
    up = lambda k: parent(F.col("path"), k)
    row = F.when(F.col("tag") == "tr", F.lit(0)).when(F.col("tag").isin(*CELLS) & (up(1)["tag"] == "tr"), F.lit(1))
    above = lambda k: F.when(F.col("k") == 0, up(k)).when(F.col("k") == 1, up(k + 1))
    table = F.when(above(1)["tag"] == "table", above(1)["n"]).when(above(1)["tag"].isin("thead", "tbody", "tfoot") & (above(2)["tag"] == "table"), above(2)["n"])
    out = found.withColumn("k", row).withColumn("table_no", table).withColumn("section", F.when(above(1)["tag"] != "table", above(1)))
    return out.withColumn("row_no", F.when(F.col("k") == 0, F.col("elem_no")).when(F.col("k") == 1, up(1)["n"]))


def table_parts(found: DataFrame) -> DataFrame:
    """Rows and cells of tables among elements, with table_no and row_no, the places of their table and row: rows are
    direct children of a table or of one of its sections, cells direct children of such rows."""
    return _in_tables(found).where("table_no is not null")


def table_cells(found: DataFrame) -> DataFrame:
    """(doc_id, table_no, row, col, colspan, is_header, text): cells placed in the grid of their table, rows and columns
    from 0; a cell's column is the sum of the spans before it. Rows without cells count for nothing."""
    cells = table_parts(found).where("k = 1").withColumn("colspan", _colspan(F.col("attrs")))
    in_row = W.partitionBy("doc_id", "table_no", "row_no").orderBy("elem_no").rowsBetween(W.unboundedPreceding, -1)
    in_table = W.partitionBy("doc_id", "table_no").orderBy("row_no")
    placed = cells.withColumn("row", F.dense_rank().over(in_table) - 1).withColumn("col", F.coalesce(F.sum("colspan").over(in_row), F.lit(0)).cast("int"))
    return placed.select("doc_id", "table_no", "row", "col", "colspan", (F.col("tag") == "th").alias("is_header"), "text")


def tables(found: DataFrame) -> DataFrame:
    """(doc_id, table_no, markdown) of the tables among elements; wide cells repeat their bar.

    A table whose first row isn't all header cells gets a blank header, if that row lies in the table itself or in a body
    that comes first in it. A table without cells is a stub. All elements are needed, not cells alone.
    """
    of = ["doc_id", "table_no"]
    cell = F.when(F.col("k") == 1, F.struct("elem_no", T.escape_markdown(F.col("text")).alias("text"), _colspan(F.col("attrs")).alias("colspan"), (F.col("tag") == "th").alias("head")))
    up, at = parent(F.col("path")), F.col("elem_no")
    none = {"table_no": F.lit(None).cast("int"), "row_no": F.lit(None).cast("int"), "cell": F.lit(None), "section": F.lit(None), "child": F.lit(None).cast("int"), "own": F.lit(False)}
    said = lambda **x: F.struct(*((x.get(k, v)).alias(k) for k, v in none.items()))
    part = said(table_no=F.col("table_no"), row_no=F.col("row_no"), cell=cell, section=F.when(F.col("k") == 0, F.col("section")))
    roles = F.array(F.when(F.col("table_no").isNotNull(), part), F.when(F.col("tag") == "table", said(table_no=at, own=F.lit(True))), F.when(up["tag"] == "table", said(table_no=up["n"], child=at)))
    # what an element is to tables, its own among them, told in one pass: a join would make the elements anew for each side
    each = _in_tables(found).select("doc_id", F.inline(F.filter(roles, lambda r: r.isNotNull())))
    rows = each.groupBy(*of, "row_no").agg(F.array_sort(F.collect_list("cell")).alias("cells"), F.first("section", True).alias("section"), F.min("child").alias("child"), F.bool_or("own").alias("own"))
    line = F.when(F.col("row_no").isNotNull(), F.struct("row_no", "cells", "section"))
    grid = rows.groupBy(*of).agg(F.array_sort(F.collect_list(line)).alias("rows"), F.min("row_no").alias("first_tr"), F.min("child").alias("first_child"), F.bool_or("own").alias("own")).where("own")
    full = F.filter(F.coalesce("rows", _empty("array<struct<row_no:int,cells:array<struct<elem_no:int,text:string,colspan:int,head:boolean>>,section:struct<n:int,tag:string>>>")), lambda r: F.size(r["cells"]) > 0)
    grid = grid.withColumn("rows", full).withColumn("top", F.get(full, F.lit(0)))
    bodied = F.col("top.section").isNull() | ((F.col("top.section.tag") == "tbody") & (F.col("top.section.n") == F.col("first_child")))
    blank = (F.col("top.row_no") == F.col("first_tr")) & F.exists("top.cells", lambda c: ~c["head"]) & bodied
    width = F.aggregate("top.cells", F.lit(0), lambda n, c: n + c["colspan"])
    lines = F.transform("rows", lambda r: T.spanning_row(r["cells"]))
    rule = T.rule_row(width)
    empty = F.concat(F.lit("|"), F.repeat(F.lit("  |"), width))
    whole = F.when(blank, F.concat(F.array(empty, rule), lines)).otherwise(F.concat(F.array(F.get(lines, F.lit(0)), rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))))
    return grid.select(*of, F.when(F.size("rows") == 0, "|\n|  |").otherwise(F.array_join(whole, "\n")).alias("markdown"))


def list_items(found: DataFrame) -> DataFrame:
    """(doc_id, elem_no, level, marker, indent, text, line) of the list items among elements (lists and items are needed).

    level counts the lists around an item inside its table cell. Items of ordered lists are numbered from the list's start;
    others are marked by *, in a list inside an unordered one by +. An item is indented by 3 behind each item of an ordered
    list that holds it, by 2 behind others. Items without a list are marked by *.
    """
    from_cell = F.coalesce(F.array_max(F.transform("path", lambda x, i: F.when(x["tag"].isin(*CELLS), i + 1))), F.lit(0))
    near = F.slice("path", from_cell + 1, F.greatest(F.size("path"), F.lit(1)))
    li = found.where(F.col("tag").isin("li", *LISTS)).withColumn("near", near).withColumn("lists", F.filter("near", lambda x: x["tag"].isin(*LISTS)))
    item = F.col("tag") == "li"
    owner = parent(F.col("path"))
    group = F.when(~item, F.col("elem_no")).when(owner["tag"].isin(*LISTS), owner["n"]).otherwise(-1 - F.col("elem_no"))
    order = W.partitionBy("doc_id", "group").orderBy("elem_no")
    start = F.first(F.when(~item, F.coalesce(F.regexp_extract(F.try_element_at("attrs", F.lit("start")), r"^\s*(-?\d{1,9})", 1).try_cast("int"), F.lit(1)))).over(order.rowsBetween(W.unboundedPreceding, 0))
    nth = F.sum(item.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1
    li = li.withColumn("group", group).withColumn("start", start).withColumn("nth", nth).where(item)
    lists, inner = F.col("lists"), parent(F.col("lists"))
    ordered = F.concat((F.coalesce("start", F.lit(1)) + F.col("nth")).cast("string"), F.lit(". "))
    marker = F.when(inner["tag"] == "ol", ordered).when((F.size(lists) <= 1) | (parent(lists, 2)["tag"] == "ol"), "* ").otherwise("+ ")
    steps = F.transform("near", lambda x, i: F.when(x["tag"] != "li", 0).when((i > 0) & (F.get("near", i - 1)["tag"] == "ol"), 3).otherwise(2))
    li = li.withColumn("marker", marker).withColumn("indent", F.aggregate(steps, F.lit(0), lambda n, k: n + k))
    line = F.concat(F.repeat(F.lit(" "), F.col("indent")), F.col("marker"), T.escape_markdown(F.col("text")))
    return li.select("doc_id", "elem_no", F.size("lists").alias("level"), "marker", "indent", "text", line.alias("line"))
