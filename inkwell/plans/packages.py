"""Files that hold many parts, converted by Spark jobs.

One pass takes files apart into a written table of parts: entries of archives, e-books, workbooks
and presentations, words of PDF files.
What belongs together is joined and put in order by Spark: spine and manifest, sheets, slides and relationships, cells and
shared strings, column types, shapes, page layouts. Python parses single parts only.

Every plan gives (key, markdown, title, error_class, message), key being a number that the pass gives to each file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import arrow
from inkwell.functions import text as T
from inkwell.operators import layout, ordered, package, tables
from inkwell.plans.shared import written

PARTS = "key long, doc_id {}, kind string, name string, path string, content binary, page int, text string, x0 double, x1 double, top double, page_width double, title string, error_class string, message string, tries {}, attempts {}"
#: Bytes of parts that are handed on together.
BATCH_BYTES = 4 << 20
PACKAGES = ("pdf", "epub", "xlsx", "pptx", "zip")


def parts(files: DataFrame, convert: Callable[[str, bytes, dict], tuple[str, str | None]], depth: int = 0) -> DataFrame:
    """The parts of files (doc_id, content, tries, attempts), tries being array<struct<name, info>>, the converters that are
    left for a file: the first is tried. To be written before it is used, as `key` names a file in one reading only.

    Each file has one row of page -1. A file of PACKAGES is taken apart, others are converted by the function, their
    Markdown in `text`. An error stands in that row, or further on in a row of its own. Where more converters are left the
    row of page -1 keeps the content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from inkwell.parsers import package as zips
        from inkwell.parsers import pdf

        for batch in batches:
            strings, numbers = (("kind", "name", "path"), ("x0", "x1", "top", "page_width"))
            tail = [("title", pa.string()), ("error_class", pa.string()), ("message", pa.string()), ("tries", batch.column(3).type), ("attempts", batch.column(4).type)]
            schema = pa.schema([("key", pa.int64()), ("doc_id", batch.column(1).type), *((n, pa.string()) for n in strings), ("content", pa.binary()), ("page", pa.int32()), ("text", pa.string()), *((n, pa.float64()) for n in numbers), *tail])
            for i in range(batch.num_rows):
                key, doc_id, data, tries, attempts = (batch.column(c)[i].as_py() for c in range(5))
                kind, info = tries[0]["name"], tries[0]["info"]
                name = info["url"] or info["local_path"] or info["filename"] or "archive.zip"
                head = {"key": key, "doc_id": doc_id, "kind": kind, "name": name}
                first = {**head, "page": -1, "tries": tries, "attempts": attempts, "content": data if len(tries) > 1 else None}
                rows, held, sent = [first], 0, False
                try:
                    if kind == "pdf":
                        rows += [{**head, "page": p, "text": t, "x0": a, "x1": b, "top": y, "page_width": w} for p, t, a, b, y, w in pdf.words(data)]
                    elif kind not in PACKAGES:
                        first["text"], first["title"] = convert(kind, data, info)
                    elif kind == "zip" and depth >= zips.DEEPEST:
                        raise ValueError("archives are nested too deep")
                    else:
                        for path, content in zips.each(data):
                            rows.append({**head, "path": path, "content": content})
                            held += len(content)
                            if held > BATCH_BYTES:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows, held, sent = [], 0, True
                except Exception as e:  # noqa: BLE001  errors are data
                    said = {"error_class": type(e).__name__, "message": str(e)}
                    rows = [{**head, **said} if sent else {**first, **said}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    named = files.select(F.monotonically_increasing_id().alias("key"), "doc_id", "content", "tries", "attempts")
    kind = lambda c: files.schema[c].dataType.simpleString()
    return named.mapInArrow(run, PARTS.format(kind("doc_id"), kind("tries"), kind("attempts")))


def converted(found: DataFrame) -> DataFrame:
    """Files that their converter has read by itself while files were taken apart."""
    own = found.where(~F.col("kind").isin(*PACKAGES) & (F.col("page") == -1))
    return own.select("key", F.when(F.col("error_class").isNull(), F.col("text")).alias("markdown"), "title", "error_class", "message")


def _finished(found: DataFrame, done: DataFrame, error: str = "nothing was found") -> DataFrame:
    """Results (key, markdown, title) of all files in parts, with the errors of those that have none."""
    every = found.groupBy("key").agg(F.max("error_class").alias("error_class"), F.max("message").alias("message"))
    ok = F.col("markdown").isNotNull() & F.col("error_class").isNull()
    kind, said = F.coalesce("error_class", F.lit("ValueError")), F.coalesce("message", F.lit(error))
    out = every.join(done, "key", "left")
    return out.select("key", F.when(ok, F.col("markdown")).alias("markdown"), F.when(ok, F.col("title")).alias("title"), F.when(~ok, kind).alias("error_class"), F.when(~ok, said).alias("message"))


def pdfs(found: DataFrame) -> DataFrame:
    """PDF words to pages: forms as tables, others as lines, pages in order with a blank line between them. Documents whose
    tables look broken are lines throughout; a file without words is an empty text."""
    words = found.where("kind = 'pdf' and error_class is null")
    laid = words_to_markdown(words.where("page >= 0").drop("doc_id").withColumnRenamed("key", "doc_id")).withColumnRenamed("doc_id", "key")
    done = words.where("page = -1").select("key").join(laid, "key", "left").select("key", F.coalesce("markdown", F.lit("")).alias("markdown"), F.lit(None).cast("string").alias("title"))
    return _finished(found.where("kind = 'pdf'"), done)


def words_to_markdown(words: DataFrame) -> DataFrame:
    """(doc_id, markdown) of words (doc_id, page, text, x0, x1, top, page_width)."""
    pages = layout.laid_pages(words).select("doc_id", "page", F.trim("plain").alias("text"), F.trim("form").alias("form"))
    pages = pages.withColumn("laid", F.coalesce("form", "text"))
    whole = pages.groupBy("doc_id").agg(ordered.in_order("laid", "page").alias("laid"), ordered.in_order("text", "page").alias("plain"), F.count("form").alias("forms"))
    text = F.when((F.col("forms") > 0) & layout.low_quality(F.col("laid")), F.col("plain")).otherwise(F.col("laid"))
    lines = whole.select("doc_id", F.posexplode(F.split(T.normalize_markdown(text), "\n")).alias("n", "line"))
    return layout.partial_numbers_joined(lines).groupBy("doc_id").agg(ordered.in_order("line", "n", sep="\n").alias("markdown"))


def books(found: DataFrame, keep_data_uris: bool = False) -> DataFrame:
    """EPUB: the container names the package document; its spine meets its manifest, chapters meet entries by path."""
    entries = found.where("kind = 'epub' and path is not null").select("key", "path", "content")
    opf = entries.where("path = 'META-INF/container.xml'").select("key", arrow.book_path("content").alias("path"))
    book = opf.join(entries, ["key", "path"], "left").select("key", "path", F.when(F.col("content").isNotNull(), F.col("content")).alias("content"))
    book = book.where("content is not null").select("key", "path", arrow.book("content").alias("b")).select("key", "path", "b.*")
    manifest = book.select(F.col("key").alias("doc_id"), F.explode("items").alias("i")).select("doc_id", "i.idref", "i.href")
    manifest = manifest.groupBy("doc_id", "idref").agg(F.last("href").alias("href"))
    spine = book.select(F.col("key").alias("doc_id"), F.posexplode("spine").alias("nth", "idref"))
    folder = F.regexp_extract("opf", r"^(.*/)", 1)
    chapters = package.spine_parts(spine, manifest).withColumnRenamed("doc_id", "key").join(book.select("key", F.col("path").alias("opf")), "key")
    chapters = chapters.select("key", "nth", F.concat(folder, "href").alias("path")).join(entries, ["key", "path"])
    page = arrow.markdown_of(keep_data_uris)(arrow.decode_text("content", F.lit("utf-8")))
    body = chapters.select("key", "nth", F.trim(page).alias("markdown")).groupBy("key").agg(ordered.in_order("markdown", "nth").alias("body"))
    told = F.filter("about", lambda a: (F.coalesce(a["value"], F.lit("")) != "") | (a["name"] == "Authors"))
    head = F.array_join(F.transform(told, lambda a: F.concat(F.lit("**"), a["name"], F.lit(":** "), a["value"])), "\n")
    done = book.where("error is null").join(body, "key", "left").select("key", F.concat_ws("\n\n", head, "body").alias("markdown"), "title")
    return _finished(found.where("kind = 'epub'"), done, "Invalid EPUB: missing META-INF/container.xml or the package document it names")


def workbooks(found: DataFrame, used: list[DataFrame]) -> DataFrame:
    """XLSX: sheets meet their parts by relationship, cells meet shared strings by place and date styles by number. Sheets and
    cells are written once; what follows reads them as often as it needs."""
    entries = found.where("kind = 'xlsx' and path is not null").select("key", "path", "content")
    part = lambda path, f: entries.where(F.col("path") == path).select("key", f("content").alias("x"))
    sheets = part("xl/workbook.xml", arrow.sheet_list).select("key", F.posexplode("x").alias("nth", "s")).select("key", "nth", "s.*")
    links = _links(entries.where("path = 'xl/_rels/workbook.xml.rels'"))
    strings = part("xl/sharedStrings.xml", arrow.shared_strings).select("key", F.posexplode("x").alias("at", "string"))
    styles = part("xl/styles.xml", arrow.date_styles).select("key", F.posexplode("x").alias("style", "is_date")).where("is_date")
    linked = package.related(sheets.select(F.col("key").alias("doc_id"), F.lit(0).alias("part_no"), "rel_id", "nth", "name", "from_1904"), links.select(F.col("key").alias("doc_id"), F.lit(0).alias("part_no"), "rel_id", "target"))
    linked = written(linked.select(F.col("doc_id").alias("key"), "nth", "name", "from_1904", F.col("target").alias("path")), "sheets")
    cells = linked.join(entries, ["key", "path"]).select("key", "nth", "from_1904", F.explode(arrow.sheet_cells("content")).alias("x")).select("key", "nth", "from_1904", "x.*")
    cells = cells.withColumn("at", F.when(F.col("kind") == "i", F.col("text").cast("int"))).join(strings, ["key", "at"], "left").join(styles, ["key", "style"], "left")
    start = F.when(F.col("from_1904"), F.expr("timestamp_ntz'1904-01-01 00:00:00'")).otherwise(F.expr("timestamp_ntz'1899-12-30 00:00:00'"))
    second = F.floor(F.round(F.col("serial") * 86400e6) / 1e6).cast("decimal(18,6)")
    text = F.when(F.col("kind") == "i", F.col("string")).when(F.col("is_date"), (start + F.make_dt_interval(secs=second)).cast("string")).otherwise(F.col("text"))
    kind = F.when(F.col("kind") == "i", "s").when(F.col("is_date"), "t").otherwise(F.col("kind"))
    cells = written(cells.select("key", "nth", "r", "c", kind.alias("kind"), F.coalesce(text, F.lit("")).alias("text")), "cells")
    laid = tables.sheet_tables(cells, ["key", "nth"])
    shown = linked.join(laid, ["key", "nth"], "left").select("key", "nth", F.concat(F.lit("## "), "name", F.lit("\n"), F.coalesce("markdown", F.lit("|\n|  |"))).alias("sheet"))
    done = shown.groupBy("key").agg(F.trim(ordered.in_order("sheet", "nth")).alias("markdown")).withColumn("title", F.lit(None).cast("string"))
    used += [linked, cells]
    return _finished(found.where("kind = 'xlsx'"), done, "the workbook names no sheets")


def archive_entries(found: DataFrame) -> DataFrame:
    """The files of archives (doc_id, content, info), doc_id being the archive's key and the path."""
    from inkwell.sources import files

    name = T.basename(F.col("path"))
    entries = found.where("kind = 'zip' and path is not null").repartition("key", "path")  # an archive's files go to many tasks
    return entries.select(F.struct("key", "path").alias("doc_id"), "content", files.info(extension=T.extension(name), filename=name).alias("info"))


def archives(found: DataFrame, converted: DataFrame) -> DataFrame:
    """Archives put together from their converted entries (doc_id, markdown, status), in alphabetical order; entries that
    were not converted are left out."""
    ok = converted.where("status = 'ok'").select("doc_id.key", "doc_id.path", "markdown")
    section = F.concat(F.lit("## File: "), "path", F.lit("\n\n"), F.trim("markdown"))
    body = ok.select("key", "path", package.alphabetical(F.col("path")).alias("place"), section.alias("section")).groupBy("key").agg(ordered.in_order("section", "place", "path").alias("body"))
    whole = found.where("kind = 'zip' and page = -1").select("key", "name").join(body, "key", "left")
    head = F.concat(F.lit("Content from the zip file `"), "name", F.lit("`:"))
    return _finished(found.where("kind = 'zip'"), whole.select("key", F.concat_ws("\n\n", head, "body").alias("markdown"), F.lit(None).cast("string").alias("title")))


def _pictured(framed: DataFrame, entries: DataFrame, keep: bool, caption: Callable[[bytes, dict], str | None] | None) -> DataFrame:
    """Shapes (kind, key, path) with `data_uri` and `said` of the media parts that pictures show: each part is met once,
    whatever number of slides show it, and bytes become text in the JVM."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    media = framed.where("kind = 'pic'").select("key", "path").distinct().join(entries, ["key", "path"])
    said = arrow.described(caption)("content", F.concat(F.lit("."), suffix)) if caption is not None else F.lit(None).cast("string")
    kind = F.coalesce(T.lookup(suffix, _KINDS), suffix)
    uri = F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.translate(F.base64("content"), "\r\n", "")) if keep else F.lit(None).cast("string")
    shown = media.select("key", "path", F.lit("pic").alias("kind"), uri.alias("data_uri"), F.nullif(said, F.lit("")).alias("said"))
    return framed.join(shown, ["key", "path", "kind"], "left")


def _links(entries: DataFrame) -> DataFrame:
    """(key, part, place, rel_id, target) of all relationships in packages, targets as paths."""
    rels = entries.where(F.col("path").rlike(r"(^|/)_rels/[^/]+\.rels$"))
    part = F.regexp_replace("path", r"(^|/)_rels/([^/]+)\.rels$", "$1$2")
    each = rels.select("key", part.alias("part"), F.posexplode(arrow.relationships("content")).alias("place", "l")).select("key", "part", "place", "l.*")
    folder = F.regexp_replace(F.regexp_extract("part", r"^(.*/)", 1), "/$", "")
    return each.select("key", "part", "place", "rel_id", F.when(F.col("external"), F.col("target")).otherwise(T.package_path(folder, F.col("target"))).alias("target"))


# Image types whose name isn't that of their files.
_KINDS = {"jpg": "jpeg", "svg": "svg+xml"}


def decks(found: DataFrame, keep_data_uris: bool = False, caption: Callable[[bytes, dict], str | None] | None = None) -> DataFrame:
    """PPTX: slides meet the presentation's relationships; shapes, groups opened, are put in reading order; charts, notes and
    pictures meet their slide's relationships. Pictures are read only if they are kept as data URIs or described."""
    entries = found.where("kind = 'pptx' and path is not null").select("key", "path", "content")
    links = _links(entries)
    of = lambda c: F.col(c).alias("doc_id")
    relations = links.select(of("key"), F.col("part").alias("part_no"), "rel_id", "target")
    listed = entries.where("path = 'ppt/presentation.xml'").select(of("key"), F.col("path").alias("part_no"), F.posexplode(arrow.slide_ids("content")).alias("nth", "rel_id"))
    listed = package.related(listed, relations).where("target is not null").select(F.col("doc_id").alias("key"), "nth", F.col("target").alias("path"))
    number = F.regexp_extract("path", r"^ppt/slides/slide(\d+)\.xml$", 1)
    stored = entries.where(number != "").select("key", number.cast("int").alias("nth"), "path").join(listed.select("key").distinct(), "key", "left_anti")
    slides = listed.unionByName(stored)
    slides = slides.withColumn("slide", F.row_number().over(W.partitionBy("key").orderBy("nth", "path"))).select("key", "slide", "path")
    shapes = slides.join(entries, ["key", "path"]).select("key", "slide", "path", F.explode(arrow.slide_shapes("content")).alias("s")).select("key", "slide", "path", "s.*")
    shapes = package.first_headings(shapes, ["key", "slide"])
    framed = package.related(shapes.withColumnsRenamed({"key": "doc_id", "path": "part_no"}), relations).withColumnsRenamed({"doc_id": "key", "target": "path"})
    charts = framed.where("kind = 'chart'").select("key", "path").distinct().join(entries, ["key", "path"]).select("key", "path", arrow.chart_parts("content").alias("chart"))
    framed = framed.join(charts, ["key", "path"], "left")
    table = lambda rows: F.when(F.size(rows) > 0, F.concat(T.markdown_table(rows), F.lit("\n"))).otherwise("")
    chart = F.when(F.col("chart.known"), package.chart_table(F.col("chart.title"), F.col("chart.names"), F.col("chart.labels"), F.col("chart.columns"))).when(~F.col("chart.known"), table(F.col("rows"))).otherwise("\n\n[unsupported chart]\n\n")
    text, inside = F.col("text"), F.size("place") > 1
    blank = T.stripped(text) == ""
    shape = F.when(inside, F.when(blank, "").otherwise(F.concat(T.stripped(text), F.lit("\n")))).when(blank, "\n").when(F.col("heading"), F.concat(F.lit("# "), F.regexp_replace(text, r"(?U)^\s+", ""), F.lit("\n"))).otherwise(F.concat(text, F.lit("\n")))
    target = T.picture_name(F.col("name"))
    if keep_data_uris or caption is not None:
        framed = _pictured(framed, entries, keep_data_uris, caption)
        text = F.when(F.col("said").isNull(), F.col("text")).otherwise(F.concat("said", F.lit(" "), "text"))
        target = F.coalesce(F.col("data_uri"), target)
    picture = F.concat(F.lit("\n!["), T.alt_text(text), F.lit("]("), target, F.lit(")\n"))
    text = F.col("text")
    piece = F.when(F.col("kind") == "sp", shape).when(F.col("kind") == "pic", picture).when(F.col("kind") == "chart", chart).when(F.col("kind") == "table", table(F.col("rows"))).otherwise(text)
    top = F.get("place", F.lit(0))
    pieces = framed.select("key", "slide", "place", top.alias("top"), inside.alias("inside"), piece.alias("piece"))
    blocks = pieces.groupBy("key", "slide", "top").agg(ordered.in_order("piece", "place", sep="").alias("block"), F.bool_or("inside").alias("group"))
    body = blocks.select("key", "slide", "top", F.when(F.col("group"), T.stripped(F.col("block"))).otherwise(F.col("block")).alias("block")).groupBy("key", "slide").agg(ordered.in_order("block", "top", sep="").alias("body"))
    noted = slides.join(links.where(F.col("target").contains("notesSlides/")).select("key", F.col("part").alias("path"), "place", "target"), ["key", "path"])
    noted = noted.groupBy("key", "slide").agg(ordered.first_by("place", "target").alias("n")).select("key", "slide", F.col("n.target").alias("path"))
    notes = noted.join(entries, ["key", "path"]).select("key", "slide", F.concat(F.lit("\n\n### Notes:\n"), arrow.note_text("content")).alias("notes"))
    whole = slides.join(body, ["key", "slide"], "left").join(notes, ["key", "slide"], "left")
    said = F.concat(F.lit("<!-- Slide number: "), F.col("slide").cast("string"), F.lit(" -->\n"), F.coalesce("body", F.lit("")), F.coalesce("notes", F.lit("")))
    done = whole.select("key", "slide", T.stripped(said).alias("said")).groupBy("key").agg(ordered.in_order("said", "slide").alias("markdown"))
    every = found.where("kind = 'pptx' and page = -1").select("key").join(done, "key", "left").select("key", F.coalesce("markdown", F.lit("")).alias("markdown"), F.lit(None).cast("string").alias("title"))
    return _finished(found.where("kind = 'pptx'"), every)
