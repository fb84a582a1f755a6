"""Files to Markdown: hints and routes in Catalyst, as a table of the converters that each file has left.

Texts, tables of values and notebooks are Catalyst expressions over their bytes, what else is a page is parsed row by row
beside them, in the same pass. PDF files, workbooks, e-books, presentations and archives are taken apart and put together by
Spark jobs (`packages`), in rounds: what fails goes to its next converter in the next round, and what archives hold goes
through the same plans, archives inside archives among it.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell import providers as P
from inkwell.functions import arrow
from inkwell.functions import text as T
from inkwell.operators import routing
from inkwell.operators.routing import INFO, Registry
from inkwell.parsers import charset as C
from inkwell.plans import packages
from inkwell.plans.packages import PACKAGES, words_to_markdown
from inkwell.plans.shared import deleted, written

ATTEMPT = "struct<converter:string,error_class:string,message:string>"
ATTEMPTS = f"array<{ATTEMPT}>"
TRIES = f"array<struct<name:string,info:{INFO}>>"
RESULT = ["doc_id", "markdown", "title", "converter", "status", "attempts"]
#: Converters that are expressions over the bytes of a file.
EXPRESSIONS = ("text", "csv", "ipynb")
#: Files whose bytes and results are Python objects at the same time.
ROWS = 64


_DEFAULTS = {"keep_data_uris": False, "style_map": None, "providers": None, "strict": False}


@dataclass(frozen=True)
class Options:
    """What a conversion is asked for. A field that isn't given is `...`, so that one call can set an option back."""

    keep_data_uris: bool = ...
    style_map: dict[str, str] | None = ...
    providers: P.Providers = ...
    strict: bool = ...

    def __post_init__(self):
        object.__setattr__(self, "_given", frozenset(f.name for f in fields(self) if getattr(self, f.name) is not ...))
        for f in fields(self):
            if f.name not in self._given:
                value = P.Providers() if f.name == "providers" else _DEFAULTS[f.name]
                object.__setattr__(self, f.name, value)

    def over(self, base: Options) -> Options:
        """Options of one call over those of a converter: whatever was given wins, defaults given on purpose too."""
        given = {f: getattr(base, f) for f in base._given} | {f: getattr(self, f) for f in self._given}
        return Options(**given)


def _parse(name: str, data: bytes, info: dict, options: Options, registry: Registry) -> tuple[str, str | None]:
    """One converter's result; raises what goes wrong."""
    from inkwell.parsers import compound, html, office, sheets, textual

    keep, given = options.keep_data_uris, options.providers
    page = lambda: C.decode(data, info.get("charset") or "utf-8")
    if name in registry.converters:
        return registry.converters[name](data, info)
    if name == "csv":
        return textual.csv_markdown(C.decode(data, info.get("charset"))), None
    if name == "text":
        return C.decode(data, info.get("charset")), None
    if name == "html":
        return html.page(page(), keep)
    if name == "wikipedia":
        return textual.wikipedia(page(), keep)
    if name == "bing":
        return textual.bing(page(), info["url"], keep)
    if name == "youtube":
        return textual.youtube(page(), info["url"], given.transcript, given.languages)
    if name == "rss":
        return textual.feed(page())
    if name == "ipynb":
        if (info.get("extension") or "").lower() != ".ipynb" and not textual.is_notebook(page()):
            raise textual.NotThisFormat("not a notebook")
        return textual.notebook(page())
    if name == "docx":
        return office.docx(data, keep, options.style_map)
    if name == "xls":
        return sheets.workbook_markdown(sheets.xls(data)), None
    if name == "msg":
        return compound.message(data)
    if name == "image":
        return P.image(data, info, given)
    if name == "audio":
        return P.audio(data, info, given)
    raise ValueError(f"no converter {name}")


def _try(name: str, data: bytes, info: dict, options: Options, registry: Registry) -> tuple[str, str | None]:
    """`_parse` with the charset of a text told first, and the analyzer as one more converter."""
    from inkwell.parsers.textual import NotThisFormat

    if name == "analyze":
        said = options.providers.analyze(data, info)
        if said is None:
            raise NotThisFormat("not analyzed")
        return said, None
    if info.get("charset") is None and (info.get("mimetype") or "").startswith("text/"):
        info = info | {"charset": C.detect(data, options.providers.detect_charset)}
    return _parse(name, data, info, options, registry)


def convert_one(data: bytes, tries: list[dict], options: Options, registry: Registry) -> tuple:
    """(markdown, title, converter, status, attempts) of a file that no Spark plan is for: its converters in order until one
    succeeds."""
    attempts = []
    for t in tries:
        try:
            return *_try(t["name"], data, t["info"], options, registry), t["name"], "ok", attempts
        except Exception as e:  # noqa: BLE001  errors are data: the next converter is tried
            if not _silent(type(e).__name__, t["name"], t["info"].get("extension")):
                attempts.append({"converter": t["name"], "error_class": type(e).__name__, "message": str(e)})
    return None, None, None, "failed" if attempts else "unsupported", attempts


def _silent(error: str, name: str, extension: str | None) -> bool:
    """Whether an error says that a file is of another kind, which is no failed attempt. A file named as a notebook is one."""
    return error == "NotThisFormat" and not (name == "ipynb" and (extension or "").lower() == ".ipynb")


def routed(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Files (doc_id, content, info) with their hints completed and `candidates`, the routes that may take them."""
    registry = registry or Registry()
    hinted = files.withColumn("info", routing.enhanced(F.col("info")))
    return hinted.withColumn("candidates", routing.candidates(registry, F.col("info"), F.col("content")))


def _tries(files: DataFrame, options: Options, registry: Registry, depth: int) -> DataFrame:
    """Files (doc_id, content, info) as (doc_id, content, tries): file by guess by converter, the first rank first. A
    classifier's answer gives a second guess where it contradicts the hints; an analyzer comes before all others."""
    given, found = options.providers, None
    if given.classify is not None and depth == 0:
        files = files.withColumn("found", arrow.classified(given.classify)("content"))
        found = F.when(F.col("found.known"), F.struct(*(F.col(f"found.{f}") for f in ("mimetype", "extensions", "charset"))))
    rows, tries = routing.rank_table(files, registry, found), F.col("tries")
    if given.analyze is not None:
        tries = F.concat(F.array(F.struct(F.lit("analyze").alias("name"), F.col("info").cast(INFO).alias("info"))), tries.cast(TRIES))
    tries = F.when(F.col("content").isNotNull(), tries).otherwise(F.array().cast(TRIES))
    return rows.select("doc_id", "content", tries.cast(TRIES).alias("tries"))


def _by_row(options: Options, registry: Registry):
    """A function of (content, tries, text) that gives `convert_one` of content, null for null tries, and the rows of a text
    of CSV."""
    from inkwell.parsers import textual

    kind = f"markdown string, title string, converter string, status string, attempts {ATTEMPTS}, cells array<array<string>>"
    attempt = pa.struct([(f, pa.string()) for f in ("converter", "error_class", "message")])
    table = pa.struct([*((f, pa.string()) for f in RESULT[1:5]), ("attempts", pa.list_(attempt)), ("cells", pa.list_(pa.list_(pa.string())))])
    clean = lambda x: None if x is None else x.encode("utf-8", "replace").decode()

    def one(data: bytes | None, left: list[dict] | None, text: str | None) -> dict:
        cells = None if text is None else [[clean(c) for c in row] for row in textual.csv_rows(text)]
        if left is None or data is None:
            return {"status": "unsupported", "attempts": [], "cells": cells}
        markdown, title, converter, status, attempts = convert_one(data, left, options, registry)
        attempts = [{k: clean(v) for k, v in a.items()} for a in attempts]
        return {"markdown": clean(markdown), "title": clean(title), "converter": converter, "status": status, "attempts": attempts, "cells": cells}

    def run(contents: pa.Array, tries: pa.Array, texts: pa.Array) -> pa.Array:
        """Objects of a few rows at a time: a batch holds thousands of files, whose bytes stay in Arrow's buffers till then."""
        done = []
        for at in range(0, len(contents), ROWS):
            rows = zip(*(x.slice(at, ROWS) for x in (contents, tries, texts)), strict=True)
            done.append(pa.array([one(*(v.as_py() for v in row)) for row in rows], table))
        return pa.concat_arrays(done) if done else pa.array([], table)

    return F.arrow_udf(run, kind).asNondeterministic()  # called once for each file: no later filter takes the call into itself


def _plain(info: Column) -> Column:
    """Whether a file's bytes are its text as they stand: UTF-8 without a mark."""
    own = F.lower(F.replace(F.trim(F.coalesce(info["charset"], F.lit("utf-8"))), F.lit("_"), F.lit("-")))
    marked = F.hex(F.substring("content", 1, 3)).startswith("EFBBBF") | F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    return own.isin("utf-8", "utf8") & F.is_valid_utf8("content") & ~marked


def _direct(rows: DataFrame, options: Options, registry: Registry) -> DataFrame:
    """Results of files whose converters need no other row, in one pass: contents are read once. UTF-8 texts, tables of
    values and notebooks are laid out by expressions; only what else there is goes to Python, and the fields of CSV files."""
    first = F.get("tries", F.lit(0))
    simple = [k for k in EXPRESSIONS if k not in registry.converters] if options.providers.detect_charset is None else []
    known = first["info"]["charset"].isNull() | F.lower(first["info"]["charset"]).isin(*C.CODECS)
    named = (first["name"] != "ipynb") | (F.lower(F.coalesce(first["info"]["extension"], F.lit(""))) == ".ipynb")
    rows = rows.withColumn("kind", F.when(first["name"].isin(*simple) & known & named, first["name"])).withColumn("first", first)
    rows = rows.withColumn("text", F.when(F.col("kind").isNotNull() & _plain(F.col("first.info")), F.col("content").cast("string")))
    rows = rows.withColumn("book", T.notebook_cells(F.when(F.col("kind") == "ipynb", F.col("text"))))
    easy = F.col("text").isNotNull() & ((F.col("kind") != "ipynb") | F.col("book").isNotNull())
    tries = F.col("tries")
    if options.providers.detect_charset is None:  # charsets are told by patterns in the JVM, of what isn't plain only
        says = lambda t: t["info"]["charset"].isNull() & (t["name"].isin("text", "csv") | F.coalesce(t["info"]["mimetype"].startswith("text/"), F.lit(False)))
        rows = rows.withColumn("charset", F.when(~easy & F.exists("tries", says), T.charset_of(F.col("content"))))
        tries = F.transform("tries", lambda t: F.when(says(t), t.withField("info.charset", F.col("charset"))).otherwise(t))
    rows = rows.select("doc_id", F.when(easy, F.col("kind")).alias("kind"), F.when(easy, F.col("text")).alias("text"), "book", F.when(~easy, F.col("content")).alias("content"), F.when(~easy, tries).alias("tries"))
    rows = rows.select("doc_id", "kind", "text", "book", _by_row(options, registry)("content", "tries", F.when(F.col("kind") == "csv", F.col("text"))).alias("p"))
    rows = rows.select("doc_id", "kind", "text", "book", "p", F.col("p.cells").alias("cells"))
    table = F.transform("cells", lambda r: T.fit_row(r, F.size(F.get("cells", F.lit(0)))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    lines = F.concat(F.array(line(F.get(table, F.lit(0))), T.rule_row(F.size(F.get(table, F.lit(0))))), F.transform(F.slice(table, 2, F.greatest(F.size(table), F.lit(1))), line))
    kind, own = F.col("kind"), F.col("kind").isNotNull()
    markdown = F.when(kind == "text", F.col("text")).when(kind == "ipynb", T.notebook_markdown(F.col("book"))).when(F.size("cells") > 0, F.array_join(lines, "\n")).when(own, "").otherwise(F.col("p.markdown"))
    title = F.when(kind == "ipynb", T.notebook_title(F.col("text"), F.col("book"))).when(~own | kind.isNull(), F.col("p.title"))
    attempts = F.when(own, F.array().cast(ATTEMPTS)).otherwise(F.col("p.attempts"))
    return rows.select("doc_id", markdown.alias("markdown"), title.alias("title"), F.coalesce("kind", "p.converter").alias("converter"), F.when(own, "ok").otherwise(F.col("p.status")).alias("status"), attempts.alias("attempts"))


def _put_together(found: DataFrame, kinds: set[str], options: Options, registry: Registry, depth: int, used: list[DataFrame]) -> DataFrame:
    """(key, markdown, title, error_class, message) of the files in a table of parts."""
    given = options.providers
    plans = {
        "pdf": lambda: packages.pdfs(found),
        "epub": lambda: packages.books(found, options.keep_data_uris),
        "xlsx": lambda: packages.workbooks(found, used),
        "pptx": lambda: packages.decks(found, options.keep_data_uris, given.caption),
        "zip": lambda: packages.archives(found, _results(packages.archive_entries(found), options, registry, depth + 1)),
    }
    done = packages.converted(found)
    for kind in sorted(kinds & set(PACKAGES)):
        done = done.unionByName(plans[kind]())
    return done


def _rounds(rows: DataFrame, options: Options, registry: Registry, depth: int) -> DataFrame:
    """Results of files that have a converter of PACKAGES among theirs.

    Each round takes the next converter of every file that is left: one pass over their contents writes a table of parts,
    plans put them together, and what failed and has converters left is the next round's, with the attempts it made. The
    parts are deleted as soon as a round's results are written.
    """

    def convert(name: str, data: bytes, info: dict) -> tuple[str, str | None]:
        return _try(name, data, info, options, registry)

    left, done, before = rows.select("doc_id", "content", "tries", F.array().cast(ATTEMPTS).alias("attempts")), [], []
    while True:
        found = written(packages.parts(left, convert, depth), "parts")
        deleted(*before)
        heads = found.where("page = -1")
        shapes = heads.select("kind", (F.size("tries") > 1).alias("more")).distinct().collect()  # as many as there are converters
        used: list[DataFrame] = []
        each = heads.select("key", "doc_id", "kind", F.get("tries", F.lit(0))["info"]["extension"].alias("extension"), "tries", "attempts")
        out = each.join(_put_together(found, {r.kind for r in shapes}, options, registry, depth, used), "key", "left")
        ok, last = F.col("markdown").isNotNull() & F.col("error_class").isNull(), F.size("tries") <= 1
        silent = (F.col("error_class") == "NotThisFormat") & ~((F.col("kind") == "ipynb") & (F.lower(F.coalesce("extension", F.lit(""))) == ".ipynb"))
        attempt = F.array(F.struct(F.col("kind").alias("converter"), F.coalesce("error_class", F.lit("ValueError")).alias("error_class"), F.coalesce("message", F.lit("nothing was found")).alias("message")))
        attempts = F.when(ok | F.coalesce(silent, F.lit(False)), F.col("attempts")).otherwise(F.concat("attempts", attempt))
        status = F.when(ok, "ok").when(~last, "open").when(F.size(attempts) > 0, "failed").otherwise("unsupported")
        out = out.select("key", "doc_id", F.when(ok, F.col("markdown")).alias("markdown"), F.when(ok, F.col("title")).alias("title"), F.when(ok, F.col("kind")).alias("converter"), status.alias("status"), attempts.cast(ATTEMPTS).alias("attempts"))
        out = written(out, "results", result=True)
        done.append(out.where("status <> 'open'").select(*RESULT))
        deleted(*used)
        again = out.where("status = 'open'").select("key", F.col("attempts").alias("so_far"))
        if not any(r.more for r in shapes) or again.isEmpty():
            deleted(found)
            return reduce(DataFrame.union, done)
        left = heads.join(again, "key").select("doc_id", "content", F.slice("tries", F.lit(2), F.size("tries")).alias("tries"), F.col("so_far").alias("attempts"))
        before = [found]


def _results(files: DataFrame, options: Options, registry: Registry, depth: int = 0) -> DataFrame:
    """Results of files (doc_id, content, info). Whether there are files for rounds is told by hints alone, without reading
    contents; a classifier has to read them."""
    # contents are made once, whatever makes them: an expression that isn't deterministic is not taken into later steps
    rows = _tries(files.withColumn("content", F.when(F.spark_partition_id() >= 0, F.col("content"))), options, registry, depth)
    spread = [k for k in PACKAGES if k not in registry.converters]
    packed = F.exists("tries", lambda t: t["name"].isin(*spread))
    if files.isStreaming or not spread:
        return _direct(rows, options, registry)
    if options.providers.classify is None or depth:
        hints = files.select(F.col("info").alias("i"), F.lit(None).cast("binary").alias("content"))
        may = reduce(Column.__or__, (routing.accepts(r, routing.enhanced(F.col("i")), F.col("content")) for r in registry.ordered() if r.name in spread))
        if hints.where(may).isEmpty():
            return _direct(rows, options, registry)
    return _direct(rows.where(~packed), options, registry).union(_rounds(rows.where(packed), options, registry, depth))


def told(attempts: Column) -> Column:
    """All failed attempts as one message."""
    each = F.transform(attempts, lambda a: F.concat(F.lit(" - "), a["converter"], F.lit(" threw "), a["error_class"], F.lit(": "), a["message"]))
    return F.when(F.size(attempts) > 0, F.concat(F.lit("File conversion failed after "), F.size(attempts).cast("string"), F.lit(" attempts:\n"), F.array_join(each, "\n"))).otherwise("Could not convert: no converter takes the file")


def convert(files: DataFrame, options: Options | None = None, registry: Registry | None = None) -> DataFrame:
    """(doc_id, markdown, title, converter, status, attempts) of files (doc_id, content, info), a row for each row.

    status: ok, failed (every converter that took the file went wrong; `attempts` says how) or unsupported. A null content
    is unsupported. Where hints say that there are packages their rounds run in this call, and the results are read from a
    written table until `shared.clear`; else nothing runs before the result is used. Of a stream only what needs no other
    row is left to Spark: `convert_stream` converts batch by batch.
    """
    options, registry = options or Options(), registry or Registry()
    out = _results(files, options, registry)
    if options.strict:
        ok = F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(F.concat(F.lit("not converted: "), told(F.col("attempts")))))
        out = out.withColumn("status", ok)
    return out.withColumn("markdown", T.normalize_markdown(F.col("markdown")))


def pdf_words(files: DataFrame) -> DataFrame:
    """(doc_id, page, text, x0, x1, top, page_width) of PDF files (doc_id, content); `convert` reports those that can't be
    read."""
    info = F.struct(*(F.lit(None).cast("string").alias(f) for f in routing.FIELDS))
    rows = files.select("doc_id", "content", F.array(F.struct(F.lit("pdf").alias("name"), info.alias("info"))).alias("tries"), F.array().cast(ATTEMPTS).alias("attempts"))
    return packages.parts(rows, lambda name, data, info: ("", None)).where("page >= 0").select("doc_id", "page", "text", "x0", "x1", "top", "page_width")
