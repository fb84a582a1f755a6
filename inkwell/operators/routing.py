"""Routing: which converters may read a file, in which order: one table of routes, compiled into one expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T

INFO = "struct<mimetype:string,extension:string,charset:string,filename:string,local_path:string,url:string>"
FIELDS = ("mimetype", "extension", "charset", "filename", "local_path", "url")
SPECIFIC, GENERIC = 0.0, 10.0


@dataclass(frozen=True)
class Route:
    """A converter and what it accepts: an extension or the start of a media type, at an address if one is given.

    `probe` names a check of the content that the parser makes when neither matches but `maybe` does.
    """

    name: str
    extensions: tuple[str, ...] = ()
    mimes: tuple[str, ...] = ()
    url: str | None = None
    maybe_extensions: tuple[str, ...] = ()
    maybe_mimes: tuple[str, ...] = ()
    magic: bool = False
    charset: bool = False
    priority: float = SPECIFIC
    #: A plugin's own rule, (content, hints) -> bool, besides the lists above; one that fails says no.
    rule: Callable[[bytes, dict], bool] | None = None


_HTML = {"extensions": (".html", ".htm"), "mimes": ("text/html", "application/xhtml")}
#: The built-in converters in their order, and the extensions and media types that each accepts.
ROUTES = [
    Route("csv", (".csv",), ("text/csv", "application/csv")),
    Route("epub", (".epub",), ("application/epub", "application/epub+zip", "application/x-epub+zip")),
    Route("msg", (".msg",), ("application/vnd.ms-outlook",), magic=True),
    Route("pdf", (".pdf",), ("application/pdf", "application/x-pdf")),
    Route("ipynb", (".ipynb",), maybe_mimes=("application/json",)),
    Route("image", (".jpg", ".jpeg", ".png", ".gif", ".webp"), ("image/jpeg", "image/png", "image/gif", "image/webp")),
    Route("audio", (".wav", ".mp3", ".m4a", ".mp4"), ("audio/x-wav", "audio/wav", "audio/mpeg", "audio/mp4", "video/mp4")),
    Route("pptx", (".pptx",), ("application/vnd.openxmlformats-officedocument.presentationml",)),
    Route("xls", (".xls",), ("application/vnd.ms-excel", "application/excel")),
    Route("xlsx", (".xlsx",), ("application/vnd.openxmlformats-officedocument.spreadsheetml",)),
    Route("docx", (".docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml",)),
    Route("bing", **_HTML, url=r"^https://www\.bing\.com/search\?q="),
    Route("youtube", **_HTML, url=r"^https://www\.youtube\.com/watch\\?\?"),
    Route("wikipedia", **_HTML, url=r"^https?://[a-zA-Z]{2,3}\.wikipedia\.org/"),
    Route("rss", (".rss", ".atom"), ("application/rss", "application/rss+xml", "application/atom", "application/atom+xml"), maybe_extensions=(".xml",), maybe_mimes=("text/xml", "application/xml")),
    Route("html", **_HTML, priority=GENERIC),
    Route("zip", (".zip",), ("application/zip",), priority=GENERIC),
    Route("text", (".txt", ".text", ".md", ".markdown", ".json", ".jsonl"), ("text/", "application/json", "application/markdown"), charset=True, priority=GENERIC),
]


@dataclass
class Registry:
    """Routes in the order in which they are tried: by priority, later registered ones first."""

    routes: list[Route] = field(default_factory=lambda: list(ROUTES))
    converters: dict[str, Callable] = field(default_factory=dict)

    def register(self, route: Route, convert: Callable[[bytes, dict], tuple[str, str | None]]) -> None:
        self.routes.insert(0, route)
        self.converters[route.name] = convert

    #: The older name of `register`.
    register_page_converter = register

    def ordered(self) -> list[Route]:
        return sorted(self.routes, key=lambda r: r.priority)


def merge(over: Column, base: Column) -> Column:
    """Field by field the first that isn't null."""
    return F.struct(*(F.coalesce(over[f], base[f]).alias(f) for f in FIELDS))


def enhanced(info: Column) -> Column:
    """A missing media type is taken from the extension, or a missing extension from the media type."""
    mime, ext = info["mimetype"], info["extension"]
    parts = {f: info[f] for f in FIELDS} | {"mimetype": F.coalesce(mime, T.mime_of(ext)), "extension": F.coalesce(ext, T.extension_of(mime))}
    return F.struct(*(parts[f].alias(f) for f in FIELDS))


def accepts(route: Route, info: Column, content: Column, ruled: Column | None = None) -> Column:
    """Whether a route may take the file; content checks that need a parser are left to it. `ruled`: what its rule says, where
    that is known."""
    ext, mime = F.lower(F.coalesce(info["extension"], F.lit(""))), F.lower(F.coalesce(info["mimetype"], F.lit("")))
    tests = [ext.isin(*route.extensions, *route.maybe_extensions)] if route.extensions or route.maybe_extensions else []
    tests += [mime.startswith(m) for m in (*route.mimes, *route.maybe_mimes)]
    if route.magic:
        tests.append((ext == "") & T.has_ole_magic(content))
    if route.charset:
        tests.append(info["charset"].isNotNull())
    if route.rule is not None:
        tests.append(_ruled(route.rule)(content, info) if ruled is None else ruled)
    out = F.lit(False)
    for t in tests:
        out = out | t
    if route.url:
        out = out & info["url"].rlike(route.url)
    return F.coalesce(out, F.lit(False))


def _says_yes(rule: Callable[[bytes, dict], bool], content: bytes | None, info: dict) -> bool:
    try:
        return content is not None and bool(rule(content, info))
    except Exception:  # noqa: BLE001  as the class says
        return False


def _ruled(rule: Callable[[bytes, dict], bool]):
    """A plugin's rule as an Arrow function of contents and hints."""

    @F.pandas_udf("boolean")
    def run(content: pd.Series, info: pd.DataFrame) -> pd.Series:
        hints = info.astype(object).where(info.notna(), None).to_dict("records")
        return pd.Series([_says_yes(rule, c, i) for c, i in zip(content, hints, strict=True)], dtype=bool)

    return run.asNondeterministic()  # asked once for each file: no later step takes the call into itself


def candidates(registry: Registry, info: Column, content: Column, ruled: dict[str, Column] | None = None) -> Column:
    """Names of the routes that may take the file, in order; one expression without Python, but for plugins' rules."""
    named = F.array(*(F.when(accepts(r, info, content, (ruled or {}).get(r.name)), F.lit(r.name)) for r in registry.ordered()))
    return F.filter(named, lambda n: n.isNotNull())


def rank_table(files: DataFrame, registry: Registry, found: Column | None = None) -> DataFrame:
    """Files (doc_id, content, info) with `tries`, array<struct<name, info>>: file by guess by converter, the first rank
    first. found: a classifier's answers as CLASSIFIED, null where it has none."""
    ruled = {r.name: _ruled(r.rule)(F.col("content"), F.col("hints")) for r in registry.ordered() if r.rule is not None}
    some = F.array(F.col("hints")) if found is None else guesses(F.col("info"), found)
    rows = files.withColumn("hints", enhanced(F.col("info")))
    rows = rows.select("doc_id", "content", "info", "hints", some.alias("guesses"), *(c.alias(f"rule{i}") for i, c in enumerate(ruled.values())))
    ruled = {n: F.col(f"rule{i}") for i, n in enumerate(ruled)}
    ranked = F.transform("guesses", lambda g: F.transform(candidates(registry, g, F.col("content"), ruled), lambda n: F.struct(n.alias("name"), g.alias("info"))))
    return rows.select("doc_id", "content", F.col("hints").alias("info"), F.flatten(ranked).alias("tries"))


CLASSIFIED = "struct<mimetype:string,extensions:array<string>,charset:string>"


def guesses(info: Column, found: Column) -> Column:
    """Hint records to try, of a file's hints and a content classifier's answer (null if it has none).

    An answer that agrees with the hints fills their gaps; one that contradicts them comes after them.
    """
    dotted = F.concat(F.lit("."), F.get(found["extensions"], F.lit(0)))
    said = F.struct(found["mimetype"].alias("mimetype"), dotted.alias("extension"), found["charset"].alias("charset"), *(info[f].alias(f) for f in ("filename", "local_path", "url")))
    other_mime = F.coalesce(info["mimetype"] != found["mimetype"], F.lit(False))
    bare = F.regexp_replace(info["extension"], r"^\.", "")
    other_ext = F.coalesce((F.size(found["extensions"]) > 0) & ~F.array_contains(found["extensions"], bare), F.lit(False))
    return F.when(found.isNull(), F.array(enhanced(info))).when(other_mime | other_ext, F.array(enhanced(info), said)).otherwise(F.array(merge(info, said)))

