"""Scalar text, path and type functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of ECMAScript's \s, as the inside of a character class; without LF for line ends.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LINE_SPACE = SPACE.replace(r"\n", "")

# Media types of file extensions, and extensions of media types.
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
MIME_BY_EXTENSION = {
    ".txt": "text/plain", ".text": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".htm": "text/html",
    ".csv": "text/csv", ".json": "application/json", ".jsonl": "application/json", ".ipynb": "application/json", ".xml": "text/xml",
    ".pdf": "application/pdf", ".docx": DOCX, ".xlsx": XLSX, ".xls": "application/vnd.ms-excel", ".pptx": PPTX,
    ".zip": "application/zip", ".epub": "application/epub+zip",
}
EXTENSION_BY_MIME = {
    "text/plain": ".txt", "text/html": ".html", "text/csv": ".csv", "application/json": ".json", "application/pdf": ".pdf", "application/zip": ".zip",
    DOCX: ".docx", XLSX: ".xlsx",
}


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value, null for other keys. The table is one map constant, made of two constant texts when the plan is
    optimized, however long it is."""
    keys, values = (F.split(F.lit("\x1e".join(x)), "\x1e") for x in (table.keys(), table.values()))
    return F.try_element_at(F.map_from_arrays(keys, values), key)


def first_prefix(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The value of the first prefix that the text starts with, null without one."""
    rows = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(v).alias("v")) for p, v in pairs))
    return F.get(F.filter(rows, lambda r: F.startswith(text, r["p"])), F.lit(0))["v"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """Lower-cased with its dot; null for names without one or with only a leading one."""
    found = F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]*)$", 1)
    return F.when(found != "", F.lower(found))


def mime_of(ext: Column) -> Column:
    return lookup(F.lower(ext), MIME_BY_EXTENSION)


def extension_of(mime: Column) -> Column:
    return lookup(mime, EXTENSION_BY_MIME)


def normalize_markdown(text: Column) -> Column:
    """Right-trimmed lines ended by LF, at most one blank line together, footnote back links next to their list."""
    text = F.regexp_replace(text, "\r\n", "\n")
    text = F.regexp_replace(text, rf"(?md)[{LINE_SPACE}]+$", "")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.regexp_replace(text, rf"(\(#footnote-ref-\d+\))\n{{2,}}([{SPACE}]*\d+\.)", "$1\n$2")


def escape_cell(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def escape_markdown(text: Column) -> Column:
    """Emphasis and code marks, and marks that would start a list, heading, rule or fence, as plain text."""
    return F.regexp_replace(F.regexp_replace(text, r"[*_`]", r"\\$0"), r"^(\+ |=+|#{1,6} |~~~)", r"\\$1")


def table_row(cells: Column) -> Column:
    """A Markdown row of array<string>."""
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(" "), escape_cell(F.coalesce(c, F.lit(""))), F.lit(" |"))), ""))


def spanning_row(cells: Column) -> Column:
    """A Markdown row of array<struct<text, colspan>>: a wide cell repeats its bar."""
    one = lambda c: F.concat(F.lit(" "), escape_cell(c["text"]), F.repeat(F.lit(" |"), F.greatest(F.lit(1), c["colspan"])))
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, one), ""))


def rule_row(width: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """A Markdown table of array<array<string>>, the first row being the header; empty text for no rows."""
    head, body = F.get(rows, F.lit(0)), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))
    table = F.concat(F.array(table_row(head), rule_row(F.size(head))), F.transform(body, table_row))
    return F.when(F.size(rows) > 0, F.array_join(table, "\n")).otherwise("")


def fit_row(row: Column, width: Column, fill: str = "") -> Column:
    """A row padded or cut to the width of its header."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(fill), width)), F.lit(1), width)


def decode_basic_entities(text: Column) -> Column:
    """&amp; first, so doubly escaped entities are decoded twice."""
    return replace_all(text, [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")])


def escape_html(text: Column) -> Column:
    return replace_all(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def pair_spaces(text: Column) -> Column:
    """Runs of spaces become pairs of no-break spaces, an odd last space stays."""
    return F.replace(text, F.lit("  "), F.lit("  "))


def show_newlines(text: Column) -> Column:
    """Line ends of any kind as a backslash and n."""
    return replace_all(text, [("\r\n", "\n"), ("\r", "\n"), ("\n", "\\n")])


def strip_leading_zeros(text: Column) -> Column:
    return F.when(text.rlike(r"^0\d+$"), F.regexp_replace(text, r"^0+(?=\d)", "")).otherwise(text)


def merge_hyphenated(text: Column) -> Column:
    """Words broken by a hyphen at the line end, if the next line starts with a lower-case letter."""
    return F.regexp_replace(text, r"-\n[^\S\n]*([a-z])", "$1")


def picture_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"[^A-Za-z0-9_]", ""), F.lit(".jpg"))


def alt_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\r\n\[\]]", " "), r"\s+", " "))


def capitalized(key: Column) -> Column:
    return F.concat(F.upper(F.substring(key, 1, 1)), F.substr(key, F.lit(2)))


def once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: The characters of SPACE themselves.
_SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def data_uri(uri: Column) -> Column:
    """struct(mimetype, charset, data) of a data: URI; null if it isn't one. charset counts only as the first parameter.

    Patterns see only what stands before the first comma, whatever length the data has, and the URI is made once.
    """
    pattern = r"(?i)^data:([^;,]+)?(?:;charset=([^;,]+))?(?:;base64)?\z"

    def parsed(uri: Column, head: Column) -> Column:
        part = lambda n: F.nullif(F.regexp_extract(head, pattern, n), F.lit(""))
        data = F.substr(uri, F.length(head) + 2)
        payload = F.when(F.contains(uri, F.lit(";base64,")), F.unbase64(data)).otherwise(F.try_url_decode(F.replace(data, F.lit("+"), F.lit("%2B"))).cast("binary"))
        fields = F.struct(F.coalesce(part(1), F.lit("text/plain")).alias("mimetype"), part(2).alias("charset"), payload.alias("data"))
        return F.when(F.contains(uri, F.lit(",")) & head.rlike(pattern), fields)

    return once(F.btrim(uri, F.lit(_SPACES)), lambda u: once(F.substring_index(u, ",", 1), lambda head: parsed(u, head)))


def file_uri_path(uri: Column) -> Column:
    """The path of a file: URI with an empty or local host, percent-decoded, without a slash before a drive; else null."""
    host, path = F.regexp_extract(uri, r"(?i)^file:(?://([^/]*))?(/.*)?$", 1), F.regexp_extract(uri, r"(?i)^file:(?://([^/?#]*))?(/[^?#]*)", 2)
    path = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    path = F.when(path.rlike("^/[A-Za-z]:"), F.substr(path, F.lit(2))).otherwise(path)
    return F.when(uri.rlike(r"(?i)^file:") & F.lower(host).isin("", "localhost"), path)


def query_value(url: Column, name: str) -> Column:
    return F.try_url_decode(F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit("")))


def has_ole_magic(content: Column) -> Column:
    return (F.length(content) >= 8) & (F.substring(content, 1, 4) == F.lit(bytes.fromhex("D0CF11E0")))


def allowed_uri(href: Column) -> Column:
    """Fragments, relative references, and the schemes http, https and file."""
    scheme = F.lower(F.regexp_extract(href, r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return href.startswith("#") | scheme.isin("", "http", "https", "file")


def wrap_html(html: Column) -> Column:
    shell = html.rlike(rf"(?i)^[{SPACE}]*(<!doctype|<html)")
    return F.when(shell, html).otherwise(F.concat(F.lit("<!DOCTYPE html><html><body>"), html, F.lit("</body></html>")))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", "")


def charset_of(content: Column) -> Column:
    """The charset of text bytes, told by marks and by whole values: UTF-8, else the pairs of multi-byte charsets."""
    from inkwell.parsers import charset

    said = F.decode(content, "ISO-8859-1")
    whole = lambda pattern: said.rlike(rf"\A{pattern}\z")
    marks = F.hex(F.substring(content, 1, 3))
    out = F.when(marks.startswith("EFBBBF"), "utf-8").when(marks.startswith("FFFE"), "utf-16le").when(marks.startswith("FEFF"), "utf-16be").when(F.is_valid_utf8(content), "utf-8")
    out = out.when(whole(charset.SHIFT_JIS) & whole(charset.LOW_SHIFT_JIS), "shift_jis").when(whole(charset.GBK), "gb18030").when(whole(charset.SHIFT_JIS), "shift_jis")
    return F.when(content.isNotNull(), out.when(whole(charset.EUC_KR), "euc-kr").otherwise("latin1"))


def charset_sample(content: Column) -> Column:
    """The bytes by which a charset is told."""
    return F.substring(content, 1, 4096)


def json_first(text: Column) -> Column:
    """The value of the first key of a JSON object; null if there is none."""
    return F.get(F.map_values(F.from_json(text, "map<string,string>")), F.lit(0))


def json_find(text: Column, key: str) -> Column:
    """The first value of a key at any depth of a JSON text that isn't null, in document order, as JSON without white space
    between its tokens; null if there is none. An object whose own key is null is not searched behind it.

    The text is cut into tokens and folded twice with a state of a few numbers: once to where the value starts, once to
    where it ends. Objects keep the order in which they are written.
    """
    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]++|\\.)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]++'), F.lit(0))
    named = F.lit('"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"')

    def first(all_: Column) -> Column:
        def step(s: Column, t: Column) -> Column:
            depth = s["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
            shut = F.when(depth < s["shut"], F.lit(1 << 30)).otherwise(s["shut"])  # the object without a value has ended
            hit = (s["at"] < 0) & (depth < shut) & (t == named) & (F.get(all_, s["i"] + 1) == ":")
            none = F.get(all_, s["i"] + 2) == "null"
            return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), F.when(hit & none, depth).otherwise(shut).alias("shut"), F.when(hit & ~none, s["i"] + 2).otherwise(s["at"]).alias("at"))

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(1 << 30).alias("shut"), F.lit(-1).alias("at"))
        return F.aggregate(all_, start, step, lambda s: s["at"])

    def value(all_: Column, at: Column) -> Column:
        def step(s: Column, t: Column) -> Column:
            depth = s["depth"] + F.when(s["i"] < at, 0).when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
            return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), F.when((s["end"] < 0) & (s["i"] >= at) & (depth == 0), s["i"] + 1).otherwise(s["end"]).alias("end"))

        end = F.aggregate(all_, F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(-1).alias("end")), step, lambda s: s["end"])
        return F.array_join(F.slice(all_, at + 1, F.greatest(end - at, F.lit(0))), "")

    once = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    return once(tokens, lambda all_: once(first(all_), lambda at: F.when(at >= 0, value(all_, at))))


def version_at_least(version: Column, least: tuple[int, ...]) -> Column:
    """Whether a dotted version is at least another one, part by part as numbers; missing parts count as 0."""
    parts = F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    own = F.slice(F.concat(parts, F.array_repeat(F.lit(0), len(least))), 1, len(least))
    return own >= F.array(*map(F.lit, least))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def package_path(folder: Column, target: Column) -> Column:
    """Where a relationship of a part in a folder leads inside its package."""
    start = F.when(target.startswith("/") | (folder == ""), F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    steps = F.filter(F.split(target, "/"), lambda s: s != "")
    go = lambda at, s: F.when(s == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).when(s == ".", at).otherwise(F.concat(at, F.array(s)))
    return F.array_join(F.aggregate(steps, start, go), "/")


def notebook_cells(text: Column) -> Column:
    """The cells of a notebook as array<struct<kind, source>>; null for what isn't JSON with a list of cells."""
    cells = F.try_variant_get(F.try_parse_json(text), "$.cells", "array<variant>")
    lines = lambda c: F.array_join(F.try_variant_get(c, "$.source", "array<string>"), "")
    source = lambda c: F.coalesce(lines(c), F.try_variant_get(c, "$.source", "string"), F.lit(""))
    return F.transform(cells, lambda c: F.struct(F.try_variant_get(c, "$.cell_type", "string").alias("kind"), source(c).alias("source")))


def notebook_markdown(cells: Column) -> Column:
    """Markdown cells as they are, code cells fenced as python, raw cells fenced; outputs are left out."""
    fenced = lambda c, mark: F.concat(F.lit(f"```{mark}\n"), c["source"], F.lit("\n```"))
    part = lambda c: F.when(c["kind"] == "markdown", c["source"]).when(c["kind"] == "code", fenced(c, "python")).when(c["kind"] == "raw", fenced(c, ""))
    return F.array_join(F.transform(cells, part), "\n\n")


def notebook_title(text: Column, cells: Column) -> Column:
    """The title in the notebook's metadata, else the first heading line of its markdown cells."""
    lines = F.flatten(F.transform(F.filter(cells, lambda c: c["kind"] == "markdown"), lambda c: F.split(c["source"], "\n")))
    first = F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0))
    own = F.nullif(F.try_variant_get(F.try_parse_json(text), "$.metadata.title", "string"), F.lit(""))
    return F.coalesce(own, stripped(F.substr(first, F.lit(3))))
