"""Document services: which file goes to which analyzer, requests through an injected client, results as Markdown."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import text as T

# File types with their modality, extensions and media types.
FILE_TYPES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "pdf": ("document", (".pdf",), ("application/pdf", "application/x-pdf")),
    "docx": ("document", (".docx",), (T.DOCX,)),
    "pptx": ("document", (".pptx",), ("application/vnd.openxmlformats-officedocument.presentationml",)),
    "xlsx": ("document", (".xlsx",), (T.XLSX,)),
    "html": ("document", (".html", ".htm"), ("text/html", "application/xhtml+xml")),
    "txt": ("document", (".txt",), ("text/plain",)),
    "md": ("document", (".md", ".markdown"), ("text/markdown",)),
    "rtf": ("document", (".rtf",), ("text/rtf", "application/rtf")),
    "xml": ("document", (".xml",), ("text/xml", "application/xml")),
    "eml": ("document", (".eml",), ("message/rfc822",)),
    "msg": ("document", (".msg",), ("application/vnd.ms-outlook",)),
    "jpeg": ("image", (".jpg", ".jpeg", ".jpe"), ("image/jpeg",)),
    "png": ("image", (".png",), ("image/png",)),
    "bmp": ("image", (".bmp",), ("image/bmp",)),
    "tiff": ("image", (".tif", ".tiff"), ("image/tiff",)),
    "heif": ("image", (".heif", ".heic"), ("image/heif", "image/heic")),
    "mp4": ("video", (".mp4",), ("video/mp4",)),
    "m4v": ("video", (".m4v",), ("video/x-m4v",)),
    "mov": ("video", (".mov",), ("video/quicktime",)),
    "avi": ("video", (".avi",), ("video/x-msvideo",)),
    "mkv": ("video", (".mkv",), ("video/x-matroska",)),
    "webm": ("video", (".webm",), ("video/webm",)),
    "flv": ("video", (".flv",), ("video/x-flv",)),
    "wmv": ("video", (".wmv",), ("video/x-ms-wmv",)),
    "wav": ("audio", (".wav",), ("audio/wav", "audio/x-wav")),
    "mp3": ("audio", (".mp3",), ("audio/mpeg", "audio/mp3")),
    "m4a": ("audio", (".m4a",), ("audio/mp4", "audio/m4a", "audio/x-m4a")),
    "flac": ("audio", (".flac",), ("audio/flac", "audio/x-flac")),
    "ogg": ("audio", (".ogg",), ("audio/ogg",)),
    "aac": ("audio", (".aac",), ("audio/aac",)),
    "wma": ("audio", (".wma",), ("audio/x-ms-wma",)),
}
# Media types that stand for others, and the analyzers by modality.
MIME_ALIASES = {"audio/x-wav": "audio/wav", "audio/x-flac": "audio/flac", "audio/x-m4a": "audio/mp4", "video/x-m4v": "video/mp4"}
ANALYZERS = {"document": "prebuilt-documentSearch", "image": "prebuilt-documentSearch", "video": "prebuilt-videoSearch", "audio": "prebuilt-audioSearch"}
# Prebuilt analyzers for other things than documents.
ANALYZER_MODALITY = {
    "prebuilt-image": "image", "prebuilt-imageSearch": "image", "prebuilt-audio": "audio", "prebuilt-audioSearch": "audio", "prebuilt-callCenter": "audio",
    "prebuilt-video": "video", "prebuilt-videoSearch": "video", "prebuilt-videoSynopsis": "video",
}


def canonical_mime(mime: Column) -> Column:
    clean = F.lower(F.trim(F.split_part(F.coalesce(mime, F.lit("")), F.lit(";"), F.lit(1))))
    return F.coalesce(T.lookup(clean, MIME_ALIASES), clean)


def file_type(extension: Column, mime: Column, allowed: list[str] | None = None) -> Column:
    """The service's file type: by extension, else by media type; null if none of the allowed ones fits."""
    allowed = list(FILE_TYPES) if allowed is None else allowed
    by_ext = T.lookup(F.lower(extension), {e: t for t in allowed for e in FILE_TYPES[t][1]})
    by_mime = T.first_prefix(canonical_mime(mime), [(m, t) for t in FILE_TYPES if t in allowed for m in FILE_TYPES[t][2]])
    return F.coalesce(by_ext, by_mime)


def modality(kind: Column) -> Column:
    return T.lookup(kind, {t: m for t, (m, _, _) in FILE_TYPES.items()})


def content_type(kind: Column, mime: Column) -> Column:
    """The given media type if it fits the file type, else the type's first one."""
    clean = canonical_mime(mime)
    fits = T.first_prefix(F.concat_ws(" ", kind, clean), [(f"{t} {m}", "yes") for t, (_, _, mimes) in FILE_TYPES.items() for m in mimes]).isNotNull()
    first = T.lookup(kind, {t: MIME_ALIASES.get(m[0], m[0]) for t, (_, _, m) in FILE_TYPES.items()})
    return F.when(fits, clean).otherwise(F.coalesce(first, F.nullif(clean, F.lit("")), F.lit("application/octet-stream")))


def analyzer(kind: Column, own: str | None = None, own_modality: str | None = None) -> Column:
    """One's own analyzer where it fits the file's modality (documents include pictures), else the prebuilt one."""
    prebuilt = F.coalesce(T.lookup(modality(kind), ANALYZERS), F.lit(ANALYZERS["document"]))
    if own is None:
        return prebuilt
    own_modality = own_modality or ANALYZER_MODALITY.get(own, "document")
    fits = modality(kind).isin("document", "image") if own_modality == "document" else modality(kind) == own_modality
    return F.when(fits, F.lit(own)).otherwise(prebuilt)


#: The file types that the document service reads.
DOCUMENT_TYPES = ("docx", "pptx", "xlsx", "html", "pdf", "jpeg", "png", "bmp", "tiff")


def file_type_here(info: dict, allowed: tuple[str, ...] | None = None) -> str | None:
    """`file_type` for one file in Python."""
    allowed = tuple(FILE_TYPES) if allowed is None else allowed
    ext, mime = (info.get("extension") or "").lower(), (info.get("mimetype") or "").partition(";")[0].strip().lower()
    mime = MIME_ALIASES.get(mime, mime)
    by_ext = next((t for t in allowed if ext in FILE_TYPES[t][1]), None)
    return by_ext or next((t for t in FILE_TYPES if t in allowed and mime and any(mime.startswith(m) for m in FILE_TYPES[t][2])), None)


def auth_headers(key: str | None = None, provider: Callable[[], dict[str, str]] | None = None, default: Callable[[], dict[str, str]] | None = None) -> dict[str, str]:
    """Headers of the first credential there is: a key, a provider, AZURE_API_KEY, a default identity. None is an error."""
    import os

    key = key or (None if provider else os.environ.get("AZURE_API_KEY"))
    found = {"Ocp-Apim-Subscription-Key": key} if key else provider() if provider else default() if default else {}
    if not found:
        raise PermissionError("no credential: give a key or a provider, or set AZURE_API_KEY")
    return found


def _flat(fields) -> dict:
    """Field values: `value` if there is one, else `content`, else the field itself."""
    if not isinstance(fields, dict):
        return {}
    return {k: v["value"] if isinstance(v, dict) and "value" in v else v["content"] if isinstance(v, dict) and "content" in v else v for k, v in fields.items()}


def _yaml(key: str, value) -> str:
    if isinstance(value, str):
        quoted = value.replace("\\", "\\\\").replace('"', '\\"')
        return f'{key}: "{quoted}"'
    return f"{key}: {json.dumps(value, ensure_ascii=False, separators=(',', ':'))}"


def result_markdown(result: dict) -> str:
    """An analysis as YAML front matter and its texts; later fields win, pages are marked by comments."""
    inner, items = result.get("analyzeResult") or {}, [c for c in result.get("contents") or [] if isinstance(c, dict)]
    fields: dict = {}
    for part in (result, inner, *items):
        fields |= _flat(part.get("fields"))
    texts = [(result.get(k), None) for k in ("markdown", "content")] + [(inner.get(k), None) for k in ("content", "markdown")]
    texts += [(c.get(k), c.get("pageNumber")) for c in items for k in ("markdown", "text", "content")]
    said = [t.strip() if page in (None, "") else f"<!-- Page {page} -->\n\n{t.strip()}" for t, page in texts if isinstance(t, str) and t.strip()]
    parts = (["---\n" + "\n".join(_yaml(k, v) for k, v in fields.items()) + "\n---"] if fields else []) + (["\n\n".join(said)] if said else [])
    return "\n\n".join(parts).strip() if parts else "```yaml\n" + json.dumps(result, indent=2, ensure_ascii=False) + "\n```"


def markdown_of(result: Column) -> Column:
    """`result_markdown` of JSON texts as an expression: fields as YAML front matter, later ones winning in the place of the
    first, then the texts with their pages."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  computed once, however often f names it
    of = lambda text, path: F.get_json_object(text, path)

    def line(name: Column, entries: Column) -> Column:
        """`value` if the field has one, else `content`, else the field itself; texts in quotes, others as JSON."""
        field = F.element_at(F.filter(entries, lambda e: e["key"] == name), -1)["value"]
        flat = lambda v: F.coalesce(F.try_variant_get(v, "$.value", "variant"), F.try_variant_get(v, "$.content", "variant"), v)
        quoted = lambda v: F.concat(F.lit('"'), F.replace(F.replace(v.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        shown = once(field, lambda v: once(flat(v), lambda x: F.when(F.schema_of_variant(x) == "STRING", quoted(x)).otherwise(F.to_json(x))))
        return F.concat(name, F.lit(": "), shown)

    def front(entries: Column) -> Column:
        lines = F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda name: line(name, entries))
        return F.when(F.size(entries) > 0, F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---")))

    def whole(text: Column, items: Column) -> Column:
        maps = F.filter(F.concat(F.array(of(text, "$.fields"), of(text, "$.analyzeResult.fields")), F.transform(items, lambda c: of(c, "$.fields"))), lambda m: m.isNotNull())
        entries = F.flatten(F.filter(F.transform(maps, lambda m: F.map_entries(F.from_json(m, "map<string,variant>"))), lambda e: e.isNotNull()))
        given = lambda t: F.when(t != "", t)
        page = lambda c: F.coalesce(F.concat(F.lit("<!-- Page "), of(c, "$.pageNumber"), F.lit(" -->\n\n")), F.lit(""))
        paged = lambda c, k: once(F.trim(of(c, f"$.{k}")), lambda t: F.when(t != "", F.concat(page(c), t)))
        own = F.array(*(once(F.trim(of(text, p)), given) for p in ("$.markdown", "$.content", "$.analyzeResult.content", "$.analyzeResult.markdown")))
        texts = F.concat(own, F.flatten(F.transform(items, lambda c: F.array(*(paged(c, k) for k in ("markdown", "text", "content"))))))
        said = F.nullif(F.array_join(texts, "\n\n"), F.lit(""))
        return F.coalesce(F.nullif(F.concat_ws("\n\n", once(entries, front), said), F.lit("")), F.concat(F.lit("```yaml\n"), text, F.lit("\n```")))

    items = lambda text: F.coalesce(F.from_json(of(text, "$.contents"), "array<string>"), F.array().cast("array<string>"))
    return once(result, lambda text: once(items(text), lambda i: whole(text, i)))


#: A client sends (method, url, headers, body) and returns (status, headers, body); it is injected and must be picklable.
Client = Callable[[str, str, dict[str, str], bytes | None], tuple[int, dict[str, str], bytes]]


@dataclass(frozen=True)
class Service:
    """An analysis service: submit, then poll the address it names; files of other types are left to other converters.

    `submit` gives the address for a file type. `auth` gives headers and is called on the executor, so that no secret gets
    into a plan.
    """

    submit: Callable[[str], str]
    client: Client
    auth: Callable[[], dict[str, str]] = auth_headers
    polls: int = 60
    wait: float = 1.0
    markdown: Callable[[dict], str] = result_markdown
    types: tuple[str, ...] = tuple(FILE_TYPES)

    def __call__(self, data: bytes, info: dict) -> str | None:
        kind = file_type_here(info, self.types)
        if kind is None:
            return None
        auth, mime = self.auth(), (info.get("mimetype") or "").partition(";")[0].strip().lower()
        mime = MIME_ALIASES.get(mime, mime)
        fits = any(mime.startswith(m) for m in FILE_TYPES[kind][2])
        status, heads, _ = self.client("POST", self.submit(kind), auth | {"Content-Type": mime if fits else FILE_TYPES[kind][2][0]}, data)
        where = {k.lower(): v for k, v in heads.items()}.get("operation-location")
        if status not in (200, 201, 202) or not where:
            raise RuntimeError(f"the service answered {status}")
        for _ in range(self.polls):
            _, _, body = self.client("GET", where, auth, None)
            answer = json.loads(body)
            state = str(answer.get("status", "")).lower()
            if state == "succeeded":
                return self.markdown(answer.get("result") or answer.get("analyzeResult") or answer)
            if state in ("failed", "canceled"):
                raise RuntimeError(f"the analysis {state}")
            time.sleep(self.wait)
        raise TimeoutError("the analysis took too long")


def without_comments(result: dict) -> str:
    """The content of a document analysis without HTML comments."""
    return re.sub(r"<!--.*?-->", "", result.get("content") or "", flags=re.S)


def document_service(endpoint: str, client: Client, auth: Callable[[], dict[str, str]] = auth_headers, model: str = "prebuilt-layout", version: str = "2024-11-30", types: tuple[str, ...] = DOCUMENT_TYPES) -> Service:
    url = f"{endpoint.rstrip('/')}/documentintelligence/documentModels/{model}:analyze?api-version={version}&outputContentFormat=markdown"
    return Service(lambda kind: url, client, auth, 60, 1.0, without_comments, types)


def content_service(endpoint: str, client: Client, auth: Callable[[], dict[str, str]] = auth_headers, own: str | None = None, version: str = "2025-05-01-preview", types: tuple[str, ...] = tuple(FILE_TYPES)) -> Service:
    """One's own analyzer serves the modality that its name stands for, documents including pictures."""

    def address(kind: str) -> str:
        what, serves = FILE_TYPES[kind][0], ANALYZER_MODALITY.get(own or "", "document")
        fits = own is not None and (what == serves or (serves == "document" and what == "image"))
        return f"{endpoint.rstrip('/')}/contentunderstanding/analyzers/{own if fits else ANALYZERS[what]}:analyze?api-version={version}"

    return Service(address, client, auth, 120, 2.0, types=types)
