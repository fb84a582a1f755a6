"""One file at a time, as a table of one row: the same plans as for any number of files."""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, unquote_to_bytes, urlsplit

from pyspark.sql import Row, SparkSession

from inkwell.operators.routing import FIELDS, INFO, Registry
from inkwell.plans.convert import Options, convert

#: Asked of web servers first, since some can answer in Markdown themselves.
ACCEPT = "text/markdown, text/html;q=0.9, text/plain;q=0.8, */*;q=0.1"


class Unsupported(ValueError):
    """No converter takes the file."""


class Failed(ValueError):
    """Every converter that took the file went wrong; `attempts` says how."""

    def __init__(self, attempts: list[dict]):
        super().__init__("File conversion failed: " + "; ".join(f"{a['converter']}: {a['error_class']}: {a['message']}" for a in attempts))
        self.attempts = attempts


@dataclass(frozen=True)
class Result:
    markdown: str
    title: str | None = None

    def __str__(self) -> str:
        return self.markdown

    @property
    def text_content(self) -> str:
        return self.markdown


def convert_file(data: bytes, hints: dict, options: Options | None = None, registry: Registry | None = None) -> Row:
    """The result of one file: doc_id, markdown, title, converter, status, attempts. Without a session a local one starts."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
    files = spark.createDataFrame([(0, data, tuple(hints.get(f) for f in FIELDS))], f"doc_id long, content binary, info {INFO}")
    return convert(files, options, registry).first()


def extension(name: str) -> str | None:
    base = name.replace("\\", "/").rpartition("/")[2]
    return base[base.rindex(".") :].lower() if base.rfind(".") > 0 else None


class Converter:
    """`fetch` gets (url, headers) and returns (status, headers, body, final url); without it web addresses are refused."""

    def __init__(self, options: Options | None = None, registry: Registry | None = None, fetch=None):
        self.options, self.registry, self.fetch = options or Options(), registry or Registry(), fetch

    def convert(self, source, **hints) -> Result:
        """A path, an address with a scheme that is known, bytes, or an open binary file."""
        if isinstance(source, (bytes, bytearray, memoryview)):
            return self.convert_bytes(bytes(source), **hints)
        if hasattr(source, "read"):
            return self.convert_bytes(source.read(), **hints)
        if isinstance(source, os.PathLike):
            return self.convert_local(source, **hints)
        if not isinstance(source, str):
            raise TypeError(f"cannot convert {type(source).__name__}")
        return self.convert_uri(source, **hints) if source.startswith(("http:", "https:", "file:", "data:")) else self.convert_local(source, **hints)

    def convert_bytes(self, data: bytes, **hints) -> Result:
        out = convert_file(data, {k: v for k, v in hints.items() if v is not None}, self.options, self.registry)
        if out.status == "unsupported":
            raise Unsupported("no converter takes this file")
        if out.status == "failed":
            raise Failed([a.asDict() for a in out.attempts])
        return Result(out.markdown, out.title)

    def convert_local(self, path, **hints) -> Result:
        path = str(path)
        found = {"extension": extension(path), "filename": path.replace("\\", "/").rpartition("/")[2], "local_path": path}
        return self.convert_bytes(Path(path).read_bytes(), **(found | hints))

    def convert_uri(self, uri: str, **hints) -> Result:
        uri = uri.strip()
        scheme = uri.partition(":")[0].lower()
        if scheme == "file":
            part = urlsplit(uri)
            if part.netloc.lower() not in ("", "localhost"):
                raise ValueError(f"Unsupported file URI: {uri}. Host must be empty or localhost.")
            path = unquote(part.path)
            return self.convert_local(path[1:] if path[2:3] == ":" else path, **hints)
        if scheme == "data":
            head, comma, body = uri.partition(",")
            if not comma:
                raise ValueError(f"Invalid data URI: {uri[:64]}...")
            kind, *parameters = head[5:].split(";")
            charset = parameters[0].partition("=")[2] if parameters and parameters[0].lower().startswith("charset=") else None
            data = base64.b64decode(body) if "base64" in parameters else unquote_to_bytes(body)
            return self.convert_bytes(data, **({"mimetype": kind or "text/plain", "charset": charset} | hints))
        if scheme in ("http", "https"):
            if self.fetch is None:
                raise ValueError("no fetcher is configured")
            return self.convert_response(*self.fetch(uri, {"Accept": ACCEPT}), **({"url": uri} | hints))
        raise ValueError("Unsupported URI scheme. Supported: file:, data:, http:, https:")

    convert_url = convert_uri

    def convert_response(self, status: int, headers: dict[str, str], body: bytes, final_url: str, **hints) -> Result:
        if not 200 <= status < 300:
            raise ValueError(f"HTTP {status}")
        low = {k.lower(): v for k, v in headers.items()}
        kind, *parameters = low.get("content-type", "").split(";")
        charset = next((p.strip()[8:].strip() for p in parameters if p.strip().startswith("charset=")), None)
        named = next((p.strip()[9:].strip().strip("\"'") for p in low.get("content-disposition", "").split(";") if p.strip().lower().startswith("filename=")), None)
        path = urlsplit(final_url).path
        name = named or (path.rpartition("/")[2] if extension(path) else None)
        found = {"mimetype": kind.strip() or None, "charset": charset, "filename": name, "extension": extension(name) if name else None, "url": final_url}
        return self.convert_bytes(body, **(found | hints))
