"""CSV, notebooks, feeds, and pages of known sites."""

from __future__ import annotations

import base64
import json
import re
from urllib.parse import parse_qs, urlsplit

from inkwell.parsers import html as H
from inkwell.parsers.xmltree import parse_xml


class NotThisFormat(ValueError):
    """The bytes are not what the converter reads."""


def csv_rows(text: str) -> list[list[str]]:
    """Commas and line ends outside quotes cut; quotes may begin anywhere in a field; a lone CR outside quotes goes."""
    rows, row, field, quoted = [], [], [], False
    for m in re.finditer(r'""|"|,|\r\n|\n|\r|[^",\r\n]+', text):
        t = m[0]
        if quoted:
            if t == '""':
                field.append('"')
            elif t == '"':
                quoted = False
            else:
                field.append(t)
        elif t == '""':
            pass  # opens and closes at once
        elif t == '"':
            quoted = True
        elif t == ",":
            row.append("".join(field))
            field = []
        elif t in ("\n", "\r\n"):
            rows.append([*row, "".join(field)])
            row, field = [], []
        elif t != "\r":
            field.append(t)
    if field or row or quoted:
        rows.append([*row, "".join(field)])
    return rows


def csv_markdown(text: str) -> str:
    rows = csv_rows(text)
    if not rows:
        return ""
    width = len(rows[0])
    line = lambda r: "| " + " | ".join((r + [""] * width)[:width]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def notebook(text: str) -> tuple[str, str | None]:
    """Markdown cells as they are, code cells fenced as python, raw cells fenced; outputs are left out."""
    book = json.loads(text)
    parts, title = [], None
    for cell in book.get("cells") or []:
        source = cell.get("source") or ""
        source = "".join(source) if isinstance(source, list) else source
        kind = cell.get("cell_type")
        if kind == "markdown":
            parts.append(source)
            if title is None:
                title = next((x.removeprefix("# ").strip() for x in source.split("\n") if x.startswith("# ")), None)
        elif kind == "code":
            parts.append(f"```python\n{source}\n```")
        elif kind == "raw":
            parts.append(f"```\n{source}\n```")
    return "\n\n".join(parts), (book.get("metadata") or {}).get("title") or title


def is_notebook(text: str) -> bool:
    return "nbformat" in text and "nbformat_minor" in text


# Entities that feeds hide their HTML behind, in the order in which they are decoded.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]


def _feed_body(text: str) -> str:
    text = text.strip()
    for old, new in ENTITIES:
        text = text.replace(old, new)
    root = H.parse(text if "<" in text else f"<p>{text}</p>")
    return H.to_markdown(H.body_of(root))


def feed_kind(text: str) -> str | None:
    try:
        root = parse_xml(text)
    except ValueError:
        return None
    if root.first("rss") is not None:
        return "rss"
    feed = root.first("feed")
    return "atom" if feed is not None and feed.first("entry") is not None else None


def feed(text: str) -> tuple[str, str | None]:
    root = parse_xml(text)
    kind = feed_kind(text)
    if kind is None:
        raise NotThisFormat("Unknown feed type")
    top = root.first("feed") if kind == "atom" else root.first("rss").first("channel")
    if top is None:
        raise NotThisFormat("No channel found in RSS feed")
    names = ("subtitle", "entry", "updated", "Updated on", "summary", ("content",)) if kind == "atom" else ("description", "item", "pubDate", "Published on", "description", ("content:encoded", "encoded"))
    about, entry, date, said, summary, contents = names
    title = top.text_of("title")
    out = (f"# {title}\n" if title else "") + (f"{x}\n" if (x := top.text_of(about)) else "")
    for node in top.all(entry):
        if x := node.text_of("title"):
            out += f"\n## {x}\n"
        if x := node.text_of(date):
            out += f"{said}: {x}\n"
        if x := node.text_of(summary):
            out += _feed_body(x)
        if x := next((t for c in contents if (t := node.text_of(c)) is not None), None):
            out += _feed_body(x)
    return out.strip(), title


def wikipedia(html: str, keep: bool = False) -> tuple[str, str | None]:
    root = H.without_scripts(H.parse(html))
    title = H.title(root)
    body = next((n for n in root.walk() if n.attrs.get("id") == "mw-content-text"), None)
    if body is None:
        return H.to_markdown(H.body_of(root), keep).strip(), title
    heads = root.with_class("mw-page-title-main")
    if heads and heads[0].content():
        title = heads[0].content().strip()
    return f"# {title if title is not None else 'Wikipedia'}\n\n{H.to_markdown(body, keep)}".strip(), title


def bing_target(href: str) -> str:
    """The address behind a redirect: base64url after two characters of parameter u."""
    try:
        hidden = parse_qs(urlsplit(href).query).get("u")
        if not hidden:
            return href
        raw = hidden[0][2:].strip().replace("-", "+").replace("_", "/")
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True).decode("latin-1")
    except ValueError:
        return href


def bing(html: str, url: str, keep: bool = False) -> tuple[str, str | None]:
    root = H.parse(html)
    asked = parse_qs(urlsplit(url).query, keep_blank_values=True).get("q", [""])[0]
    for node in root.with_class("tptt"):
        if node.content():
            node.children = []
            node.add(H.Node("#text", text=node.content() + " "))
    for node in root.with_class("algoSlug_icon"):
        node.remove()
    found = []
    for hit in root.with_class("b_algo"):
        for a in hit.all("a"):
            href = a.attrs.get("href")
            if href and re.search(r"bing\.com/ck/a", href, re.I):
                text = a.content()
                a.tag, a.attrs, a.children = "span", {}, []
                a.add(H.Node("#text", text=text))
            elif href:
                a.attrs["href"] = bing_target(href)
        lines = [x.strip() for x in H.to_markdown(hit, keep).strip().split("\n")]
        if any(lines):
            found.append("\n".join(filter(None, lines)))
    return f"## A Bing search for '{asked}' found the following results:\n\n" + "\n\n".join(found), H.title(root)


def _values(value, key: str):
    if isinstance(value, list):
        for v in value:
            yield from _values(v, key)
    elif isinstance(value, dict):
        for k, v in value.items():
            if k == key:
                yield v
                return
            yield from _values(v, key)


def find_key(value, key: str):
    """The first value of a key that isn't null, in document order, at any depth."""
    return next((v for v in _values(value, key) if v is not None), None)


def youtube(html: str, url: str, transcript=None, languages: tuple[str, ...] = ("en",)) -> tuple[str, str | None]:
    root = H.parse(html)
    page = H.title(root)
    meta = {"title": page} if page else {}
    for node in root.all("meta"):
        key = next((node.attrs[a] for a in ("itemprop", "property", "name") if node.attrs.get(a) and node.attrs.get("content")), None)
        if key:
            meta[key] = node.attrs["content"]
    for script in root.all("script"):
        m = re.search(r"var ytInitialData = (\{.*?\});", script.content(), re.S)
        if m:
            try:
                said = find_key(json.loads(m[1]), "attributedDescriptionBodyText")
                if isinstance(said, dict) and isinstance(said.get("content"), str):
                    meta["description"] = said["content"]
            except ValueError:
                pass
            break
    pick = lambda *keys: next((meta[k] for k in keys if meta.get(k)), None)
    title, about = pick("title", "og:title", "name"), pick("description", "og:description")
    out = "# YouTube\n" + (f"\n## {title}\n" if title else "")
    stats = "".join(f"- **{name}:** {v}\n" for name, key in (("Views", "interactionCount"), ("Keywords", "keywords"), ("Runtime", "duration")) if (v := pick(key)))
    out += (f"\n### Video Metadata\n{stats}\n" if stats else "") + (f"\n### Description\n{about}\n" if about else "")
    video = parse_qs(urlsplit(url).query).get("v")
    if transcript is not None and video:
        try:
            words = transcript(video[0], list(languages))
        except Exception:  # noqa: BLE001  a transcript is an extra
            words = None
        out += f"\n### Transcript\n{words}\n" if words else ""
    return out.strip(), title or page
