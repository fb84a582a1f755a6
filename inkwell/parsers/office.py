"""Text documents and slides."""

from __future__ import annotations

import base64
import re

from inkwell.parsers import html as H
from inkwell.parsers import omml
from inkwell.parsers.package import open_zip, read
from inkwell.parsers.xmltree import Node, parse_xml


def relations(package, part: str) -> dict[str, str]:
    """Ids and targets of a part's relationships, targets as package paths; external ones as they are."""
    folder, _, name = part.rpartition("/")
    raw = read(package, f"{folder}/_rels/{name}.rels")
    out = {}
    for n in parse_xml(raw).named("Relationship") if raw else []:
        target = n.attrs.get("Target", "")
        if n.attrs.get("TargetMode") != "External":
            steps = [] if target.startswith("/") else folder.split("/")
            for step in target.strip("/").split("/"):
                if step == "..":
                    steps = steps[:-1]
                elif step != ".":
                    steps.append(step)
            target = "/".join(steps)
        out[n.attrs.get("Id", "")] = target
    return out


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


class _Document:
    """A text document as HTML: headings by style, runs, lists, tables, links, pictures, footnotes, formulas."""

    def __init__(self, data: bytes, style_map: dict[str, str] | None = None):
        self.package = open_zip(data)
        self.links = relations(self.package, "word/document.xml")
        body = read(self.package, "word/document.xml")
        if body is None:
            raise ValueError("no word/document.xml")
        self.body = parse_xml(body).one("body")
        self.styles = {}
        if raw := read(self.package, "word/styles.xml"):
            for s in parse_xml(raw).named("style"):
                name = s.kid("name")
                self.styles[s.attr("styleId")] = (name.attr("val") or "") if name is not None else ""
        self.style_map = style_map or {}
        self.ordered: dict[tuple[str, str], bool] = {}
        if raw := read(self.package, "word/numbering.xml"):
            numbering = parse_xml(raw)
            kinds = {(a.attr("abstractNumId"), level.attr("ilvl")): (level.kid("numFmt").attr("val") if level.kid("numFmt") else "") for a in numbering.named("abstractNum") for level in a.kids("lvl")}
            for num in numbering.kids("numbering")[0].kids("num") if numbering.kids("numbering") else []:
                abstract = num.kid("abstractNumId")
                for (a, level), kind in kinds.items():
                    if abstract is not None and a == abstract.attr("val"):
                        self.ordered[(num.attr("numId"), level)] = kind not in ("bullet", "none", "")
        self.notes_used: list[str] = []

    def math(self, node: Node) -> str:
        """Formulas of a part that can't be expressed stay as their text."""
        out = []
        for m in [node] if node.name == "oMath" else node.named("oMath"):
            mark = "$$" if node.name == "oMathPara" else "$"
            try:
                out.append(f"{mark}{omml.latex(m)}{mark}")
            except omml.Unsupported:
                out.append("".join(t.content() for t in m.named("t")))
        return _escape("".join(out))

    def run(self, node: Node) -> str:
        out = []
        for c in node.children:
            if c.tag == "#text":
                continue
            if c.name == "t":
                out.append(_escape(c.content()))
            elif c.name == "tab":
                out.append("\t")
            elif c.name in ("br", "cr"):
                out.append("<br>" if c.attr("type") in (None, "textWrapping") else "")
            elif c.name == "noBreakHyphen":
                out.append("‑")
            elif c.name == "footnoteReference":
                note = c.attr("id") or ""
                self.notes_used.append(note)
                out.append(f'<sup><a href="#footnote-{note}" id="footnote-ref-{note}">[{len(self.notes_used)}]</a></sup>')
            elif c.name in ("drawing", "pict"):
                out += [self.picture(c, b) for b in c.named("blip", "imagedata")]
        text = "".join(out)
        style = node.kid("rPr")
        if style is not None and text.strip():
            on = lambda n: style.kid(n) is not None and style.kid(n).attr("val") not in ("0", "false", "none")
            text = f"<em>{text}</em>" if on("i") else text
            text = f"<strong>{text}</strong>" if on("b") else text
        return text

    def picture(self, box: Node, blip: Node) -> str:
        target = self.links.get(blip.attr("embed") or blip.attr("id") or "")
        data = read(self.package, target) if target else None
        if data is None:
            return ""
        about = box.one("docPr")
        alt = (about.attrs.get("descr") or about.attrs.get("title") or "") if about is not None else ""
        kind = {"jpg": "jpeg", "svg": "svg+xml"}.get(target.rpartition(".")[2].lower(), target.rpartition(".")[2].lower())
        return f'<img alt="{_escape(alt)}" src="data:image/{kind};base64,{base64.b64encode(data).decode()}">'

    def inline(self, node: Node) -> str:
        out = []
        for c in node.children:
            if c.tag == "#text":
                continue
            if c.name == "r":
                out.append(self.run(c))
            elif c.name == "hyperlink":
                target = self.links.get(c.attr("id") or "") or (f"#{c.attr('anchor')}" if c.attr("anchor") else "")
                text = self.inline(c)
                out.append(f'<a href="{_escape(target)}">{text}</a>' if target else text)
            elif c.name in ("oMath", "oMathPara"):
                out.append(self.math(c))
            elif c.name in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
                out.append(self.inline(c))
        return re.sub(r"</(strong|em)><\1>", "", "".join(out))

    def blocks(self, node: Node) -> str:
        out: list[str] = []
        levels: list[str] = []  # open lists, outermost first

        def close(to: int) -> None:
            while len(levels) > to:
                out.append(f"</li></{levels.pop()}>")

        for c in node.children:
            if c.tag == "#text":
                continue
            if c.name == "p":
                style = c.kid("pPr")
                named = style.kid("pStyle") if style is not None else None
                name = self.styles.get(named.attr("val"), named.attr("val") or "") if named is not None else ""
                number = style.kid("numPr") if style is not None else None
                text = self.inline(c)
                if number is not None and number.kid("numId") is not None and number.kid("numId").attr("val") != "0":
                    depth = int((number.kid("ilvl").attr("val") if number.kid("ilvl") is not None else None) or 0)
                    kind = "ol" if self.ordered.get((number.kid("numId").attr("val"), str(depth)), False) else "ul"
                    if len(levels) > depth + 1 or (len(levels) == depth + 1 and levels[-1] != kind):
                        close(depth + (levels[depth] == kind))
                    if len(levels) == depth + 1:
                        out.append(f"</li><li>{text}")
                    while len(levels) <= depth:
                        levels.append(kind)
                        out.append(f"<{kind}><li>" + (text if len(levels) == depth + 1 else ""))
                    continue
                close(0)
                if not text.strip():
                    continue
                heading = re.fullmatch(r"heading ?([1-6])", name, re.I)
                tag = self.style_map.get(name) or (f"h{heading[1]}" if heading else "h1" if name.lower() == "title" else "p")
                out.append(f"<{tag}>{text}</{tag}>")
            elif c.name == "tbl":
                close(0)
                out.append(self.table(c))
            elif c.name in ("oMathPara", "oMath"):
                close(0)
                out.append(f"<p>{self.math(c)}</p>")
            elif c.name in ("sdt", "sdtContent", "ins"):
                close(0)
                out.append(self.blocks(c))
        close(0)
        return "".join(out)

    def table(self, node: Node) -> str:
        rows = []
        for r in node.kids("tr"):
            cells = []
            for c in r.kids("tc"):
                style = c.kid("tcPr")
                span = style.kid("gridSpan") if style is not None else None
                merged = style.kid("vMerge") if style is not None else None
                text = "" if merged is not None and merged.attr("val") in (None, "continue") else self.blocks(c)
                cells.append(f'<td colspan="{(span.attr("val") if span is not None else None) or 1}">{text}</td>')
            rows.append(f"<tr>{''.join(cells)}</tr>")
        return f"<table>{''.join(rows)}</table>"

    def notes(self) -> list[tuple[str, Node]]:
        raw = read(self.package, "word/footnotes.xml")
        return [(n.attr("id") or "", n) for n in (parse_xml(raw).named("footnote") if raw else []) if n.attr("id") not in ("-1", "0")]

    def html(self) -> str:
        out = self.blocks(self.body)
        known = dict(self.notes())
        items = [f'<li id="footnote-{i}">{self.blocks(known[i]).removesuffix("</p>")} <a href="#footnote-ref-{i}">↑</a></p></li>' for i in dict.fromkeys(self.notes_used) if i in known]
        return out + (f"<ol>{''.join(items)}</ol>" if items else "")


def docx(data: bytes, keep: bool = False, style_map: dict[str, str] | None = None) -> tuple[str, str | None]:
    document = _Document(data, style_map)
    text, title = H.page(document.html(), keep)
    text = re.sub(r"(\(#footnote-ref-\d+\))\n{2,}(\s*\d+\.)", r"\1\n\2", text)
    missing = []
    for i, node in document.notes():
        note = "".join(t.content() for t in node.named("t")).strip()
        if note and f"(#footnote-ref-{i})" not in text and note not in text:
            missing.append(note)
    return ("\n\n".join([text.strip(), *missing]).strip() if missing else text), title


def _cached(node: Node | None, *kinds: str) -> list[str]:
    """Cached chart points by their index."""
    for kind in kinds if node is not None else ():
        for cache in node.named(kind):
            points = sorted(cache.named("pt"), key=lambda p: int(p.attrs.get("idx", "0")))
            if points:
                return [p.attrs.get("v") or (p.one("v").content().strip() if p.one("v") is not None else "") for p in points]
    return []


def chart_parts(data: bytes) -> dict | None:
    """(title, names, labels, columns) of a chart's cached series; null without series."""
    root = parse_xml(data)
    top = root.one("chart") or root
    series = top.named("ser")
    if not series:
        return None

    def name(s: Node) -> str:
        tx = s.one("tx")
        return next(iter(_cached(tx, "strCache")), "") or (tx.content().strip() if tx is not None else "") or "Series"

    heading = next((t for box in top.kids("title") for t in ["".join(x.content() for x in box.named("t")).strip() or next(iter(_cached(box, "strCache")), "")] if t), "")
    return {"title": heading, "names": list(map(name, series)), "labels": _cached(series[0].one("cat"), "strCache", "numCache"), "columns": [_cached(s.one("val"), "numCache", "strCache") for s in series]}


def slide_ids(raw: bytes) -> list[str]:
    """The relationships of a presentation's slides, in order."""
    return [i for n in parse_xml(raw).named("sldId") if (i := n.attrs.get("r:id"))]


def note_text(raw: bytes) -> str:
    """The text of a notes part's first body."""
    tree = parse_xml(raw).one("spTree")
    for shape in tree.named("sp") if tree is not None else []:
        holder = shape.one("ph")
        if holder is None or holder.attrs.get("type", "body") == "body":
            return _Slides.text(shape)
    return ""


def slide_shapes(raw: bytes) -> list[dict]:
    """The shapes of a slide part, groups opened: kind (sp, pic, chart, table, raw), place (top, left and number of the shape
    and the groups around it), and what the kind has."""
    root = parse_xml(raw)
    tree = root.one("spTree")
    if tree is None:
        return [{"place": [], "kind": "raw", "text": "\n".join(t.content() for t in root.named("t") if t.content())}]
    out: list[dict] = []

    def walk(node: Node, around: list[dict]) -> None:
        for i, shape in enumerate(node.kids(*_Slides.SHAPES)):
            top, left = _Slides.position(shape)
            one = {"place": [*around, {"top": top, "left": left, "stored": i}]}
            if shape.name == "grpSp":
                walk(shape, one["place"])
                continue
            if shape.name == "sp":
                holder = shape.one("ph")
                one |= {"kind": "sp", "text": _Slides.text(shape), "is_title": holder is not None and holder.attrs.get("type") in ("title", "ctrTitle")}
            elif shape.name == "pic":
                about = shape.one("cNvPr")
                name = about.attrs.get("name", "image") if about is not None else "image"
                blip = shape.one("blip")
                one |= {"kind": "pic", "name": name, "text": (about.attrs.get("descr") if about is not None else None) or name, "rel_id": blip.attr("embed") if blip is not None else None}
            else:
                is_chart = any("/chart" in g.attrs.get("uri", "") for g in shape.named("graphicData")) or bool(shape.named("chart"))
                rows = [["".join(t.content() for t in c.named("t")) for c in r.named("tc")] for r in shape.named("tr")]
                one |= {"kind": "chart" if is_chart else "table", "rel_id": next((r for c in shape.named("chart") if (r := c.attrs.get("r:id"))), None), "rows": [r for r in rows if any(r)]}
            out.append(one)

    walk(tree, [])
    return out


class _Slides:
    SHAPES = ("sp", "pic", "graphicFrame", "grpSp")

    @staticmethod
    def position(shape: Node) -> tuple[int, int]:
        off = shape.one("off")

        def number(name: str) -> int:
            value = off.attrs.get(name, "0") if off is not None else "0"
            m = re.match(r"\s*([+-]?\d+)", value)
            return int(m[1]) if m else 1 << 53

        return number("y"), number("x")

    @staticmethod
    def text(shape: Node) -> str:
        box = shape.one("txBody")
        if box is not None:
            lines = ["".join(t.content() for t in p.named("t")) for p in box.named("p")]
            if any(x.strip() for x in lines):
                return "\n".join(lines)
        return "".join(t.content() for t in shape.named("t"))
