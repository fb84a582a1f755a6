"""Workbooks: cells of XLSX and legacy XLS files, and the sheets' Markdown."""

from __future__ import annotations

import datetime as dt
import re
import struct

from inkwell.parsers import html as H
from inkwell.parsers.compound import Compound
from inkwell.parsers.xmltree import parse_xml

# Cell texts that mean a missing value.
MISSING = {"#N/A", "#N/A N/A", "#NA", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"}
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
Cells = dict[tuple[int, int], object]


def number_text(x: float) -> str:
    """Whole numbers plain, others rounded to 6 decimals."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    x = round(x, 6)
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)


def timestamp_text(serial: float, from_1904: bool = False) -> str:
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
    return str((start + dt.timedelta(days=serial)).replace(microsecond=0))


def _shown(value: object) -> str:
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return number_text(value)
    text = str(value)
    return "NaN" if text.strip() in MISSING else text.replace("\r\n", "\n").replace("\r", "\n").replace("\n", "\\n")


def table(cells: Cells) -> list[list[str]]:
    """Rows of texts, the first being the header, columns from A on; types are seen column by column."""
    full = {k: v for k, v in cells.items() if v not in (None, "")}
    if not full:
        return []
    top, right, bottom = min(r for r, _ in cells), max(c for _, c in full), max(r for r, _ in full)
    seen: dict[str, int] = {}
    head = []
    for c in range(right + 1):
        v = full.get((top, c))
        name = f"Unnamed: {c}" if v is None else number_text(v) if isinstance(v, float) else str(v).replace("\n", "\\n")
        seen[name] = seen.get(name, -1) + 1
        head.append(f"{name}.{seen[name]}" if seen[name] else name)
    rows = [[_shown(full[(r, c)]) if (r, c) in full else "NaN" for c in range(right + 1)] for r in range(top + 1, bottom + 1)]
    for c in range(right + 1):
        column = [re.sub(r"^0+(?=\d)", "", r[c]) if re.fullmatch(r"0\d+", r[c]) else r[c] for r in rows]
        known = [v for v in column if v != "NaN"]
        if known and all(re.fullmatch(r"-?\d+(\.\d+)?", v) for v in known) and (len(known) < len(column) or any(re.search(r"\.\d*[1-9]", v) for v in known)):
            column = [f"{v}.0" if re.fullmatch(r"-?\d+", v) else v for v in column]
        for r, v in zip(rows, column, strict=True):
            r[c] = v
    return [head, *rows]


def sheet_markdown(cells: Cells) -> str:
    rows = table(cells)
    if not rows:
        return "|\n|  |"
    paired = lambda t: t.replace("  ", "\xa0\xa0")
    return H.table_text([[(H._escape(paired(t)).replace("\\\\", "\\"), 1) for t in r] for r in rows])


def workbook_markdown(sheets: list[tuple[str, Cells]]) -> str:
    return "\n\n".join(f"## {name}\n{sheet_markdown(cells)}" for name, cells in sheets).strip()


def _at(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def date_styles(raw: bytes) -> list[bool]:
    """Whether each cell style shows numbers as dates."""
    styles = parse_xml(raw)
    own = {n.attrs.get("numFmtId"): bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.attrs.get("formatCode", "")), re.I)) for n in styles.named("numFmt")}
    formats = styles.one("cellXfs")
    return [own.get(x.attrs.get("numFmtId"), int(x.attrs.get("numFmtId", "0")) in DATE_FORMATS) for x in (formats.kids("xf") if formats else [])]


def cell_rows(raw: bytes) -> list[dict]:
    """(r, c, kind, text, serial, style) of a sheet's cells; kind: s text, i place in the string table, b, n."""
    out, row = [], -1
    for r in parse_xml(raw).named("row"):
        row = int(r.attrs.get("r", row + 2)) - 1
        column = -1
        for c in r.kids("c"):
            y, column = _at(c.attrs["r"]) if c.attrs.get("r") else (row, column + 1)
            kind, value = c.attrs.get("t", "n"), c.kid("v")
            text = value.content() if value is not None else None
            cell = {"r": y, "c": column, "kind": "s", "text": text, "serial": None, "style": None}
            if kind == "inlineStr":
                cell["text"] = "".join(t.content() for t in c.named("t"))
            elif text is None:
                continue
            elif kind == "s":
                cell["kind"] = "i"
            elif kind == "b":
                cell |= {"kind": "b", "text": str(text == "1")}
            elif kind == "n":
                cell |= {"kind": "n", "text": number_text(float(text)), "serial": float(text), "style": int(c.attrs.get("s", "0"))}
            out.append(cell)
    return out


def _rk(raw: int) -> float:
    value = float(struct.unpack("<i", struct.pack("<I", raw & 0xFFFFFFFF))[0] >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def _text(data: bytes, at: int, size: int, wide: bool) -> str:
    return data[at : at + 2 * size].decode("utf-16-le", "replace") if wide else data[at : at + size].decode("latin-1")


def _shared(chunks: list[bytes]) -> list[str]:
    """The strings of an SST record and its continuations; a string that a chunk cuts goes on with a new width flag."""
    out: list[str] = []
    part, at = 0, 8
    total = struct.unpack_from("<I", chunks[0], 4)[0]
    while len(out) < total and part < len(chunks):
        if at >= len(chunks[part]):
            part, at = part + 1, 0
            continue
        size, flags = struct.unpack_from("<HB", chunks[part], at)
        at += 3
        runs = struct.unpack_from("<H", chunks[part], at)[0] if flags & 8 else 0
        at += 2 if flags & 8 else 0
        extra = struct.unpack_from("<I", chunks[part], at)[0] if flags & 4 else 0
        at += 4 if flags & 4 else 0
        text, wide = "", bool(flags & 1)
        while True:
            fit = min(size - len(text), (len(chunks[part]) - at) // (2 if wide else 1))
            text += _text(chunks[part], at, fit, wide)
            at += fit * (2 if wide else 1)
            if len(text) >= size or part + 1 >= len(chunks):
                break
            part, at = part + 1, 1
            wide = bool(chunks[part][0] & 1)
        out.append(text)
        skip = runs * 4 + extra
        while skip and part < len(chunks):
            step = min(skip, len(chunks[part]) - at)
            at, skip = at + step, skip - step
            if skip:
                part, at = part + 1, 0
    return out


def xls(data: bytes) -> list[tuple[str, Cells]]:
    """Cells of a BIFF8 workbook stream."""
    file = Compound(data)
    stream = file.stream("Workbook") or file.stream("Book")
    if stream is None:
        raise ValueError("no workbook stream")
    records, at = [], 0
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        records.append((at, kind, stream[at + 4 : at + 4 + size]))
        at += 4 + size
    strings, sheets, formats, own = [], [], [], {}
    for i, (_, kind, body) in enumerate(records):
        if kind == 0x85:
            sheets.append((_text(body, 8, body[6], bool(body[7] & 1)), struct.unpack_from("<I", body)[0]))
        elif kind == 0x41E:
            code = _text(body, 5, struct.unpack_from("<H", body, 2)[0], bool(body[4] & 1))
            own[struct.unpack_from("<H", body)[0]] = bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I))
        elif kind == 0xE0:
            formats.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0xFC:
            more = i + 1
            while more < len(records) and records[more][1] == 0x3C:
                more += 1
            strings = _shared([r[2] for r in records[i:more]])
    out = []
    for name, begin in sheets:
        cells: Cells = {}

        def put(r, c, style, x, cells=cells):
            code = formats[style] if style < len(formats) else 0
            cells[(r, c)] = timestamp_text(x) if own.get(code, code in DATE_FORMATS) else x

        depth, last = 0, None
        for where, kind, body in records:
            if where < begin:
                continue
            if kind == 0x809:
                depth += 1
            elif kind == 0x0A:
                depth -= 1
                if depth == 0:
                    break
            if depth != 1 or len(body) < 6:
                continue
            r, c, style = struct.unpack_from("<HHH", body)
            if kind == 0xFD:
                cells[(r, c)] = strings[struct.unpack_from("<I", body, 6)[0]]
            elif kind == 0x203:
                put(r, c, style, struct.unpack_from("<d", body, 6)[0])
            elif kind == 0x27E:
                put(r, c, style, _rk(struct.unpack_from("<I", body, 6)[0]))
            elif kind == 0xBD:
                for k in range((len(body) - 6) // 6):
                    s, raw = struct.unpack_from("<HI", body, 4 + 6 * k)
                    put(r, c + k, s, _rk(raw))
            elif kind == 0x204:
                cells[(r, c)] = _text(body, 9, struct.unpack_from("<H", body, 6)[0], bool(body[8] & 1))
            elif kind == 0x205 and body[7] == 0:
                cells[(r, c)] = bool(body[6])
            elif kind == 0x06:
                last = (r, c)
                if body[12:14] != b"\xff\xff":
                    put(r, c, style, struct.unpack_from("<d", body, 6)[0])
                elif body[6] == 1:
                    cells[(r, c)] = bool(body[8])
            elif kind == 0x207 and last is not None:
                cells[last] = _text(body, 3, struct.unpack_from("<H", body)[0], bool(body[2] & 1))
        out.append((name, cells))
    return out
