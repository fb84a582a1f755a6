"""Small writers of the formats that the engine reads, for round trips in queries and tests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zip_bytes(entries: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, content in entries.items():
            package.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def _links(targets: dict[str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Target={quoteattr(t)}/>' for i, t in targets.items()) + "</Relationships>"


def xlsx_bytes(sheets: dict[str, list[list[object]]]) -> bytes:
    files, book = {}, ""
    for n, (name, rows) in enumerate(sheets.items(), 1):
        book += f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>'
        body = ""
        for r, row in enumerate(rows, 1):
            cells = ""
            for c, v in enumerate(row):
                ref = f"{chr(65 + c)}{r}"
                if isinstance(v, (int, float)):
                    cells += f'<c r="{ref}"><v>{v!r}</v></c>'
                elif v is not None:
                    cells += f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
            body += f'<row r="{r}">{cells}</row>'
        files[f"xl/worksheets/sheet{n}.xml"] = f"<worksheet><sheetData>{body}</sheetData></worksheet>"
    files["xl/workbook.xml"] = f'<workbook xmlns:r="{R}"><sheets>{book}</sheets></workbook>'
    files["xl/_rels/workbook.xml.rels"] = _links({f"rId{n}": f"worksheets/sheet{n}.xml" for n in range(1, len(sheets) + 1)})
    return zip_bytes(files)


def docx_bytes(body: str, **parts: str) -> bytes:
    """A document from the inner XML of its body; further parts by their names in word/."""
    space = 'xmlns:w="w" xmlns:m="m" xmlns:r="r"'
    files = {"word/document.xml": f"<w:document {space}><w:body>{body}</w:body></w:document>"}
    return zip_bytes(files | {f"word/{k}.xml": v for k, v in parts.items()})


def paragraph(text: str, style: str | None = None) -> str:
    kind = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{kind}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"


def shape(text: str, kind: str | None = None, top: int = 0, left: int = 0) -> str:
    holder = f'<p:nvPr><p:ph type="{kind}"/></p:nvPr>' if kind else "<p:nvPr/>"
    lines = "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in text.split("\n"))
    return f'<p:sp><p:nvSpPr>{holder}</p:nvSpPr><p:spPr><a:xfrm><a:off x="{left}" y="{top}"/></a:xfrm></p:spPr><p:txBody>{lines}</p:txBody></p:sp>'


def slide_table(rows: list[list[str]], top: int = 0) -> str:
    body = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{escape(c)}</a:t></a:r></a:p></a:txBody></a:tc>" for c in r) + "</a:tr>" for r in rows)
    return f'<p:graphicFrame><p:xfrm><a:off x="0" y="{top}"/></p:xfrm><a:graphic><a:graphicData uri="table"><a:tbl>{body}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'


def chart_xml(title: str, labels: list[str], series: dict[str, list[float]]) -> str:
    points = lambda values: "".join(f'<c:pt idx="{i}"><c:v>{escape(str(v))}</c:v></c:pt>' for i, v in enumerate(values))
    body = "".join(
        f"<c:ser><c:tx><c:strRef><c:strCache>{points([n])}</c:strCache></c:strRef></c:tx><c:cat><c:strRef><c:strCache>{points(labels)}</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache>{points(v)}</c:numCache></c:numRef></c:val></c:ser>"
        for n, v in series.items()
    )
    return f'<c:chartSpace xmlns:c="c" xmlns:a="a"><c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>{escape(title)}</a:t></a:r></a:p></c:rich></c:tx></c:title><c:plotArea><c:barChart>{body}</c:barChart></c:plotArea></c:chart></c:chartSpace>'


def slide_chart(link: str, top: int = 0) -> str:
    return f'<p:graphicFrame><p:xfrm><a:off x="0" y="{top}"/></p:xfrm><a:graphic><a:graphicData uri="x/chart"><c:chart xmlns:c="c" r:id="{link}"/></a:graphicData></a:graphic></p:graphicFrame>'


def pptx_bytes(slides: list[str], notes: dict[int, str] | None = None, charts: dict[int, str] | None = None) -> bytes:
    """Slides from the inner XML of their shape trees; notes and charts (rId9) by slide number from 1."""
    files = {"ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{R}"><p:sldIdLst>' + "".join(f'<p:sldId r:id="rId{n}"/>' for n in range(1, len(slides) + 1)) + "</p:sldIdLst></p:presentation>"}
    files["ppt/_rels/presentation.xml.rels"] = _links({f"rId{n}": f"slides/slide{n}.xml" for n in range(1, len(slides) + 1)})
    for n, tree in enumerate(slides, 1):
        files[f"ppt/slides/slide{n}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a" xmlns:r="{R}"><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>'
        links = {}
        if notes and n in notes:
            links["rId8"] = f"../notesSlides/notesSlide{n}.xml"
            files[f"ppt/notesSlides/notesSlide{n}.xml"] = f'<p:notes xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{shape(notes[n], "body")}</p:spTree></p:cSld></p:notes>'
        if charts and n in charts:
            links["rId9"] = f"../charts/chart{n}.xml"
            files[f"ppt/charts/chart{n}.xml"] = charts[n]
        if links:
            files[f"ppt/slides/_rels/slide{n}.xml.rels"] = _links(links)
    return zip_bytes(files)


def epub_bytes(about: dict[str, str], chapters: list[str]) -> bytes:
    """A book from Dublin Core values and chapter bodies."""
    meta = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in about.items())
    items = "".join(f'<item id="c{i}" href="c{i}.xhtml"/>' for i in range(len(chapters)))
    refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
    files = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
        "OPS/book.opf": f'<package xmlns:dc="dc"><metadata>{meta}</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>',
    }
    return zip_bytes(files | {f"OPS/c{i}.xhtml": f"<html><body>{c}</body></html>" for i, c in enumerate(chapters)})


def pdf_bytes(pages: list[list[tuple[float, float, str]]], width: float = 612, height: float = 792) -> bytes:
    """Pages of (x, top, text), in a font of 6 points a character."""
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /FirstChar 32 /LastChar 255 /Widths [" + b"600 " * 224 + b"] >>"]
    for i, items in enumerate(pages):
        lines = []
        for x, top, text in items:
            safe = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
            lines.append(f"BT /F1 10 Tf 1 0 0 1 {x} {height - top} Tm ({safe}) Tj ET")
        raw = zlib.compress("\n".join(lines).encode("cp1252", "replace"))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        objects.append(f"<< /Length {len(raw)} /Filter /FlateDecode >>\nstream\n".encode() + raw + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(f"{n} 0 obj\n".encode() + o + b"\nendobj\n" for n, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n"


def wav_bytes(pcm: bytes, rate: int = 8000, channels: int = 1) -> bytes:
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(pcm)) + pcm


def compound_bytes(streams: dict[str, bytes]) -> bytes:
    """A compound file with these streams; one level of storages by 'storage/name'. All sectors are regular or mini ones of
    one chain each."""
    names = ["Root Entry", *sorted({n.split("/")[0] for n in streams if "/" in n}), *streams]
    storages = [n for n in names[1:] if n not in streams]
    mini, mini_fat, regular, fat = bytearray(), [], [], []
    place: dict[str, tuple[int, int]] = {}

    def sectors(data: bytes) -> int:
        start = len(regular)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        regular.extend(parts)
        fat.extend([*range(start + 1, start + len(parts)), 0xFFFFFFFE] if parts else [])
        return start if parts else 0xFFFFFFFE

    for n, data in streams.items():
        if len(data) >= 4096:
            place[n] = (sectors(data), len(data))
        else:
            first, count = len(mini) // 64, -(-len(data) // 64)
            mini.extend(data.ljust(count * 64, b"\0"))
            mini_fat.extend([*range(first + 1, first + count), 0xFFFFFFFE] if count else [])
            place[n] = (first if count else 0xFFFFFFFE, len(data))
    root_start = sectors(bytes(mini))
    mini_start = sectors(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) * 4 // 512) * 512, b"\xff")) if mini_fat else 0xFFFFFFFE
    entries = []
    for i, n in enumerate(names):
        leaf = n.rpartition("/")[2]
        inside = lambda top: [k for k, m in enumerate(names) if k and (m.rpartition("/")[0] if m in streams else "") == top]
        siblings = inside(n.rpartition("/")[0] if n in streams else "") if i else []
        right = siblings[siblings.index(i) + 1] if i and siblings.index(i) + 1 < len(siblings) else 0xFFFFFFFF
        kind = 5 if i == 0 else 1 if n in storages else 2
        kids = inside("" if i == 0 else n) if kind != 2 else []
        start, size = (root_start, len(mini)) if i == 0 else place.get(n, (0, 0))
        raw = leaf.encode("utf-16-le") + b"\0\0"
        entries.append(raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, kids[0] if kids else 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<IQ", start, size))
    directory = sectors(b"".join(entries).ljust(-(-len(entries) // 4) * 512, b"\0"))
    count = 1
    while (len(fat) + count) * 4 > count * 512:
        count += 1
    first_fat = len(regular)
    fat += [0xFFFFFFFD] * count
    raw = struct.pack(f"<{len(fat)}I", *fat).ljust(count * 512, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIIII", count, directory, 0, 4096, mini_start, 1 if mini_fat else 0, 0xFFFFFFFE, 0, first_fat)
    head += b"".join(struct.pack("<I", first_fat + k) for k in range(1, count))
    return head.ljust(512, b"\xff") + b"".join(regular) + raw


def message_bytes(subject: str, sender: str, to: list[str], body: str) -> bytes:
    wide = lambda t: t.encode("utf-16-le")
    streams = {"__substg1.0_0037001F": wide(subject), "__substg1.0_0C1F001F": wide(sender), "__substg1.0_1000001F": wide(body)}
    for i, who in enumerate(to):
        streams[f"__recip_version1.0_#{i:08X}/__substg1.0_3003001F"] = wide(who)
    return compound_bytes(streams)


def xls_bytes(sheets: dict[str, list[list[object]]]) -> bytes:
    """A BIFF8 workbook of numbers and texts."""
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    strings = list(dict.fromkeys(str(v) for rows in sheets.values() for r in rows for v in r if isinstance(v, str)))
    text = lambda s: struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")
    bof = lambda kind: record(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    shared = record(0xFC, struct.pack("<II", len(strings), len(strings)) + b"".join(map(text, strings)))
    bodies = []
    for rows in sheets.values():
        body = bof(0x10)
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                if isinstance(v, str):
                    body += record(0xFD, struct.pack("<HHHI", r, c, 0, strings.index(v)))
                elif v is not None:
                    body += record(0x203, struct.pack("<HHHd", r, c, 0, float(v)))
        bodies.append(body + record(0x0A, b""))
    names = [struct.pack("<BB", len(n), 1) + n.encode("utf-16-le") for n in sheets]
    head = len(bof(5)) + sum(4 + 6 + len(n) for n in names) + len(shared) + 4
    book, at = bof(5), head
    for n, body in zip(names, bodies, strict=True):
        book += record(0x85, struct.pack("<IBB", at, 0, 0) + n)
        at += len(body)
    return compound_bytes({"Workbook": book + shared + record(0x0A, b"") + b"".join(bodies)})
