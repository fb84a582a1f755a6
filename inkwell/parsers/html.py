"""HTML as a tolerant tree, and its Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import quote, unquote, urlsplit

BLOCKS = frozenset(
    "address article aside audio blockquote body canvas center dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html isindex li main menu nav noframes noscript ol output p pre section table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the given kinds, searched up to a boundary.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "noscript", "canvas", "audio", "output"}
JS_SPACE = " \t\n\x0b\x0c\r\xa0                　﻿"


class Node:
    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None, text: str = ""):
        self.tag, self.attrs, self.parent, self.text, self.children = tag, attrs or {}, parent, text, []

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self):
        """All elements below, in document order; without recursion, trees may be deep."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if node.tag != "#text":
                yield node
                stack.extend(reversed(node.children))

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def with_class(self, name: str) -> list[Node]:
        return [n for n in self.walk() if name in n.attrs.get("class", "").split()]

    def content(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.tag == "#text":
                out.append(node.text)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)

    def elements(self, *tags: str) -> list[Node]:
        return [c for c in self.children if c.tag != "#text" and (not tags or c.tag in tags)]

    def inside(self, *tags: str) -> bool:
        node = self.parent
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None


class _Builder(HTMLParser):
    DEEPEST = 200  # elements nested deeper become siblings, so that rendering can't overflow

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.head = self.root.add(Node("head"))
        self.body = self.root.add(Node("body"))
        self.open: list[Node] = [self.body]

    def _end_open(self, kinds: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop:
                return
            if self.open[i].tag in kinds:
                del self.open[i:]
                if kinds == {"p"}:
                    return

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head", "body"):
            if tag != "head":
                target = self.root if tag == "html" else self.body
                target.attrs |= {k: v for k, v in found.items() if k not in target.attrs}
            return
        if tag in ENDS_PARAGRAPH:
            self._end_open({"p"}, {"table", "td", "th", "button", "object"})
        if tag in CLOSED_BY:
            self._end_open(*CLOSED_BY[tag])
        at_head = tag in ("title", "meta", "link", "base") and len(self.open) == 1
        node = (self.head if at_head else self.open[-1]).add(Node(tag, found))
        if tag not in VOID and len(self.open) < self.DEEPEST:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in ("html", "head", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return  # an end tag doesn't reach out of a cell
        if tag == "p":
            self.open[-1].add(Node("p"))

    def handle_data(self, data):
        last = self.open[-1].children[-1] if self.open[-1].children else None
        if last is not None and last.tag == "#text":
            last.text += data
        else:
            self.open[-1].add(Node("#text", text=data))


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def title(root: Node) -> str | None:
    node = root.first("title")
    return node.content().strip(JS_SPACE) if node is not None else None


def _collapse(root: Node) -> None:
    """White space inside a block becomes single spaces, none at its edges; pre and textarea keep theirs."""
    state = {"prev": None, "space": True}

    def block_edge() -> None:
        if state["prev"] is not None:
            state["prev"].text = state["prev"].text.removesuffix(" ")
        state["prev"], state["space"] = None, True

    def visit(node: Node) -> None:
        if node.tag == "#text":
            text = re.sub(r"[ \t\r\n]+", " ", node.text)
            if state["space"] and text.startswith(" "):
                text = text[1:]
            node.text = text
            if text:
                state["prev"], state["space"] = node, text.endswith(" ")
            return
        block = node.tag in BLOCKS or node.tag == "br"
        if block:
            block_edge()
        if node.tag in ("pre", "textarea"):
            state["prev"], state["space"] = None, False
        elif node.tag in VOID and node.tag != "br":
            state["prev"], state["space"] = None, False
        else:
            for child in node.children:
                visit(child)
        if block:
            block_edge()

    for child in root.children:
        visit(child)
    block_edge()


_MATH = re.compile(r"\$\$[\s\S]*?\$\$|(?<!\$)\$[^$\n]+?\$(?!\$)")


def _escape(text: str) -> str:
    """Markdown metacharacters; backslashes inside math stay single."""

    def plain(part: str) -> str:
        return re.sub(r"[*_`]", r"\\\g<0>", part.replace("\\", "\\\\"))

    out, at = [], 0
    for m in _MATH.finditer(text):
        out += [plain(text[at : m.start()]), re.sub(r"[*_`]", r"\\\g<0>", m[0])]
        at = m.end()
    text = "".join([*out, plain(text[at:])])
    return re.sub(r"^(\+ |=+|#{1,6} |~~~)", r"\\\1", text)


def _join(left: str, right: str) -> str:
    """Two pieces with as many line ends between them as either asks for, two at most."""
    a, b = left.rstrip("\n"), right.lstrip("\n")
    return a + "\n" * min(2, max(len(left) - len(a), len(right) - len(b))) + b


def normal_href(href: str) -> str:
    """Absolute references with their path encoded anew, without user info; other schemes than web and file give ''."""
    if href.startswith("#") or not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", href):
        return href
    try:
        part = urlsplit(href.strip())
        if part.scheme.lower() not in ("http", "https", "file"):
            return ""
        path = "/".join(quote(unquote(p, errors="strict"), safe="!~*'()") for p in (part.path or "/").split("/"))
        if path == "/" and not part.query and not part.fragment:
            path = ""
        host = part.netloc.rpartition("@")[2].lower()
        return f"{part.scheme.lower()}://{host}{path}" + (f"?{part.query}" if part.query else "") + (f"#{part.fragment}" if part.fragment else "")
    except (ValueError, UnicodeDecodeError):
        return href


class _Writer:
    def __init__(self, keep_data_uris: bool):
        self.keep_data_uris = keep_data_uris

    def children(self, node: Node) -> str:
        out = ""
        for child in node.children:
            piece = self.node(child)
            if piece:
                out = _join(out, piece)
        return out

    def node(self, node: Node) -> str:
        if node.tag == "#text":
            return node.text if node.inside("pre", "code") else _escape(node.text)
        rule = getattr(self, f"tag_{node.tag}", None)
        if rule is not None:
            return rule(node)
        content = self.children(node)
        if node.tag in BLOCKS:
            return f"\n\n{content}\n\n" if content.strip(JS_SPACE) else "\n\n" if content else ""
        return content

    def tag_br(self, node):
        return "  \n"

    def tag_hr(self, node):
        return "\n\n* * *\n\n"

    def tag_head(self, node):
        return ""

    tag_script = tag_style = tag_template = tag_head

    def _heading(self, node):
        text = self.children(node).strip(JS_SPACE)
        return f"\n{'#' * int(node.tag[1])}{' ' + text if text else ''}\n\n"

    tag_h1 = tag_h2 = tag_h3 = tag_h4 = tag_h5 = tag_h6 = _heading

    def _around(self, node, mark):
        content = self.children(node)
        inner = content.strip(JS_SPACE)
        if not inner:
            return content
        at = content.index(inner)
        return content[:at] + mark + inner + mark + content[at + len(inner) :]

    def tag_strong(self, node):
        return self._around(node, "**")

    def tag_em(self, node):
        return self._around(node, "*")

    tag_b, tag_i = tag_strong, tag_em

    def tag_code(self, node):
        if node.inside("pre"):
            return self.children(node)
        text = re.sub(r"\r?\n|\r", " ", node.content())
        if not text:
            return ""
        runs = {len(r) for r in re.findall("`+", text)}
        fence = "`" * next(n for n in range(1, len(text) + 2) if n not in runs)
        pad = " " if text.startswith("`") or text.endswith("`") or re.fullmatch(r" .*[^ ].* ", text) else ""
        return fence + pad + text + pad + fence

    def tag_pre(self, node):
        inner = node.children[0] if node.children and node.children[0].tag == "code" else None
        if inner is None:
            content = self.children(node)
            return f"\n\n{content}\n\n" if content.strip() else ""
        code = inner.content()
        language = re.search(r"language-(\S+)", inner.attrs.get("class", ""))
        fence = "`" * max(3, *(len(m) + 1 for m in ["``", *re.findall(r"(?m)^`{3,}", code)]))
        return f"\n\n{fence}{language[1] if language else ''}\n{code.removesuffix(chr(10))}\n{fence}\n\n"

    def tag_blockquote(self, node):
        content = self.children(node).strip("\n")
        return "\n\n" + re.sub(r"(?m)^", "> ", content) + "\n\n"

    def tag_ul(self, node):
        content = self.children(node)
        last = node.parent is not None and node.parent.tag == "li" and node.parent.elements()[-1] is node
        return f"\n{content}" if last else f"\n\n{content}\n\n"

    tag_ol = tag_menu = tag_ul

    def _marker(self, node):
        """(indent and marker of an item, indent of its further lines)."""
        lists, up = [], node.parent
        while up is not None and up.tag not in ("td", "th"):
            if up.tag in ("ul", "ol", "menu"):
                lists.append(up)
            up = up.parent
        parent = lists[0] if lists else None
        if parent is not None and parent.tag == "ol":
            try:
                start = int(parent.attrs.get("start", "1"))
            except ValueError:
                start = 1
            return f"{start + parent.elements('li').index(node)}. "
        if len(lists) <= 1:
            return "* "
        return "* " if lists[1].tag == "ol" else "+ "

    def tag_li(self, node):
        content = self.children(node).strip("\n").rstrip()
        inner = node.parent is not None and node.parent.tag == "ol"
        pad = "   " if inner else "  "
        text = re.sub(r"\n(?=[^\n])", "\n" + pad, content)
        later = node.parent is not None and node.parent.elements()[-1] is not node
        return self._marker(node) + text + ("\n" if later else "")

    def tag_a(self, node):
        content = self.children(node)
        href = node.attrs.get("href", "")
        if not href:
            return content
        text = content.strip(JS_SPACE)
        if not text:
            return ""
        if node.inside("pre"):
            return text
        href, label = normal_href(href), node.attrs.get("title", "")
        if not href:
            return text
        if text.replace("\\_", "_").removesuffix("/") == href.removesuffix("/") and not label:
            return f"<{href}>"
        text = text.replace("[", "\\[").replace("]", "\\]") if not node.all("img") and not node.all("input") else text
        text = text.replace("\\[", "[").replace("\\]", "]")
        quoted = label.replace('"', '\\"')
        return f"[{text}]({href}" + (f' "{quoted}")' if label else ")")

    def tag_img(self, node):
        alt, label = node.attrs.get("alt", "").replace("\n", " "), node.attrs.get("title", "")
        source = node.attrs.get("src", node.attrs.get("data-src", ""))
        if source.startswith("data:") and not self.keep_data_uris:
            source = source.split(",")[0] + "..."
        quoted = label.replace('"', '\\"')
        return f"![{alt}]({source}" + (f' "{quoted}")' if label else ")") if source else alt

    def tag_input(self, node):
        if node.attrs.get("type") != "checkbox":
            return ""
        return "[x] " if "checked" in node.attrs else "[ ] "

    def _span(self, cell):
        m = re.match(r"\s*\+?(\d+)", cell.attrs.get("colspan", "1"))
        return min(1000, int(m[1])) or 1 if m else 1

    def _cell(self, cell):
        text = self.children(cell)
        text = re.sub(r"  \n", " ", text)
        text = text.replace("\\\\", "\\")
        text = re.sub(r"\\([`#=|])", r"\1", text)
        text = re.sub(r"\n+(?= *(?:[*+-]|\d+\.) )", " ", text.strip(JS_SPACE))
        text = re.sub(r"\n{2,}", "  ", text)
        return text.replace("\n", " ").strip(JS_SPACE)

    def tag_table(self, node):
        rows = [r for c in node.elements() for r in ([c] if c.tag == "tr" else c.elements("tr") if c.tag in ("thead", "tbody", "tfoot") else [])]
        table: list[list[tuple[str, int]]] = []
        for row in rows:
            cells = row.elements("td", "th")
            if not cells:
                continue
            parent = row.parent
            leads = row is node.first("tr") and any(c.tag != "th" for c in cells)
            if not table and leads and (parent.tag == "table" or (parent.tag == "tbody" and parent.parent.elements()[0] is parent)):
                table.append([("", 1)] * sum(map(self._span, cells)))
            table.append([(self._cell(c), self._span(c)) for c in cells])
        if not table:
            return "\n\n|\n|  |\n\n"
        return "\n\n" + table_text(table) + "\n\n"


def table_text(rows: list[list[tuple[str, int]]]) -> str:
    """A Markdown table of (text, colspan) cells; rows are neither padded nor their bars escaped."""
    line = lambda cells: "|" + "".join(" " + t.replace("\n", " ") + " |" * max(1, n) for t, n in cells)
    width = sum(max(1, n) for _, n in rows[0])
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def to_markdown(node: Node, keep_data_uris: bool = False) -> str:
    _collapse(node)
    writer = _Writer(keep_data_uris)
    text = writer.children(node) if node.tag in ("body", "html", "#root") else _join("", writer.children(node))
    return text.strip("\n").rstrip(JS_SPACE)


def without_scripts(root: Node) -> Node:
    for node in root.all("script", "style"):
        node.remove()
    return root


def body_of(root: Node) -> Node:
    return next(c for c in root.children if c.tag == "body")


def page(html: str, keep_data_uris: bool = False) -> tuple[str, str | None]:
    """(Markdown, title) of a page or fragment."""
    root = without_scripts(parse(html))
    name = title(root)
    return to_markdown(body_of(root), keep_data_uris), name
