"""XML as the same tree as HTML, prefixes kept, through expat."""

from __future__ import annotations

import re
from xml.parsers import expat

from inkwell.parsers.html import Node as _Node


class Node(_Node):
    __slots__ = ()

    @property
    def name(self) -> str:
        """The tag without its prefix."""
        return self.tag.rpartition(":")[2]

    def text_of(self, tag: str) -> str | None:
        """The text of the first such descendant, trimmed; null if there is none or it is empty."""
        node = self.first(tag)
        return (node.content().strip() or None) if node is not None else None

    def named(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.tag.rpartition(":")[2] in names]

    def one(self, name: str) -> Node | None:
        return next((n for n in self.walk() if n.tag.rpartition(":")[2] == name), None)

    def kids(self, *names: str) -> list[Node]:
        return [c for c in self.children if c.tag != "#text" and c.tag.rpartition(":")[2] in names]

    def kid(self, name: str) -> Node | None:
        return next(iter(self.kids(name)), None)

    def attr(self, name: str) -> str | None:
        """An attribute by its name with or without prefix."""
        return self.attrs.get(name, next((v for k, v in self.attrs.items() if k.rpartition(":")[2] == name), None))


def parse_xml(data: str | bytes) -> Node:
    """The document node. Entity declarations are refused: none of the formats needs them."""
    root = Node("#document")
    at = [root]
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(tag, attrs):
        at.append(at[-1].add(Node(tag, attrs)))

    def refuse(*_):
        raise ValueError("entity declarations are not read")

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda tag: at.pop()
    parser.CharacterDataHandler = lambda text: at[-1].add(Node("#text", text=text))
    parser.EntityDeclHandler = refuse
    if isinstance(data, str):
        data = re.sub(r"^\s*<\?xml[^>]*\?>", "", data.lstrip("﻿")).encode()
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise ValueError(f"not XML: {e}") from None
    return root
