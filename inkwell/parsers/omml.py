"""Office formulas as LaTeX."""

from __future__ import annotations

import unicodedata

# Combining characters of accents and the commands for them.
ACCENTS = {
    "̀": "grave", "́": "acute", "̂": "hat", "̃": "tilde", "̄": "bar", "̅": "overbar", "̆": "breve", "̇": "dot",
    "̈": "ddot", "̉": "ovhook", "̊": "ocirc", "̌": "check", "̐": "candra", "̒": "oturnedcomma", "̕": "ocommatopright",
    "̚": "droang", "̸": "not", "⃐": "leftharpoonaccent", "⃑": "rightharpoonaccent", "⃒": "vertoverlay", "⃖": "overleftarrow",
    "⃗": "vec", "⃛": "dddot", "⃜": "ddddot", "⃡": "overleftrightarrow", "⃧": "annuity", "⃩": "widebridgeabove", "⃰": "asteraccent",
    "̰": "wideutilde", "̱": "underbar", "⃨": "threeunderdot", "⃬": "underrightharpoondown", "⃭": "underleftharpoondown",
    "⃮": "underleftarrow", "⃯": "underrightarrow", "⎴": "overbracket", "⏜": "overparen", "⏞": "overbrace", "⎵": "underbracket",
    "⏝": "underparen", "⏟": "underbrace",
}
# Large operators.
LARGE = {
    "⅀": "\\Bbbsum", "∏": "\\prod", "∐": "\\coprod", "∑": "\\sum", "∫": "\\int", "⋀": "\\bigwedge", "⋁": "\\bigvee", "⋂": "\\bigcap",
    "⋃": "\\bigcup", "⨀": "\\bigodot", "⨁": "\\bigoplus", "⨂": "\\bigotimes",
}
# Symbols; each command is followed by a space.
SYMBOLS = {
    "→": "rightarrow", "←": "leftarrow", "↑": "uparrow", "↓": "downarrow", "↔": "leftrightarrow", "↕": "updownarrow", "↖": "nwarrow",
    "↗": "nearrow", "↘": "searrow", "↙": "swarrow", "⋮": "vdots", "⋯": "cdots", "⋰": "adots", "⋱": "ddots", "≠": "ne", "≤": "leq",
    "≥": "geq", "≦": "leqq", "≧": "geqq", "≨": "lneqq", "≩": "gneqq", "≪": "ll", "≫": "gg", "∈": "in", "∉": "notin", "∋": "ni",
    "∌": "not\\ni", "∞": "infty", "±": "pm", "∓": "mp", "𝜕": "partial", "𝜖": "varepsilon", "𝜗": "vartheta", "𝜘": "varkappa", "𝜙": "varphi",
    "𝜚": "varrho", "𝜛": "varpi", "𝜍": "varsigma",
}
FUNCTIONS = "sin cos tan arcsin arccos arctan arccot sinh cosh tanh coth sec csc".split()
LIMITS = ("lim", "max", "min")
SPECIAL = set("{}_^#&$%~")


class Unsupported(ValueError):
    """A function or limit that has no LaTeX form here."""


def escape(text: str) -> str:
    """Backslashes before the characters that mean something in LaTeX, unless one stands there."""
    out, last = [], ""
    for c in text.replace("\\\\", "\\"):
        out.append("\\" + c if c in SPECIAL and last != "\\" else c)
        last = c
    return "".join(out)


def symbol(c: str) -> str:
    """Commands for symbols and italic Greek letters, plain letters for italic Latin ones."""
    if c in SYMBOLS:
        return f"\\{SYMBOLS[c]} "
    if 0x1D434 <= ord(c) <= 0x1D467:
        return unicodedata.normalize("NFKC", c)
    if 0x1D6FC <= ord(c) <= 0x1D714:
        return "\\" + unicodedata.name(unicodedata.normalize("NFKC", c)).split()[-1].lower().replace("lamda", "lambda") + " "
    return c


def _setting(node, properties: str, name: str) -> str | None:
    """The value of a property element, null if it isn't set."""
    box = node.kid(properties)
    item = box.kid(name) if box is not None else None
    return (item.attr("val") or "") if item is not None else None


def _part(node, name: str) -> str:
    child = node.kid(name)
    return latex(child) if child is not None else ""


def _fraction(node):
    top, bottom = _part(node, "num"), _part(node, "den")
    kind = _setting(node, "fPr", "type")
    if kind == "skw":
        return f"^{{{top}}}/_{{{bottom}}}"
    if kind == "lin":
        return f"{{{top}}}/{{{bottom}}}"
    return (r"\genfrac{}{}{0pt}{}" if kind == "noBar" else r"\frac") + f"{{{top}}}{{{bottom}}}"


def _fence(node):
    left, right = _setting(node, "dPr", "begChr"), _setting(node, "dPr", "endChr")
    side = lambda c, default: default if c is None else escape("".join(map(symbol, c))) or "."
    inner = (_setting(node, "dPr", "sepChr") or "|").join(latex(e) for e in node.kids("e"))
    return rf"\left{side(left, '(')}{inner}\right{side(right, ')')}"


def _accent(node):
    mark = _setting(node, "accPr", "chr") or "̂"
    return f"\\{ACCENTS[mark]}{{{_part(node, 'e')}}}" if mark in ACCENTS else f"{mark}{_part(node, 'e')}"


def _group(node):
    mark = _setting(node, "groupChrPr", "chr")
    return f"\\{ACCENTS[mark]}{{{_part(node, 'e')}}}" if mark in ACCENTS else (mark or "") + _part(node, "e")


def _function(node):
    named = node.kid("fName")
    out, placed = [], False
    for child in _kids(named) if named is not None else []:
        text = latex(child)
        if child.name == "r":
            if text not in FUNCTIONS:
                raise Unsupported(f"Not support func {text}")
            out.append(f"\\{text}({_part(node, 'e')})")
            placed = True
        else:
            out.append(text)
    return "".join(out) + ("" if placed else _part(node, "e"))


def _lower_limit(node):
    base = _part(node, "e")
    if base not in LIMITS:
        raise Unsupported(f"Not support lim {base}")
    return f"\\{base}_{{{_part(node, 'lim')}}}"


def _nary(node):
    mark = _setting(node, "naryPr", "chr")
    return ("" if mark is None else LARGE.get(mark, mark)) + "".join(latex(c) for c in _kids(node))


def _root(node):
    degree = _part(node, "deg")
    return rf"\sqrt[{degree}]{{{_part(node, 'e')}}}" if degree else rf"\sqrt{{{_part(node, 'e')}}}"


def _bar(node):
    return ("\\underline" if _setting(node, "barPr", "pos") == "bot" else "\\overline") + f"{{{_part(node, 'e')}}}"


def _run(node):
    return escape("".join(symbol(c) for t in node.kids("t")[:1] for c in t.content()))


RULES = {
    "r": _run, "f": _fraction, "d": _fence, "acc": _accent, "groupChr": _group, "func": _function, "limLow": _lower_limit, "nary": _nary, "rad": _root, "bar": _bar,
    "sub": lambda n: f"_{{{_inside(n)}}}",
    "sup": lambda n: f"^{{{_inside(n)}}}",
    "lim": lambda n: _inside(n).replace("\\rightarrow", "\\to", 1),
    "limUpp": lambda n: rf"\overset{{{_part(n, 'lim')}}}{{{_part(n, 'e')}}}",
    "eqArr": lambda n: r"\begin{array}{c}" + "".join("\\\\" + latex(e) for e in n.kids("e")) + r"\end{array}",
    "m": lambda n: r"\begin{matrix}" + "".join("\\\\" + latex(r) for r in n.kids("mr")) + r"\end{matrix}",
    "mr": lambda n: "&".join(latex(e) for e in n.kids("e")),
}


def _kids(node):
    return [c for c in node.children if c.tag != "#text" and not c.name.endswith("Pr")]


def _inside(node) -> str:
    return "".join(latex(c) for c in _kids(node))


def latex(node) -> str:
    """LaTeX of a formula's element; raises Unsupported for functions and limits without a form."""
    rule = RULES.get(node.name)
    return rule(node) if rule is not None else _inside(node)
