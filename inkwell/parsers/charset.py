"""Charset detection and decoding of text bytes."""

from __future__ import annotations

import codecs
import re

#: Bytes that an injected detector is shown.
SAMPLE = 4096
# Labels as WHATWG reads them, and their Python codecs.
CODECS = {
    "utf-8": "utf-8-sig", "utf8": "utf-8-sig", "ascii": "cp1252", "us-ascii": "cp1252", "latin1": "cp1252", "iso-8859-1": "cp1252", "windows-1252": "cp1252",
    "shift_jis": "cp932", "shift-jis": "cp932", "shiftjis": "cp932", "sjis": "cp932", "cp932": "cp932", "gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030",
    "euc-kr": "cp949", "euckr": "cp949", "cp949": "cp949", "euc-jp": "euc_jp", "big5": "big5hkscs", "windows-1250": "cp1250", "windows-1251": "cp1251",
    "utf-16": "utf-16-le", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be",
}


# The byte pairs of multi-byte charsets among single bytes, at least one pair, as patterns over bytes read as
# ISO-8859-1. Nothing in them goes back, so they take whole values of any length.
_ASCII, _KANA = r"[\x00-\x7f]", r"[\x00-\x7f\xa1-\xdf]"
GBK = rf"(?:{_ASCII}*+[\x81-\xfe][\x40-\xfe])++{_ASCII}*+"
SHIFT_JIS = rf"(?:{_KANA}*+[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc])++{_KANA}*+"
EUC_KR = rf"(?:{_ASCII}*+[\xa1-\xfe][\xa1-\xfe])++{_ASCII}*+"
#: Bytes that GBK could read as well are Shift_JIS only if every pair's lead is below 0xA1.
LOW_SHIFT_JIS = rf"(?:{_ASCII}*+[\x81-\xa0][\x40-\x7e\x80-\xfc])++{_ASCII}*+"
_gbk, _shift_jis, _euc_kr, _low = (re.compile(p.encode()) for p in (GBK, SHIFT_JIS, EUC_KR, LOW_SHIFT_JIS))


def utf8(data: bytes) -> bool:
    """Whether a whole value is UTF-8."""
    try:
        data.decode()
        return True
    except UnicodeDecodeError:
        return False


#: Detectors' guesses below this confidence don't count.
CONFIDENT = 0.7
# What detectors call charsets, where it isn't what we call them.
LABELS = {"ascii": "utf-8", "utf8": "utf-8", "iso8859-1": "iso-8859-1", "gb2312": "gb18030", "gbk": "gb18030", "shift-jis": "shift_jis", "shiftjis": "shift_jis", "euckr": "euc-kr", "utf-16": "utf-16le"}


def label(name: str | None, confidence: float = 1.0) -> str | None:
    """A detector's guess as one of our labels, null if it isn't sure."""
    if not name or confidence < CONFIDENT:
        return None
    name = name.strip().lower().replace("_", "-")
    return LABELS.get(name, name)


def detect(data: bytes, detector=None) -> str:
    """A detector (bytes -> (name, confidence)) is asked about what is neither marked nor UTF-8."""
    if data.startswith(codecs.BOM_UTF8):
        return "utf-8"
    if data.startswith(codecs.BOM_UTF16_LE):
        return "utf-16le"
    if data.startswith(codecs.BOM_UTF16_BE):
        return "utf-16be"
    if utf8(data):
        return "utf-8"
    if detector is not None and (found := label(*detector(data[:SAMPLE]))):
        return found
    sjis = _shift_jis.fullmatch(data)
    if sjis and _low.fullmatch(data):
        return "shift_jis"
    return "gb18030" if _gbk.fullmatch(data) else "shift_jis" if sjis else "euc-kr" if _euc_kr.fullmatch(data) else "latin1"


def decode(data: bytes, charset: str | None = None) -> str:
    """Never fails: bad bytes become U+FFFD, bytes without a meaning in windows-1252 stay as control characters."""
    name = CODECS.get((charset or detect(data)).strip().lower().replace("_", "-"), None) or CODECS.get((charset or "").strip().lower())
    if name is None:
        try:
            name = codecs.lookup(charset).name
        except LookupError:
            raise ValueError(f"unknown charset: {charset}") from None
    if name == "cp1252":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data) if any(b in data for b in b"\x81\x8d\x8f\x90\x9d") else data.decode("cp1252")
    text = data.decode(name, "replace")
    return text.removeprefix("﻿")
