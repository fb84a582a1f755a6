"""Services that a conversion may call, given as functions; none is called unless given.

Each function must be picklable; it runs on the executors, once for each file that needs it.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable
from dataclasses import dataclass

# The metadata fields of pictures and recordings, in the order in which they are shown.
IMAGE_FIELDS = ("ImageSize", "Title", "Caption", "Description", "Keywords", "Artist", "Author", "DateTimeOriginal", "CreateDate", "GPSPosition")
AUDIO_FIELDS = ("Title", "Artist", "Author", "Band", "Album", "Genre", "Track", "DateTimeOriginal", "CreateDate", "NumChannels", "SampleRate", "AvgBytesPerSec", "BitsPerSample")


@dataclass(frozen=True)
class Providers:
    metadata: Callable[[bytes, dict], dict[str, str]] | None = None
    caption: Callable[[bytes, dict], str | None] | None = None
    transcribe: Callable[[bytes, dict], str | None] | None = None
    transcript: Callable[[str, list[str]], str | None] | None = None
    fetch: Callable[[str], tuple[bytes, dict[str, str]]] | None = None
    analyze: Callable[[bytes, dict], str | None] | None = None
    detect_charset: Callable[[bytes], tuple[str | None, float]] | None = None
    classify: Callable[[bytes], dict | None] | None = None
    languages: tuple[str, ...] = ("en",)


def caption_request(data: bytes, info: dict, model: str, prompt: str | None = None) -> dict:
    """The body of a chat request that asks for a picture's caption."""
    kinds = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp"}
    kind = info.get("mimetype") or kinds.get((info.get("extension") or "").lower(), "application/octet-stream")
    picture = {"url": f"data:{kind};base64,{base64.b64encode(data).decode()}"}
    content = [{"type": "text", "text": (prompt or "").strip() or "Write a detailed caption for this image."}, {"type": "image_url", "image_url": picture}]
    return {"model": model, "messages": [{"role": "user", "content": content}]}


def shown_fields(found: dict[str, str], fields: tuple[str, ...]) -> str:
    return "".join(f"{f}: {found[f]}\n" for f in fields if found.get(f))


def image(data: bytes, info: dict, p: Providers) -> tuple[str, str | None]:
    out = shown_fields(p.metadata(data, info), IMAGE_FIELDS) if p.metadata else ""
    said = p.caption(data, info) if p.caption else None
    return (out + (f"\n# Description:\n{said.strip()}\n" if said else "")).strip(), None


def audio(data: bytes, info: dict, p: Providers) -> tuple[str, str | None]:
    out = shown_fields(p.metadata(data, info), AUDIO_FIELDS) if p.metadata else ""
    said = p.transcribe(data, info) if p.transcribe else None
    return (out + (f"\n\n### Audio Transcript:\n{said}" if said else "")).strip(), None


def parse_wav(data: bytes) -> tuple[bytes, int, int]:
    """(samples, rate, channels) of a 16-bit PCM recording."""
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("Invalid WAV file")
    at, pcm, rate, channels, bits = 12, None, 16000, 1, 16
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt " and size >= 16:
            channels, rate, bits = *struct.unpack_from("<HI", data, at + 10), struct.unpack_from("<H", data, at + 22)[0]
        elif kind == b"data":
            pcm = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if not pcm or bits != 16:
        raise ValueError("Unsupported WAV format (expected 16-bit PCM)")
    return pcm, rate, channels


def speech_text(response: str) -> str:
    """The first alternatives of newline-delimited recognition results."""
    said = []
    for line in filter(None, map(str.strip, response.split("\n"))):
        try:
            results = json.loads(line).get("result") or []
        except (ValueError, AttributeError):
            continue
        said += [t for r in results if (a := r.get("alternative") or [{}]) and (t := (a[0].get("transcript") or "").strip())]
    return " ".join(said)
