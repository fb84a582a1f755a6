"""Compound files (OLE), and the mail messages stored in them."""

from __future__ import annotations

import re
import struct

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END = 0xFFFFFFF8  # sector numbers from here on are marks


class Compound:
    """Streams of a compound file by name; storages are paths joined by '/'."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        self.size = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini_size = 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, first_dir = struct.unpack_from("<II", data, 44)
        self.cutoff, first_mini, _, more, n_more = struct.unpack_from("<IIIII", data, 56)
        tables = list(struct.unpack_from("<109I", data, 76))
        while more < END and n_more:
            part = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            tables += part[:-1]
            more, n_more = part[-1], n_more - 1
        self.fat: list[int] = []
        for s in [t for t in tables if t < END][:n_fat]:
            self.fat += struct.unpack(f"<{self.size // 4}I", self._sector(s))
        raw = self._chain(first_dir)
        entries = [raw[i : i + 128] for i in range(0, len(raw) - 127, 128)]
        self.entries = [(e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace"), e[66], *struct.unpack_from("<III", e, 68), *struct.unpack_from("<II", e, 116)) for e in entries]
        mini = self._chain(first_mini)
        self.mini = list(struct.unpack(f"<{len(mini) // 4}I", mini))
        self.mini_data = self._chain(self.entries[0][5]) if self.entries else b""
        self.names: dict[str, int] = {}
        self._list(self.entries[0][4] if self.entries else 0xFFFFFFFF, "", set())

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def _chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < END and start < len(self.fat) and start not in seen:
            seen.add(start)
            out.append(self._sector(start))
            start = self.fat[start]
        return b"".join(out)

    def _list(self, top: int, prefix: str, seen: set[int]) -> None:
        stack = [(top, prefix)]
        while stack:
            i, prefix = stack.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            name, kind, left, right, child = self.entries[i][:5]
            self.names[prefix + name] = i
            stack += [(left, prefix), (right, prefix)] + ([(child, f"{prefix}{name}/")] if kind == 1 else [])

    def stream(self, name: str) -> bytes | None:
        i = self.names.get(name)
        if i is None:
            return None
        start, size = self.entries[i][5:7]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < END and start < len(self.mini) and start not in seen:
            seen.add(start)
            out.append(self.mini_data[start * self.mini_size : (start + 1) * self.mini_size])
            start = self.mini[start]
        return b"".join(out)[:size]


def _property(file: Compound, tag: str, folder: str = "") -> str | None:
    """A text property of a message or recipient, wide or not."""
    wide = file.stream(f"{folder}__substg1.0_{tag}001F")
    if wide is not None:
        return wide.decode("utf-16-le", "replace").rstrip("\0")
    narrow = file.stream(f"{folder}__substg1.0_{tag}001E")
    return narrow.decode("cp1252", "replace").rstrip("\0") if narrow is not None else None


def message(data: bytes) -> tuple[str, str | None]:
    """A mail message: who, to whom, what, and the body as it is."""
    file = Compound(data)
    subject, body, headers = _property(file, "0037"), _property(file, "1000"), _property(file, "007D") or ""
    header = lambda name: next((m[1].strip() for m in [re.search(rf"(?im)^{name}:\s*(.+)$", headers)] if m), None)
    sender = _property(file, "5D01") or _property(file, "0C1F") or _property(file, "0C1A") or header("From")
    to = []
    for folder in sorted({n.split("/")[0] + "/" for n in file.names if n.startswith("__recip_version1.0_")}):
        raw = file.stream(folder + "__properties_version1.0") or b""
        kinds = [struct.unpack_from("<I", raw, i + 8)[0] for i in range(8, len(raw) - 15, 16) if raw[i + 2 : i + 4] == b"\x15\x0c"]
        who = _property(file, "39FE", folder) or _property(file, "3003", folder) or _property(file, "3001", folder)
        if who and (not kinds or kinds[0] == 1):
            to.append(who)
    receiver = ", ".join(to) or _property(file, "0E04") or header("To")
    lines = [f"**{k}:** {v}" for k, v in (("From", sender), ("To", receiver), ("Subject", subject or header("Subject"))) if v]
    return ("# Email Message\n\n" + "\n".join(lines) + "\n\n## Content\n\n" + (body or "")).strip(), subject
