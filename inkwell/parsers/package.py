"""Zip packages, entry by entry."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

#: Archives nested deeper, or that would unpack to more bytes, are refused.
DEEPEST, MOST_BYTES = 8, 1 << 30


def open_zip(data: bytes) -> zipfile.ZipFile:
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError(f"not a zip package: {e}") from None
    if sum(i.file_size for i in package.infolist()) > MOST_BYTES:
        raise ValueError("the package unpacks to too many bytes")
    return package


def read(package: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        return package.read(name)
    except KeyError:
        return None


def each(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of the files of an archive, one after the other as stored."""
    package = open_zip(data)
    for i in package.infolist():
        if not i.is_dir():
            yield i.filename, package.read(i)
