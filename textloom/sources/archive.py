"""ZIP archives, damaged ones too, and the decoding of markup."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

from textloom.sources.model import ReadError


class Archive:
    """Members of a ZIP by name, whatever its case. A broken directory is rebuilt from the local headers."""

    def __init__(self, data: bytes):
        self._data = data
        self._found: dict[str, object] = {}
        try:
            self._zip = zipfile.ZipFile(io.BytesIO(data))
            for info in self._zip.infolist():
                self._found.setdefault(info.filename, info)
        except (zipfile.BadZipFile, struct.error, ValueError, NotImplementedError, OSError):
            self._zip = None
            self._scan()
        if not self._found and b"PK\x05\x06" not in data:
            raise ReadError("zipDamaged", "no members")
        self._lower = {name.lower(): name for name in reversed(list(self._found))}

    def _scan(self) -> None:
        for m in re.finditer(rb"PK\x03\x04", self._data):
            if len(self._data) < m.start() + 30:
                break
            flags, method, _, _, _, packed, _, n, extra = struct.unpack_from("<2xHHHHIIIHH", self._data, m.start() + 4)
            name = self._data[m.start() + 30 : m.start() + 30 + n]
            self._found.setdefault(name.decode("utf-8" if flags & 0x800 else "cp437", "replace"), (flags, method, packed, m.start() + 30 + n + extra))

    def names(self) -> list[str]:
        return list(self._found)

    def __contains__(self, name: str) -> bool:
        return name in self._found or name.lower() in self._lower

    def read(self, name: str) -> bytes:
        entry = self._found[name if name in self._found else self._lower[name.lower()]]
        if not isinstance(entry, tuple):
            if entry.flag_bits & 1:
                raise ReadError("encrypted")
            try:
                return self._zip.read(entry)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError) as error:
                raise ReadError("zipDamaged", str(error)) from error
        flags, method, packed, at = entry
        if flags & 1:
            raise ReadError("encrypted")
        if method == 0:
            return self._data[at : at + packed]
        try:
            return zlib.decompressobj(-15).decompress(self._data[at:])
        except zlib.error as error:
            raise ReadError("zipDamaged", str(error)) from error

    def text(self, name: str) -> str:
        return decode_markup(self.read(name))


def decode_markup(data: bytes) -> str:
    """Markup by its byte-order mark, by the encoding that its first kilobyte names, else as UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    named = re.search(rb"""(?:encoding=|<meta[^>]+charset=)["']?([\w.:-]+)""", data[:1024], re.I)
    try:
        return data.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")
