"""Archive directories and entries of packaged books, read from bytes.

Errors that end a book are raised as Fatal with what they are about; all else
is given as diagnostics by the callers.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field, replace

#: Limits of the format's reader, in bytes. Fixed values.
MAX_ENTRY = 256 << 20
MAX_METADATA = 4 << 20
SAFE_INTEGER = 1 << 53
_FULL = 0xFFFFFFFF

_END = struct.Struct("<4s4H2IH")
_LOCATOR = struct.Struct("<4sIQI")
_END64 = struct.Struct("<4sQ2H2I4Q")
_CENTRAL = struct.Struct("<4s6H3I5H2I")
_LOCAL = struct.Struct("<4s5H3I2H")


class Fatal(Exception):
    """A book that can't be read: kind is container, encrypted or package."""

    def __init__(self, kind: str, message: str, scheme: str | None = None, href: str | None = None):
        super().__init__(message)
        self.kind, self.message, self.scheme, self.href = kind, message, scheme, href


@dataclass(frozen=True)
class Entry:
    ord: int
    name: str
    raw_name: str
    name_len: int
    flags: int
    method: int
    csize: int
    usize: int
    lho: int
    crc32: int
    invalid: str | None

    @property
    def is_dir(self) -> bool:
        return self.name.endswith("/")


@dataclass
class Directory:
    entries: list[Entry]
    delta: int
    zip64: bool
    duplicates: list[Entry] = field(default_factory=list)

    def __post_init__(self):
        self.by_name: dict[str, Entry] = {}
        self.by_folded: dict[str, Entry] = {}
        for e in self.entries:
            if e.is_dir:
                continue
            if e.name in self.by_name:
                self.duplicates.append(e)
            else:
                self.by_name[e.name] = e
                self.by_folded.setdefault(e.name.lower(), e)

    def find(self, path: str) -> Entry | None:
        """The entry of this very name, else the first that differs in case only."""
        return self.by_name.get(path) or self.by_folded.get(path.lower())


def entry_name(raw: str) -> str:
    return re.sub(r"^(\.?/)+", "", raw.replace("\\", "/"))


def _name(raw: bytes, flags: int) -> str:
    if flags & 0x800:
        return raw.decode("utf-8", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp437")


def read_directory(data: bytes) -> Directory:
    """The central directory: the record at the end, its 64-bit form if a locator stands before it, then all entries."""
    at = data.rfind(b"PK\5\6", max(0, len(data) - 65_577))
    while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):
        at = data.rfind(b"PK\5\6", max(0, len(data) - 65_577), at + 3)
    if at < 0:
        raise Fatal("container", "no end of central directory")
    _, disk, first_disk, _, _, size, offset, _ = _END.unpack_from(data, at)
    end, zip64 = at, False
    if at >= 20 and data[at - 20 : at - 16] == b"PK\6\7":
        _, where, declared, disks = _LOCATOR.unpack_from(data, at - 20)
        if where or disks > 1:
            raise Fatal("container", "archive of several disks")
        for end in (declared, at - 76):
            if 0 <= end <= at - 76 and data[end : end + 4] == b"PK\6\6":
                break
        else:
            raise Fatal("container", "no 64-bit end of central directory")
        _, _, _, _, disk, first_disk, _, _, size, offset = _END64.unpack_from(data, end)
        zip64 = True
    if disk or first_disk:
        raise Fatal("container", "archive of several disks")
    delta = end - size - offset
    if size > end or delta < 0:
        raise Fatal("container", "central directory doesn't fit")
    begin = offset + delta
    return Directory(mark_overlaps(list(_entries(data[begin : begin + size], delta, len(data)))), delta, zip64)


def _entries(cd: bytes, delta: int, length: int):
    p = n = 0
    while p < len(cd):
        if p + 46 > len(cd) or cd[p : p + 4] != b"PK\1\2":
            raise Fatal("container", "central directory cut or damaged")
        (_, _, _, flags, method, _, _, crc, csize, usize, n_name, n_extra, n_comment, _, _, _, lho) = _CENTRAL.unpack_from(cd, p)
        extra_at = p + 46 + n_name
        after = extra_at + n_extra + n_comment
        if after > len(cd):
            raise Fatal("container", "central directory cut or damaged")
        raw = _name(cd[p + 46 : extra_at], flags)
        name = entry_name(raw)
        if flags & 1:
            raise Fatal("encrypted", "entry encrypted by the archive", "zip-encryption", name)
        (usize, csize, lho), huge = _wide([usize, csize, lho], cd[extra_at : extra_at + n_extra])
        yield Entry(n, name, raw, n_name, flags, method, csize or 0, usize or 0, (lho or 0) + delta, crc, _invalid(usize, csize, lho, huge, delta, length))
        p, n = after, n + 1


def _wide(values: list[int | None], extra: bytes) -> tuple[list[int | None], bool]:
    """Values that are full, in the format's order, from the 64-bit extra field; None where it ends too early or a value is beyond exact integers."""
    huge, q = False, 0
    while q + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, q)
        if q + 4 + size > len(extra):
            break
        if kind == 1:
            wide = [x[0] for x in struct.iter_unpack("<Q", extra[q + 4 : q + 4 + size - size % 8])]
            for i, v in enumerate(values):
                if v == _FULL:
                    values[i] = wide.pop(0) if wide else None
                    if values[i] is not None and values[i] > SAFE_INTEGER:
                        values[i], huge = None, True
            break
        q += 4 + size
    return values, huge


def _invalid(usize: int | None, csize: int | None, lho: int | None, huge: bool, delta: int, length: int) -> str | None:
    """The first reason not to read an entry."""
    if huge:
        return "beyond-exact-integers"
    if None in (usize, csize, lho) or _FULL in (usize, csize, lho):
        return "zip64-extra"
    if lho + delta >= length:
        return "header-beyond-end"
    if lho + delta + 30 + csize > length:
        return "data-beyond-end"
    return "too-large" if usize > MAX_ENTRY else None


def mark_overlaps(entries: list[Entry]) -> list[Entry]:
    """Entries that begin inside the last entry kept, in order of place, are invalid: they'd let few bytes become many."""
    limit, bad = -1, set()
    for e in sorted((e for e in entries if e.invalid is None and not e.is_dir), key=lambda e: (e.lho, e.ord)):
        if e.lho < limit:
            bad.add(e.ord)
        else:
            limit = e.lho + 30 + e.csize
    return [replace(e, invalid="overlap") if e.ord in bad else e for e in entries]


def read_entry(data: bytes, e: Entry) -> tuple[bytes, dict | None]:
    """An entry's bytes and, if they aren't as declared, what differs."""
    if e.invalid:
        raise Fatal("container", e.invalid, href=e.name)
    if e.method not in (0, 8):
        raise Fatal("container", f"compression method {e.method}", href=e.name)
    if data[e.lho : e.lho + 4] != b"PK\3\4" or e.lho + 30 > len(data):
        raise Fatal("container", "bad local header", href=e.name)
    *_, n_name, n_extra = _LOCAL.unpack_from(data, e.lho)
    begin = e.lho + 30 + n_name + n_extra
    if begin + e.csize > len(data):
        raise Fatal("container", "data-beyond-end", href=e.name)
    packed = data[begin : begin + e.csize]
    if e.method == 0:
        out = packed
    else:
        inflate = zlib.decompressobj(-15)
        try:
            out = inflate.decompress(packed, e.usize + 1)
        except zlib.error as error:
            raise Fatal("container", "bad deflate stream", href=e.name) from error
    if len(out) > e.usize:
        raise Fatal("container", "more than declared", href=e.name)
    if len(out) < e.usize:
        return out, {"reason": "size", "expected": str(e.usize), "actual": str(len(out))}
    if (crc := zlib.crc32(out)) != e.crc32:
        return out, {"reason": "crc", "expected": str(e.crc32), "actual": str(crc)}
    return out, None


def mimetype_problem(data: bytes, d: Directory) -> str | None:
    """missing, notFirst, compressed, unreadable or content; None if all is well."""
    e = d.by_name.get("mimetype")
    if e is None:
        return "missing"
    if min(d.entries, key=lambda x: x.lho) is not e or e.lho != d.delta:
        return "notFirst"
    if e.method != 0:
        return "compressed"
    try:
        return None if read_entry(data, e)[0] == b"application/epub+zip" else "content"
    except Fatal:
        return "unreadable"
