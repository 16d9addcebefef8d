"""Directories of ZIP archives: written as a stream, read by ranges, ZIP64 included.

Only stored members are made.  Their sizes follow them in a data descriptor, so a member of any
length is written without being held.  The reader takes sizes and places from the central
directory, in pieces of bounded size, and never unpacks an archive.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

# Signatures and field limits of the format (fixed values).
LOCAL, DESCRIPTOR, CENTRAL = b"PK\x03\x04", b"PK\x07\x08", b"PK\x01\x02"
END, END64, LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
ZIP64_FIELD, ZIP64_VERSION = 1, 45
#: Sizes come after the data; names are UTF-8.
FLAGS = 0x0808
#: 1 January 1980, the format's first day, so that equal contents give equal archives.
DOS_TIME, DOS_DATE = 0, 0x21
#: Bytes of a directory that are held at a time.
PIECE = 1 << 20

#: Reads ``size`` bytes (fewer at the end) from an offset.
Reader = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    method: int
    #: Where the data begins, and how long it is as it lies in the archive.
    offset: int
    size: int


class ZipStream:
    """Makes the bytes of an archive from left to right."""

    def __init__(self, zip64: bool = False):
        self.at, self.zip64, self.entries, self.n = 0, zip64, [], 0
        self.name, self.start, self.size, self.crc = b"", 0, 0, 0

    def _count(self, raw: bytes) -> bytes:
        self.at += len(raw)
        return raw

    def begin(self, name: str) -> bytes:
        self.name, self.start, self.size, self.crc = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", ZIP64_FIELD, 16, 0, 0)
        head = LOCAL + struct.pack("<HHHHHIIIHH", ZIP64_VERSION, FLAGS, 0, DOS_TIME, DOS_DATE, 0, FULL32, FULL32, len(self.name), len(extra))
        return self._count(head + self.name + extra)

    def data(self, raw: bytes) -> bytes:
        self.size += len(raw)
        self.crc = zlib.crc32(raw, self.crc)
        return self._count(raw)

    def end(self) -> bytes:
        tail = DESCRIPTOR + struct.pack("<IQQ", self.crc, self.size, self.size)
        large = [v if self.zip64 or v >= FULL32 else None for v in (self.size, self.size, self.start)]
        extra = b"".join(struct.pack("<Q", v) for v in large if v is not None)
        extra = struct.pack("<HH", ZIP64_FIELD, len(extra)) + extra if extra else b""
        short = [FULL32 if wide is not None else value for wide, value in zip(large, (self.size, self.size, self.start), strict=True)]
        self.entries.append(CENTRAL + struct.pack(
            "<HHHHHHIIIHHHHHII", ZIP64_VERSION, ZIP64_VERSION, FLAGS, 0, DOS_TIME, DOS_DATE, self.crc, short[0], short[1],
            len(self.name), len(extra), 0, 0, 0, 0, short[2]) + self.name + extra)
        return self._count(tail)

    def finish(self, comment: bytes = b"") -> bytes:
        directory, start, n = b"".join(self.entries), self.at, len(self.entries)
        raw = directory
        if self.zip64 or n >= FULL16 or start >= FULL32 or len(directory) >= FULL32:
            raw += END64 + struct.pack("<QHHIIQQQQ", 44, ZIP64_VERSION, ZIP64_VERSION, 0, 0, n, n, len(directory), start)
            raw += LOCATOR64 + struct.pack("<IQI", 0, start + len(directory), 1)
            n, size, start = FULL16, FULL32, FULL32
        else:
            size = len(directory)
        return self._count(raw + END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, len(comment)) + comment)


def _directory(read: Reader, length: int) -> tuple[int, int]:
    """Where the central directory begins and how long it is."""
    room = min(length, 22 + FULL16)
    tail = read(length - room, room)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    entries, size, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL32 in (size, start) or entries == FULL16:
        end = length - room + at
        locator = read(end - 20, 20) if end >= 20 else b""
        if locator[:4] == LOCATOR64:
            end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end of a central directory where its locator points")
            size, start = struct.unpack_from("<QQ", end64, 40)
    return start, size


def _long_fields(extra: bytes, values: list[int]) -> list[int]:
    """``values`` (size, packed size, offset) with those that are full taken from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_FIELD:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide) if v == FULL32 else v for v in values]
        at += 4 + size
    return values


def members(read: Reader, length: int) -> Iterator[Member]:
    """The members of an archive of ``length`` bytes, in the order of its central directory."""
    start, size = _directory(read, length)
    held, at, end = b"", start, start + size
    while at < end or held:
        if len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            more = read(at, min(PIECE, end - at))
            if not more:
                raise ValueError("the central directory is cut off")
            held, at = held + more, at + len(more)
            continue
        if held[:4] != CENTRAL:
            raise ValueError("no entry of a central directory where one must be")
        method, = struct.unpack_from("<H", held, 10)
        packed, whole = struct.unpack_from("<II", held, 20)
        name_size, extra_size, comment_size = struct.unpack_from("<HHH", held, 28)
        offset, = struct.unpack_from("<I", held, 42)
        name = held[46 : 46 + name_size].decode("utf-8", "replace")
        extra = held[46 + name_size : 46 + name_size + extra_size]
        whole, packed, offset = _long_fields(extra, [whole, packed, offset])
        held = held[46 + name_size + extra_size + comment_size :]
        local = read(offset, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no member where the central directory has {name}")
        yield Member(name, method, offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
