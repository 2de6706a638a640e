"""Zip containers of documents: a guarded reader and a writer that copies unchanged entries byte for byte."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

# Limits of a package.
MAX_PARTS, MAX_PART, MAX_TOTAL = 10_000, 512 << 20, 3 << 29


class Broken(ValueError):
    """A container that can't be read; the message is its diagnostic."""


@dataclass
class Entry:
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    offset: int
    record: bytes  # of the central directory
    end: int = 0  # of the entry's bytes in the file


def _u(fmt: str, data: bytes, at: int) -> tuple:
    try:
        return struct.unpack_from(fmt, data, at)
    except struct.error:
        raise Broken("truncated") from None


def neutral_extra(extra: bytes) -> bytes:
    """An extra field whose Unicode path records (0x7075) are renamed, so that the entry's own name counts."""
    out, at = bytearray(extra), 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 0x7075:
            struct.pack_into("<H", out, at, 0xFFFF)
        at += 4 + size
    return bytes(out)


def directory(data: bytes) -> list[Entry]:
    """Entries in the order of the central directory; limits are checked before anything is inflated."""
    at = data.rfind(b"PK\5\6", max(0, len(data) - 65557))
    if at < 0:
        raise Broken("no end of central directory")
    count, _, start = _u("<HII", data, at + 10)
    if count > MAX_PARTS:
        raise Broken("too many parts")
    entries, total, pos = [], 0, start
    for _ in range(count):
        if data[pos : pos + 4] != b"PK\1\2":
            raise Broken("bad central directory")
        _, _, flags, method, _, _, crc, packed, size, n, x, c, _, _, _, offset = _u("<HHHHHHIIIHHHHHII", data, pos + 4)
        raw = data[pos + 46 : pos + 46 + n]
        name = raw.decode("utf-8" if flags & 0x800 else "cp437", errors="replace")
        record = data[pos : pos + 46 + n] + neutral_extra(data[pos + 46 + n : pos + 46 + n + x]) + data[pos + 46 + n + x : pos + 46 + n + x + c]
        if size > MAX_PART:
            raise Broken("part too large")
        total += size
        if total > MAX_TOTAL:
            raise Broken("package too large")
        entries.append(Entry(name, method, flags, crc, packed, size, offset, record))
        pos += 46 + n + x + c
    order = sorted(entries, key=lambda e: e.offset)
    for e, after in zip(order, [*(o.offset for o in order[1:]), start]):
        e.end = after
    return entries


def read(data: bytes, e: Entry) -> bytes:
    """The inflated bytes of one entry."""
    if data[e.offset : e.offset + 4] != b"PK\3\4":
        raise Broken("bad local header")
    n, x = _u("<HH", data, e.offset + 26)
    body = data[e.offset + 30 + n + x : e.offset + 30 + n + x + e.packed]
    if e.method == 0:
        out = body
    elif e.method == 8:
        try:
            unzip = zlib.decompressobj(-15)
            out = unzip.decompress(body, MAX_PART + 1)
        except zlib.error:
            raise Broken("bad deflate data") from None
    else:
        raise Broken("unknown compression")
    if len(out) > MAX_PART:
        raise Broken("part too large")
    if zlib.crc32(out) != e.crc:
        raise Broken("checksum differs")
    return out


def _local(name: bytes, content: bytes) -> tuple[bytes, bytes]:
    """(local header and data, central record without offset) of a new entry, dated 1980-01-01."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(content) + packer.flush()
    crc = zlib.crc32(content)
    head = struct.pack("<HHHHHIIIHH", 20, 0x800, 8, 0, 33, crc, len(packed), len(content), len(name), 0)
    return b"PK\3\4" + head + name + packed, b"PK\1\2" + struct.pack("<H", 20) + head + struct.pack("<HHHII", 0, 0, 0, 0, 0) + name


def rewrite(data: bytes | None, changed: dict[str, bytes | None]) -> bytes:
    """The container with some parts replaced, added or (None) taken out. Without changes the bytes are the same.

    Entries that stay are copied as they lie, in their old order; new ones follow.
    """
    if data is not None and not changed:
        return data
    out, central = bytearray(), []
    left = dict(changed)
    for e in directory(data) if data is not None else []:
        at = len(out)
        if e.name in left:
            content = left.pop(e.name)
            if content is None:
                continue
            body, record = _local(e.name.encode(), content)
            out += body
        else:
            out += data[e.offset : e.end]
            record = e.record
        central.append(record[:42] + struct.pack("<I", at) + record[46:])
    for name, content in left.items():
        if content is not None:
            at = len(out)
            body, record = _local(name.encode(), content)
            out += body
            central.append(record[:42] + struct.pack("<I", at) + record[46:])
    start = len(out)
    out += b"".join(central)
    out += b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(central), len(central), len(out) - start, start, 0)
    return bytes(out)
