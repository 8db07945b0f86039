"""7z archives: the list of members, and their contents as a stream. Copy, LZMA, LZMA2, Deflate and BZip2, with delta and branch filters; encryption and BCJ2 are not read."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

MAGIC = b"7z\xbc\xaf\x27\x1c"
_HEADER, _ARCHIVE_PROPERTIES, _MORE_STREAMS, _MAIN_STREAMS, _FILES = 1, 2, 3, 4, 5
_PACK, _UNPACK, _SUB, _SIZE, _CRC, _FOLDER, _UNPACK_SIZE, _NUMBER = 6, 7, 8, 9, 10, 11, 12, 13
_EMPTY_STREAM, _EMPTY_FILE, _NAMES, _ATTRIBUTES, _ENCODED = 14, 15, 17, 21, 23
_FILTERS = {b"\x03\x03\x01\x03": lzma.FILTER_X86, b"\x04": lzma.FILTER_X86, b"\x03\x03\x02\x05": lzma.FILTER_POWERPC, b"\x03\x03\x04\x01": lzma.FILTER_IA64, b"\x03\x03\x05\x01": lzma.FILTER_ARM, b"\x03\x03\x07\x01": lzma.FILTER_ARMTHUMB, b"\x03\x03\x08\x05": lzma.FILTER_SPARC}
_CHUNK = 1 << 16


class BadSevenZip(ValueError):
    """Bytes that are no 7z archive, or one of a kind that is not read."""


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise BadSevenZip("the header ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """The format's own: the first byte's leading ones say how many bytes follow."""
        first, mask, value = self.byte(), 0x80, 0
        for k in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * k
            value |= self.byte() << 8 * k
            mask >>= 1
        return value

    def count(self) -> int:
        n = self.number()
        if n > len(self.data) * 8:
            raise BadSevenZip("a number in the header is too large")
        return n

    def bits(self, n: int) -> list[bool]:
        data = self.take(-(-n // 8))
        return [bool(data[k // 8] >> 7 - k % 8 & 1) for k in range(n)]

    def flags(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)


@dataclass
class _Folder:
    coders: list[tuple[bytes, bytes]]
    order: list[int]
    sizes: list[int] = field(default_factory=list)
    packed: int = 1
    start: int = 0
    length: int = 0
    files: list[int] = field(default_factory=list)

    @property
    def size(self) -> int:
        return self.sizes[self.order[-1]]


def _folder(b: _Bytes) -> _Folder:
    coders, simple = [], True
    for _ in range(b.count()):
        head = b.byte()
        name = b.take(head & 15)
        if head & 16:
            simple = simple and b.number() == 1 == b.number()
        coders.append((name, b.take(b.count()) if head & 32 else b""))
    if not coders or not simple:
        raise BadSevenZip("coders with several streams are not supported")
    feeds = {}
    for _ in range(len(coders) - 1):
        into, out = b.number(), b.number()
        feeds[out] = into  # what coder `out` gives is what coder `into` reads
    at = [k for k in range(len(coders)) if k not in feeds.values()]
    order = at[:1]
    while order and order[-1] in feeds:
        order.append(feeds[order[-1]])
    if sorted(order) != list(range(len(coders))):
        raise BadSevenZip("the coders are no chain")
    return _Folder(coders, order)


def _digests(b: _Bytes, n: int) -> list[bool]:
    known = b.flags(n)
    b.take(4 * sum(known))
    return known


def _streams(b: _Bytes) -> list[_Folder]:
    base, sizes, folders, subs, known = 0, [], [], None, []
    while (kind := b.byte()) != 0:
        if kind == _PACK:
            base, n = b.number(), b.count()
            while (what := b.byte()) != 0:
                if what == _SIZE:
                    sizes = [b.number() for _ in range(n)]
                elif what == _CRC:
                    _digests(b, n)
        elif kind == _UNPACK:
            known = []
            while (what := b.byte()) != 0:
                if what == _FOLDER:
                    n = b.count()
                    if b.byte():
                        raise BadSevenZip("external folders are not supported")
                    folders = [_folder(b) for _ in range(n)]
                elif what == _UNPACK_SIZE:
                    for f in folders:
                        f.sizes = [b.number() for _ in f.coders]
                elif what == _CRC:
                    known = _digests(b, len(folders))
        elif kind == _SUB:
            subs = _substreams(b, folders, known)
        else:
            raise BadSevenZip("unknown part of the header")
    at = base
    for f, n in zip(folders, sizes, strict=True):
        f.start, f.length = at, n
        at += n
    for k, f in enumerate(folders):
        f.files = subs[k] if subs is not None else [f.size]
    return folders


def _substreams(b: _Bytes, folders: list[_Folder], known: list[bool]) -> list[list[int]]:
    numbers = [1] * len(folders)
    kind = b.byte()
    if kind == _NUMBER:
        numbers = [b.count() for _ in folders]
        kind = b.byte()
    sizes = []
    for f, n in zip(folders, numbers, strict=True):
        own = [b.number() for _ in range(n - 1)] if kind == _SIZE else []
        if n and len(own) != n - 1:
            raise BadSevenZip("sizes are missing")
        sizes.append([*own, f.size - sum(own)] if n else [])
    if kind == _SIZE:
        kind = b.byte()
    while kind != 0:
        if kind != _CRC:
            raise BadSevenZip("unknown part of the header")
        _digests(b, sum(n for k, n in enumerate(numbers) if not (n == 1 and k < len(known) and known[k])))
        kind = b.byte()
    return sizes


def _decoder(name: bytes, properties: bytes, after: list[dict]) -> Callable[[bytes, int], bytes]:
    """A function from some input and the most bytes wanted to output; branch filters go with the LZMA coder before them."""
    if name in (b"\x03\x01\x01", b"\x21"):
        if name == b"\x21":
            bits = properties[0]
            own = {"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if bits >= 40 else (2 | bits & 1) << bits // 2 + 11}
        else:
            k, size = properties[0], struct.unpack("<I", properties[1:5])[0]
            own = {"id": lzma.FILTER_LZMA1, "dict_size": max(size, 4096), "lc": k % 9, "lp": k // 9 % 5, "pb": k // 45}
        d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[*after[::-1], own])
        return lambda data, most: b"" if d.eof else d.decompress(data, most)
    if after:
        raise BadSevenZip("a filter without LZMA is not supported")
    if name == b"\0":
        held = bytearray()

        def copy(data: bytes, most: int) -> bytes:
            held.extend(data)
            out = bytes(held[:most])
            del held[:most]
            return out

        return copy
    if name == b"\x04\x01\x08":
        z = zlib.decompressobj(-15)
        return lambda data, most: z.decompress(z.unconsumed_tail + data, most)
    if name == b"\x04\x02\x02":
        u = bz2.BZ2Decompressor()
        return lambda data, most: b"" if u.eof else u.decompress(data, most)
    raise BadSevenZip(f"method {name.hex()} is not supported")


def _opened(data: bytes, f: _Folder) -> Callable[[int], bytes]:
    """read(n): the next n bytes of a folder; no more than they is unpacked."""
    chain = [f.coders[k] for k in f.order]
    filters = []
    while len(chain) > 1 and (chain[-1][0] in _FILTERS or chain[-1][0] == b"\x03"):
        name, properties = chain.pop()
        filters.insert(0, {"id": lzma.FILTER_DELTA, "dist": (properties or b"\0")[0] + 1} if name == b"\x03" else {"id": _FILTERS[name]})
    if len(chain) != 1:
        raise BadSevenZip("chains of packers are not supported")
    step, at, end = _decoder(*chain[0], filters), 32 + f.start, 32 + f.start + f.length
    if end > len(data):
        raise BadSevenZip("the archive ends too early")

    def read(n: int) -> bytes:
        nonlocal at
        out, dry = bytearray(), 0
        while len(out) < n:
            got = step(b"", n - len(out))
            if not got:
                part = data[at : min(end, at + _CHUNK)]
                at += len(part)
                got = step(part, n - len(out))
                dry = 0 if got or part else dry + 1
                if dry > 2:
                    raise BadSevenZip("the data end too early")
            out += got
        return bytes(out)

    return read


def _header(data: bytes) -> _Bytes | None:
    if data[:6] != MAGIC or len(data) < 32:
        raise BadSevenZip("not a 7z archive")
    offset, size, crc = struct.unpack_from("<QQI", data, 12)
    if not size:
        return None
    raw = data[32 + offset : 32 + offset + size]
    if len(raw) != size or zlib.crc32(raw) != crc:
        raise BadSevenZip("the header is damaged")
    b = _Bytes(raw)
    while (kind := b.byte()) == _ENCODED:
        f = _streams(b)[0]
        b = _Bytes(_opened(data, f)(f.size))
    if kind != _HEADER:
        raise BadSevenZip("no header")
    return b


def members(data: bytes) -> Iterator[tuple[str, int, bool, Callable[[int], bytes] | None]]:
    """(name, size, is_dir, read) in the archive's order; read(n) gives a member's next n bytes, until the next member is asked for.

    Bytes of members before it in the same folder that were not read are unpacked and dropped.
    """
    b = _header(data)
    if b is None:
        return
    folders: list[_Folder] = []
    kind = b.byte()
    if kind == _ARCHIVE_PROPERTIES:
        while b.byte() != 0:
            b.take(b.count())
        kind = b.byte()
    if kind == _MORE_STREAMS:
        _streams(b)
        kind = b.byte()
    if kind == _MAIN_STREAMS:
        folders, kind = _streams(b), b.byte()
    if kind != _FILES:
        return
    n = b.count()
    empty, no_folder, names, attributes = [False] * n, [], [""] * n, [0] * n
    while (kind := b.byte()) != 0:
        part = _Bytes(b.take(b.count()))
        if kind == _EMPTY_STREAM:
            empty = part.bits(n)
        elif kind == _EMPTY_FILE:
            no_folder = part.bits(sum(empty))
        elif kind == _NAMES:
            if part.byte():
                raise BadSevenZip("external names are not supported")
            names = part.data[1:].decode("utf-16-le", "replace").split("\0")[:n]
        elif kind == _ATTRIBUTES:
            known = part.flags(n)
            if not part.byte():
                attributes = [struct.unpack("<I", part.take(4))[0] if k else 0 for k in known]
    files = iter(no_folder + [False] * n)
    streams = iter([(k, size) for k, f in enumerate(folders) for size in f.files])
    open_, read, behind = -1, None, 0
    for name, none, bits in zip(names, empty, attributes, strict=True):
        if none:
            is_dir = not next(files)
            yield name + "/" * (is_dir and not name.endswith("/")), 0, is_dir, None
            continue
        k, size = next(streams)
        if k != open_:
            open_, read, behind = k, None, 0
        used = 0

        def take(want: int, k=k, size=size) -> bytes:
            nonlocal read, behind, used
            if read is None:
                read = _opened(data, folders[k])
            while behind:
                behind -= len(read(min(behind, _CHUNK)))
            want = min(want, size - used)
            used += want
            return read(want) if want else b""

        yield name, size, bool(bits & 16), take
        behind += size - used
