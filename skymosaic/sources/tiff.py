"""TIFF files read by byte ranges: headers, and windows of which only the strips or tiles that they meet are fetched.

Classic and big files of either byte order; blocks in strips or tiles, plain, LZW, deflated or PackBits, with or without
horizontal differences; samples of 8, 16 or 32 bits, unsigned, signed or floating, by pixel or by plane. What is not of
these kinds, or damaged, raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

from .files import Held, Ranges

# Tags and types of the TIFF format, keys of its geographic extension.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIE, MATRIX, KEYS = 33550, 33922, 34264, 34735
SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "Q", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
PROJECTED, GEOGRAPHIC = 3072, 2048
CLEAR, END, FIRST = 256, 257, 258
#: Values of a tag at most: a damaged count must not ask for the whole file.
MOST_VALUES = 1 << 26


def tags_of(source: Ranges | Held) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first picture of a file."""
    start = source.read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = order and struct.unpack(order + "H", start[2:4])[0]
    if version == 42:
        at, count, entry, width = struct.unpack(order + "I", start[4:])[0], "H", "HHI", 4
    elif version == 43:
        at, count, entry, width = struct.unpack(order + "Q", source.read(8, 8))[0], "Q", "HHQ", 8
    else:
        raise ValueError("no TIFF file")
    head = struct.calcsize(order + count)
    n = struct.unpack(order + count, source.read(at, head))[0]
    size = struct.calcsize(order + entry) + width
    if n > 4096:
        raise ValueError("too many tags")
    table = source.read(at + head, n * size)
    found = {}
    for k in range(n):
        tag, kind, values = struct.unpack_from(order + entry, table, k * size)
        if kind not in SIZES or values > MOST_VALUES:
            continue
        form = f"{order}{values}{SIZES[kind]}"
        need = struct.calcsize(form)
        own = table[(k + 1) * size - width : (k + 1) * size]
        data = own[:need] if need <= width else source.read(struct.unpack(order + ("I" if width == 4 else "Q"), own)[0], need)
        found[tag] = struct.unpack(form, data)
    return order, found


def header_of(source: Ranges | Held | bytes) -> dict:
    _, t = tags_of(Held(source) if isinstance(source, bytes) else source)
    if WIDTH not in t or HEIGHT not in t:
        raise ValueError("no size")
    if MATRIX in t:
        m = t[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in t and TIE in t:
        (sx, sy), (i, j, _, x, y) = t[SCALE][:2], t[TIE][:5]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = None
    keys = t.get(KEYS, ())
    known = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    epsg = known.get(PROJECTED, known.get(GEOGRAPHIC))
    return {"width": t[WIDTH][0], "height": t[HEIGHT][0], "bands": t.get(SAMPLES, (1,))[0], "epsg": epsg, "transform": transform and dict(zip("abcdef", map(float, transform)))}


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a code's width grows one code early, as the format has it."""
    table: list[bytes] = [bytes([k]) for k in range(256)] + [b"", b""]
    out: list[bytes] = []
    held = bits = 0
    width, before = 9, b""
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            del table[FIRST:]
            width, before = 9, b""
            continue
        if not before:
            if code >= 256:
                raise ValueError("damaged LZW codes")
            before = table[code]
            out.append(before)
            continue
        if code < len(table):
            text = table[code]
        elif code == len(table):
            text = before + before[:1]
        else:
            raise ValueError("damaged LZW codes")
        out.append(text)
        table.append(before + text[:1])
        before = text
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
        if len(table) > 4096:
            raise ValueError("damaged LZW codes")
    return b"".join(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


class Picture:
    """The first picture of a file and how its blocks lie."""

    def __init__(self, source: Ranges | Held):
        self.source = source
        self.order, t = tags_of(source)
        one = lambda tag, otherwise: t.get(tag, (otherwise,))[0]
        if WIDTH not in t or HEIGHT not in t:
            raise ValueError("no size")
        self.width, self.height, self.bands = t[WIDTH][0], t[HEIGHT][0], one(SAMPLES, 1)
        bits, form = one(BITS, 1), one(FORMAT, 1)
        kind = {1: "u", 2: "i", 3: "f"}.get(form)
        if kind is None or bits not in (8, 16, 32) or (kind == "f" and bits != 32) or len(set(t.get(BITS, (1,)))) > 1:
            raise ValueError("samples must be of 8, 16 or 32 bits, all alike")
        self.kind = np.dtype(f"{self.order}{kind}{bits // 8}")
        self.compression, self.predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
        if self.compression not in (PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE):
            raise ValueError(f"compression {self.compression} is not known")
        if self.predictor not in (1, 2) or self.predictor == 2 and kind == "f":
            raise ValueError(f"predictor {self.predictor} is not known")
        self.planes = self.bands if one(PLANAR, 1) == 2 else 1
        self.tiled = TILE_OFFSETS in t or TILE_WIDTH in t
        if self.tiled:
            self.block_w, self.block_h, self.at, self.sizes = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), t.get(TILE_OFFSETS, t.get(OFFSETS, ())), t.get(TILE_COUNTS, t.get(COUNTS, ()))
        else:
            self.block_w, self.block_h, self.at, self.sizes = self.width, min(one(ROWS, self.height), self.height), t.get(OFFSETS, ()), t.get(COUNTS, ())
        if not (self.width > 0 and self.height > 0 and self.bands > 0 and self.block_w > 0 and self.block_h > 0):
            raise ValueError("sizes must be above 0")
        self.across, self.down = -(-self.width // self.block_w), -(-self.height // self.block_h)
        if len(self.at) < self.across * self.down * self.planes or len(self.sizes) < len(self.at):
            raise ValueError("blocks are missing")

    def block(self, x: int, y: int, plane: int) -> np.ndarray:
        """Rows x columns x samples of a block; strips at the lower edge are shorter, tiles are always whole."""
        k = (plane * self.down + y) * self.across + x
        samples = self.bands if self.planes == 1 else 1
        rows = self.block_h if self.tiled else min(self.block_h, self.height - y * self.block_h)
        want = rows * self.block_w * samples
        if not self.sizes[k]:  # a block that was never written is empty
            return np.zeros((rows, self.block_w, samples), self.kind)
        data = self.source.read(self.at[k], self.sizes[k])
        try:
            if self.compression == LZW:
                data = unpack_lzw(data)
            elif self.compression in (DEFLATE, OLD_DEFLATE):
                data = zlib.decompress(data)
            elif self.compression == PACKBITS:
                data = unpack_bits(data)
        except zlib.error as e:
            raise ValueError(f"a block is damaged: {e}") from e
        if len(data) < want * self.kind.itemsize:
            raise ValueError("a block is too short")
        out = np.frombuffer(data, self.kind, want).reshape(rows, self.block_w, samples)
        return np.cumsum(out, axis=1, dtype=self.kind.newbyteorder("=")) if self.predictor == 2 else out

    def window(self, x: int, y: int, width: int, height: int, blocks: dict | None = None) -> np.ndarray:
        """height x width x bands; what lies outside the picture is cut off. `blocks` keeps those that later windows may need."""
        x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + width, self.width), min(y + height, self.height)
        kind = self.kind.newbyteorder("=")
        if x1 <= x0 or y1 <= y0:
            return np.zeros((0, 0, self.bands), kind)
        out = np.empty((y1 - y0, x1 - x0, self.bands), kind)
        blocks = {} if blocks is None else blocks
        for by in range(y0 // self.block_h, (y1 - 1) // self.block_h + 1):
            for bx in range(x0 // self.block_w, (x1 - 1) // self.block_w + 1):
                for plane in range(self.planes):
                    if (bx, by, plane) not in blocks:
                        blocks[bx, by, plane] = self.block(bx, by, plane)
                    data = blocks[bx, by, plane]
                    top, left = by * self.block_h, bx * self.block_w
                    a, b, c, d = max(y0, top), min(y1, top + data.shape[0]), max(x0, left), min(x1, left + self.block_w)
                    bands = slice(plane, plane + 1) if self.planes > 1 else slice(None)
                    out[a - y0 : b - y0, c - x0 : d - x0, bands] = data[a - top : b - top, c - left : d - left]
        return out


def window_of(content: bytes, x: int, y: int, width: int, height: int) -> np.ndarray:
    return Picture(Held(content)).window(x, y, width, height)


def tiff_bytes(x: np.ndarray, transform: Sequence[float] | None = None, epsg: int | None = None, packed: bool = True) -> bytes:
    """A TIFF of rows x columns x bands (8 or 16 bits) in strips, with its place where one is given."""
    h, w, bands = x.shape
    rows = max(1, 65_536 // max(1, w * bands * x.itemsize))
    strips = [np.ascontiguousarray(x[i : i + rows]).astype(x.dtype.newbyteorder("<")).tobytes() for i in range(0, h, rows)]
    strips = [zlib.compress(s) for s in strips] if packed else strips
    starts = np.cumsum([8, *map(len, strips)]).tolist()
    entries = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (8 * x.itemsize,) * bands), (COMPRESSION, 3, (DEFLATE if packed else PLAIN,)), (PHOTOMETRIC, 3, (2 if bands >= 3 else 1,)), (OFFSETS, 4, tuple(starts[:-1])), (SAMPLES, 3, (bands,)), (ROWS, 4, (rows,)), (COUNTS, 4, tuple(map(len, strips))), (PLANAR, 3, (1,))]
    if transform is not None:
        a, b, c, d, e, f = transform
        entries.append((MATRIX, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    if epsg is not None:
        entries.append((KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, GEOGRAPHIC if epsg == 4326 else PROJECTED, 0, 1, epsg)))
    at = starts[-1] + starts[-1] % 2
    extra, fields = b"", b""
    after = at + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        data = struct.pack(f"<{len(values)}{SIZES[kind]}", *values)
        if len(data) > 4:
            fields += struct.pack("<HHII", tag, kind, len(values), after + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        else:
            fields += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    body = b"".join(strips)
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(entries)) + fields + struct.pack("<I", 0) + extra
