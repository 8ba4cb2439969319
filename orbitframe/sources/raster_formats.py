"""Layouts of raster files (TIFF, DTED, uncompressed NITF), their blocks decoded, and files made from pixels.

A file is opened with seek and read; its layout is read from headers alone.  A layout is a list of grids: an image segment
at an overview level.  Errors of the content are ValueError.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from typing import Any, BinaryIO
from xml.sax.saxutils import quoteattr

import numpy as np

from orbitframe.sources.rasters import PIXEL_SCALE, TIE_POINTS, TRANSFORM

#: Fixed values of the public TIFF format: tags, bytes and codes of field types.
SUBFILE, COMPRESSION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 254, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT, BITS, NO_DATA = 322, 323, 324, 325, 339, 258, 42113
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CODECS = {1: "raw", 5: "lzw", 8: "deflate", 32946: "deflate"}

#: Fixed widths of the fields of three tagged records.
_CORNERS = ("11", "12", "21", "22")
RECORDS = {
    "RPC00B": [("SUCCESS", 1), ("ERR_BIAS", 7), ("ERR_RAND", 7), ("LINE_OFF", 6), ("SAMP_OFF", 5), ("LAT_OFF", 8), ("LONG_OFF", 9), ("HEIGHT_OFF", 5), ("LINE_SCALE", 6), ("SAMP_SCALE", 5), ("LAT_SCALE", 8), ("LONG_SCALE", 9), ("HEIGHT_SCALE", 5)],
    "ICHIPB": [("XFRM_FLAG", 2), ("SCALE_FACTOR", 10), ("ANAMRPH_CORR", 2), ("SCANBLK_NUM", 2), *((f"{p}_{a}_{c}", 12) for p in ("OP", "FI") for c in _CORNERS for a in ("ROW", "COL")), ("FI_ROW", 8), ("FI_COL", 8)],
    "CSCRNA": [("PREDICT_CORNERS", 1), *((f"{c}CNR_{n}", w) for c in ("UL", "UR", "LR", "LL") for n, w in (("LAT", 9), ("LONG", 10), ("HT", 8)))],
}
RPC_POLYNOMIALS = ("LINE_NUM_COEFF", "LINE_DEN_COEFF", "SAMP_NUM_COEFF", "SAMP_DEN_COEFF")
RPC_TERMS, RPC_TERM_WIDTH = 20, 12


@dataclass
class Part:
    """Bytes of a block that hold the bands from a first one on."""

    offset: int
    count: int
    band: int
    bands: int


@dataclass
class Grid:
    """One image segment at one level.  order: axes of a block's values as stored, of y, x and b; parts: by block, row by row."""

    kind: str
    segment: int
    level: int
    width: int
    height: int
    block_width: int
    block_height: int
    bands: int
    dtype: str
    order: str
    parts: list[list[Part]]
    codec: str = "raw"
    predictor: int = 1
    padded: bool = True
    gt: list[float] | None = None
    no_data: float | None = None
    records: list[tuple[str, bytes]] = field(default_factory=list)
    extensions: list[tuple[str, bytes]] = field(default_factory=list)

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    def size_of(self, i: int) -> tuple[int, int, int, int]:
        """left, top, width and height of block i."""
        top, left = (i // self.across) * self.block_height, (i % self.across) * self.block_width
        return left, top, min(self.block_width, self.width - left), min(self.block_height, self.height - top)


def layout(f: BinaryIO, size: int) -> list[Grid]:
    """The grids of a file of so many bytes."""
    f.seek(0)
    head = f.read(16)
    try:
        if head[:2] in (b"II", b"MM"):
            return _tiff(f, head, size)
        if head[:4] == b"UHL1":
            return _dted(f, size)
        if head[:9] == b"NITF02.10":
            return _nitf(f, size)
    except (struct.error, KeyError, IndexError, UnicodeDecodeError, ZeroDivisionError) as e:
        raise ValueError(f"damaged raster header: {e!r}") from e
    raise ValueError("not a TIFF, DTED or NITF 2.1 file")


def _at(f: BinaryIO, offset: int, n: int) -> bytes:
    f.seek(offset)
    got = f.read(n)
    if len(got) < n:
        raise ValueError("file ends within what its header announces")
    return got


def _within(parts: list[list[Part]], size: int) -> list[list[Part]]:
    if any(p.offset + p.count > size for block in parts for p in block):
        raise ValueError("file ends within what its header announces")
    return parts


def _tiff(f: BinaryIO, head: bytes, size: int) -> list[Grid]:
    e = "<" if head[:2] == b"II" else ">"
    big = {42: False, 43: True}.get(struct.unpack(e + "H", head[2:4])[0])
    if big is None:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(e + "Q", head[8:16]) if big else struct.unpack(e + "I", head[4:8])
    count_code, entry, inline, word = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        width = struct.calcsize(e + count_code)
        (n,) = struct.unpack(e + count_code, _at(f, at, width))
        if n * entry > size:
            raise ValueError("damaged TIFF directory")
        raw = _at(f, at + width, n * entry + inline)
        tags: dict[int, Any] = {}
        for i in range(n):
            tag, kind, count = struct.unpack(e + "HH" + word, raw[i * entry : i * entry + 4 + inline])
            nbytes = SIZES.get(kind, 1) * count
            here = raw[i * entry + 4 + inline : (i + 1) * entry]
            if nbytes > size:
                raise ValueError("damaged TIFF directory")
            data = here[:nbytes] if nbytes <= inline else _at(f, struct.unpack(e + word, here)[0], nbytes)
            tags[tag] = data.rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(f"{e}{count}{CODES[kind]}", data) if kind in CODES else data
        out.append(_tiff_grid(tags, e, size, out))
        (at,) = struct.unpack(e + word, raw[n * entry :])
    return out


def _tiff_grid(tags: dict[int, Any], e: str, size: int, before: list[Grid]) -> Grid:
    one = lambda t, d=None: tags[t][0] if t in tags or d is None else d
    width, height, bands = one(256), one(257), one(SAMPLES, 1)
    bits, form, codec = set(tags.get(BITS, (1,))), one(SAMPLE_FORMAT, 1), CODECS.get(one(COMPRESSION, 1))
    if codec is None or len(bits) > 1 or not bits <= {8, 16, 32, 64} or form not in (1, 2, 3) or one(PREDICTOR, 1) not in (1, 2) or not width or not height:
        raise ValueError("a TIFF of a kind that is not read")
    tiled, separate = TILE_OFFSETS in tags, one(PLANAR, 1) == 2
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    n = -(-width // bw) * -(-height // bh)
    if len(offsets) != len(counts) or len(offsets) != n * (bands if separate else 1):
        raise ValueError("damaged TIFF directory")
    if separate:
        parts = [[Part(offsets[b * n + i], counts[b * n + i], b, 1) for b in range(bands)] for i in range(n)]
    else:
        parts = [[Part(offsets[i], counts[i], 0, bands)] for i in range(n)]
    gt = None
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        gt = [m[3], m[0], m[1], m[7], m[4], m[5]]
    elif PIXEL_SCALE in tags and TIE_POINTS in tags:
        (sx, sy), (i, j, _, x, y, _) = tags[PIXEL_SCALE][:2], tags[TIE_POINTS][:6]
        gt = [x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy]
    try:
        no_data = float(tags[NO_DATA]) if NO_DATA in tags else None
    except ValueError:
        no_data = None
    overview = bool(one(SUBFILE, 0) & 1) and bool(before)
    segment, level = (before[-1].segment, before[-1].level + 1) if overview else (before[-1].segment + 1 if before else 0, 0)
    return Grid("tiff", segment, level, width, height, bw, bh, bands, f"{e}{'_uif'[form]}{bits.pop() // 8}", "yxb", _within(parts, size), codec, one(PREDICTOR, 1), tiled, gt, no_data)


#: Bytes of a DTED file before its profiles and around the posts of one; profiles of a block.
DTED_HEAD, DTED_BEFORE, DTED_AFTER, DTED_PROFILES = 3428, 8, 4, 64


def _dted(f: BinaryIO, size: int) -> list[Grid]:
    h = _at(f, 0, 80).decode("ascii")
    angle = lambda t: (int(t[:3]) + int(t[3:5]) / 60 + int(t[5:7]) / 3600) * (-1 if t[7] in "WS" else 1)
    west, south, dx, dy, width, height = angle(h[4:12]), angle(h[12:20]), int(h[20:24]) / 36000, int(h[24:28]) / 36000, int(h[47:51]), int(h[51:55])
    record = DTED_BEFORE + 2 * height + DTED_AFTER
    starts = range(0, width, DTED_PROFILES)
    parts = [[Part(DTED_HEAD + x * record, record * min(DTED_PROFILES, width - x), 0, 1)] for x in starts]
    gt = [west, dx, 0.0, south + dy * (height - 1), 0.0, -dy]  # of posts, as in text grids
    return [Grid("dted", 0, 0, width, height, DTED_PROFILES, height, 1, ">u2", "xy", _within(parts, size), "dted", gt=gt, no_data=-32767.0)]


class _Fields:
    """Fields of fixed width, one after another."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        got = self.data[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("file ends within a header")
        self.at += n
        return got

    def text(self, n: int) -> str:
        return self.take(n).decode("latin-1").strip()

    def number(self, n: int) -> int:
        return int(self.take(n))


def _records(data: bytes) -> list[tuple[str, bytes]]:
    f, out = _Fields(data), []
    while f.at + 11 <= len(data):
        name, n = f.text(6), f.number(5)
        out.append((name, f.take(n)))
    return out


def _extended(f: _Fields) -> list[tuple[str, bytes]]:
    n = f.number(5)
    return _records(f.take(n)[3:]) if n else []


def _nitf(f: BinaryIO, size: int) -> list[Grid]:
    length = int(_at(f, 354, 6))
    h = _Fields(_at(f, 0, length), 360)
    groups = [[(h.number(a), h.number(b)) for _ in range(h.number(3))] for a, b in ((6, 10), (4, 6))]
    h.take(3)
    groups += [[(h.number(a), h.number(b)) for _ in range(h.number(3))] for a, b in ((4, 5), (4, 9), (4, 7))]
    common = _extended(h) + _extended(h)
    at, images, extensions = length, [], []
    for which, group in enumerate(groups):
        for head, body in group:
            if which == 0:
                images.append((at, head, body))
            elif which == 3:
                sub = _at(f, at, head)
                extensions.append((sub[2:27].decode("latin-1").strip(), _at(f, at + head, body)))
            at += head + body
    return [_nitf_grid(_at(f, at, head), i, at + head, size, common, extensions) for i, (at, head, body) in enumerate(images)]


def _nitf_grid(sub: bytes, segment: int, at: int, size: int, common: list, extensions: list) -> Grid:
    h = _Fields(sub, 333)
    height, width, kind = h.number(8), h.number(8), h.text(3)
    h.take(19)
    if h.take(1) != b" ":
        h.take(60)
    h.take(80 * h.number(1))
    codec = h.text(2)
    if codec != "NC":
        raise ValueError("only NITF images without compression and mask are read")
    bands = h.number(1) or h.number(5)
    for _ in range(bands):
        h.take(12)
        tables = h.number(1)
        if tables:
            h.take(tables * h.number(5))
    h.take(1)
    mode, across, down, bw, bh, bits = h.text(1), h.number(4), h.number(4), h.number(4), h.number(4), h.number(2)
    h.take(20)
    records = _extended(h) + _extended(h) + common
    form = {"INT": "u", "SI": "i", "R": "f"}.get(kind)
    if form is None or bits not in (8, 16, 32, 64):
        raise ValueError("a NITF image of a kind that is not read")
    bw, bh = bw or width, bh or height
    n, plane = across * down, bw * bh * bits // 8
    if across != -(-width // bw) or down != -(-height // bh):
        raise ValueError("damaged NITF image header")
    if mode == "S":
        parts = [[Part(at + (b * n + i) * plane, plane, b, 1) for b in range(bands)] for i in range(n)]
    else:
        parts = [[Part(at + i * plane * bands, plane * bands, 0, bands)] for i in range(n)]
    order = {"P": "yxb", "R": "ybx", "B": "byx", "S": "byx"}[mode]
    return Grid("nitf", segment, 0, width, height, bw, bh, bands, f">{form}{bits // 8}", order, _within(parts, size), records=records, extensions=extensions)


def unpacked_lzw(data: bytes) -> bytes:
    """Bytes of a TIFF's LZW stream: codes of 9 to 12 bits, high bits first, 256 clears the table and 257 ends."""
    out, table, last = bytearray(), [], b""
    at = bits = held = 0
    width = 9
    while True:
        while bits < width:
            if at == len(data):
                raise ValueError("LZW stream without an end")
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFFFF, bits + 8, at + 1
        code = held >> bits - width & (1 << width) - 1
        bits -= width
        if code == 257:
            return bytes(out)
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table or code > len(table) or code == len(table) and not last:
            raise ValueError("damaged LZW stream")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def _elevations(data: bytes, rows: int) -> np.ndarray:
    """Posts of profiles, from the north; each profile's checksum must fit."""
    profiles = np.frombuffer(data, np.uint8).reshape(-1, DTED_BEFORE + 2 * rows + DTED_AFTER)
    said = np.ascontiguousarray(profiles[:, -DTED_AFTER:]).view(">u4")[:, 0]
    if (profiles[:, 0] != 0xAA).any() or (profiles[:, :-DTED_AFTER].sum(1, dtype=np.uint64) != said).any():
        raise ValueError("damaged DTED profile")
    raw = np.ascontiguousarray(profiles[:, DTED_BEFORE:-DTED_AFTER]).view(">u2").astype(np.int32)
    return np.where(raw & 0x8000, -(raw & 0x7FFF), raw).T[::-1]


def block(f: BinaryIO, grid: Grid, i: int, parts: list[Part]) -> np.ndarray:
    """Bands x rows x columns of block i, whose parts these are."""
    _, _, width, height = grid.size_of(i)
    if grid.codec == "dted":
        p = parts[0]
        return _elevations(_at(f, p.offset, p.count), height)[None].astype(float)
    bw, bh = (grid.block_width, grid.block_height) if grid.padded else (width, height)
    out = np.zeros((grid.bands, height, width))
    for p in parts:
        if not p.count:  # a block that was never written
            out[p.band : p.band + p.bands] = grid.no_data or 0.0
            continue
        data = _at(f, p.offset, p.count)
        try:
            data = zlib.decompress(data) if grid.codec == "deflate" else unpacked_lzw(data) if grid.codec == "lzw" else data
        except zlib.error as e:
            raise ValueError("damaged deflate stream") from e
        shape = {"y": bh, "x": bw, "b": p.bands}
        kind = np.dtype(grid.dtype)
        need = bw * bh * p.bands * kind.itemsize
        if len(data) < need:
            raise ValueError("a block is shorter than its size")
        values = np.frombuffer(data[:need], kind).reshape([shape[a] for a in grid.order])
        if grid.predictor == 2:
            values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
        values = values.transpose([grid.order.index(a) for a in "byx"])
        out[p.band : p.band + p.bands] = values[:, :height, :width]
    return out


def record_xml(records: list[tuple[str, bytes]]) -> str:
    """The XML form of the records whose fields are known; others are elements with their bytes in hexadecimal."""
    out = []
    for name, data in records:
        f, parts = _Fields(data), []
        try:
            if name in RECORDS:
                parts = [f"<field name={quoteattr(n)} value={quoteattr(f.text(w))}/>" for n, w in RECORDS[name]]
            if name == "RPC00B":
                for poly in RPC_POLYNOMIALS:
                    terms = "".join(f'<group index="{i}"><field name={quoteattr(poly)} value={quoteattr(f.text(RPC_TERM_WIDTH))}/></group>' for i in range(RPC_TERMS))
                    parts.append(f'<repeated name="{poly}" number="{RPC_TERMS}">{terms}</repeated>')
        except ValueError:
            parts = []
        out.append(f"<tre name={quoteattr(name)}>{''.join(parts)}</tre>" if parts else f'<tre name={quoteattr(name)} hex="{data.hex()}"/>')
    return f"<tres>{''.join(out)}</tres>"


# Files made from pixels: bands x rows x columns.


def tiff_file(pixels: np.ndarray, gt: list[float] | None = None, no_data: float | None = None, compress: str = "deflate", rows: int = 64) -> bytes:
    """A little-endian TIFF of strips, a band after another."""
    pixels = np.ascontiguousarray(pixels, pixels.dtype.newbyteorder("<"))
    bands, height, width = pixels.shape
    strips = [pixels[b, y : y + rows].tobytes() for b in range(bands) for y in range(0, height, rows)]
    if compress == "deflate":
        strips = [zlib.compress(s, 6) for s in strips]
    elif compress != "none":
        raise ValueError(f"no way to compress by {compress}")
    offsets = np.cumsum([8, *(len(s) for s in strips)]).tolist()
    form = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    tags = [
        (256, 4, [width]), (257, 4, [height]), (BITS, 3, [pixels.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [8 if compress == "deflate" else 1]), (262, 3, [1]), (STRIP_OFFSETS, 4, offsets[:-1]), (SAMPLES, 3, [bands]),
        (STRIP_ROWS, 4, [rows]), (STRIP_BYTES, 4, [len(s) for s in strips]), (PLANAR, 3, [2 if bands > 1 else 1]), *([(338, 3, [0] * (bands - 1))] if bands > 1 else []), (SAMPLE_FORMAT, 3, [form] * bands),
    ]
    if gt is not None:
        x, a, b, y, c, d = gt
        tags.append((TRANSFORM, 12, [a, b, 0, x, c, d, 0, y, 0, 0, 0, 0, 0, 0, 0, 1]))
    if no_data is not None:
        tags.append((NO_DATA, 2, f"{no_data:.17g}\0".encode()))
    at = offsets[-1] + offsets[-1] % 2
    entries, extra, beyond = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        data = values if kind == 2 else struct.pack(f"<{len(values)}{CODES[kind]}", *values)
        if len(data) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), beyond + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    return b"II" + struct.pack("<HI", 42, at) + b"".join(strips) + b"\0" * (at - offsets[-1]) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra


def nitf_file(pixels: np.ndarray, igeolo: str | None = None, records: list[tuple[str, bytes]] = (), extensions: list[tuple[str, bytes]] = (), when: str = "20000101000000") -> bytes:
    """A NITF 2.1 file of one uncompressed image in one block, bands one after another, with tagged records and XML extension segments."""
    pixels = np.ascontiguousarray(pixels, pixels.dtype.newbyteorder(">"))
    bands, height, width = pixels.shape
    text = lambda v, n: str(v).ljust(n)[:n].encode("latin-1")
    number = lambda v, n: str(v).zfill(n).encode()
    security = b"U" + b" " * 166
    tagged = b"".join(text(n, 6) + number(len(d), 5) + d for n, d in records)
    bits = pixels.dtype.itemsize * 8
    side = lambda v: number(v if v <= 8192 else 0, 4)
    shown = {1: "MONO", 3: "RGB"}.get(bands, "MULTI")
    each = {1: ["M"], 3: ["R", "G", "B"]}.get(bands, [""] * bands)
    sub = b"IM" + text("", 10) + text(when, 14) + text("", 97) + security + b"0" + text("", 42) + number(height, 8) + number(width, 8) + text({"u": "INT", "i": "SI", "f": "R"}[pixels.dtype.kind], 3) + text(shown, 8) + text("MS" if bands > 1 else "VIS", 8) + number(bits, 2) + b"R"
    sub += (b"G" + text(igeolo, 60) if igeolo else b" ") + b"0" + b"NC" + (number(bands, 1) if bands < 10 else b"0" + number(bands, 5)) + b"".join(text(n, 2) + text("", 6) + b"N" + b"   " + b"0" for n in each)
    sub += b"0" + b"B" + number(1, 4) * 2 + side(width) + side(height) + number(bits, 2) + number(1, 3) + number(0, 3) + number(0, 10) + text("1.0", 4) + number(0, 5) + (number(len(tagged) + 3, 5) + number(0, 3) + tagged if tagged else number(0, 5))
    des = [b"DE" + text(n, 25) + b"01" + security + number(0, 4) for n, _ in extensions]
    data = pixels.tobytes()
    tail = number(1, 3) + number(len(sub), 6) + number(len(data), 10) + number(0, 3) * 3 + number(len(des), 3) + b"".join(number(len(h), 4) + number(len(d), 9) for h, (_, d) in zip(des, extensions, strict=True)) + number(0, 3) + number(0, 5) * 2
    body = sub + data + b"".join(h + d for h, (_, d) in zip(des, extensions, strict=True))
    length = 360 + len(tail)
    head = b"NITF02.10" + number(3, 2) + text("BF01", 4) + text("", 10) + text(when, 14) + text("", 80) + security + number(0, 5) * 2 + b"0" + b"\0" * 3 + text("", 42)
    return head + number(length + len(body), 12) + number(length, 6) + tail + body
