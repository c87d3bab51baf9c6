"""Encoders and decoders of image and vector formats (numpy, bytes): GeoTIFF, JPEG, shapefiles."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# TIFF types (size and struct code), and the tags used here.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PIXEL_SCALE, TIE_POINT, GEO_KEYS = 33550, 33922, 34735


def encode_geotiff(gray: np.ndarray, transform: tuple[float, ...], epsg: int) -> bytes:
    """8-bit gray with a north-up transform (pixel width, 0, left, 0, -pixel height, top) and a projected system."""
    a = np.ascontiguousarray(gray, np.uint8)
    h, w = a.shape
    dx, _, left, _, dy, top = transform
    # Version 1.1.0 with three keys: projected model, pixels are areas, the system's number.
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]
    tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8]), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1]), (STRIPS, 4, [0]), (SAMPLES, 3, [1]), (ROWS, 4, [h]), (COUNTS, 4, [w * h])]
    tags += [(PIXEL_SCALE, 12, [dx, -dy, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, left, top, 0.0]), (GEO_KEYS, 3, keys)]
    place, extra = 8 + 2 + 12 * len(tags) + 4, []
    start = place + sum(len(v) * _TYPES[t][0] for _, t, v in tags if len(v) * _TYPES[t][0] > 4)
    entries = b""
    for tag, kind, values in tags:
        values = [start] if tag == STRIPS else values
        body = struct.pack(f"<{len(values)}{_TYPES[kind][1]}", *values)
        if len(body) > 4:
            extra.append(body)
            body, place = struct.pack("<I", place), place + len(body)
        entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + struct.pack("<I", 0) + b"".join(extra) + a.tobytes()


def decode_tiff(data: bytes) -> tuple[np.ndarray, tuple[float, ...] | None, int | None]:
    """First band of an uncompressed 8-bit TIFF, its transform and system (None where it has none)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        here = at + 10 + 12 * i
        if size * count > 4:
            (here,) = struct.unpack_from(order + "I", data, here)
        tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, here)
    if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(BITS, (8,))[0] != 8:
        raise ValueError("only uncompressed 8-bit TIFFs are read")
    h, w, bands = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
    raw = b"".join(data[a : a + c] for a, c in zip(tags[STRIPS], tags[COUNTS], strict=True))
    a = np.frombuffer(raw, np.uint8, h * w * bands).reshape(h, w, bands)[:, :, 0]
    transform = None
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (dx, dy, _), tie = tags[PIXEL_SCALE], tags[TIE_POINT]
        transform = (dx, 0.0, tie[3] - tie[0] * dx, 0.0, -dy, tie[4] + tie[1] * dy)
    keys = tags.get(GEO_KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == 3072), None)
    return a, transform, epsg


# Fixed values of the JPEG standard: quantisation of luminance, and its Huffman codes (numbers of codes by length,
# then symbols) for DC and AC coefficients.
_LUMINANCE = (
    "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 "
    "18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
)
_DC = ("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "000102030405060708090a0b")
_AC = (
    "0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125",
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
)


def _codes(table: tuple[str, str]) -> dict[int, str]:
    """Bits of each symbol; codes of one length count up, and double from one length to the next."""
    symbols, out, code = iter(bytes.fromhex(table[1])), {}, 0
    for length, n in enumerate(map(int, table[0].split()), 1):
        for _ in range(n):
            out[next(symbols)] = format(code, f"0{length}b")
            code += 1
        code <<= 1
    return out


@lru_cache(maxsize=4)
def _jpeg_tables(quality: int):
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    quant = np.clip((np.array(_LUMINANCE.split(), float).reshape(8, 8) * scale + 50) // 100, 1, 255)
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    cosine = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    zigzag = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return quant, cosine, tuple(np.array(zigzag).T), _codes(_DC), _codes(_AC)


def encode_jpeg(gray: np.ndarray, quality: int = 90) -> bytes:
    """8-bit gray as a baseline JPEG."""
    a = np.ascontiguousarray(gray, np.uint8)
    h, w = a.shape
    quant, cosine, zigzag, dc, ac = _jpeg_tables(quality)
    padded = np.pad(a, ((0, -h % 8), (0, -w % 8)), "edge").astype(float) - 128
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    values = np.rint(cosine @ blocks @ cosine.T / quant).astype(int)[:, zigzag[0], zigzag[1]]
    bits, last = [], 0

    def amount(v: int) -> tuple[int, str]:
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    for row in values.tolist():
        size, tail = amount(row[0] - last)
        bits += [dc[size], tail]
        last, zeros = row[0], 0
        stop = max((i for i, v in enumerate(row) if v and i), default=0)
        for v in row[1 : stop + 1]:
            if not v:
                zeros += 1
                continue
            while zeros > 15:
                bits.append(ac[0xF0])
                zeros -= 16
            size, tail = amount(v)
            bits += [ac[zeros << 4 | size], tail]
            zeros = 0
        if stop < 63:
            bits.append(ac[0])
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    body = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\0")

    def part(kind: int, data: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data

    huffman = b"".join(part(0xC4, bytes([k]) + bytes(map(int, t[0].split())) + bytes.fromhex(t[1])) for k, t in ((0, _DC), (16, _AC)))
    head = part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, b"\0" + bytes(quant[zigzag].astype(np.uint8).tolist()))
    frame = part(0xC0, struct.pack(">BHHB", 8, h, w, 1) + b"\1\x11\0")
    return b"\xff\xd8" + head + frame + huffman + part(0xDA, b"\1\1\0\0\x3f\0") + body + b"\xff\xd9"


def encode_shapefile(lines: list[list[tuple[float, float]]], crs: str | None = None) -> dict[str, bytes]:
    """Polylines (shape type 3) as the files shp, shx and dbf, and prj where the system is known."""

    def box(points) -> bytes:
        x, y = zip(*points, strict=True) if points else ((0.0,), (0.0,))
        return struct.pack("<4d", min(x), min(y), max(x), max(y))

    records, index, at = [], [], 50  # places count words of two bytes
    for number, line in enumerate(lines, 1):
        body = struct.pack("<i", 3) + box(line) + struct.pack("<iii", 1, len(line), 0) + b"".join(struct.pack("<2d", *p) for p in line)
        records.append(struct.pack(">ii", number, len(body) // 2) + body)
        index.append(struct.pack(">ii", at, len(body) // 2))
        at += len(records[-1]) // 2

    def head(words: int) -> bytes:
        return struct.pack(">i20xi", 9994, words) + struct.pack("<ii", 1000, 3) + box([p for line in lines for p in line]) + bytes(32)

    column = b"id".ljust(11, b"\0") + b"N" + bytes(4) + bytes([10, 0]) + bytes(14)
    rows = b"".join(b" " + str(i).rjust(10).encode() for i in range(1, len(lines) + 1))
    table = struct.pack("<BBBBIHH20x", 3, 100, 1, 1, len(lines), 32 + 32 + 1, 11) + column + b"\r" + rows + b"\x1a"
    out = {"shp": head(at) + b"".join(records), "shx": head(50 + 4 * len(lines)) + b"".join(index), "dbf": table}
    return out | ({"prj": crs.encode()} if crs else {})


def decode_shapefile(shp: bytes) -> list[list[tuple[float, float]]]:
    """The points of each polyline of a shp file."""
    if struct.unpack_from(">i", shp)[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at < len(shp):
        _, words = struct.unpack_from(">ii", shp, at)
        (n,) = struct.unpack_from("<i", shp, at + 8 + 40)
        out.append([struct.unpack_from("<2d", shp, at + 8 + 48 + 16 * i) for i in range(n)])
        at += 8 + 2 * words
    return out
