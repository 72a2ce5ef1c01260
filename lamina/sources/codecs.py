"""Small NumPy codecs for slices: PNG, baseline TIFF, npy and npz.

They cover what the workload and common tools write: grey or colour PNG without
interlace, and TIFF or BigTIFF of integers or floats in strips or tiles, plain, deflated,
LZW or PackBits, with or without the horizontal predictor, one page a slice. Other files
can be read by passing an own decoder to ``read_volume``.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
# TIFF tags, and bytes of their value types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, SIZES, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 339
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES = 322, 323, 324, 325
TYPE_BYTES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}


def read_png(data: bytes) -> np.ndarray:
    """(H, W) or (H, W, channels) of 8 or 16 bits."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    w, h, depth, colour, _, _, interlace = head
    if depth not in (8, 16) or interlace or colour not in (0, 2, 4, 6):
        raise ValueError(f"PNG of {depth} bits, colour type {colour}, interlace {interlace} isn't supported")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, w * step), np.uint8)
    for y in range(h):
        kind, line, up = int(raw[y, 0]), raw[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + up
        elif kind == 1:
            out[y + 1] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        else:
            now = out[y + 1]
            for i in range(len(line)):
                a = int(now[i - step]) if i >= step else 0
                b, c = int(up[i]), int(up[i - step]) if i >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[i] = (int(line[i]) + guess) & 255
    pixels = out[1:].view(">u2") if depth == 16 else out[1:]
    pixels = pixels.reshape(h, w, channels).astype(np.uint16 if depth == 16 else np.uint8)
    return pixels[..., 0] if channels == 1 else pixels


def write_png(image: np.ndarray) -> bytes:
    """A grey PNG of 8 or 16 bits; larger ids are refused."""
    if image.min(initial=0) < 0 or image.max(initial=0) > 65_535:
        raise ValueError("ids of a PNG slice must be in 0..65535")
    depth = 8 if image.dtype == np.uint8 else 16
    lines = np.zeros((image.shape[0], 1 + image.shape[1] * depth // 8), np.uint8)
    lines[:, 1:] = image.astype(np.uint8 if depth == 8 else ">u2").view(np.uint8).reshape(image.shape[0], -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 5)) + chunk(b"IEND", b"")


def _tags(data: bytes, order: str, at: int, big: bool) -> tuple[dict[int, tuple], int]:
    entry, width = (20, 8) if big else (12, 4)
    count = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    out = {}
    for k in range(count):
        tag, kind = struct.unpack_from(order + "HH", data, at + k * entry)
        n = struct.unpack_from(order + ("Q" if big else "I"), data, at + k * entry + 4)[0]
        if kind in TYPE_BYTES:
            code, size = TYPE_BYTES[kind]
            place = at + k * entry + 4 + width
            if n * size > width:
                place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
            out[tag] = struct.unpack_from(f"{order}{n}{code}", data, place)
    return out, struct.unpack_from(order + ("Q" if big else "I"), data, at + count * entry)[0]


def tiff_pages(data: bytes):
    """(tags, byte order) of every page; enough for shapes without reading pixels."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    while at:
        tags, at = _tags(data, order, at, big)
        yield tags, order


def tiff_shape(data: bytes) -> tuple[int, int, int]:
    pages = [t for t, _ in tiff_pages(data)]
    return len(pages), pages[0][HEIGHT][0], pages[0][WIDTH][0]


def lzw(data: bytes) -> bytes:
    """The variable-length code of TIFF: 9 to 12 bits, most significant bit first, widened one code early."""
    out, table, width = [], [bytes([k]) for k in range(256)] + [b"", b""], 9
    bits = held = 0
    before = b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        said = table[code] if code < len(table) else before + before[:1]
        out.append(said)
        if before:
            table.append(before + said[:1])
            width = max(9, min(12, (len(table) + 1).bit_length()))
        before = said
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 if n > 128 else 1
    return b"".join(out)


# Numbers of TIFF compressions.
UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits}


def _block(data: bytes, shape: tuple[int, int, int], dtype: str, predictor: int) -> np.ndarray:
    """(rows, columns, samples) of one strip or tile; a short last strip has fewer rows."""
    row = shape[1] * shape[2] * np.dtype(dtype).itemsize
    out = np.frombuffer(data[: len(data) // row * row], dtype).reshape(-1, *shape[1:])
    out = out.astype(out.dtype.newbyteorder("="))
    return np.cumsum(out, axis=1, dtype=out.dtype) if predictor == 2 else out


def read_tiff(data: bytes) -> np.ndarray:
    """(pages, H, W) of a grey stack; further samples of a pixel are left out."""
    out = []
    for tags, order in tiff_pages(data):
        one = lambda tag, default=1: tags.get(tag, (default,))[0]  # noqa: B023, E731
        w, h, bits, samples, packing, predictor = tags[WIDTH][0], tags[HEIGHT][0], one(BITS), one(SAMPLES), one(COMPRESSION), one(PREDICTOR)
        if packing not in UNPACK or bits % 8 or predictor not in (1, 2):
            raise ValueError(f"TIFF compression {packing} with {bits} bits and predictor {predictor} isn't supported")
        dtype = order + {1: "u", 2: "i", 3: "f"}[one(FORMAT)] + str(bits // 8)
        tiled = TILES in tags
        th, tw = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(one(ROWS, h), h), w)
        image = np.zeros((h, w), np.dtype(dtype).newbyteorder("="))
        across = -(-w // tw)
        for k, (at, n) in enumerate(zip(tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else SIZES], strict=True)):
            y, x = k // across * th, k % across * tw
            part = _block(UNPACK[packing](data[at : at + n]), (th, tw, samples), dtype, predictor)[..., 0]
            image[y : y + part.shape[0], x : x + tw] = part[: h - y, : w - x]
        out.append(image)
    return np.stack(out)


def tiff_stream(pages: Iterable[np.ndarray], count: int, compress: bool = False, big: bool = False) -> Iterator[bytes]:
    """A little-endian stack, one strip a page, as pieces to write one after the other.

    ``big`` writes BigTIFF, whose places have 64 bits; one page is in memory at a time.
    """
    word, entry = ("Q", 20) if big else ("I", 12)
    yield b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) if big else b"II" + struct.pack("<HI", 42, 8)
    here = 16 if big else 8
    for z, image in enumerate(pages):
        kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
        body = image.astype(image.dtype.newbyteorder("<")).tobytes()
        body = zlib.compress(body, 6) if compress else body
        body_at = here + (8 if big else 2) + entry * 10 + (8 if big else 4)
        tags = [(WIDTH, image.shape[1]), (HEIGHT, image.shape[0]), (BITS, image.dtype.itemsize * 8), (COMPRESSION, 8 if compress else 1), (PHOTOMETRIC, 1), (STRIPS, body_at), (SAMPLES, 1), (ROWS, image.shape[0]), (SIZES, len(body)), (FORMAT, kind)]
        pad = b"\0" * (-(body_at + len(body)) % 8)
        following = body_at + len(body) + len(pad) if z + 1 < count else 0
        if not big and body_at + len(body) > 0xFFFFFFFF:
            raise ValueError("more than 4 GB: write with big=True")
        head = struct.pack("<Q" if big else "<H", len(tags)) + b"".join(struct.pack(f"<HH{word}{word}", tag, 16 if big else 4, 1, value) for tag, value in tags) + struct.pack("<" + word, following)
        yield head + body + pad
        here = following


def write_tiff(stack: np.ndarray, compress: bool = False, big: bool = False) -> bytes:
    return b"".join(tiff_stream(stack, len(stack), compress, big))


def read_array(data: bytes) -> np.ndarray:
    """An npy array, or the first array of an npz file."""
    loaded = np.load(io.BytesIO(data), allow_pickle=False)
    return loaded if isinstance(loaded, np.ndarray) else loaded[loaded.files[0]]
