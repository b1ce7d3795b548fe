"""TIFF columns: walk image directories, decode strips and tiles, undo predictors, one row a page.

``decode`` reads both byte orders, 8 and 16 bits a sample, chunky and planar samples, strips and tiles, no compression,
PackBits, LZW and deflate, and the horizontal predictor. ``encode`` writes bytes losslessly as pages of RGB rows of 64
pixels; the pages take turns at the layouts in ``LAYOUTS``.

Defined results: a null file has no page. A file that isn't TIFF, is cut short or loops is a single row with its error
after the pages that were read. A null or empty text is stored as one row of spaces. Texts of any length are stored
whole. Repeated rows give theirs each; an empty table gives an empty one. Input columns named as a new one are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_text, unpacked

# fixed values of the format: tags, field types, compressions
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, EOI = 256, 257

ROW = 192
PAGE_ROWS = 64
#: (compression, predictor, tiled) of the pages, in turn.
LAYOUTS = ((DEFLATE, 2, False), (PACKBITS, 1, True), (LZW, 1, False), (DEFLATE, 2, True))
STRIP_ROWS, TILE = 32, 16


class TiffError(ValueError):
    pass


def packbits(data: bytes) -> bytes:
    """Runs of 3 and more as runs, the rest as literals of up to 128."""
    out, n = bytearray(), len(data)
    x = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(x)) + 1 if n else np.zeros(0, int)
    starts = np.concatenate([[0], edge]) if n else edge
    lengths = np.diff(np.concatenate([starts, [n]]))
    at = 0

    def literal(to: int) -> None:
        nonlocal at
        while at < to:
            k = min(128, to - at)
            out.append(k - 1)
            out.extend(data[at : at + k])
            at += k

    for k in np.flatnonzero(lengths >= 3):
        a, run = int(starts[k]), int(lengths[k])
        literal(a)
        while run > 0:
            m = min(128, run)
            if m == 1:
                out += bytes((0, data[a]))
            else:
                out += bytes((257 - m, data[a]))
            run -= m
        at = a + int(lengths[k])
    literal(n)
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; a width grows one code early, and a full table is cleared."""
    codes, widths = [CLEAR], [9]
    table = {bytes((i,)): i for i in range(256)}
    width, new, held = 9, 258, b""
    for i in range(len(data)):
        c = held + data[i : i + 1]
        if c in table:
            held = c
            continue
        codes.append(table[held])
        widths.append(width)
        table[c] = new
        new += 1
        if new == 4094:
            codes.append(CLEAR)
            widths.append(12)
            table = {bytes((j,)): j for j in range(256)}
            width, new = 9, 258
        elif new + 1 > 1 << width:
            width += 1
        held = data[i : i + 1]
    if held:
        codes.append(table[held])
        widths.append(width)
        new += 1
        if new + 1 > 1 << width and width < 12:
            width += 1
    codes.append(EOI)
    widths.append(width)
    w = np.array(widths)
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - w[:, None]]).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, out, got = list(base), 9, b"", [], 0
    buffer = bits = 0
    for byte in data:
        buffer = (buffer << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = buffer >> bits & ((1 << width) - 1)
        if code == CLEAR:
            table, width, held = list(base), 9, b""
            continue
        if code == EOI:
            break
        n = len(table)
        if code < n:
            word = table[code]
            if held:
                table.append(held + word[:1])
        elif code == n and held:
            word = held + held[:1]
            table.append(word)
        else:
            raise TiffError("LZW code out of range")
        out.append(word)
        got += len(word)
        held = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
        if got >= size:
            break
    return b"".join(out)


def _compress(block: np.ndarray, compression: int, predictor: int) -> bytes:
    """A block of rows x pixels x samples, 8 bits each."""
    if predictor == 2:
        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)  # wraps
    data = block.tobytes()
    if compression == DEFLATE:
        return zlib.compress(data, 4)
    if compression == LZW:
        return lzw(data)
    return b"".join(packbits(r.tobytes()) for r in block) if compression == PACKBITS else data


def padded(text: str | None) -> bytes:
    """UTF-8 with spaces up to a positive multiple of a row."""
    data = (text or "").encode()
    return data + b" " * (-len(data) % ROW if data else ROW)


def encode(payload: bytes, layouts=LAYOUTS) -> bytes:
    """A little-endian file of the payload, a positive multiple of ROW bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4  # where the offset of the next directory goes
    for k, top in enumerate(range(0, len(rows), PAGE_ROWS)):
        image = rows[top : top + PAGE_ROWS]
        height, width = image.shape[:2]
        compression, predictor, tiled = layouts[k % len(layouts)]
        if tiled:
            tall = np.pad(image, ((0, -height % TILE), (0, -width % TILE), (0, 0)), mode="edge")
            blocks = [tall[y : y + TILE, x : x + TILE] for y in range(0, height, TILE) for x in range(0, width, TILE)]
        else:
            blocks = [image[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        offsets, counts = [], []
        for b in blocks:
            data = _compress(b, compression, predictor)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)
        entries = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8, 8, 8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2]), (SAMPLES, 3, [3]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tiled:
            entries += [(TILE_WIDTH, 4, [TILE]), (TILE_LENGTH, 4, [TILE]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            entries += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [STRIP_ROWS]), (STRIP_COUNTS, 4, counts)]
        struct.pack_into("<I", out, link, len(out))
        extra = len(out) + 2 + 12 * len(entries) + 4
        directory, beyond = struct.pack("<H", len(entries)), b""
        for tag, kind, values in sorted(entries):
            data = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(data) > 4:
                at = extra + len(beyond)
                beyond += data + b"\0" * (len(data) % 2)
                data = struct.pack("<I", at)
            directory += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        link = len(out) + len(directory)
        out += directory + b"\0\0\0\0" + beyond
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: bytes  # rows of chunky samples, little-endian where they have 16 bits


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """Byte order and fields of each directory along the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise TiffError("not TIFF")
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen = set()
        while at:
            if at in seen:
                raise TiffError("directories loop")
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            fields = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind not in TYPES:
                    continue
                form = f"{order}{count}{TYPES[kind]}"
                where = at + 10 + 12 * i
                if struct.calcsize(form) > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                fields[tag] = list(struct.unpack_from(form, data, where))
            yield order, fields
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error:
        raise TiffError("cut short") from None


def _block(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompress(data)
        except zlib.error:
            raise TiffError("bad deflate data") from None
    elif compression == PACKBITS:
        out = unpackbits(data, size)
    elif compression == LZW:
        out = unlzw(data, size)
    else:
        raise TiffError(f"compression {compression}")
    if len(out) < size:
        raise TiffError("cut short")
    return out[:size]


def decode(data: bytes) -> Iterator[Page]:
    for number, (order, f) in enumerate(directories(data)):
        one = lambda tag, default=None: f.get(tag, [default])[0]  # noqa: B023, E731
        width, height, samples, compression, predictor = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
        bits = one(BITS, 1)
        if not width or not height or bits not in (8, 16) or len(set(f.get(BITS, [bits]))) != 1 or predictor not in (1, 2):
            raise TiffError("samples of another kind")
        kind = np.dtype(order + "u2") if bits == 16 else np.dtype(np.uint8)
        planes = samples if one(PLANAR, 1) == 2 else 1
        deep = samples // planes
        if TILE_OFFSETS in f:
            bw, bh, offsets, counts = one(TILE_WIDTH), one(TILE_LENGTH), f[TILE_OFFSETS], f.get(TILE_COUNTS, [])
        else:
            bw, bh, offsets, counts = width, min(one(ROWS_PER_STRIP, height) or height, height), f.get(STRIP_OFFSETS, []), f.get(STRIP_COUNTS, [])
        if not bw or not bh:
            raise TiffError("blocks without size")
        across, down = -(-width // bw), -(-height // bh)
        if len(offsets) < across * down * planes or len(counts) < across * down * planes:
            raise TiffError("blocks missing")
        image = np.empty((height, width, samples), kind.newbyteorder("<"))
        for k in range(across * down * planes):
            plane, rest = divmod(k, across * down)
            y, x = (rest // across) * bh, (rest % across) * bw
            rows = bh if TILE_OFFSETS in f else min(bh, height - y)
            if offsets[k] + counts[k] > len(data):
                raise TiffError("cut short")
            raw = _block(data[offsets[k] : offsets[k] + counts[k]], compression, rows * bw * deep * kind.itemsize)
            block = np.frombuffer(raw, kind).reshape(rows, bw, deep)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
            part = block[: height - y, : width - x]
            if planes > 1:
                image[y : y + rows, x : x + bw, plane] = part[:, :, 0]
            else:
                image[y : y + rows, x : x + bw] = part
        yield Page(number, width, height, samples, bits, compression, image.tobytes())


def feature(page: Page) -> str:
    """Mean and deviation of each channel, and which cells of an 8 x 8 grid of mean brightness are over the whole's mean."""
    x = np.frombuffer(page.pixels, np.uint8 if page.bits == 8 else "<u2").reshape(page.height, page.width, page.samples)
    flat = x.reshape(-1, page.samples).astype(np.float64)
    mean, deviation = flat.mean(0), flat.std(0)
    bright = x.sum(2, dtype=np.float64)
    ys, xs = (np.arange(8) * page.height) // 8, (np.arange(8) * page.width) // 8
    grid = np.add.reduceat(np.add.reduceat(bright, ys, axis=0), xs, axis=1)
    n = np.maximum(np.diff([*ys, page.height]), 1)[:, None] * np.maximum(np.diff([*xs, page.width]), 1)[None]
    cells = grid / n
    bits = int("".join("1" if v else "0" for v in (cells > cells.mean()).ravel()), 2)
    return ",".join(f"{v:.3f}" for v in [*mean, *deviation]) + f",{bits:016x}"


def with_media(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), n_bytes of the text, and its stored form ``media``."""

    def work(texts):
        return [[len(t.encode()) if t else 0 for t in texts], [encode(padded(t)) for t in texts]]

    return map_text(df, text, df.columns if keep is None else keep, "n_bytes long, media binary", work)


def pages(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row a page: ``keep`` (all columns but ``media`` by default), page, width, height, samples, bits, compression, pixels, feature, error."""
    names = ["page", "width", "height", "samples", "bits", "compression", "pixels", "feature", "error"]
    keep = [c for c in ([c for c in df.columns if c != media] if keep is None else keep) if c.lower() not in names]
    frame = df.select(*kept(keep), F.col(f"`{media}`").alias("media"))
    out = frame.drop("media").schema
    for n in names:
        out = out.add(n, "binary" if n == "pixels" else "string" if n in ("feature", "error") else "integer")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = list(to_arrow_schema(out))[-len(names) :]
        for b in batches:
            for i, data in enumerate(b.column(b.num_columns - 1)):
                data, rows = data.as_py(), []
                if data is None:
                    continue
                try:
                    for p in decode(data):
                        rows.append((p.number, p.width, p.height, p.samples, p.bits, p.compression, p.pixels, feature(p), None))
                except TiffError as e:
                    rows.append((len(rows), None, None, None, None, None, None, None, str(e)))
                if rows:
                    ids = [c.take(pa.array([i] * len(rows))) for c in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*ids, *[pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), kinds, strict=True)]], names=out.names)

    return unpacked(frame.mapInArrow(run, out), keep, names)


def digests(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row a file, over the same pages: their number, the bytes of their pixels, digests, and their features joined by semicolons. A file that can't be read has an error."""

    def work(files):
        out = []
        for data in files:
            whole, tail, size, features, error = hashlib.sha256(), b"", 0, [], None
            try:
                for p in decode(data) if data is not None else ():
                    whole.update(p.pixels)
                    tail = (tail + p.pixels)[-16:]
                    size += len(p.pixels)
                    features.append(feature(p))
            except TiffError as e:
                error = str(e)
            out.append((len(features), size, whole.hexdigest(), zlib.crc32(tail), len(data or b""), hashlib.sha256(data or b"").hexdigest(), ";".join(features), error))
        return list(zip(*out, strict=True))

    keep = [c for c in df.columns if c != media] if keep is None else keep
    return map_text(df, media, keep, "n_pages int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string", work, cast="binary")
