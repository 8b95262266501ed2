"""Baseline JPEG in numpy: bytes stored as coefficients, markers and scans read back, thumbnails.

Storing.  64 bytes make one 8 x 8 block.  Byte b becomes the quantised coefficient b (128 to 255)
or b - 255 (0 to 127): these are the 256 values of size category 8, whose extra bits are b itself,
so the payload survives without loss, as quantised coefficients do not pass through a transform.
Images are grey, with a restart marker after every block.

Reading.  The markers are parsed; scans are decoded by the image's own Huffman tables.  Restart
intervals are independent, so all intervals of a scan (of all images with the same tables) are
decoded in lockstep: one numpy step takes the next symbol of every interval.

Features.  The DC coefficients give a luminance image at an eighth of the size without any inverse
transform; its 8 x 8 average is compared with its mean for a 64-bit hash.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The order in which a block's coefficients are stored.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
BLOCK = 64
#: Blocks that are decoded at once.
LANES = 1 << 15
MAX_SIDE = 65535 // 8


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payload: bytes) -> bytes:
    """A baseline JPEG whose coefficients are the payload, a positive multiple of 64 bytes; the last row is filled up with zeros.

    ValueError beyond the largest image, ``MAX_SIDE`` blocks squared (4 GB).
    """
    blocks = len(payload) // BLOCK
    wide = math.isqrt(blocks - 1) + 1  # nearly a square, so that the thumbnail is an image
    high = -(-blocks // wide)
    if wide > MAX_SIDE:
        raise ValueError(f"{len(payload)} bytes don't fit into an image")
    data = np.frombuffer(payload, "u1").reshape(blocks, BLOCK)
    if wide * high > blocks:
        data = np.concatenate([data, np.zeros((wide * high - blocks, BLOCK), "u1")])
    head = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, b"\0" + b"\1" * BLOCK), _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + b"\1\x11\0")]
    for kind in (0x00, 0x10):  # one code of one bit, '0', for run 0 and size 8
        head.append(_segment(0xC4, bytes([kind, 1, *[0] * 15, 8])))
    head += [_segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, b"\1\1\0\0\x3f\0")]
    scan = []
    for lo in range(0, len(data), LANES):
        part = data[lo : lo + LANES]
        bits = np.zeros((len(part), BLOCK, 9), "u1")
        bits[:, :, 1:] = np.unpackbits(part.reshape(len(part), BLOCK, 1), axis=2)
        coded = np.packbits(bits.reshape(len(part), 9 * BLOCK), axis=1)
        numbers = (np.arange(lo, lo + len(part)) % 8 + 0xD0).astype("u1")
        marked = np.concatenate([coded, np.full((len(part), 1), 0xFF, "u1"), numbers[:, None]], 1)
        full = np.flatnonzero((coded == 0xFF).any(1))
        if not len(full):
            scan.append(marked.tobytes())
        else:  # a zero byte after each FF of the data
            flat, plain = marked.ravel(), np.zeros(marked.shape, bool)
            plain[:, : coded.shape[1]] = coded == 0xFF
            scan.append(np.insert(flat, np.flatnonzero(plain.ravel()) + 1, 0).tobytes())
    return b"".join([*head, b"".join(scan)[:-2], b"\xff\xd9"])


@dataclass
class Image:
    """What the markers of a baseline JPEG say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quantisation: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)  # class and number -> lengths, symbols
    restart: int = 0
    scan: list[tuple[int, int]] = field(default_factory=list)  # component index, tables
    comments: list[bytes] = field(default_factory=list)
    data: bytes = b""


def parse(jpeg: bytes) -> Image:
    """Parse the markers up to the end of the first scan; ValueError for what isn't baseline."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, at = Image(), 2
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        if marker == 0xFF:
            at += 1
            continue
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (wide + 1)
                image.quantisation[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype("i4")
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples of 8 bits only")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDA:
            index = {c[0]: i for i, c in enumerate(image.components)}
            image.scan = [(index[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            image.data = jpeg[at:]
            return image


def _table(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits: the length of the code that they start with, times 256, plus its symbol."""
    out, code, i = np.zeros(1 << 16, "i4"), 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbols[i]
            code, i = code + 1, i + 1
        code <<= 1
    return out


def _intervals(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes without stuffing or markers, 8 zero bytes after each interval, and their starts."""
    raw = np.frombuffer(data, "u1")
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    stop = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    end = int(stop[0]) if len(stop) else len(raw)
    ff, after = ff[ff < end], after[ff < end]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    edges = np.concatenate([[0], marks + 2])
    ends = np.concatenate([marks, [end]])
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1] = False  # stuffing
    keep[marks], keep[marks + 1] = False, False
    count = np.concatenate([[0], np.cumsum(keep)])
    lengths = count[ends] - count[edges]
    starts = np.cumsum(lengths + 8) - lengths - 8
    out = np.zeros(int((lengths + 8).sum()), "u1")
    body = raw[:end][keep]
    out[np.arange(len(body)) + 8 * np.repeat(np.arange(len(lengths)), lengths)] = body
    return out, starts


def _layout(image: Image) -> list[tuple[int, int]]:
    """(component, tables) of each block of a minimum coded unit."""
    if len(image.scan) == 1:
        return image.scan
    return [(c, t) for c, t in image.scan for _ in range(image.components[c][1] * image.components[c][2])]


def _units(image: Image) -> int:
    across, down = 8, 8
    if len(image.scan) > 1:
        across, down = 8 * max(c[1] for c in image.components), 8 * max(c[2] for c in image.components)
    return -(-image.width // across) * -(-image.height // down)


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Of each image the quantised coefficients (block in scan order, 64 in zigzag order), DC
    already summed up; images with the same tables and layout are decoded together."""
    alike: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        layout = tuple(_layout(image))
        alike.setdefault((layout, tuple(sorted(image.huffman.items())), len(image.components), image.restart or _units(image)), []).append(i)
    out: list = [None] * len(images)
    for (layout, huffman, parts, per), who in alike.items():
        tables = {k: _table(*v) for k, v in huffman}
        data, starts, left, rows, size, n = [], [], [], [], 0, 0
        spans = []
        for i in who:
            d, s = _intervals(images[i].data)
            units = _units(images[i])
            lanes = -(-units // per)
            if len(s) < lanes:
                raise ValueError("the scan ends too early")
            data.append(d)
            starts.append(s[:lanes] + size)
            left.append(units - np.arange(lanes) * per)
            rows.append(n + np.arange(lanes) * per * len(layout))
            spans.append((n, n + units * len(layout)))
            size += len(d)
            n += lanes * per * len(layout)
        coded = np.zeros((n, BLOCK), "i2")
        _lockstep(np.concatenate(data), np.concatenate(starts), np.concatenate(left), np.concatenate(rows), layout, tables, parts, per, coded)
        for i, (a, b) in zip(who, spans, strict=True):
            out[i] = coded[a:b]
    return out


def _lockstep(data: np.ndarray, starts: np.ndarray, left: np.ndarray, rows: np.ndarray, layout: tuple, tables: dict, parts: int, per: int, out: np.ndarray) -> None:
    """Decode all intervals symbol by symbol; ``left`` units of each go to ``out`` from ``rows``."""
    for lo in range(0, len(starts), LANES):
        some = starts[lo : lo + LANES]
        first = int(some[0])
        last = int(starts[lo + LANES]) if lo + LANES < len(starts) else len(data)
        part = np.concatenate([data[first:last], np.zeros(8, "u1")])
        # the 8 bytes from every position as one number
        words = np.lib.stride_tricks.sliding_window_view(part, 8)
        lanes, bit = len(some), (some - first) * 8
        dc = np.zeros((lanes, parts), "i4")
        end = 8 * (len(part) - 8)

        def take(table: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Run and value of the next symbol, the symbol where it has no value, and the bit after it."""
            bit = np.minimum(bit, end - 1)
            window = words[bit >> 3].copy().view(">u8")[:, 0].astype("u8") << (bit & 7).astype("u8")
            entry = table[(window >> np.uint64(48)).astype("i4")]
            length, symbol = entry >> 8, entry & 255
            if not length.all():
                raise ValueError("a code that the table doesn't have")
            size = symbol & 15
            extra = ((window << length.astype("u8")) >> np.uint64(32)).astype("i8") >> (32 - size)
            value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
            return symbol >> 4, np.where(size == 0, 0, value), np.where(size == 0, symbol, -1), bit + length + size

        for unit in range(per):
            active = np.flatnonzero(left[lo : lo + lanes] > unit)
            if not len(active):
                break
            for j, (component, ts) in enumerate(layout):
                row = rows[lo + active] + unit * len(layout) + j
                _, value, _, bit[active] = take(tables[ts >> 4], bit[active])
                dc[active, component] += value.astype("i4")
                out[row, 0] = dc[active, component]
                k = np.ones(len(active), "i4")
                todo = np.arange(len(active))
                table = tables[16 | ts & 15]
                while len(todo):
                    who = active[todo]
                    run, value, plain, bit[who] = take(table, bit[who])
                    k[todo] = np.where(plain == 0, 64, k[todo] + run)
                    inside = (plain < 0) & (k[todo] < 64)
                    out[row[todo[inside]], k[todo[inside]]] = value[inside]
                    k[todo] += 1
                    todo = todo[k[todo] < 64]


def stored(image: Image, coded: np.ndarray) -> bytes:
    """The payload of ``encode`` from its coefficients."""
    size = struct.unpack(">Q", image.comments[0])[0]
    return (coded + 255 * (coded < 0)).astype("u1").tobytes()[:size]


def thumbnail(image: Image, coded: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size from the DC coefficients of the first component."""
    layout = _layout(image)
    mine = [j for j, (c, _) in enumerate(layout) if c == image.scan[0][0]]
    _, h, v, q = image.components[image.scan[0][0]]
    if len(image.scan) == 1:
        h = v = 1
    dc = coded.reshape(-1, len(layout), BLOCK)[:, mine, 0].astype("f8") * image.quantisation[q][0] / 8 + 128
    wide, high = (max(c[1] for c in image.components), max(c[2] for c in image.components)) if len(image.scan) > 1 else (1, 1)
    across = -(-image.width // (8 * wide))
    grid = dc.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
    return np.clip(np.rint(grid[: -(-image.height * v // (8 * high)), : -(-image.width * h // (8 * wide))]), 0, 255).astype("u1")


def average_hash(grey: np.ndarray) -> str:
    """64 bits: which cells of the 8 x 8 average are above the mean."""
    rows, cols = (np.linspace(0, n, 9) for n in grey.shape)
    up = np.concatenate([[[0] * (grey.shape[1] + 1)], np.concatenate([np.zeros((grey.shape[0], 1)), grey.cumsum(0).cumsum(1)], 1)])

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The summed table between its points."""
        r0, c0 = np.minimum(r.astype(int), grey.shape[0] - 1), np.minimum(c.astype(int), grey.shape[1] - 1)
        fr, fc = (r - r0)[:, None], (c - c0)[None, :]
        g = lambda i, j: up[np.ix_(r0 + i, c0 + j)]
        return (1 - fr) * ((1 - fc) * g(0, 0) + fc * g(0, 1)) + fr * ((1 - fc) * g(1, 0) + fc * g(1, 1))

    total = at(rows, cols)
    cells = total[1:, 1:] - total[:-1, 1:] - total[1:, :-1] + total[:-1, :-1]
    return f"{int(''.join('1' if x else '0' for x in (np.round(cells, 6) > round(cells.mean(), 6)).ravel()), 2):016x}"


def describe(jpegs: list[bytes]) -> list[tuple[Image, np.ndarray, str]]:
    """Of each image its markers, coefficients, and ``width x height : hash of the thumbnail``."""
    images = [parse(j) for j in jpegs]
    coded = coefficients(images)
    return [(i, c, f"{i.width}x{i.height}:{average_hash(thumbnail(i, c))}") for i, c in zip(images, coded, strict=True)]


def _portions(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text, one row at least."""
    lo, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if i > lo and total + n > most:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def texts_as_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each whole text as a JPEG, read it back, and digest what was stored.

    A map over partitions, a few megabytes of text at a time; a longer text is taken by itself, whole.
    Null and empty texts are one block of zeros; equal texts give equal values; null ids and repeated rows stay; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _portions(whole):
                raw = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
                jpegs, rows = [encode(padded(d)) for d in raw], []
                for data, jpeg, (image, coded, feature) in zip(raw, jpegs, describe(jpegs), strict=True):
                    back = stored(image, coded)
                    rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(jpeg), hashlib.sha256(jpeg).hexdigest(), feature))
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                if with_media:
                    columns.append(pa.array(jpegs, pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names + ["media"] * with_media)

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
