"""Baseline JPEG: marker parsing, Huffman decoding and DC-only luminance thumbnails, in numpy.

Restart intervals of all images of a batch that share one structure (components and Huffman tables)
are lanes that are decoded together, a symbol of every lane at a time. The thumbnail has one sample
for each luminance block: round(DC * q / 8) + 128.

`encode` writes grey images whose blocks hold a DC coefficient alone, with a DC quantiser of 8, so a
block's mean is any chosen byte: a payload of bytes is stored losslessly, one block a byte, 64 blocks
a row, each row a restart interval. Payloads beyond 8191 rows go on in further images.

Defined results: null text is the empty payload, 64 zero bytes; equal texts give equal values; repeated
rows keep a row each; other columns are ignored; an empty table gives an empty table. Progressive
images and images without needed tables raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import per_batch, texts

ROW, MAX_ROWS = 64, 8191
# The typical luminance DC table of the standard (counts by length, symbols), and a table with the
# two AC symbols that any encoder needs for blocks without AC coefficients: end of block and a run of sixteen.
DC_COUNTS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_COUNTS, AC_SYMBOLS = (0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0x00, 0xF0)


def codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((s, code, length))
            code += 1
        at += n
        code <<= 1
    return out


#: Of a DC difference's size class, its code and the code's length; of an absolute difference, its size class.
DC_CODE, DC_LENGTH = (np.array([x[k] for x in sorted(codes(DC_COUNTS, DC_SYMBOLS))], np.int64) for k in (1, 2))
SIZE_OF = np.array([x.bit_length() for x in range(256)], np.int64)


def lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For every 16-bit window: length << 8 | symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in codes(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _scan(samples: np.ndarray) -> bytes:
    """Entropy-coded rows of 64 DC values, each a restart interval."""
    dc = samples.reshape(-1, ROW).astype(np.int64) - 128
    diff = np.diff(dc, axis=1, prepend=0).ravel()
    size = SIZE_OF[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    word = ((DC_CODE[size] << size) | extra) << 2  # the end-of-block code is 00
    bits = DC_LENGTH[size] + size + 2  # at most 19
    inside = bits.reshape(-1, ROW).cumsum(axis=1)
    pad = -inside[:, -1] % 8
    row_start = np.concatenate([[0], np.cumsum(inside[:, -1] + pad)])
    start = (row_start[:-1, None] + inside).ravel() - bits
    # Each word meets at most four bytes; words share no bits, so sums of their parts are the bytes.
    first, placed = start >> 3, word << (32 - bits - (start & 7))
    data = np.zeros(int(row_start[-1]) // 8 + 4)
    for k in range(4):
        data += np.bincount(first + k, (placed >> (24 - 8 * k)) & 255, len(data))
    data[row_start[1:] // 8 - 1] += (1 << pad) - 1  # padding bits are 1
    data = data[:-4].astype(np.uint8).tobytes()
    edges = (row_start // 8).tolist()
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out.append(data[a:b].replace(b"\xff", b"\xff\x00"))
        if i < len(edges) - 2:
            out.append(bytes((0xFF, 0xD0 + i % 8)))
    return b"".join(out)


def encode(payload: bytes) -> bytes:
    """One or more grey baseline images whose block means are the payload's bytes; its length is a multiple of 64."""
    samples, out = np.frombuffer(payload, np.uint8), []
    for a in range(0, len(samples), ROW * MAX_ROWS):
        part = samples[a : a + ROW * MAX_ROWS]
        height = len(part) // ROW * 8
        frame = bytes((8,)) + height.to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big") + bytes((1, 1, 0x11, 0))
        out += [
            b"\xff\xd8", _segment(0xDB, bytes((0,)) + bytes([8] * 64)), _segment(0xC0, frame),
            _segment(0xC4, bytes((0x00, *DC_COUNTS, *DC_SYMBOLS))), _segment(0xC4, bytes((0x10, *AC_COUNTS, *AC_SYMBOLS))),
            _segment(0xDD, ROW.to_bytes(2, "big")), _segment(0xDA, bytes((1, 1, 0x00, 0, 63, 0))), _scan(part), b"\xff\xd9",
        ]
    return b"".join(out)


@dataclass
class Image:
    """A parsed image: its frame, and its scan's restart intervals without stuffing."""

    width: int
    height: int
    quantiser: int
    pattern: tuple[tuple[int, tuple, tuple], ...]  # of each block of a unit: component, DC table, AC table
    sampling: tuple[int, int]  # luminance blocks across and down a unit
    units: tuple[int, int]
    interval: int
    lanes: list[bytes]


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """The image that starts at `at`, and where it ends."""
    quant: dict[int, int] = {}
    tables: dict[int, tuple] = {}
    interval, frame = 0, None
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                n = sum(counts)
                tables[body[0]] = (counts, tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            frame = (int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)])
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            break
    if frame is None or body[0] != len(frame[2]):
        raise ValueError("the scan does not hold all components")
    height, width, parts = frame
    chosen = {body[i]: (tables[body[i + 1] >> 4], tables[16 + (body[i + 1] & 15)]) for i in range(1, 1 + 2 * body[0], 2)}
    single = len(parts) == 1
    pattern = tuple((c, *chosen[p[0]]) for c, p in enumerate(parts) for _ in range(1 if single else p[1] * p[2]))
    across, down = (1, 1) if single else (parts[0][1], parts[0][2])
    hmax, vmax = (1, 1) if single else (max(p[1] for p in parts), max(p[2] for p in parts))
    units = (-(-width // (8 * hmax)), -(-height // (8 * vmax)))
    lanes, start = [], at
    while True:
        at = data.index(b"\xff", at)
        if data[at + 1] == 0:
            at += 2
            continue
        lanes.append(data[start:at].replace(b"\xff\x00", b"\xff"))
        restart = 0xD0 <= data[at + 1] <= 0xD7
        at += 2
        start = at
        if not restart:
            break
    if data[at - 1] != 0xD9:
        raise ValueError("more than one scan")
    image = Image(width, height, quant[parts[0][3]], pattern, (across, down), units, interval or units[0] * units[1], lanes)
    return image, at


def decode_lanes(pattern: tuple, lanes: list[bytes], units: np.ndarray) -> np.ndarray:
    """DC coefficients of the first component's blocks of all lanes, lane after lane."""
    kinds = list(dict.fromkeys(t for p in pattern for t in p[1:]))
    table = np.stack([lookup(*t) for t in kinds])
    dc_of, ac_of = (np.array([kinds.index(p[k]) for p in pattern]) for k in (1, 2))
    component = np.array([p[0] for p in pattern])
    raw = np.frombuffer(b"".join(x + b"\xff\xff\xff\xff" for x in lanes) + b"\xff" * 8, np.uint8).astype(np.int64)
    window = (raw[:-4] << 32) | (raw[1:-3] << 24) | (raw[2:-2] << 16) | (raw[3:-1] << 8) | raw[4:]
    sizes = np.array([len(x) + 4 for x in lanes], np.int64)
    bit = (np.cumsum(sizes) - sizes) * 8
    limit = bit + (sizes - 4) * 8
    first = int((component == 0).sum())
    out = np.zeros(int(units.sum()) * first, np.int64)
    write = (np.cumsum(units) - units) * first
    n, total = len(lanes), units * len(pattern)
    block, k, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, int(component.max()) + 1), np.int64)
    live = np.flatnonzero(total > 0)
    while len(live):
        b, place, coef = bit[live], block[live] % len(pattern), k[live]
        is_dc = coef == 0
        bits40 = window[b >> 3]
        off = b & 7
        hit = table[np.where(is_dc, dc_of[place], ac_of[place]), (bits40 >> (24 - off)) & 0xFFFF]
        length, symbol = hit >> 8, hit & 255
        if not length.all():
            raise ValueError("a code that is in no table")
        size = symbol & 15
        used = (b + length).astype(np.int64)
        extra = (window[used >> 3] >> (40 - (used & 7) - size)) & ((1 << size) - 1)
        bit[live] = used + size
        d = np.flatnonzero(is_dc)
        if len(d):
            value = np.where(extra[d] < (1 << size[d]) >> 1, extra[d] - (1 << size[d]) + 1, extra[d])
            lane, c = live[d], component[place[d]]
            last[lane, c] += value
            luma = np.flatnonzero(c == 0)
            out[write[lane[luma]]] = last[lane[luma], 0]
            write[lane[luma]] += 1
        ends = ~is_dc & (symbol == 0)
        coef = np.where(is_dc, 1, np.where(ends, 64, coef + (symbol >> 4) + 1))
        done = coef >= 64
        k[live] = np.where(done, 0, coef)
        block[live] += done
        live = live[block[live] < total[live]]
    if (bit > limit).any():
        raise ValueError("a restart interval ends early")
    return out


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """DC-only luminance thumbnails."""
    out: list[np.ndarray | None] = [None] * len(images)
    for pattern in dict.fromkeys(x.pattern for x in images):
        chosen = [i for i, x in enumerate(images) if x.pattern == pattern]
        lanes, units = [], []
        for i in chosen:
            x = images[i]
            total = x.units[0] * x.units[1]
            left = [min(x.interval, total - a) for a in range(0, total, x.interval)]
            if len(left) != len(x.lanes):
                raise ValueError("restart intervals do not match the frame")
            lanes += x.lanes
            units += left
        dc = decode_lanes(pattern, lanes, np.array(units, np.int64))
        at = 0
        for i in chosen:
            x = images[i]
            (h, v), (ux, uy) = x.sampling, x.units
            n = ux * uy * h * v
            grid = dc[at : at + n].reshape(uy, ux, v, h).transpose(0, 2, 1, 3).reshape(uy * v, ux * h)
            at += n
            out[i] = np.clip(np.floor(grid * x.quantiser / 8 + 0.5) + 128, 0, 255).astype(np.uint8)
    return out


def difference_hash(thumb: np.ndarray) -> str:
    """64 bits: in a grid of 8 by 9 cell means, whether each exceeds its right neighbour."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 10).astype(int)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.astype(float).cumsum(axis=0).cumsum(axis=1)
    r0, r1 = np.minimum(rows[:-1], thumb.shape[0] - 1), np.maximum(rows[1:], np.minimum(rows[:-1], thumb.shape[0] - 1) + 1)
    c0, c1 = cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    c0, c1 = np.minimum(c0, thumb.shape[1] - 1), np.minimum(c1, thumb.shape[1])
    c1 = np.maximum(c1, c0 + 1)
    cell = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    cell /= (r1 - r0)[:, None] * (c1 - c0)[None, :]
    return np.packbits(cell[:, :-1] > cell[:, 1:]).tobytes().hex()


def media_features(docs: DataFrame) -> DataFrame:
    """Texts stored as JPEG and read back: digests of payload and media, and dimensions with thumbnail hashes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t or b"" for t in texts(batch.column("text"))]
        media = [encode(t + bytes(-len(t) % 64 if t else 64)) for t in raw]
        images, owner = [], []
        for i, m in enumerate(media):
            at = 0
            while at < len(m):
                image, at = parse(m, at)
                images.append(image)
                owner.append(i)
        parts: list[list[bytes]] = [[] for _ in raw]
        shown: list[list[str]] = [[] for _ in raw]
        for i, image, thumb in zip(owner, images, thumbnails(images)):
            parts[i].append(thumb.tobytes())
            shown[i].append(f"{image.width}x{image.height}:{difference_hash(thumb)}")
        payload = [b"".join(p) for p in parts]
        longs = [[len(t) for t in raw], [len(p) for p in payload], [zlib.crc32(p[-64:]) for p in payload], [len(m) for m in media]]
        n_bytes, payload_bytes, tail, media_bytes = (pa.array(x, pa.int64()) for x in longs)
        digest, stored, feature = (pa.array(x, pa.string()) for x in ([hashlib.sha256(p).hexdigest() for p in payload], [hashlib.sha256(m).hexdigest() for m in media], [",".join(s) for s in shown]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, payload_bytes, digest, tail, media_bytes, stored, feature], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(per_batch(step, size_of="text"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
