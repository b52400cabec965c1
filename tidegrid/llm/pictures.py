"""Baseline JPEG files made of texts, for tables that have no pictures of their own.

The bytes of a text are the luminance samples of a picture, 64 to a block, in a nearly square grid of blocks. Every other picture
(by its number) is in colour, sampled 4:2:0, with restart markers. Blocks of a whole batch are transformed and coded by array operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.columnar import ragged, slices, utf8
from tidegrid.llm.shared import in_arrow

_LUMA = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_DC_SPEC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
# Each AC symbol has a code of 8 bits or of 16: any complete table is a valid one.
_COMMON = [0x00, 0xF0] + [r << 4 | s for s in range(1, 6) for r in range(16)]
_RARE = [r << 4 | s for s in range(6, 11) for r in range(16)]
_AC_SPEC = bytes([0] * 7 + [len(_COMMON)] + [0] * 7 + [len(_RARE)]) + bytes(_COMMON) + bytes(_RARE)
RESTART = 8


def _codes(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, at = 0, 16
    value, length = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64)
    for size in range(1, 17):
        for _ in range(spec[size - 1]):
            value[spec[at]], length[spec[at]] = code, size
            code, at = code + 1, at + 1
        code <<= 1
    return value, length


def _cosines() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    d = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    d[0] /= np.sqrt(2)
    return d


def _head(width: int, height: int, colour: bool) -> bytes:
    part = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    components = bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]) if colour else bytes([1, 1, 0x11, 0])
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + components
    scan = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]) if colour else bytes([1, 1, 0, 0, 63, 0])
    tables = part(0xDB, bytes([0]) + bytes(_LUMA[_ZIGZAG].tolist())) + part(0xC0, frame) + part(0xC4, bytes([0]) + _DC_SPEC) + part(0xC4, bytes([16]) + _AC_SPEC)
    return b"\xff\xd8" + tables + (part(0xDD, RESTART.to_bytes(2, "big")) if colour else b"") + part(0xDA, scan)


def entropy_coded(levels: np.ndarray, component: np.ndarray, lane: np.ndarray) -> list[bytes]:
    """The coded bytes of each lane of blocks (quantised levels in zigzag order); lanes are numbered in order and none is empty."""
    n = len(levels)
    fresh = np.append(True, lane[1:] != lane[:-1])
    dc = levels[:, 0].astype(np.int64)
    before = np.zeros(n, dtype=np.int64)
    for c in np.unique(component):
        mine = np.flatnonzero(component == c)
        before[mine[1:]] = np.where(lane[mine[1:]] == lane[mine[:-1]], dc[mine[:-1]], 0)
    size_of = lambda v: np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)
    bits_of = lambda v, s: np.where(v < 0, v + (1 << s) - 1, v).astype(np.uint64)
    codes, lengths = _codes(_DC_SPEC)
    diff = dc - before
    size = size_of(diff)
    rows = [(np.arange(n), np.zeros(n, dtype=np.int64), codes[size] << size.astype(np.uint64) | bits_of(diff, size), lengths[size] + size)]
    codes, lengths = _codes(_AC_SPEC)
    block, place = np.nonzero(levels[:, 1:])
    place = place + 1
    same = np.append(False, block[1:] == block[:-1]) if len(block) else np.zeros(0, dtype=bool)
    gap = place - np.where(same, np.append(0, place[:-1]), 0) - 1 if len(block) else place
    for k in range(3):
        long = np.flatnonzero(gap >= 16 * (k + 1))
        rows.append((block[long], place[long] * 8 - 4 + k, np.full(len(long), codes[0xF0]), np.full(len(long), lengths[0xF0])))
    value = levels[block, place].astype(np.int64)
    size = size_of(value)
    symbol = gap % 16 << 4 | size
    rows.append((block, place * 8, codes[symbol] << size.astype(np.uint64) | bits_of(value, size), lengths[symbol] + size))
    last = np.zeros(n, dtype=np.int64)
    np.maximum.at(last, block, place)
    end = np.flatnonzero(last < 63)
    rows.append((end, np.full(len(end), 1000), np.full(len(end), codes[0]), np.full(len(end), lengths[0])))
    block, order, code, length = (np.concatenate(x) for x in zip(*rows))
    by = np.argsort(block * 1024 + order, kind="stable")
    block, code, length = block[by], code[by].astype(np.uint64), length[by]
    # Each lane begins at a 32-bit word; ones fill its last byte.
    lanes = int(lane[-1]) + 1
    bits = np.bincount(lane[block], weights=length, minlength=lanes).astype(np.int64)
    words = bits // 32 + 2
    base = (np.cumsum(words) - words) * 32
    before = np.cumsum(length) - length
    first = np.searchsorted(lane[block], np.arange(lanes))
    at = base[lane[block]] + before - before[first][lane[block]]
    fill = -bits % 8
    at, length = np.append(at, base + bits), np.append(length, fill)
    code = np.append(code, (np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1))
    shifted = code << (64 - length - at % 32).astype(np.uint64)
    high, low = (shifted >> np.uint64(32)).astype(float), (shifted & np.uint64(0xFFFFFFFF)).astype(float)
    total = int(words.sum())
    packed = np.bincount(at // 32, weights=high, minlength=total) + np.bincount(at // 32 + 1, weights=low, minlength=total)[:total]
    raw = packed.astype(">u4").tobytes()
    return [raw[b // 8 : b // 8 + (n + 7) // 8].replace(b"\xff", b"\xff\x00") for b, n in zip(base.tolist(), bits.tolist())]


def jpegs(texts: pa.Array, number: np.ndarray) -> list[bytes | None]:
    """A JPEG file for each text; none for a null one. Odd numbers are in colour."""
    data, offsets = utf8(texts)
    size = np.diff(offsets)
    colour = number % 2 == 1
    luma = np.maximum(1, -(-size // 64))
    unit = np.where(colour, 4, 1)
    across = np.ceil(np.sqrt(luma / unit)).astype(np.int64)
    down = -(-luma // (unit * across))
    mcus = across * down
    blocks = mcus * np.where(colour, 6, 1)
    owner = np.repeat(np.arange(len(size)), blocks)
    within = ragged(np.zeros(len(size), dtype=np.int64), blocks)
    part = np.where(colour[owner], within % 6, 0)
    component = np.maximum(0, part - 3)
    from_ = np.where(colour[owner], within // 6 * 4 + part, within)
    samples = np.full((len(owner), 64), 128, dtype=np.float32)
    mine = np.flatnonzero((component == 0) & (from_ * 64 < size[owner]))
    start = offsets[owner[mine]] + from_[mine] * 64
    padded = np.concatenate([data, np.full(64, 32, dtype=np.uint8)])
    inside = from_[mine][:, None] * 64 + np.arange(64) < size[owner[mine]][:, None]
    samples[mine] = np.where(inside, padded[start[:, None] + np.arange(64)], 32)
    chroma = np.flatnonzero(component > 0)
    samples[chroma] = (96 + within[chroma] % 64)[:, None]
    two = np.kron(_cosines(), _cosines()).astype(np.float32)
    levels = np.rint((samples - 128) @ two.T / _LUMA).astype(np.int32)[:, _ZIGZAG]
    mcu = np.where(colour[owner], within // 6, within)
    cut = np.append(True, (owner[1:] != owner[:-1]) | (colour[owner[1:]] & (mcu[1:] != mcu[:-1]) & (mcu[1:] % RESTART == 0)))
    lane = np.cumsum(cut) - 1
    coded = entropy_coded(levels, component, lane)
    heads = owner[np.flatnonzero(cut)]
    out: list[bytes | None] = []
    valid = texts.is_valid().to_pylist()
    place = np.searchsorted(heads, np.arange(len(size) + 1)).tolist()
    for k in range(len(size)):
        if not valid[k]:
            out.append(None)
            continue
        lanes = coded[place[k] : place[k + 1]]
        body = b"".join(x + bytes([0xFF, 0xD0 + j % 8]) for j, x in enumerate(lanes[:-1])) + lanes[-1]
        sides = (16, 16) if colour[k] else (8, 8)
        out.append(_head(int(across[k]) * sides[0], int(down[k]) * sides[1], bool(colour[k])) + body + b"\xff\xd9")
    return out


def drawn(table: DataFrame, id_col: str, text: str) -> DataFrame:
    """The id and picture (binary) of each row."""

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text"):
            number = piece.column(0).fill_null(0).to_numpy()
            yield pa.record_batch([piece.column(0), pa.array(jpegs(piece.column(1), number), pa.binary())], names=[id_col, "picture"])

    return in_arrow(table.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text).alias("_text")), draw, f"`{id_col}` bigint, picture binary")
