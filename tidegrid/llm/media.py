"""Baseline JPEG columns: dimensions and hashes of thumbnails rebuilt from DC coefficients alone.

Markers are parsed image by image. The entropy-coded data of all images of a batch are then decoded in step: each scan, or each part of it between
restart markers, is a lane, and one round of array operations takes every lane one table look-up further. A look-up of the next 16 bits gives all
AC codes that begin and end within them, since only their lengths matter; DC differences are kept. The mean of each 8 x 8
luminance block follows from its DC value, and these means are the thumbnail, an eighth of the picture in each direction.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.columnar import mix, slices, span_hashes
from tidegrid.llm.shared import in_arrow

#: Bytes of pictures decoded together.
BATCH = 8 << 20
#: With fewer lanes than this, plain Python is faster than array operations.
FEW_LANES = 24
SCHEMA = "width int, height int, components int, thumb_width int, thumb_height int, thumb_hash bigint, difference_hash bigint, status string"
_STOP = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


class Unsupported(Exception):
    """A JPEG that isn't baseline."""


class Damaged(Exception):
    """Not a JPEG, or one that breaks off."""


@dataclass
class Picture:
    width: int
    height: int
    components: int
    scale: int
    sampling: tuple[int, int]
    #: For each block of an MCU: component, DC table, AC table.
    pattern: list[tuple[int, bytes, bytes]]
    across: int
    down: int
    restart: int
    lanes: list[bytes]


def parse(raw: bytes) -> Picture:
    """The frame, tables and entropy-coded data of the scan that has the first component."""
    if raw[:2] != b"\xff\xd8":
        raise Damaged
    at, frame, restart = 2, None, 0
    scales: dict[int, int] = {}
    huffman: dict[int, bytes] = {}
    while True:
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise Damaged
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        if marker == 0xD9:
            raise Damaged
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        part = raw[at + 4 : at + 2 + size]
        if size < 2 or len(part) != size - 2:
            raise Damaged
        at += 2 + size
        if marker == 0xDB:
            while part:
                wide, number = part[0] >> 4, part[0] & 15
                need = 129 if wide else 65
                if len(part) < need:
                    raise Damaged
                scales[number] = int.from_bytes(part[1:3], "big") if wide else part[1]
                part = part[need:]
        elif marker == 0xC4:
            while part:
                need = 17 + sum(part[1:17])
                if len(part) < need or need > 17 + 256:
                    raise Damaged
                huffman[part[0]] = part[1:need]
                part = part[need:]
        elif marker == 0xDD:
            if len(part) < 2:
                raise Damaged
            restart = int.from_bytes(part[:2], "big")
        elif marker == 0xC0 or 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if marker != 0xC0 or len(part) > 5 and part[0] != 8:
                raise Unsupported
            if len(part) < 6 or len(part) < 6 + 3 * part[5] or not part[5]:
                raise Damaged
            height, width = int.from_bytes(part[1:3], "big"), int.from_bytes(part[3:5], "big")
            frame = width, height, [(part[k], part[k + 1] >> 4, part[k + 1] & 15, part[k + 2]) for k in range(6, 6 + 3 * part[5], 3)]
            if not width or not height or any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in frame[2]):
                raise Damaged
        elif marker == 0xDA:
            if not frame or not part or len(part) < 4 + 2 * part[0]:
                raise Damaged
            stop = _STOP.search(raw, at)
            body = raw[at : stop.start() if stop else len(raw)]
            used = {part[1 + 2 * k]: part[2 + 2 * k] for k in range(part[0])}
            width, height, parts = frame
            if parts[0][0] not in used:
                if not stop:
                    raise Damaged
                at = stop.start()
                continue
            chosen = [(k, p) for k, p in enumerate(parts) if p[0] in used]
            wide, tall = max(p[1] for p in parts), max(p[2] for p in parts)
            across, down = -(-width // (8 * wide)), -(-height // (8 * tall))
            sampling = parts[0][1], parts[0][2]
            if len(chosen) == 1:  # one component: blocks in plain order, without padding to whole MCUs
                across, down = -(-(-(-width * sampling[0] // wide)) // 8), -(-(-(-height * sampling[1] // tall)) // 8)
                sampling = 1, 1
            pattern = []
            for k, (name, h, v, _) in chosen:
                tables = used[name]
                try:
                    pattern += [(k, huffman[tables >> 4], huffman[16 | tables & 15])] * (h * v if len(chosen) > 1 else 1)
                except KeyError:
                    raise Damaged from None
            if parts[0][3] not in scales:
                raise Damaged
            lanes = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(body)]
            if restart:
                need = -(-across * down // restart)
                if len(lanes) < need:
                    raise Damaged
                lanes = lanes[:need]
            elif len(lanes) > 1:
                raise Damaged
            return Picture(width, height, len(parts), scales[parts[0][3]], sampling, pattern, across, down, restart or across * down, lanes)


def code_table(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol for each 16-bit window; length 0 where no code begins."""
    length, symbol = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
    code, at = 0, 16
    for size in range(1, 17):
        for _ in range(spec[size - 1]):
            low = code << (16 - size)
            if low >= 1 << 16:
                raise Damaged
            length[low : low + (1 << (16 - size))] = size
            symbol[low : low + (1 << (16 - size))] = spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return length, symbol


def ac_tables(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window the first code, and all codes within the window, as bits << 9 | end of block << 8 | coefficients; 0: no code.

    Bits count the value bits behind a code too, coefficients the place after it.
    """
    length, symbol = code_table(spec)
    run, size = symbol >> 4, symbol & 15
    end = (length > 0) & (symbol == 0)
    bits = length + size
    coefficients = np.where(end, 0, run + 1)
    bad = (length == 0) | (size == 0) & (run != 0) & (run != 15)
    one = np.where(bad, 0, bits << 9 | end << 8 | coefficients)
    total, places, done = bits.copy(), coefficients.copy(), end.copy()
    windows = np.arange(1 << 16)
    live = ~bad & ~end
    for _ in range(15):
        live = live & (total < 16)
        at = np.flatnonzero(live)
        if not len(at):
            break
        rest = windows[at] << total[at] & 0xFFFF
        left = 16 - total[at]
        fits = (length[rest] > 0) & (length[rest] <= left) & ~bad[rest]
        live[at[~fits]] = False
        at, rest = at[fits], rest[fits]
        total[at] += bits[rest]
        places[at] += coefficients[rest]
        done[at] = end[rest]
        live[at[end[rest]]] = False
    return one, np.where(bad | (places > 63), one, total << 9 | done << 8 | np.minimum(places, 255))


def decode_lanes(data: np.ndarray, start: np.ndarray, bits: np.ndarray, blocks: np.ndarray, pattern: np.ndarray, period: np.ndarray, dc: np.ndarray, ac_one: np.ndarray, ac_many: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The DC values of all blocks of all lanes, lane after lane, the component of each, and which lanes are damaged.

    pattern and table have, per lane, the component and the table pair of each block of an MCU, which has period blocks. data ends in eight spare bytes.
    """
    word = data[:-3].astype(np.uint32) << np.uint32(24) | data[1:-2].astype(np.uint32) << np.uint32(16) | data[2:-1].astype(np.uint32) << np.uint32(8) | data[3:]
    n = len(start)
    first = np.cumsum(blocks) - blocks
    out, component = np.zeros(int(blocks.sum()), dtype=np.int32), np.zeros(int(blocks.sum()), dtype=np.int8)
    damaged = np.zeros(n, dtype=bool)
    lane = np.flatnonzero(blocks > 0)
    at, end = start[lane] * 8, start[lane] * 8 + bits[lane]
    block, k = np.zeros(len(lane), dtype=np.int64), np.zeros(len(lane), dtype=np.int64)
    last = np.zeros((n, pattern.shape[1] + 4), dtype=np.int64)
    now = table[lane, 0].astype(np.int64)
    while len(lane) > FEW_LANES:
        window = (word[at >> 3] >> (np.uint32(16) - (at & 7).astype(np.uint32))) & np.uint32(0xFFFF)
        look = now << 16 | window
        is_dc = k == 0
        many, one = ac_many[look], ac_one[look]
        step = np.where(k + (many & 255) <= 63, many, one)
        wrong = ~is_dc & (one == 0)
        move, ended = step >> 9, (step & 256) > 0
        k_new = np.where(ended, 64, k + (step & 255))
        d = np.flatnonzero(is_dc)
        if len(d):
            entry = dc[look[d]]
            code, size = entry >> 5, entry & 31
            wrong[d] = (code == 0) | (size > 11)
            p = at[d] + code
            value = (word[p >> 3] >> (np.uint32(16) - (p & 7).astype(np.uint32))).astype(np.int64) & 0xFFFF
            value >>= 16 - np.minimum(size, 16)
            value = np.where((size > 0) & (value < (1 << size) >> 1), value - (1 << size) + 1, np.where(size > 0, value, 0))
            c = pattern[lane[d], block[d] % period[lane[d]]]
            last[lane[d], c] += value
            where = first[lane[d]] + block[d]
            out[where], component[where] = last[lane[d], c], c
            move[d], k_new[d] = code + size, 1
        at = at + move
        k = k_new
        wrong |= (at > end) | (k > 64)
        over = k >= 64
        if over.any() or wrong.any():
            block[over] += 1
            k[over] = 0
            now[over] = table[lane[over], block[over] % period[lane[over]]]
            damaged[lane[wrong]] = True
            on = ~wrong & (block < blocks[lane])
            if not on.all():
                lane, at, end, block, k, now = (x[on] for x in (lane, at, end, block, k, now))
    for j in range(len(lane)):
        me, p, stop, b, place = int(lane[j]), int(at[j]), int(end[j]), int(block[j]), int(k[j])
        size_of, all_blocks = int(period[me]), int(blocks[me])
        comps, tables, base = pattern[me].tolist(), table[me].tolist(), int(first[me])
        while b < all_blocks:
            t = tables[b % size_of] << 16
            w = int(word[p >> 3]) >> (16 - (p & 7)) & 0xFFFF
            if place == 0:
                entry = int(dc[t | w])
                code, size = entry >> 5, entry & 31
                if code == 0 or size > 11:
                    damaged[me] = True
                    break
                p += code
                value = (int(word[p >> 3]) >> (16 - (p & 7)) & 0xFFFF) >> (16 - size) if size else 0
                if size and value < 1 << (size - 1):
                    value -= (1 << size) - 1
                c = comps[b % size_of]
                last[me, c] += value
                out[base + b], component[base + b] = last[me, c], c
                p += size
                place = 1
            else:
                step = int(ac_many[t | w])
                if place + (step & 255) > 63:
                    step = int(ac_one[t | w])
                if step == 0:
                    damaged[me] = True
                    break
                p += step >> 9
                place = 64 if step & 256 else place + (step & 255)
                if place > 64:
                    damaged[me] = True
                    break
            if p > stop:
                damaged[me] = True
                break
            if place == 64:
                b, place = b + 1, 0
    return out, component, damaged


def thumbnails(pictures: list[bytes | None]) -> tuple[list[Picture | None], list[np.ndarray | None], list[str]]:
    """Each picture's frame, thumbnail (8-bit rows) and status: ok, null, damaged or unsupported."""
    parsed: list[Picture | None] = []
    status: list[str] = []
    pairs: dict[tuple[bytes, bytes], int] = {}
    dc, one, many = [], [], []
    for raw in pictures:
        picture = None
        if raw is None:
            state = "null"
        else:
            try:
                picture, state = parse(raw), "ok"
                for _, d, a in picture.pattern:
                    if (d, a) not in pairs:
                        length, symbol = code_table(d)
                        first, all_ = ac_tables(a)
                        pairs[d, a] = len(dc)
                        dc.append(np.where(length > 0, length << 5 | np.minimum(symbol, 31), 0))
                        one.append(first)
                        many.append(all_)
            except Unsupported:
                state = "unsupported"
            except Damaged:
                picture, state = None, "damaged"
        parsed.append(picture)
        status.append(state)
    whose, lanes, blocks = [], [], []
    for k, p in enumerate(parsed):
        if p:
            total, per = p.across * p.down, len(p.pattern)
            for j, lane in enumerate(p.lanes):
                whose.append(k)
                lanes.append(lane)
                blocks.append(min(p.restart, total - j * p.restart) * per)
    found: list[np.ndarray | None] = [None] * len(parsed)
    if not lanes:
        return parsed, found, status
    sizes = np.array([len(x) for x in lanes])
    data = np.frombuffer(b"".join([*lanes, b"\xff" * 16]), dtype=np.uint8)
    most = max(len(p.pattern) for p in parsed if p)
    pattern, table = np.zeros((len(lanes), most), dtype=np.int64), np.zeros((len(lanes), most), dtype=np.int64)
    period = np.ones(len(lanes), dtype=np.int64)
    for j, k in enumerate(whose):
        p = parsed[k]
        period[j] = len(p.pattern)
        pattern[j, : len(p.pattern)] = [c for c, _, _ in p.pattern]
        table[j, : len(p.pattern)] = [pairs[d, a] for _, d, a in p.pattern]
    blocks = np.array(blocks, dtype=np.int64)
    values, component, bad = decode_lanes(data, np.cumsum(sizes) - sizes, sizes * 8, blocks, pattern, period, np.concatenate(dc), np.concatenate(one), np.concatenate(many), table)
    ends = np.cumsum(blocks)
    whose = np.array(whose)
    for k in np.unique(whose):
        p = parsed[k]
        mine = np.flatnonzero(whose == k) if len(p.lanes) > 1 else [int(np.searchsorted(whose, k))]
        if bad[mine].any():
            parsed[k], status[k] = (p, "damaged")
            continue
        a, b = ends[mine[0]] - blocks[mine[0]], ends[mine[-1]]
        luma = values[a:b][component[a:b] == 0]
        h, v = p.sampling
        grid = luma.reshape(p.down, p.across, v, h).transpose(0, 2, 1, 3).reshape(p.down * v, p.across * h)
        wide, tall = (-(-p.width // 8), -(-p.height // 8))
        if p.components > 1 or (h, v) != (1, 1):
            grid = grid[: max(1, min(tall, grid.shape[0])), : max(1, min(wide, grid.shape[1]))]
        found[k] = np.clip((grid * p.scale + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return parsed, found, status


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: which of 8 x 8 cells are darker than the cell to their right, over 8 x 9 cells of means. Signed."""
    tall, wide = thumb.shape
    sums = np.zeros((tall + 1, wide + 1), dtype=np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    y, x = np.arange(8), np.arange(9)
    y0, x0 = y * tall // 8, x * wide // 9
    y1, x1 = np.maximum(y0 + 1, (y + 1) * tall // 8), np.maximum(x0 + 1, (x + 1) * wide // 9)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    mean = (sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]) / area
    return int(np.packbits(mean[:, :-1] < mean[:, 1:]).view(">i8")[0])


def described(pictures: list[bytes | None]) -> list[pa.Array]:
    """The columns of SCHEMA."""
    parsed, found, status = thumbnails(pictures)
    raw = [t.tobytes() for t in found if t is not None]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64) if raw else np.zeros(0, dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts = ends - np.array([len(x) for x in raw], dtype=np.int64)
    shapes = np.array([t.shape[1] for t in found if t is not None], dtype=np.uint64)
    hashes = iter(mix(span_hashes(data, starts, ends) + shapes).view(np.int64).tolist() if raw else [])
    rows = []
    for p, t, s in zip(parsed, found, status):
        frame = (p.width, p.height, p.components) if p else (None, None, None)
        rows.append((*frame, *((t.shape[1], t.shape[0], next(hashes), difference_hash(t)) if t is not None else (None,) * 4), s))
    kinds = [pa.int32()] * 5 + [pa.int64()] * 2 + [pa.string()]
    return [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]


def media(pictures: DataFrame, id_col: str, column: str = "picture") -> DataFrame:
    """For each row its id, the picture's width, height and components, its thumbnail's size, thumb_hash, difference_hash and status.

    thumb_hash is equal for equal thumbnails; difference_hash differs in few bits for like ones. status: ok; null; unsupported (JPEG, not
    baseline); damaged (no JPEG, an empty value, or data that break off or have a code that no table has). Sizes are null where the frame couldn't be read, hashes
    where the scan couldn't. The first component counts as luminance. Repeated rows each have a row; an empty table gives none; further columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_picture", BATCH):
            yield pa.record_batch([piece.column(0), *described(piece.column(1).to_pylist())], names=names)

    names = [id_col, *[f.split()[0] for f in SCHEMA.split(", ")]]
    rows = pictures.select(F.col(id_col).cast("bigint").alias(id_col), F.col(column).alias("_picture"))
    return in_arrow(rows, run, f"`{id_col}` bigint, {SCHEMA}")
