"""Vectorised text handling over Arrow string columns.

Texts are taken as UTF-8 bytes in one buffer with offsets, the way Arrow holds
them, so that splitting and hashing run as a handful of numpy calls for many
documents at once.  A *word* is a maximal run of bytes other than ASCII white
space (blank, tab, line feed, vertical tab, form feed, carriage return); case
and punctuation are kept.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone, whole.
SLICE_BYTES = 1 << 20

#: The same class of characters for Spark's and DuckDB's regular expressions.
SPACE_CLASS = "[ \\t\\n\\x0b\\f\\r]"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    up, down = _POWERS["up"], _POWERS["down"]
    if len(up) > 4 * SLICE_BYTES and n <= SLICE_BYTES:
        _POWERS.clear()
    return up[:n], down[:n]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of the batches with at most limit bytes of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = offsets_of(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    raw = texts.buffers()[1]
    if raw is None or raw.size == 0:
        return np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(raw, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets at which each begins; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    offsets = offsets_of(texts)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one entry more at the end)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    solid = ~_IS_SPACE[data]
    first = np.empty(len(data), dtype=bool)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    edges = offsets[1:-1]
    first[edges[edges < len(data)]] = True
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    last[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(first & solid)
    ends = np.flatnonzero(last & solid) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; it depends on the bytes alone."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def owners(bounds: np.ndarray) -> np.ndarray:
    """The index of the text that each item belongs to, from the first item of each text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ngram_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words, text by text, and the text of each.

    A text of fewer than n words, but at least one, has one gram: all its words.
    """
    counts = np.diff(bounds)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), grams)
    if not len(owner):
        return np.zeros(0, dtype=np.uint64), owner
    at = ragged(bounds[:-1], grams)
    size = np.minimum(counts, n)
    padded = np.append(hashes, np.zeros(n, dtype=np.uint64))
    out = padded[at]
    for k in range(1, n):
        out = out * np.uint64(_BASE) + padded[at + k]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        place = (np.cumsum(grams) - grams)[short]
        value = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            on = k < counts[short]
            value[on] = value[on] * np.uint64(_BASE) + hashes[bounds[:-1][short[on]] + k]
        out[place] = value
    return mix(out + size[owner].astype(np.uint64)), owner


def distinct_pairs(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (owner, value) pairs, sorted by both; owner comes sorted."""
    if not len(values):
        return owner, values
    values = values.copy()
    edges = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(values)]
    for a, b in zip(edges[:-1], edges[1:]):  # by text: a vectorised sort each
        values[a:b].sort()
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[fresh], values[fresh]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32

#: What fold() does, for DuckDB's translate() and regular expressions over {text}.
FOLDED_SQL = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ')"
FOLDED_WORD = "[a-z0-9\\x{80}-\\x{10FFFF}]+"
#: What any folded word has, for Spark's regular expressions over texts as they are.
FOLDED_LETTER = "[A-Za-z0-9\\x{80}-\\x{10FFFF}]"


def fold(data: np.ndarray) -> np.ndarray:
    """The bytes with ASCII and Latin-1 letters in lower case and all other ASCII characters but digits as blanks; lengths stay.

    The words of the result are *folded words*: runs of ASCII letters, digits and characters beyond ASCII.
    """
    out = _FOLD[data]
    if len(data) > 1:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[upper] += 32
    return out


def pieces_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of bytes as a binary array."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ragged(starts, lengths)]))])


def key_filter(spark, keys, limit: int) -> np.ndarray | None:
    """The sorted values of a one-column table of 64-bit keys, if they are no more than limit; the table is stored before."""
    if keys.count() > limit:
        return None
    return np.sort(keys.toArrow().column(0).to_numpy().view(np.uint64))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values the sorted table has."""
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values
