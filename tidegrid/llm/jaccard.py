"""Exact similarity join of documents' n-gram sets, skipping work by relations between sets.

A set is the distinct N-grams of a document's folded words (lower case, ASCII punctuation left out). Documents with equal sets form a
class, and classes are joined; its members share each answer.

1. Frequencies. Every word and every gram of every document is counted over the whole corpus. Grams are ordered by the power of two
   of the number of documents expected for them, rare ones first, then by hash. Expected is what a gram's words would give
   by chance, or, for frequent grams, their own count if that is more. Any one order gives the same result; this one keeps index lists short.
2. Index. Two sets of Jaccard similarity t share a gram among the first |x| - ceil(t |x|) + 1 of each. A list of the index
   has, for one gram, the sets with it in their prefix, in blocks of one position, by size within a block. For a set probing
   the list, the sizes that length and position still allow are one range of a block, so whole blocks are skipped (index-level skipping).
   Pairs of a list of more than HOT classes are not listed, as they grow with its square and stand in many lists: such lists say
   only which classes they join, and the classes that chains of them join are a crowd.
3. Sketches. Most candidate pairs are not similar. A sketch has a bit for each value of some bits of a gram's hash, a sixteenth of the set's bytes; two of them bound
   the overlap from above, and pairs whose bound is too low go before any set moves.
4. Answers. Candidate pairs gather at a leader, the least class among a class's candidates. Of each set there only the difference to the
   leader is kept; the overlap of two sets follows from the leader's size and their two differences, so the answer for a set is
   derived from that of a similar set instead of intersecting it anew (answer-level skipping). A leader of many classes has them dealt into blocks of
   about BLOCK, and a task holds the sets of two blocks, never of a whole group. Of a crowd all pairs are compared whose sizes allow it, also
   by blocks, but larger ones, as each set moves once for each block it meets: the overlaps of BLOCK and BLOCK of their classes are a product of matrices,
   and only each class's number of links and its least linked class leave the task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.columnar import FOLDED_LETTER, FOLDED_SQL, FOLDED_WORD, distinct_pairs, fold, member, mix, ngram_hashes, pieces_of, ragged, slices, span_hashes, utf8, words
from tidegrid.llm.shared import Sent, in_arrow, owned, scratch, shared_folder, slots, stored, swept

GRAM, THRESHOLD = 3, 0.6
#: A gram or word that occurs at least so often counts as frequent.
FREQUENT = 16
#: Frequent grams, frequent words and candidate classes are sent to the scan if no more than this. Beyond it, FREQUENT is doubled (the
#: result doesn't depend on it) and candidate classes reach the documents by a join.
BROADCAST_KEYS = 2_000_000
#: Classes of one leader that lie together in one block.
BLOCK = 512
#: Blocks' worth of classes of one crowd and about one size that lie together, and their grams, at most, on average.
WIDE, WIDE_GRAMS = 8, 1 << 21
#: Bits of a sketch for each gram, at least.
SKETCH = 4
#: Lists of the index with more classes make crowds; the result doesn't depend on it.
HOT = 128
#: Sets that go to one partition of the answers, on average, at most.
SETS = 2_000
#: Classes that a task remembers to have put into the index; beyond, some are put there twice, which changes nothing.
SEEN = 1 << 20
CLASS_BITS = 6
#: Rows with their marks are sent to the documents if no more than this; beyond, texts move to meet them.
BROADCAST_MARKS = 1 << 19
#: What stands for a null id inside one_of_each: it comes behind all others.
NO_ID = 2**63 - 1
CLASSES, BY_GRAM, BY_WORD = 0, 1, 2


def folded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all folded words; the first word of each text."""
    data, offsets = utf8(texts)
    data = fold(data)
    starts, ends, bounds = words(data, offsets)
    return span_hashes(data, starts, ends), bounds


def sets_of(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text and hash of all grams, distinct and sorted by both; each text's number of grams; each text's class (0: no grams)."""
    grams, owner = ngram_hashes(hashes, bounds, n)
    return sets_of_grams(owner, grams, len(bounds) - 1)


def sets_of_grams(owner: np.ndarray, grams: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As sets_of(), from each gram's text and hash."""
    owner, grams = distinct_pairs(owner, grams)
    size = np.bincount(owner, minlength=texts)
    ends = np.cumsum(size)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(grams ^ np.uint64(0x5851F42D4C957F2D)))])
    of = mix(mix(sums[ends] - sums[ends - size]) + size.astype(np.uint64)) | np.uint64(1)
    return owner, grams, size, np.where(size > 0, of, np.uint64(0))


def packed(buckets: int, keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Columns, cut by the top of the keys into one binary value for each bucket that occurs; keys needn't be sorted."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first[1:], len(keys))
    out = []
    for c in columns:
        raw = np.ascontiguousarray(c[order])
        out.append(pieces_of(raw.view(np.uint8), first * raw.itemsize, ends * raw.itemsize))
    return there, out


def statistics(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Rows of kind, a, b, c: doc_id, class and tie of each row with words; frequent grams (upper 32 bits) and frequent words with their counts.

    Counts are added up for many documents at once before they move, so that what stands in every document is sent but once by each.
    """
    step = 1 << 20

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            ids, ties, cls, grams, used = (np.concatenate(x) for x in zip(*held))
            held.clear()
            used, times = np.unique(used, return_counts=True)
            grams, often = np.unique((grams >> np.uint64(32)).astype(np.uint32), return_counts=True)
            parts = -(-often // 255)  # a count has one byte; more of a gram take several entries
            often = np.minimum(often.repeat(parts) - ragged(np.zeros(len(parts), dtype=np.int64), parts) * 255, 255).astype(np.uint8)
            grams = grams.repeat(parts)
            for kind, keys, columns in ((CLASSES, mix(cls), (ids, cls, ties)), (BY_GRAM, grams.astype(np.uint64) << np.uint64(32), (grams, often)), (BY_WORD, used, (used, times))):
                there, blobs = packed(buckets, keys, *columns)
                blobs = blobs if len(blobs) == 3 else [*blobs, pa.nulls(len(there), pa.binary())]
                yield pa.record_batch([pa.array(np.full(len(there), kind, dtype=np.int32)), pa.array(there.astype(np.int32)), *blobs], names=["kind", "bucket", "a", "b", "c"])

        for piece in slices(batches, "text"):
            hashes, bounds = folded_words(piece.column(2))
            _, grams, _, cls = sets_of(hashes, bounds, n)
            some = cls != 0
            held.append((piece.column(0).to_numpy()[some], piece.column(1).to_numpy()[some], cls[some], grams, hashes))
            size += len(grams)
            if size >= step:
                yield from out()
                size = 0
        if held:
            yield from out()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        used: list[tuple[np.ndarray, np.ndarray]] = []
        read = lambda blob, kind: np.frombuffer(blob.as_buffer(), dtype=kind)

        def rows(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(a), 1 << 16):
                part = slice(k, k + (1 << 16))
                third = pa.nulls(len(a[part]), pa.int64()) if c is None else pa.array(c[part])
                yield pa.record_batch([pa.array(np.full(len(a[part]), kind, dtype=np.int32)), pa.array(a[part].astype(np.int64)), pa.array(b[part].view(np.int64)), third], names=["kind", "a", "b", "c"])

        for batch in batches:
            for kind, a, b, c in zip(batch.column(0).to_pylist(), *batch.columns[2:]):
                if kind == CLASSES:
                    yield from rows(CLASSES, *(read(x, np.int64) for x in (a, b, c)))
                elif kind == BY_GRAM:
                    grams.append((read(a, np.uint32), read(b, np.uint8)))
                else:
                    used.append((read(a, np.uint64), read(b, np.int64)))
        if grams:
            keys, often = (np.concatenate(x) for x in zip(*grams))
            grams.clear()
            order = np.argsort(keys, kind="stable")
            keys, often = keys[order], often[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            times = np.add.reduceat(often, first, dtype=np.int64)
            yield from rows(BY_GRAM, keys[first[times >= FREQUENT]].astype(np.int64), times[times >= FREQUENT])
        if used:
            words_, times = (np.concatenate(x) for x in zip(*used))
            words_, at = np.unique(words_, return_inverse=True)
            total = np.bincount(at, weights=times).astype(np.int64)
            yield from rows(BY_WORD, words_[total >= FREQUENT].view(np.int64), total[total >= FREQUENT])
            yield from rows(BY_WORD, np.zeros(1, dtype=np.int64), total.sum(keepdims=True))  # all words, under 0

    spreads = in_arrow(docs.select("doc_id", "tie", "text"), spread, "kind int, bucket int, a binary, b binary, c binary")
    return in_arrow(spreads.repartitionById(buckets, F.col("bucket")), count, "kind int, a bigint, b bigint, c bigint")


class Places:
    """A sorted table of unsigned keys with a directory by their upper bits: what it takes to find a key doesn't grow with the table, as bisection does."""

    def __init__(self, table: np.ndarray) -> None:
        width = table.itemsize * 8
        bits = min(width, len(table).bit_length() + 1)
        self.table, self.shift = table, table.dtype.type(width - bits)
        counts = np.bincount((table >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.append(0, np.cumsum(counts)).astype(np.int32)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the table has, and where there."""
        part = (keys >> self.shift).astype(np.int64)
        low, high = self.first[part], self.first[part + 1]
        mine = np.flatnonzero(low < high)
        at, stop, wanted = low[mine], high[mine], keys[mine]
        found, where = [], []
        while len(mine):
            hit = self.table[at] == wanted
            found.append(mine[hit])
            where.append(at[hit])
            on = ~hit & (at + 1 < stop)
            mine, at, stop, wanted = mine[on], at[on] + 1, stop[on], wanted[on]
        return (np.concatenate(found), np.concatenate(where)) if found else (mine, mine)


@dataclass
class Order:
    """Frequent grams and words, sorted, with the bits of their count; bits of the number of all words."""

    grams: np.ndarray
    gram_bits: np.ndarray
    words: np.ndarray
    word_bits: np.ndarray
    all_bits: float

    @cached_property
    def gram_places(self) -> Places:
        return Places(self.grams)

    @cached_property
    def word_places(self) -> Places:
        return Places(self.words)


def order_of(counted: DataFrame, limit: int) -> Order:
    tables = []
    for kind in (BY_GRAM, BY_WORD):
        rows = counted.where((F.col("kind") == kind) & (F.col("a") != 0)).select("a", "b")
        least = FREQUENT
        while rows.where(F.col("b") >= least).count() > limit:
            least *= 2
        table = rows.where(F.col("b") >= least).toArrow()
        keys, times = table.column("a").to_numpy().view(np.uint64), np.log2(np.maximum(table.column("b").to_numpy(), 1)).astype(np.float32)
        order = np.argsort(keys)
        tables += [keys[order], times[order]]
    total = counted.where((F.col("kind") == BY_WORD) & (F.col("a") == 0)).agg(F.sum("b")).first()[0] or 1
    return Order(tables[0].astype(np.uint32), tables[1], tables[2], tables[3], float(np.log2(total)))


def looked_up(keys: np.ndarray, places: Places, values: np.ndarray, missing: float) -> np.ndarray:
    out = np.full(len(keys), missing, dtype=np.float32)
    found, at = places.of(keys)
    out[found] = values[at]
    return out


def ordered(hashes: np.ndarray, bounds: np.ndarray, n: int, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and key of all grams, distinct and sorted by both, and each text's class. The order of keys is that of the index: expected frequency above, hash below."""
    grams, owner = ngram_hashes(hashes, bounds, n)
    rare = looked_up(hashes, order.word_places, order.word_bits, 1.0) - np.float32(order.all_bits)  # log2 of each word's share
    counts = np.diff(bounds)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = ragged(bounds[:-1], per)
    padded = np.append(rare, np.zeros(n, dtype=np.float32))
    expected = np.float32(order.all_bits) + padded[at]
    for k in range(1, n):
        expected += padded[at + k]
    short = np.repeat((counts > 0) & (counts < n), per)
    expected[short] = 0
    expected = np.maximum(expected, looked_up((grams >> np.uint64(32)).astype(np.uint32), order.gram_places, order.gram_bits, -99.0))
    level = np.clip(expected + 40, 0, 2**CLASS_BITS - 1).astype(np.uint64)
    keys = level << np.uint64(64 - CLASS_BITS) | grams >> np.uint64(CLASS_BITS)
    return *distinct_pairs(owner, keys), sets_of_grams(owner, grams, len(bounds) - 1)[3]


def prefix_size(size: np.ndarray, t: float) -> np.ndarray:
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def needed(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The least overlap of sets of sizes a and b with similarity t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def probe(gram: np.ndarray, cls: np.ndarray, size: np.ndarray, pos: np.ndarray, t: float, hot: int) -> tuple[np.ndarray, ...]:
    """Candidate pairs of classes from index entries; pos is a gram's position in its set, from 0. Of lists of more than hot classes, instead, the least class with each (itself too), and its size.

    Entries are sorted by gram, position, size. Each entry probes, in its list, the blocks of its own and later positions; of each block it visits
    one range of sizes and skips the rest.
    """
    order = np.lexsort((cls, size, pos, gram))
    gram, cls, size, pos = gram[order], cls[order], size[order], pos[order]
    if len(gram):  # copies: one entry for each class in a list
        fresh = np.append(True, (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1]))
        gram, cls, size, pos = gram[fresh], cls[fresh], size[fresh], pos[fresh]
    head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, dtype=np.int64)
    length = np.diff(np.append(head, len(gram)))
    crowded = np.repeat(length > hot, length)
    joined = cls[crowded], size[crowded]
    if len(joined[0]):
        begin = np.cumsum(length[length > hot]) - length[length > hot]
        least = np.repeat(np.minimum.reduceat(joined[0], begin), length[length > hot])
        order = np.lexsort((joined[0], least))
        least, *joined = least[order], joined[0][order], joined[1][order]
        keep = np.append(True, (least[1:] != least[:-1]) | (joined[0][1:] != joined[0][:-1]))
        joined = least[keep], joined[0][keep], joined[1][keep]
    else:
        joined = joined[0], *joined
    many = np.repeat((length > 1) & (length <= hot), length)
    gram, cls, size, pos = gram[many], cls[many], size[many], pos[many]
    if not len(gram):
        return cls, cls, *joined
    head = np.append(True, gram[1:] != gram[:-1])
    listed = np.cumsum(head) - 1
    block = np.cumsum(head | np.append(True, pos[1:] != pos[:-1])) - 1
    block_start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    block_pos, block_list = pos[block_start], listed[block_start]
    last_block = np.searchsorted(block_list, np.arange(listed[-1] + 1), "right") - 1
    # One sortable number for (block, size): ranges of a block are found by bisection in the whole index.
    width = np.int64(size.max()) + 2
    rank = block * width + size
    out_a, out_b = [], []
    me, at = np.arange(len(gram)), block.copy()
    s = size.astype(float)
    while len(me):
        x, i, j = s[me], pos[me].astype(float), block_pos[at].astype(float)
        low = np.maximum(np.ceil(t * x - 1e-9), np.ceil(t * x + (1 + t) * j - 1e-9))
        high = np.minimum(np.floor(x / t + 1e-9), np.floor((x - i) * (1 + t) / t - x + 1e-9))
        some = high >= low
        low, high = np.clip(low, 0, width - 1).astype(np.int64), np.clip(high, -1, width - 2).astype(np.int64)
        a = np.searchsorted(rank, at * width + low, "left")
        b = np.searchsorted(rank, at * width + high, "right")
        a = np.where(at == block[me], np.maximum(a, me + 1), a)  # within its own block, only entries behind it
        n = np.where(some, np.maximum(b - a, 0), 0)
        out_a.append(np.repeat(cls[me], n))
        out_b.append(cls[ragged(a, n)])
        at = at + 1
        on = at <= last_block[listed[me]]
        me, at = me[on], at[on]
        if sum(map(len, out_a)) > 1 << 22:
            out_a, out_b = ([x] for x in distinct(np.concatenate(out_a), np.concatenate(out_b)))
    return *distinct(np.concatenate(out_a), np.concatenate(out_b)), *joined


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    keep = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])) & (low != high) if len(low) else np.zeros(0, dtype=bool)
    return low[keep], high[keep]


def candidates(docs: DataFrame, n: int, t: float, buckets: int, order: Order, hot: int = HOT) -> DataFrame:
    """Pairs of classes a, b that the index leaves, with size 0; repeats between buckets are taken out. For lists of more than hot classes, the least class a with each class b and the size of b."""
    known = Sent(docs.sparkSession, order)
    step = 1 << 19

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()
        size = 0

        def fresh(c: int) -> bool:
            if not c or c in seen:
                return False
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(c)
            return True

        def out() -> pa.RecordBatch:
            gram, cls, n_grams, pos = (np.concatenate(x) for x in zip(*held))
            spread = mix(gram)
            there, blobs = packed(buckets, spread, gram, cls, n_grams, pos)
            return pa.record_batch([pa.array(there.astype(np.int32)), *blobs], names=["bucket", "gram", "cls", "size", "pos"])

        for piece in slices(batches, "text"):
            owner, keys, cls = ordered(*folded_words(piece.column(0)), n, known.value)
            count = np.bincount(owner, minlength=len(cls))
            take = np.where([fresh(c) for c in cls.tolist()], np.minimum(prefix_size(count, t), count), 0)
            start = np.cumsum(count) - count
            at = ragged(start, take)
            pos = ragged(np.zeros(len(take), dtype=np.int64), take)
            of = np.repeat(np.arange(len(take)), take)
            held.append((keys[at], cls[of], count[of].astype(np.uint32), pos.astype(np.uint32)))
            size += len(at)
            if size >= step:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = {}
        for batch in batches:
            for b, *blobs in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                by.setdefault(b, []).append(blobs)
        for b in list(by):
            blobs = by.pop(b)
            columns = [np.concatenate([np.frombuffer(x[k].as_buffer(), dtype=kind) for x in blobs]) for k, kind in enumerate((np.uint64, np.uint64, np.uint32, np.uint32))]
            low, high, *joined = probe(columns[0], columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), t, hot)
            a, c, sizes = np.append(low, joined[0]), np.append(high, joined[1]), np.append(np.zeros(len(low), dtype=np.int64), joined[2])
            there, blobs = packed(buckets, mix(a ^ mix(c)), a, c, sizes)
            yield pa.record_batch([pa.array(there.astype(np.int32)), *blobs], names=["bucket", "a", "b", "size"])

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = {}
        for batch in batches:
            for b, *blobs in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                by.setdefault(b, []).append(blobs)
        for b in list(by):
            blobs = by.pop(b)
            a, c, sizes = (np.concatenate([np.frombuffer(x[k].as_buffer(), dtype=np.int64) for x in blobs]) for k in range(3))
            order = np.lexsort((sizes, c, a))
            a, c, sizes = a[order], c[order], sizes[order]
            fresh = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (sizes[1:] != sizes[:-1]))
            a, c, sizes = a[fresh], c[fresh], sizes[fresh]
            for k in range(0, len(a), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.record_batch([pa.array(a[part]), pa.array(c[part]), pa.array(sizes[part])], names=["a", "b", "size"])

    entries = in_arrow(docs.select("text"), index, "bucket int, gram binary, cls binary, size binary, pos binary")
    # A pair stands in many lists, and the more buckets there are, the more of them have it; so pairs move in bulk, too.
    pairs = in_arrow(entries.repartitionById(buckets, F.col("bucket")), join, "bucket int, a binary, b binary, size binary")
    return in_arrow(pairs.repartitionById(buckets, F.col("bucket")), once, "a bigint, b bigint, size bigint")


def crowds(hot: DataFrame) -> DataFrame:
    """cls, size and crowd of all classes in hot lists (a, b, size), the crowd the same for all that chains of lists join; stored."""
    roots = components(hot.where("a != b").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))).toDF("cls", "crowd")
    return stored(hot.sparkSession, hot.groupBy(F.col("b").alias("cls")).agg(F.max("size").alias("size")).join(roots, "cls"))


def met_in_crowds(crowded: DataFrame, t: float, block: int) -> DataFrame:
    """place, cls and side: any two classes of a crowd whose sizes allow a similarity of t are in one place. All of side 0 meet each other there, those of side 1 meet those of side 2."""
    # Two sizes that allow it are at most two levels apart, three if rounded.
    level = F.floor(F.log("size") / max(-np.log(t) / 2, 1e-6)).alias("level")
    leveled = crowded.select("cls", "crowd", "size", level)
    shares = leveled.groupBy("crowd", "level").agg(F.ceil(F.greatest(F.count("*") / (WIDE * block), F.sum("size") / WIDE_GRAMS)).alias("blocks"))
    dealt = stored(crowded.sparkSession, leveled.join(shares, ["crowd", "level"]).select("cls", "crowd", F.struct("level", F.pmod(F.xxhash64(F.lit(3), "cls"), "blocks").alias("part")).alias("block")))
    blocks = dealt.select("crowd", "block").distinct()
    both = blocks.toDF("crowd", "x").join(blocks.toDF("crowd", "y"), "crowd").where((F.col("x") <= F.col("y")) & (F.col("y.level") - F.col("x.level") <= 3))
    both = both.withColumn("place", F.xxhash64(F.lit(4), "crowd", "x", "y"))
    low = both.select("crowd", F.col("x").alias("block"), "place", F.when(F.col("x") == F.col("y"), 0).otherwise(1).alias("side"))
    high = both.where("x != y").select("crowd", F.col("y").alias("block"), "place", F.lit(2).alias("side"))
    return dealt.join(low.union(high), ["crowd", "block"]).select("place", "cls", "side")


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """cls, size and sketch of the classes of all texts. Bit k of a sketch of m bits, a power of two, says that the set has a gram whose mixed hash is k modulo m. A class may come several times."""

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in slices(batches, "text"):
            owner, grams, size, cls = sets_of(*folded_words(piece.column(0)), n)
            bits = np.int64(1) << np.ceil(np.log2(np.maximum(SKETCH * size, 64))).astype(np.int64)
            stop = np.cumsum(bits)
            flags = np.zeros(int(stop[-1]) if len(stop) else 0, dtype=bool)
            flags[(stop - bits)[owner] + (mix(grams) & (bits - 1).astype(np.uint64)[owner]).astype(np.int64)] = True
            raw = np.packbits(flags, bitorder="little")
            if len(seen) >= SEEN:
                seen.clear()
            fresh = []
            for k, c in enumerate(cls.tolist()):
                if c and c not in seen:
                    seen.add(c)
                    fresh.append(k)
            at = np.array(fresh, dtype=np.int64)
            blobs = pieces_of(raw, (stop - bits)[at] // 8, stop[at] // 8)
            yield pa.record_batch([pa.array(cls[at].view(np.int64)), pa.array(size[at].astype(np.int64)), blobs], names=["cls", "size", "sketch"])

    return in_arrow(docs.select("text"), draw, "cls bigint, size bigint, sketch binary")


def most_overlap(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
    """No less than the overlap of sets with these sketches, a row each: bits in common, and, as several grams of a set may share a bit, the lesser number of grams without one of their own."""
    width = min(x.shape[1], y.shape[1])
    x, y = (np.bitwise_or.reduce(z.reshape(len(z), -1, width), axis=1) for z in (x, y))
    ones = lambda z: np.bitwise_count(z.view(np.uint64)).sum(axis=1, dtype=np.int64)
    return ones(x & y) + np.minimum(size_x - ones(x), size_y - ones(y))


def not_ruled_out(pairs: DataFrame, docs: DataFrame, n: int, t: float) -> DataFrame:
    """The pairs of classes a, b whose sketches allow a similarity of t; stored. Sketches move, sets don't."""
    spark = pairs.sparkSession

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_x, size_y = (batch.column(k).to_numpy() for k in (2, 3))
            lengths = [np.diff(utf8(batch.column(k))[1]) for k in (4, 5)]
            like = np.zeros(batch.num_rows, dtype=bool)
            for long_x, long_y in set(zip(*(x.tolist() for x in lengths))):
                mine = (lengths[0] == long_x) & (lengths[1] == long_y)
                x, y = (utf8(batch.column(k).filter(pa.array(mine)))[0].reshape(-1, long) for k, long in ((4, long_x), (5, long_y)))
                like[mine] = most_overlap(x, y, size_x[mine], size_y[mine]) >= needed(size_x[mine].astype(float), size_y[mine].astype(float), t)
            yield batch.select(["a", "b"]).filter(pa.array(like))

    path = shared_folder(spark)
    with scratch(spark):
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        drawn = stored(spark, sketches(docs, n).join(wanted, "cls", "left_semi").dropDuplicates(["cls"]))
        x, y = (drawn.toDF(c, "size_" + c, "sketch_" + c) for c in "ab")
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
        in_arrow(both, test, "a bigint, b bigint").write.parquet(path)
    swept(spark)
    return owned(spark, path, pairs.select("a", "b").schema)


def shipped_sets(docs: DataFrame, ships: DataFrame, n: int, limit: int) -> DataFrame:
    """place, class, docs, side and grams for each row of ships (cls, rep, docs, place, side): the set of document rep goes to the place."""
    spark = docs.sparkSession
    small = ships.count() <= limit
    known = None
    names = ["cls", "rep", "docs", "place", "side"]
    wanted = None
    if small:
        table = ships.orderBy("cls").toArrow()
        columns = [table.column(c).to_numpy() for c in names]
        wanted = np.unique(columns[1])
        known = spark.sparkContext.broadcast(columns)
    elif (reps := ships.select("rep").distinct()).count() <= limit:
        wanted = np.sort(reps.toArrow().column(0).to_numpy())
    wanted = wanted if wanted is None else spark.sparkContext.broadcast(wanted)

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:  # only texts that go somewhere are cut into words
            reps = wanted.value
            batches = (batch.filter(pa.array(member(batch.column(0).to_numpy(), reps))) for batch in batches)
        for piece in slices(batches, "text"):
            _, grams, size, cls = sets_of(*folded_words(piece.column(1)), n)
            signed, end = cls.view(np.int64), np.cumsum(size)
            if known is None:
                at = np.flatnonzero(cls != 0)
                docs = place = signed[at]
                side = np.zeros(len(at), dtype=np.int8)
            else:
                keys, rep, count, places, sides = known.value
                low, high = np.searchsorted(keys, signed, "left"), np.searchsorted(keys, signed, "right")
                at = np.repeat(np.arange(len(cls)), high - low)
                hit = ragged(low, high - low)
                mine = rep[hit] == piece.column(0).to_numpy()[at]
                at, docs, place, side = at[mine], count[hit[mine]], places[hit[mine]], sides[hit[mine]]
            for k in range(0, len(at), 1 << 10):
                part = at[k : k + (1 << 10)]
                blob = pieces_of(grams.view(np.uint8), (end - size)[part] * 8, end[part] * 8)
                yield pa.record_batch([pa.array(place[k : k + (1 << 10)]), pa.array(signed[part]), pa.array(docs[k : k + (1 << 10)]), pa.array(side[k : k + (1 << 10)]), blob], names=["place", "cls", "docs", "side", "grams"])

    schema = "place bigint, cls bigint, docs bigint, side tinyint, grams binary"
    rows = docs.select("doc_id", "text")
    if small:
        return in_arrow(rows, grams, schema)
    if wanted is None:
        rows = rows.join(ships.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = in_arrow(rows, grams, schema).dropDuplicates(["cls"]).select("cls", "grams")
    return ships.join(sets, "cls").select("place", "cls", "docs", "side", "grams")


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|sets[a] & sets[b]| for each pair of numbers, from the sets' differences to the one that most pairs have; sets are sorted arrays."""
    leader = sets[int(np.bincount(np.concatenate([a, b]), minlength=len(sets)).argmax())]
    lost, lacking, added = np.zeros(len(sets), dtype=np.int64), [], []
    for k, x in enumerate(sets):
        both = member(x, leader)
        gone = np.ones(len(leader), dtype=bool)
        gone[np.searchsorted(leader, x[both])] = False
        lacking.append(np.flatnonzero(gone))
        added.append(x[~both])
        lost[k] = len(lacking[-1])
    # A difference is coded by the leader's place that is lacking, or, behind these, by the number of the gram that is added.
    names, coded = np.unique(np.concatenate(added), return_inverse=True)
    more = np.array([len(x) for x in added])
    ends = np.cumsum(more)
    codes = [np.concatenate([x, len(leader) + coded[e - m : e]]) for x, e, m in zip(lacking, ends, more)]
    length = lost + more
    start, flat = np.cumsum(length) - length, np.concatenate(codes)
    out = len(leader) - lost[a] - lost[b]
    order = np.argsort(a, kind="stable")
    mark = np.zeros(len(leader) + len(names), dtype=bool)
    edges = np.append(np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])), len(order))
    for low, high in zip(edges[:-1], edges[1:]):
        mine = order[low:high]
        own, others = codes[a[mine[0]]], b[mine]
        if not len(own):
            continue
        mark[own] = True
        stop = np.cumsum(length[others])
        sums = np.append(0, np.cumsum(mark[flat[ragged(start[others], length[others])]]))
        out[mine] += sums[stop] - sums[stop - length[others]]
        mark[own] = False
    return out


def all_overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """|sets[a] & sets[b]| for each a of left (rows) and b of right (columns): a product of 0/1 matrices over the grams that many have, pairs of entries for the others."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    kinds, shape = int(code.max()) + 1, (len(left), len(right))
    sides = []
    for mine in (left, right):
        number = np.full(len(sets), -1)
        number[mine] = np.arange(len(mine))
        at = np.flatnonzero(number[owner] >= 0)
        at = at[np.argsort(code[at], kind="stable")]
        sides.append((number[owner[at]], code[at], np.bincount(code[at], minlength=kinds)))
    products = sides[0][2] * sides[1][2]
    dense = products > shape[0] * shape[1] / 128
    out = np.zeros(shape, dtype=np.float32)
    column, step = np.cumsum(dense) - 1, 1024
    wide = [(number[dense[codes]], column[codes[dense[codes]]]) for number, codes, _ in sides]
    for k in range(0, int(dense.sum()), step):
        tables = []
        for (number, columns), n in zip(wide, shape):
            low, high = np.searchsorted(columns, [k, k + step])
            table = np.zeros((n, step), dtype=np.float32)
            table[number[low:high], columns[low:high] - k] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    thin = (products > 0) & ~dense
    number, codes, _ = sides[0]
    number, codes = number[thin[codes]], codes[thin[codes]]
    others, _, times = sides[1]
    start, n = (np.cumsum(times) - times)[codes], times[codes]
    ends = np.cumsum(n)
    edges = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], 1 << 20)), len(n))) if len(n) else []
    for low, high in zip(edges[:-1], edges[1:]):
        cell = np.repeat(number[low:high] * shape[1], n[low:high]) + others[ragged(start[low:high], n[low:high])]
        out += np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape)
    return out


def least_of_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n numbers, the least one that a chain of pairs links it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def met(arrays: list[np.ndarray], size: np.ndarray, side: np.ndarray, t: float, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs a, b of numbers of sets with similarity t or more, and their overlaps: of all of side 0, or, if there are none, of side 1 with side 2; block and block of them at once."""
    one = bool((side == 0).any())
    left, right = (np.flatnonzero(side == (0 if one else k)) for k in (1, 2))
    cut = lambda x: [x[k : k + block] for k in range(0, len(x), block)]
    left, right = (cut(x[np.argsort(size[x], kind="stable")]) for x in (left, right))
    for i, x in enumerate(left):
        for y in right[i if one else 0 :]:
            if min(size[x[-1]], size[y[-1]]) < t * max(size[x[0]], size[y[0]]) - 1e-9:  # no sizes here allow it
                continue
            same = one and y is right[i]
            mine = [arrays[k] for k in x] + ([] if same else [arrays[k] for k in y])
            both = all_overlaps(mine, np.arange(len(x)), np.arange(len(mine) - len(y), len(mine)))
            like = both >= needed(size[x].astype(float)[:, None], size[y].astype(float), t)
            a, b = np.nonzero(np.triu(like, 1) if same else like)
            yield x[a], y[b], both[a, b].astype(np.int64)


def answered(groups: DataFrame, t: float, counted: bool, block: int = BLOCK) -> DataFrame:
    """Pairs of classes with similarity t or more; groups has, by place, its pairs (a, b) and its sets (a, null, docs, side, grams), or, for crowds, only sets: see met_in_crowds(). Other sets have side -1.

    counted: instead of pairs, for each class that has some in a place, how many documents they lead to there, and the least class that they link it to.
    """
    schema = "cls bigint, links bigint, root bigint" if counted else "a bigint, b bigint, jaccard double"

    def out(sets: dict[int, tuple[np.ndarray, int, int]], pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys = np.sort(np.fromiter(sets, dtype=np.int64, count=len(sets)))
        arrays = [sets[k][0] for k in keys.tolist()]
        size = np.array([len(x) for x in arrays])
        if pairs:
            a, b = (np.searchsorted(keys, np.concatenate(x)) for x in zip(*pairs))
            both = overlaps(arrays, a, b)
            like = both >= needed(size[a].astype(float), size[b].astype(float), t)
            found = iter([(a[like], b[like], both[like])])
        else:
            found = met(arrays, size, np.array([sets[k][2] for k in keys.tolist()], dtype=np.int64), t, block)
        docs = np.array([sets[k][1] for k in keys.tolist()])
        links = np.zeros(len(keys), dtype=np.int64)
        chains: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b, both in found:
            if not counted and len(a):
                yield pa.record_batch([pa.array(keys[a]), pa.array(keys[b]), pa.array(both / (size[a] + size[b] - both))], names=["a", "b", "jaccard"])
            elif len(a):
                links += (np.bincount(a, weights=docs[b], minlength=len(keys)) + np.bincount(b, weights=docs[a], minlength=len(keys))).astype(np.int64)
                root = least_of_linked(len(keys), a, b)
                led = np.flatnonzero(root != np.arange(len(keys)))
                chains.append((led, root[led]))
        if chains:
            root = least_of_linked(len(keys), *(np.concatenate(x) for x in zip(*chains)))
            some = np.flatnonzero(links > 0)
            yield pa.record_batch([pa.array(keys[some]), pa.array(links[some]), pa.array(keys[root[some]])], names=["cls", "links", "root"])

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sets, pairs = None, {}, []
        for batch in batches:
            if not batch.num_rows:
                continue
            place, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            paired = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            b, docs, side = (batch.column(k).fill_null(0).to_numpy() for k in (2, 3, 4))
            edges = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place)).tolist()
            for low, high in zip(edges[:-1], edges[1:]):
                if place[low] != here:
                    yield from out(sets, pairs)
                    here, sets, pairs = place[low], {}, []
                mine = paired[low:high]
                if mine.any():
                    pairs.append((a[low:high][mine], b[low:high][mine]))
                for k in (np.flatnonzero(~mine) + low).tolist():
                    sets[int(a[k])] = np.frombuffer(batch.column(5)[k].as_py(), dtype=np.uint64), int(docs[k]), int(side[k])
        yield from out(sets, pairs)

    return in_arrow(groups, answer, schema)


def similar_classes(docs: DataFrame, members: DataFrame, order: Order, n: int = GRAM, t: float = THRESHOLD, limit: int = BROADCAST_KEYS, counted: bool = False, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    spark = docs.sparkSession
    buckets = slots(spark, docs)
    found = stored(spark, candidates(docs, n, t, buckets, order, hot))
    swept(spark)
    pairs, lists = found.where("size = 0").select("a", "b"), found.where("size > 0")
    crowded = crowds(lists) if lists.limit(1).count() else None
    if crowded is not None:  # pairs within a crowd are compared there
        a, b = (crowded.select(F.col("cls").alias(x), F.col("crowd").alias("of_" + x)) for x in "ab")
        pairs = stored(spark, pairs.join(a, "a", "left").join(b, "b", "left").where(~F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False))).select("a", "b"))
    pairs = not_ruled_out(pairs, docs, n, t)
    sides = pairs.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    leaders = sides.groupBy("cls").agg(F.least(F.col("cls"), F.min("other")).alias("leader"))
    led = stored(spark, pairs.join(leaders.withColumnRenamed("cls", "a"), "a").select("leader", "a", "b"))
    sides = led.select("leader", F.col("a").alias("cls")).union(led.select("leader", "b")).distinct()
    large = sides.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") > block).select("leader", F.ceil(F.col("n") / block).alias("blocks"))
    dealt = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.coalesce("blocks", F.lit(1)))
    i, j = dealt("a"), dealt("b")
    placed = stored(spark, led.join(large, "leader", "left").select(F.xxhash64("leader", F.least(i, j), F.greatest(i, j)).alias("place"), "a", "b"))
    ships = placed.select("place", F.col("a").alias("cls")).union(placed.select("place", "b")).distinct().withColumn("side", F.lit(-1))
    if crowded is not None:
        ships = ships.union(met_in_crowds(crowded, t, block))
    standing = members.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("docs"))
    ships = stored(spark, ships.join(standing, "cls").select("cls", "rep", "docs", "place", F.col("side").cast("tinyint").alias("side")))
    shipped = shipped_sets(docs, ships, n, limit).select("place", F.col("cls").alias("a"), F.lit(None).cast("bigint").alias("b"), "docs", "side", "grams")
    groups = shipped.union(placed.select("place", "a", "b", F.lit(None).cast("bigint").alias("docs"), F.lit(None).cast("tinyint").alias("side"), F.lit(None).cast("binary").alias("grams")))
    parts = max(buckets, -(-ships.count() // SETS))
    return answered(groups.repartition(parts, "place").sortWithinPartitions("place"), t, counted, block)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text) and text; null ids are left out."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text"))


def classed(docs: DataFrame, n: int, limit: int) -> tuple[DataFrame, Order]:
    """doc_id, cls and tie of all rows with words, and the order of grams."""
    counted = stored(docs.sparkSession, statistics(docs, n, slots(docs.sparkSession, docs)))
    members = counted.where(F.col("kind") == CLASSES).select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), F.col("c").alias("tie"))
    order = order_of(counted, limit)
    swept(docs.sparkSession)
    return members, order


def jaccard_join(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, limit: int = BROADCAST_KEYS, hot: int = HOT) -> DataFrame:
    """Pairs doc_a, doc_b, jaccard of documents whose n-gram sets have a Jaccard similarity of threshold or more, exactly.

    The least doc_id of a class of equal sets stands for the class: a class of k documents has k - 1 rows, from that document to each
    other (jaccard 1), and two similar classes have one row, from the lesser of their two documents. All pairs of documents follow from
    these rows: any other document has the partners of the one that its row of jaccard 1 names.

    A document of fewer than n words has one gram, all its words; without words (null or empty text) it is in no pair. Null ids are left
    out, and rows that repeat in id and text count once; an id with several texts has a row for each pair its texts are in, none with itself. An empty
    table gives no rows; further columns are ignored. Where many texts are near copies of one another, rows grow with their square; groups() doesn't.
    """
    docs = keyed(docs)
    members, order = classed(docs, n, limit)
    standing = members.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    copies = members.join(standing, "cls").where("doc_id > rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")).distinct()
    near = similar_classes(docs, members, order, n, threshold, limit, hot=hot)
    near = near.join(standing.toDF("a", "ra"), "a").join(standing.toDF("b", "rb"), "b").where("ra != rb")
    near = near.select(F.least("ra", "rb").alias("doc_a"), F.greatest("ra", "rb").alias("doc_b"), "jaccard")
    return copies.union(near)


def linked_classes(docs: DataFrame, members: DataFrame, order: Order, n: int, threshold: float, limit: int, block: int = BLOCK, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """cls and links, the documents in other classes that are similar to it, of classes that have some; and cls and root, the same for all classes that similar pairs link. Both are stored."""
    spark = docs.sparkSession
    found = stored(spark, similar_classes(docs, members, order, n, threshold, limit, True, block, hot))
    swept(spark)
    edges = found.where("cls != root").select(F.col("cls").alias("doc_a"), F.col("root").alias("doc_b"))
    return stored(spark, found.groupBy("cls").agg(F.sum("links").alias("links"))), components(edges).toDF("cls", "root")


def groups(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, limit: int = BROADCAST_KEYS, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """For each document doc_id, class_id and links: the least doc_id that a chain of similar documents leads to, and how many other documents it is similar to itself.

    Similar: their n-gram sets have a Jaccard similarity of threshold or more, exactly; all such pairs count, none is listed. A document like no other has its own id and 0,
    so does one without words (null or empty text). Null ids are left out, and rows that repeat in id and text count once; an id with
    several texts has a row for each. An empty table gives no rows; further columns are ignored.
    """
    docs = keyed(docs)
    members, order = classed(docs, n, limit)
    links, roots = linked_classes(docs, members, order, n, threshold, limit, block, hot)
    rows = members.distinct()
    by_class = rows.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count_distinct("doc_id").alias("same"))
    by_class = by_class.join(links, "cls", "left").join(roots, "cls", "left").select("cls", "least", "same", F.coalesce("links", F.lit(0)).alias("near"), F.coalesce("root", "cls").alias("root"))
    by_class = stored(docs.sparkSession, by_class)
    class_ids = by_class.groupBy("root").agg(F.min("least").alias("class_id"))
    facts = by_class.join(class_ids, "root").select("cls", "class_id", (F.col("same") - 1 + F.col("near")).alias("links"))
    worded = rows.join(facts, "cls").select("doc_id", "class_id", "links")
    wordless = docs.where(~F.coalesce(F.col("text").rlike(FOLDED_LETTER), F.lit(False))).select("doc_id", "tie").distinct().select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return worded.union(wordless)


def one_of_each(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, limit: int = BROADCAST_KEYS, marks: int = BROADCAST_MARKS) -> DataFrame:
    """The rows of docs, all columns as they are, one of each group that chains of similar texts link: the one with the least doc_id (null last), then the least hash of the text.

    Rows without words (null, empty or blank text) all stay, as they are in no group. Of rows that repeat in id and text one stays. An id with several texts loses only those
    that are in a group with a lesser one. An empty table gives no rows; further columns are kept.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text"))
    members, order = classed(slim, n, limit)
    _, roots = linked_classes(slim, members, order, n, threshold, limit)
    rows = members.groupBy("doc_id", "tie", "cls").agg(F.count("*").alias("times"))
    rows = stored(spark, rows.join(roots, "cls", "left").select("doc_id", "tie", "times", F.coalesce("root", "cls").alias("root")))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "tie")).alias("first"), F.sum("times").alias("n")).where("n > 1")
    marked = rows.join(first, "root").select("doc_id", "tie", (F.col("first") == F.struct("doc_id", "tie")).alias("stays"), "times").where("times > 1 OR NOT stays")
    marked = stored(spark, marked)
    few = marked.count() <= marks
    mark = ["_i", "_t", "_stays", "_once"]
    while {c.lower() for c in docs.columns} & set(mark):
        mark = [c + "_" for c in mark]
    i, t, stays, once = mark
    known = docs.join(F.broadcast(marked.toDF(i, t, stays, once)) if few else marked.toDF(i, t, stays, once), (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)) == F.col(i)) & (F.xxhash64("text") == F.col(t)), "left")
    kept = known.where(F.coalesce(F.col(stays), F.lit(True)))
    if not marked.where("stays").limit(1).count():
        return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
    alone = kept.where(F.col(stays).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    return alone.union(kept.where(stays).dropDuplicates([i, t]).select(*[F.col(f"`{c}`") for c in docs.columns]))


def components(edges: DataFrame) -> DataFrame:
    """doc_id and root, the least number it is linked to: pointer jumping, whose rounds grow with the logarithm of the longest chain; stored.

    In each round a node takes the least root among its neighbours' roots, its old root takes it too, and roots are followed once. Nulls must not be in edges; repeated
    edges count once, and none give no rows.
    """
    spark = edges.sparkSession
    with scratch(spark):
        both = stored(spark, edges.select(F.col("doc_a").alias("x"), F.col("doc_b").alias("y")).union(edges.select("doc_b", "doc_a")).distinct())
        roots = stored(spark, both.groupBy(F.col("x").alias("doc_id")).agg(F.least(F.min("y"), F.col("x")).alias("root")))
        while True:
            seen = both.join(roots.toDF("y", "r"), "y").groupBy("x").agg(F.min("r").alias("r"))
            best = roots.join(seen.withColumnRenamed("x", "doc_id"), "doc_id").select("doc_id", "root", F.least("root", "r").alias("best"))
            hooks = best.groupBy("root").agg(F.min("best").alias("best")).toDF("doc_id", "hook")
            moved = best.join(hooks, "doc_id", "left").select("doc_id", "root", F.least("best", F.coalesce("hook", "best")).alias("best"))
            jumped = moved.alias("m").join(moved.select(F.col("doc_id").alias("best"), F.col("best").alias("next")).alias("n"), "best").select("doc_id", F.col("root").alias("old"), F.least("best", "next").alias("root"))
            jumped = stored(spark, jumped)
            changed = jumped.where("root != old").limit(1).count()
            roots = jumped.select("doc_id", "root")
            if not changed:
                break
        path = shared_folder(spark)
        roots.write.parquet(path)
    return owned(spark, path, roots.schema)


ORACLE = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({FOLDED_SQL.format(text="text")}, '{FOLDED_WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < {GRAM} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {GRAM} + 2), lambda i: array_to_string(list_slice(w, i, i + {GRAM} - 1), ' ')))) END AS grams
  FROM split WHERE len(w) > 0
), classed AS (
  SELECT doc_id, grams, len(grams) AS n, min(doc_id) OVER (PARTITION BY grams) AS rep, count(*) OVER (PARTITION BY grams) AS same FROM sets
), items AS (
  SELECT rep, n, same, unnest(grams) AS g FROM classed WHERE doc_id = rep
), shared AS (
  SELECT a.rep AS x, b.rep AS y, a.n AS na, b.n AS nb, b.same AS same, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL
), near AS (
  SELECT x, y, same FROM shared WHERE c >= ceil({THRESHOLD} / (1 + {THRESHOLD}) * (na + nb) - 1e-9)
), reached AS (
  SELECT DISTINCT x, x AS y FROM near UNION SELECT r.x, n.y FROM reached r JOIN near n ON r.y = n.x
), roots AS (
  SELECT x, min(y) AS root FROM reached GROUP BY x
), links AS (
  SELECT x, sum(same) AS links FROM near GROUP BY x
)
SELECT c.doc_id, coalesce(r.root, c.rep) AS class_id, CAST(c.same - 1 + coalesce(l.links, 0) AS BIGINT) AS links
FROM classed c LEFT JOIN roots r ON r.x = c.rep LEFT JOIN links l ON l.x = c.rep
UNION ALL SELECT doc_id, doc_id, 0 FROM split WHERE len(w) = 0 OR w IS NULL
"""
