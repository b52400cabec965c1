"""Repeated windows of words by a depth-limited radix sort of suffixes.

A suffix is a document from one of its words on (folded: lower case, ASCII punctuation left out). Suffixes are ordered through their first
DEPTH words only, by most-significant-digit passes of DIGIT words each; after a pass, a suffix that shares its digits with
no other is dropped. The groups left after the last pass are exactly the windows of DEPTH words that occur more than once.

Two steps in front of the passes bring equal windows together without moving every suffix. Each window is known by the least of the
hashes of its GRAM-word grams; equal windows have equal least grams, so (1) a window whose least gram occurs once in the
corpus can't repeat, and (2) the runs of consecutive windows that share a recurring least gram go, with their words, to that gram's partition. The first
pass is the distribution by that gram; the others run within the partition. Both steps are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.columnar import FOLDED_SQL, FOLDED_WORD, _BASE, fold, key_filter, member, mix, owners, pieces_of, ragged, slices, span_hashes, utf8, words
from tidegrid.llm.shared import column_at, in_arrow, slots, stored

DEPTH, GRAM, DIGIT = 50, 8, 10
#: Recurring grams are sent to the scan if no more than this; beyond, they reach the documents by joins.
BROADCAST_KEYS = 4_000_000
#: Bytes of runs that the passes sort at once; a larger group of one gram is sorted alone.
SORT_BYTES = 4 << 20


def flat_grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position on; the last n - 1 positions have none."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + h[k : k + size]
    return mix(out)


def sliding_least(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values, the index of its least one, the leftmost of equals."""
    if len(g) < width:
        return np.zeros(0, dtype=np.int32)
    at, reach = np.arange(len(g), dtype=np.int32), 1
    while 2 * reach <= width:
        a, b = at[:-reach], at[reach:]
        at = np.where(g[b] < g[a], b, a)
        reach *= 2
    if reach < width:
        a, b = at[: len(g) - width + 1], at[width - reach :]
        at = np.where(g[b] < g[a], b, a)
    return at


def windows(texts: pa.Array, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """Folded bytes, words' starts and ends, first word of each text; then each window's first word, text and least gram's position; the grams."""
    data, offsets = utf8(texts)
    data = fold(data)
    starts, ends, bounds = words(data, offsets)
    g = flat_grams(span_hashes(data, starts, ends), gram)
    least = sliding_least(g, depth - gram + 1)
    count = np.maximum(np.diff(bounds) - depth + 1, 0)
    at = ragged(bounds[:-1], count)
    return data, starts, ends, bounds, at, np.repeat(np.arange(len(count)), count), least[at], g


def recurring(docs: DataFrame, depth: int, gram: int) -> DataFrame:
    """The least grams that occur at more than one place, as key."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            *_, least, g = windows(piece.column(0), depth, gram)
            keys, times = np.unique(g[np.unique(least)], return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(times)], names=["key", "times"])

    counted = in_arrow(docs.select("text"), count, "key bigint, times bigint")
    return counted.groupBy("key").agg(F.sum("times").alias("times")).where("times > 1").select("key")


def runs(docs: DataFrame, depth: int, gram: int, limit: int) -> DataFrame:
    """Runs of windows whose least gram recurs: key, doc_id, tie, first window, number of windows, and their words."""
    spark = docs.sparkSession
    keys = stored(spark, recurring(docs, depth, gram))
    table = key_filter(spark, keys, limit)
    schema = "key bigint, doc_id bigint, tie bigint, at bigint, n bigint, body binary"
    known = spark.sparkContext.broadcast(table) if table is not None else None

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            data, starts, ends, bounds, at, of, least, g = windows(piece.column(2), depth, gram)
            if not len(at):
                continue
            key = g[least]
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
            first = np.flatnonzero(fresh)
            n = np.diff(np.append(first, len(at)))
            if known is not None:
                keep = member(key[first], known.value)
            else:
                wanted = piece.column(3)
                keep = np.zeros(len(first), dtype=bool)
                for k in np.flatnonzero(np.diff(bounds) >= depth):
                    mine = slice(*np.searchsorted(of[first], [k, k + 1]))
                    keep[mine] = member(key[first][mine], np.sort(wanted[k].values.to_numpy().view(np.uint64)))
            first, n = first[keep], n[keep]
            if not len(first):
                continue
            word = at[first]
            body = pieces_of(data, starts[word], ends[word + n + depth - 2])
            rows = pa.array(of[first])
            yield pa.record_batch([pa.array(key[first].view(np.int64)), piece.column(0).take(rows), piece.column(1).take(rows), pa.array(word - bounds[of[first]]), pa.array(n), body], names=["key", "doc_id", "tie", "at", "n", "body"])

    rows = docs.select("doc_id", "tie", "text")
    if table is None:

        def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, "text"):
                *_, of, least, g = windows(piece.column(2), depth, gram)
                at = np.unique(least, return_index=True)[1]
                rows = pa.array(of[at])
                yield pa.record_batch([pa.array(g[least[at]].view(np.int64)), piece.column(0).take(rows), piece.column(1).take(rows)], names=["key", "doc_id", "tie"])

        owned = in_arrow(rows, own, "key bigint, doc_id bigint, tie bigint").join(keys, "key", "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("t")).agg(F.collect_set("key").alias("keys"))
        rows = rows.join(owned, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("doc_id", "tie", "text", "keys")
    return in_arrow(rows, cut, schema)


def equal_groups(tokens: np.ndarray, suffixes: np.ndarray, group: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (positions in tokens) that share their first depth tokens with another of their group, and their final groups.

    Most-significant-digit passes over digits of several tokens, each a hash; the last digit may be shorter.
    """
    which = np.arange(len(suffixes))
    grams = {}
    for done in range(0, depth, digit):
        size = min(digit, depth - done)
        if size not in grams:
            grams[size] = flat_grams(tokens, size)
        value = grams[size][suffixes[which] + done]
        order = np.lexsort((value, group))
        which, value, group = which[order], value[order], group[order]
        fresh = np.ones(len(which), dtype=bool)
        fresh[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(fresh) - 1
        many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, dtype=bool)
        which, group = which[many], group[many]
    return which, group


def sorted_runs(table: pa.Table, depth: int, digit: int) -> pa.RecordBatch:
    """Repeated windows among the runs of whole keys: doc_id, tie, first and last window of a row of them, and whether they are the first of their kind."""
    table = table.combine_chunks()
    body = table.column("body").chunk(0)
    data, offsets = utf8(body)
    starts, ends, bounds = words(data, offsets)
    tokens = span_hashes(data, starts, ends)
    n, at, tie = (table.column(c).to_numpy() for c in ("n", "at", "tie"))
    known = table.column("doc_id").is_valid().to_numpy()
    ids = table.column("doc_id").fill_null(0).to_numpy()
    key = np.unique(table.column("key").to_numpy(), return_inverse=True)[1]
    run = np.repeat(np.arange(len(n)), n)
    within = ragged(np.zeros(len(n), dtype=np.int64), n)
    which, group = equal_groups(tokens, bounds[:-1][run] + within, key[run], depth, digit)
    run, place = run[which], within[which] + at[run[which]]
    # Rows that repeat in id and text are one document: one of their windows each counts.
    order = np.lexsort((place, tie[run], ids[run], known[run], group))
    run, place, group = run[order], place[order], group[order]
    same = np.zeros(len(run), dtype=bool)
    same[1:] = (group[1:] == group[:-1]) & (place[1:] == place[:-1]) & (tie[run[1:]] == tie[run[:-1]]) & (ids[run[1:]] == ids[run[:-1]]) & (known[run[1:]] == known[run[:-1]])
    run, place, group = run[~same], place[~same], group[~same]
    count = np.bincount(group) if len(group) else np.zeros(0, dtype=np.int64)
    many = count[group] > 1 if len(group) else np.zeros(0, dtype=bool)
    run, place, group = run[many], place[many], group[many]
    first = np.ones(len(run), dtype=bool)
    first[1:] = group[1:] != group[:-1]
    order = np.lexsort((place, first, tie[run], ids[run], known[run]))
    run, place, first = run[order], place[order], first[order]
    fresh = np.ones(len(run), dtype=bool)
    fresh[1:] = (tie[run[1:]] != tie[run[:-1]]) | (ids[run[1:]] != ids[run[:-1]]) | (known[run[1:]] != known[run[:-1]]) | (first[1:] != first[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(run)) - 1
    return pa.record_batch([
        pa.array(ids[run[head]], mask=~known[run[head]]), pa.array(tie[run[head]]), pa.array(place[head]), pa.array(place[last]) if len(head) else pa.array([], pa.int64()), pa.array(first[head]),
    ], names=["doc_id", "tie", "at", "until", "first"])


def spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, digit: int = DIGIT, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Spans of words covered by repeated windows: doc_id, tie (a hash of the text), start, n_words, first."""
    gram = min(gram, depth)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text"))

    def radix(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < SORT_BYTES:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # keys come sorted; the last one may go on
            if whole:
                yield sorted_runs(table.slice(0, whole), depth, digit)
                rest = table.slice(whole).combine_chunks()
                held, size = rest.to_batches(), rest.nbytes
        if held:
            yield sorted_runs(pa.Table.from_batches(held), depth, digit)

    found = in_arrow(runs(docs, depth, gram, limit).repartition(slots(docs.sparkSession, docs), "key").sortWithinPartitions("key"), radix, "doc_id bigint, tie bigint, at bigint, until bigint, first boolean")
    mine = Window.partitionBy("doc_id", "tie", "first").orderBy("at", "until")
    reach = F.max(F.col("until") + F.lit(depth)).over(mine.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", F.when(F.col("at") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("doc_id", "tie", "first", "island").agg(F.min("at").alias("start"), (F.max("until") + F.lit(depth) - F.min("at")).alias("n_words"))
    return merged.select("doc_id", "tie", "start", "n_words", "first")


def repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """For each span of words that repeated windows of depth words cover: doc_id, start (in words, from 0), n_words and first.

    Occurrences of a window are ordered by doc_id (null before all), then a hash of the text, then place; first spans join the
    windows that are the first of their kind, the others those that come again, in this or another document. A span of each kind may
    share words with one of the other. Documents of fewer than depth words, null and empty texts have no windows; rows that repeat in
    doc_id and text are one document; an empty table gives no rows; further columns are ignored.
    """
    return spans(docs, depth).select("doc_id", "start", "n_words", "first")


def without_repeats(docs: DataFrame, depth: int = DEPTH, limit: int = BROADCAST_KEYS) -> DataFrame:
    """docs with the words of all windows that come again cut from text, so that each such window stays once at most.

    Columns and rows stay; n_chars, where there is such a column, is counted again for a text that changed. What goes with a cut word is what stands between it and
    the next one. A text that is all repeats becomes empty. Null ids are an id like others, that of the first occurrence; null, empty and short texts have no windows and stay as they are; rows that repeat in
    doc_id and text are one document and are cut alike; an empty table gives no rows; columns may have any name, and text and n_chars may be written in any case.
    """
    names = docs.columns
    counted = next((k for k, c in enumerate(names) if c.lower() == "n_chars"), None)
    text_at = column_at(docs, "text")
    mark = "_cuts"
    while mark in [c.lower() for c in names]:
        mark += "_"
    again = spans(docs, depth, limit=limit).where("not first").groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("cuts"))
    again = again.select(F.col("doc_id").alias("i"), F.col("tie").alias("t"), "cuts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("text").alias("tie"))
    joined = rows.join(again, F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")), "left").select("row.*", F.col("cuts").alias(mark))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(batch.num_columns - 1)
            columns = batch.columns[:-1]
            touched = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            if len(touched):
                texts, counts = columns[text_at].to_pylist(), columns[counted].to_pylist() if counted is not None else None
                for k in touched:
                    texts[k] = shortened(texts[k], [(c["start"], c["n_words"]) for c in cuts[int(k)].as_py()])
                    if counts:
                        counts[k] = len(texts[k])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if counts:
                    columns[counted] = pa.array(counts, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(joined, cut, docs.schema)


def shortened(text: str, cuts: list[tuple[int, int]]) -> str:
    raw = text.encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, _, _ = words(fold(data), np.array([0, len(data)]))
    starts = np.append(starts, len(data))
    out, done = [], 0
    for start, n in cuts:
        a, b = int(starts[start]), int(starts[start + n])
        out.append(raw[done : max(done, a)])
        done = max(done, b)
    return b"".join([*out, raw[done:]]).decode()


ORACLE = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all({FOLDED_SQL.format(text="text")}, '{FOLDED_WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i AS p, md5(array_to_string(list_slice(w, i + 1, i + {DEPTH}), ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {DEPTH} + 1)) AS i FROM split WHERE len(w) >= {DEPTH})
), ranked AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) = 1 AS "first" FROM windows
), marked AS (
  SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, "first" ORDER BY p) + {DEPTH} THEN 0 ELSE 1 END AS new FROM ranked WHERE c > 1
), islands AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, "first" ORDER BY p) AS island FROM marked
)
SELECT doc_id, min(p) AS start, max(p) + {DEPTH} - min(p) AS n_words, "first" FROM islands GROUP BY doc_id, "first", island
"""
