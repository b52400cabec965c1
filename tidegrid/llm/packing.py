"""First-fit decreasing with a tournament tree, run by itself in each of many random groups of documents.

A row's group is a seeded hash of its id, the hash of its text and its number among rows that are equal in both, so that neither null ids nor copies
gather in one group, and a task that is run again deals its rows as before.

A document of more tokens than a bin holds is cut into full pieces and a rest, so whole texts are packed. The pieces of a
group go by falling length into the first bin with room. The tree holds each bin's free room at its leaves and the larger
of two rooms at each inner node; going left wherever the left child has room finds the first fit in as many steps as the
tree has levels.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.columnar import SPACE_CLASS
from tidegrid.llm.shared import stored

SCHEMA = "pack_group bigint, bin bigint, slot bigint, doc_id bigint, start bigint, n_tokens bigint"


def first_fit(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each size, in the order given; sizes are at most capacity."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        out.append(at - leaves)
        room[at] -= size
        at >>= 1
        while at:
            left, right = room[2 * at], room[2 * at + 1]
            best = left if left > right else right
            if room[at] == best:
                break
            room[at] = best
            at >>= 1
    return out


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_CLASS.replace("[", "[^") + "+")), F.lit(0)).cast("bigint")


def pack(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id", capacity: int = 2048, group_rows: int = 8_192, seed: int = 11) -> DataFrame:
    """A row for each piece: its group, bin (from 0), slot in the bin (from 0), doc_id, first token and number of tokens.

    tokens: each document's length, words between white space unless given. Documents of no tokens (null or empty
    text) take no room and have no row; an empty table gives none. Documents are told apart as rows: repeated rows are packed as often as
    they occur, and ties in length go by a seeded hash, then id, then start. A null id is kept as null. Groups have group_rows rows on average. A table needs no text if tokens are
    given; further columns are ignored.
    """
    tokens = word_count() if tokens is None else tokens
    text = F.col("text") if "text" in [c.lower() for c in docs.columns] else F.lit(None)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), tokens.cast("bigint").alias("n")).where("n > 0")
    counted = stored(docs.sparkSession, rows.groupBy("doc_id", "tie", "n").agg(F.count("*").alias("times")))
    groups = max(1, -(-(counted.agg(F.sum("times")).first()[0] or 0) // group_rows))
    each = counted.select("doc_id", "tie", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("copy"))
    slim = each.select("doc_id", "n", F.xxhash64(F.lit(seed), "doc_id", "tie", "copy").alias("k"))
    slim = slim.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed + 1), "k"), F.lit(groups)))

    def packed(table: pa.Table) -> pa.Table:
        n, k, ids = (table.column(c).to_numpy(zero_copy_only=False) for c in ("n", "k", "doc_id"))
        known = np.zeros(len(n), dtype=bool) if table.column("doc_id").null_count == len(n) else table.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        ids = np.where(known, ids, 0).astype(np.int64)
        pieces = -(-n // capacity)
        owner = np.repeat(np.arange(len(n)), pieces)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        size = np.minimum(n[owner] - start, capacity)
        order = np.lexsort((start, ids[owner], k[owner], -size))
        owner, start, size = owner[order], start[order], size[order]
        bins = np.array(first_fit(size.tolist(), capacity), dtype=np.int64)
        by_bin = np.argsort(bins, kind="stable")
        owner, start, size, bins = owner[by_bin], start[by_bin], size[by_bin], bins[by_bin]
        first = np.searchsorted(bins, bins)
        group = table.column("pack_group")[0].as_py()
        return pa.table({
            "pack_group": pa.array(np.full(len(bins), group, dtype=np.int64)), "bin": pa.array(bins), "slot": pa.array(np.arange(len(bins)) - first),
            "doc_id": pa.array(ids[owner], mask=~known[owner]), "start": pa.array(start.astype(np.int64)), "n_tokens": pa.array(size.astype(np.int64)),
        })

    return slim.groupBy("pack_group").applyInArrow(packed, SCHEMA)
