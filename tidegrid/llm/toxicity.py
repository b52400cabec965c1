"""Classifier chains over toxicity categories.

Each category has a linear model over lexical features; the model of a later category also gets the probabilities of all
earlier ones. In training those are out-of-fold predictions, so that a later model doesn't learn to trust its
predecessors more than their answers on new documents deserve.

Features say how often, as log(1 + count), a document has a word, or a word that begins with given 4, 5 or 6 bytes (lower case; white space and
ASCII punctuation separate words). Those that tell the last category's classes apart best, by the z-score of a difference of
shares, are kept. They are chosen anew for the training rows of each fold, so that a held-out row has no part in its own prediction; copies of a text are in one fold.

The labels table has one column on toxicity and one on quality. kinds() makes two categories of them, toxic prose and toxic junk, which are predicted first, the latter from the
former too, and then toxicity as such. Pass categories to chain over label columns of one's own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.columnar import distinct_pairs, mix, owners, slices, span_hashes, utf8, words
from tidegrid.llm.shared import Sent, column_at, fit_logistic, in_arrow, sigmoid, stored

#: Hash table of the features: 2**20 places.
PLACES = 1 << 20
PREFIXES = (4, 5, 6)
#: The labelled rows that a fit looks at, at most; taken by a seeded hash of doc_id.
SAMPLE_ROWS = 8_000
#: The size of a model, in features, at most.
FEATURES = 4_096
#: The categories that kinds() makes, in the order of the chain.
KINDS = ("toxic_prose", "toxic_junk", "toxic")
MIN_Z = 5.0
FOLDS = 5
PUNCTUATION = np.zeros(256, dtype=np.uint8) + np.arange(256, dtype=np.uint8)
PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = 32


@dataclass
class Chain:
    """place: the column of each feature place, -1 where it has none; weights: per category, features then earlier categories then bias."""

    names: list[str]
    place: np.ndarray
    weights: list[np.ndarray]
    width: int


def feature_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The feature places of all words in the texts and the text of each, repeats included."""
    data, offsets = utf8(pc.utf8_lower(texts))
    data = PUNCTUATION[data]
    starts, ends, bounds = words(data, offsets)
    owner = owners(bounds)
    mask = np.uint64(PLACES - 1)
    places, of = [(span_hashes(data, starts, ends) & mask).astype(np.int32)], [owner]
    for size in PREFIXES:
        long = ends - starts >= size
        at = starts[long]
        places.append((mix(span_hashes(data, at, at + size) + np.uint64(size)) & mask).astype(np.int32))
        of.append(owner[long])
    return np.concatenate(places), np.concatenate(of)


def document_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, feature place) pairs, sorted by text."""
    places, owner = feature_places(texts)
    order = np.argsort(owner, kind="stable")
    return distinct_pairs(owner[order], places[order])


def probabilities(chain: Chain, texts: pa.Array) -> np.ndarray:
    """A row for each category in chain order."""
    places, owner = feature_places(texts)
    cols = chain.place[places]
    hit = cols >= 0
    cols, owner = cols[hit], owner[hit]
    return predict(chain, *times_of(owner, cols), len(texts))


def times_of(owner: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, column) pairs, sorted by both, and how often each occurs."""
    pairs, times = np.unique(owner.astype(np.int64) << 32 | cols.astype(np.int64), return_counts=True)
    return pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.int32), times


def predict(chain: Chain, owner: np.ndarray, cols: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(chain.weights), n))
    for k, w in enumerate(chain.weights):
        z = np.bincount(owner, weights=np.log1p(times) * w[cols], minlength=n) + w[-1]
        for j in range(k):
            z += w[chain.width + j] * out[j]
        out[k] = sigmoid(z)
    return out


def sample_of(docs: DataFrame, labels: DataFrame, wanted: Sequence[str], id_col: str = "doc_id", rows: int = SAMPLE_ROWS, seed: int = 5) -> DataFrame:
    """At most rows labelled documents, stored: _id, the wanted label columns, _text, and _first, false for copies of a text with a lesser id.

    Unlabelled or repeated ids in labels are left out; of documents with one id, the one whose text has the least hash counts.
    """
    chosen = labels.select(F.col("doc_id").alias("_id"), *wanted).dropna().dropDuplicates(["_id"]).orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text"))
    one = texts.join(F.broadcast(chosen), "_id").groupBy("_id", *wanted).agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    copies = Window.partitionBy(F.xxhash64("_text")).orderBy("_id")
    return stored(docs.sparkSession, one.withColumn("_first", F.row_number().over(copies) == 1))


def local(sample: pa.Table, column: str = "_text") -> pa.Array:
    texts = sample.column(column).combine_chunks() if sample.num_rows else pa.array([], sample.schema.field(column).type)
    return texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts


def kinds(labels: DataFrame) -> DataFrame:
    """labels (doc_id, toxic, quality) with the categories KINDS; a missing quality counts as good, a missing toxic leaves the row out of a fit."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False))
    toxic = F.col("toxic") > 0
    return labels.select("doc_id", (toxic & ~bad).cast("int").alias(KINDS[0]), (toxic & bad).cast("int").alias(KINDS[1]), toxic.cast("int").alias(KINDS[2]))


def cells_of(texts: pa.Array, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (feature place, cell) pairs and how many texts each has; cell is a number for each text."""
    found, base = [np.zeros(0, dtype=np.int64)], 0
    for piece in slices([pa.record_batch([texts], names=["_text"])], "_text"):
        owner, places = document_features(piece.column(0))
        found.append(places.astype(np.int64) * cells + cell[owner + base])
        base += piece.num_rows
    codes, times = np.unique(np.concatenate(found), return_counts=True)
    return codes // cells, codes % cells, times


def chosen(places: np.ndarray, z: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The column of each feature place (-1: none), and which columns each selection has; z has a column for each selection, the last of which gets the first columns."""
    picks = []
    for one in z.T:
        best = np.lexsort((places, -np.abs(one)))[:FEATURES]
        picks.append(best[np.abs(one[best]) >= least])
    order = np.concatenate([picks[-1], np.setdiff1d(np.concatenate(picks), picks[-1])])
    column = np.full(len(places), -1)
    column[order] = np.arange(len(order))
    has = np.zeros((len(picks), len(order)), dtype=bool)
    for k, pick in enumerate(picks):
        has[k, column[pick]] = True
    place = np.full(PLACES, -1, dtype=np.int32)
    place[places[order]] = np.arange(len(order))
    return place, has


def columns_of(texts: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (text, column) pairs of features that were chosen, and how often each occurs."""
    found, base = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))], 0
    for piece in slices([pa.record_batch([texts], names=["_text"])], "_text"):
        places, owner = feature_places(piece.column(0))
        cols = place[places]
        owner, cols, times = times_of(owner[cols >= 0], cols[cols >= 0])
        found.append((owner + base, cols, times))
        base += piece.num_rows
    owner, cols, times = (np.concatenate(x) for x in zip(*found))
    return owner, cols, times


def chained(y: dict[str, np.ndarray], fold: np.ndarray, place: np.ndarray, has: np.ndarray, owner: np.ndarray, cols: np.ndarray, times: np.ndarray) -> Chain:
    """The chain of the label columns y, in their order; has says which feature columns the training rows of each fold chose, and, last, which all rows did."""
    names, n = list(y), len(fold)
    width, final = has.shape[1], int(has[-1].sum())
    out_of_fold = np.zeros((len(names), n))
    chain = Chain(names, np.where(place < final, place, -1).astype(np.int32), [], final)
    for k, name in enumerate(names):
        rows = np.concatenate([owner, *[np.arange(n)] * k])
        all_cols = np.concatenate([cols, *[np.full(n, width + j) for j in range(k)]]).astype(np.int64)
        values = np.concatenate([np.log1p(times), *out_of_fold[:k]])
        for f in range(FOLDS if n else 0):
            used = np.append(has[f], np.ones(k, dtype=bool))[all_cols]
            inside, held = used & (fold[rows] != f), used & (fold[rows] == f)
            kept = np.flatnonzero(fold != f)
            renumber = np.zeros(n, dtype=np.int64)
            renumber[kept] = np.arange(len(kept))
            w = fit_logistic(renumber[rows[inside]], all_cols[inside], values[inside], y[name][kept], width + k)
            z_out = np.bincount(rows[held], weights=values[held] * w[all_cols[held]], minlength=n) + w[-1]
            out_of_fold[k][fold == f] = sigmoid(z_out[fold == f])
        used = (all_cols < final) | (all_cols >= width)
        last = np.where(all_cols >= width, all_cols - width + final, all_cols)
        chain.weights.append(fit_logistic(rows[used], last[used], values[used], y[name], final + k))
        if not n:
            chain.weights[-1][-1] = -40.0
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("toxic",), id_col: str = "doc_id", rows: int = SAMPLE_ROWS, places_z: float = MIN_Z) -> Chain:
    """A chain over label columns of 0 and 1, fitted to at most rows labelled documents (the documented bound; scoring covers all documents).

    Executors read the sample's texts; to the driver come its labels, the features that some selection chose (at most FEATURES for each) and which document has which. Rows that lack a label are left out;
    no labels, or no documents with some, give a chain that calls nothing toxic.
    """
    sample = sample_of(docs, labels, categories, id_col, rows).withColumn("_fold", F.pmod(F.xxhash64("_text"), F.lit(FOLDS)).cast("int"))
    main = categories[-1]
    slim = sample.select("_id", "_first", "_fold", *categories).toArrow().sort_by("_id")
    ids, first, fold = local(slim, "_id").to_numpy(), local(slim, "_first").to_numpy(zero_copy_only=False).astype(bool), local(slim, "_fold").to_numpy().astype(np.int64)
    y = {c: (local(slim, c).to_numpy(zero_copy_only=False).astype(float) > 0).astype(float) for c in categories}
    toxic = y[main] > 0
    n = np.array([[(first & (fold == f) & (toxic == yes)).sum() for yes in (True, False)] for f in range(FOLDS)]).reshape(FOLDS, 2)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places, cells, times = cells_of(batch.column(0), batch.column(1).to_numpy().astype(np.int64), 2 * FOLDS)
                yield pa.record_batch([pa.array(places), pa.array(cells), pa.array(times)], names=["place", "cell", "times"])

    cells = sample.where("_first").select("_text", (F.col("_fold") * 2 + F.when(F.col(main) > 0, 0).otherwise(1)).cast("bigint").alias("cell"))
    counts = in_arrow(cells, counted, "place bigint, cell bigint, times bigint").groupBy("place")
    counts = counts.agg(*[F.sum(F.when(F.col("cell") == k, F.col("times")).otherwise(0)).cast("double").alias(f"c{k}") for k in range(2 * FOLDS)])
    scores = []
    for f in range(FOLDS + 1):  # the training rows of each fold, then all rows
        inside = [g for g in range(FOLDS) if g != f]
        (c1, n1), (c0, n0) = ((sum((F.col(f"c{2 * g + k}") for g in inside), F.lit(0.0)), max(1, int(n[inside, k].sum()))) for k in (0, 1))
        pooled = (c1 + c0) / (n1 + n0)
        z = (c1 / n1 - c0 / n0) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n1 + 1 / n0))
        scores.append(F.when(c1 + c0 >= 3, z).otherwise(0.0).alias(f"z{f}"))
    scored = counts.select("place", *scores).where(F.greatest(*[F.abs(f"z{f}") for f in range(FOLDS + 1)]) >= places_z).toArrow()
    z = np.column_stack([scored.column(f"z{f}").to_numpy() for f in range(FOLDS + 1)]) if scored.num_rows else np.zeros((0, FOLDS + 1))
    place, has = chosen(scored.column("place").to_numpy(), z, places_z)
    shared = Sent(docs.sparkSession, place)

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, cols, times = columns_of(batch.column(1), shared.value)
            yield pa.record_batch([batch.column(0).take(pa.array(owner)), pa.array(cols), pa.array(times)], names=["_id", "col", "times"])

    pairs = in_arrow(sample.select(F.col("_id").cast("bigint").alias("_id"), "_text"), featured, "_id bigint, col int, times bigint").toArrow()
    owner = np.searchsorted(ids, local(pairs, "_id").to_numpy()) if pairs.num_rows else np.zeros(0, dtype=np.int64)
    cols = local(pairs, "col").to_numpy() if pairs.num_rows else np.zeros(0, dtype=np.int32)
    times = local(pairs, "times").to_numpy() if pairs.num_rows else np.zeros(0, dtype=np.int64)
    order = np.lexsort((cols, owner))
    return chained(y, fold, place, has, owner[order], cols[order], times[order])


def toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """For each document doc_id, the probability of each category (p_ and its name), and toxic: the last one reaches threshold.

    A null or empty text has no features and gets the probabilities of the biases. Without labels, or with one class of label, all
    documents get the base rate (0 without labels). Texts are read whole. Each row is scored by itself: repeated rows get equal results, an
    empty table none; further columns are ignored.
    """
    schema = "doc_id bigint, " + ", ".join(f"`p_{c}` double" for c in chain.names) + ", toxic boolean"
    shared = Sent(docs.sparkSession, chain)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            p = probabilities(shared.value, piece.column(1))
            yield pa.record_batch([piece.column(0), *[pa.array(x) for x in p], pa.array(p[-1] >= threshold)], names=["doc_id", *[f"p_{c}" for c in shared.value.names], "toxic"])

    return in_arrow(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("text")), score, schema)


def keep_clean(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that the chain doesn't call toxic.

    Null and empty texts have no features and stay unless the base rate alone reaches threshold; whole texts are scored, each row by itself; an empty table gives no rows; columns may have any name,
    and text may be written in any case.
    """
    shared = Sent(docs.sparkSession, chain)
    at = column_at(docs, "text")

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices((pa.RecordBatch.from_arrays([b.column(at), *b.columns], names=["_text", *[f"c{i}" for i in range(b.num_columns)]]) for b in batches), "_text"):
            p = probabilities(shared.value, piece.column(0))
            kept = pa.RecordBatch.from_arrays(piece.columns[1:], names=names)
            yield kept.filter(pa.array(p[-1] < threshold))

    names = docs.columns
    return in_arrow(docs, clean, docs.schema)
