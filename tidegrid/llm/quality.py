"""Hierarchical empirical Bayes for document quality.

A linear classifier over the shape of a text gives each document evidence p. Sites (hosts) and their paths pool the evidence of
their documents by grouped sums: a host's share of good documents has a beta posterior whose prior is the corpus, a
path's one whose prior is its host. The priors' strengths, in documents, come from the spread of the shares beyond sampling noise
(method of moments), so sparse sites stay near the global share. A document's final log odds are its own plus a
share of what its path's posterior says beyond the corpus, its own evidence taken out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.columnar import distinct_pairs, owners, slices, span_hashes, utf8, words
from tidegrid.llm.shared import Sent, fit_logistic, in_arrow, sigmoid, stored, without
from tidegrid.llm.toxicity import sample_of

#: The labelled rows that the classifier's fit looks at, at most; taken by a seeded hash of doc_id.
SAMPLE_ROWS = 8_000
#: How much of the site's log odds counts for a document.
SITE_WEIGHT = 0.5

_UPPER, _DIGIT, _SYMBOL, _BANG, _BAR = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[[ord(c) for c in "#$%&*@^~<>{}[]\\_=+"]] = True
_BANG[[ord(c) for c in "!?"]] = True
_BAR[ord("|")] = True
_LINE = np.zeros(256, dtype=bool)
_LINE[10] = True
FEATURES = 14


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def shape(texts: pa.Array) -> np.ndarray:
    """FEATURES numbers for each text."""
    data, offsets = utf8(texts)
    n = len(texts)
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, bounds = words(data, offsets)
    owner = owners(bounds)
    h = span_hashes(data, starts, ends)
    count = np.diff(bounds)
    some = np.maximum(count, 1)
    kinds = np.bincount(distinct_pairs(owner, h)[0], minlength=n)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    length = ends - starts
    # Lines: white space but line feeds made solid, so that the same splitting gives lines.
    lined = np.where((data == 32) | (data == 9), np.uint8(1), data)
    l_starts, l_ends, l_bounds = words(lined, offsets)
    l_owner = owners(l_bounds)
    l_count = np.maximum(np.diff(l_bounds), 1)
    l_kinds = np.bincount(distinct_pairs(l_owner, span_hashes(lined, l_starts, l_ends))[0], minlength=n)
    root = lambda x: np.sqrt(np.maximum(x, 0))
    return np.column_stack([
        root(_per_text(_UPPER[data], offsets) / size), root(_per_text(_DIGIT[data], offsets) / size), root(_per_text(_SYMBOL[data], offsets) / some),
        root(_per_text(_BANG[data], offsets) / some), root(_per_text(_BAR[data], offsets) / some), root(_per_text(_LINE[data], offsets) / some),
        root(_per_text(data >= 128, offsets) / size), root(np.bincount(owner, weights=same, minlength=n) / some), kinds / some, np.log1p(some) * (1 - kinds / some),
        root(1 - l_kinds / l_count), np.bincount(owner, weights=length, minlength=n) / some / 10, np.log1p(count), (count == 0).astype(float),
    ])


def evidence(model: Classifier, texts: pa.Array) -> np.ndarray:
    """Log odds that each text is good."""
    x = (shape(texts) - model.mean) / model.scale
    return np.clip(np.clip(x, -5, 5) @ model.weights[:-1] + model.weights[-1], -20, 20)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> Classifier:
    """The document classifier, fitted to at most rows labelled documents (the documented bound); executors look at their texts."""

    def shaped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text"):
            yield pa.record_batch([piece.column(0), piece.column(1), *[pa.array(c) for c in shape(piece.column(2)).T]], names=names)

    names = ["_id", "quality", *[f"x{k}" for k in range(FEATURES)]]
    sample = sample_of(docs, labels, ["quality"], id_col, rows).select(F.col("_id").cast("bigint").alias("_id"), F.col("quality").cast("double").alias("quality"), "_text")
    table = in_arrow(sample, shaped, "_id bigint, quality double, " + ", ".join(f"x{k} double" for k in range(FEATURES))).toArrow().sort_by("_id")
    return train(np.column_stack([table.column(c).to_numpy() for c in names[2:]]), table.column("quality").to_numpy() > 0)


def train(x: np.ndarray, good: np.ndarray) -> Classifier:
    """The classifier of rows of shape() and whether each is good."""
    n = len(good)
    if not n:
        return Classifier(np.zeros(FEATURES), np.ones(FEATURES), np.append(np.zeros(FEATURES), 20.0))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -5, 5)
    w = fit_logistic(np.repeat(np.arange(n), FEATURES), np.tile(np.arange(FEATURES), n), z.ravel(), good.astype(float), FEATURES, steps=400)
    return Classifier(mean, scale, w)


def scored(docs: DataFrame, model: Classifier, id_col: str, host: str, path: str) -> DataFrame:
    """doc_id, host, path and log odds of each document by its text alone."""
    shared = Sent(docs.sparkSession, model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            yield pa.record_batch([*piece.columns[:3], pa.array(evidence(shared.value, piece.column(3)))], names=["doc_id", "host", "path", "z"])

    site = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")).alias(a) for c, a in ((host, "host"), (path, "path"))]
    return in_arrow(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *site, F.col("text")), score, "doc_id bigint, host string, path string, z double")


def site_posteriors(scores: DataFrame) -> DataFrame:
    """For each host and path the number of documents, the sum of their evidence, and the prior (share and strength) it is shrunk to.

    One row per path; paths are grouped first, hosts from the paths' sums, the corpus from the hosts' sums.
    """
    p = 1 / (1 + F.exp(-F.col("z")))
    paths = scores.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    world = hosts.agg(F.sum("hn").alias("wn"), F.sum("hs").alias("ws"), F.count("*").alias("k"))
    spread = lambda n, s, mu: F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - mu, 2))
    mu = F.col("ws") / F.col("wn")
    # Strength m with var(share) = mu (1 - mu) / (m + 1) + noise: within 1 and 1e6 documents.
    host_level = hosts.crossJoin(F.broadcast(world)).groupBy("wn", "ws", "k").agg(spread("hn", "hs", mu).alias("q"), F.sum(F.col("hn") * F.col("hn")).alias("sq"))
    strength = lambda: F.least(F.lit(1e6), F.greatest(F.lit(1.0), mu * (1 - mu) / F.greatest((F.col("q") - (F.col("k") - 1) * mu * (1 - mu)) / F.greatest(F.col("wn") - F.col("sq") / F.col("wn"), F.lit(1.0)), F.lit(1e-9)) - 1))
    host_level = host_level.select("wn", "ws", strength().alias("host_strength"))
    with_host = paths.join(hosts, "host").crossJoin(F.broadcast(host_level))
    inner = with_host.groupBy("wn", "ws", "host_strength").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2)).alias("q"), F.countDistinct("host").alias("h"), F.count("*").alias("paths"), F.sum(F.col("n") * F.col("n") / F.col("hn")).alias("sq"))
    path_level = inner.select(F.least(F.lit(1e6), F.greatest(F.lit(1.0), mu * (1 - mu) / F.greatest((F.col("q") - (F.col("paths") - F.col("h")) * mu * (1 - mu)) / F.greatest(F.col("wn") - F.col("sq"), F.lit(1.0)), F.lit(1e-9)) - 1)).alias("path_strength"))
    return with_host.crossJoin(F.broadcast(path_level)).select("host", "path", "n", "s", "hn", "hs", mu.alias("mu"), "host_strength", "path_strength")


def combined(scores: DataFrame, sites: DataFrame, threshold: float) -> DataFrame:
    """scores with p_document, p_host, p_path, quality and keep."""
    own = 1 / (1 + F.exp(-F.col("z")))
    others = lambda s, n: (F.col(s) - own, F.col(n) - 1)
    hs, hn = others("hs", "hn")
    s, n = others("s", "n")
    p_host = (hs + F.col("mu") * F.col("host_strength")) / (hn + F.col("host_strength"))
    out = scores.join(sites, ["host", "path"]).withColumn("p_document", own).withColumn("p_host", p_host)
    out = out.withColumn("p_path", (s + F.col("p_host") * F.col("path_strength")) / (n + F.col("path_strength")))
    bounded = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda c: F.log(bounded(c) / (1 - bounded(c)))
    z = F.col("z") + F.lit(SITE_WEIGHT) * (odds(F.col("p_path")) - odds(F.col("mu")))
    return out.withColumn("quality", 1 / (1 + F.exp(-z))).withColumn("keep", F.col("quality") >= threshold)


def sites_of(scores: DataFrame) -> DataFrame:
    """The posteriors, stored. Spark sees the size of what is stored, and broadcasts it if its own bound allows, else joins by a shuffle whose hot sites it splits."""
    return stored(scores.sparkSession, site_posteriors(scores))


def sites_of_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with the columns host and path to judge sites of URLs by: the host in lower case, and the first step of the path; null where there is no host.

    Columns of these names come back as host_input and path_input.
    """
    pages = without(pages, ["host", "path"])
    parts = F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    step = F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(/[^/?#]*)", 1)
    host = F.when(parts != "", F.lower(parts))
    return pages.withColumns({"host": host, "path": F.when(host.isNotNull(), F.when(step == "", "/").otherwise(step))})


def quality(docs: DataFrame, model: Classifier, threshold: float = 0.5, id_col: str = "doc_id", host: str = "source", path: str = "lang") -> DataFrame:
    """For each document doc_id, p_document, p_host, p_path, quality and keep.

    host and path: the columns that name a document's site and its part of it; null is a site of its own. A null or empty
    text is judged as a text of no words. Without labels, or with one class, the classifier can't tell and everything is kept or has the
    base rate. Repeated rows count and are scored each; an empty table gives no rows; further columns are ignored.
    """
    scores = stored(docs.sparkSession, scored(docs, model, id_col, host, path))
    return combined(scores, sites_of(scores), threshold).select("doc_id", "p_document", "p_host", "p_path", "quality", "keep")


def keep_good(docs: DataFrame, model: Classifier, threshold: float = 0.5, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs, all columns as they are, whose quality() reaches threshold.

    Each text is scored once, and the rows are stored with their scores until the sites' posteriors are known. Null and empty texts, null hosts and paths, repeated rows and missing labels
    are judged as quality() says; an empty table gives no rows; columns may have any name.
    """
    names = docs.columns
    shared = Sent(docs.sparkSession, model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(evidence(shared.value, piece.column(piece.num_columns - 1)))], names=out_names)

    site = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")).alias(a) for c, a in ((host, "host"), (path, "path"))]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *site, F.col("text"))
    out_names = ["row", "host", "path", "z"]
    schema = rows.select("row", "host", "path", F.lit(0.0).alias("z")).schema
    scores = stored(docs.sparkSession, in_arrow(rows, score, schema))
    marked = combined(scores, sites_of(scores.select("host", "path", "z")), threshold).where("keep")
    return marked.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
