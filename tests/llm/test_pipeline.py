"""The corpus pipeline against brute force, and on tables with all that may go wrong."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import sentencepiece
from cases import nasty, none, table
from helpers import DATA
from test_models import brute_quality
from test_sets import brute_groups, brute_spans, folded

import corpus_pipeline
from tidegrid.llm import jaccard, pieces, quality, suffixes, toxicity

SMALL = str(DATA / "sf0.001")


def test_run_is_like_its_stages_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, toxicity.kinds(labels), toxicity.KINDS)
    rows = sorted(tuple(r) for r in docs.collect())
    clean = [r for r in rows if toxicity.probabilities(chain, pa.array([r[1]]))[-1][0] < 0.5]
    assert 0 < len(clean) < len(rows)
    left = spark.createDataFrame(clean, docs.schema)
    judged = brute_quality(quality.scored(left, quality.fit(left, labels), "doc_id", "source", "lang").collect())
    good = [r for r in clean if judged[r[0]][2] >= 0.5]
    assert 0 < len(good) < len(clean)
    single = {class_id for _, class_id, _ in brute_groups([(r[0], r[1]) for r in good], 3, 0.6)}
    one = [(r[0], r[1]) for r in good if r[0] in single]
    assert 0 < len(one) < len(good)
    cuts = defaultdict(set)
    for k, start, n, first in brute_spans(one, suffixes.DEPTH):
        if not first:
            cuts[k] |= set(range(start, start + n))
    stages = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, SMALL)
    texts = {r.doc_id: r.text for r in stages.collect()}
    assert stages.columns == docs.columns and set(texts) == {k for k, _ in one}
    for k, text in one:
        assert folded(texts[k]) == [w for i, w in enumerate(folded(text)) if i not in cuts[k]]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    tokens = defaultdict(int)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        tokens[r.doc_id] += r.n_tokens
    assert tokens == {k: len(library.encode(t)) for k, t in texts.items() if t}


def test_run_on_nasty_and_on_empty_tables(spark, tmp_path):
    labels = "doc_id bigint, quality int, toxic int"
    for name, docs, rows in (("nasty", nasty(spark), [(1, 1, 0), (6, 1, 0), (None, None, None)]), ("empty", none(spark), [])):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(rows, labels).write.parquet(str(tmp_path / name / "labels.parquet"))
        path = str(tmp_path / name)
        kept = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, path)
            assert kept.columns == docs.columns
        got = corpus_pipeline.run(spark, path).collect()
        assert {r.doc_id for r in got} == {r.doc_id for r in kept.collect() if r.text} and (name == "empty") == (not got)


def test_near_duplicate_stage_lists_no_square(spark, monkeypatch):
    """Of many near copies one stays, and what the index leaves follows the texts, not their pairs."""
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join([*words[:k % 110], f"new{k}", *words[k % 110 + 1:]]) for k in range(400)]
    left, index = [], jaccard.candidates

    def counted(*args):
        left.append(found := index(*args))
        return found

    monkeypatch.setattr(jaccard, "candidates", counted)
    kept = corpus_pipeline.near_duplicate_stage(spark, table(spark, [*texts, "a text like no other one", ""]), SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 400, 401]
    assert len(left) == 1 and left[0].count() < 400 * 20


def test_near_duplicate_stage_cuts_and_moves_no_more_than_it_needs(spark, monkeypatch):
    """Texts are cut into words twice, and again only where they may have a near copy; no pair of the index moves as often as lists have it."""
    cut, moved = [], defaultdict(list)
    words = jaccard.folded_words

    def counted(texts):
        cut.append(len(texts))
        return words(texts)

    def here(df, run, schema):
        batches = list(run(iter(df.toArrow().to_batches())))
        moved[schema] += [tuple(r.values()) for b in batches for r in b.to_pylist()]
        return spark.createDataFrame(moved[schema] if len(batches) else [], schema)

    monkeypatch.setattr(jaccard, "folded_words", counted)
    monkeypatch.setattr(jaccard, "in_arrow", here)
    copies = [" ".join([*(f"w{k}" for k in range(120)), f"new{k}"]) for k in range(20)]
    alone = [" ".join(f"x{k}y{i}" for i in range(30)) for k in range(300)]
    kept = corpus_pipeline.near_duplicate_stage(spark, table(spark, [*copies, *alone]), SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(20, 320)]
    assert sum(cut) == 2 * 320 + 20
    pairs = moved["a bigint, b bigint, size bigint"]
    assert len(pairs) == len(set(pairs)) == 190


def test_places_are_found_in_a_few_steps_in_a_table_of_any_size():
    r = np.random.default_rng(5)
    for n in (0, 1, 50, 1 << 20):
        for kind in (np.uint32, np.uint64):
            keys = np.unique(r.integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True))
            asked = np.concatenate([keys, r.integers(0, np.iinfo(kind).max, 1000, dtype=kind), np.array([0, np.iinfo(kind).max], dtype=kind)])
            places = jaccard.Places(keys)
            found, at = places.of(asked)
            assert sorted(found.tolist()) == np.flatnonzero(np.isin(asked, keys)).tolist() and (keys[at] == asked[found]).all()
            assert np.diff(places.first).max() <= 16


def test_marked_rows_are_the_same_sent_or_met(spark):
    rows = [sorted(map(str, jaccard.one_of_each(nasty(spark), marks=marks).collect())) for marks in (0, 1 << 19)]
    assert rows[0] == rows[1] and 0 < len(rows[0]) < nasty(spark).count()
