"""N-gram Jaccard join and repeated windows against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from cases import LONG, SCHEMA, nasty, none, prose, table
from pyspark.sql import functions as F

from tidegrid.llm import jaccard, suffixes
from tidegrid.llm.columnar import _FOLD


def folded(text: str | None) -> list[str]:
    text = "".join(c.lower() if ord(c) < 256 and c != "ß" and ord(c) != 0xB5 else c for c in text or "")
    return [w for w in re.split("[" + re.escape("".join(chr(c) for c in range(128) if _FOLD[c] == 32)) + "]+", text) if w]


def grams(text: str | None, n: int) -> frozenset:
    w = folded(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute_pairs(docs: list[tuple[int, str | None]], n: int, t: float) -> dict[tuple[int, int], float]:
    classes: dict[frozenset, int] = {}
    out = {}
    sets = [(k, grams(x, n)) for k, x in sorted(docs, key=lambda d: d[0])]
    for k, s in sets:
        if not s:
            continue
        if s in classes:
            if classes[s] != k:
                out[classes[s], k] = 1.0
        else:
            classes[s] = k
    standing = sorted((k, s) for s, k in classes.items())
    for i, (a, x) in enumerate(standing):
        for b, y in standing[i + 1 :]:
            both = len(x & y)
            if both and both / (len(x) + len(y) - both) >= t - 1e-12 and a != b:
                out[a, b] = both / (len(x) + len(y) - both)
    return out


def near_copies(seed: int) -> list[str]:
    r = random.Random(seed)
    texts = prose(25, 60, seed)
    for text in texts[:15]:
        for _ in range(r.randint(0, 4)):
            w = text.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(["new", "other", "more"])
            texts.append(" ".join(w) if r.random() < 0.7 else text.upper() + "!")
    return [*texts, *prose(30, 12, seed + 1, vocabulary=6), "", "Ä ö", "ä Ö!"]


@pytest.mark.parametrize(("seed", "limit", "t"), [(1, 2_000_000, 0.6), (2, 0, 0.6), (3, 2_000_000, 0.9), (4, 5, 0.3)])
def test_join_is_like_brute_force(spark, seed, limit, t):
    texts = near_copies(seed)
    found = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.jaccard_join(table(spark, texts), 3, t, limit).collect()}
    assert found == pytest.approx(brute_pairs(list(enumerate(texts)), 3, t))


def brute_groups(docs: list[tuple[int, str | None]], n: int, t: float) -> set[tuple[int, int, int]]:
    """doc_id, class_id, links of distinct rows."""
    docs = sorted(set(docs), key=lambda d: (d[0], d[1] or ""))
    sets = [grams(x, n) for _, x in docs]
    like = lambda x, y: bool(x & y) and len(x & y) / len(x | y) >= t - 1e-12
    near = [[j for j, y in enumerate(sets) if j != i and like(x, y)] for i, x in enumerate(sets)]
    root = list(range(len(docs)))
    for _ in docs:
        for i, js in enumerate(near):
            root[i] = min([root[i], *(root[j] for j in js)])
    least = {r: min(docs[i][0] for i in range(len(docs)) if root[i] == r) for r in set(root)}
    return {(k, least[root[i]], len(near[i])) for i, (k, _) in enumerate(docs)}


@pytest.mark.parametrize(("seed", "limit", "t", "block"), [(1, 2_000_000, 0.6, 512), (2, 0, 0.6, 2), (4, 5, 0.3, 3)])
def test_groups_are_like_brute_force(spark, seed, limit, t, block):
    texts = near_copies(seed)
    found = jaccard.groups(table(spark, texts), 3, t, limit, block).collect()
    assert len(found) == len(texts) and {tuple(r) for r in found} == brute_groups(list(enumerate(texts)), 3, t)


@pytest.mark.parametrize(("seed", "limit", "t", "block"), [(1, 2_000_000, 0.6, 512), (2, 0, 0.6, 2), (4, 5, 0.3, 3), (3, 2_000_000, 0.9, 4)])
def test_crowds_are_like_brute_force(spark, seed, limit, t, block):
    """Lists of more than 2 classes make crowds: counts, classes and pairs stay the same."""
    texts = near_copies(seed)
    found = jaccard.groups(table(spark, texts), 3, t, limit, block, 2).collect()
    assert len(found) == len(texts) and {tuple(r) for r in found} == brute_groups(list(enumerate(texts)), 3, t)
    joined = jaccard.jaccard_join(table(spark, texts), 3, t, limit, 2).collect()
    assert len(joined) == len(set(joined)) and {(r.doc_a, r.doc_b): r.jaccard for r in joined} == pytest.approx(brute_pairs(list(enumerate(texts)), 3, t))


def test_hot_lists_list_no_pairs(spark):
    """What the index leaves of a large group of near copies follows the texts, not their square."""
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join([*words[:k % 110], f"new{k}", *words[k % 110 + 1:]]) for k in range(600)]
    docs = jaccard.keyed(table(spark, texts))
    members, order = jaccard.classed(docs, 3, 2_000_000)
    assert jaccard.candidates(docs, 3, 0.6, 8, order).count() < 600 * 20
    assert {(r.class_id, r.links) for r in jaccard.groups(table(spark, texts)).collect()} == {(0, 599)}


def test_sketches_keep_similar_pairs(spark):
    """No pair is lost by its sketches, and of unlike ones nearly none stays to have its sets moved."""
    r = random.Random(5)
    texts = [" ".join(r.choices([f"w{k}" for k in range(400)], k=n)) for n in (1, 2, 5, 30, 80, 200, 900) for _ in range(4)]
    texts += [" ".join(x.split()[:-2] + ["new"]) for x in texts]
    docs = jaccard.keyed(table(spark, texts))
    members = jaccard.classed(docs, 3, 2_000_000)[0].collect()
    cls, sets = {m.doc_id: m.cls for m in members}, [grams(x, 3) for x in texts]
    pairs = {(cls[i], cls[j]): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i) if cls[i] != cls[j]}
    kept = {tuple(x) for x in jaccard.not_ruled_out(spark.createDataFrame(list(pairs), "a bigint, b bigint"), docs, 3, 0.6).collect()}
    like = {p for p, x in pairs.items() if x >= 0.6}
    assert len(like) > 10 and like <= kept and len(kept - like) < len(pairs) / 50


def test_a_crowd_moves_each_set_seldom(spark):
    crowded = spark.range(600).selectExpr("id AS cls", "100 AS size", "0L AS crowd")
    assert jaccard.met_in_crowds(crowded, 0.6, 100).count() <= 600 * 2
    # Long sets lie in smaller blocks.
    assert jaccard.met_in_crowds(crowded.withColumn("size", F.lit(1 << 17)), 0.6, 100).where("side = 0").groupBy("place").count().count() > 20


@pytest.mark.parametrize("limit", [0, 80])
def test_more_moves_than_are_broadcast(spark, limit):
    """Sets that go to more places than are sent to the scan, with their documents known to it or not."""
    texts = near_copies(6)
    assert {tuple(r) for r in jaccard.groups(table(spark, texts), 3, 0.6, limit, 1, 2).collect()} == brute_groups(list(enumerate(texts)), 3, 0.6)


def test_groups_of_nasty_rows(spark):
    docs = nasty(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    found = jaccard.groups(docs).collect()
    assert {tuple(r) for r in found} == brute_groups(rows, 3, 0.6) and len(found) == len(set(rows))
    assert jaccard.groups(none(spark)).count() == 0


def test_many_near_copies_make_few_rows(spark, monkeypatch):
    """Rows that leave a task follow the texts, not their pairs, however a large group is dealt into blocks."""
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join([*words[:k % 110], f"new{k}", *words[k % 110 + 1:]]) for k in range(300)]
    docs = jaccard.keyed(table(spark, texts))
    members, order = jaccard.classed(docs, 3, 0)
    found = jaccard.similar_classes(docs, members, order, counted=True, block=100)
    n = found.count()
    assert n <= 300 * 3
    assert {(r.class_id, r.links) for r in jaccard.groups(table(spark, texts)).collect()} == {(0, 299)}
    assert [r.doc_id for r in jaccard.one_of_each(table(spark, texts)).collect()] == [0]


def test_join_of_nasty_rows(spark):
    docs = nasty(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    found = jaccard.jaccard_join(docs).collect()
    assert {(r.doc_a, r.doc_b) for r in found} == {(1, 2), (6, 7)} == set(brute_pairs(rows, 3, 0.6))
    assert jaccard.jaccard_join(none(spark)).count() == 0


def test_one_of_each_keeps_the_least(spark):
    docs = nasty(spark)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted([1, 3, 4, -1, 5, 6, 8, 8, 9, -1])
    rows = [(None, "a text that has no id", "en", "s", 1), (None, "a text that has no id", "en", "s", 2), (None, "A text that has no id!", "en", "s", 3), (2, "two texts of one id", "en", "s", 4), (2, "and this is the other", "en", "s", 5), (1, "two texts of one id", "en", "s", 6)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text.lower().strip("!")) for r in kept) == [(0, "a text that has no id"), (1, "two texts of one id"), (2, "and this is the other")]
    assert jaccard.one_of_each(none(spark)).count() == 0


def test_components_follow_long_chains(spark):
    n = 60
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])] + [(100, 101)], "doc_a bigint, doc_b bigint")
    found = {r.doc_id: r.root for r in jaccard.components(edges).collect()}
    assert found == {**dict.fromkeys(range(n), 0), 100: 100, 101: 100}


def brute_spans(docs: list[tuple[int | None, str | None]], depth: int) -> set[tuple]:
    places = defaultdict(list)
    for k, x in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        w = folded(x)
        for i in range(len(w) - depth + 1):
            places[tuple(w[i : i + depth])].append((k, i))
    marked = defaultdict(list)
    for found in places.values():
        for at, (k, i) in enumerate(found):
            if len(found) > 1:
                marked[k, at == 0].append(i)
    out = set()
    for (k, first), at in marked.items():
        at.sort()
        start = last = at[0]
        for i in [*at[1:], None]:
            if i is not None and i <= last + depth:
                last = i
                continue
            out.add((k, start, last + depth - start, first))
            start = last = i
    return out


@pytest.mark.parametrize(("depth", "limit"), [(12, 4_000_000), (12, 0), (9, 3)])
def test_spans_are_like_brute_force(spark, depth, limit):
    r = random.Random(depth)
    shared = prose(6, 40, 9)
    texts = [f"{a} {r.choice(shared)} {b}, {r.choice(shared)}" for a, b in zip(prose(40, 30, 1), prose(40, 30, 2))] + ["", "short one"]
    texts[7] = texts[8] = texts[9]
    found = {(x.doc_id, x.start, x.n_words, x.first) for x in suffixes.spans(table(spark, texts), depth, limit=limit).collect()}
    assert found == brute_spans(list(enumerate(texts)), depth)


def test_spans_of_nasty_rows(spark):
    docs = nasty(spark)
    found = {(x.doc_id, x.start, x.n_words, x.first) for x in suffixes.repeats(docs).collect()}
    assert found == brute_spans([(r.doc_id, r.text) for r in docs.collect()], suffixes.DEPTH)
    assert suffixes.repeats(none(spark)).count() == 0


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_cut_texts_have_no_window_twice(spark, limit):
    shared = prose(3, 60, 4)
    texts = [f"{a}\n{s} {b}." for a, b, s in zip(prose(12, 20, 5), prose(12, 20, 6), shared * 4)]
    cut = suffixes.without_repeats(table(spark, texts), 10, limit)
    kept = {r.doc_id: r.text for r in cut.collect()}
    again = brute_spans(list(enumerate(texts)), 10)
    for k, text in enumerate(texts):
        gone = {i for d, start, n, first in again if d == k and not first for i in range(start, start + n)}
        assert folded(kept[k]) == [w for i, w in enumerate(folded(text)) if i not in gone]
    assert all(r.n_chars == len(r.text) for r in cut.collect())


def test_cutting_nasty_rows(spark):
    docs = nasty(spark)
    cut = suffixes.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert len(texts[6]) < len(LONG) and len(texts[7]) < 400 and texts[3] is None and texts[4] == ""
    assert suffixes.without_repeats(none(spark)).count() == 0
