"""Pieces, phrases, WARC, packing, sharding and pictures: against brute force, other libraries or exact round trips."""

from __future__ import annotations

import gzip
import random
import struct
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from cases import LONG, SCHEMA, nasty, none, prose, table

from tidegrid.llm import media, packing, phrases, pictures, pieces, sharding, warc
from tidegrid.llm.columnar import mix, utf8

HARD = ["", " ", "  two  blanks ", "tab\tand\nline", "Grüße, 日本語のテキスト \U0001f600!", "▁ mark ▁▁", "aaaaaaaaaaaaaaaaaaaa", "x" * 300, "don't stop-believing 12345", "\u0000\u0007", LONG]


def test_ids_are_those_of_the_library(spark):
    texts = HARD + prose(200, 40)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    found = {r.doc_id: r for r in pieces.encode(table(spark, texts), pieces.MODEL, decoded=True).collect()}
    for k, text in enumerate(texts):
        assert found[k].ids == library.encode(text)
        assert found[k].decoded == text.replace("▁", " ") if text else not found[k].ids


def test_pieces_of_nasty_rows(spark):
    docs = nasty(spark)
    coded = pieces.encode(docs, pieces.MODEL)
    assert coded.count() == docs.count() and pieces.encode(none(spark), pieces.MODEL).count() == 0
    back = pieces.decode(coded, pieces.MODEL)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back.collect()))) == sorted(repr((r.doc_id, (r.text or "").replace("▁", " "))) for r in docs.collect())


def lz78(raw: bytes) -> set[bytes]:
    """Phrases, each the shortest new piece, or what there is before an anchor."""
    known, out, phrase = set(), set(), b""
    for k in range(len(raw)):
        if k and phrase and raw[k - 1] in b" \t\n" and raw[k] not in b" \t\n" and not int(mix(np.array([int.from_bytes(raw[max(0, k - 8) : k][::-1], "little")], dtype=np.uint64))[0]) & 1:
            out.add(phrase)
            phrase = b""
        phrase += raw[k : k + 1]
        if phrase not in known:
            known.add(phrase)
            phrase = b""
    return known | out


def test_phrases_are_those_of_lz78():
    texts = [*prose(20, 80), "aaaaaaaaa", "日本語日本語", "", " lead", "two  blanks\n\nlines"]
    data, offsets = utf8(pa.array(texts))
    cuts = phrases.anchors(data, offsets)
    for text, a, b in zip(texts, offsets, offsets[1:]):
        raw = text.encode()
        ends = phrases.phrase_ends(raw, (cuts[(cuts > a) & (cuts < b)] - a).tolist())
        assert {raw[a:b] for a, b in zip([0, *ends], ends)} == lz78(raw)


def classes(rows) -> set[tuple[int, int]]:
    """Pairs of ids in one class."""
    by = defaultdict(list)
    for r in rows:
        by[r.class_id].append(r.doc_id)
    return {(a, b) for ids in by.values() for a in ids for b in ids if a < b}


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_similar_documents_are_found(spark, limit):
    base = prose(30, 300, 8)
    texts = base + [t + " some more" for t in base] + [t.replace("a", "b", 1) for t in base] + base[:3] + ["", None]
    signs, count = phrases.signatures(pa.array(texts))
    like = lambda a, b: count[a] and count[b] and (signs[a] == signs[b]).mean() >= phrases.THRESHOLD
    near = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if like(a, b)}
    root = list(range(len(texts)))
    for _ in range(20):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    rows = phrases.similar(table(spark, texts), limit=limit).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    found = classes(rows)
    wanted = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if root[a] == root[b]}
    assert found <= wanted and {(k, 90 + k) for k in range(3)} <= found and len(found & wanted) >= 0.9 * len(wanted)
    links = {r.doc_id: r.links for r in rows}
    assert all(links[k] <= sum(k in p for p in near) for k in links) and all((links[k] > 0) == any(k in p for p in found) for k in links)


def test_costs_count_every_signature(spark):
    """More rows than a sample or one chunk of a task has; each value at each place counts."""
    n = 40_000
    found = (np.random.default_rng(4).random((n, phrases.WIDTH)) ** 6 * 65536).astype(np.uint16)
    found[-1] = 65535
    blobs = [pa.array([x.tobytes() for x in (part & 255 if low else part >> 8).astype(np.uint8)]) for low, part in ((True, found), (False, found))]
    rows = spark.createDataFrame(pa.table(blobs, names=["signature", "upper"])).coalesce(2)
    known = phrases.counted(rows, n)
    for place in range(phrases.WIDTH):
        values, times = np.unique(found[:, place], return_counts=True)
        bits = np.minimum(np.rint(16 * np.log2(n / times)), 255)
        assert (known[place][values] == bits).all() and known[place].any()
    assert phrases.counted(rows.limit(0), 0).shape == (phrases.WIDTH, 65536)


def test_phrases_of_nasty_rows(spark):
    docs = nasty(spark)
    rows = phrases.similar(docs).collect()
    assert {(1, 2), (6, 7)} <= classes(rows)
    assert len(rows) == docs.where("doc_id IS NOT NULL").select("doc_id", "text").distinct().count()
    assert phrases.similar(none(spark)).count() == 0


def test_many_near_copies_make_few_pairs(spark):
    words = [w for t in prose(60, 40, 23, 4000) for w in t.split()]
    texts = [" ".join([*words[: k % 600], f"new{k}", *words[k % 600 + 1 : 600]]) for k in range(800)]
    prints = phrases.fingerprints(table(spark, texts))
    assert phrases.candidates(prints).count() <= 800 * phrases.KEYS / phrases.MET
    assert {r.class_id for r in phrases.similar(table(spark, texts)).collect()} == {0}


@pytest.mark.parametrize("chunk", [97, 1 << 20])
def test_warc_round_trip(spark, tmp_path, chunk):
    inner = "WARC/1.1\r\nContent-Length: 5\r\n\r\nfalse\r\n\r\n"
    rows = [(k, f"http://h/{k}", "x" * k * 7 + inner * (k % 3)) for k in range(40)] + [(100, None, None), (None, "http://n/", ""), (7, "http://h/7", "again")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = warc.pages_round_trip(spark, pages, str(tmp_path / "w"), chunk)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((i, u, h or "")) for i, u, h in rows)


def test_damaged_warc(spark, tmp_path):
    record = lambda body: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "a.warc").write_bytes(record(b"one") + record(b"two") + b"rubbish" + record(b"three"))
    (folder / "b.warc").write_bytes(b"no record" + record(b"four"))
    (folder / "c.warc").write_bytes(record(b"five")[:-6])
    (folder / "e.warc").write_bytes(b"")
    broken = len(record(b"one") + record(b"two"))
    for chunk in (50, 1 << 20):
        found = sorted((Path(r.file).name, r.at, r.body and bytes(r.body), r.whole) for r in warc.read(spark, str(folder), chunk).collect())
        assert found == [("a.warc", 0, b"one", True), ("a.warc", len(record(b"one")), b"two", True), ("a.warc", broken, None, False), ("b.warc", 0, None, False), ("c.warc", 0, b"fi", False)]


@pytest.mark.parametrize("chunk", [1000, 1 << 20])
def test_long_headers_and_compressed_records(spark, tmp_path, chunk):
    """Headers of 200 KiB don't end a file, and gzip members are records as well as plain ones."""
    record = lambda k, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://h/{'x' * 200_000 if k % 7 == 3 else k}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    bodies = [np.random.default_rng(k).bytes(k * 30) + b"WARC/1.0\r\nno header" * (k % 3) for k in range(30)]
    folder = tmp_path / "z"
    folder.mkdir()
    (folder / "plain.warc").write_bytes(b"".join(record(k, x) for k, x in enumerate(bodies)))
    (folder / "packed.warc.gz").write_bytes(b"".join(gzip.compress(record(k, x)) for k, x in enumerate(bodies)))
    found = warc.read(spark, str(folder), chunk).collect()
    for name in ("plain.warc", "packed.warc.gz"):
        mine = sorted((r for r in found if r.file.endswith(name)), key=lambda r: r.at)
        assert [bytes(r.body) for r in mine] == bodies and all(r.whole for r in mine)


def test_first_fit_is_like_brute_force():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 333):
        sizes = sorted(r.integers(1, 100, n).tolist(), reverse=True)
        room, expected = [], []
        for s in sizes:
            k = next((k for k, free in enumerate(room) if free >= s), len(room))
            if k == len(room):
                room.append(100)
            room[k] -= s
            expected.append(k)
        assert packing.first_fit(sizes, 100) == expected


def test_packing_covers_all_words(spark):
    docs = nasty(spark)
    rows = packing.pack(docs, capacity=1000, group_rows=3).collect()
    covered, bins = defaultdict(int), defaultdict(int)
    for r in rows:
        covered[r.doc_id] += r.n_tokens
        bins[r.pack_group, r.bin] += r.n_tokens
    expected = defaultdict(int)
    for r in docs.collect():
        if (r.text or "").split():
            expected[r.doc_id] += len(r.text.split())
    assert covered == expected and max(bins.values()) <= 1000
    assert packing.pack(none(spark)).count() == 0


def test_groups_are_even_whatever_ids_are_null_or_repeat(spark):
    rows = [(None if k % 2 else k % 5, f"a text {k if k % 3 else 'again'}", "en", "s", 9) for k in range(1200)]
    count = defaultdict(int)
    for r in packing.pack(spark.createDataFrame(rows, SCHEMA), group_rows=100).collect():
        count[r.pack_group] += 1
    assert len(count) == 12 and sum(count.values()) == 1200 and max(count.values()) <= 160


def test_shards_have_the_mixture(spark):
    docs = table(spark, prose(300, 5)).selectExpr("doc_id", "text", "lang", "CASE WHEN doc_id % 10 = 0 THEN 'rare' WHEN doc_id % 3 = 0 THEN NULL ELSE 'hot' END AS source", "n_chars")
    rows = sharding.shards(docs, rows_per_shard=50).collect()
    assert sorted(r.doc_id for r in rows) == list(range(300))
    count = defaultdict(lambda: defaultdict(int))
    for r in rows:
        count[r.source][r.shard] += 1
    for per in count.values():
        assert max(per.values()) - min(per.values()) <= 1 and len(per) == 6


def test_shards_of_nasty_rows(spark):
    docs = nasty(spark)
    out = sharding.shards(docs)
    assert {"shard_input", "position_input", "shard", "position"} <= set(out.columns) and out.count() == docs.count()
    assert sharding.shards(none(spark)).count() == 0


def test_thumbnails_are_block_means():
    texts = [t * 9 for t in prose(40, 60)] + ["q", LONG[:40_000]]
    raw = pictures.jpegs(pa.array(texts), np.zeros(len(texts), dtype=np.int64))
    parsed, thumbs, status = media.thumbnails(raw)
    assert set(status) == {"ok"}
    for text, picture, thumb in zip(texts, parsed, thumbs):
        data = text.encode()
        assert thumb.shape == (picture.height // 8, picture.width // 8)
        for k, value in enumerate(thumb.ravel()):
            block = data[64 * k : 64 * k + 64].ljust(64, b" ") if 64 * k < len(data) else None
            if block:
                assert abs(int(value) - np.mean(list(block))) <= 2.01
    colour, colour_thumbs, status = media.thumbnails(pictures.jpegs(pa.array(texts), np.ones(len(texts), dtype=np.int64)))
    assert set(status) == {"ok"} and all(p.components == 3 for p in colour)
    for text, picture, thumb in zip(texts, colour, colour_thumbs):
        data, across = text.encode(), picture.width // 16
        assert thumb.shape == (picture.height // 8, picture.width // 8)
        for k in range(-(-len(data) // 64)):  # four blocks to a square of sixteen pixels
            square, part = divmod(k, 4)
            value = thumb[square // across * 2 + part // 2, square % across * 2 + part % 2]
            assert abs(int(value) - np.mean(list(data[64 * k : 64 * k + 64].ljust(64, b" ")))) <= 2.01


def test_a_picture_written_by_hand():
    """16 x 8 pixels, grey: two blocks, of DC 20 and 20 - 31 steps of 8, by a code of one DC size and one of no AC value."""
    raw = bytes.fromhex("ffd8 ffdb0043 00" + "08" * 64 + "ffc0000b 08 0008 0010 01 011100" + "ffc40014 00 01" + "00" * 15 + "05" + "ffc40014 10 01" + "00" * 15 + "00" + "ffda0008 01 0100 003f00")
    bits = "0" + "10100" + "0" + "0" + "00000" + "0"
    raw += int(bits.ljust(16, "1"), 2).to_bytes(2, "big") + b"\xff\xd9"
    parsed, thumbs, status = media.thumbnails([raw])
    assert status == ["ok"] and (parsed[0].width, parsed[0].height, parsed[0].components) == (16, 8, 1)
    assert thumbs[0].tolist() == [[128 + 20, 128 + 20 - 31]]


def test_hashes_of_thumbnails():
    r = np.random.default_rng(2)
    for tall, wide in ((1, 1), (3, 20), (40, 33)):
        thumb = r.integers(0, 256, (tall, wide)).astype(np.uint8)
        bits = ""
        cut = lambda k, n, parts: range(k * n // parts, max(k * n // parts + 1, (k + 1) * n // parts))
        for y in range(8):
            means = [np.mean([[thumb[i, j] for j in cut(x, wide, 9)] for i in cut(y, tall, 8)]) for x in range(9)]
            bits += "".join("1" if a < b else "0" for a, b in zip(means, means[1:]))
        assert media.difference_hash(thumb) % 2**64 == int(bits, 2)
    texts = ["some text " * 40, "some text " * 40, "other words " * 40]
    columns = media.described(pictures.jpegs(pa.array(texts), np.zeros(3, dtype=np.int64)))
    a, b, c = columns[5].to_pylist()
    assert a == b != c


def unigram_model(path: Path, pieces_: list[tuple[str, float]]) -> None:
    """A model file of the unigram type, written field by field."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    part = lambda field, body: varint(field << 3 | 2) + varint(len(body)) + body
    one = lambda piece, score, kind: part(1, part(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(kind))
    raw = one("<unk>", 0.0, 2) + one("<s>", 0.0, 3) + one("</s>", 0.0, 3) + b"".join(one(p, s, 1) for p, s in pieces_)
    path.write_bytes(raw + part(2, b"\x18\x01") + part(3, part(1, b"identity") + b"\x18\x01\x20\x00\x28\x01"))


def test_unigram_models_take_the_best_segmentation(spark, tmp_path):
    r = random.Random(6)
    known = {"".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(60)} | set("abcd") | {"▁", "▁a", "▁ab", "▁abc"}
    scores = {p: -r.uniform(1, 12) for p in sorted(known)}
    unigram_model(tmp_path / "u.model", list(scores.items()))
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    texts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 40))) for _ in range(200)] + ["abxcd", "xx yy", ""]
    rows = {x.doc_id: x.ids for x in pieces.encode(table(spark, texts), str(tmp_path / "u.model")).collect()}
    cost = lambda ids: sum(library.get_score(i) for i in ids)
    for k, text in enumerate(texts):
        assert rows[k] == library.encode(text) or "x" not in text and cost(rows[k]) == pytest.approx(cost(library.encode(text)))
        marked = "▁" + text.replace(" ", "▁")
        if text and "x" not in text and "y" not in text:  # brute force: the best score of all segmentations
            best = [0.0]
            for e in range(1, len(marked) + 1):
                best.append(max(best[s] + scores[marked[s:e]] for s in range(max(0, e - 6), e) if marked[s:e] in scores))
            assert cost(rows[k]) == pytest.approx(best[-1], abs=1e-3)


def test_media_of_bad_pictures(spark):
    good = pictures.jpegs(pa.array(["some text " * 30]), np.array([1]))[0]
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[: len(good) // 2]), (6, good.replace(b"\xff\xc0", b"\xff\xc2", 1)), (None, good)]
    table_ = spark.createDataFrame(rows, "id bigint, picture binary")
    got = media.media(table_, "id").collect()
    assert sorted((r.id or 0, r.status) for r in got) == [(0, "ok"), (1, "ok"), (1, "ok"), (2, "null"), (3, "damaged"), (4, "damaged"), (5, "damaged"), (6, "unsupported")]
    assert media.media(table_.limit(0), "id").count() == 0


def test_edited_copies_are_similar(spark):
    """Labelled by how they are made, not by the signatures: every twentieth word of a copy is another one."""
    r = random.Random(5)
    words = [w for t in prose(200, 40, 22, 4000) for w in t.split()]
    base = [" ".join(r.choice(words) for _ in range(300)) for _ in range(40)]
    edited = [" ".join(r.choice(words) if k % 20 == 10 else w for k, w in enumerate(t.split())) for t in base]
    found = classes(phrases.similar(table(spark, base + edited)).collect())
    made = {(k, k + len(base)) for k in range(len(base))}
    assert len(found & made) >= 0.9 * len(made) and len(found - made) <= 0.1 * len(made)
