"""SentencePiece encoding and decoding by a forward pass over a trie of distinct words.

A text is cut where no piece of the vocabulary reaches across: between two bytes that stand side by side in no piece. That cuts
before each run of marked blanks, so the parts are marked words. Cutting changes no result. The distinct words, sorted,
are a trie in depth-first order: from one word to the next, forward states up to their common prefix are kept and only the rest is
computed. Results are put together again for all words of all texts by array operations.

The forward state at a character depends on the model's type. Unigram models: Viterbi, the best score of a segmentation of the
prefix and its last piece. BPE models: their scores are merge ranks, whose sums mean nothing, and Viterbi would not give the
library's ids. There the state is the last piece of the prefix's own encoding. It is the one piece t ending there for which merging (state before t, t) by
rank leaves both as they are: the greedy encoding of a text, cut at any of its pieces, is the encodings of both parts.
Both give the ids of the sentencepiece library; among segmentations of exactly equal score, unigram models take the one whose last pieces are longest, where the
library's choice follows the rounding of its sums.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.columnar import offsets_of, ragged, slices, span_hashes, utf8
from tidegrid.llm.shared import Sent, in_arrow

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose ids a task keeps; beyond, it starts anew.
KNOWN_WORDS = 300_000
#: The vocabulary file that is taken unless another one is named, in a call or in the environment.
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@dataclass
class Model:
    kind: int
    pieces: list[str]
    scores: list[float]
    types: list[int]
    unknown: int
    dummy_prefix: bool
    byte_ids: list[int] = field(default_factory=list)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            at += size
            yield tag >> 3, raw[at - size : at]
        else:
            size = {1: 8, 5: 4}[tag & 7]
            at += size
            yield tag >> 3, raw[at - size : at]


def load(path: str) -> Model:
    """A model file. Only models that leave texts as they are (identity normaliser, blanks kept and marked) are taken."""
    with open(path, "rb") as f:
        raw = f.read()
    model = Model(UNIGRAM, [], [], [], 0, True)
    blanks_removed = True
    charsmap = b""
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append(piece)
            model.scores.append(score)
            model.types.append(kind)
        elif number == 2:
            model.kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            charsmap, model.dummy_prefix, blanks_removed = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if charsmap or blanks_removed or USER_DEFINED in model.types or model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with an identity normaliser, without user-defined pieces, are supported")
    model.unknown = model.types.index(UNKNOWN)
    model.byte_ids = [model.pieces.index(f"<0x{b:02X}>") for b in range(256)] if BYTE in model.types else []
    return model


class Encoder:
    """The forward pass. encode() wants sorted words; a blank stands for the mark."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.ids = {p.replace(MARK, " "): i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t in (NORMAL, UNUSED)}
        self.root: dict = {}
        for piece, i in self.ids.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.text = {i: p for p, i in self.ids.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.unknown_score = min((s for s, t in zip(model.scores, model.types) if t == NORMAL), default=0.0) - 10

    def merged(self, text: str) -> list[str]:
        """Greedy merging by rank, the leftmost of equals first."""
        parts = list(text)
        ids, scores = self.ids, self.model.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fitting(self, before: int, piece: int) -> bool:
        """Whether merging before and piece (before < 0: nothing, or an unknown character) leaves them as they are."""
        right = self.text[piece]
        if before < 0:
            return len(right) == 1 or self.merged(right) == [right]
        left = self.text[before]
        return self.merged(left + right) == [left, right]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; characters without a piece become bytes, or the unknown piece once for each run of them."""
        ranked = self.model.kind == BPE
        scores, root, fits = self.model.scores, self.root, self.fits
        # By number of characters: last piece (-1: unknown character), where it begins, score, and the trie nodes of pieces under way.
        last, begin, score, open_ = [-2], [0], [0.0], [[]]
        previous, out = "", []
        for word in words:
            n = min(len(word), len(previous))
            common = 0
            while common < n and word[common] == previous[common]:
                common += 1
            previous = word
            del last[common + 1 :], begin[common + 1 :], score[common + 1 :], open_[common + 1 :]
            for k in range(common, len(word)):
                c = word[k]
                under_way, found, start, best = [], -1, k, None
                for s, node in open_[k]:
                    node = node.get(c)
                    if node is not None:
                        under_way.append((s, node))
                node = root.get(c)
                if node is not None:
                    under_way.append((k, node))
                for s, node in under_way:
                    piece = node.get("")
                    if piece is None:
                        continue
                    if ranked:
                        pair = (last[s], piece)
                        fit = fits.get(pair)
                        if fit is None:
                            fit = fits[pair] = self.fitting(*pair)
                        if fit:
                            found, start = piece, s
                            break
                    else:
                        total = score[s] + scores[piece]
                        if best is None or total > best:
                            found, start, best = piece, s, total
                if not ranked and (node is None or "" not in node):
                    total = score[k] + self.unknown_score
                    if best is None or total > best:
                        found, start, best = -1, k, total
                last.append(found)
                begin.append(start)
                score.append(best or 0.0)
                open_.append(under_way)
            ids: list[int] = []
            k = len(word)
            while k:
                piece, start = last[k], begin[k]
                if piece >= 0:
                    ids.append(piece)
                elif self.model.byte_ids:
                    ids.extend(self.model.byte_ids[b] for b in reversed(word[start:k].encode()))
                elif not ids or ids[-1] != self.model.unknown:
                    ids.append(self.model.unknown)
                k = start
            ids.reverse()
            out.append(ids)
        if len(fits) > 300_000:
            fits.clear()
        return out


class Batches:
    """Encoding and decoding of whole Arrow arrays."""

    def __init__(self, model: Model) -> None:
        self.model, self.encoder = model, Encoder(model)
        self.forget()
        self.side_by_side = np.zeros((256, 256), dtype=bool)
        for piece in self.encoder.ids:
            raw = np.frombuffer(piece.encode(), dtype=np.uint8)
            self.side_by_side[raw[:-1], raw[1:]] = True
        spelled = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode() for p, t in zip(model.pieces, model.types)]
        self.lengths = np.array([len(s) for s in spelled])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.at, self.n, self.flat, self.used = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32), 0

    def learn(self, keys: np.ndarray, spelled: list[str]) -> None:
        order = sorted(range(len(spelled)), key=spelled.__getitem__)
        found = self.encoder.encode([spelled[k] for k in order])
        sizes = np.array([len(x) for x in found])
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.known) + len(found) > len(self.at):
            self.at, self.n = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.n, np.zeros_like(self.n)])
        self.flat[self.used : self.used + total] = [i for x in found for i in x]
        first = len(self.known)
        self.at[first : first + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.n[first : first + len(found)] = sizes
        self.used += total
        self.known.update(zip(keys[order].tolist(), range(first, first + len(found))))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; a null or empty text has none."""
        texts = pc.replace_substring(texts.fill_null(""), MARK, " ")
        if self.model.dummy_prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
        data, offsets = utf8(texts)
        if not len(data):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, dtype=np.int32)), pa.array([], pa.int32()))
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = ~self.side_by_side[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        edges = offsets[1:-1]
        cut[edges[edges < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys, index, word = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > KNOWN_WORDS:
            self.forget()
        places = [self.known.get(k, -1) for k in keys.tolist()]
        new = [k for k, p in enumerate(places) if p < 0]
        if new:
            raw = data.tobytes()
            first = index[new]
            self.learn(keys[new], [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            for k in new:
                places[k] = self.known[int(keys[k])]
        places = np.array(places)[word]
        sizes = self.n[places]
        ids = self.flat[ragged(self.at[places], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
        if not self.model.byte_ids and len(ids):  # unknown characters side by side are one piece, in several words too
            again = np.append(False, (ids[1:] == self.model.unknown) & (ids[:-1] == self.model.unknown))
            again[bounds[:-1][bounds[:-1] < len(ids)]] = False
            bounds = np.concatenate([[0], np.cumsum(~again)])[bounds]
            ids = ids[~again]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids, null for null; bytes that aren't UTF-8 become replacement characters."""
        valid = ids.is_valid()
        bounds = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) if len(ids) else np.zeros(1, dtype=np.int64)
        flat = ids.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.int64)
        bounds = bounds - bounds[0]
        sizes = self.lengths[flat]
        data = self.spelled[ragged(self.starts[flat], sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        starts, ends = offsets[:-1].copy(), offsets[1:]
        if self.model.dummy_prefix:
            some = ends > starts
            lead = np.zeros(len(starts), dtype=bool)
            lead[some] = data[starts[some]] == 32
            starts[lead] += 1
        where = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        raw = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data[ragged(starts, ends - starts)]))])
        try:
            out = raw.cast(pa.string())
        except pa.ArrowInvalid:
            out = pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.string())
        return pc.if_else(valid, out, pa.scalar(None, pa.string()))


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", decoded: bool = False) -> DataFrame:
    """For each document doc_id and ids (and, if wanted, decoded: the text that the ids give back).

    Ids are those of the sentencepiece library without begin and end marks. A null or empty text has an empty list; whole texts are encoded;
    repeated rows each have a row, an empty table none; further columns are ignored. A mark (U+2581) in a text is a blank to the model.
    """
    model = load(model_path)
    shared = Sent(docs.sparkSession, model)
    schema = "doc_id bigint, ids array<int>" + ", decoded string" * decoded

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Batches(shared.value)
        for piece in slices(batches, "text"):
            ids = coder.encode(piece.column(1))
            columns = [piece.column(0), ids] + [coder.decode(ids)] * decoded
            yield pa.record_batch(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return in_arrow(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("text")), run, schema)


def counted(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id") -> DataFrame:
    """doc_id and n_pieces, the number of ids that encode() gives, of each row; 0 for a null or empty text. Null ids are kept; an empty table gives no rows; further columns are ignored."""
    shared = Sent(docs.sparkSession, load(model_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Batches(shared.value)
        for piece in slices(batches, "text"):
            yield pa.record_batch([piece.column(0), coder.encode(piece.column(1)).value_lengths().cast(pa.int64())], names=["doc_id", "n_pieces"])

    return in_arrow(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("text")), run, "doc_id bigint, n_pieces bigint")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text for each row of doc_id and ids; null ids give null, an empty list an empty text."""
    shared = Sent(encoded.sparkSession, load(model_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Batches(shared.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), coder.decode(batch.column(1))], names=["doc_id", "text"])

    return in_arrow(encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id bigint, text string")
