"""Blocks of postings and the exact best chunks of many questions over them.

A block holds whole chunks, in the order of their ids, and its own terms. A
question meets every block; what cannot be among its best k any more is dropped
at once, so neither scores nor postings are moved between tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paperloom.functions.text import STOP_WORDS, TOKEN, stem_word

#: Chunks of a block (its scores fit a core's cache).
BLOCK = 8192
#: Share of a block's chunks from which a term is kept as one number a chunk.
DENSE = 1 / 16
#: Bits of a number that holds which terms of a question occur.
BITS = 62
#: Half a unit of the sixth digit and a bit: scores are compared as rounded.
SLACK = 1e-6

BLOCKS = "ids array<string>, tables array<boolean>, owner binary, lengths binary, terms array<string>, df array<int>, docs binary, tfs binary, rows bigint, words bigint"


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one partition's ``chunk_id, is_table, text`` (lower case, no commas); all rows of a chunk are in the partition.

    A document of the counts is a chunk and a length: versions of a chunk with one length are counted together.
    """
    find, stops, stems = re.compile(TOKEN).findall, frozenset(STOP_WORDS), {}
    chunks: dict[str | None, dict[int, list]] = {}
    tabular = set()
    for batch in batches:
        for key, table, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = [w for w in find(text) if w not in stops]
            doc = chunks.setdefault(key, {}).setdefault(len(words), [0, Counter()])
            doc[0] += 1
            for w, n in Counter(words).items():
                if (t := stems.get(w)) is None:
                    t = stems[w] = stem_word(w)
                doc[1][t] += n
            if table:
                tabular.add(key)
    keys = sorted(chunks, key=lambda k: (k is None, k or ""))
    for at in range(0, len(keys), BLOCK):
        yield _block(keys[at : at + BLOCK], chunks, tabular)


def _block(keys: list, chunks: dict, tabular: set) -> pa.RecordBatch:
    owner, lengths, number, tf, doc_of = [], [], [], [], []
    known: dict[str, int] = {}
    rows = words = 0
    for i, key in enumerate(keys):
        for length, (copies, counted) in chunks[key].items():
            rows, words = rows + copies, words + copies * length
            number += [known.setdefault(t, len(known)) for t in counted]
            tf += counted.values()
            doc_of += [len(owner)] * len(counted)
            owner.append(i)
            lengths.append(length)
    number = np.array(number, np.int32)
    order = np.argsort(number, kind="stable")
    part = lambda x, kind: pa.array([np.asarray(x).astype(kind).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([keys], pa.list_(pa.string())), pa.array([[k in tabular for k in keys]], pa.list_(pa.bool_())), part(owner, np.int32), part(lengths, np.int32),
            pa.array([list(known)], pa.list_(pa.string())), pa.array([np.bincount(number, minlength=len(known)).astype(np.int32)], pa.list_(pa.int32())),
            part(np.array(doc_of, np.int32)[order], np.int32), part(np.array(tf, np.int32)[order], np.int32), pa.array([rows], pa.int64()), pa.array([words], pa.int64()),
        ],
        [f.split()[0] for f in BLOCKS.split(", ")],
    )


class _Weights:
    """A block's weights without the inverse frequency, by number in a batch's vocabulary: places and values, or one value a chunk."""

    def __init__(self, row: dict, vocabulary: pa.Array, mean: float, k1: float, b: float):
        self.n, self.dense, self.sparse = len(row["ids"]), {}, {}
        at = pc.index_in(vocabulary, value_set=row["terms"].values).fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(row["df"].values.to_numpy())
        owner, lengths, docs, tfs = (np.frombuffer(row[c].as_py(), np.int32) for c in ("owner", "lengths", "docs", "tfs"))
        norm = k1 * (1 - b + b * lengths / mean)
        for v in np.flatnonzero(at >= 0).tolist():
            a, e = (ends[at[v] - 1] if at[v] else 0), ends[at[v]]
            d, tf = docs[a:e], tfs[a:e].astype(float)
            place, value = owner[d], tf * (k1 + 1) / (tf + norm[d])
            if len(owner) > self.n or len(d) > DENSE * self.n:
                whole = np.bincount(place, value, self.n)
                if len(d) > DENSE * self.n:
                    self.dense[v] = whole
                    continue
                place = np.flatnonzero(whole)
                value = whole[place]
            self.sparse[v] = place, value

    def holds(self, v: int, places: np.ndarray) -> np.ndarray:
        if v in self.dense:
            return self.dense[v][places] > 0
        if v not in self.sparse:
            return np.zeros(len(places), bool)
        known = self.sparse[v][0]
        return known[np.minimum(np.searchsorted(known, places), len(known) - 1)] == places


class _Batch:
    """Questions that are asked together and the best that they have found so far."""

    def __init__(self, asked: pa.Scalar, k: int, held: bool):
        rows = asked.as_py()
        self.k, self.keys = k, [r["lead"] for r in rows]
        number: dict[str, int] = {}
        self.questions = [[(number.setdefault(w["term"], len(number)), w["idf"]) for w in r["weights"]] for r in rows]
        self.vocabulary = pa.array(list(number), pa.string())
        self.terms = list(number)
        self.least = np.zeros(len(rows))
        self.wide = 1 + max(map(len, self.questions)) // BITS if held else 0
        self.found = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty((0, self.wide), np.int64))
        self.fresh: list[tuple] = []
        self.pending = 0

    def meet(self, w: _Weights, first: int, allowed: np.ndarray | None) -> None:
        """Adds the best of a block whose first chunk has the number ``first``."""
        # Questions with the same frequent terms follow each other and share their sum.
        common = [tuple(x for x in q if x[0] in w.dense) for q in self.questions]
        scores, base, part, last = np.empty(w.n), np.empty(w.n), np.empty(w.n), None
        for q in sorted(range(len(common)), key=common.__getitem__):
            if common[q] != last:
                last = common[q]
                base[:] = 0
                for v, idf in last:
                    np.multiply(w.dense[v], idf, out=part)
                    np.add(base, part, out=base)
            np.copyto(scores, base)
            for v, idf in self.questions[q]:
                if v in w.sparse:
                    place, value = w.sparse[v]
                    scores[place] += idf * value
            if allowed is not None:
                np.multiply(scores, allowed, out=scores)
            self._keep(q, w, scores, first)
        if self.pending > 2 * len(self.found[0]):
            self.merge()

    def _keep(self, q: int, w: _Weights, scores: np.ndarray, first: int) -> None:
        if self.least[q] > 0:
            places = np.flatnonzero(scores >= self.least[q] - SLACK)
            if not len(places):
                return
            rounded = np.round(scores[places], 6)
        else:
            most = scores.max()
            if most <= 0:
                return
            for share in (0.8, 0.6, 0.4, 0.2, 0):
                places = np.flatnonzero(scores > share * most)
                rounded = np.round(scores[places], 6)
                # Enough, if what was left out can't be among the best, rounded as it is.
                if len(places) >= self.k and np.partition(rounded, -self.k)[-self.k] > share * most + SLACK:
                    break
        if len(places) > self.k:
            order = np.argsort(-rounded, kind="stable")[: self.k]
            places, rounded = places[order], rounded[order]
        if not (rounded > 0).all():
            places, rounded = places[rounded > 0], rounded[rounded > 0]
        if len(places) >= self.k:
            self.least[q] = max(self.least[q], rounded.min())
        masks = np.zeros((len(places), self.wide), np.int64)
        if self.wide:
            for i, (v, _) in enumerate(self.questions[q]):
                masks[:, i // BITS] |= w.holds(v, places).astype(np.int64) << (i % BITS)
        self.fresh.append((np.full(len(places), q), rounded, places + first, masks))
        self.pending += len(places)

    def merge(self) -> None:
        """Leaves the best k of each question and what ties with the last of them."""
        q, score, place, masks = (np.concatenate(x) for x in zip(self.found, *self.fresh, strict=True))
        order = np.lexsort((-score, q))
        q, score = q[order], score[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
        counts = np.diff(np.r_[starts, len(q)])
        full = counts >= self.k
        floor = np.where(full, score[np.minimum(starts + self.k, len(q)) - 1], 0.0) if len(q) else np.empty(0)
        self.least[q[starts[full]]] = np.maximum(self.least[q[starts[full]]], floor[full])
        kept = score >= np.repeat(floor, counts)
        self.found, self.fresh, self.pending = (q[kept], score[kept], place[order][kept], masks[order][kept]), [], 0


def best(k: int, k1: float, b: float, *, tables: bool = False, held: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows of a block with ``batch, asked, mean_length``: ``lead, chunk_id, score, held``, a superset of each question's best k of all blocks of the task.

    ``tables`` looks at tables only; ``held`` names the terms of the question that the chunk holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, _Batch] = {}
        names, total = {}, 0
        where: dict[tuple, int] = {}
        kind = pa.int64()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                ids = row["ids"].values
                key = (ids[0].as_py(), len(ids))
                if key not in where:
                    where[key], total = total, total + len(ids)
                    names[key] = ids.take(pa.array(np.arange(len(ids))))  # a copy: the batch is not kept
                number = row["batch"].as_py()
                if number not in asked:
                    kind = row["asked"].type.value_type.field("lead").type
                    asked[number] = _Batch(row["asked"], k, held)
                one = asked[number]
                allowed = row["tables"].values.to_numpy(zero_copy_only=False).astype(float) if tables else None
                one.meet(_Weights(row, one.vocabulary, row["mean_length"].as_py(), k1, b), where[key], allowed)
        told = pa.chunked_array([names[key] for key in where], pa.string())
        for one in asked.values():
            one.merge()
            q, score, place, masks = one.found
            words = [[one.terms[v] for i, (v, _) in enumerate(one.questions[a]) if m[i // BITS] >> (i % BITS) & 1] for a, m in zip(q.tolist(), masks.tolist(), strict=True)] if held else [None] * len(q)
            columns = [pa.array([one.keys[a] for a in q.tolist()], kind), told.take(pa.array(place)).combine_chunks(), pa.array(score), pa.array(words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["lead", "chunk_id", "score", "held"])

    return run
