"""Problem 10: share of repeated words inside one document.

Method: cheap rule statistics of each document (distinct shares of words, word
pairs and word triples, share of the commonest word, share of repeated lines,
compressed size over size) enter an isolation forest. The forest is grown on a
bounded sample; the threshold on the anomaly score comes from the labelled rows of
that sample (a label is the exact rule) and, where these are few, from sample
texts made to repeat just enough. Only documents that the forest flags are held
against the exact rule of six-word windows; the others are never searched for
windows. Recall of the screen over all rows: see README.

Defined cases: null, empty and word-less texts have share 0 and are never found;
where the sample holds neither labels nor texts of 12 words, all rows are checked.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import read_table

WINDOW = 6
LEAST_WORDS = 12
LEAST_SHARE = 0.30
#: Bounded samples: rows for growing and labels, labels needed, and trees and rows a tree.
SAMPLE_ROWS = 20_000
LEAST_LABELS = 100
TREES = 64
ROWS_A_TREE = 256
#: The threshold lies under the lowest score of a labelled row by this much.
MARGIN = 0.03
STATISTICS = ("distinct_words", "distinct_pairs", "distinct_triples", "top_word", "repeated_lines", "compressed")

_DROP = re.compile(r"[^\w\s]")


def repeated_positions(words: list[str], window: int = WINDOW) -> int:
    """Number of words inside a window whose same form began earlier."""
    seen: set[tuple] = set()
    covered = 0
    reach = 0
    for i, gram in enumerate(zip(*(words[k:] for k in range(window)))):
        if gram in seen:
            start = i if i > reach else reach
            covered += i + window - start
            reach = i + window
        else:
            seen.add(gram)
    return covered


def words_of(text: str | None) -> list[str]:
    return _DROP.sub("", text.lower()).split() if text else []


def repeated_share(words: list[str]) -> float:
    return repeated_positions(words) / len(words) if words else 0.0


def statistics(text: str | None, words: list[str]) -> tuple[float, ...]:
    """The cheap statistics of a document, in the order of ``STATISTICS``."""
    n = len(words)
    if not n:
        return 1.0, 1.0, 1.0, 0.0, 0.0, 1.0
    pairs = list(zip(words, words[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    raw = text.encode("utf-8", "replace")
    return (
        len(set(words)) / n,
        len(set(pairs)) / max(1, n - 1),
        len(set(zip(pairs, words[2:]))) / max(1, n - 2),
        Counter(words).most_common(1)[0][1] / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(zlib.compress(raw, 1)) / len(raw),
    )


def planted(words: list[str]) -> list[str] | None:
    """The words with as many of their first repeated at the end as just make a case, else None."""
    again = max(WINDOW, math.ceil(LEAST_SHARE * len(words) / (1 - LEAST_SHARE)))
    return [*words, *words[:again]] if len(words) >= max(LEAST_WORDS, again) else None


def _harmonic(n: np.ndarray | float) -> np.ndarray | float:
    n = np.maximum(n, 2)
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Random splits on a sample; flat arrays, so that scoring is vectorised."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = ROWS_A_TREE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = max(2, min(size, len(rows)))
        self.depth = int(np.ceil(np.log2(self.size)))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=len(rows) < self.size)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, length = [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            k = len(feature)
            feature.append(-1), cut.append(0.0), left.append((0, 0)), length.append(0.0)
            low, high = part.min(0), part.max(0)
            open_ = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) <= 1 or not len(open_):
                length[k] = depth + (float(_harmonic(len(part))) if len(part) > 1 else 0.0)
                return k
            f = int(rng.choice(open_))
            c = float(rng.uniform(low[f], high[f]))
            side = part[:, f] < c
            feature[k], cut[k] = f, c
            left[k] = (node(part[side], depth + 1), node(part[~side], depth + 1))
            return k

        node(rows, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, children, length in self.trees:
            at = np.zeros(len(rows), dtype=int)
            for _ in range(self.depth + 1):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = (rows[every, np.maximum(f, 0)] >= cut[at]).astype(int)
                at = np.where(inner, children[at, right], at)
            total += length[at]
        return np.power(2.0, -total / len(self.trees) / float(_harmonic(self.size)))


def is_case(n_words: int, share: float) -> bool:
    return n_words >= LEAST_WORDS and share >= LEAST_SHARE - 1e-12


class Screen:
    """Forest and threshold; without labels the threshold is 0 and everything is flagged."""

    def __init__(self, rows: np.ndarray, kinds: np.ndarray):
        base, labels = rows[kinds < 2], rows[kinds == 1]
        if len(labels) < LEAST_LABELS:
            labels = rows[kinds >= 1]
        self.threshold = 0.0
        if len(labels):
            self.forest = IsolationForest(base)
            self.threshold = float(self.forest.score(labels).min()) - MARGIN

    def flags(self, rows: np.ndarray) -> np.ndarray:
        return np.ones(len(rows), bool) if self.threshold <= 0 else self.forest.score(rows) >= self.threshold


def fit_screen(df: DataFrame, key: str, text: str, *, sample_rows: int = SAMPLE_ROWS) -> Screen:
    """The screen, from the statistics of a bounded sample drawn by hash (``sample_rows`` on average)."""
    rate = int(min(1.0, sample_rows / max(1, df.count())) * (1 << 30))
    drawn = df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) < rate)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows, kinds = [], []
            for k, value in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                words = words_of(value)
                rows.append(statistics(value, words)), kinds.append(int(is_case(len(words), repeated_share(words))))
                # Every tenth text or so is made to repeat as well, by its key.
                if zlib.crc32(str(k).encode()) % 10 == 0 and (more := planted(words)) and is_case(len(more), repeated_share(more)):
                    rows.append(statistics(value + " " + " ".join(more[len(words) :]), more)), kinds.append(2)
            columns = list(zip(*rows)) or [[]] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), *(pa.array(c, pa.float64()) for c in columns)], ["kind", *STATISTICS])

    got = drawn.select(key, text).mapInArrow(batches, "kind int, " + ", ".join(f"{s} double" for s in STATISTICS)).toPandas()
    got = got.sort_values(list(got.columns), ignore_index=True)
    return Screen(got[list(STATISTICS)].to_numpy(), got["kind"].to_numpy())


def repeated_documents(df: DataFrame, key: str, text: str, *, screen: Screen | None = None) -> DataFrame:
    """``key, n_words, anomalous, repeated_share``: the share only of what the forest flags; one pass, no shuffle."""
    screen = screen or fit_screen(df, key, text)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column(1).to_pylist()
            words = [words_of(t) for t in texts]
            rows = np.array([statistics(t, w) for t, w in zip(texts, words)]).reshape(-1, len(STATISTICS))
            flags = screen.flags(rows)
            shares = [repeated_share(w) if f else None for f, w in zip(flags, words)]
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), pa.array([len(w) for w in words], pa.int32()), pa.array(flags), pa.array(shares, pa.float64())],
                [key, "n_words", "anomalous", "repeated_share"],
            )

    source = df.select(key, text)
    return source.mapInArrow(batches, f"{key} {dict(source.dtypes)[key]}, n_words int, anomalous boolean, repeated_share double")


def document_shares(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_words, repeated_share`` of every document by the exact rule."""

    class Every(Screen):
        def __init__(self):
            self.threshold = 0.0

    return repeated_documents(df, key, text, screen=Every()).drop("anomalous")


def p10_share(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated share of every document."""
    shares = document_shares(read_table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return shares.select("doc_id", "n_words", F.round("repeated_share", 9).alias("repeated_share"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = repeated_documents(read_table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return rows.filter("anomalous").filter((F.col("n_words") >= LEAST_WORDS) & (F.col("repeated_share") >= LEAST_SHARE - 1e-12)).select("doc_id")


#: White space of Unicode, for an engine whose \s is ASCII (fixed values).
_BLANK = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LOWER = "lower(replace(text, 'İ', 'i' || chr(775)))"
_WORDS = rf"list_filter(string_split_regex(regexp_replace({_LOWER}, '[^\p{{L}}\p{{N}}_{_BLANK}]', '', 'g'), '[{_BLANK}]+'), lambda x: x <> '')"

QUERIES = {"p10_found": p10_found, "p10_share": p10_share}
_REPEATED = f"""
        WITH w AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 5), ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 6)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM g) WHERE k > 1),
        c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 6)) AS p FROM r) GROUP BY doc_id)"""
ORACLE = {
    "p10_found": _REPEATED + " SELECT c.doc_id FROM c JOIN w USING (doc_id) WHERE len(w.ws) >= 12 AND c.n >= 0.30 * len(w.ws)",
    "p10_share": _REPEATED + """ SELECT w.doc_id, len(w.ws)::INT AS n_words, CASE WHEN len(w.ws) = 0 THEN 0.0 ELSE round(coalesce(c.n, 0) / len(w.ws), 9) END AS repeated_share
        FROM w LEFT JOIN c USING (doc_id)""",
}
