"""Problem 8: encode every document with a public byte-level BPE vocabulary.

Method: a text is cut by the vocabulary's pattern into pieces; inside a piece a
segment tree over the ranks of adjacent pairs holds at each node the lowest
rank below it, leftmost first. The root therefore names the next merge, which
changes two leaves, each repaired in logarithmic time, until no pair can merge.
A bounded memo keeps the ids of pieces seen by a worker; it changes no result.

Defined cases: null and empty texts give an empty list; text that looks like a
special token is ordinary text; lone surrogates are written as U+FFFD.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import read_table

#: Folder of the public vocabularies; a parameter of every operator below.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Pieces remembered by one worker before the memo is emptied.
MEMO_PIECES = 300_000
#: The published splitting pattern of this family of vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = 1 << 60


class PieceEncoder:
    """Greedy pair merging of one piece through a segment tree."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def encode(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        if n == 1:
            return [ranks[parts[0]]]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        width = 1
        while width < n - 1:
            width *= 2
        # A node holds rank * n + position: the least value is the lowest rank, leftmost first.
        tree = [_NONE] * (2 * width)
        get = ranks.get
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                tree[width + i] = rank * n + i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while (root := tree[1]) != _NONE:
            i = root % n
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            k = after[i] = after[j]
            if j < n - 1:
                put(j, _NONE)
            if k < n:
                before[k] = i
                rank = get(parts[i] + parts[k])
                put(i, _NONE if rank is None else rank * n + i)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                rank = get(parts[h] + parts[i])
                put(h, _NONE if rank is None else rank * n + h)
        return [ranks[p] for p in parts if p is not None]


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in raw.splitlines() if line)}


def read_vocabulary(folder: str, vocabulary: str) -> bytes:
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as file:
        return file.read()


def load_ranks(folder: str, vocabulary: str) -> dict[bytes, int]:
    return ranks_of(read_vocabulary(folder, vocabulary))


def text_encoder(folder: str, vocabulary: str) -> Callable[[str | None], list[int]]:
    return encoder_of(read_vocabulary(folder, vocabulary))


@lru_cache(maxsize=4)
def encoder_of(raw: bytes) -> Callable[[str | None], list[int]]:
    import regex

    pieces = regex.compile(PATTERN).findall
    encode = PieceEncoder(ranks_of(raw)).encode
    memo: dict[str, list[int]] = {}

    def run(text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        for piece in pieces(text):
            known = memo.get(piece)
            if known is None:
                known = encode(piece.encode("utf-8", "replace"))
                if len(memo) >= MEMO_PIECES:
                    memo.clear()
                if len(piece) <= 64:
                    memo[piece] = known
            ids += known
        return ids

    return run


def encode_texts(
    df: DataFrame, key: str, text: str, *, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, counts_only: bool = False
) -> DataFrame:
    """``key`` and ``ids`` (or ``n_tokens``) of each row; a narrow map, nothing is shuffled."""
    source = df.select(F.col(key), F.col(text).alias("text"))
    kind = dict(source.dtypes)[key]
    result = "n_tokens int" if counts_only else "ids array<int>"

    # The driver reads the vocabulary (a file of fixed size, about 1 MB); executors need no copy of it on their disks.
    shipped = df.sparkSession.sparkContext.broadcast(read_vocabulary(folder, vocabulary))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder_of(shipped.value)
        for frame in frames:
            texts = frame.column(1)
            # Batches are cut so that one with very long texts stays small in memory.
            for start in range(0, frame.num_rows, 1000):
                part = texts.slice(start, 1000).to_pylist()
                if counts_only:
                    out = pa.array([len(run(t)) for t in part], pa.int32())
                else:
                    out = pa.array([run(t) for t in part], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(start, 1000), out], [key, result.split()[0]])

    return source.mapInArrow(batches, f"{key} {kind}, {result}")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(read_table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
ORACLE: dict[str, str] = {}
