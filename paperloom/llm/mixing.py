"""Problem 9: draw documents so that each source holds a target share of tokens.

Method: cube sampling. For a mix the greatest total is taken that every source
can fill with at most ``max_repeats`` copies of its tokens. A source then needs
share * total / tokens copies of each of its documents: the whole part is taken
for all, the fraction f is an inclusion probability. The flight phase moves the
probabilities through the null space of two constraints (documents and tokens of
the source) until no three undecided documents of a block are left; blocks of
``BLOCK`` rows by hash fly apart from each other, and what is undecided flies
again with that of other blocks until one block a source is left. The landing
decides its last (at most two) documents by their probabilities; then drawn and
undrawn documents of that block are exchanged, one for one, until the tokens of the
source are within ``TOLERANCE`` of its target or no exchange brings them nearer.
``p9_shares`` reports what is left as ``error_tokens``. Exchanges stay in the one
last block of a source and touch a few documents, so that probabilities move by
little.

Every document is in one block of bounded size, so a source with a third of all
rows is many blocks. Shares given for sources without documents cannot be
filled: they are reported with 0 tokens and the others keep their proportions.

Defined cases: source names are compared lower-cased with other characters than
letters and digits as "_"; null sources and documents without tokens are never
drawn; repeated target rows count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.encoding import TOKENIZERS, VOCABULARY, encode_texts
from paperloom.sources.tables import read_table, shared_checkpoint

BLOCK = 4_000
#: Tokens that a source may stand off from its target, and exchanges tried for that.
TOLERANCE = 1
EXCHANGES = 8
SEED = 5
_TINY = 1e-9


def source_name(column: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(column)), r"[^\p{L}\p{Nd}]+", "_")


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities until fewer than three are undecided; sums of p and p*size stay."""
    p = p.astype(float).copy()
    sizes = sizes.astype(float)
    pool: list[int] = []
    for i in rng.permutation(len(p)):
        if not _TINY < p[i] < 1 - _TINY:
            continue
        pool.append(int(i))
        while len(pool) == 3:
            a, b, c = pool
            # u spans the null space of the rows (1, 1, 1) and (size a, b, c).
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / v if v > 0 else -p[k] / v for k, v in zip(pool, u) if v)
            down = min(p[k] / v if v > 0 else (p[k] - 1) / v for k, v in zip(pool, u) if v)
            step = up if rng.random() < down / (up + down) else -down
            for k, v in zip(pool, u):
                p[k] = min(1.0, max(0.0, p[k] + step * v))
            pool = [k for k in pool if _TINY < p[k] < 1 - _TINY]
    return p


def landing(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide what is left so that the number drawn is the rounded sum of probabilities."""
    p = p.copy()
    open_ = np.flatnonzero((p > _TINY) & (p < 1 - _TINY))
    if len(open_):
        # Systematic draw: each document keeps its probability, their number differs by less than one.
        edges = np.concatenate([[0.0], np.cumsum(p[open_])]) + rng.random()
        p[open_] = (np.floor(edges[1:]) - np.floor(edges[:-1])).clip(0, 1)
    return np.rint(p)


def exchange(taken: np.ndarray, sizes: np.ndarray, target: float) -> np.ndarray:
    """Swap a drawn document for an undrawn one while that brings the drawn tokens nearer to ``target``; their number stays."""
    taken = taken.copy()
    for _ in range(EXCHANGES):
        off = float(sizes[taken > 0.5].sum()) - target
        drawn, other = np.flatnonzero(taken > 0.5), np.flatnonzero(taken <= 0.5)
        if abs(off) <= TOLERANCE or not len(drawn) or not len(other):
            break
        # Of each drawn document the undrawn one whose size differs from it by nearest to ``off``.
        order = other[np.argsort(sizes[other], kind="stable")]
        wanted = sizes[drawn] - off
        at = np.searchsorted(sizes[order], wanted)
        near = np.stack([np.clip(at - 1, 0, len(order) - 1), np.clip(at, 0, len(order) - 1)])
        left = np.abs(sizes[order[near]] - wanted)
        side, k = np.unravel_index(int(np.argmin(left)), left.shape)
        if left[side, k] >= abs(off):
            break
        taken[drawn[k]], taken[order[near[side, k]]] = 0.0, 1.0
    return taken


def _fly(last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable", ignore_index=True)
        rng = np.random.default_rng([SEED, *(abs(hash_of(k)) for k in key)])
        sizes, wanted = rows["n_tokens"].to_numpy().astype(float), rows["p"].to_numpy()
        p = flight(wanted, sizes, rng)
        rows["p"] = exchange(landing(p, rng), sizes, float(sizes @ wanted)) if last else np.where(p <= _TINY, 0.0, np.where(p >= 1 - _TINY, 1.0, p))
        return rows

    return run


def hash_of(value: object) -> int:
    import zlib

    return zlib.crc32(str(value).encode())


_ROWS = "mix_name string, source string, doc_id bigint, n_tokens int, whole int, p double"


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_name, source, target_share, max_repeats, tokens, copies`` per mix and source; a few rows a mix."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    t = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats").distinct()
    t = t.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    both = t.join(have, "source", "left").fillna(0, ["tokens", "documents"])
    reach = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0), F.col("max_repeats") * F.col("tokens") / F.col("target_share"))
    totals = both.groupBy("mix_name").agg(F.min(reach).alias("total"))
    need = F.col("target_share") * F.col("total") / F.col("tokens")
    return both.join(totals, "mix_name").withColumn("copies", F.when(F.col("tokens") > 0, need).otherwise(0.0))


def draw(df: DataFrame, targets: DataFrame, *, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Drawn documents (``mix_name, source, doc_id, n_tokens, copies``) and the plan they follow."""
    named = df.select(F.struct("doc_id", source_name(F.col("source")).alias("source")).alias("at"), "text")
    sizes = encode_texts(named, "at", "text", folder=folder, vocabulary=vocabulary, counts_only=True).select("at.doc_id", "at.source", "n_tokens")
    sizes = shared_checkpoint(sizes.filter("source is not null and n_tokens > 0"))
    wanted = shared_checkpoint(plan(sizes, targets))
    whole = F.floor(F.col("copies") + F.lit(1e-12)).cast("int")
    # The plan has a row per mix and source, a table of the caller's own making; Spark picks the join by its size.
    rows = sizes.join(wanted.filter("copies > 0").select("mix_name", "source", "copies"), "source")
    rows = rows.select("mix_name", "source", "doc_id", "n_tokens", whole.alias("whole"), (F.col("copies") - whole).alias("p"))
    open_ = (F.col("p") > _TINY) & (F.col("p") < 1 - _TINY)
    decided: list[DataFrame] = []
    level = 0
    while True:
        most = rows.filter(open_).groupBy("mix_name", "source").count().agg(F.max("count")).head()[0] or 0
        blocks = max(1, -(-most // BLOCK))
        block = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(level)), F.lit(blocks))
        flown = rows.filter(open_).withColumn("b", block).groupBy("mix_name", "source", "b")
        flown = flown.applyInPandas(_fly_block(blocks == 1), _ROWS)
        decided.append(rows.filter(~open_))
        rows = shared_checkpoint(flown)
        level += 1
        if blocks == 1:
            decided.append(rows)
            break
    taken = decided[0]
    for part in decided[1:]:
        taken = taken.unionByName(part)
    taken = taken.select("mix_name", "source", "doc_id", "n_tokens", (F.col("whole") + F.round("p").cast("int")).alias("copies"))
    return taken.filter("copies > 0"), wanted


def _fly_block(last: bool):
    run = _fly(last)

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return run(key, rows.drop(columns="b"))

    return block


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, folder, "documents", "doc_id", "text", "source"), read_table(spark, folder, "mix_targets")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return draw(*_inputs(spark, folder))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target, possible and actual share of every source of every mix."""
    taken, wanted = draw(*_inputs(spark, folder))
    got = taken.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_documents"), F.max("copies").alias("most_copies")
    )
    rows = wanted.join(got, ["mix_name", "source"], "left").fillna(0, ["drawn_tokens", "drawn_documents", "most_copies"])
    sums = rows.groupBy("mix_name").agg(
        F.sum("drawn_tokens").alias("all_drawn"), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("reachable")
    )
    rows = rows.join(sums, "mix_name")
    return rows.select(
        "mix_name", "source", "target_share", "max_repeats", "tokens", "drawn_documents", "drawn_tokens", "most_copies",
        F.when(F.col("tokens") > 0, F.col("target_share") / F.col("reachable")).otherwise(0.0).alias("reachable_share"),
        F.coalesce(F.try_divide("drawn_tokens", "all_drawn"), F.lit(0.0)).alias("actual_share"),
        (F.col("drawn_tokens") - F.round(F.col("copies") * F.col("tokens"))).cast("bigint").alias("error_tokens"),
    )


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}
