"""Hybrid retrieval: Okapi BM25, dense cosine, reciprocal rank fusion, coverage and extraction.

Statistics (number of chunks, document frequency, mean length) cover every normal
chunk; metadata filters only hide scores afterwards. Quarantined chunks never
enter. The postings are written once per state of the chunks, in blocks of chunks:
questions go over the blocks together, no text is read. Questions are all evaluation
questions, or where a query says so a stated set (those whose id is divisible by 20),
held against all rows; ties go to the smaller id.

Null texts count as empty; copies of a row count once; a question without index
terms finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import STOP_WORDS, sentences, tokens
from paperloom.operators.postings import BLOCK, BLOCKS, best, blocks
from paperloom.sources.tables import exists, fingerprint, read_table, shared_checkpoint, shared_folder

# Depths of the cascade and constants of the scores.
RETRIEVE, RERANK, FINAL, PROMPT, RRF = 40, 14, 6, 4, 60
K1, B = 1.5, 0.75
WINDOW_WORDS = 384

#: Sets of terms that are asked together.
QUESTIONS = 2048


def chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    rows = read_table(spark, folder, "chunks", "chunk_id", "trust", *columns)
    return rows.filter("trust = 'normal'").drop("trust").distinct()


def questions(spark: SparkSession, folder: str, every: int = 20) -> DataFrame:
    rows = read_table(spark, folder, "rag_eval_nollm", "qa_id", "question").filter((F.col("qa_id") % every == 0) & F.col("question").isNotNull()).distinct()
    return rows.select(F.col("qa_id").alias("question_id"), "question")


class Index:
    """Blocks of postings (see ``postings``), ``terms`` (``term, df``) and one row of ``corpus`` (``n, mean_length``) of a table's chunks."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/index-{fingerprint(spark, f'{folder}/chunks.parquet')}"
        # The last part is written last: an index that broke off is written anew.
        if not exists(spark, f"{self.path}/corpus/_SUCCESS"):
            self._write(read_table(spark, folder, "chunks", "chunk_id", "trust", "kind", "text", "embed_text").filter("trust = 'normal'").drop("trust"))

    def _write(self, rows: DataFrame) -> None:
        # Copies are removed where the rows of a chunk meet: texts move once.
        parts = max(1, -(-rows.count() // BLOCK))
        text = F.concat_ws(" ", F.coalesce("embed_text", F.lit("")), F.coalesce("text", F.lit("")))
        met = rows.repartition(parts, "chunk_id").distinct().select("chunk_id", F.coalesce(F.col("kind") == "table", F.lit(False)).alias("is_table"), F.replace(F.lower(text), F.lit(",")).alias("text"))
        met.mapInArrow(blocks, BLOCKS).write.mode("overwrite").parquet(f"{self.path}/blocks")
        counted = self.blocks().select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
        counted.write.mode("overwrite").parquet(f"{self.path}/terms")
        sizes = self.blocks().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), (F.sum("words") / F.sum("rows")).alias("mean_length"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/corpus")

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def corpus(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/corpus")


def question_terms(asked: DataFrame) -> DataFrame:
    return asked.select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


class Asked:
    """Questions by their terms, each set of terms once: ``members`` (``question_id, lead``) and ``sets`` (``lead, term, idf``) over an index."""

    def __init__(self, index: Index, asked: DataFrame):
        self.index = index
        rows = asked.select("question_id", tokens(F.col("question")).alias("terms")).groupBy("question_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
        rows = shared_checkpoint(rows.filter(F.size("terms") > 0))
        leads = rows.groupBy("terms").agg(F.min("question_id").alias("lead"))
        self.members = rows.join(leads, "terms").select("question_id", "lead")
        # A term of no chunk has a weight too; one row of corpus statistics.
        weights = leads.select("lead", F.explode("terms").alias("term")).join(index.terms(), "term", "left").fillna(0, ["df"]).crossJoin(F.broadcast(index.corpus()))
        self.sets = shared_checkpoint(weights.select("lead", "term", inverse_frequency(F.col("n"), F.col("df")).alias("idf")))

    def best(self, k: int, *, tables: bool = False, held: bool = False) -> DataFrame:
        """``lead, chunk_id, score, rank, held`` of each set's best k chunks with a score over 0."""
        whole = self.sets.groupBy("lead").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("weights"))
        parts = max(1, -(-whole.count() // QUESTIONS))
        batches = whole.withColumn("batch", F.pmod(F.xxhash64("lead"), F.lit(parts))).repartition(parts, "batch").groupBy("batch").agg(F.collect_list(F.struct("lead", "weights")).alias("asked"))
        batches = batches.crossJoin(F.broadcast(self.index.corpus().select("mean_length")))
        # Many batches keep the cores busy by themselves; each then goes over all blocks in one task and moves its results once.
        blocks = self.index.blocks().drop("rows", "words").coalesce(max(1, -(-2 * self.index.spark.sparkContext.defaultParallelism // parts)))
        met = blocks.crossJoin(batches.hint("shuffle_replicate_nl"))
        kind = dict(self.sets.dtypes)["lead"]
        return top(met.mapInArrow(best(k, K1, B, tables=tables, held=held), f"lead {kind}, chunk_id string, score double, held array<string>"), k, "lead")


def bm25(index: Index, asked: DataFrame, k: int, *, tables: bool = False) -> DataFrame:
    """``question_id, chunk_id, score, rank`` of each question's best k chunks with a score over 0."""
    told = Asked(index, asked)
    return told.members.join(told.best(k, tables=tables).drop("held"), "lead").select("question_id", "chunk_id", "score", "rank")


def top(scores: DataFrame, k: int, key: str = "question_id", item: str = "chunk_id") -> DataFrame:
    """Rank from 1 within each key; the limit is pushed below the shuffle as a partial top-k."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(vector: Column, dims: int = 64) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; for many rows against many see ``dense_scores``."""

    def total(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    return total(a, b) / F.sqrt(total(a, a) * total(b, b))


def fused(rankings: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of ``question_id, chunk_id, rank`` rows of several rankings."""
    return rankings.groupBy("question_id", "chunk_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"))


def retrieval_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return bm25(Index(spark, folder), questions(spark, folder, every=1), RETRIEVE)


def retrieval_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Scores with corpus-wide statistics, then a mask on the kind of chunk."""
    return bm25(Index(spark, folder), questions(spark, folder, every=1), FINAL, tables=True)


def _hybrid(spark: SparkSession, folder: str) -> DataFrame:
    # A few rows a question, used for its stand-in vector and for the fusion.
    lexical = shared_checkpoint(bm25(Index(spark, folder), questions(spark, folder), RETRIEVE).select("question_id", "chunk_id", "rank"))
    vectors = chunks(spark, folder, "embedding").filter(usable(F.col("embedding"))).select("chunk_id", F.col("embedding").cast("array<double>").alias("v"))
    # No embedding model here: the best lexical chunk with a vector stands for the question (pseudo-relevance).
    first = lexical.join(vectors, "chunk_id").groupBy("question_id").agg(F.min_by("v", "rank").alias("v"))
    points = vectors.withColumnRenamed("chunk_id", "id")
    dense = dense_scores(points, shared_checkpoint(first.withColumnRenamed("question_id", "query_id")), k=RETRIEVE)
    dense = top(dense, RETRIEVE, "query_id", "id").select(F.col("query_id").alias("question_id"), F.col("id").alias("chunk_id"), "rank")
    return top(fused(lexical.unionByName(dense)), RERANK)


def retrieval_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder).select("question_id", "chunk_id", "score", "rank")


def retrieval_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted share of each question's terms that its best chunks hold; a term of no chunk weighs most."""
    told = Asked(Index(spark, folder), questions(spark, folder, every=1))
    have = told.best(PROMPT, held=True).select("lead", F.explode("held").alias("term")).distinct().withColumn("have", F.lit(1))
    weights = told.sets.join(have, ["lead", "term"], "left")
    got = F.sum(F.when(F.col("have") == 1, F.col("idf")).otherwise(0.0))
    shares = weights.groupBy("lead").agg(F.round(got / F.sum("idf"), 6).alias("coverage"))
    return told.members.join(shares, "lead").select("question_id", "coverage")


def retrieval_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Extract: the two sentences of each best chunk that share most words with the question, in their order."""
    asked = questions(spark, folder, every=1)
    best = bm25(Index(spark, folder), asked, 3).select("question_id", "chunk_id", F.col("rank").alias("source"))
    text = chunks(spark, folder, "text").join(best, "chunk_id").join(asked, "question_id")
    cut = text.select("question_id", "question", "chunk_id", "source", F.posexplode(sentences(F.col("text"))).alias("at", "sentence"))
    q = F.array_distinct(tokens(F.col("question")))
    score = F.round(F.size(F.array_intersect(q, tokens(F.col("sentence")))) / F.size(q), 6)
    order = Window.partitionBy("question_id", "chunk_id").orderBy(F.desc("score"), "at")
    kept = cut.withColumn("score", score).withColumn("r", F.row_number().over(order)).filter("r <= 2 and score > 0")
    return kept.select("question_id", "source", "at", "sentence", "score")


def retrieval_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed windows of words over whole documents, the naive baseline's chunks."""
    docs = read_table(spark, folder, "documents", "doc_id", "text").filter("text is not null")
    words = docs.select("doc_id", F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / WINDOW_WORDS).cast("int"))
    cut = words.select("doc_id", F.explode(starts).alias("window"), "w")
    part = F.slice("w", F.col("window") * WINDOW_WORDS + 1, WINDOW_WORDS)
    return cut.select("doc_id", "window", F.size(part).alias("words"), F.md5(F.array_join(part, " ")).alias("digest"))


def dense_scores(points: DataFrame, asked: DataFrame, *, dims: int = 64, k: int = 10, block: int = 1024) -> DataFrame:
    """``query_id, id, score``: candidates for the exact top-k of ``query_id, v`` against all of ``id, v``, block against block.

    Every query meets every row, a stated query set in blocks of bounded size; of each
    pair of blocks only k rows a query leave.
    """
    number = lambda key, rows: F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows // block))))
    left = points.withColumn("b", number("id", points.count())).groupBy("b").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs"))
    right = asked.withColumn("b", number("query_id", asked.count())).groupBy("b").agg(F.collect_list("query_id").alias("qids"), F.flatten(F.collect_list("v")).alias("qs"))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, vs, qids, qs in frame.itertuples(index=False):
                ids, qids = np.asarray(ids), np.asarray(qids)
                x, q = (np.array(m, float).reshape(-1, dims) for m in (vs, qs))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                q /= np.linalg.norm(q, axis=1, keepdims=True)
                sims = q @ x.T
                if qids.dtype == ids.dtype:
                    sims[qids[:, None] == ids[None, :]] = -2
                # The k-th best of each query bounds what is sorted; ties by the rounded score stay.
                at = max(0, len(ids) - k)
                r, c = np.nonzero(sims >= np.partition(sims, at, axis=1)[:, at, None] - 1e-6)
                score = np.round(sims[r, c], 6)
                order = np.lexsort((ids[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                kept = (np.arange(len(r)) - np.searchsorted(r, r) < k) & (score > -1.5)
                yield pd.DataFrame({"query_id": qids[r[kept]], "id": ids[c[kept]], "score": score[kept]})

    met = left.drop("b").crossJoin(right.drop("b"))
    return met.mapInPandas(best, f"query_id {dict(asked.dtypes)['query_id']}, id {dict(points.dtypes)['id']}, score double")


def dense_top(vectors: DataFrame, key: str, vector: str, *, dims: int = 64, k: int = 10, every: int = 20, block: int = 1024) -> DataFrame:
    """Exact top-k of the query rows (key divisible by ``every``) against all rows."""
    rows = vectors.filter(usable(F.col(vector), dims)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = rows.filter(F.col("id") % every == 0).withColumnRenamed("id", "query_id")
    return top(dense_scores(rows, asked, dims=dims, k=k, block=block), k, "query_id", "id")


def retrieval_dense(spark: SparkSession, folder: str) -> DataFrame:
    found = dense_top(read_table(spark, folder, "embeddings"), "vec_id", "embedding")
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def retrieval_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Route of each evaluation question by ordered patterns."""
    rows = read_table(spark, folder, "rag_eval_nollm", "qa_id", "question").distinct()
    q = F.lower(F.col("question"))
    route = (
        F.when(q.rlike(r"\b(compare|versus|vs|difference between|contradict\w*)\b"), "compare")
        .when(q.rlike(r"\b(list|which|all|every|each)\b"), "list")
        .when(q.rlike(r"\b(how much|how many|how large|total|sum|average|growth|ratio|percent\w*|cagr|amount)\b|%"), "numeric")
        .otherwise("lookup")
    )
    return rows.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("questions"))


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_bm25, retrieval_filtered, retrieval_hybrid, retrieval_coverage, retrieval_sentences, retrieval_windows, retrieval_dense, retrieval_routes,
    )
}

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_STEM = "CASE WHEN length(t) < 5 OR regexp_full_match(t, '[0-9]+') THEN t WHEN t LIKE '%ies' AND length(t) > 5 THEN left(t, length(t) - 3) || 'y' " + " ".join(
    f"WHEN t LIKE '%{s}' AND length(t) >= {4 + len(s)} THEN left(t, length(t) - {len(s)})" for s in ("ing", "ity", "ed", "es", "s")
) + " ELSE t END"


def sql_tokens(text: str) -> str:
    return (
        f"list_transform(list_filter(regexp_extract_all(replace(lower({text}), ',', ''), '[a-z0-9]+(?:\\.[0-9]+)?|[₹$€£%]'), "
        f"lambda t: t NOT IN ({_STOPS})), lambda t: {_STEM})"
    )


_ASKED = "(SELECT DISTINCT qa_id AS question_id, question FROM rag_eval_nollm WHERE qa_id % 20 = 0 AND question IS NOT NULL)"
_BASE = f"""
    WITH c AS (SELECT DISTINCT chunk_id, text, embed_text, kind FROM chunks WHERE trust = 'normal'),
    i AS (SELECT chunk_id, {sql_tokens("coalesce(embed_text, '') || ' ' || coalesce(text, '')")} AS terms FROM c),
    n AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM i),
    p AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS length, unnest(terms) AS term FROM i) GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT DISTINCT question_id, unnest({sql_tokens("question")}) AS term FROM {_ASKED}),
    s AS (SELECT question_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score
          FROM q JOIN p USING (term) JOIN d USING (term) CROSS JOIN n GROUP BY ALL HAVING score > 0),
    r AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""
#: The same over all questions.
_WHOLE = _BASE.replace("qa_id % 20 = 0 AND ", "")
_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_COSINE = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"

ORACLE = {
    "retrieval_bm25": _WHOLE + " SELECT question_id, chunk_id, score, rank FROM r WHERE rank <= 40",
    "retrieval_filtered": _WHOLE + """, m AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank
        FROM s SEMI JOIN (SELECT chunk_id FROM c WHERE kind = 'table') USING (chunk_id))
        SELECT question_id, chunk_id, score, rank FROM m WHERE rank <= 6""",
    "retrieval_hybrid": _BASE + f""", l AS (SELECT question_id, chunk_id, rank FROM r WHERE rank <= 40),
        e AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM chunks WHERE trust = 'normal' AND {_USABLE}),
        f AS (SELECT question_id, arg_min(e, rank) AS q FROM l JOIN e USING (chunk_id) GROUP BY question_id),
        v AS (SELECT question_id, chunk_id, round({_COSINE.format(a="e", b="q")}, 6) AS score FROM e CROSS JOIN f),
        w AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM v QUALIFY rank <= 40),
        u AS (SELECT question_id, chunk_id, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS score FROM (FROM l UNION ALL FROM w) GROUP BY ALL)
        SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM u QUALIFY rank <= 14""",
    "retrieval_coverage": _WHOLE + """, b AS (SELECT question_id, chunk_id FROM r WHERE rank <= 4),
        h AS (SELECT DISTINCT question_id, term, 1 AS have FROM b JOIN p USING (chunk_id))
        SELECT question_id, round(sum(CASE WHEN have = 1 THEN idf ELSE 0 END) / sum(idf), 6) AS coverage
        FROM (SELECT question_id, term, have, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf
              FROM q LEFT JOIN d USING (term) LEFT JOIN h USING (question_id, term) CROSS JOIN n) GROUP BY question_id""",
    "retrieval_sentences": _WHOLE + f""", b AS (SELECT question_id, chunk_id, rank AS source FROM r WHERE rank <= 3),
        cut AS (SELECT question_id, question, source, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS ss
                FROM b JOIN c USING (chunk_id) JOIN {_ASKED.replace("qa_id % 20 = 0 AND ", "")} AS a USING (question_id)),
        one AS (SELECT question_id, question, source, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS "at" FROM cut),
        scored AS (SELECT question_id, source, "at"::INT AS "at", sentence, round(len(list_intersect(list_distinct({sql_tokens("question")}), {sql_tokens("sentence")})) / len(list_distinct({sql_tokens("question")})), 6) AS score FROM one)
        SELECT question_id, source, "at", sentence, score FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY question_id, source ORDER BY score DESC, "at") <= 2""",
    "retrieval_windows": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, w, unnest(range(0, ((len(w) - 1) // 384) + 1))::INT AS "window" FROM w WHERE len(w) > 0)
        SELECT doc_id, "window", len(list_slice(w, "window" * 384 + 1, "window" * 384 + 384))::INT AS words,
               md5(array_to_string(list_slice(w, "window" * 384 + 1, "window" * 384 + 384), ' ')) AS digest FROM s""",
    "retrieval_dense": f"""
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_USABLE}),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COSINE.format(a="a.e", b="b.e")}, 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
    "retrieval_routes": r"""
        SELECT CASE WHEN regexp_matches(q, '\b(compare|versus|vs|difference between|contradict\w*)\b') THEN 'compare'
                    WHEN regexp_matches(q, '\b(list|which|all|every|each)\b') THEN 'list'
                    WHEN regexp_matches(q, '\b(how much|how many|how large|total|sum|average|growth|ratio|percent\w*|cagr|amount)\b|%') THEN 'numeric'
                    ELSE 'lookup' END AS route, count(*) AS questions
        FROM (SELECT DISTINCT qa_id, lower(question) AS q FROM rag_eval_nollm) GROUP BY 1""",
}
