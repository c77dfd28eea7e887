"""Evaluation: judging, rates by subset, macro averages, run comparison, sampling, shards and logs.

Null judgements are left out of rates, not counted as failures. Copies of a row count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.sources.tables import read_table


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """One row a question and pipeline."""
    rows = read_table(spark, folder, "rag_eval_nollm").distinct()
    sides = F.array(
        *(
            F.struct(
                F.lit(side).alias("pipeline"), F.col(f"{side}.judge.pass").alias("passed"), F.col(f"{side}.judge.cited_ok").alias("cited"),
                F.col(f"{side}.judge.retrieved_ok").alias("retrieved"), F.col(f"{side}.ms").alias("ms"), F.col(f"{side}.text").alias("text"),
            )
            for side in ("baseline", "deallens")
        )
    )
    out = rows.select("qa_id", "data_room", "question_no", "qtype", "asked_at", F.explode(sides).alias("s"))
    return out.select("qa_id", "data_room", "question_no", "qtype", "asked_at", "s.*")


def rate(flag: str) -> Column:
    """Share of true among the known, three decimals; null where nothing is known."""
    return F.round(F.avg(F.col(flag).cast("int")), 3)


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = answers(spark, folder)
    return rows.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("n"), rate("passed").alias("accuracy"), F.round(F.avg(F.when(F.col("qtype") == "numeric", F.col("passed").cast("int"))), 3).alias("numeric"),
        rate("cited").alias("citations"), rate("retrieved").alias("retrieval"), F.round(F.avg(F.when(F.col("qtype") == "unanswerable", F.col("passed").cast("int"))), 3).alias("abstention"),
        F.round(F.avg(F.when(F.col("qtype") == "injection", F.col("passed").cast("int"))), 3).alias("injection"), F.round(F.avg("ms") / 1000, 2).alias("seconds"),
    )


def eval_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Every subset at once: pipeline and type, each alone, and all (grouping sets)."""
    rows = answers(spark, folder)
    return rows.cube("pipeline", "qtype").agg(F.count(F.lit(1)).alias("n"), rate("passed").alias("accuracy"), F.grouping_id().alias("level"))


def eval_macro(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the rates of the types, not of the answers."""
    per = answers(spark, folder).groupBy("pipeline", "qtype").agg(F.avg(F.col("passed").cast("int")).alias("r"))
    return per.groupBy("pipeline").agg(F.round(F.avg("r"), 6).alias("macro"), F.count(F.lit(1)).alias("types"))


def eval_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Case by case: both pass, only one, none, by type."""
    rows = read_table(spark, folder, "rag_eval_nollm").distinct()
    a = rows.select("qa_id", "qtype", F.col("baseline.judge.pass").alias("a")).filter("a is not null")
    b = rows.select("qa_id", F.col("deallens.judge.pass").alias("b")).filter("b is not null")
    both = a.join(b, "qa_id", "full_outer")
    change = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a") & F.col("b"), "fixed").when(F.col("a") & ~F.col("b"), "broken")
        .when(F.col("a"), "both_pass").otherwise("both_fail")
    )
    return both.groupBy("qtype", change.alias("change")).agg(F.count(F.lit(1)).alias("cases"))


def eval_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Median and 95th percentile by pipeline, exact."""
    return answers(spark, folder).filter("ms is not null").groupBy("pipeline").agg(
        F.round(F.percentile("ms", 0.5), 3).alias("p50"), F.round(F.percentile("ms", 0.95), 3).alias("p95"), F.max("ms").alias("longest")
    )


def eval_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of each month and its change on the month before."""
    rows = answers(spark, folder).filter("pipeline = 'deallens' and passed is not null")
    per = rows.groupBy(F.date_format("asked_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("accuracy"))
    return per.withColumn("change", F.round(F.col("accuracy") - F.lag("accuracy").over(Window.orderBy("month")), 6))


def stratified(rows: DataFrame, stratum: str, key: str, per: int, seed: str = "s1") -> DataFrame:
    """``per`` rows of each stratum, by a hash of seed and key: the same rows on any cluster."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(stratum), F.col(key)), 256), key)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per)


def eval_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A sampling operator: twenty questions of each type."""
    rows = read_table(spark, folder, "rag_eval_nollm", "qa_id", "qtype").distinct()
    return stratified(rows, "qtype", "qa_id", 20).select("qtype", "qa_id", "place")


def eval_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each of eight shards, by hash."""
    rows = read_table(spark, folder, "documents", "doc_id")
    shard = F.conv(F.right(F.md5(F.col("doc_id").cast("string")), F.lit(1)), 16, 10).cast("int") % 8
    return rows.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("documents"))


def eval_last(spark: SparkSession, folder: str) -> DataFrame:
    """Latest record of each room and question from an append-only log."""
    rows = read_table(spark, folder, "rag_eval_nollm", "qa_id", "data_room", "question_no", "asked_at").distinct()
    return rows.groupBy("data_room", "question_no").agg(F.max_by("qa_id", F.struct("asked_at", "qa_id")).alias("qa_id"), F.count(F.lit(1)).alias("records"))


def eval_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Reason of each failed answer by an ordered ladder."""
    rows = answers(spark, folder).filter("passed = false")
    text = F.trim(F.coalesce("text", F.lit("")))
    why = (
        F.when(F.col("ms").isNull(), "no_timing").when(F.col("text").isNull(), "no_output").when(text == "", "empty_output")
        .when(F.col("retrieved") == F.lit(False), "not_retrieved").when(F.col("cited") == F.lit(False), "not_cited").otherwise("content_mismatch")
    )
    return rows.groupBy("pipeline", why.alias("reason")).agg(F.count(F.lit(1)).alias("answers"))


def eval_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Order-free fingerprint of the documents: a hash over the sum and the xor of row hashes, no global sort."""
    rows = read_table(spark, folder, "documents", "doc_id", "sha256")
    row = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lower("sha256")))
    h = F.conv(F.left(row, F.lit(15)), 16, 10).cast("bigint")
    both = rows.agg(F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return both.select(F.left(F.sha2(F.concat_ws("|", "x", "s", "n"), 256), F.lit(16)).alias("fingerprint"), F.col("n").alias("documents"))


QUERIES = {
    f.__name__: f
    for f in (
        eval_summary, eval_by_type, eval_macro, eval_compare, eval_latency, eval_trend, eval_sample, eval_shards, eval_last, eval_failures, eval_fingerprint,
    )
}

_SIDES = """
    WITH r AS (SELECT DISTINCT * FROM rag_eval_nollm),
    a AS (SELECT qa_id, qtype, asked_at, 'baseline' AS pipeline, baseline.judge.pass AS passed, baseline.judge.cited_ok AS cited, baseline.judge.retrieved_ok AS retrieved, baseline.ms AS ms, baseline.text AS t FROM r
          UNION ALL SELECT qa_id, qtype, asked_at, 'deallens', deallens.judge.pass, deallens.judge.cited_ok, deallens.judge.retrieved_ok, deallens.ms, deallens.text FROM r)"""
ORACLE = {
    "eval_fingerprint": """
        WITH h AS (SELECT ('0x' || left(md5(concat_ws('|', doc_id, lower(sha256))), 15))::BIGINT AS h FROM documents)
        SELECT left(sha256(concat_ws('|', bit_xor(h), sum(h)::VARCHAR, count(*))), 16) AS fingerprint, count(*) AS documents FROM h""",
    "eval_summary": _SIDES + """ SELECT pipeline, count(*) AS n, round(avg(passed::INT), 3) AS accuracy, round(avg(passed::INT) FILTER (qtype = 'numeric'), 3) AS numeric,
        round(avg(cited::INT), 3) AS citations, round(avg(retrieved::INT), 3) AS retrieval, round(avg(passed::INT) FILTER (qtype = 'unanswerable'), 3) AS abstention,
        round(avg(passed::INT) FILTER (qtype = 'injection'), 3) AS injection, round(avg(ms) / 1000, 2) AS seconds FROM a GROUP BY pipeline""",
    "eval_by_type": _SIDES + """ SELECT pipeline, qtype, count(*) AS n, round(avg(passed::INT), 3) AS accuracy, grouping(pipeline, qtype) AS level FROM a GROUP BY CUBE (pipeline, qtype)""",
    "eval_macro": _SIDES + """, p AS (SELECT pipeline, qtype, avg(passed::INT) AS r FROM a GROUP BY ALL)
        SELECT pipeline, round(avg(r), 6) AS macro, count(*) AS types FROM p GROUP BY pipeline""",
    "eval_compare": """
        WITH r AS (SELECT DISTINCT * FROM rag_eval_nollm), a AS (SELECT qa_id, qtype, baseline.judge.pass AS a FROM r WHERE baseline.judge.pass IS NOT NULL),
        b AS (SELECT qa_id, deallens.judge.pass AS b FROM r WHERE deallens.judge.pass IS NOT NULL)
        SELECT qtype, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN NOT a AND b THEN 'fixed' WHEN a AND NOT b THEN 'broken' WHEN a THEN 'both_pass' ELSE 'both_fail' END AS change,
               count(*) AS cases FROM a FULL JOIN b USING (qa_id) GROUP BY ALL""",
    "eval_latency": _SIDES + " SELECT pipeline, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, max(ms) AS longest FROM a WHERE ms IS NOT NULL GROUP BY pipeline",
    "eval_trend": _SIDES + """, m AS (SELECT strftime(asked_at, '%Y-%m') AS month, count(*) AS n, round(avg(passed::INT), 6) AS accuracy FROM a WHERE pipeline = 'deallens' AND passed IS NOT NULL GROUP BY 1)
        SELECT *, round(accuracy - lag(accuracy) OVER (ORDER BY month), 6) AS change FROM m""",
    "eval_sample": """
        WITH r AS (SELECT DISTINCT qa_id, qtype FROM rag_eval_nollm)
        SELECT qtype, qa_id, row_number() OVER (PARTITION BY qtype ORDER BY sha256(concat_ws('|', 's1', qtype, qa_id)), qa_id) AS place FROM r QUALIFY place <= 20""",
    "eval_shards": "SELECT ('0x' || right(md5(doc_id::VARCHAR), 1))::INT % 8 AS shard, count(*) AS documents FROM documents GROUP BY 1",
    "eval_last": """
        SELECT data_room, question_no, arg_max(qa_id, (asked_at, qa_id)) AS qa_id, count(*) AS records
        FROM (SELECT DISTINCT qa_id, data_room, question_no, asked_at FROM rag_eval_nollm) GROUP BY ALL""",
    "eval_failures": _SIDES + """ SELECT pipeline, CASE WHEN ms IS NULL THEN 'no_timing' WHEN t IS NULL THEN 'no_output' WHEN trim(t, ' ') = '' THEN 'empty_output' WHEN retrieved = false THEN 'not_retrieved'
        WHEN cited = false THEN 'not_cited' ELSE 'content_mismatch' END AS reason, count(*) AS answers FROM a WHERE passed = false GROUP BY ALL""",
}
