"""Problem 4: how distinctive a term is of its record.

Method: positive pointwise mutual information of term and record from joint and
marginal counts, the record's count smoothed by a fractional exponent. Group-bys
and joins only: a record counts its own terms in place (no shuffle), then one
partially aggregated group-by gives the marginals of terms, and one join brings
them back. Rows that cannot qualify are dropped before that join when a least
count or a greatest number of records is asked for; marginals still cover all rows.

Defined cases: null and empty texts have no terms; copies of a row count once;
a term present in a third of all records is pre-aggregated before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import read_table

#: Exponent that damps the weight of large records.
SMOOTHING = 0.75
LEAST_LETTERS = 4


def _runs(terms: Column) -> Column:
    """Array of (term, tf) from sorted terms by run lengths, n log n in the row."""
    n = F.size(terms)
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: (i < n) & ((i == 0) | (F.get(terms, i) != F.get(terms, i - 1))),
    )
    return F.transform(
        F.arrays_zip(starts.alias("a"), F.slice(F.concat(starts, F.array(n)), 2, F.size(starts)).alias("b")),
        lambda s: F.struct(F.get(terms, s["a"]).alias("term"), (s["b"] - s["a"]).alias("tf")),
    )


def joint_counts(df: DataFrame, key: str, text: str, least: int = LEAST_LETTERS) -> DataFrame:
    """``key, term, tf, record_terms`` of every record, copies of a row once."""
    once = df.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_text")).distinct()
    sorted_terms = F.array_sort(F.regexp_extract_all(F.lower("_text"), F.lit(rf"(\p{{L}}{{{least},}})"), F.lit(1)))
    rows = once.select(key, sorted_terms.alias("_terms"))
    # The outer explode keeps the terms from being computed once more below ``distinct``, to drop texts without any.
    rows = rows.select(key, F.size("_terms").alias("record_terms"), F.explode_outer(_runs(F.col("_terms"))).alias("_t")).filter("_t is not null")
    return rows.select(key, F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf"), "record_terms")


def positive_pmi(
    joint: DataFrame,
    key: str,
    *,
    smoothing: float = SMOOTHING,
    least_tf: int = 1,
    least_records: int = 1,
    most_records: int | None = None,
) -> DataFrame:
    """Adds ``records``, ``term_total`` and ``ppmi`` to joint counts.

    ppmi = max(0, ln(p(term, record) / (p(term) * p_s(record)))), where p_s is the
    record's count to the power ``smoothing`` over the sum of all such powers.
    """
    marginals = joint.groupBy("term").agg(F.count(F.lit(1)).alias("records"), F.sum("tf").alias("term_total"))
    totals = (
        joint.groupBy(key).agg(F.first("record_terms").alias("n"))
        .agg(F.sum("n").cast("double").alias("all_terms"), F.sum(F.pow(F.col("n").cast("double"), F.lit(smoothing))).alias("all_powers"))
    )
    if least_records > 1:
        marginals = marginals.filter(F.col("records") >= least_records)
    if most_records is not None:
        marginals = marginals.filter(F.col("records") <= most_records)
    kept = joint.filter(F.col("tf") >= least_tf) if least_tf > 1 else joint
    scored = kept.join(marginals, "term").crossJoin(F.broadcast(totals))  # totals: one row
    ratio = (F.col("tf") * F.col("all_powers")) / (F.col("term_total") * F.pow(F.col("record_terms").cast("double"), F.lit(smoothing)))
    return scored.withColumn("ppmi", F.greatest(F.lit(0.0), F.log(ratio))).drop("all_terms", "all_powers")


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of every chunk with its score."""
    joint = joint_counts(read_table(spark, folder, "chunks", "chunk_id", "text"), "chunk_id", "text")
    return positive_pmi(joint, "chunk_id").select("chunk_id", "term", "tf", "records", F.round("ppmi", 6).alias("ppmi"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    joint = joint_counts(read_table(spark, folder, "chunks", "chunk_id", "text"), "chunk_id", "text")
    return positive_pmi(joint, "chunk_id", least_tf=3, least_records=2, most_records=8).select("chunk_id", "term")


_JOINT = r"""
    WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL),
    t AS (SELECT chunk_id, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i' || chr(775))), '\p{L}{4,}')) AS term FROM c),
    j AS (SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY ALL),
    m AS (SELECT term, count(*) AS records, sum(tf) AS total FROM j GROUP BY term),
    r AS (SELECT chunk_id, sum(tf) AS n FROM j GROUP BY chunk_id),
    s AS (SELECT sum(pow(n, 0.75)) AS powers FROM r)"""

QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores}
ORACLE = {
    "p4_found": _JOINT + " SELECT chunk_id, term FROM j JOIN m USING (term) WHERE tf >= 3 AND records BETWEEN 2 AND 8",
    "p4_scores": _JOINT + """
        SELECT chunk_id, term, CAST(tf AS INTEGER) AS tf, records,
               round(greatest(0.0, ln((tf * powers) / (total * pow(n, 0.75)))), 6) AS ppmi
        FROM j JOIN m USING (term) JOIN r USING (chunk_id) CROSS JOIN s""",
}
