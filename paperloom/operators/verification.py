"""Independent verification: text and cell differences, one-to-one matching, order, integrity rules and rollup.

Evidence is compared as multisets unless order matters. A status is never better
than its worst unit; what was only guessed at is never "verified".
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import content_words
from paperloom.operators.layout import _BLOCKS, _VALID, blocks, valid_box
from paperloom.sources.tables import read_table

#: Statuses from best to worst (fixed values).
STATUSES = ("verified", "recovered", "not_verifiable", "review", "failed")
RANK = {s: k for k, s in enumerate(STATUSES)}


def word_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, F.explode(content_words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def multiset_difference(source: DataFrame, output: DataFrame, key: str) -> DataFrame:
    """``missing``, ``extra``, ``kept`` words of each key from two frames of word counts."""
    a, b = source.withColumnRenamed("n", "a"), output.withColumnRenamed("n", "b")
    both = a.join(b, [key, "word"], "full_outer").fillna(0, ["a", "b"])
    return both.groupBy(key).agg(
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra"),
        F.sum(F.least("a", "b")).alias("kept"), F.sum("a").alias("words"),
        F.sum(F.when(F.col("word").rlike(r"\d"), F.greatest(F.col("a") - F.col("b"), F.lit(0))).otherwise(0)).alias("missing_numbers"),
    )


def severity(lost: Column, extra: Column, numbers: Column) -> Column:
    return F.when(numbers > 0, "high").when(lost >= 0.30, "high").when(lost > 0, "medium").when(extra >= 0.10, "low").otherwise("none")


def verify_content(spark: SparkSession, folder: str) -> DataFrame:
    """Words of a document's text against the words of its chunks."""
    docs = read_table(spark, folder, "documents", "doc_id", "text").filter("text is not null")
    parts = read_table(spark, folder, "chunks", "chunk_id", "doc_id", "kind", "text").filter("kind = 'section'").distinct()
    source = word_counts(docs.join(parts.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "text")
    diff = multiset_difference(source, word_counts(parts, "doc_id", "text"), "doc_id").filter("words > 0")
    lost, extra = F.col("missing") / F.col("words"), F.col("extra") / F.col("words")
    return diff.select("doc_id", "words", "kept", "missing", "extra", F.round(F.col("kept") / F.col("words"), 6).alias("recall"), severity(lost, extra, F.col("missing_numbers")).alias("severity"))


def verify_embed(spark: SparkSession, folder: str) -> DataFrame:
    """Words of a chunk's text that its index text lost, per chunk, worst first cases only."""
    rows = read_table(spark, folder, "chunks", "chunk_id", "text", "embed_text").distinct()
    diff = multiset_difference(word_counts(rows, "chunk_id", "text"), word_counts(rows, "chunk_id", "embed_text"), "chunk_id")
    return diff.filter("missing > 0").select("chunk_id", "words", "missing", "missing_numbers")


def assign(pairs: DataFrame, group: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """Best-first one-to-one pairs within each group, ties by (left, right).

    A pair that is best for both its sides is taken; the rest is asked again in
    the same task. Groups are pages or documents, small by nature.
    """
    kind = dict(pairs.dtypes)

    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part[score] >= least].sort_values([score, left, right], ascending=[False, True, True])
        a, b, keep = set(), set(), []
        for i, x, y in zip(part.index, part[left], part[right]):
            if x not in a and y not in b:
                a.add(x), b.add(y), keep.append(i)
        return part.loc[keep]

    chosen = pairs.select(group, left, right, score)
    return chosen.groupBy(group).applyInPandas(greedy, ", ".join(f"{c} {kind[c]}" for c in (group, left, right, score)))


def verify_assign(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraph blocks of a document against its section chunks: shared words over all, one to one."""
    rows = blocks(spark, folder).filter("type = 'paragraph'").select("doc_id", "block_id", F.array_distinct(content_words(F.col("content"))).alias("bw")).filter("size(bw) >= 5")
    parts = read_table(spark, folder, "chunks", "chunk_id", "doc_id", "kind", "text").filter("kind = 'section'").distinct()
    # Block and chunk meet on the words that they share; those that share none are never a pair.
    ours = rows.select("doc_id", "block_id", F.size("bw").alias("n"), F.explode("bw").alias("word"))
    theirs = parts.select("doc_id", "chunk_id", F.explode(F.array_distinct(content_words(F.col("text")))).alias("word")).distinct()
    met = ours.join(theirs, ["doc_id", "word"]).groupBy("doc_id", "block_id", "n", "chunk_id").agg(F.count(F.lit(1)).alias("common"))
    scored = met.withColumn("score", F.round(F.col("common") / F.col("n"), 6)).filter("score >= 0.3")
    return assign(scored, "doc_id", "block_id", "chunk_id", "score", 0.3)


def displaced(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Number of rows of each group outside a longest increasing run of ``value`` in ``order``."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_left

        seq = part.sort_values(order, kind="stable")[value].tolist()
        tails: list = []
        for v in seq:
            k = bisect_left(tails, v)
            tails[k : k + 1] = [v]
        return pd.DataFrame({group: [key[0]], "rows": [len(seq)], "displaced": [len(seq) - len(tails)]})

    kind = dict(rows.dtypes)[group]
    return rows.select(group, order, value).groupBy(group).applyInPandas(run, f"{group} {kind}, rows int, displaced int")


def verify_order(spark: SparkSession, folder: str) -> DataFrame:
    """Stored reading order against the order that geometry gives."""
    from paperloom.operators.layout import reading_order

    rows = reading_order(blocks(spark, folder)).filter("reading_order is not null").select("doc_id", "position", "reading_order")
    return displaced(rows, "doc_id", "position", "reading_order")


def integrity(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, item, code, severity`` of the rules over one extraction; each rule is a projection, the rest one union."""
    same = Window.partitionBy("doc_id", "block_id")
    order = Window.partitionBy("doc_id").orderBy("ord", "block_id")
    marked = rows.withColumn("copies", F.count(F.lit(1)).over(same)).withColumn("before", F.lag("reading_order").over(order)).withColumn("last", F.lag("content").over(order))
    marked = marked.withColumn("order_copies", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "reading_order")))
    content = F.col("content")
    rules = (
        ("duplicate_block_id", "high", F.col("copies") > 1),
        ("missing_required_field", "high", content.isNull() & ~F.col("type").isin("figure", "chart")),
        ("invalid_page_reference", "high", F.coalesce(F.col("page") < 1, F.lit(True))),
        ("empty_content", "medium", F.trim(content) == ""),
        ("control_characters", "medium", content.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")),
        ("replacement_character", "medium", content.contains("�")),
        ("invalid_bbox", "medium", F.col("bbox").isNotNull() & ~valid_box(F.col("bbox"))),
        ("missing_bbox", "info", F.col("bbox").isNull()),
        ("invalid_confidence", "medium", ~F.col("confidence").between(0, 1)),
        ("missing_confidence", "info", F.col("confidence").isNull()),
        ("review_requested", "low", F.col("requires_review")),
        ("missing_reading_order", "low", F.col("reading_order").isNull()),
        ("duplicate_reading_order", "low", F.col("reading_order").isNotNull() & (F.col("order_copies") > 1)),
        ("reading_order_not_monotonic", "low", F.col("reading_order") < F.col("before")),
        ("adjacent_repeat", "low", (content == F.col("last")) & (F.length(content) >= 12)),
        ("unknown_type", "low", ~F.col("type").isin("heading", "paragraph", "list", "table", "figure", "chart", "equation", "header", "footer", "unknown")),
    )
    if "heading_level" in rows.columns:
        rules += (("malformed_metadata", "medium", (F.col("type") == "heading") & ~F.col("heading_level").between(1, 6)),)
    # One pass over the blocks: every row tests all rules, then only hits are kept.
    hits = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for code, level, test in rules)))
    found = marked.select("doc_id", F.col("block_id").alias("item"), F.explode(hits).alias("h")).select("doc_id", "item", "h.code", "h.severity")
    kept = rows.select("doc_id").distinct()
    known = documents.join(kept, "doc_id", "left_semi")
    pages = rows.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    beyond = known.join(pages, "doc_id").filter("page_count is null or page_count < 1 or last_page > page_count")
    return found.unionByName(beyond.select("doc_id", F.col("doc_id").cast("string").alias("item"), F.lit("invalid_page_count").alias("code"), F.lit("high").alias("severity")))


def verify_integrity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "page_count")
    return integrity(blocks(spark, folder), docs).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("doc_id").alias("documents"))


def decide(issues: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Status of each unit by its worst issue; a unit without evidence is not verifiable."""
    worst = issues.groupBy(key).agg(
        F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"), F.count_if(F.col("severity") == "low").alias("low")
    )
    rows = units.join(worst, key, "left").fillna(0, ["high", "medium", "low"])
    status = F.when(F.col("high") > 0, "failed").when(F.col("medium") > 0, "review").when(F.col("evidence") == 0, "not_verifiable").when(F.col("low") > 0, "recovered")
    return rows.withColumn("status", status.otherwise("verified"))


def worst_status(statuses: Column) -> Column:
    """Aggregate: the worst of statuses."""
    rank = F.create_map(*(F.lit(x) for s, k in RANK.items() for x in (s, k)))
    return F.max_by(statuses, rank[statuses])


def empty_units(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, item, code, severity``: pages of a document with blocks that hold none."""
    pages = rows.groupBy("doc_id").agg(F.collect_set("page").alias("pages"))
    known = documents.filter("page_count >= 1").join(pages, "doc_id")
    lost = known.select("doc_id", F.explode(F.array_except(F.sequence(F.lit(1), F.col("page_count")), "pages")).alias("page"))
    return lost.select("doc_id", page_unit(F.col("page")).alias("item"), F.lit("unit_without_blocks").alias("code"), F.lit("low").alias("severity"))


def page_unit(page: Column) -> Column:
    return F.concat_ws(":", "doc_id", page)


def roll_up(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """``doc_id, unit, evidence, high, medium, low, status`` of every unit; no issue is lost.

    The units are the pages with blocks, the pages without and, for issues that belong
    to no block (their item is a document or a page), the document or page they name.
    """
    place = rows.select("doc_id", F.col("block_id").alias("item"), page_unit(F.col("page")).alias("unit")).distinct()
    placed = issues.join(place, ["doc_id", "item"], "left").select("doc_id", F.coalesce("unit", "item").alias("unit"), "severity")
    pages = rows.groupBy("doc_id", page_unit(F.col("page")).alias("unit")).agg(F.count_if(F.col("bbox").isNotNull()).alias("evidence"))
    named = placed.select("doc_id", "unit", F.lit(0).cast("bigint").alias("evidence"))
    units = pages.unionByName(named).groupBy("doc_id", "unit").agg(F.max("evidence").alias("evidence"))
    return decide(placed.select("unit", "severity"), units, "unit")


def verify_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Units decided by their issues, documents by their worst unit."""
    rows = blocks(spark, folder)
    documents = read_table(spark, folder, "documents", "doc_id", "page_count")
    decided = roll_up(rows, integrity(rows, documents).unionByName(empty_units(rows, documents)))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return decided.groupBy("doc_id").agg(worst_status(F.col("status")).alias("status"), F.count(F.lit(1)).alias("units"), *counts)


def verify_grounding(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of the answers that the question already states, per question type (the sign is ignored)."""
    rows = read_table(spark, folder, "rag_eval_nollm", "qa_id", "qtype", "question", "deallens").distinct()
    digits = r"(\d[\d,]*(?:\.\d+)?)"

    def numbers(text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(digits), F.lit(1)), lambda t: F.replace(t, F.lit(",")).try_cast("double"))

    claims = rows.select("qtype", F.explode(numbers(F.col("deallens.text"))).alias("claim"), numbers(F.col("question")).alias("pool"))
    close = F.exists("pool", lambda p: F.abs(p - F.col("claim")) <= F.greatest(F.lit(1e-9), 1e-6 * F.greatest(F.abs(p), F.abs("claim"))))
    return claims.groupBy("qtype").agg(F.count(F.lit(1)).alias("claims"), F.count_if(close).alias("supported"))


QUERIES = {f.__name__: f for f in (verify_content, verify_embed, verify_assign, verify_order, verify_integrity, verify_rollup, verify_grounding)}

_W = "unnest(regexp_extract_all(lower(replace({0}, 'İ', 'i' || chr(775))), '\\p{{N}}[\\p{{N}}.,]*\\p{{N}}|[\\p{{L}}\\p{{N}}]+'))"
_DIFF = """f AS (SELECT {k}, word, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING ({k}, word)),
    g AS (SELECT {k}, sum(greatest(x - y, 0)) AS missing, sum(greatest(y - x, 0)) AS extra, sum(least(x, y)) AS kept, sum(x) AS words,
          sum(CASE WHEN regexp_matches(word, '\\d') THEN greatest(x - y, 0) ELSE 0 END) AS missing_numbers FROM f GROUP BY {k})"""
_RULES = (
    ("duplicate_block_id", "high", "copies > 1"), ("missing_required_field", "high", "content IS NULL AND type NOT IN ('figure', 'chart')"), ("invalid_page_reference", "high", "coalesce(page < 1, true)"),
    ("empty_content", "medium", "trim(content) = ''"), ("control_characters", "medium", "regexp_matches(content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')"), ("replacement_character", "medium", "contains(content, '\ufffd')"),
    ("invalid_bbox", "medium", f"bbox IS NOT NULL AND NOT {_VALID}"), ("missing_bbox", "info", "bbox IS NULL"), ("invalid_confidence", "medium", "NOT confidence BETWEEN 0 AND 1"),
    ("missing_confidence", "info", "confidence IS NULL"), ("review_requested", "low", "requires_review"), ("missing_reading_order", "low", "reading_order IS NULL"),
    ("duplicate_reading_order", "low", "reading_order IS NOT NULL AND order_copies > 1"), ("reading_order_not_monotonic", "low", "reading_order < before"),
    ("adjacent_repeat", "low", "content = last AND length(content) >= 12"), ("malformed_metadata", "medium", "type = 'heading' AND NOT heading_level BETWEEN 1 AND 6"),
    ("unknown_type", "low", "type NOT IN ('heading', 'paragraph', 'list', 'table', 'figure', 'chart', 'equation', 'header', 'footer', 'unknown')"),
)
_ISSUES = (
    _BLOCKS + """, x AS (SELECT doc_id, block_id, (json->>'reading_order')::INT AS reading_order, (json->>'requires_review')::BOOLEAN AS requires_review,
              try_cast(json->'metadata'->>'heading_level' AS DOUBLE)::INT AS heading_level FROM ok WHERE json->>'type' IS NOT NULL),
    m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, block_id) AS copies, count(*) OVER (PARTITION BY doc_id, reading_order) AS order_copies,
              lag(reading_order) OVER w AS before, lag(content) OVER w AS last FROM b JOIN x USING (doc_id, block_id) WINDOW w AS (PARTITION BY doc_id ORDER BY ord, block_id)),
    known AS (SELECT doc_id, page_count, max(page) AS last_page, list(DISTINCT page) AS pages FROM m JOIN documents USING (doc_id) GROUP BY ALL),
    issues AS ("""
    + " UNION ALL ".join(f"SELECT doc_id, doc_id || ':' || page AS unit, '{code}' AS code, '{level}' AS severity FROM m WHERE {test}" for code, level, test in _RULES)
    + " UNION ALL SELECT doc_id, doc_id::VARCHAR, 'invalid_page_count', 'high' FROM known WHERE page_count IS NULL OR page_count < 1 OR last_page > page_count)"
)
ORACLE = {
    "verify_integrity": _ISSUES + " SELECT code, severity, count(*) AS issues, count(DISTINCT doc_id) AS documents FROM issues GROUP BY ALL",
    "verify_rollup": _ISSUES + """, every AS (FROM issues UNION ALL SELECT doc_id, doc_id || ':' || page, 'unit_without_blocks', 'low'
             FROM (SELECT doc_id, pages, unnest(range(1, page_count + 1)) AS page FROM known WHERE page_count >= 1) WHERE NOT list_contains(pages, page::INT)),
        units AS (SELECT doc_id, unit, max(evidence) AS evidence FROM (SELECT doc_id, doc_id || ':' || page AS unit, count(bbox) AS evidence FROM m GROUP BY ALL UNION ALL SELECT doc_id, unit, 0 FROM every) GROUP BY ALL),
        worst AS (SELECT unit, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM every GROUP BY unit),
        d AS (SELECT doc_id, CASE WHEN high > 0 THEN 4 WHEN medium > 0 THEN 3 WHEN evidence = 0 THEN 2 WHEN low > 0 THEN 1 ELSE 0 END AS rank FROM units LEFT JOIN worst USING (unit))
        SELECT doc_id, ['verified', 'recovered', 'not_verifiable', 'review', 'failed'][max(rank) + 1] AS status, count(*) AS units, count(*) FILTER (rank = 0) AS verified,
               count(*) FILTER (rank = 1) AS recovered, count(*) FILTER (rank = 2) AS not_verifiable, count(*) FILTER (rank = 3) AS review, count(*) FILTER (rank = 4) AS failed FROM d GROUP BY doc_id""",
    "verify_content": f"""
        WITH c AS (SELECT DISTINCT chunk_id, doc_id, text FROM chunks WHERE kind = 'section'),
        a AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {_W.format("text")} AS word FROM documents WHERE doc_id IN (SELECT doc_id FROM c)) GROUP BY ALL),
        b AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {_W.format("text")} AS word FROM c) GROUP BY ALL),
        {_DIFF.format(k="doc_id")}
        SELECT doc_id, words, kept, missing, extra, round(kept / words, 6) AS recall, CASE WHEN missing_numbers > 0 THEN 'high' WHEN missing / words >= 0.3 THEN 'high'
               WHEN missing / words > 0 THEN 'medium' WHEN extra / words >= 0.1 THEN 'low' ELSE 'none' END AS severity FROM g WHERE words > 0""",
    "verify_embed": f"""
        WITH c AS (SELECT DISTINCT chunk_id, text, embed_text FROM chunks),
        a AS (SELECT chunk_id, word, count(*) AS n FROM (SELECT chunk_id, {_W.format("text")} AS word FROM c) GROUP BY ALL),
        b AS (SELECT chunk_id, word, count(*) AS n FROM (SELECT chunk_id, {_W.format("embed_text")} AS word FROM c) GROUP BY ALL),
        {_DIFF.format(k="chunk_id")} SELECT chunk_id, words, missing, missing_numbers FROM g WHERE missing > 0""",
    "verify_grounding": """
        WITH r AS (SELECT DISTINCT qa_id, qtype, question, deallens.text AS t FROM rag_eval_nollm),
        n AS (SELECT qtype, unnest(list_transform(regexp_extract_all(t, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))) AS claim,
                     list_transform(regexp_extract_all(question, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)) AS pool FROM r)
        SELECT qtype, count(*) AS claims, count(*) FILTER (len(list_filter(pool, lambda p: abs(p - claim) <= greatest(1e-9, 1e-6 * greatest(abs(p), abs(claim))))) > 0) AS supported
        FROM n GROUP BY qtype""",
}
