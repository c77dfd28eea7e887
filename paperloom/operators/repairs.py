"""Repairs of recognised text, quality signals, table headers, document types, questions to ask and recovery verdicts.

Everything is native. Null texts give null or no signal; copies of a row count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import finance as M
from paperloom.sources.tables import read_table

# Words that speak for a kind of document, file-name words and what they add.
TYPE_WORDS = {
    "financial_statement": "balance sheet|statement of profit|profit and loss|cash flow|audited|financial statements|independent auditor|total assets|shareholders' equity|income statement",
    "cim": "confidential information memorandum|investment highlights|executive summary|management presentation|company overview|transaction overview",
    "contract": "agreement|hereinafter|whereas|governing law|termination|indemnif|change of control|representations and warranties|this deed",
    "debt_schedule": "debt schedule|maturity|term loan|revolver|facility|tranche|borrowings|repayment schedule|covenant",
    "bank_statement": "bank statement|opening balance|closing balance|withdrawal|deposit|account number",
}
NAME_WORDS = {"contract": ("agreement|contract|deed|indenture", 4), "debt_schedule": ("debt_schedule|debt schedule|maturity", 4), "financial_statement": ("audited|financial_statement|financials|annual_report", 4)}
SUPERSCRIPT = ("0123456789+-n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ")
SEVERITY = ("high", "medium", "low")


def document_type(text: Column, name: Column, file_type: Column) -> Column:
    """Kind with the most words (file-name words count more), if two or more; else by file type. Ties go to the first kind."""
    hay = F.lower(F.concat_ws(" ", name, text))
    scores = []
    for kind, pattern in TYPE_WORDS.items():
        score = F.regexp_count(hay, F.lit(pattern))
        if kind in NAME_WORDS:
            words, more = NAME_WORDS[kind]
            score = score + F.when(F.lower(name).rlike(words), more).otherwise(0)
        elif kind == "cim":
            score = score + F.when(F.lower(name).rlike(r"(?:^|[^a-z])cim(?:[^a-z]|$)"), 3).otherwise(0)
        scores.append(F.struct(F.coalesce(score, F.lit(0)).alias("s"), F.lit(-len(scores)).alias("o"), F.lit(kind).alias("k")))
    best = F.array_max(F.array(*scores))
    return F.when(best["s"] >= 2, best["k"]).when(file_type == "pptx", "presentation").when(file_type == "xlsx", "spreadsheet").otherwise("other")


def repair_types(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents", "doc_id", "text", "filename", "file_type")
    return rows.groupBy(document_type(F.col("text"), F.coalesce("filename", F.lit("")), F.col("file_type")).alias("kind")).agg(F.count(F.lit(1)).alias("documents"))


def trim_repetition(text: Column, most: int = 3) -> Column:
    """Text without the lines of a run beyond ``most`` equal ones."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: (i < most) | (F.trim(x) == "") | ~F.forall(F.sequence(F.lit(1), F.lit(most)), lambda k: F.get(lines, i - k) == x))
    return F.array_join(kept, "\n")


def punctuation_spacing(text: Column) -> Column:
    """No blank before a mark, one after it, numbers and addresses left alone."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+([,.;:!?])(?=\s|$)", "$1"), r"([,;:!?])(?=\p{L}{2})(?<!\d.)", "$1 ")


def superscripts(text: Column) -> Column:
    """Bare powers such as x^2 or 10^{-3} in Unicode: digits behind a caret, braces dropped."""
    marked = F.regexp_replace(text, r"(?<=[\p{L}\d)])\^\{?([+-]?\d{1,3})\}?", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    first = F.get(parts, F.lit(0))

    def raised(p: Column) -> Column:
        return F.concat(F.translate(F.substring_index(p, "\u0002", 1), *SUPERSCRIPT), F.substring_index(p, "\u0002", -1))

    return F.concat(first, F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), raised), ""))


def quality_flags(text: Column) -> Column:
    """Signals that a page should be read again: repeated long paragraphs, repeated short lines, unbalanced formulas, illegible marks."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= 40)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(1, 39))

    def most_equal(items: Column) -> Column:
        ordered = F.array_sort(items)
        zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

        def step(acc: Column, x: Column) -> Column:
            run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
            return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

        return F.aggregate(ordered, zero, step)["most"]

    dollars = F.regexp_count(F.regexp_replace(text, r"\\\$|\$[ \d]", ""), F.lit(r"\$"))
    flags = F.array(
        F.when(most_equal(paragraphs) >= 3, "repeated_paragraph"), F.when(most_equal(lines) >= 15, "repeated_line"),
        F.when((dollars % 2 == 1) | (F.regexp_count(text, F.lit(r"\\begin\{")) != F.regexp_count(text, F.lit(r"\\end\{"))), "unbalanced_formula"),
        F.when(text.rlike(r"(?i)\[(?:illegible|unreadable|unclear)\]|�"), "illegible"),
    )
    return F.array_compact(flags)


def repair_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents", "doc_id", "text").filter("text is not null")
    return rows.select("doc_id", F.explode(quality_flags(F.col("text"))).alias("flag"))


def repair_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that lose lines to repetition, with the number lost."""
    rows = read_table(spark, folder, "documents", "doc_id", "text").filter("text is not null").withColumn("kept", trim_repetition(F.col("text")))
    lost = F.size(F.split("text", "\n")) - F.size(F.split("kept", "\n"))
    return rows.select("doc_id", lost.alias("lines_lost")).filter("lines_lost > 0")


def header_rows(cells: DataFrame, table: str = "table_id") -> DataFrame:
    """Leading rows (1 to 3) before the first one with a number: ``table_id, header_rows``."""
    numeric = cells.groupBy(table, "row_idx").agg(F.bool_or(M.financial_number(F.col("raw")).isNotNull()).alias("n"))
    first = numeric.groupBy(table).agg(F.min(F.when(F.col("n"), F.col("row_idx"))).alias("first"))
    return first.select(table, F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce("first", F.lit(1)))).alias("header_rows"))


def merged_spans(cells: DataFrame, table: str = "table_id") -> DataFrame:
    """Runs of a filled cell and the null cells right of it in one row: ``table_id, row_idx, col_idx, span``."""
    order = Window.partitionBy(table, "row_idx").orderBy("col_idx")
    start = F.sum(F.col("raw").isNotNull().cast("int")).over(order)
    runs = cells.withColumn("run", start).filter("run > 0").groupBy(table, "row_idx", "run").agg(F.min("col_idx").alias("col_idx"), F.count(F.lit(1)).alias("span"))
    return runs.filter("span > 1").drop("run")


def repair_spans(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.operators.grids import cells, tables_and_literals

    return merged_spans(cells(tables_and_literals(spark, folder)).select("table_id", "row_idx", "col_idx", "raw"))


def seller_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered questions of each workspace from contradictions, totals, missing references and unreadable blocks, worst first."""
    from paperloom.operators import grids

    rows = grids.cells(grids.tables(spark, folder))
    found = grids.contradictions(grids.facts(rows)).select(
        "workspace_id", "severity", F.concat(F.lit("Which figure is right for "), "concept", F.lit(" in "), "period", F.lit("?")).alias("question")
    )
    rooms = rows.select("table_id", "workspace_id").distinct()
    totals = grids.total_checks(rows).filter("not holds").join(rooms, "table_id").select(
        "workspace_id", F.lit("high").alias("severity"), F.concat(F.lit("Why does the total of table "), "table_id", F.lit(" not add up?")).alias("question")
    )
    missing = grids.diligence_missing(spark, folder).select("workspace_id", F.lit("medium").alias("severity"), F.concat(F.lit("Please provide "), "label", F.lit(".")).alias("question"))
    unsure = read_table(spark, folder, "chunks", "chunk_id", "workspace_id", "kind", "min_confidence").distinct().filter("kind = 'table' and min_confidence < 0.6")
    unsure = unsure.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")).select(
        "workspace_id", F.lit("low").alias("severity"), F.concat(F.lit("Please send clearer copies of "), F.col("n").cast("string"), F.lit(" tables.")).alias("question")
    )
    every = reduce(DataFrame.unionByName, [found, totals, missing, unsure]).distinct()
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITY)), F.col("severity"))
    return every.withColumn("number", F.row_number().over(Window.partitionBy("workspace_id").orderBy(rank, "question")))


def recovery_verdict(original: Column, candidate: Column) -> Column:
    """Which reading the source supports: recall of at least 0.98; unknown recalls decide nothing."""
    a, b = F.coalesce(original >= 0.98, F.lit(False)), F.coalesce(candidate >= 0.98, F.lit(False))
    return F.when(a & b, "both").when(b, "candidate").when(a, "original").otherwise("inconclusive")


def repair_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """Text and index text of each section chunk as two readings of its document: which of them its words support."""
    from paperloom.functions.text import content_words

    rows = read_table(spark, folder, "chunks", "chunk_id", "doc_id", "kind", "text", "embed_text").filter("kind = 'section'").distinct()
    docs = read_table(spark, folder, "documents", "doc_id", "text").withColumnRenamed("text", "source")
    both = rows.join(docs.filter("source is not null"), "doc_id")
    have = F.array_distinct(content_words(F.col("source")))

    def share(text: str) -> Column:
        words = F.array_distinct(content_words(F.col(text)))
        return F.when(F.size(words) > 0, F.size(F.array_intersect(words, have)) / F.size(words))

    return both.groupBy(recovery_verdict(share("text"), share("embed_text")).alias("verdict")).agg(F.count(F.lit(1)).alias("chunks"))


def suggested_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Up to four questions a document, from its facts: one a concept, the latest period first."""
    from paperloom.operators import grids

    found = grids.facts(grids.cells(grids.tables(spark, folder))).withColumn("k", M.period_key(F.col("period")))
    latest = found.groupBy("doc_id", "concept").agg(F.max_by("period", "k").alias("period"), F.max("k").alias("k"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("k"), "concept")
    text = F.concat(F.lit("What was "), F.replace("concept", F.lit("_"), F.lit(" ")), F.lit(" in "), "period", F.lit("?"))
    return latest.withColumn("place", F.row_number().over(order)).filter("place <= 4").select("doc_id", "place", text.alias("question"))


QUERIES = {f.__name__: f for f in (repair_types, repair_flags, repair_repetition, repair_spans, repair_recovery, seller_questions, suggested_questions)}

from paperloom.operators.grids import _FACTS, _MORE_CELLS  # noqa: E402



def _type_scores() -> str:
    parts = []
    for n, (kind, pattern) in enumerate(TYPE_WORDS.items()):
        score = f"len(regexp_extract_all(hay, '{pattern.replace(chr(39), chr(39) * 2)}'))"
        if kind in NAME_WORDS:
            score += f" + CASE WHEN regexp_matches(lower(name), '{NAME_WORDS[kind][0]}') THEN {NAME_WORDS[kind][1]} ELSE 0 END"
        elif kind == "cim":
            score += " + CASE WHEN regexp_matches(lower(name), '(?:^|[^a-z])cim(?:[^a-z]|$)') THEN 3 ELSE 0 END"
        parts.append(f"{{'s': {score}, 'o': {-n}, 'k': '{kind}'}}")
    return "list_max([" + ", ".join(parts) + "])"


_KNOWN = "list_distinct(regexp_extract_all(lower(replace({0}, 'İ', 'i' || chr(775))), '\\p{{N}}[\\p{{N}}.,]*\\p{{N}}|[\\p{{L}}\\p{{N}}]+'))"
ORACLE = {
    "repair_types": f"""
        WITH d AS (SELECT coalesce(filename, '') AS name, file_type, lower(concat_ws(' ', coalesce(filename, ''), text)) AS hay FROM documents), b AS (SELECT file_type, {_type_scores()} AS best FROM d)
        SELECT CASE WHEN best.s >= 2 THEN best.k WHEN file_type = 'pptx' THEN 'presentation' WHEN file_type = 'xlsx' THEN 'spreadsheet' ELSE 'other' END AS kind, count(*) AS documents FROM b GROUP BY 1""",
    "repair_recovery": f"""
        WITH c AS (SELECT DISTINCT chunk_id, doc_id, text, embed_text FROM chunks WHERE kind = 'section'),
        w AS (SELECT {_KNOWN.format("c.text")} AS a, {_KNOWN.format("c.embed_text")} AS b, {_KNOWN.format("d.text")} AS s FROM c JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL),
        r AS (SELECT CASE WHEN len(a) > 0 THEN len(list_intersect(a, s)) / len(a) END AS a, CASE WHEN len(b) > 0 THEN len(list_intersect(b, s)) / len(b) END AS b FROM w)
        SELECT CASE WHEN a >= 0.98 AND b >= 0.98 THEN 'both' WHEN b >= 0.98 THEN 'candidate' WHEN a >= 0.98 THEN 'original' ELSE 'inconclusive' END AS verdict, count(*) AS chunks FROM r GROUP BY 1""",
    "repair_spans": _MORE_CELLS + """, r AS (SELECT table_id, row_idx::INT AS row_idx, col_idx::INT AS col_idx, sum((raw IS NOT NULL)::INT) OVER (PARTITION BY table_id, row_idx ORDER BY col_idx) AS run FROM cells)
        SELECT table_id, row_idx, min(col_idx) AS col_idx, count(*) AS span FROM r WHERE run > 0 GROUP BY table_id, row_idx, run HAVING count(*) > 1""",
    "suggested_questions": _FACTS + """, newest AS (SELECT doc_id, concept, arg_max(period, substr(period, 3)::INT) AS period, max(substr(period, 3)::INT) AS k FROM facts GROUP BY ALL)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, concept)::INT AS place, 'What was ' || replace(concept, '_', ' ') || ' in ' || period || '?' AS question FROM newest QUALIFY place <= 4""",
}
