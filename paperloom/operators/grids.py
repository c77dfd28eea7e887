"""Typed table grids in long form, totals, facts and what follows from them.

A grid that cannot be read gives no cells. "First" is always by (table, row,
column) so that representatives are deterministic. Copies of a row count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import finance as M
from paperloom.sources.tables import read_table

GRID = (
    "header_rows int, col_paths array<string>, n_cols int, "
    "rows array<struct<ridx:int,label:string,is_total:boolean,cells:array<struct<raw:string,v:double>>>>"
)
#: Two small tables that stand beside those of the store in checks that nothing there triggers: a debt schedule and a total that is wrong.
LITERAL_TABLES = (
    ("literal-debt", "Debt schedule", 1.0, '{"col_paths": ["Facility", "Amount outstanding", "Maturity"], "rows": [{"label": "Facility A", "is_total": false, "cells": [{"raw": "Facility A"}, {"raw": "50.0", "v": 50.0},'
     ' {"raw": "June 2026"}]}, {"label": "Overdraft", "is_total": false, "cells": [{"raw": "Overdraft"}, {"raw": "32.0", "v": 32.0}, {"raw": "2026"}]}, {"label": "Facility B", "is_total": false, "cells": [{"raw": "Facility B"},'
     ' {"raw": "120.5", "v": 120.5}, {"raw": "2028"}]}, {"label": "Total", "is_total": true, "cells": [{"raw": "Total"}, {"raw": "202.5", "v": 202.5}, {"raw": null}]}]}'),
    ("literal-wrong", "Costs", 1.0, '{"col_paths": ["Item", "Amount"], "rows": [{"label": "Rent", "is_total": false, "cells": [{"raw": "Rent"}, {"raw": "10", "v": 10.0}]}, {"label": "Power", "is_total": false, "cells": [{"raw": "Power"},'
     ' {"raw": "20", "v": 20.0}]}, {"label": "Pay", "is_total": false, "cells": [{"raw": null}, {"raw": null, "v": 30.0}]}, {"label": "Grand total", "is_total": true, "cells": [{"raw": "Grand total"}, {"raw": "65", "v": 65.0}]}]}'),
)
TOTAL = r"(?i)^\s*(?:grand\s+)?total\b"
RELATIVE = 0.005


def tables(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "tables_store").distinct()


def cells(rows: DataFrame) -> DataFrame:
    """One row a value cell (columns from 1), parsed natively."""
    keep = ["table_id", "doc_id", "workspace_id", "title", "page", "unit", "scale", "currency", "statement_kind", "kind"]
    parsed = rows.select(*keep, F.from_json("grid_json", GRID).alias("g")).filter("g.col_paths is not null")
    lines = parsed.select(*keep, "g.col_paths", F.posexplode("g.rows").alias("row_idx", "r"))
    out = lines.select(*keep, "col_paths", "row_idx", "r.label", "r.is_total", F.posexplode("r.cells").alias("col_idx", "c")).filter("col_idx > 0")
    path = F.get("col_paths", F.col("col_idx"))
    return out.select(
        *keep, "row_idx", "col_idx", "label", "is_total", path.alias("col_path"), M.period(path).alias("period"), F.col("c.raw").alias("raw"), F.col("c.v").alias("v")
    )


def tables_and_literals(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame(list(LITERAL_TABLES), "table_id string, title string, scale double, grid_json string")
    return tables(spark, folder).unionByName(rows, allowMissingColumns=True)


def table_cells(spark: SparkSession, folder: str) -> DataFrame:
    rows = cells(tables(spark, folder))
    return rows.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count("v").alias("numbers"), F.round(F.sum("v"), 4).alias("total"), F.max("col_idx").alias("last_col"),
        F.max("row_idx").alias("last_row"),
    )


def table_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Cells whose printed form reads as another number than the stored value."""
    rows = cells(tables(spark, folder)).withColumn("parsed", M.financial_number(F.col("raw")))
    return rows.filter("v is not null and parsed is not null").groupBy("table_id").agg(
        F.count(F.lit(1)).alias("parsed_cells"), F.count_if(F.abs(F.col("parsed") - F.col("v")) > 1e-9).alias("differing")
    )


def table_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Deterministic description: title, columns and first labels."""
    parsed = tables(spark, folder).select("table_id", "title", "unit", "currency", F.from_json("grid_json", GRID).alias("g")).filter("g.col_paths is not null")
    labels = F.slice(F.filter("g.rows.label", lambda x: x.isNotNull()), 1, 12)
    text = F.concat_ws(
        " ", F.concat(F.lit("Table: "), F.coalesce("title", F.lit("untitled")), F.lit(".")), F.concat(F.lit("Columns: "), F.array_join("g.col_paths", ", "), F.lit(".")),
        F.concat(F.lit("Rows: "), F.array_join(labels, ", "), F.lit(".")), F.concat(F.lit("Unit: "), F.concat_ws(" ", "currency", "unit"), F.lit(".")),
    )
    return parsed.select("table_id", text.alias("summary"))


def total_checks(rows: DataFrame) -> DataFrame:
    """Stated totals that differ from the sum of the rows above them, since the total before.

    Tolerance: half the last decimal times the root of the number of rows, or 0.05 %; three rows at least.
    """
    order = Window.partitionBy("table_id", "col_idx").orderBy("row_idx")
    is_sum = F.coalesce(F.col("is_total"), F.lit(False)) & F.col("label").rlike(TOTAL)
    marked = rows.withColumn("is_sum", F.coalesce(is_sum, F.lit(False)).cast("int"))
    marked = marked.withColumn("block", F.sum("is_sum").over(order) - F.col("is_sum"))
    number = F.col("v").isNotNull() & ~F.coalesce(F.col("raw").contains("%"), F.lit(False))
    part = (F.col("is_sum") == 0) & ~F.coalesce(F.col("is_total"), F.lit(False)) & number
    grouped = marked.groupBy("table_id", "doc_id", "col_idx", "block").agg(
        F.sum(F.when(part, F.col("v").cast("decimal(28,6)"))).cast("double").alias("expected"), F.count_if(part).alias("parts"),
        F.max(F.when(number, M.decimals(F.col("raw")))).alias("decimals"), F.max(F.when((F.col("is_sum") == 1) & number, F.col("v"))).alias("stated"),
    )
    slack = F.greatest(0.5 * F.pow(F.lit(10.0), -F.col("decimals")) * F.sqrt(F.col("parts").cast("double")), 0.0005 * F.abs("stated"))
    return grouped.filter((F.col("parts") >= 3) & F.col("stated").isNotNull()).withColumn("difference", F.round(F.col("stated") - F.col("expected"), 6)).withColumn(
        "holds", F.abs("difference") <= slack
    )


def diligence_totals(spark: SparkSession, folder: str) -> DataFrame:
    return total_checks(cells(tables_and_literals(spark, folder))).select("table_id", "col_idx", "block", "parts", "stated", "difference", "holds")


def facts(rows: DataFrame) -> DataFrame:
    """Known concepts with a period, in base units; the first of equal facts stays."""
    found = rows.filter("v is not null").withColumn("concept", M.first_match(F.col("label"), M.CONCEPTS))
    found = found.filter(F.col("concept").isNotNull() & F.col("period").isNotNull() & ~F.coalesce(F.col("raw").contains("%"), F.lit(False)))
    value = F.round(F.col("v") * F.coalesce("scale", F.lit(1.0)), 6)
    found = found.select(
        "workspace_id", "doc_id", "concept", "period", value.alias("value"), "currency", "unit", "scale", "page", "label", "raw", "table_id", "row_idx", "col_idx"
    )
    order = Window.partitionBy("doc_id", "concept", "period", "value", "page").orderBy("table_id", "row_idx", "col_idx")
    return found.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def diligence_facts(spark: SparkSession, folder: str) -> DataFrame:
    return facts(cells(tables(spark, folder))).select("doc_id", "concept", "period", "value", "currency", "table_id", "row_idx", "col_idx")


def contradictions(found: DataFrame) -> DataFrame:
    """Concept and period on which documents of a workspace differ beyond tolerance.

    One fact a document (its first), compared in the currency of the first of all.
    """
    first = Window.partitionBy("workspace_id", "concept", "period", "doc_id").orderBy("table_id", "row_idx", "col_idx")
    reps = found.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
    key = ["workspace_id", "concept", "period"]
    # The currency of the earliest representative comes from an aggregate, not from a sort of the whole group.
    lead = reps.groupBy(*key).agg(F.min(F.struct("doc_id", "table_id", "row_idx", "col_idx", "currency")).alias("l"))
    lead = lead.select(F.col("workspace_id").alias("_w"), F.col("concept").alias("_c"), F.col("period").alias("_p"), F.col("l.currency").alias("lead"))
    met = F.col("workspace_id").eqNullSafe(F.col("_w")) & (F.col("concept") == F.col("_c")) & (F.col("period") == F.col("_p"))
    same = reps.join(lead, met).filter(F.col("currency").eqNullSafe(F.col("lead"))).drop("_w", "_c", "_p")
    side = F.struct("value", "doc_id", "scale", "raw", "label")
    both = same.groupBy(*key).agg(F.count(F.lit(1)).alias("documents"), F.min(side).alias("lo"), F.max(side).alias("hi")).filter("documents > 1")

    def rounding(s: str) -> Column:
        return 0.5 * F.pow(F.lit(10.0), -M.decimals(F.coalesce(F.col(f"{s}.raw"), F.lit("")))) * F.coalesce(F.col(f"{s}.scale"), F.lit(1.0))

    gap = F.col("hi.value") - F.col("lo.value")
    slack = F.greatest(RELATIVE * F.least(F.abs("lo.value"), F.abs("hi.value")), rounding("lo"), rounding("hi"))
    percent = F.when(F.col("lo.value") != 0, gap / F.abs("lo.value") * 100)
    level = F.when(F.coalesce(percent, F.lit(100.0)) >= 5, 2).when(percent >= 1, 1).otherwise(0)
    adjusted = F.lower(F.concat_ws(" ", "lo.label", "hi.label")).contains("adjust")
    severity = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.when(adjusted & (level > 0), level - 1).otherwise(level) + 1)
    return both.filter(gap > slack).select(
        *key, "documents", F.col("lo.value").alias("low"), F.col("hi.value").alias("high"), F.round(percent, 1).alias("gap_percent"), severity.alias("severity")
    )


def diligence_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    return contradictions(facts(cells(tables(spark, folder))))


def diligence_growth(spark: SparkSession, folder: str) -> DataFrame:
    """Growth of a document's latest figure over the period before, per concept."""
    found = facts(cells(tables(spark, folder))).withColumn("k", M.period_key(F.col("period")))
    one = found.groupBy("doc_id", "concept", "k").agg(F.min_by("value", F.struct("table_id", "row_idx", "col_idx")).alias("value"))
    order = Window.partitionBy("doc_id", "concept").orderBy("k")
    rows = one.withColumn("before", F.lag("value").over(order)).withColumn("last", F.lead("k").over(order).isNull()).filter("last and before is not null")
    return rows.select("doc_id", "concept", "value", "before", F.when(F.col("before") != 0, F.round((F.col("value") - F.col("before")) / F.abs("before") * 100, 4)).alias("growth"))


def diligence_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Matrix of documents and concepts: the figure of the latest period."""
    found = facts(cells(tables(spark, folder))).withColumn("k", M.period_key(F.col("period")))
    latest = F.max_by("value", F.struct("k", -F.col("row_idx"), -F.col("col_idx"), "table_id"))
    return found.groupBy("doc_id").pivot("concept", [c for c, _ in M.CONCEPTS]).agg(latest)


def maturity_wall(rows: DataFrame) -> DataFrame:
    """Amount that falls due by year, per table with a maturity and an amount column; totals stand aside."""
    due, amount = r"(?i)matur|due|expir|repay", r"(?i)amount|outstanding|principal|balance"
    year = rows.filter(F.col("col_path").rlike(due)).groupBy("table_id", "row_idx").agg(F.min_by(F.regexp_extract("raw", r"(20\d{2})", 1), "col_idx").alias("year"))
    sums = rows.filter(F.col("col_path").rlike(amount) & ~F.col("col_path").rlike(r"(?i)matur|due|expir") & ~F.coalesce("is_total", F.lit(False)))
    sums = sums.groupBy("table_id", "row_idx").agg(F.min_by("v", "col_idx").alias("v"), F.first("scale").alias("scale"))
    both = sums.join(year.filter("year <> ''"), ["table_id", "row_idx"])
    return both.groupBy("table_id", "year").agg(F.sum(F.col("v").cast("decimal(28,6)")).cast("double").alias("due"), F.count(F.lit(1)).alias("rows"))


def diligence_maturity(spark: SparkSession, folder: str) -> DataFrame:
    return maturity_wall(cells(tables_and_literals(spark, folder)))


def diligence_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Dated events of section chunks, one a date and sentence."""
    from paperloom.functions.text import sentences

    rows = read_table(spark, folder, "chunks", "chunk_id", "doc_id", "kind", "trust", "text").filter("kind = 'section' and trust = 'normal'").distinct()
    cut = rows.select("doc_id", F.explode(sentences(F.col("text"))).alias("s")).filter(F.col("s").rlike(M.EVENT))
    events = cut.select("doc_id", "s", F.explode(M.dates(F.col("s"))).alias("date"))
    kind = F.coalesce(M.first_match(F.col("s"), M.EVENT_KINDS), F.lit("other"))
    return events.withColumn("kind", kind).groupBy("date", "kind").agg(F.countDistinct("s").alias("events"), F.countDistinct("doc_id").alias("documents"))


REFERENCE = r"\b((?:schedule|annexure|annex|exhibit|appendix)\s+(?:[0-9]+|[a-z]))\b"


def diligence_missing(spark: SparkSession, folder: str) -> DataFrame:
    """References that a workspace's chunks cite and none of its headings or openings provides."""
    rows = read_table(spark, folder, "chunks", "chunk_id", "workspace_id", "trust", "text", "heading_json").filter("trust = 'normal' and text is not null").distinct()
    low = F.lower("text")

    def labels(text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), lambda r: F.regexp_replace(r, r"\s+", " "))

    cited = rows.select("workspace_id", F.explode(labels(low)).alias("label")).groupBy("workspace_id", "label").agg(F.count(F.lit(1)).alias("citations"))
    heads = rows.select("workspace_id", F.explode(labels(F.lower(F.coalesce("heading_json", F.lit(""))))).alias("label"))
    opening = F.regexp_extract(F.left(F.ltrim(low), F.lit(60)), "^" + REFERENCE, 1)
    leads = rows.select("workspace_id", F.regexp_replace(opening, r"\s+", " ").alias("label")).filter("label <> ''")
    return cited.join(heads.unionByName(leads).distinct(), ["workspace_id", "label"], "left_anti")


def correction_effect(rows: DataFrame, table_id: str, row_idx: int, col_idx: int, value: float) -> DataFrame:
    """Total checks and contradictions before and after one corrected cell: what appears and what goes."""
    hit = (F.col("table_id") == table_id) & (F.col("row_idx") == row_idx) & (F.col("col_idx") == col_idx)
    after = rows.withColumn("raw", F.when(hit, F.lit(str(value))).otherwise(F.col("raw"))).withColumn("v", F.when(hit, F.lit(float(value))).otherwise(F.col("v")))

    def state(part: DataFrame) -> DataFrame:
        totals = total_checks(part).filter("not holds").select(F.lit("total").alias("what"), F.concat_ws("|", "table_id", "col_idx", "block").alias("item"))
        sides = contradictions(facts(part)).select(F.lit("contradiction").alias("what"), F.concat_ws("|", "workspace_id", "concept", "period").alias("item"))
        return totals.unionByName(sides)

    before, now = state(rows).withColumn("was", F.lit(1)), state(after).withColumn("now", F.lit(1))
    both = before.join(now, ["what", "item"], "full_outer")
    return both.filter("was is null or now is null").select("what", "item", F.when(F.col("now").isNull(), "resolved").otherwise("new").alias("change"))


def diligence_correction(spark: SparkSession, folder: str) -> DataFrame:
    """Effect of one corrected cell (Facility A of the literal debt schedule, 50 to 60) among all tables."""
    return correction_effect(cells(tables_and_literals(spark, folder)), "literal-debt", 0, 1, 60.0)


QUERIES = {
    f.__name__: f
    for f in (
        table_cells, table_numbers, table_summary, diligence_totals, diligence_facts, diligence_contradictions, diligence_growth, diligence_pack,
        diligence_maturity, diligence_timeline, diligence_missing, diligence_correction,
    )
}

_CELLS = """
    WITH t AS (SELECT DISTINCT * FROM tables_store),
    g AS (SELECT * EXCLUDE (grid_json), from_json(grid_json, '{"col_paths":["VARCHAR"],"rows":[{"label":"VARCHAR","is_total":"BOOLEAN","cells":[{"raw":"VARCHAR","v":"DOUBLE"}]}]}') AS g FROM t),
    l AS (SELECT * EXCLUDE (g), g.col_paths AS paths, unnest(g.rows) AS r, generate_subscripts(g.rows, 1) - 1 AS row_idx FROM g),
    k AS (SELECT * EXCLUDE (r), r.label AS label, r.is_total AS is_total, unnest(r.cells) AS c, generate_subscripts(r.cells, 1) - 1 AS col_idx FROM l),
    cells AS (SELECT * EXCLUDE (c, paths), c.raw AS raw, c.v AS v, paths[col_idx + 1] AS col_path FROM k WHERE col_idx > 0)"""
_MORE_CELLS = _CELLS.replace(
    "(SELECT DISTINCT * FROM tables_store)",
    "(SELECT DISTINCT * FROM tables_store UNION ALL BY NAME SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in LITERAL_TABLES) + ") AS v(table_id, title, scale, grid_json))",
)


def sql_period(text: str) -> str:
    """SQL of ``finance.period``."""
    full = lambda y: f"CASE WHEN length({y}) = 4 THEN {y} ELSE '20' || {y} END"
    part = lambda pattern, n: f"regexp_extract({text}, '{pattern}', {n})"
    quarter, year = r"(?i)\bQ([1-4])\s*(?:FY)?\s*''?(\d{4}|\d{2})\b", r"(?i)\bFY\s*''?(\d{4}|\d{2})(?:\s*[-/–]\s*''?(\d{4}|\d{2}))?\b"
    span, bare = r"\b(20\d{2})\s*[-–/]\s*(20\d{2}|\d{2})\b", r"\b(20[0-4]\d)\b"
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    ended = rf"(?i)(?:year|period|quarter)s?\s+ended\s+(?:on\s+)?(?:\d{{1,2}}(?:st|nd|rd|th)?\s+)?(?:{months})\s*(?:\d{{1,2}},?\s*)?(20\d{{2}})"
    end = f"CASE WHEN {part(year, 2)} <> '' THEN {part(year, 2)} ELSE {part(year, 1)} END"
    return (
        f"CASE WHEN {part(quarter, 1)} <> '' THEN 'Q' || {part(quarter, 1)} || 'FY' || {full(part(quarter, 2))} WHEN {part(year, 1)} <> '' THEN 'FY' || {full('(' + end + ')')} "
        f"WHEN {part(span, 2)} <> '' THEN 'FY' || {full(part(span, 2))} WHEN {part(ended, 1)} <> '' THEN 'FY' || {part(ended, 1)} WHEN {part(bare, 1)} <> '' THEN 'FY' || {part(bare, 1)} END"
    )


def sql_number(raw: str) -> str:
    core = f"regexp_replace(regexp_replace(trim({raw}), '^\\((.*)\\)$', '-\\1'), '[₹$€£¥%\\s]|(?i:\\b(?:rs\\.?|inr|usd|eur|gbp|jpy)\\b)', '', 'g')"
    value = (
        f"CASE WHEN regexp_matches({core}, '^[-+]?\\d+(\\.\\d+)?$') THEN {core} WHEN regexp_matches({core}, '^[-+]?\\d{{1,3}}(,\\d{{2,3}})+(\\.\\d+)?$') THEN replace({core}, ',', '') "
        f"WHEN regexp_matches({core}, '^[-+]?\\d{{1,3}}(\\.\\d{{3}})*,\\d{{1,2}}$') THEN replace(replace({core}, '.', ''), ',', '.') END"
    )
    return f"round(TRY_CAST({value} AS DOUBLE) / CASE WHEN regexp_matches(trim({raw}), '%\\s*\\)?$') THEN 100 ELSE 1 END, 10)"


_CONCEPT = "CASE " + " ".join(f"WHEN regexp_matches(label, '{p.replace('(?i)', '')}', 'i') THEN '{c}'" for c, p in M.CONCEPTS) + " END"
_FACTS = _CELLS + f""",
    p AS (SELECT *, {_CONCEPT} AS concept, CASE
            WHEN regexp_matches(col_path, '\\bFY\\s*\\d{{4}}\\b', 'i') THEN 'FY' || regexp_extract(col_path, '\\bFY\\s*(\\d{{4}})\\b', 1, 'i')
            WHEN regexp_matches(col_path, '\\b20[0-4]\\d\\b') THEN 'FY' || regexp_extract(col_path, '\\b(20[0-4]\\d)\\b', 1) END AS period FROM cells),
    facts AS (SELECT workspace_id, doc_id, concept, period, round(v * coalesce(scale, 1), 6) AS value, currency, scale, page, label, raw, table_id, row_idx::INT AS row_idx, col_idx::INT AS col_idx
        FROM p WHERE v IS NOT NULL AND concept IS NOT NULL AND period IS NOT NULL AND NOT coalesce(contains(raw, '%'), false)
        QUALIFY row_number() OVER (PARTITION BY doc_id, concept, period, round(v * coalesce(scale, 1), 6), page ORDER BY table_id, row_idx, col_idx) = 1)"""
_NUM = "coalesce(v IS NOT NULL AND NOT coalesce(contains(raw, '%'), false), false)"
_REFSQL = "list_transform(regexp_extract_all({0}, '\\b(?:schedule|annexure|annex|exhibit|appendix)\\s+(?:[0-9]+|[a-z])\\b'), lambda r: regexp_replace(r, '\\s+', ' ', 'g'))"

ORACLE = {
    "table_cells": _CELLS + """ SELECT table_id, count(*) AS cells, count(v) AS numbers, round(sum(v), 4) AS total, max(col_idx) AS last_col, max(row_idx) AS last_row
        FROM cells GROUP BY table_id""",
    "table_summary": _CELLS + """ SELECT table_id, concat_ws(' ', 'Table: ' || coalesce(title, 'untitled') || '.', 'Columns: ' || array_to_string(g.col_paths, ', ') || '.',
        'Rows: ' || array_to_string(list_slice(list_filter(list_transform(g.rows, lambda r: r.label), lambda x: x IS NOT NULL), 1, 12), ', ') || '.',
        'Unit: ' || concat_ws(' ', currency, unit) || '.') AS summary FROM g""",
    "table_numbers": _CELLS + f""", p AS (SELECT table_id, v, {sql_number("raw")} AS parsed FROM cells)
        SELECT table_id, count(*) AS parsed_cells, count(*) FILTER (abs(parsed - v) > 1e-9) AS differing FROM p WHERE v IS NOT NULL AND parsed IS NOT NULL GROUP BY table_id""",
    "diligence_pack": _FACTS + " SELECT doc_id, " + ", ".join(
        f"arg_max(value, (substr(period, 3)::INT, -row_idx, -col_idx, table_id)) FILTER (concept = '{c}') AS {c}" for c, _ in M.CONCEPTS
    ) + " FROM facts GROUP BY doc_id",
    "diligence_maturity": _MORE_CELLS + """, due AS (SELECT table_id, row_idx, arg_min(regexp_extract(raw, '(20\\d{2})', 1), col_idx) AS "year" FROM cells WHERE regexp_matches(col_path, '(?i)matur|due|expir|repay') GROUP BY ALL),
        sums AS (SELECT table_id, row_idx, arg_min(v, col_idx) AS v FROM cells WHERE regexp_matches(col_path, '(?i)amount|outstanding|principal|balance') AND NOT regexp_matches(col_path, '(?i)matur|due|expir')
                 AND NOT coalesce(is_total, false) GROUP BY ALL)
        SELECT table_id, "year", sum(v::DECIMAL(28,6))::DOUBLE AS due, count(*) AS rows FROM sums JOIN due USING (table_id, row_idx) WHERE "year" <> '' GROUP BY ALL""",
    "diligence_totals": _MORE_CELLS + f""",
        m AS (SELECT *, (coalesce(is_total, false) AND coalesce(regexp_matches(label, '^\\s*(?:grand\\s+)?total\\b', 'i'), false))::INT AS is_sum FROM cells),
        b AS (SELECT *, sum(is_sum) OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) - is_sum AS block FROM m),
        s AS (SELECT table_id, col_idx::INT AS col_idx, block::BIGINT AS block, sum(v::DECIMAL(28,6)) FILTER (is_sum = 0 AND NOT coalesce(is_total, false) AND {_NUM})::DOUBLE AS expected,
                 count(*) FILTER (is_sum = 0 AND NOT coalesce(is_total, false) AND {_NUM}) AS parts,
                 max(length(regexp_extract(raw, '\\.(\\d+)', 1))) FILTER ({_NUM}) AS decimals, max(v) FILTER (is_sum = 1 AND {_NUM}) AS stated FROM b GROUP BY ALL)
        SELECT table_id, col_idx, block, parts, stated, round(stated - expected, 6) AS difference,
               abs(round(stated - expected, 6)) <= greatest(0.5 * pow(10, -decimals) * sqrt(parts), 0.0005 * abs(stated)) AS holds
        FROM s WHERE parts >= 3 AND stated IS NOT NULL""",
    "diligence_facts": _FACTS + " SELECT doc_id, concept, period, value, currency, table_id, row_idx, col_idx FROM facts",
    "diligence_contradictions": _FACTS + """,
        reps AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY workspace_id, concept, period, doc_id ORDER BY table_id, row_idx, col_idx) = 1),
        led AS (SELECT *, first_value(currency) OVER (PARTITION BY workspace_id, concept, period ORDER BY doc_id, table_id, row_idx, col_idx) AS lead FROM reps),
        sides AS (SELECT *, 0.5 * pow(10, -length(regexp_extract(coalesce(raw, ''), '\\.(\\d+)', 1))) * coalesce(scale, 1) AS unsure FROM led WHERE currency IS NOT DISTINCT FROM lead),
        b AS (SELECT workspace_id, concept, period, count(*) AS documents, arg_min(value, (value, doc_id)) AS low, arg_max(value, (value, doc_id)) AS high,
                     arg_min(unsure, (value, doc_id)) AS u1, arg_max(unsure, (value, doc_id)) AS u2, arg_min(label, (value, doc_id)) AS n1, arg_max(label, (value, doc_id)) AS n2
              FROM sides GROUP BY ALL HAVING count(*) > 1),
        d AS (SELECT *, CASE WHEN low <> 0 THEN (high - low) / abs(low) * 100 END AS pc, contains(lower(n1 || ' ' || n2), 'adjust') AS adj FROM b
              WHERE high - low > greatest(0.005 * least(abs(low), abs(high)), u1, u2)),
        e AS (SELECT *, CASE WHEN coalesce(pc, 100) >= 5 THEN 2 WHEN pc >= 1 THEN 1 ELSE 0 END AS lev FROM d)
        SELECT workspace_id, concept, period, documents, low, high, round(pc, 1) AS gap_percent,
               ['low', 'medium', 'high'][CASE WHEN adj AND lev > 0 THEN lev - 1 ELSE lev END + 1] AS severity FROM e""",
    "diligence_growth": _FACTS + """,
        o AS (SELECT doc_id, concept, substr(period, 3)::INT AS k, arg_min(value, (table_id, row_idx, col_idx)) AS value FROM facts GROUP BY ALL),
        w AS (SELECT *, lag(value) OVER (PARTITION BY doc_id, concept ORDER BY k) AS before, lead(k) OVER (PARTITION BY doc_id, concept ORDER BY k) AS nxt FROM o)
        SELECT doc_id, concept, value, before, CASE WHEN before <> 0 THEN round((value - before) / abs(before) * 100, 4) END AS growth FROM w WHERE nxt IS NULL AND before IS NOT NULL""",
    "diligence_missing": f"""
        WITH r AS (SELECT DISTINCT chunk_id, workspace_id, lower(text) AS t, lower(coalesce(heading_json, '')) AS h FROM chunks WHERE trust = 'normal' AND text IS NOT NULL),
        c AS (SELECT workspace_id, label, count(*) AS citations FROM (SELECT workspace_id, unnest({_REFSQL.format("t")}) AS label FROM r) GROUP BY ALL),
        p AS (SELECT DISTINCT workspace_id, unnest({_REFSQL.format("h")}) AS label FROM r
              UNION SELECT workspace_id, regexp_replace(regexp_extract(left(ltrim(t, E' \\n\\t'), 60), '^((?:schedule|annexure|annex|exhibit|appendix)\\s+(?:[0-9]+|[a-z]))\\b', 1), '\\s+', ' ', 'g') FROM r)
        SELECT workspace_id, label, citations FROM c ANTI JOIN p USING (workspace_id, label)""",
}
_AFTER = ORACLE["diligence_totals"].replace('{"raw": "50.0", "v": 50.0}', '{"raw": "60.0", "v": 60.0}')
_STATE = "SELECT 'total' AS what, concat_ws('|', table_id, col_idx, block) AS item FROM ({0}) WHERE NOT holds"
ORACLE["diligence_correction"] = (
    f"WITH before AS ({_STATE.format(ORACLE['diligence_totals'])}), after AS ({_STATE.format(_AFTER)}) "
    "SELECT what, item, 'new' AS change FROM (FROM after EXCEPT FROM before) UNION ALL SELECT what, item, 'resolved' FROM (FROM before EXCEPT FROM after)"
)
