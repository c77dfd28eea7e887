"""Tables against each other and against text: differences, continuations over pages, debt, figures in prose, gaps.

Cells are compared by their text with case, spaces and group commas set aside;
empty rows and columns at the end of a grid do not count. Grids without any filled
cell have size 0 by 0. Copies of a row count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import finance as M
from paperloom.operators import grids
from paperloom.sources.tables import read_table

#: Kinds of difference, the first that holds (fixed values).
KINDS = ("dimensions", "identical", "rows_reordered", "columns_reordered", "cells_changed")


def cell_text(raw: Column) -> Column:
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " ")))
    return F.when(flat.rlike(r"^[-+(]?\d{1,3}(?:,\d{2,3})+(?:\.\d+)?\)?$"), F.replace(flat, F.lit(","))).otherwise(flat)


def _shape(cells: DataFrame, side: str) -> DataFrame:
    """``key``, rows and columns, and the sorted rows and columns as texts, of one side."""
    filled = cells.filter("text <> ''")

    def lines(across: str, along: str) -> DataFrame:
        each = filled.groupBy("key", across).agg(F.array_sort(F.collect_list(F.struct(along, "text"))).cast("string").alias("line"))
        return each.groupBy("key").agg(F.array_sort(F.collect_list("line")).alias(f"{side}_{across}s"))

    size = filled.groupBy("key").agg((F.max("row") + 1).alias(f"{side}_height"), (F.max("col") + 1).alias(f"{side}_width"))
    return size.join(lines("row", "col"), "key").join(lines("col", "row"), "key")


def table_difference(keys: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """``key, kind, compared, differing, heights and widths`` for every key, from cells ``key, row, col, text`` of two sides."""
    size = keys.join(_shape(first, "a"), "key", "left").join(_shape(second, "b"), "key", "left").fillna(0, ["a_height", "a_width", "b_height", "b_width"])
    both = first.filter("text <> ''").withColumnRenamed("text", "x").join(second.filter("text <> ''").withColumnRenamed("text", "y"), ["key", "row", "col"], "full_outer")
    inside = both.join(size.select("key", F.least("a_height", "b_height").alias("h"), F.least("a_width", "b_width").alias("w")), "key").filter("row < h and col < w")
    differing = inside.groupBy("key").agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differing"))
    rows = size.join(differing, "key", "left").fillna(0, ["differing"])
    kind = (
        F.when((F.col("a_height") != F.col("b_height")) | (F.col("a_width") != F.col("b_width")), KINDS[0]).when(F.col("differing") == 0, KINDS[1])
        .when(F.col("a_rows") == F.col("b_rows"), KINDS[2]).when(F.col("a_cols") == F.col("b_cols"), KINDS[3]).otherwise(KINDS[4])
    )
    compared = F.least("a_height", "b_height") * F.least("a_width", "b_width")
    return rows.select("key", kind.alias("kind"), compared.alias("compared"), "differing", "a_height", "a_width", "b_height", "b_width")


#: Pairs of small grids, one of each kind of difference: key, side, rows.
GRIDS = (
    ("same", "a", [["X", "1,000"], ["y", "2"]]), ("same", "b", [["x ", "1000", ""], ["Y", "2", ""], ["", "", ""]]), ("size", "a", [["x", "1"]]), ("size", "b", [["x", "1"], ["y", "2"]]), ("rows", "a", [["x", "1"], ["y", "2"]]),
    ("rows", "b", [["y", "2"], ["x", "1"]]), ("columns", "a", [["x", "1"], ["y", "2"]]), ("columns", "b", [["1", "x"], ["2", "y"]]), ("cells", "a", [["x", "1"], ["y", "2"]]), ("cells", "b", [["x", "7"], ["y", "2"]]), ("none", "a", [[""]]), ("none", "b", []),
)


def _pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each table beside the one before it of the same workspace and title, and the literal pairs."""
    rows = grids.cells(grids.tables(spark, folder)).select("table_id", "workspace_id", "title", F.col("row_idx").alias("row"), F.col("col_idx").alias("col"), cell_text(F.col("raw")).alias("text"))
    named = rows.select("table_id", "workspace_id", "title").distinct()
    order = Window.partitionBy("workspace_id", "title").orderBy("table_id")
    pairs = named.withColumn("before", F.lag("table_id").over(order)).filter("before is not null").select(F.col("table_id").alias("key"), "before")
    cells = rows.select("table_id", "row", "col", "text")
    literal = spark.createDataFrame([(k, side, r, c, text) for k, side, grid in GRIDS for r, line in enumerate(grid) for c, text in enumerate(line)], "key string, side string, row int, col int, raw string")
    literal = literal.select("key", "side", "row", "col", cell_text(F.col("raw")).alias("text"))
    a = cells.join(pairs.select(F.col("before").alias("table_id"), "key"), "table_id").select("key", "row", "col", "text").unionByName(literal.filter("side = 'a'").drop("side"))
    b = cells.join(pairs.select(F.col("key").alias("table_id"), "key"), "table_id").select("key", "row", "col", "text").unionByName(literal.filter("side = 'b'").drop("side"))
    return pairs.select("key").unionByName(spark.createDataFrame([(k,) for k in dict.fromkeys(k for k, *_ in GRIDS)], "key string")), a, b


def table_differences(spark: SparkSession, folder: str) -> DataFrame:
    return table_difference(*_pairs(spark, folder))


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row a table from its parts on following pages: ``doc_id, table_id, pages, rows, row_pages``.

    ``doc_id, table_id, page, ord, continues, rows`` says whether a part goes on from the
    part before it. A first row of a continuation that repeats the table's first row is
    its header again and is left out; anything else is data and stays.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "ord")
    chained = parts.withColumn("chain", F.sum((~F.coalesce("continues", F.lit(False))).cast("int")).over(order))
    within = Window.partitionBy("doc_id", "chain").orderBy("page", "ord")
    head = F.first(F.get("rows", F.lit(0))).over(within)
    flat = lambda row: F.transform(row, lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    again = (F.row_number().over(within) > 1) & F.coalesce(flat(F.get("rows", F.lit(0))) == flat(head), F.lit(False))
    kept = chained.withColumn("kept", F.when(again, F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows"))).withColumn("first", F.first("table_id").over(within))
    every = F.array_sort(F.collect_list(F.struct("page", "ord", "kept")))
    made = kept.groupBy("doc_id", "chain", F.col("first").alias("table_id")).agg(every.alias("e"))
    pages = F.flatten(F.transform("e", lambda x: F.transform(x["kept"], lambda _: x["page"])))
    return made.select("doc_id", "table_id", F.col("e.page").alias("pages"), F.flatten("e.kept").alias("rows"), pages.alias("row_pages"))


#: Parts of tables over pages: document, table, page, place, whether it goes on, rows.
PARTS = (
    (1, "t1", 1, 0, False, [["Item", "2020"], ["a", "1"]]), (1, "t2", 2, 1, True, [[" item ", "2020"], ["b", "2"], ["c", "3"]]), (1, "t3", 3, 2, True, [["d", "4"]]), (1, "t4", 3, 3, False, [["Other", "x"]]), (2, "t5", 1, 0, None, [["Item", "2020"]]),
    (2, "t6", 2, 0, True, []), (2, "t7", 3, 0, True, [["Item", "2020"]]),
)


def table_merges(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.createDataFrame(list(PARTS), "doc_id int, table_id string, page int, ord int, continues boolean, rows array<array<string>>")
    join = lambda column: F.array_join(F.transform(column, lambda x: x.cast("string")), ",")
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")
    return merge_parts(parts).select("doc_id", "table_id", join("pages").alias("pages"), rows.alias("rows"), join("row_pages").alias("row_pages"))


def debt_tables(rows: DataFrame) -> DataFrame:
    """Facilities of each table with a maturity and an amount column: number, total, years, the year most falls due, lowest and highest rate."""
    due, amount, rate = r"(?i)matur|due|expir|repay", r"(?i)amount|outstanding|principal|balance", r"(?i)rate|interest|coupon"
    key = ["table_id", "row_idx"]

    def first(pattern: str, value: Column, name: str) -> DataFrame:
        lead = rows.filter(F.col("col_path").rlike(pattern)).groupBy("table_id").agg(F.min("col_idx").alias("col_idx"))
        return rows.join(lead, ["table_id", "col_idx"]).filter(~F.coalesce("is_total", F.lit(False)) & F.col("label").isNotNull()).select(*key, value.alias(name))

    owed = first(amount, F.col("v"), "v").filter("v is not null")
    both = owed.join(first(due, F.regexp_extract("raw", r"(20\d{2})", 1), "year"), key).join(first(rate, F.regexp_extract("raw", r"(\d+\.?\d*)\s*%", 1).try_cast("double"), "rate"), key, "left")
    years = both.filter("year <> ''").groupBy("table_id", "year").agg(F.sum(F.col("v").cast("decimal(28,6)")).alias("s")).groupBy("table_id").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("year", F.struct(-F.col("s"), "year")).alias("largest_year")
    )
    sums = both.groupBy("table_id").agg(F.count(F.lit(1)).alias("facilities"), F.sum(F.col("v").cast("decimal(28,6)")).cast("double").alias("total"), F.min("rate").alias("low_rate"), F.max("rate").alias("high_rate"))
    return sums.join(years, "table_id", "left")


def diligence_debt(spark: SparkSession, folder: str) -> DataFrame:
    return debt_tables(grids.cells(grids.tables_and_literals(spark, folder)))


#: A figure in a sentence: what it is, a verb, a currency, the number and its scale.
STATED = (
    r"(?i)\b(total\s+borrowings|total\s+debt|net\s+debt|gross\s+profit|revenue|ebitda|net\s+profit)\b[^.\d]{0,50}?"
    r"\b(?:stood\s+at|was|were|is|of|amounted\s+to|at)\s+(?:Rs\.?|₹|INR|USD|EUR|\$|£|€)?\s*(\d[\d,]*\.?\d*)\s*(crore|lakh|million|billion)?"
)


def text_facts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, concept, period, value, unit, raw`` of figures stated in prose; the period is the first one the sentence names."""
    from paperloom.functions.text import sentences

    cut = rows.select(key, F.explode(sentences(F.col(text))).alias("s")).filter(F.col("s").rlike(STATED))
    found = cut.select(key, "s", F.explode(F.regexp_extract_all("s", F.lit(STATED), F.lit(0))).alias("m"))
    part = lambda n: F.regexp_extract("m", STATED, n)
    unit = F.when(part(3) != "", F.lower(part(3)))
    value = F.replace(part(2), F.lit(",")).try_cast("double") * F.coalesce(M.unit_scale(unit), F.lit(1.0))
    named = found.select(key, M.first_match(part(1), M.CONCEPTS).alias("concept"), M.period(F.col("s")).alias("period"), F.round(value, 6).alias("value"), unit.alias("unit"), part(2).alias("raw"))
    return named.filter("concept is not null and period is not null").distinct()


def diligence_text_facts(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "chunks", "chunk_id", "kind", "trust", "text").filter("kind = 'section' and trust = 'normal' and text is not null")
    return text_facts(rows, "chunk_id", "text")


def diligence_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts that no table of a workspace gives a figure for."""
    found = grids.facts(grids.cells(grids.tables(spark, folder))).select("workspace_id", "concept").distinct()
    every = read_table(spark, folder, "workspaces", "workspace_id").select("workspace_id", F.explode(F.array(*(F.lit(c) for c, _ in M.CONCEPTS))).alias("concept"))
    return every.join(found, ["workspace_id", "concept"], "left_anti")


QUERIES = {f.__name__: f for f in (table_differences, table_merges, diligence_debt, diligence_text_facts, diligence_gaps)}

from paperloom.operators.grids import _CELLS, _FACTS, _MORE_CELLS, sql_period  # noqa: E402

_TEXT = "lower(trim(regexp_replace(coalesce(raw, ''), '\\s+', ' ', 'g')))"
_GRID_ROWS = ", ".join(f"('{k}', '{side}', {r}, {c}, '{text}')" for k, side, grid in GRIDS for r, line in enumerate(grid) for c, text in enumerate(line))
_PART_ROWS = ", ".join(
    f"({d}, '{t}', {p}, {o}, {'NULL' if c is None else str(c).lower()}, {'[' + ', '.join('[' + ', '.join(repr(x) for x in line) + ']' for line in rows) + ']' if rows else '[]::VARCHAR[][]'})" for d, t, p, o, c, rows in PARTS
)
_STATED = STATED.replace("'", "''")
_CONCEPT_OF = "CASE " + " ".join(f"WHEN regexp_matches(label, '{p}') THEN '{c}'" for c, p in M.CONCEPTS) + " END"
ORACLE = {
    "table_differences": _CELLS + f""", named AS (SELECT DISTINCT table_id, workspace_id, title FROM cells), p AS (SELECT table_id AS key, lag(table_id) OVER (PARTITION BY workspace_id, title ORDER BY table_id) AS before FROM named QUALIFY before IS NOT NULL),
        x AS (SELECT key, 'a' AS side, row_idx AS row, col_idx AS col, raw FROM p JOIN cells ON table_id = before UNION ALL SELECT key, 'b', row_idx, col_idx, raw FROM p JOIN cells ON table_id = key
              UNION ALL SELECT * FROM (VALUES {_GRID_ROWS}) AS v(key, side, row, col, raw)),
        y AS (SELECT key, side, row, col, CASE WHEN regexp_matches({_TEXT}, '^[-+(]?\\d{{1,3}}(?:,\\d{{2,3}})+(?:\\.\\d+)?\\)?$') THEN replace({_TEXT}, ',', '') ELSE {_TEXT} END AS text FROM x),
        f AS (SELECT * FROM y WHERE text <> ''), keys AS (SELECT key FROM p UNION SELECT key FROM x UNION SELECT 'none'),
        ln AS (SELECT key, side, list(line ORDER BY line) AS lines FROM (SELECT key, side, row, list((col, text) ORDER BY col)::VARCHAR AS line FROM f GROUP BY ALL) GROUP BY ALL),
        cl AS (SELECT key, side, list(line ORDER BY line) AS lines FROM (SELECT key, side, col, list((row, text) ORDER BY row)::VARCHAR AS line FROM f GROUP BY ALL) GROUP BY ALL),
        sz AS (SELECT key, coalesce(max(row) FILTER (side = 'a') + 1, 0) AS a_height, coalesce(max(col) FILTER (side = 'a') + 1, 0) AS a_width, coalesce(max(row) FILTER (side = 'b') + 1, 0) AS b_height,
               coalesce(max(col) FILTER (side = 'b') + 1, 0) AS b_width FROM keys LEFT JOIN f USING (key) GROUP BY key),
        df AS (SELECT key, count(*) FILTER (a.text IS DISTINCT FROM b.text) AS differing FROM (SELECT * FROM f WHERE side = 'a') a FULL JOIN (SELECT * FROM f WHERE side = 'b') b USING (key, row, col) JOIN sz USING (key)
               WHERE row < least(a_height, b_height) AND col < least(a_width, b_width) GROUP BY key)
        SELECT key, CASE WHEN a_height <> b_height OR a_width <> b_width THEN 'dimensions' WHEN coalesce(differing, 0) = 0 THEN 'identical' WHEN ra.lines = rb.lines THEN 'rows_reordered' WHEN ca.lines = cb.lines THEN 'columns_reordered'
               ELSE 'cells_changed' END AS kind, least(a_height, b_height) * least(a_width, b_width) AS compared, coalesce(differing, 0) AS differing, a_height, a_width, b_height, b_width
        FROM sz LEFT JOIN df USING (key) LEFT JOIN (FROM ln WHERE side = 'a') ra USING (key) LEFT JOIN (FROM ln WHERE side = 'b') rb USING (key) LEFT JOIN (FROM cl WHERE side = 'a') ca USING (key) LEFT JOIN (FROM cl WHERE side = 'b') cb USING (key)""",
    "table_merges": f"""
        WITH p AS (SELECT * FROM (VALUES {_PART_ROWS}) AS v(doc_id, table_id, page, ord, continues, rows)),
        c AS (SELECT *, sum((NOT coalesce(continues, false))::INT) OVER (PARTITION BY doc_id ORDER BY page, ord) AS chain FROM p),
        h AS (SELECT *, first_value(rows[1]) OVER w AS head, row_number() OVER w AS n, first_value(table_id) OVER w AS lead FROM c WINDOW w AS (PARTITION BY doc_id, chain ORDER BY page, ord)),
        k AS (SELECT *, CASE WHEN n > 1 AND coalesce(list_transform(rows[1], lambda x: lower(trim(x))) = list_transform(head, lambda x: lower(trim(x))), false) THEN rows[2:] ELSE rows END AS kept FROM h)
        SELECT doc_id, lead AS table_id, string_agg(page::VARCHAR, ',' ORDER BY page, ord) AS pages, array_to_string(list_transform(flatten(list(kept ORDER BY page, ord)), lambda r: array_to_string(r, '|')), ';') AS rows,
               coalesce(array_to_string(flatten(list(list_transform(kept, lambda r: page) ORDER BY page, ord)), ','), '') AS row_pages FROM k GROUP BY doc_id, chain, lead""",
    "diligence_debt": _MORE_CELLS + """, firsts AS (SELECT table_id, min(col_idx) FILTER (regexp_matches(col_path, '(?i)amount|outstanding|principal|balance')) AS a, min(col_idx) FILTER (regexp_matches(col_path, '(?i)matur|due|expir|repay')) AS d,
              min(col_idx) FILTER (regexp_matches(col_path, '(?i)rate|interest|coupon')) AS r FROM cells GROUP BY 1),
        w AS (SELECT table_id, row_idx, max(v) FILTER (col_idx = a) AS v, max(regexp_extract(raw, '(20\\d{2})', 1)) FILTER (col_idx = d) AS y, max(TRY_CAST(regexp_extract(raw, '(\\d+\\.?\\d*)\\s*%', 1) AS DOUBLE)) FILTER (col_idx = r) AS rate
              FROM cells JOIN firsts USING (table_id) WHERE a IS NOT NULL AND d IS NOT NULL AND NOT coalesce(is_total, false) AND label IS NOT NULL GROUP BY ALL),
        o AS (SELECT * FROM w WHERE v IS NOT NULL), ys AS (SELECT table_id, y, sum(v::DECIMAL(28,6)) AS s FROM o WHERE y <> '' GROUP BY ALL),
        yy AS (SELECT table_id, min(y) AS first_year, max(y) AS last_year, arg_min(y, (-s, y)) AS largest_year FROM ys GROUP BY 1)
        SELECT table_id, count(*) AS facilities, sum(v::DECIMAL(28,6))::DOUBLE AS total, min(rate) AS low_rate, max(rate) AS high_rate, any_value(first_year) AS first_year, any_value(last_year) AS last_year, any_value(largest_year) AS largest_year
        FROM o LEFT JOIN yy USING (table_id) GROUP BY table_id""",
    "diligence_text_facts": f"""
        WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE kind = 'section' AND trust = 'normal' AND text IS NOT NULL),
        s AS (SELECT chunk_id, unnest(string_split(regexp_replace(text, '([.!?])[\\s\\x0b]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM c),
        m AS (SELECT chunk_id, s, unnest(regexp_extract_all(s, '{_STATED}')) AS m FROM s),
        g AS (SELECT chunk_id, s, regexp_extract(m, '{_STATED}', 1) AS label, regexp_extract(m, '{_STATED}', 2) AS raw, nullif(lower(regexp_extract(m, '{_STATED}', 3)), '') AS unit FROM m),
        v AS (SELECT DISTINCT chunk_id, {_CONCEPT_OF} AS concept, {sql_period("s")} AS period, round(TRY_CAST(replace(raw, ',', '') AS DOUBLE) * CASE unit WHEN 'crore' THEN 1e7 WHEN 'lakh' THEN 1e5 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 ELSE 1 END, 6) AS value, unit, raw FROM g)
        SELECT * FROM v WHERE concept IS NOT NULL AND period IS NOT NULL""",
    "diligence_gaps": _FACTS + ", every AS (SELECT workspace_id, unnest([" + ", ".join(f"'{c}'" for c, _ in M.CONCEPTS) + "]) AS concept FROM workspaces) SELECT * FROM every ANTI JOIN facts USING (workspace_id, concept)",
}
