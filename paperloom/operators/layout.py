"""Blocks: reading order, duplicates, continuations, Markdown, filters and page ranges.

Blocks whose JSON cannot be read are left out; a null box, confidence or order
stays null ("not reported") and is its own bucket. Copies of a row count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.finance import printed_page
from paperloom.functions.text import comparable
from paperloom.sources.tables import read_table

BLOCK = (
    "id string, type string, content string, page int, bbox array<double>, confidence double, extractor string, reading_order int, "
    "requires_review boolean, metadata map<string,string>, _bad string"
)
GUTTER, SAME_BOX = 0.012, 0.8


#: Blocks of one text in one place, which no extraction of the tables holds.
LITERAL_BLOCKS = tuple(
    (-1, key, n, '{"id": "' + key + '", "type": "paragraph", "content": "' + text + '", "page": 1, "bbox": ' + box + "}")
    for n, (key, text, box) in enumerate((("x0", "Same words", "[0.1, 0.1, 0.5, 0.2]"), ("x1", "Same words", "[0.1, 0.1, 0.5, 0.2]"), ("x2", "same  words!", "[0.1, 0.102, 0.5, 0.2]"), ("x3", "same words", "[0.6, 0.1, 0.9, 0.2]")))
)


def blocks(spark: SparkSession, folder: str, *, literal: bool = False) -> DataFrame:
    rows = read_table(spark, folder, "blocks").distinct()
    if literal:
        rows = rows.unionByName(spark.createDataFrame(list(LITERAL_BLOCKS), "doc_id bigint, block_id string, ord int, json string"))
    parsed = rows.select("doc_id", "block_id", "ord", F.from_json("json", BLOCK, {"columnNameOfCorruptRecord": "_bad"}).alias("j")).filter("j._bad is null and j.type is not null")
    level = F.expr("cast(try_cast(j.metadata['heading_level'] as double) as int)")
    return parsed.select(
        "doc_id", "block_id", "ord", *(f"j.{c}" for c in ("type", "content", "page", "bbox", "confidence", "extractor", "reading_order", "requires_review")), level.alias("heading_level")
    )


def edge(n: int) -> Column:
    return F.get("bbox", F.lit(n))


def valid_box(box: Column) -> Column:
    x0, y0, x1, y1 = (F.get(box, F.lit(k)) for k in range(4))
    inside = F.forall(box, lambda v: (v >= 0) & (v <= 1))
    return F.coalesce((F.size(box) == 4) & inside & (x0 < x1) & (y0 < y1), F.lit(False))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes given as columns."""

    def at(s: str, k: int) -> Column:
        return F.get(F.col(s), F.lit(k))

    width = F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0))
    height = F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1))
    inter = F.when((width > 0) & (height > 0), width * height).otherwise(0.0)

    def area(s: str) -> Column:
        return (at(s, 2) - at(s, 0)) * (at(s, 3) - at(s, 1))

    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))


def containment(inner: str, outer: str) -> Column:
    """Share of the inner box that lies in the outer."""

    def at(s: str, k: int) -> Column:
        return F.get(F.col(s), F.lit(k))

    width = F.least(at(inner, 2), at(outer, 2)) - F.greatest(at(inner, 0), at(outer, 0))
    height = F.least(at(inner, 3), at(outer, 3)) - F.greatest(at(inner, 1), at(outer, 1))
    whole = (at(inner, 2) - at(inner, 0)) * (at(inner, 3) - at(inner, 1))
    return F.coalesce(F.try_divide(F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0)), whole), F.lit(0.0))


def column_splits(rows: DataFrame) -> DataFrame:
    """``doc_id, page, split``: middle of the widest gutter in the middle of a page with two blocks on either side.

    A gutter opens where the running right edge of blocks, in order of left edge,
    stops short of the next block's left edge.
    """
    body = rows.filter(~F.col("type").isin("header", "footer") & valid_box(F.col("bbox"))).select("doc_id", "page", "block_id", edge(0).alias("x0"), edge(2).alias("x1"))
    narrow = body.filter("x1 - x0 < 0.6")
    order = Window.partitionBy("doc_id", "page").orderBy("x0", "block_id")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = narrow.withColumn("reach", reach).withColumn("left", F.row_number().over(order) - 1).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page")))
    open_ = gaps.filter((F.col("x0") - F.col("reach") >= GUTTER) & F.col("reach").between(0.2, 0.8) & (F.col("left") >= 2) & (F.col("all") - F.col("left") >= 2))
    return open_.groupBy("doc_id", "page").agg(F.max_by((F.col("x0") + F.col("reach")) / 2, F.struct(F.col("x0") - F.col("reach"), -F.col("x0"))).alias("split"))


def reading_order(rows: DataFrame) -> DataFrame:
    """Header, body by sections and columns, footer; contiguous from 0 within a document. Blocks without a box come last on their page."""
    split = column_splits(rows)
    placed = rows.join(split, ["doc_id", "page"], "left")
    zone = F.when(F.col("type") == "header", 0).when(F.col("type") == "footer", 2).otherwise(1)
    spans = F.coalesce((edge(0) < F.col("split")) & (edge(2) > F.col("split")), F.lit(True)).cast("int")
    placed = placed.withColumn("zone", zone).withColumn("spans", F.when(F.col("zone") == 1, spans).otherwise(0))
    down = Window.partitionBy("doc_id", "page", "zone").orderBy(edge(1).asc_nulls_last(), edge(0).asc_nulls_last(), "ord", "block_id")
    # A block across both columns cuts the page: what follows it is a new section.
    placed = placed.withColumn("section", F.sum("spans").over(down))
    side = F.when(F.col("spans") == 1, -1).when(edge(0) >= F.col("split"), 1).otherwise(0)
    order = Window.partitionBy("doc_id").orderBy("page", "zone", "section", side, edge(1).asc_nulls_last(), edge(0).asc_nulls_last(), "ord", "block_id")
    return placed.withColumn("position", F.row_number().over(order) - 1).drop("zone", "spans", "section", "split")


def layout_order(spark: SparkSession, folder: str) -> DataFrame:
    return reading_order(blocks(spark, folder)).select("doc_id", "block_id", "page", "position")


def layout_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates(blocks(spark, folder, literal=True))


def duplicates(rows: DataFrame) -> DataFrame:
    """Blocks that repeat an earlier one: same page, same words, boxes that overlap by more than 0.8."""
    rows = rows.filter(valid_box(F.col("bbox"))).withColumn("words", comparable(F.col("content"))).filter("words <> ''")
    # Blocks of one text and one box are one place; only different boxes of a text are held against each other.
    places = rows.groupBy("doc_id", "page", "words", "bbox").agg(F.min(F.struct("ord", "block_id")).alias("first"))
    a = places.select("doc_id", "page", "words", F.col("first").alias("kept"), F.col("bbox").alias("b1"))
    b = places.select("doc_id", "page", "words", F.col("bbox").alias("b2"))
    met = a.join(b, ["doc_id", "page", "words"]).filter(iou("b1", "b2") > SAME_BOX)
    earliest = met.groupBy("doc_id", "page", "words", F.col("b2").alias("bbox")).agg(F.min("kept").alias("kept"))
    found = rows.join(earliest, ["doc_id", "page", "words", "bbox"]).filter(F.col("kept") < F.struct("ord", "block_id"))
    return found.select("doc_id", F.col("block_id").alias("dropped"), F.col("kept.block_id").alias("kept"))


def unique_ids(rows: DataFrame, key: str = "block_id", group: str = "doc_id", order: str = "ord") -> DataFrame:
    """Later rows of one id get "~2", "~3" and so on."""
    n = F.row_number().over(Window.partitionBy(group, key).orderBy(order))
    return rows.withColumn("unique_id", F.when(n == 1, F.col(key)).otherwise(F.concat_ws("~", key, n)))


def layout_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Level of each heading by the height of its box on its document: the tallest first, four levels at most."""
    rows = blocks(spark, folder).filter((F.col("type") == "heading") & valid_box(F.col("bbox"))).withColumn("height", F.round(edge(3) - edge(1), 3))
    level = F.least(F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("height"))), F.lit(4))
    return rows.select("doc_id", "block_id", "height", level.alias("level"))


def layout_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown of each document from its ordered blocks; headings by their level (1 where none is recorded), pages apart by a rule, furniture left out."""
    rows = reading_order(blocks(spark, folder)).filter(~F.col("type").isin("header", "footer") & (F.trim("content") != ""))
    marks = F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("heading_level", F.lit(1)))))
    text = (
        F.when(F.col("type") == "heading", F.concat(marks, F.lit(" "), "content"))
        .when(F.col("type") == "list", F.regexp_replace("content", r"(?m)^\s*(?:[-•*]\s*)?(?=\S)", "- "))
        .when(F.col("type") == "equation", F.concat(F.lit("$$\n"), F.col("content"), F.lit("\n$$")))
        .when(F.col("type") == "figure", F.concat(F.lit("*"), F.col("content"), F.lit("*"))).otherwise(F.col("content"))
    )
    before = F.lag("page").over(Window.partitionBy("doc_id").orderBy("position"))
    piece = F.concat(F.when(before != F.col("page"), "---\n\n").otherwise(""), text)
    parts = rows.select("doc_id", "position", piece.alias("p"))
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("position", "p")))["p"], "\n\n")
    return parts.groupBy("doc_id").agg(joined.alias("markdown"), F.count(F.lit(1)).alias("blocks"))


def confidence_band(c: Column) -> Column:
    return F.when(c.isNull(), "none").when(c >= 0.85, "high").when(c >= 0.60, "medium").otherwise("low")


def layout_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of each type and confidence band that mention a fund word."""
    rows = blocks(spark, folder).filter(F.lower("content").contains("loan"))
    return rows.groupBy("type", confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("doc_id").alias("documents"))


def parse_pages(text: Column, most: Column) -> Column:
    """"1,3-5" as a sorted set of pages, cut to 1 .. most; anything else is left out."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: p.rlike(r"^\d{1,6}(-\d{1,6})?$"))

    def pages(p: Column) -> Column:
        a = F.substring_index(p, "-", 1).cast("int")
        b = F.substring_index(p, "-", -1).cast("int")
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), most)
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))


def page_ranges(rows: DataFrame, group: str, page: str) -> DataFrame:
    """Pages of a group as ranges: "1-3, 5" (gaps and islands)."""
    one = rows.select(group, F.col(page).alias("p")).filter("p is not null").distinct()
    island = F.col("p") - F.row_number().over(Window.partitionBy(group).orderBy("p"))
    runs = one.withColumn("island", island).groupBy(group, "island").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda s: s["t"]), ", ").alias("pages"))


def layout_pages(spark: SparkSession, folder: str) -> DataFrame:
    return page_ranges(blocks(spark, folder), "doc_id", "page")


def layout_page_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Types on each page from 1 to the last, empty pages included."""
    rows = blocks(spark, folder).filter("page >= 1")
    pages = rows.groupBy("doc_id").agg(F.max("page").alias("last")).select("doc_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page"))
    seen = rows.groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.count(F.lit(1)).alias("blocks"))
    return pages.join(seen, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("types", F.lit("")).alias("types"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def layout_printed(spark: SparkSession, folder: str) -> DataFrame:
    """Printed label of each page from its headers and footers; the first wins."""
    rows = blocks(spark, folder).filter(F.col("type").isin("header", "footer")).withColumn("label", printed_page(F.col("content"))).filter("label is not null")
    return rows.groupBy("doc_id", "page").agg(F.min_by("label", F.struct("ord", "block_id")).alias("label"))


def continuations(tables: DataFrame) -> DataFrame:
    """Chains of tables of one document whose column paths agree from page to page: ``doc_id, table_id, chain``."""
    order = Window.partitionBy("doc_id").orderBy("page", "table_id")
    paths = F.to_json(F.from_json("grid_json", "col_paths array<string>"))
    rows = tables.withColumn("paths", paths).withColumn("before", F.lag(F.struct("page", "paths")).over(order))
    goes_on = F.coalesce((F.col("before.paths") == F.col("paths")) & (F.col("page") - F.col("before.page") == 1), F.lit(False))
    return rows.withColumn("chain", F.sum((~goes_on).cast("int")).over(order)).select("doc_id", "table_id", "page", "chain")


def layout_continuations(spark: SparkSession, folder: str) -> DataFrame:
    return continuations(read_table(spark, folder, "tables_store", "doc_id", "table_id", "page", "grid_json").distinct())


def layout_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Words under each heading path position: running heading by window, then one aggregate."""
    rows = reading_order(blocks(spark, folder))
    order = Window.partitionBy("doc_id").orderBy("position")
    section = F.sum((F.col("type") == "heading").cast("int")).over(order)
    words = F.size(F.filter(F.split(F.coalesce("content", F.lit("")), r"\s+"), lambda w: w != ""))
    body = rows.withColumn("section", section).withColumn("words", words)
    return body.groupBy("doc_id", "section").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("blocks"))


QUERIES = {
    f.__name__: f
    for f in (
        layout_order, layout_duplicates, layout_headings, layout_markdown, layout_filter, layout_pages, layout_page_summary, layout_printed,
        layout_continuations, layout_sections,
    )
}

_BLOCKS = """
    WITH r AS (SELECT DISTINCT * FROM blocks), ok AS (SELECT * FROM r WHERE json_valid(json) AND json_type(json) = 'OBJECT'),
    b AS (SELECT doc_id, block_id, ord, json->>'type' AS type, json->>'content' AS content, (json->>'page')::INT AS page, (json->>'confidence')::DOUBLE AS confidence,
                 CASE WHEN json_type(json->'bbox') = 'ARRAY' THEN (json->'bbox')::DOUBLE[] END AS bbox FROM ok WHERE json->>'type' IS NOT NULL)"""
_MORE_BLOCKS = _BLOCKS.replace("FROM blocks)", "FROM blocks UNION ALL SELECT * FROM (VALUES " + ", ".join(str(row) for row in LITERAL_BLOCKS) + ") AS v(doc_id, block_id, ord, json))")
_VALID = "coalesce(len(bbox) = 4 AND len(list_filter(bbox, lambda v: v >= 0 AND v <= 1)) = 4 AND bbox[1] < bbox[3] AND bbox[2] < bbox[4], false)"
_ORDERED = (
    _BLOCKS + f""", body AS (SELECT doc_id, page, block_id, bbox[1] AS x0, bbox[3] AS x1 FROM b WHERE type NOT IN ('header', 'footer') AND {_VALID}),
        gaps AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
                 row_number() OVER (PARTITION BY doc_id, page ORDER BY x0, block_id) - 1 AS nth, count(*) OVER (PARTITION BY doc_id, page) AS n FROM body WHERE x1 - x0 < 0.6),
        split AS (SELECT doc_id, page, arg_max((x0 + reach) / 2, (x0 - reach, -x0)) AS split FROM gaps WHERE x0 - reach >= 0.012 AND reach BETWEEN 0.2 AND 0.8 AND nth >= 2 AND n - nth >= 2 GROUP BY ALL),
        z AS (SELECT b.*, split, CASE type WHEN 'header' THEN 0 WHEN 'footer' THEN 2 ELSE 1 END AS zone,
                 CASE WHEN type IN ('header', 'footer') THEN 0 WHEN coalesce(bbox[1] < split AND bbox[3] > split, true) THEN 1 ELSE 0 END AS spans FROM b LEFT JOIN split USING (doc_id, page)),
        s AS (SELECT *, sum(spans) OVER (PARTITION BY doc_id, page, zone ORDER BY bbox[2] NULLS LAST, bbox[1] NULLS LAST, ord, block_id) AS section FROM z),
        placed AS (SELECT doc_id, block_id, type, content, page, (row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS FIRST, zone, section, CASE WHEN spans = 1 THEN -1 WHEN bbox[1] >= split THEN 1 ELSE 0 END,
               bbox[2] NULLS LAST, bbox[1] NULLS LAST, ord, block_id) - 1)::INT AS position FROM s)"""
)
ORACLE = {
    "layout_order": _ORDERED + " SELECT doc_id, block_id, page, position FROM placed",
    "layout_sections": _ORDERED + """, n AS (SELECT doc_id, sum((type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY position)::BIGINT AS section,
            len(list_filter(string_split_regex(coalesce(content, ''), '\\s+'), lambda w: w <> '')) AS words FROM placed)
        SELECT doc_id, section, sum(words)::BIGINT AS words, count(*) AS blocks FROM n GROUP BY ALL""",
    "layout_markdown": _ORDERED + """, h AS (SELECT doc_id, block_id, try_cast(json->'metadata'->>'heading_level' AS DOUBLE)::INT AS level FROM ok),
        m AS (SELECT doc_id, position, page, CASE type WHEN 'heading' THEN repeat('#', greatest(1, least(6, coalesce(level, 1)))) || ' ' || content
                  WHEN 'list' THEN regexp_replace(content, '(?m)^\\s*(?:[-•*]\\s*)?(\\S)', '- \\1', 'g') WHEN 'equation' THEN '$$' || chr(10) || content || chr(10) || '$$'
                  WHEN 'figure' THEN '*' || content || '*' ELSE content END AS piece FROM placed JOIN h USING (doc_id, block_id) WHERE type NOT IN ('header', 'footer') AND trim(content) <> ''),
        l AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY position) AS before FROM m)
        SELECT doc_id, string_agg(CASE WHEN before <> page THEN '---' || chr(10) || chr(10) ELSE '' END || piece, chr(10) || chr(10) ORDER BY position) AS markdown, count(*) AS blocks FROM l GROUP BY doc_id""",
    "layout_filter": _BLOCKS + """ SELECT type, CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band,
        count(*) AS blocks, count(DISTINCT doc_id) AS documents FROM b WHERE contains(lower(content), 'loan') GROUP BY ALL""",
    "layout_headings": _BLOCKS + f""", h AS (SELECT doc_id, block_id, round(bbox[4] - bbox[2], 3) AS height FROM b WHERE type = 'heading' AND {_VALID})
        SELECT doc_id, block_id, height, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY height DESC), 4)::INT AS level FROM h""",
    "layout_pages": _BLOCKS + """, p AS (SELECT DISTINCT doc_id, page AS p FROM b WHERE page IS NOT NULL),
        i AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM p), u AS (SELECT doc_id, min(p) AS a, max(p) AS z FROM i GROUP BY doc_id, g)
        SELECT doc_id, string_agg(CASE WHEN a = z THEN a::VARCHAR ELSE a || '-' || z END, ', ' ORDER BY a) AS pages FROM u GROUP BY doc_id""",
    "layout_page_summary": _BLOCKS + """, l AS (SELECT doc_id, unnest(range(1, max(page) + 1))::INT AS page FROM b WHERE page >= 1 GROUP BY doc_id),
        s AS (SELECT doc_id, page, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(*) AS blocks FROM b WHERE page >= 1 GROUP BY ALL)
        SELECT doc_id, page, coalesce(types, '') AS types, coalesce(blocks, 0) AS blocks FROM l LEFT JOIN s USING (doc_id, page)""",
    "layout_printed": _BLOCKS + """, t AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM b WHERE type IN ('header', 'footer')),
        l AS (SELECT *, replace(regexp_extract(t, '(?i)^(?:page\\s+)?([a-z]{1,2}\\s?[-–]\\s?\\d{1,4}|\\d{1,4})(?:\\s+of\\s+\\d+)?$', 1), ' ', '') AS label FROM t WHERE length(t) <= 14)
        SELECT doc_id, page, arg_min(label, (ord, block_id)) AS label FROM l WHERE label <> '' GROUP BY ALL""",
    "layout_duplicates": _MORE_BLOCKS + f""", w AS (SELECT *, trim(regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS words FROM b WHERE {_VALID}),
        m AS (SELECT x.doc_id, x.block_id AS kept, x.ord AS o1, y.block_id AS dropped,
                 greatest(least(x.bbox[3], y.bbox[3]) - greatest(x.bbox[1], y.bbox[1]), 0) * greatest(least(x.bbox[4], y.bbox[4]) - greatest(x.bbox[2], y.bbox[2]), 0) AS i,
                 (x.bbox[3] - x.bbox[1]) * (x.bbox[4] - x.bbox[2]) + (y.bbox[3] - y.bbox[1]) * (y.bbox[4] - y.bbox[2]) AS u
              FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.page = y.page AND x.words = y.words AND (x.ord, x.block_id) < (y.ord, y.block_id) WHERE x.words <> '')
        SELECT doc_id, dropped, arg_min(kept, (o1, kept)) AS kept FROM m WHERE i / (u - i) > 0.8 GROUP BY ALL""",
}
