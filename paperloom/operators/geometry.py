"""Word geometry: rows, columns, regions and numeric grids from ``words(page key, x0, y0, x1, y1, text)``.

Rows are sessions of vertical centres, columns clusters of edges; both are windows.
Empty pages give nothing; words without a box take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = r"^[(\-−]?[₹$€£¥]?\s?\d[\d,.]*%?\)?$"
ROW_SHARE, EDGE = 0.35, 0.045


def physical_rows(words: DataFrame, page: str = "page") -> DataFrame:
    """Adds ``row``: a new one where a centre lies more than 0.35 of the median height below the one before."""
    placed = words.filter("x0 is not null and y0 is not null and x1 > x0 and y1 > y0").withColumn("centre", (F.col("y0") + F.col("y1")) / 2)
    height = placed.groupBy(page).agg(F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("height"))
    order = Window.partitionBy(page).orderBy("centre", "x0")
    joined = placed.join(height, page)
    jump = F.coalesce(F.col("centre") - F.lag("centre").over(order) > F.col("height") * ROW_SHARE, F.lit(True)).cast("int")
    return joined.withColumn("jump", jump).withColumn("row", F.sum("jump").over(order) - 1).drop("jump", "height")


def edge_clusters(words: DataFrame, edge: str, page: str = "page", gap: float = EDGE) -> DataFrame:
    """Adds ``column``: edges that follow each other by less than ``gap`` are one column."""
    order = Window.partitionBy(page).orderBy(edge)
    jump = F.coalesce(F.col(edge) - F.lag(edge).over(order) > gap, F.lit(True)).cast("int")
    return words.withColumn("_j", jump).withColumn("column", F.sum("_j").over(order) - 1).drop("_j")


def lines_of_text(words: DataFrame, page: str = "page") -> DataFrame:
    """Rows as text, left to right."""
    rows = physical_rows(words, page)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return rows.groupBy(page, "row").agg(text.alias("line"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def numeric_columns(words: DataFrame, page: str = "page", least: int = 3) -> DataFrame:
    """Right edges at which numbers recur on ``least`` rows or more: ``page, column, rows, x1``."""
    numbers = edge_clusters(physical_rows(words, page).filter(F.col("text").rlike(NUMERIC)), "x1", page, 0.012)
    return numbers.groupBy(page, "column").agg(F.countDistinct("row").alias("rows"), F.avg("x1").alias("x1")).filter(F.col("rows") >= least)


def numeric_tables(words: DataFrame, page: str = "page") -> DataFrame:
    """Pages with two recurring numeric columns or more and labels on three of their rows."""
    columns = numeric_columns(words, page).groupBy(page).agg(F.count(F.lit(1)).alias("columns")).filter("columns >= 2")
    labels = physical_rows(words, page).groupBy(page, "row").agg(F.bool_or(F.col("text").rlike(NUMERIC)).alias("n"), F.bool_or(F.col("text").rlike(r"\p{L}{2}")).alias("l"))
    rows = labels.filter("n and l").groupBy(page).agg(F.count(F.lit(1)).alias("rows")).filter("rows >= 3")
    return columns.join(rows, page)


def page_statistics(words: DataFrame, images: DataFrame, page: str = "page") -> DataFrame:
    """Text and image shares of each page and the route that follows from them."""
    text = words.groupBy(page).agg(F.sum(F.length("text")).alias("characters"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("text_share"))
    image = images.groupBy(page).agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("image_share"), F.count(F.lit(1)).alias("images"))
    both = text.join(image, page, "full_outer").fillna(0)
    scanned = (F.col("image_share") > 0.7) & (F.col("text_share") < 0.05) & (F.col("images") <= 2)
    mixed = (F.col("characters") > 0) & (F.col("image_share") > 0.3) & (F.col("text_share") < 0.1)
    return both.withColumn("route", F.when(scanned, "scanned").when(mixed, "mixed").otherwise("digital"))


def outside(words: DataFrame, regions: DataFrame, page: str = "page") -> DataFrame:
    """Words whose centre lies in no region of their page (a range anti join behind an equality)."""
    r = regions.select(F.col(page).alias("_p"), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return words.join(r, (F.col(page) == F.col("_p")) & x.between(F.col("_x0"), F.col("_x1")) & y.between(F.col("_y0"), F.col("_y1")), "left_anti")


def ruled_grid(rules: DataFrame, page: str = "page", cover: float = 0.8) -> DataFrame:
    """Pages with two horizontal and two vertical rules or more that each span ``cover`` of their extent."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    box = rules.groupBy(page).agg((F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"))
    both = rules.join(box, page).groupBy(page).agg(F.count_if((wide > high) & (wide >= cover * F.col("w"))).alias("across"), F.count_if((high > wide) & (high >= cover * F.col("h"))).alias("down"))
    return both.filter("across >= 2 and down >= 2")


def colour_is_near_white(packed: Column) -> Column:
    """Whether every channel of a packed colour is 240 or more."""
    return (F.shiftright(packed, 16).bitwiseAND(F.lit(255)) >= 240) & (F.shiftright(packed, 8).bitwiseAND(F.lit(255)) >= 240) & (packed.bitwiseAND(F.lit(255)) >= 240)
