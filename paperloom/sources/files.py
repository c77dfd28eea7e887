"""JSON lines, HTML tables, magic bytes and the guarded sinks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import safe_cell

#: First bytes of each kind of file (fixed values).
MAGIC = {"pdf": "25504446", "docx": "504B0304", "xlsx": "504B0304", "pptx": "504B0304", "png": "89504E47", "jpg": "FFD8FF", "gif": "47494638"}


def magic_matches(content: Column, extension: Column) -> Column:
    """Whether a file begins as its extension says; unknown extensions do not."""
    signs = F.create_map(*(F.lit(x) for pair in MAGIC.items() for x in pair))
    return F.coalesce(F.startswith(F.hex(F.substring(content, 1, 8)), signs[F.lower(extension)]), F.lit(False))


def file_name(text: Column) -> Column:
    """Last path component without control characters, at most 255 characters."""
    base = F.substring_index(F.substring_index(text, "/", -1), "\\", -1)
    return F.left(F.regexp_replace(base, r"[\x00-\x1f\x7f]", ""), F.lit(255))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; lines that cannot be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last record of each key."""
    window = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(window)).filter("_r = 1").drop("_r")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with every text cell guarded against formulas."""
    kinds = dict(rows.dtypes)
    rows.select(*(safe_cell(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in rows.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def encrypt(content: Column, key: Column) -> Column:
    """AES-256-GCM envelope; each value gets a nonce of its own."""
    return F.aes_encrypt(content, key, F.lit("GCM"))


def decrypt(content: Column, key: Column) -> Column:
    return F.try_aes_decrypt(content, key, F.lit("GCM"))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.depth, self.cell = [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            given = dict(attrs)
            spans = [int(given[s]) if str(given.get(s, "")).isdigit() else 1 for s in ("rowspan", "colspan")]
            self.cell = {"text": [], "head": tag == "th", "spans": [max(1, s) for s in spans]}
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"].append(data)


def html_grid(html: str | None) -> tuple[list[list[str]], int] | None:
    """Rectangular grid and number of leading header rows of a text with exactly one table, else None."""
    parser = _Tables()
    parser.feed(html or "")
    if len(parser.tables) != 1 or not parser.tables[0]:
        return None
    grid: dict[tuple[int, int], str] = {}
    heads = 0
    # A span ends with the table: below with its rows, to the right with as many columns as it has cells.
    height, cells = len(parser.tables[0]), sum(map(len, parser.tables[0]))
    for r, row in enumerate(parser.tables[0]):
        c = 0
        if row and heads == r and all(cell["head"] for cell in row):
            heads += 1
        for cell in row:
            while (r, c) in grid:
                c += 1
            text = " ".join("".join(cell["text"]).split())
            down, right = min(cell["spans"][0], height - r), min(cell["spans"][1], max(cells, 2))
            for i in range(down):
                for j in range(right):
                    grid[r + i, c + j] = text if not (i or j) else ""
            c += right
    width = max(c for _, c in grid) + 1 if grid else 0
    return [[grid.get((r, c), "") for c in range(width)] for r in range(height)], heads


def html_tables(rows: DataFrame, key: str, html: str) -> DataFrame:
    """``key, row_idx, col_idx, text, header`` of every row whose text holds exactly one table."""
    kind = dict(rows.dtypes)[key]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, text in frame.itertuples(index=False):
                if found := html_grid(text):
                    grid, heads = found
                    out += [(k, r, c, cell, r < heads) for r, line in enumerate(grid) for c, cell in enumerate(line)]
            yield pd.DataFrame(out, columns=[key, "row_idx", "col_idx", "text", "header"])

    return rows.select(key, html).filter(F.lower(html).contains("<table")).mapInPandas(read, f"{key} {kind}, row_idx int, col_idx int, text string, header boolean")


def source_html_tables(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.sources.tables import read_table

    rows = read_table(spark, folder, "chunks", "chunk_id", "text").filter("text is not null").distinct()
    return html_tables(rows, "chunk_id", "text")


def source_envelope(spark: SparkSession, folder: str) -> DataFrame:
    """Round trip of document texts through the encrypted form, by a key of each row."""
    from paperloom.sources.tables import read_table

    rows = read_table(spark, folder, "documents", "doc_id", "text").filter("text is not null")
    key = F.unhex(F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(64)))
    sealed = rows.withColumn("key", key).withColumn("sealed", encrypt(F.encode("text", "UTF-8"), F.col("key")))
    return sealed.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.decode(decrypt(F.col("sealed"), F.col("key")), "UTF-8") == F.col("text")).alias("restored"))


def source_names(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the extension of their safe name and by their stated type."""
    from paperloom.sources.tables import read_table

    rows = read_table(spark, folder, "documents", "filename", "file_type").filter("filename is not null")
    extension = F.lower(F.substring_index(file_name(F.col("filename")), ".", -1))
    return rows.groupBy(extension.alias("extension"), "file_type").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"source_html_tables": source_html_tables, "source_envelope": source_envelope, "source_names": source_names}
ORACLE = {
    "source_envelope": "SELECT count(*) AS documents, count(text) AS restored FROM documents WHERE text IS NOT NULL",
    "source_names": """SELECT lower(split_part(split_part(filename, '/', -1), '.', -1)) AS extension, file_type, count(*) AS documents FROM documents WHERE filename IS NOT NULL GROUP BY ALL""",
}
