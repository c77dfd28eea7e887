"""Clean-up of transcribed pages: labelled furniture, inline tags, tab-separated grids, hyphens at line ends, names of files.

All native. Null stays null; a text without any of this stays as it is but for the
blank lines that furniture leaves. Copies of a row count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import content_words
from paperloom.sources.tables import read_table

# Characters that can stand raised or lowered, and their forms.
RAISED = ("0123456789+-=()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾")
LOWERED = ("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎")
EMPHASIS = r"(?i)</?(?:b|i|u|em|strong|span|small|font|mark|ins|del|s)(?:\s[^<>]*)?>"


def labelled(text: Column, label: str) -> Column:
    """Texts that a reader labelled as furniture, empty ones left out."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"(?is)<{label}>(.*?)</{label}>"), F.lit(1)), lambda t: F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))), lambda t: t != "")


def without_furniture(text: Column) -> Column:
    """The body: labelled headers and footers out; a label that is never closed hides nothing."""
    body = F.regexp_replace(text, r"(?is)<page-header>.*?</page-header>|<page-footer>.*?</page-footer>", "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"(?i)</?page-(?:header|footer)>", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def inline_tags(text: Column) -> Column:
    """Inline tags as the text that they stand for: digits raised and lowered, emphasis dropped, breaks as blanks."""
    out = F.regexp_replace(text, r"(?i)<br\s*/?>", " ")

    def script(t: Column, tag: str, table: tuple[str, str]) -> Column:
        # The contents stand between marks, so that pieces of odd number are what the tag held.
        parts = F.split(F.regexp_replace(t, rf"(?is)<{tag}>(.*?)</{tag}>", "\u0001$1\u0001"), "\u0001")
        moved = F.transform(parts, lambda p, i: F.when((i % 2 == 1) & p.rlike(r"^[0-9+\-=()]+$"), F.translate(p, *table)).otherwise(p))
        return F.array_join(moved, "")

    return F.regexp_replace(script(script(out, "sup", RAISED), "sub", LOWERED), EMPHASIS, "")


def tabbed_grids(text: Column) -> Column:
    """Runs of two lines or more with the same number (two or more) of tab-separated cells as pipe tables."""
    width = lambda line: F.when(~F.startswith(F.ltrim(line), F.lit("|")), F.size(F.split(F.trim(line), "\t"))).otherwise(1)
    lines = F.split(text, "\n")
    at = lambda i: F.coalesce(width(F.get(lines, i)), F.lit(0))

    def one(line: Column, i: Column) -> Column:
        inside = (width(line) >= 2) & ((at(i - 1) == width(line)) | (at(i + 1) == width(line)))
        starts = inside & (at(i - 1) != width(line))
        ends = inside & (at(i + 1) != width(line))
        row = F.concat(F.lit("| "), F.array_join(F.transform(F.split(F.trim(line), "\t"), lambda c: F.replace(F.trim(c), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), width(line)), " | "), F.lit(" |"))
        before = F.when(starts & (F.trim(F.coalesce(F.get(lines, i - 1), F.lit(""))) != ""), "\n").otherwise("")
        after = F.when(ends & (F.trim(F.coalesce(F.get(lines, i + 1), F.lit(""))) != ""), "\n").otherwise("")
        return F.when(inside, F.concat(before, row, F.when(starts, rule).otherwise(""), after)).otherwise(line)

    return F.array_join(F.transform(lines, one), "\n")


def hyphen_readings(text: Column) -> Column:
    """Both readings of hyphens at line ends: joined, and kept."""
    return F.struct(F.regexp_replace(text, r"(\p{L})[-‐]\n\s*(\p{L})", "$1$2").alias("joined"), F.regexp_replace(text, r"(\p{L})([-‐])\n\s*(\p{L})", "$1$2$3").alias("kept"))


def matches_either(text: Column, wanted: Column) -> Column:
    """Whether a text holds the words wanted in one of the two readings."""
    both = hyphen_readings(text)
    have = lambda t: F.size(F.array_except(content_words(wanted), content_words(t))) == 0
    return have(both["joined"]) | have(both["kept"])


def file_label(name: Column) -> Column:
    """A file name for display: without its extension, underscores as blanks."""
    return F.replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), F.lit("_"), F.lit(" "))


#: Pages as readers transcribe them; none of the tables holds such text.
PAGES = (
    (1, "<page-header> Kabom Ports </page-header>\nRevenue rose.\n\n\n<page-footer>Page 3</page-footer>\n"), (2, "<page-header>never closed\nstays"), (3, "An area of 5 m<sup>2</sup> and H<sub>2</sub>O, <b>not</b> x<sup>th</sup><br/>here"),
    (4, "Costs\na\tb\n1\t2|3\nend"), (5, "a\tb\tc\nalone\tpair"), (6, "x\ty\nz\tw"), (7, "The inter-\nnational e-\nmail"), (8, ""), (9, None), (10, "| a\tb |\n| c\td |"),
)


def _pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PAGES), "page_id int, text string")


def page_bodies(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    headers, footers = labelled(t, "page-header"), labelled(t, "page-footer")
    return _pages(spark).select("page_id", without_furniture(t).alias("body"), F.array_join(headers, "|").alias("headers"), F.array_join(footers, "|").alias("footers"), inline_tags(t).alias("plain"))


def page_grids(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark).select("page_id", tabbed_grids(F.col("text")).alias("grid"))


def page_hyphens(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each section chunk that only one reading of its line ends gives."""
    rows = read_table(spark, folder, "chunks", "chunk_id", "kind", "text").filter(F.col("text").rlike(r"\p{L}[-‐]\n")).filter("kind = 'section'").select("chunk_id", "text").distinct()
    both = rows.select("chunk_id", hyphen_readings(F.col("text")).alias("h"))
    joined, kept = (F.array_distinct(content_words(F.col(f"h.{c}"))) for c in ("joined", "kept"))
    return both.select("chunk_id", F.size(F.array_except(joined, kept)).alias("only_joined"), F.size(F.array_except(kept, joined)).alias("only_kept"))


def file_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents", "filename").filter("filename is not null")
    return rows.groupBy(file_label(F.col("filename")).alias("label")).agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {f.__name__: f for f in (page_bodies, page_grids, page_hyphens, file_labels)}


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


_ROWS = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {_literal(t)})" for i, t in PAGES) + ") AS v(page_id, text))"


def _script(text: str, tag: str, table: tuple[str, str]) -> str:
    parts = f"string_split(regexp_replace({text}, '(?is)<{tag}>(.*?)</{tag}>', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i % 2 = 0 AND regexp_matches(p, '^[0-9+\\-=()]+$') THEN translate(p, '{table[0]}', '{table[1]}') ELSE p END), '')"


_LABELLED = "array_to_string(list_filter(list_transform(regexp_extract_all(text, '(?is)<{0}>(.*?)</{0}>', 1), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> ''), '|')"
_PLAIN = "regexp_replace(text, '(?i)<br\\s*/?>', ' ', 'g')"
_HYPHENS = "list_distinct(regexp_extract_all(lower(replace(regexp_replace(text, '(\\p{{L}})([-‐])\\n\\s*(\\p{{L}})', '{0}', 'g'), 'İ', 'i' || chr(775))), '\\p{{N}}[\\p{{N}}.,]*\\p{{N}}|[\\p{{L}}\\p{{N}}]+'))"
ORACLE = {
    "page_bodies": f"""
        WITH p AS {_ROWS}, b AS (SELECT *, regexp_replace(text, '(?is)<page-header>.*?</page-header>|<page-footer>.*?</page-footer>', chr(10), 'g') AS b FROM p)
        SELECT page_id, regexp_replace(regexp_replace(regexp_replace(b, '(?i)</?page-(?:header|footer)>', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body,
               {_LABELLED.format("page-header")} AS headers, {_LABELLED.format("page-footer")} AS footers,
               regexp_replace({_script(_script(_PLAIN, "sup", RAISED), "sub", LOWERED)}, '{EMPHASIS}', '', 'g') AS plain FROM b""",
    "page_grids": f"""
        WITH p AS {_ROWS}, l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
        w AS (SELECT *, CASE WHEN ltrim(line) LIKE '|%' THEN 1 ELSE len(string_split(trim(line), chr(9))) END AS w FROM l),
        n AS (SELECT *, coalesce(lag(w) OVER o, 0) AS a, coalesce(lead(w) OVER o, 0) AS z, trim(coalesce(lag(line) OVER o, '')) AS up, trim(coalesce(lead(line) OVER o, '')) AS down FROM w WINDOW o AS (PARTITION BY page_id ORDER BY i)),
        m AS (SELECT *, w >= 2 AND (a = w OR z = w) AS inside FROM n),
        r AS (SELECT page_id, i, CASE WHEN inside THEN CASE WHEN a <> w AND up <> '' THEN chr(10) ELSE '' END || '| ' || array_to_string(list_transform(string_split(trim(line), chr(9)), lambda c: replace(trim(c), '|', '\\|')), ' | ') || ' |'
                 || CASE WHEN a <> w THEN chr(10) || '| ' || array_to_string(list_transform(range(w), lambda x: '---'), ' | ') || ' |' ELSE '' END || CASE WHEN z <> w AND down <> '' THEN chr(10) ELSE '' END ELSE line END AS line FROM m)
        SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS grid FROM r GROUP BY 1 UNION ALL SELECT page_id, NULL FROM p WHERE text IS NULL""",
    "page_hyphens": f"""
        WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE kind = 'section' AND regexp_matches(text, '\\p{{L}}[-‐]\\n')),
        w AS (SELECT chunk_id, {_HYPHENS.format(chr(92) + "1" + chr(92) + "3")} AS j, {_HYPHENS.format(chr(92) + "1" + chr(92) + "2" + chr(92) + "3")} AS k FROM c)
        SELECT chunk_id, len(list_filter(j, lambda x: NOT list_contains(k, x)))::INT AS only_joined, len(list_filter(k, lambda x: NOT list_contains(j, x)))::INT AS only_kept FROM w""",
    "file_labels": "SELECT replace(regexp_replace(filename, '\\.[A-Za-z0-9]+$', ''), '_', ' ') AS label, count(*) AS documents FROM documents WHERE filename IS NOT NULL GROUP BY 1",
}
