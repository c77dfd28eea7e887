from paperloom.operators import repairs as R
from pyspark.sql import functions as F


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_runs_of_equal_lines_are_cut(spark):
    assert column(spark, ["a\na\na\na\na\nb\na", "x", "", None], R.trim_repetition) == ["a\na\na\nb\na", "x", "", None]


def test_superscripts_and_spacing(spark):
    assert column(spark, ["x^2 and 10^{-3}, a^b", "plain"], R.superscripts) == ["x² and 10⁻³, a^b", "plain"]
    assert column(spark, ["one , two ; three,four 1,234"], R.punctuation_spacing) == ["one, two; three, four 1,234"]


def test_quality_flags(spark):
    long = "a paragraph of more than forty characters in all"
    got = column(spark, [f"{long}\n\n{long}\n\n{long}", "\n".join(["5"] * 15), "\\begin{a} [illegible]", "clean text", None], R.quality_flags)
    assert got[0] == ["repeated_paragraph"] and got[1] == ["repeated_line"] and got[2] == ["unbalanced_formula", "illegible"] and got[3] == [] and not got[4]


def test_document_types(spark):
    rows = [("whereas this agreement is made", "x.pdf", "pdf"), ("nothing", "loan_agreement.docx", "docx"), ("balance sheet and cash flow", "a.xlsx", "xlsx"), (None, "deck.pptx", "pptx"), ("", "b.xlsx", "xlsx"), ("x", "CIM_final.pdf", "pdf")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, n string, f string")
    got = [r.k for r in df.select("i", R.document_type(F.col("t"), F.col("n"), F.col("f")).alias("k")).orderBy("i").collect()]
    assert got == ["contract", "contract", "financial_statement", "presentation", "spreadsheet", "cim"]


def test_headers_and_spans(spark):
    rows = [("t", 0, 0, "Region"), ("t", 0, 1, "Sales"), ("t", 0, 2, None), ("t", 1, 0, "Unit"), ("t", 1, 1, "kg"), ("t", 1, 2, "m"), ("t", 2, 0, "North"), ("t", 2, 1, "1,200"), ("t", 2, 2, "5")]
    df = spark.createDataFrame(rows, "table_id string, row_idx int, col_idx int, raw string")
    assert R.header_rows(df).head().header_rows == 2
    assert [tuple(r) for r in R.merged_spans(df).collect()] == [("t", 0, 1, 2)]


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 0.99), (3, 0.98, 0.1), (4, None, 0.5)], "i int, a double, b double")
    got = [r.v for r in rows.select("i", R.recovery_verdict(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == ["both", "candidate", "original", "inconclusive"]
