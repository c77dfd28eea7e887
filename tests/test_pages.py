import pytest
from paperloom.operators import pages as P
from pyspark.sql import functions as F


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_labelled_furniture_leaves_the_body(spark):
    texts = ["<page-header> A </page-header>\nbody\n<Page-Footer>3</Page-Footer>", "<page-header>open only", "plain", "", None]
    assert column(spark, texts, P.without_furniture) == ["body", "open only", "plain", "", None]
    assert column(spark, texts, lambda t: P.labelled(t, "page-header")) == [["A"], [], [], [], None]


@pytest.mark.parametrize(("text", "plain"), [("5 m<sup>2</sup>", "5 m²"), ("H<sub>2</sub>O<sub>x</sub>", "H₂Ox"), ("<B>a</B><br>b < c", "a b < c"), ("<sup>1</sup><sup>2</sup>", "¹²"), (None, None)])
def test_inline_tags(spark, text, plain):
    assert column(spark, [text], P.inline_tags) == [plain]


def test_tabbed_grids_need_two_lines_of_one_width(spark):
    got = column(spark, ["x\na\tb\n1\t2|3\ny", "a\tb\n1\t2\t3", "| a\tb\n| c\td", None], P.tabbed_grids)
    assert got == ["x\n\n| a | b |\n| --- | --- |\n| 1 | 2\\|3 |\n\ny", "a\tb\n1\t2\t3", "| a\tb\n| c\td", None]


def test_either_reading_of_a_hyphen_will_do(spark):
    rows = spark.createDataFrame([("the inter-\nnational e-\nmail", "international e-mail"), ("inter-\nnational", "international"), ("e-\nmail", "e mail"), ("a", "b")], "t string, w string")
    assert [r.m for r in rows.select(P.matches_either(F.col("t"), F.col("w")).alias("m")).collect()] == [False, True, True, False]
    assert column(spark, ["a_b.pdf", "x", None], P.file_label) == ["a b", "x", None]
