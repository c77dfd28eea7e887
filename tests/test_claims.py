import pytest
from paperloom.functions import numbers as N
from paperloom.operators import claims as C
from pyspark.sql import functions as F

NUMBERS = [
    ("1,234", 1234.0, "", 0), ("(1,234.5)", -1234.5, "", 1), ("$ 5 M", 5e6, "$", 0), ("usd 5", 5.0, "$", 0), ("12.5%", 12.5, "%", 1), ("1.234.567", 1234567.0, "", 0), ("1'000.25", 1000.25, "", 2), ("12,34,567.50", 1234567.5, "", 2),
    ("−7", -7.0, "", 0), ("5 mm", None, None, None), ("1,23,4", None, None, None), ("5 apples", None, None, None), ("", None, None, None), (None, None, None, None), ("$5%", None, None, None), ("(-5)", None, None, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NUMBERS)], "i int, t string")
    return {r.i: r.n for r in rows.select("i", N.parse_number(F.col("t")).alias("n")).collect()}


@pytest.mark.parametrize("i", range(len(NUMBERS)))
def test_numbers_as_written(parsed, i):
    _, value, unit, decimals = NUMBERS[i]
    got = parsed[i]
    assert (got is None) if value is None else (float(got.value), got.unit, got.decimals) == (value, unit, decimals)


def test_claims_need_a_cited_source(spark):
    rows = [
        (1, "Revenue of Kabom was 1,200.5 in March.", "kabom earned (1,200.5) crore"), (2, "Revenue of Kabom was 1,201.", "kabom earned 1,200.5"), (3, "Nothing to check here.", "x"), (4, "Nothing to check here.", None), (5, "It was 5.", None),
        (6, "", "x"), (7, None, "x"),
    ]
    df = spark.createDataFrame(rows, "id int, s string, p string").selectExpr("*", "1 as claims")
    got = {r.id: (r.claims, r.supported, r.verified) for r in C.check_sentences(df, "id", "s", "p").collect()}
    assert got[1] == (2, 2, True) and got[2] == (2, 1, False) and got[3] == (1, 1, True) and got[4] == (1, 0, False) and got[5] == (1, 0, False) and got[6] == (1, 1, True)


def test_judging_is_the_same_for_every_pipeline(spark):
    got = {r.case_id: (r.passed, r.cited_ok, r.resisted) for r in C.judge_cases(spark, "").collect()}
    assert [k for k, v in got.items() if v[0]] == [1, 3, 4, 6, 7, 10]
    assert got[1][1] is True and got[2][1] is False and got[3][1] is False and got[4][1] is None and got[9][2] is False and got[10][2] is True
