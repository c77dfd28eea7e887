import pytest
from paperloom.plans import table_plan as P

CELLS = "table_id string, scale double, unit string, currency string, row_idx int, col_idx int, label string, is_total boolean, col_path string, period string, raw string, v double"


def debt(spark, currency="INR"):
    rows = [("Term Loan A", 50.0, 2026), ("Revolver", 32.0, 2026), ("Term Loan B", 120.5, 2028), ("Total", 202.5, None)]
    out = []
    for i, (label, amount, year) in enumerate(rows):
        out.append(("d", 1e7, "crore", currency, i, 1, label, label == "Total", "Amount", None, str(amount), amount))
        out.append(("d", 1e7, "crore", currency, i, 2, label, label == "Total", "Maturity", None, str(year or ""), None))
    return spark.createDataFrame(out, CELLS)


def periods(spark):
    rows = [("Revenue", 100.0, 121.0), ("Cost", 60.0, 66.0)]
    return spark.createDataFrame([("p", 1e6, "million", "USD", i, c, r[0], False, f"FY202{3 + 2 * (c - 1)}", f"FY202{3 + 2 * (c - 1)}", str(r[c]), r[c]) for i, r in enumerate(rows) for c in (1, 2)], CELLS)


def value(plan, tables):
    r = P.compile_plan({"steps": plan}, tables).collect()
    assert len(r) == 1
    return r[0]


def look(i, row, col, table="T1"):
    return {"id": i, "op": "lookup", "table": table, "row": row, "col": col}


def test_aggregate_leaves_totals_out(spark):
    t = {"T1": debt(spark)}
    base = {"id": "s", "op": "aggregate", "table": "T1", "col": "Amount"}
    assert value([{**base, "fn": "sum"}], t).value == 202.5
    assert value([{**base, "fn": "sum", "where": {"col": "Maturity", "eq": "2026"}}], t).value == 82.0
    assert value([{**base, "fn": "count", "where": {"col": "Maturity", "contains": "20"}}], t).value == 3
    assert value([{**base, "fn": "sum", "where": {"col": "Maturity", "eq": "1999"}}], t).value == 0
    assert value([{**base, "fn": "max", "where": {"col": "Maturity", "eq": "1999"}}], t).error == "no values to combine"
    assert value([{**base, "fn": "sum", "rows": ["Revolver", "Total"]}], t).value == 234.5


def test_arithmetic(spark):
    t = {"T1": periods(spark)}
    two = [look("a", "Revenue", "FY2023"), look("b", "Revenue", "FY2025")]
    assert value([*two, {"id": "c", "op": "difference", "a": "b", "b": "a"}], t).value == 21
    assert round(value([*two, {"id": "c", "op": "ratio", "a": "b", "b": "a"}], t).value, 6) == 1.21
    assert round(value([*two, {"id": "c", "op": "percent_change", "old": "a", "new": "b"}], t).value, 6) == 21
    assert round(value([*two, {"id": "c", "op": "cagr", "start": "a", "end": "b", "years": 2}], t).value, 6) == 10
    assert value([*two, {"id": "c", "op": "average", "args": ["a", "b"]}], t).value == 110.5


def test_refusals(spark):
    t = {"T1": debt(spark), "T2": periods(spark)}
    assert "several rows" in value([look("a", "Term Loan", "Amount")], t).error
    assert "no cell" in value([look("a", "Goodwill", "Amount")], t).error
    mixed = value([look("a", "Revolver", "Amount"), look("b", "Revenue", "FY2023", "T2"), {"id": "c", "op": "sum", "args": ["a", "b"]}], t)
    assert mixed.value is None and mixed.error == "different currencies"


@pytest.mark.parametrize("plan", [
    None, {}, {"steps": []}, {"steps": [{"id": "a", "op": "eval"}]}, {"steps": [{"id": "a", "op": "sum", "args": ["b"]}]}, {"steps": [look("a", "x", "y"), look("a", "x", "y")]},
    {"steps": [look(str(i), "x", "y") for i in range(25)]}, {"steps": [look("a", "x", "y")], "output": "z"}, {"steps": [{"id": "a", "op": "aggregate", "table": "T", "col": "c", "fn": "median"}]},
])
def test_bad_plans_are_rejected(plan):
    with pytest.raises(P.PlanError):
        P.validate(plan)
