import json

from paperloom.functions import latex
from paperloom.operators import chunking, geometry, layout
from paperloom.plans import planner

CELLS = "table_id string, title string, scale double, unit string, currency string, row_idx int, col_idx int, label string, is_total boolean, col_path string, period string, raw string, v double"


def cells(spark):
    rows = []
    for i, (label, a, b) in enumerate([("Revenue", 121.0, 100.0), ("Cost of sales", 66.0, 60.0), ("Gross profit", 55.0, 40.0)]):
        rows += [("p", "Profit and loss", 1e6, "million", "USD", i, c, label, False, f"FY{y}", f"FY{y}", str(v), v) for c, y, v in ((1, 2025, a), (2, 2023, b))]
    for i, (label, a, y) in enumerate([("Term Loan A", 50.0, 2026), ("Revolver", 32.0, 2026), ("Term Loan B", 120.5, 2028)]):
        rows += [("d", "Debt schedule", 1e7, "crore", "INR", i, 1, label, False, "Amount", None, str(a), a), ("d", "Debt schedule", 1e7, "crore", "INR", i, 2, label, False, "Maturity", None, str(y), None)]
    return spark.createDataFrame(rows, CELLS)


def test_questions_become_plans(spark):
    t = cells(spark)
    assert planner.answer(t, "What was the revenue growth in the profit and loss from 2023 to 2025?")["value"] == 21
    assert planner.answer(t, "What was gross profit in FY2023 in the profit and loss?")["value"] == 40
    assert round(planner.answer(t, "What is the ratio of gross profit to revenue in FY2025, profit and loss?")["value"], 4) == round(55 / 121, 4)
    assert planner.answer(t, "How much debt of the debt schedule is maturing in 2026?")["value"] == 82
    assert planner.answer(t, "Who chairs the board?") is None


def test_specific_labels_win():
    assert planner.mentioned(["Term Loan", "Term Loan A", "Revolver"], "What is Term Loan A?") == ["Term Loan A"]


def test_packing_keeps_order_budget_and_whole_tables(spark):
    kind = "doc_id long, block_id string, type string, content string, page int, confidence double, level int, position int"
    rows = [(1, "h", "heading", "Risks", 1, None, 1, 0)] + [(1, f"p{i}", "paragraph", "word " * 150, 1 + i // 3, 0.5 + i / 100, None, i + 1) for i in range(6)]
    rows += [(1, "t", "table", "cell " * 900, 3, 0.9, None, 7), (1, "f", "footer", "p. 3", 3, None, None, 8), (1, "n", "paragraph", None, 3, None, None, 9), (1, "long", "paragraph", "A sentence of six words here. " * 300, 4, None, None, 10)]
    got = chunking.build_chunks(spark.createDataFrame(rows, kind)).orderBy("chunk_no").collect()
    assert [r.kind for r in got[:4]] == ["section", "section", "section", "table"] and got[0].block_ids == ["p0", "p1"]
    assert all(r.tokens <= chunking.MOST for r in got if r.kind == "section") and got[0].min_confidence == 0.5 and got[0].heading == '["Risks"]'
    assert sum(r.text.count("sentence") for r in got) == 300


def test_recorded_heading_levels_nest(spark, tmp_path):
    def block(i, kind, content, level=None):
        meta = {} if level is None else {"heading_level": level}
        return 1, f"b{i}", i, json.dumps({"id": f"b{i}", "type": kind, "content": content, "page": 1, "bbox": [0.1, 0.05 * i, 0.9, 0.05 * i + 0.04], "metadata": meta})

    parts = [("heading", "Report", 1), ("heading", "Debt", 3), ("paragraph", "a"), ("heading", "Leases", 3), ("paragraph", "b"), ("heading", "Risks", 2), ("paragraph", "c"), ("heading", "Annex"), ("paragraph", "d")]
    rows = [block(i, *p) for i, p in enumerate(parts, 1)]
    spark.createDataFrame(rows, "doc_id long, block_id string, ord int, json string").write.parquet(f"{tmp_path}/blocks.parquet")
    got = {r.text: json.loads(r.heading) for r in chunking.chunk_sections(spark, str(tmp_path)).collect()}
    assert got == {"a": ["Report", "Debt"], "b": ["Report", "Leases"], "c": ["Report", "Risks"], "d": ["Annex"]}
    text = layout.layout_markdown(spark, str(tmp_path)).head().markdown
    assert [s for s in text.split("\n\n") if s.startswith("#")] == ["# Report", "### Debt", "### Leases", "## Risks", "# Annex"]


def test_rows_columns_and_numeric_tables(spark):
    words = []
    for r, (label, *numbers) in enumerate([("Cash", "1.0", "22.5"), ("Debt", "310.0", "4.1"), ("Tax", "5.5", "60.0")]):
        y = 0.1 + 0.03 * r
        words.append((1, 0.1, y, 0.2, y + 0.01, label))
        words += [(1, x - 0.02 * len(n), y + 0.001, x, y + 0.011, n) for x, n in zip((0.5, 0.8), numbers)]
    words.append((2, 0.1, 0.1, 0.2, 0.11, "alone"))
    df = spark.createDataFrame(words, "page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r.line for r in geometry.lines_of_text(df).filter("page = 1").orderBy("row").collect()] == ["Cash 1.0 22.5", "Debt 310.0 4.1", "Tax 5.5 60.0"]
    assert [(r.page, r.columns, r.rows) for r in geometry.numeric_tables(df).collect()] == [(1, 2, 3)]
    region = spark.createDataFrame([(1, 0.0, 0.0, 0.3, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert geometry.outside(df, region).filter("page = 1").count() == 6


def test_ruled_grid_and_route(spark):
    rules = [(1, 0.1, y, 0.9, y + 0.001) for y in (0.1, 0.5, 0.9)] + [(1, x, 0.1, x + 0.001, 0.9) for x in (0.1, 0.899)] + [(2, 0.1, 0.1, 0.9, 0.101)]
    box = "page int, x0 double, y0 double, x1 double, y1 double"
    assert [r.page for r in geometry.ruled_grid(spark.createDataFrame(rules, box)).collect()] == [1]
    words = spark.createDataFrame([(1, 0.1, 0.1, 0.2, 0.12, "a")], box + ", text string")
    images = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.9), (3, 0.0, 0.0, 1.0, 1.0)], box)
    assert {r.page: r.route for r in geometry.page_statistics(words, images).collect()} == {1: "scanned", 3: "scanned"}


def test_latex_checks():
    assert latex.problems("\\frac{a}{b} + \\left( x \\right)") == [] and latex.problems(None) == []
    assert "braces" in latex.problems("{a") and "environments" in latex.problems("\\begin{a}\\end{b}") and "left_right" in latex.problems("\\left(") and "dollars" in latex.problems("$a")
    assert latex.inline_equations("where DSCR = a/b and x_1 >= 3 holds") and not latex.inline_equations("no equation here, 2019-20")
    assert latex.agreement("\\alpha x^2", "x 2") == 1.0 and latex.agreement("abc", "xyz") == 0.0
