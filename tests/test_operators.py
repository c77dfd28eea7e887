import math
from pathlib import Path

import pytest
from paperloom.operators import grids, layout, retrieval, verification
from pyspark.sql import functions as F


def test_box_measures(spark):
    r = spark.createDataFrame([([0.0, 0.0, 0.5, 0.5], [0.25, 0.25, 0.75, 0.75])], "a array<double>, b array<double>").select(layout.iou("a", "b").alias("i"), layout.containment("a", "b").alias("c")).head()
    assert (round(r.i, 6), r.c) == (round(0.0625 / 0.4375, 6), 0.25)


BOX = "doc_id long, block_id string, ord int, type string, content string, page int, bbox array<double>, confidence double, extractor string, reading_order int, requires_review boolean"


def test_two_columns_are_read_left_then_right_and_cut_by_spanning_blocks(spark):
    boxes = {"head": ("header", [0.1, 0.01, 0.9, 0.03]), "l1": ("paragraph", [0.05, 0.1, 0.45, 0.2]), "r1": ("paragraph", [0.55, 0.1, 0.95, 0.2]), "l2": ("paragraph", [0.05, 0.25, 0.45, 0.35]),
             "r2": ("paragraph", [0.55, 0.25, 0.95, 0.35]), "wide": ("table", [0.05, 0.4, 0.95, 0.5]), "l3": ("paragraph", [0.05, 0.6, 0.45, 0.7]), "foot": ("footer", [0.1, 0.97, 0.9, 0.99]), "nobox": ("paragraph", None)}
    rows = [(1, k, i, kind, k, 1, b, None, None, None, False) for i, (k, (kind, b)) in enumerate(reversed(boxes.items()))]
    got = [r.block_id for r in layout.reading_order(spark.createDataFrame(rows, BOX)).orderBy("position").collect()]
    assert got == ["head", "l1", "l2", "r1", "r2", "wide", "l3", "nobox", "foot"]


def test_page_text_and_ranges(spark):
    rows = spark.createDataFrame([("1,3-5, 9-7,x,0", 8)], "t string, n int").select(layout.parse_pages(F.col("t"), F.col("n")).alias("p")).head()
    assert rows.p == [1, 3, 4, 5, 7, 8]
    df = spark.createDataFrame([(1, p) for p in (1, 2, 3, 5, 7, 8, 2, None)], "g int, p int")
    assert layout.page_ranges(df, "g", "p").head().pages == "1-3, 5, 7-8"


def test_unique_ids(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 2), (1, "a", 3)], "doc_id int, block_id string, ord int")
    assert [r.unique_id for r in layout.unique_ids(df).orderBy("ord").collect()] == ["a", "a~2", "b", "a~3"]


def test_assignment_is_best_first_with_stable_ties(spark):
    pairs = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.95), (1, "b", "y", 0.95), (1, "b", "x", 0.2), (1, "c", "z", 0.1)], "g int, l string, r string, s double")
    assert sorted((r.l, r.r) for r in verification.assign(pairs, "g", "l", "r", "s", 0.2).collect()) == [("a", "y"), ("b", "x")]


@pytest.mark.parametrize(("seq", "moved"), [([1, 2, 3], 0), ([3, 1, 2], 1), ([2, 2], 1), ([5, 4, 3, 2], 3)])
def test_longest_increasing_run(spark, seq, moved):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(seq)], "g int, o int, v int")
    assert verification.displaced(df, "g", "o", "v").head().displaced == moved


def test_rollup_takes_the_worst(spark):
    df = spark.createDataFrame([(1, "verified"), (1, "review"), (1, "recovered"), (2, "verified"), (3, "not_verifiable"), (3, "recovered")], "d int, s string")
    got = {r.d: r.s for r in df.groupBy("d").agg(verification.worst_status(F.col("s")).alias("s")).collect()}
    assert got == {1: "review", 2: "verified", 3: "not_verifiable"}


def test_duplicates_name_the_first_of_their_place(spark, tmp_path):
    import json

    def block(key, text, box):
        return (1, key, int(key[1:]), json.dumps({"id": key, "type": "paragraph", "content": text, "page": 1, "bbox": box}))

    rows = [block(f"b{i}", "Same words", [0.1, 0.1, 0.5, 0.2]) for i in range(4)] + [block("b4", "same  words!", [0.1, 0.101, 0.5, 0.2]), block("b5", "same words", [0.6, 0.1, 0.9, 0.2]), block("b6", "other", [0.1, 0.1, 0.5, 0.2])]
    spark.createDataFrame(rows, "doc_id long, block_id string, ord int, json string").write.parquet(f"{tmp_path}/blocks.parquet")
    got = sorted((r.dropped, r.kept) for r in layout.duplicates(layout.blocks(spark, str(tmp_path))).collect())
    assert got == [(f"b{i}", "b0") for i in range(1, 5)]


def test_issues_of_no_block_still_decide_their_document(spark):
    rows = spark.createDataFrame([(1, "b0", 0, "paragraph", "text", 1, [0.1, 0.1, 0.9, 0.2], 0.9, "x", 0, False), (2, "c0", 0, "paragraph", "text", 1, [0.1, 0.1, 0.9, 0.2], 0.9, "x", 0, False)], BOX)
    docs = spark.createDataFrame([(1, None), (2, 2)], "doc_id long, page_count int")
    issues = verification.integrity(rows, docs).unionByName(verification.empty_units(rows, docs))
    got = {(r.doc_id, r.unit): r.status for r in verification.roll_up(rows, issues).collect()}
    assert got == {(1, "1:1"): "verified", (1, "1"): "failed", (2, "2:1"): "verified", (2, "2:2"): "not_verifiable"}


def test_faults_are_named_by_their_rule(spark):
    good = (1, "b0", 0, "paragraph", "text of a block", 1, [0.1, 0.1, 0.9, 0.2], 0.9, "x", 0, False)
    faults = {"duplicate_block_id": {"block_id": "b0"}, "invalid_page_reference": {"page": 0}, "empty_content": {"content": " "}, "control_characters": {"content": "a\x01b"}, "replacement_character": {"content": "a�"},
              "invalid_bbox": {"bbox": [0.5, 0.5, 0.1, 0.9]}, "invalid_confidence": {"confidence": 1.5}, "missing_reading_order": {"reading_order": None}, "review_requested": {"requires_review": True}, "unknown_type": {"type": "poem"},
              "adjacent_repeat": {"content": "text of a block"}}
    names = [c.split()[0] for c in BOX.split(", ")]
    docs = spark.createDataFrame([(1, 5)], "doc_id long, page_count int")
    for code, change in faults.items():
        other = {**dict(zip(names, good)), "block_id": "b1", "ord": 1, "reading_order": 1, "content": "other text here", **change}
        got = {r.code for r in verification.integrity(spark.createDataFrame([good, tuple(other[n] for n in names)], BOX), docs).collect()}
        assert code in got, (code, got)
    clean = {**dict(zip(names, good)), "block_id": "b1", "ord": 1, "reading_order": 1, "content": "other text here"}
    assert verification.integrity(spark.createDataFrame([good, tuple(clean[n] for n in names)], BOX), docs).collect() == []


CELLS = "table_id string, doc_id long, workspace_id string, title string, page int, unit string, scale double, currency string, statement_kind string, kind string, row_idx int, col_idx int, label string, is_total boolean, col_path string, period string, raw string, v double"


def cell(doc, row, label, v, total=False, raw=None, currency="USD", table=None):
    return (table or f"t{doc}", doc, "w", "T", 1, "million", 1e6, currency, None, "table", row, 1, label, total, "FY2025", "FY2025", raw or f"{v}", v)


def test_contradictions_and_tolerance(spark):
    rows = [cell(1, 0, "Revenue", 452.0), cell(2, 0, "Total revenue", 480.0), cell(3, 0, "Revenue", 999.0, currency="EUR"), cell(1, 1, "EBITDA", 100.0), cell(2, 1, "EBITDA", 100.4), cell(4, 0, "Cost", 5.0)]
    got = grids.contradictions(grids.facts(spark.createDataFrame(rows, CELLS))).collect()
    assert [(r.concept, r.gap_percent, r.severity) for r in got] == [("revenue", 6.2, "high")]


def test_totals_reset_and_tolerate_rounding(spark):
    rows = [cell(1, i, f"r{i}", 10.1 + i) for i in range(3)] + [cell(1, 3, "Total", 33.3, True)] + [cell(1, 4 + i, f"s{i}", 1.0) for i in range(3)] + [cell(1, 7, "Total", 6.0, True)]
    got = grids.total_checks(spark.createDataFrame(rows, CELLS)).orderBy("block").collect()
    assert [(r.holds, r.difference) for r in got] == [(True, 0.0), (False, 3.0)]


def test_maturity_wall(spark):
    rows = []
    for i, (label, amount, year) in enumerate([("A", 50.0, 2026), ("B", 32.0, 2026), ("C", 120.5, 2028), ("Total", 202.5, None)]):
        a = list(cell(1, i, label, amount, label == "Total"))
        a[14] = "Amount"
        m = list(cell(1, i, label, None, label == "Total", str(year)))
        m[11], m[14] = 2, "Maturity"
        rows += [tuple(a), tuple(m)]
    got = {r.year: r.due for r in grids.maturity_wall(spark.createDataFrame(rows, CELLS)).collect()}
    assert got == {"2026": 82.0, "2028": 120.5}


def test_correction_tells_what_changed(spark):
    rows = [cell(1, i, f"r{i}", 10.0) for i in range(3)] + [cell(1, 3, "Total", 33.0, True)]
    got = grids.correction_effect(spark.createDataFrame(rows, CELLS), "t1", 0, 1, 13.0).collect()
    assert [(r.what, r.change) for r in got] == [("total", "resolved")]


def test_fusion_and_cosine(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 2), (1, "c", 1)], "question_id int, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in retrieval.fused(ranks).collect()}
    assert abs(got["a"] - (1 / 61 + 1 / 62)) < 1e-9 and abs(got["c"] - 1 / 61) < 1e-9
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>").select(retrieval.cosine(F.col("a"), F.col("b")).alias("c")).head().c
    assert abs(v - math.sqrt(0.5)) < 1e-9


def test_every_query_runs_on_the_smallest_tables(spark, folder):
    if not Path(folder).exists():
        pytest.skip("no test tables")
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if not n.startswith("p")]
    for name in names:
        entry.queries()[name](spark, folder).count()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["question_id", "chunk_id", "score", "rank"]
