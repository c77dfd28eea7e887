from paperloom.operators import tables_check as T


def test_kinds_of_difference(spark, folder):
    got = {r.key: (r.kind, r.differing) for r in T.table_differences(spark, folder).filter("a_height < 4").collect()}
    assert {k: got[k][0] for k in ("same", "size", "rows", "columns", "cells", "none")} == {
        "same": "identical", "size": "dimensions", "rows": "rows_reordered", "columns": "columns_reordered", "cells": "cells_changed", "none": "identical",
    }
    assert got["cells"][1] == 1 and got["rows"][1] == 4


def test_parts_become_one_table_with_the_page_of_each_row(spark):
    got = {r.table_id: (r.pages, r.rows, r.row_pages) for r in T.table_merges(spark, "").collect()}
    assert got["t1"] == ("1,2,3", "Item|2020;a|1;b|2;c|3;d|4", "1,1,2,2,3")
    assert got["t4"] == ("3", "Other|x", "3") and got["t5"] == ("1,2,3", "Item|2020", "1")


def test_figures_in_prose(spark):
    rows = [("a", "Total debt of the group stood at Rs 1,200.5 crore in FY2024. No figure here."), ("b", "Revenue rose."), ("c", "EBITDA was 12 million."), ("d", None)]
    got = [tuple(r) for r in T.text_facts(spark.createDataFrame(rows, "id string, t string"), "id", "t").collect()]
    assert got == [("a", "total_debt", "FY2024", 1200.5e7, "crore", "1,200.5")]


def test_debt_leaves_totals_out(spark, folder):
    (row,) = T.diligence_debt(spark, folder).filter("table_id = 'literal-debt'").collect()
    assert (row.facilities, row.total, row.first_year, row.last_year, row.largest_year, row.low_rate) == (3, 202.5, "2026", "2028", "2028", None)
