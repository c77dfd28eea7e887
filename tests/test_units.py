import json

import numpy as np
import pytest
from paperloom.operators import units as U

STATED = [
    ("Profit and loss (INR in Lakhs)", ("lakh", 100_000, "INR")), ("Segment results [Rs millions]", ("million", 1_000_000, "INR")), ("Balance sheet FY2023 - Rs Cr.", ("crore", 10_000_000, "INR")),
    ("Capital spending as at 31 March 2021 in ¥ MM", ("million", 1_000_000, "JPY")), ("Output (metric tons)", ("tonne", 1_000, None)), ("FY2019 [GWh]", ("GWh", 1_000_000, None)),
    ("Change [%]", ("percent", 100, None)), ("Remaining lease terms (yrs)", ("years", 12, None)), ("FY2020 (USD '000)", ("thousand", 1_000, "USD")), ("FY2020 in euro 000s", ("thousand", 1_000, "EUR")),
    ("Lakh Villages scheme: Capital spending", None), ("Thousand Roofs plan: Fixed assets as at 31 March 2020", None), ("Output by plant", None), ("Revenue in India", None), (None, None), ("", None),
]


@pytest.mark.parametrize(("text", "unit"), STATED)
def test_stated(text, unit):
    assert U.stated(text) == unit


def test_notes_cells_and_fields():
    assert U.noted(["Cash", "All figures in '000 ₹"]) == ("thousand", 1_000, "INR")
    assert U.written([None, "EUR 615.8 000s", "-"]) == ("thousand", 1_000, "EUR")
    assert U.written(["₹ (1,234.5) crores"]) == ("crore", 10_000_000, "INR")
    assert U.recorded("Mio.", 1000.0, "US$") == ("million", 1_000_000, "USD")
    assert U.recorded("megawatt hours", None, None) == ("MWh", 1_000, None)
    assert U.recorded(None, None, "USD") is None and U.recorded(None, 1e5, "Rs.") == ("lakh", 100_000, "INR")


def brute(values, penalty):
    n = len(values)
    best = [(-penalty, [])]
    for t in range(1, n + 1):
        best.append(min(((best[s][0] + ((values[s:t] - values[s:t].mean()) ** 2).sum() + penalty, [*best[s][1], s]) for s in range(t)), key=lambda x: x[0]))
    return best[n]


def test_partition_is_exact():
    rng = np.random.default_rng(1)
    for n, noise in ((1, 0.3), (2, 0.3), (7, 0.3), (40, 0.3), (30, 1.0), (30, 1.7), (25, 0.0)):
        values = np.concatenate([rng.normal(m, noise, n) for m in (0, 3, 0.5)])
        cost, starts = brute(values, 1.0)
        got = U.best_partition(values, 1.0)
        bounds = [*got, len(values)]
        mine = sum(((values[a:b] - values[a:b].mean()) ** 2).sum() + 1.0 for a, b in zip(bounds, bounds[1:])) - 1.0
        assert abs(mine - cost) < 1e-9


def grid(paths, rows):
    return json.dumps({"col_paths": paths, "rows": [{"ridx": i, "label": r[0], "cells": [{"raw": str(c), "v": c if isinstance(c, float) else None} for c in r]} for i, r in enumerate(rows)]})


def frame(spark, rows):
    return spark.createDataFrame(rows, "table_id string, workspace_id string, title string, unit string, scale double, currency string, grid_json string").selectExpr("*", "1 as shift", "2 as level")


def test_found_and_history(spark, tmp_path):
    rows = [(f"t{i}", "w", "Segment results FY2020 (USD million)", "million", 1e6, "USD", grid(["P", f"FY20{10 + i}"], [("a", 10.0), ("b", 12.0)])) for i in range(8)]
    rows += [("late", "w", "Segment results", None, None, None, grid(["P", "FY2029"], [("a", 10_000_000.0), ("b", 12_000_000.0)]))]
    rows += [("bad", "w", None, None, None, None, "{"), ("none", "w", None, None, None, None, None), ("wrong", "w", "X (EUR k)", "thousand", 1e6, "EUR", grid(["P", "A", "B [GBP mn]"], [("a", 1.0, 2.0)]))]
    rows += [rows[0]]
    frame(spark, rows).write.parquet(f"{tmp_path}/tables_store.parquet")
    got = sorted(map(tuple, U.p7_found(spark, str(tmp_path)).collect()))
    assert got == [("wrong", 1, "EUR", 1_000), ("wrong", 2, "GBP", 1_000_000)]
    values = U.p7_values(spark, str(tmp_path)).filter("table_id = 't0'").orderBy("ridx").collect()
    assert [r.base_value for r in values] == [10e6, 12e6]


def test_shift_of_a_known_factor_is_named(spark):
    rows = [(f"t{i:02}", "w", "Sales (USD million)", "million", 1e6, "USD", grid(["P", f"FY20{10 + i}"], [("a", 10.0 if i < 8 else 10_000.0)])) for i in range(14)]
    got = {r.table_id: r["shift"] for r in U.histories(U.columns_of(frame(spark, rows))).collect()}
    assert all(abs(got[f"t{i:02}"] - (0 if i < 8 else 3)) < 1e-9 for i in range(14))


def test_a_history_over_many_partitions_is_searched_as_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    level = np.concatenate([rng.normal(m, 0.4, 9) for m in (1, 3.2, 1.5, 5, 4.6)])
    rows = [(f"t{i:02}", "w" if i % 9 else None, "Sales (USD million)", "million", 1e6, "USD", grid(["P", f"FY20{10 + i}"], [("a", float(10**v))])) for i, v in enumerate(level)]
    columns = U.columns_of(frame(spark, rows))
    want = {r.table_id: r["mean"] for r in U.segments(columns).collect()}
    y = {room: [float(np.log10(10**v * 1e6)) for i, v in enumerate(level) if (i % 9 == 0) == room] for room in (True, False)}
    for room, values in y.items():
        bounds = [*U.best_partition(np.array(values)), len(values)]
        means = [m for a, b in zip(bounds, bounds[1:]) for m in [np.mean(values[a:b])] * (b - a)]
        assert np.allclose(means, [want[f"t{i:02}"] for i in range(len(level)) if (i % 9 == 0) == room])
    for size in (2, 5):
        monkeypatch.setattr(U, "BUCKET_ROWS", size)
        got = {r.table_id: r["mean"] for r in U.segments(columns).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_long_level_history_is_quick():
    import time

    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(m, 0.1, 30_000) for m in (0, 1, 0)])
    begin = time.time()
    assert len(U.best_partition(values)) == 3 and time.time() - begin < 30


def test_history_gives_the_unit_where_nothing_states_it(spark, tmp_path):
    """Statements of some columns are taken away; only the changepoints of their history can give them back."""
    rng = np.random.default_rng(4)
    factors = {"lakh": 1e5, "crore": 1e7, "million": 1e6, "thousand": 1e3}
    rows, want = [], {}
    for room in range(6):
        for i in range(20):
            name = ["lakh", "crore", "million", "thousand"][(i // 5 + room) % 4]
            amount = float(4e9 * 10 ** rng.normal(0, 0.1) / factors[name])
            stated = i % 5 < 3
            title = f"Revenue by month (INR {name})" if stated else "Revenue by month"
            key = f"r{room}t{i:02}"
            rows.append((key, f"w{room}", title, name if stated else None, factors[name] if stated else None, "INR" if stated else None, grid(["P", f"FY20{10 + i}"], [("a", amount)])))
            want[key] = None if stated else (key, 1, "INR", int(factors[name]))
    frame(spark, rows).write.parquet(f"{tmp_path}/tables_store.parquet")
    got = sorted(map(tuple, U.p7_found(spark, str(tmp_path)).collect()))
    assert got == sorted(w for w in want.values() if w)
    values = U.p7_values(spark, str(tmp_path)).collect()
    assert {r.place for r in values} == {"title", "history"} and all(1e9 < r.base_value < 1.6e10 for r in values)


def test_empty_table(spark):
    assert U.harmonised(frame(spark, []).limit(0)).collect() == []
