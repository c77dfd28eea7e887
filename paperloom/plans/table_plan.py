"""The table-operation language: a JSON plan of whitelisted steps, compiled to DataFrame operations.

A plan is {"title", "steps": [...], "output": id}. Steps refer to tables by alias
and to earlier steps by id. Nothing is evaluated from text. Each step becomes a
frame of one row a key (value, scale, unit, currency, kind, operands, warnings,
error); a step that cannot be computed carries an error instead of a value, and what
depends on it carries it on. With a key column one plan runs over any number of
tables at once, as group-bys and joins on the key; without one there is one key.

Rules kept: totals are left out of aggregates unless rows are named; an empty sum
or count is 0, an empty average, minimum or maximum an error; amounts of different
currencies or kinds are never combined; percent is stored as a fraction and shown
times 100; a label that fits several rows equally well, but none exactly, is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPERATIONS = ("lookup", "aggregate", "sum", "average", "min", "max", "count", "difference", "ratio", "percent_change", "cagr", "filter")
AGGREGATES = ("sum", "average", "min", "max", "count")
MOST_STEPS = 24
ROW_FROM, COL_FROM = 0.7, 0.6
# Words that do not tell labels apart.
LABEL_STOPS = "the an of and in on for to as at by total net from with".split()

VALUE = (
    "value double, scale double, unit string, currency string, kind string, "
    "operands array<struct<label:string,col_path:string,raw:string>>, warnings array<string>, error string"
)


FIELDS = tuple(field.split()[0] for field in VALUE.split(", "))
#: Name of the key column inside a compiled plan.
KEY = "_key"


class PlanError(ValueError):
    """The plan itself is not valid."""


def validate(plan: object) -> dict:
    """The plan, if it is well formed: known operations, unique ids, references to earlier steps only."""
    if not isinstance(plan, dict) or not isinstance(plan.get("steps"), list) or not plan["steps"]:
        raise PlanError("a plan needs a list of steps")
    if len(plan["steps"]) > MOST_STEPS:
        raise PlanError(f"a plan has at most {MOST_STEPS} steps")
    known: set[str] = set()
    for step in plan["steps"]:
        if not isinstance(step, dict) or not isinstance(step.get("id"), str) or step["id"] in known:
            raise PlanError("every step needs an id of its own")
        if step.get("op") not in OPERATIONS:
            raise PlanError(f"unknown operation {step.get('op')!r}")
        asked = [*(step.get("args") or []), *(step[k] for k in ("a", "b", "old", "new", "start", "end") if isinstance(step.get(k), str))]
        if missing := [a for a in asked if a not in known]:
            raise PlanError(f"step {step['id']} refers to {missing}, which no earlier step gives")
        if step["op"] in ("lookup", "aggregate", "filter") and not (step.get("table") and step.get("col")):
            raise PlanError(f"step {step['id']} needs a table and a column")
        if step["op"] == "aggregate" and step.get("fn") not in AGGREGATES:
            raise PlanError(f"unknown aggregate {step.get('fn')!r}")
        known.add(step["id"])
    if plan.get("output", plan["steps"][-1]["id"]) not in known:
        raise PlanError("the output is not a step")
    return plan


def label_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def label_score(wanted: Column, label: Column) -> Column:
    """1 for the same words, then 0.97, 0.9, 0.75 for same, wider and narrower sets, else 0.85 times their overlap."""
    a, b = label_words(wanted), label_words(label)
    stops = F.array(*(F.lit(w) for w in LABEL_STOPS))

    def told(words: Column) -> Column:
        kept = F.array_distinct(F.array_except(words, stops))
        return F.when(F.size(kept) > 0, kept).otherwise(F.array_distinct(words))

    x, y = told(a), told(b)
    common = F.size(F.array_intersect(x, y))
    return (
        F.when((F.size(a) <= 0) | (F.size(b) <= 0) | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0)
        .when((common == F.size(x)) & (common == F.size(y)), 0.97).when(common == F.size(x), 0.9).when(common == F.size(y), 0.75)
        .otherwise(common / F.size(F.array_union(x, y)) * 0.85)
    )


def _column(cells: DataFrame, wanted: str) -> DataFrame:
    """Cells of each key's best column; the first of equals."""
    from paperloom.functions.finance import period

    score = F.greatest(label_score(F.lit(wanted), F.col("col_path")), F.when(period(F.lit(wanted)) == F.col("period"), 0.98).otherwise(0.0))
    scored = cells.select(KEY, "col_idx", "col_path", "period").distinct().withColumn("s", score).filter(F.col("s") >= COL_FROM)
    best = scored.groupBy(KEY).agg(F.min_by("col_idx", F.struct(-F.col("s"), F.col("col_idx"))).alias("col_idx"))
    return cells.join(best, [KEY, "col_idx"])


def _row(cells: DataFrame, wanted: str) -> DataFrame:
    """Cells of each key's best row, with ``tied`` set where several rows fit equally well but not exactly."""
    rows = cells.select(KEY, "row_idx", "label").distinct().withColumn("s", label_score(F.lit(wanted), F.col("label"))).filter(F.col("s") >= ROW_FROM)
    best = rows.groupBy(KEY, "s").agg(F.min("row_idx").alias("row_idx"), F.count(F.lit(1)).alias("n")).groupBy(KEY).agg(F.max_by(F.struct("row_idx", "n", "s"), "s").alias("b"))
    return cells.join(best.select(KEY, "b.row_idx", ((F.col("b.n") > 1) & (F.col("b.s") < 1)).alias("tied")), [KEY, "row_idx"])


def _kind() -> Column:
    percent = F.coalesce(F.col("raw").contains("%"), F.lit(False))
    amount = F.col("currency").isNotNull() | (F.col("scale") > 1)
    return F.when(percent, "pct").when(amount, "amount").otherwise("number")


def _operand() -> Column:
    return F.struct("label", "col_path", "raw")


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _lookup(cells: DataFrame, step: dict, keys: DataFrame) -> DataFrame:
    hit = _row(_column(cells, step["col"]), step["row"])
    error = F.when(F.col("tied"), F.lit(f"'{step['row']}' matches several rows")).when(F.col("v").isNull(), F.lit("the cell holds no number"))
    value = hit.select(
        KEY, F.when(error.isNull(), F.col("v")).alias("value"), F.coalesce("scale", F.lit(1.0)).alias("scale"), "unit", "currency", _kind().alias("kind"),
        F.array(_operand()).alias("operands"), F.array().cast("array<string>").alias("warnings"), error.alias("error"), F.lit(True).alias("hit"),
    ).dropDuplicates([KEY])
    missing = F.when(F.col("hit").isNull(), F.lit(f"no cell for '{step['row']}' and '{step['col']}'"))
    empty = {c: F.coalesce(c, F.array().cast(dict(value.dtypes)[c])).alias(c) for c in ("operands", "warnings")}
    rows = keys.join(value, KEY, "left").withColumn("error", F.coalesce("error", missing))
    return rows.select(*(empty.get(c, c) for c in (KEY, *FIELDS)))


def _aggregate(cells: DataFrame, step: dict, keys: DataFrame) -> DataFrame:
    fn = step.get("fn", "count")
    part = _column(cells, step["col"])
    if step.get("rows"):
        part = reduce(DataFrame.unionByName, [_row(part, r).drop("tied") for r in step["rows"]])
    else:
        part = part.filter(~F.coalesce("is_total", F.lit(False)))
    if where := step.get("where"):
        told = _column(cells, where["col"]).select(KEY, "row_idx", F.coalesce("raw", F.lit("")).alias("_w"))
        if "eq" in where:
            want = str(where["eq"])
            test = F.lower(F.trim("_w")) == want.lower().strip()
            if want.isdigit() and len(want) == 4:
                test = test | F.col("_w").rlike(rf"\b{want}\b")
        else:
            test = F.lower("_w").contains(str(where["contains"]).lower())
        part = part.join(told.filter(test).select(KEY, "row_idx").distinct(), [KEY, "row_idx"], "left_semi")
    base = F.col("v") * F.coalesce("scale", F.lit(1.0))
    if fn != "count":
        part = part.filter("v is not null")
    # A key without rows has one row of nulls: its sum and count are 0.
    part = keys.join(part, KEY, "left")
    there = F.col("row_idx").isNotNull()
    lead = F.min_by(F.coalesce("scale", F.lit(1.0)), F.when(there, F.struct("row_idx", "col_idx")))
    measure = {"sum": F.coalesce(F.sum(base), F.lit(0.0)), "average": F.avg(base), "min": F.min(base), "max": F.max(base), "count": F.count("row_idx").cast("double")}[fn]
    made = part.groupBy(KEY).agg(
        measure.alias("m"), F.coalesce(lead, F.lit(1.0)).alias("scale"), F.first("unit", True).alias("unit"), F.first("currency", True).alias("currency"),
        F.array_sort(F.collect_set("currency")).alias("codes"), F.array_sort(F.collect_set(F.when(there, _kind()))).alias("kinds"),
        F.array_sort(F.collect_list(F.when(there, F.struct("row_idx", _operand().alias("o")))))["o"].alias("operands"),
    )
    none = F.array().cast("array<string>").alias("warnings")
    if fn == "count":
        return made.select(
            KEY, F.col("m").alias("value"), F.lit(1.0).alias("scale"), _nothing("string").alias("unit"), _nothing("string").alias("currency"), F.lit("count").alias("kind"),
            "operands", none, _nothing("string").alias("error"),
        )
    mixed = F.when(F.size("codes") > 1, "different currencies").when(F.size(F.array_except("kinds", F.array(F.lit("number")))) > 1, "different kinds of value")
    mixed = F.coalesce(mixed, F.when(F.col("m").isNull(), "no values to combine"))
    kind = F.coalesce(F.get(F.array_except("kinds", F.array(F.lit("number"))), F.lit(0)), F.lit("number"))
    return made.select(KEY, F.when(mixed.isNull(), F.col("m") / F.col("scale")).alias("value"), "scale", "unit", "currency", kind.alias("kind"), "operands", none, mixed.alias("error"))


def _combine(steps: list[DataFrame], fn: str) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [s.withColumn("n", F.lit(k)) for k, s in enumerate(steps)])
    base = F.col("value") * F.when(F.col("kind") == "amount", F.col("scale")).otherwise(1.0)
    measure = {"sum": F.sum(base), "average": F.avg(base), "min": F.min(base), "max": F.max(base), "count": F.count("value").cast("double")}[fn]
    made = rows.groupBy(KEY).agg(
        measure.alias("m"), F.min_by("scale", "n").alias("scale"), F.min_by("unit", "n").alias("unit"), F.min_by("currency", "n").alias("currency"),
        F.collect_set("currency").alias("codes"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.flatten(F.collect_list("operands")).alias("operands"),
        F.array_distinct(F.flatten(F.collect_list("warnings"))).alias("warnings"), F.min("error").alias("failed"),
    )
    other = F.array_except("kinds", F.array(F.lit("number")))
    error = F.coalesce("failed", F.when(F.size("codes") > 1, "different currencies").when(F.size(other) > 1, "different kinds of value"))
    kind = F.lit("count") if fn == "count" else F.coalesce(F.get(other, F.lit(0)), F.lit("number"))
    scale = F.when(kind == "amount", F.col("scale")).otherwise(1.0)
    return made.select(KEY, F.when(error.isNull(), F.col("m") / scale).alias("value"), scale.alias("scale"), "unit", "currency", kind.alias("kind"), "operands", "warnings", error.alias("error"))


def _pair(first: DataFrame, second: DataFrame, op: str, years: float | None = None) -> DataFrame:
    a = first.select(KEY, *(F.col(c).alias(f"a_{c}") for c in FIELDS))
    b = second.select(KEY, *(F.col(c).alias(f"b_{c}") for c in FIELDS))
    rows = a.join(b, KEY)

    def base(s: str) -> Column:
        return F.col(f"{s}_value") * F.when(F.col(f"{s}_kind") == "amount", F.col(f"{s}_scale")).otherwise(1.0)

    x, y = base("a"), base("b")
    error = F.coalesce("a_error", "b_error")
    error = F.coalesce(error, F.when(F.col("a_currency") != F.col("b_currency"), "different currencies"))
    clash = (F.col("a_kind") != F.col("b_kind")) & ~F.col("a_kind").isin("number") & ~F.col("b_kind").isin("number")
    error = F.coalesce(error, F.when(clash, "different kinds of value"))
    nothing = F.lit(None).cast("string")
    if op == "difference":
        scale = F.when(F.col("a_kind") == "amount", F.col("a_scale")).otherwise(1.0)
        value, kind, unit, code = (x - y) / scale, F.col("a_kind"), F.col("a_unit"), F.col("a_currency")
    elif op == "ratio":
        error = F.coalesce(error, F.when(y == 0, "division by zero"))
        value, kind, unit, code, scale = x / F.nullif(y, F.lit(0.0)), F.lit("ratio"), nothing, nothing, F.lit(1.0)
    elif op == "percent_change":
        error = F.coalesce(error, F.when(x == 0, "the old value is zero"))
        value, kind, unit, code, scale = (y - x) / F.nullif(F.abs(x), F.lit(0.0)) * 100, F.lit("pct"), nothing, nothing, F.lit(1.0)
    else:
        error = F.coalesce(error, F.when((x <= 0) | (y <= 0) | F.lit(not years or years <= 0), "growth needs positive values and years"))
        ok = (x > 0) & (y > 0) & F.lit(bool(years and years > 0))
        value = F.when(ok, (F.pow(y / F.nullif(x, F.lit(0.0)), F.lit(1.0 / (years or 1.0))) - 1) * 100)
        kind, unit, code, scale = F.lit("pct"), nothing, nothing, F.lit(1.0)
    return rows.select(
        KEY, F.when(error.isNull(), value).alias("value"), scale.cast("double").alias("scale"), unit.alias("unit"), code.alias("currency"), kind.alias("kind"),
        F.concat("a_operands", "b_operands").alias("operands"), F.array_distinct(F.concat("a_warnings", "b_warnings")).alias("warnings"), error.alias("error"),
    )


def compile_plan(plan: dict, tables: dict[str, DataFrame], key: str | None = None) -> DataFrame:
    """The plan's result and receipt; ``tables`` maps aliases to frames of cells.

    One row without ``key``; with it one row for every value of that column in any of
    the tables, each computed from the cells of its value alone.
    """
    validate(plan)
    keyed = {alias: t.withColumn(KEY, F.col(key) if key else F.lit(0)) for alias, t in tables.items()}
    if key:
        keys = reduce(DataFrame.unionByName, [t.select(KEY) for t in keyed.values()]).distinct()
    else:
        keys = next(iter(tables.values())).sparkSession.createDataFrame([(0,)], f"{KEY} int")
    made: dict[str, DataFrame] = {}
    for step in plan["steps"]:
        op = step["op"]
        if op in ("lookup", "aggregate", "filter") and step["table"] not in tables:
            raise PlanError(f"unknown table {step['table']!r}")
        if op == "lookup":
            out = _lookup(keyed[step["table"]], step, keys)
        elif op in ("aggregate", "filter"):
            out = _aggregate(keyed[step["table"]], step, keys)
        elif op in AGGREGATES:
            out = _combine([made[a] for a in step["args"]], op)
        elif op in ("difference", "ratio"):
            out = _pair(made[step["a"]], made[step["b"]], op)
        elif op == "percent_change":
            out = _pair(made[step["old"]], made[step["new"]], op)
        else:
            out = _pair(made[step["start"]], made[step["end"]], op, step.get("years"))
        made[step["id"]] = out
    out = made[plan.get("output", plan["steps"][-1]["id"])]
    return out.withColumnRenamed(KEY, key) if key else out.drop(KEY)


def display(value: Column, kind: Column, currency: Column, unit: Column) -> Column:
    symbol = F.coalesce(F.create_map(*(F.lit(x) for x in ("INR", "₹", "USD", "$", "EUR", "€", "GBP", "£", "JPY", "¥")))[currency], F.lit(""))
    return (
        F.when(kind == "pct", F.concat(F.format_number(value, 2), F.lit("%"))).when(kind == "ratio", F.concat(F.format_number(value, 2), F.lit("x")))
        .when(kind == "count", F.format_number(value, 0))
        .otherwise(F.concat(symbol, F.format_number(value, 2), F.coalesce(F.concat(F.lit(" "), unit), F.lit(""))))
    )


# --- the same operations over every table at once: what a batch of plans becomes ---------------------------------


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.operators.grids import cells, tables

    return cells(tables(spark, folder))


def plan_aggregate_all(spark: SparkSession, folder: str) -> DataFrame:
    """Each aggregate of each column of each table, totals aside, in base units."""
    rows = _cells(spark, folder).filter(~F.coalesce("is_total", F.lit(False)))
    base = F.col("v") * F.coalesce("scale", F.lit(1.0))
    out = rows.groupBy("table_id", "col_idx").agg(
        F.coalesce(F.sum(base.cast("decimal(30,4)")).cast("double"), F.lit(0.0)).alias("sum"), F.min(base).alias("min"), F.max(base).alias("max"),
        F.count(F.lit(1)).alias("count"), F.count("v").alias("values"),
    )
    return out.withColumn("average", F.when(F.col("values") > 0, F.round(F.col("sum") / F.col("values"), 4))).drop("values")


def plan_change_all(spark: SparkSession, folder: str) -> DataFrame:
    """Difference, ratio, change and yearly growth of each row's first and last dated column."""
    rows = _cells(spark, folder).filter("v is not null and period is not null").withColumn("year", F.right("period", F.lit(4)).cast("int"))
    ends = rows.groupBy("table_id", "row_idx").agg(
        F.min(F.struct("year", "col_idx", "v")).alias("a"), F.max(F.struct("year", "col_idx", "v")).alias("b"), F.first("label").alias("label")
    ).filter("a.year < b.year")
    a, b, years = F.col("a.v"), F.col("b.v"), F.col("b.year") - F.col("a.year")
    return ends.select(
        "table_id", "row_idx", F.round(b - a, 4).alias("difference"), F.when(a != 0, F.round(b / a, 6)).alias("ratio"),
        F.when(a != 0, F.round((b - a) / F.abs(a) * 100, 4)).alias("percent_change"),
        F.when((a > 0) & (b > 0), F.round((F.pow(b / a, 1.0 / years) - 1) * 100, 4)).alias("cagr"),
    )


def plan_label_match(spark: SparkSession, folder: str) -> DataFrame:
    """Row of each table that best fits "borrowings", and whether the choice is open."""
    rows = _cells(spark, folder).select("table_id", "row_idx", "label").distinct()
    scored = rows.withColumn("score", F.round(label_score(F.lit("total borrowings of term loan"), F.col("label")), 6)).filter(F.col("score") >= 0.2)
    order = Window.partitionBy("table_id").orderBy(F.desc("score"), "row_idx")
    ranked = scored.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).filter("r = 1")
    return ranked.select("table_id", "row_idx", "score", F.coalesce((F.col("next") == F.col("score")) & (F.col("score") < 1), F.lit(False)).alias("tied"))


def _asked(label: str, col: str) -> dict:
    return {"op": "lookup", "table": "T", "row": label, "col": col}


def plan_question(spark: SparkSession, folder: str) -> DataFrame:
    """A compiled plan over every table: change of its Revenue from FY2021 to FY2022, or why there is none."""
    plan = {"steps": [{"id": "a", **_asked("Revenue", "FY2021")}, {"id": "b", **_asked("Revenue", "FY2022")}, {"id": "c", "op": "percent_change", "old": "a", "new": "b"}]}
    out = compile_plan(plan, {"T": _cells(spark, folder)}, "table_id")
    shown = display(F.col("value"), F.col("kind"), F.col("currency"), F.col("unit"))
    return out.select("table_id", F.round("value", 4).alias("value"), "kind", "error", F.when(F.col("value").isNotNull(), shown).alias("shown"))


def plan_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """A compiled plan over every table: aggregates of its FY2021 column and what they make of one another."""
    rows = _cells(spark, folder)
    steps = [{"id": fn, "op": "aggregate", "table": "T", "col": "FY2021", "fn": fn} for fn in AGGREGATES]
    steps += [{"id": "spread", "op": "difference", "a": "max", "b": "min"}, {"id": "ratio", "op": "ratio", "a": "spread", "b": "average"}, {"id": "both", "op": "sum", "args": ["max", "min"]}]
    parts = [compile_plan({"steps": steps, "output": s["id"]}, {"T": rows}, "table_id").select("table_id", F.round("value", 4).alias(f"{s['id']}_value"), F.col("error").alias(f"{s['id']}_error")) for s in steps]
    return reduce(lambda a, b: a.join(b, "table_id"), parts)


QUERIES = {f.__name__: f for f in (plan_aggregate_all, plan_change_all, plan_label_match, plan_question, plan_aggregates)}

from paperloom.operators.grids import _CELLS  # noqa: E402

_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in LABEL_STOPS) + ")))"
_FIT = "CASE WHEN len(y) = 0 THEN 0 WHEN b = x THEN 1 WHEN list_contains(y, x[1]) AND len(y) = 1 THEN 0.97 WHEN list_contains(y, x[1]) THEN 0.9 ELSE 0 END"
_KIND = "CASE WHEN coalesce(contains(raw, '%'), false) THEN 'pct' WHEN currency IS NOT NULL OR scale > 1 THEN 'amount' ELSE 'number' END"


def _picked(name: str, year: str) -> str:
    """Cells of each table's best column for a year, for a wanted label of one word."""
    return f""", {name}_s AS (SELECT DISTINCT table_id, col_idx, greatest({_FIT}, CASE WHEN coalesce(nullif(regexp_extract(col_path, '(?i)\\bFY\\s*(\\d{{4}})\\b', 1), ''),
            regexp_extract(col_path, '\\b(20[0-4]\\d)\\b', 1)) = '{year}' THEN 0.98 ELSE 0 END) AS s
            FROM (SELECT table_id, col_idx, col_path, ['fy{year}'] AS x, regexp_extract_all(lower(col_path), '[a-z0-9]+') AS b, {_WORDS.format("col_path")} AS y FROM cells)),
        {name} AS (SELECT cells.* FROM cells JOIN (SELECT table_id, arg_min(col_idx, (-s, col_idx)) AS col_idx FROM {name}_s WHERE s >= 0.6 GROUP BY 1) USING (table_id, col_idx))"""


def _looked(name: str, year: str) -> str:
    """Result of looking up Revenue in those cells."""
    return _picked(name, year) + f""", {name}_r AS (SELECT *, {_FIT} AS s FROM (SELECT *, ['revenue'] AS x, regexp_extract_all(lower(label), '[a-z0-9]+') AS b, {_WORDS.format("label")} AS y FROM {name})),
        {name}_o AS (SELECT *, count(*) OVER (PARTITION BY table_id, s) AS n FROM {name}_r WHERE s >= 0.7 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY s DESC, row_idx) = 1),
        {name}_v AS (SELECT table_id, CASE WHEN row_idx IS NULL THEN 'no cell for ''Revenue'' and ''FY{year}''' WHEN n > 1 AND s < 1 THEN '''Revenue'' matches several rows' WHEN v IS NULL THEN 'the cell holds no number' END AS error,
            CASE WHEN row_idx IS NOT NULL THEN {_KIND} END AS kind, CASE WHEN NOT (n > 1 AND s < 1) THEN v * CASE WHEN {_KIND} = 'amount' THEN coalesce(scale, 1) ELSE 1 END END AS x FROM (SELECT DISTINCT table_id FROM cells) LEFT JOIN {name}_o USING (table_id))"""


ORACLE = {
    "plan_question": _CELLS + _looked("a", "2021") + _looked("b", "2022") + """, e AS (SELECT table_id, a.x AS old, b.x AS new, coalesce(a.error, b.error,
            CASE WHEN a.kind <> b.kind AND a.kind <> 'number' AND b.kind <> 'number' THEN 'different kinds of value' END, CASE WHEN a.x = 0 THEN 'the old value is zero' END) AS error FROM a_v a JOIN b_v b USING (table_id)),
        r AS (SELECT table_id, CASE WHEN error IS NULL THEN (new - old) / abs(old) * 100 END AS value, error FROM e)
        SELECT table_id, round(value, 4) AS value, 'pct' AS kind, error, format('{:,.2f}', value) || '%' AS shown FROM r""",
    "plan_aggregates": _CELLS + _picked("p", "2021") + f""", every AS (SELECT *, v * coalesce(scale, 1) AS x, {_KIND} AS kind FROM p WHERE NOT coalesce(is_total, false)),
        grouped AS (SELECT table_id, count(*) AS "count", coalesce(arg_min(coalesce(scale, 1), (row_idx, col_idx)) FILTER (v IS NOT NULL), 1) AS scale, coalesce(sum(x), 0) AS "sum", avg(x) AS average, min(x) AS "min", max(x) AS "max",
              count(DISTINCT kind) FILTER (kind <> 'number' AND v IS NOT NULL) AS kinds, coalesce(bool_or(kind = 'amount') FILTER (v IS NOT NULL AND kind <> 'number'), false) AS amount FROM every GROUP BY 1),
        judged AS (SELECT table_id, coalesce("count", 0)::DOUBLE AS "count", coalesce(scale, 1) AS scale, coalesce("sum", 0) AS "sum", average, "min", "max", coalesce(amount, false) AS amount,
              CASE WHEN kinds > 1 THEN 'different kinds of value' END AS mixed, CASE WHEN kinds > 1 THEN 'different kinds of value' WHEN average IS NULL THEN 'no values to combine' END AS none
              FROM (SELECT DISTINCT table_id FROM cells) LEFT JOIN grouped USING (table_id)),
        scaled AS (SELECT *, CASE WHEN amount THEN scale ELSE 1 END AS unit, "max" / scale AS hi, "min" / scale AS lo, average / scale AS mid FROM judged)
        SELECT table_id, CASE WHEN mixed IS NULL THEN round("sum" / scale, 4) END AS sum_value, mixed AS sum_error, CASE WHEN none IS NULL THEN round(mid, 4) END AS average_value, none AS average_error,
               CASE WHEN none IS NULL THEN round(lo, 4) END AS min_value, none AS min_error, CASE WHEN none IS NULL THEN round(hi, 4) END AS max_value, none AS max_error, "count" AS count_value, NULL::VARCHAR AS count_error,
               CASE WHEN none IS NULL THEN round((hi * unit - lo * unit) / unit, 4) END AS spread_value, none AS spread_error,
               CASE WHEN none IS NULL AND mid <> 0 THEN round((hi - lo) / mid, 4) END AS ratio_value, coalesce(none, CASE WHEN mid = 0 THEN 'division by zero' END) AS ratio_error,
               CASE WHEN none IS NULL THEN round((hi * unit + lo * unit) / unit, 4) END AS both_value, none AS both_error FROM scaled""",
    "plan_aggregate_all": _CELLS + """, b AS (SELECT table_id, col_idx::INT AS col_idx, v * coalesce(scale, 1) AS x FROM cells WHERE NOT coalesce(is_total, false))
        SELECT table_id, col_idx, coalesce(sum(x::DECIMAL(30,4))::DOUBLE, 0) AS "sum", min(x) AS "min", max(x) AS "max", count(*) AS "count",
               CASE WHEN count(x) > 0 THEN round(coalesce(sum(x::DECIMAL(30,4))::DOUBLE, 0) / count(x), 4) END AS average FROM b GROUP BY ALL""",
    "plan_change_all": _CELLS + """, p AS (SELECT table_id, row_idx::INT AS row_idx, col_idx, v, coalesce(nullif(regexp_extract(col_path, '(?i)\\bFY\\s*(\\d{4})\\b', 1), ''), regexp_extract(col_path, '\\b(20[0-4]\\d)\\b', 1)) AS y FROM cells WHERE v IS NOT NULL),
        e AS (SELECT table_id, row_idx, arg_min(v, (y::INT, col_idx, v)) AS a, arg_max(v, (y::INT, col_idx, v)) AS b, max(y::INT) - min(y::INT) AS n FROM p WHERE y <> '' GROUP BY ALL HAVING n > 0)
        SELECT table_id, row_idx, round(b - a, 4) AS difference, CASE WHEN a <> 0 THEN round(b / a, 6) END AS ratio, CASE WHEN a <> 0 THEN round((b - a) / abs(a) * 100, 4) END AS percent_change,
               CASE WHEN a > 0 AND b > 0 THEN round((pow(b / a, 1.0::DOUBLE / n) - 1) * 100, 4) END AS cagr FROM e""",
    "plan_label_match": _CELLS + f""", r AS (SELECT DISTINCT table_id, row_idx::INT AS row_idx, label FROM cells),
        w AS (SELECT *, {_WORDS.format("'total borrowings of term loan'")} AS x, {_WORDS.format("label")} AS y FROM r),
        s AS (SELECT table_id, row_idx, round(CASE WHEN len(y) = 0 THEN 0 WHEN len(list_intersect(x, y)) = len(x) AND len(x) = len(y) THEN 0.97 WHEN len(list_intersect(x, y)) = len(x) THEN 0.9
                 WHEN len(list_intersect(x, y)) = len(y) THEN 0.75 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) * 0.85 END, 6) AS score FROM w)
        SELECT table_id, row_idx, score, coalesce(lead(score) OVER o = score AND score < 1, false) AS tied FROM s WHERE score >= 0.2
        WINDOW o AS (PARTITION BY table_id ORDER BY score DESC, row_idx) QUALIFY row_number() OVER o = 1""",
}
