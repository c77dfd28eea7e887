"""From a question to plans of the table-operation language, by rules; plans are tried in order.

Planning works on labels and headings of a few candidate tables; figures stay in
Spark. A question that asks for no calculation, or names no row, gives no plan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import tokens
from paperloom.plans.table_plan import LABEL_STOPS, compile_plan

# What in a question asks for which operation.
INTENTS = (
    ("percent_change", r"\b(growth|grow|grew|increase|decrease|change|changed)\b"), ("cagr", r"\bcagr|compound\b"), ("ratio", r"\b(ratio|times|multiple|divided by|as a share of)\b"),
    ("difference", r"\b(difference|gap|more than|less than|exceed)\b"), ("average", r"\b(average|mean)\b"), ("max", r"\b(largest|highest|maximum|biggest)\b"), ("min", r"\b(smallest|lowest|minimum)\b"),
    ("count", r"\bhow many\b"), ("sum", r"\b(total|sum|together|combined)\b"), ("lookup", r"\b(what (?:is|was|were)|how much)\b"),
)


def words(text: str) -> set[str]:
    return {w for w in re.findall(r"[a-z0-9]+", text.lower()) if w not in LABEL_STOPS}


def mentioned(labels: list[str], question: str) -> list[str]:
    """Labels whose words all stand in the question, the more specific instead of the less; else one that shares half of its words."""
    asked = words(question)
    whole = [label for label in labels if label and words(label) and words(label) <= asked]
    kept = [label for label in whole if not any(words(label) < words(other) for other in whole)]
    if kept:
        return kept
    part = [label for label in labels if label and words(label) and len(words(label) & asked) * 2 >= len(words(label))]
    return part if len(part) == 1 else []


def intents(question: str) -> list[str]:
    return [name for name, pattern in INTENTS if re.search(pattern, question, re.I)]


def make_plans(question: str, alias: str, labels: list[str], columns: list[str]) -> list[dict]:
    """Plans for one table, the most specific intent first; ``columns`` in table order."""
    rows, wants = mentioned(labels, question), intents(question)
    years = re.findall(r"\b(?:FY\s?)?(20\d\d)\b", question)
    picked = [c for y in years for c in columns if y in c] or columns[:1]
    plans = []

    def look(i: str, row: str, col: str) -> dict:
        return {"id": i, "op": "lookup", "table": alias, "row": row, "col": col}

    due = re.search(r"\b(?:matur\w*|due|expir\w*|repay\w*)\b.*?\b(20\d\d)\b", question, re.I)
    when = next((c for c in columns if re.search(r"matur|due|expir|repay", c, re.I)), None)
    amount = next((c for c in columns if re.search(r"amount|outstanding|principal|balance", c, re.I)), None)
    if due and when and amount:
        plans.append({"steps": [{"id": "s1", "op": "aggregate", "fn": "count" if "count" in wants else "sum", "table": alias, "col": amount, "where": {"col": when, "eq": due.group(1)}}]})
    for want in wants:
        if want in ("percent_change", "cagr") and rows and len(columns) >= 2:
            new, old = (picked[-1], picked[0]) if len(picked) >= 2 else (columns[0], columns[1])
            ends = sorted([old, new], key=lambda c: re.findall(r"\d{4}", c) or [""])
            steps = [look("s1", rows[0], ends[0]), look("s2", rows[0], ends[1])]
            if want == "cagr":
                span = [int(y[0]) for y in (re.findall(r"\d{4}", c) for c in ends) if y]
                steps.append({"id": "s3", "op": "cagr", "start": "s1", "end": "s2", "years": max(1, span[1] - span[0]) if len(span) == 2 else 1})
            else:
                steps.append({"id": "s3", "op": "percent_change", "old": "s1", "new": "s2"})
            plans.append({"steps": steps})
        elif want in ("ratio", "difference") and len(rows) >= 2:
            order = sorted(rows, key=lambda r: question.lower().find(r.lower()))
            plans.append({"steps": [look("s1", order[0], picked[0]), look("s2", order[1], picked[0]), {"id": "s3", "op": want, "a": "s1", "b": "s2"}]})
        elif want in ("sum", "average", "max", "min", "count") and picked:
            named = {"rows": rows} if len(rows) >= 2 else {}
            plans.append({"steps": [{"id": "s1", "op": "aggregate", "fn": want, "table": alias, "col": picked[0], **named}]})
        elif want == "lookup" and len(rows) == 1 and picked:
            plans.append({"steps": [look("s1", rows[0], picked[0])]})
    return plans


def candidate_tables(cells: DataFrame, question: str, least: int = 2) -> DataFrame:
    """Tables whose title, labels and headings share ``least`` terms or more with the question, the best first."""
    asked = F.array_distinct(tokens(F.lit(question)))
    text = cells.select("table_id", F.explode(F.array("title", "label", "col_path")).alias("t")).distinct()
    terms = text.select("table_id", F.explode(F.array_intersect(tokens(F.col("t")), asked)).alias("term")).distinct()
    return terms.groupBy("table_id").agg(F.count(F.lit(1)).alias("terms")).filter(F.col("terms") >= least).orderBy(F.desc("terms"), "table_id")


def answer(cells: DataFrame, question: str, most_tables: int = 3) -> dict | None:
    """First plan of the best tables that yields a value; the explained refusal of the first that does not; None without a plan."""
    refusal = None
    for row in candidate_tables(cells, question).limit(most_tables).collect():  # a catalogue of three tables
        part = cells.filter(F.col("table_id") == row.table_id)
        heads = part.select("label", "row_idx", "col_path", "col_idx").collect()
        labels = list(dict.fromkeys(h.label for h in sorted(heads, key=lambda h: h.row_idx)))
        columns = list(dict.fromkeys(h.col_path for h in sorted(heads, key=lambda h: h.col_idx) if h.col_path))
        for plan in make_plans(question, "T1", labels, columns):
            got = compile_plan(plan, {"T1": part}).head().asDict(recursive=True)
            if got["error"] is None:
                return {"table_id": row.table_id, "plan": plan, **got}
            refusal = refusal or {"table_id": row.table_id, "plan": plan, **got}
    return refusal
