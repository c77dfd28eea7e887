"""Problem 7: quantities recorded in different units.

Method. A column's unit is the one its heading states, else its title, else a note
among the row labels, else its cells, else the row's own fields. Values enter the
history of their source (workspace and subject) as logarithms of their level, those
of stated columns in base units. An exact penalised changepoint search (optimal
partitioning, squared error, functional pruning) cuts the history into levels. The
stated columns anchor it: where they agree on a level, a segment that stands below
it by a known factor gives unit and factor to the columns that state none, in
``p7_found`` and ``p7_values``. Stated columns keep what they state; where their
history says otherwise, ``shift`` of ``p7_values`` tells by which known factor.

Scale. Rows are range-partitioned in the order of their histories, so a history with
a third of all rows is many partitions. A step of more than sqrt(6 * PENALTY) lies
between two segments of every best partition (to split there and around its two ends
costs three levels and saves more), so histories are cut at such steps from row to
row, and the pieces are searched apart, still exactly. Edges of partitions are glued
by a table of one row a partition. A piece without such a step is one task, however
long; the search takes near-linear time and a few numbers a row.

Defined cases: grids that cannot be read, and tables without columns, give no
rows; a column without unit, fields and a matching shift stays unknown and is no
case; null, blank and dashed cells hold no value; copies of a row count once.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import read_table, shared_checkpoint

#: Rows of a range partition and of a bucket of pieces, on average.
BUCKET_ROWS = 20_000
#: Cost of one more level, in squared decades, and how near a shift must be to a known factor.
PENALTY = 1.0
NEAR = 0.15
#: Widest middle half of stated columns, in decades, that counts as agreement on a level, and how near a factor must then be.
AGREED, NEAR_LEVEL = 0.8, 0.4

# Spellings of scales, currencies and physical units.
SCALES = {
    "crore": (10_000_000, "crore crores cr cr."),
    "lakh": (100_000, "lakh lakhs lac lacs"),
    "thousand": (1_000, "thousand thousands k 000 000s '000 '000s ’000 tsd tsd. mille"),
    "million": (1_000_000, "million millions mn mm mio mio. m mln millionen"),
    "billion": (1_000_000_000, "billion billions bn mrd mrd."),
}
CURRENCIES = {
    "INR": "inr rs rs. ₹ rupee rupees|indian rupee|indian rupees",
    "USD": "usd us$ $ dollar dollars|us dollar|us dollars|u.s. dollars",
    "EUR": "eur € euro euros",
    "GBP": "gbp £ pounds|pounds sterling|pound sterling|sterling",
    "JPY": "jpy ¥ yen|japanese yen",
}
PHYSICAL = {
    "tonne": ("kg", 1_000, "tonne tonnes t mt ton tons|metric tons|metric tonnes|metric ton"),
    "MWh": ("kWh", 1_000, "mwh|megawatt hours|megawatt hour|megawatt-hours"),
    "GWh": ("kWh", 1_000_000, "gwh|gigawatt hours|gigawatt hour|gigawatt-hours"),
    "years": ("months", 12, "years year yrs yr yrs."),
    "percent": ("bps", 100, "percent % pct pct.|per cent"),
}


def _spellings(text: str) -> list[str]:
    return [s for part, group in enumerate(text.split("|")) for s in ([group] if part else group.split())]


_SCALE_OF = {s: name for name, (_, text) in SCALES.items() for s in text.split()}
_CURRENCY_OF = {s: name for name, text in CURRENCIES.items() for s in _spellings(text)}
_PHYSICAL_OF = {s: name for name, (_, _, text) in PHYSICAL.items() for s in _spellings(text)}
_ALL = sorted([*_SCALE_OF, *_CURRENCY_OF, *_PHYSICAL_OF], key=len, reverse=True)
_TOKEN = re.compile("|".join(re.escape(s) + (r"(?![^\W\d_])" if s[-1].isalnum() else "") for s in _ALL), re.I)
_FILLER = re.compile(r"(?:all\s+)?(?:amounts?|figures?|values?|numbers?|stated|expressed|reported|in|of|the|are|is)\b", re.I)
_NUMBER = re.compile(r"[(\-−+]?\s*\d[\d.,'  ]*\)?")

Unit = tuple[str, int, str | None]


def phrase(text: str) -> tuple[str | None, str | None, str | None]:
    """Scale, currency and physical unit of a phrase made of unit words alone, else three times None."""
    scale = currency = physical = None
    rest = text.strip().strip(",;:.").strip() if text else ""
    if text and text.strip().endswith("."):
        rest = text.strip()
    while rest:
        token = _TOKEN.match(rest)
        filler = _FILLER.match(rest)
        if token:
            word = token.group().lower()
            if word in _SCALE_OF and scale is None:
                scale = _SCALE_OF[word]
            elif word in _CURRENCY_OF and currency is None:
                currency = _CURRENCY_OF[word]
            elif word in _PHYSICAL_OF and physical is None:
                physical = _PHYSICAL_OF[word]
            else:
                return None, None, None
            rest = rest[token.end() :]
        elif filler:
            rest = rest[filler.end() :]
        elif rest[0] in " \t,/;:. ":
            rest = rest[1:]
        else:
            return None, None, None
    return (None, None, physical) if physical and not (scale or currency) else (scale, currency, None) if not physical else (None, None, None)


def complete(parts: tuple[str | None, str | None, str | None], currency: str | None = None) -> Unit | None:
    """(unit, factor, currency) of a phrase; a scale alone takes the currency given."""
    scale, money, physical = parts
    if physical:
        return physical, PHYSICAL[physical][1], None
    money = money or currency
    return (scale, SCALES[scale][0], money) if scale and money else None


_LAST = (re.compile(r"[(\[]([^()\[\]]+)[)\]]\s*$"), re.compile(r"\s[-–—]\s+([^()\[\]]+?)\s*$"), re.compile(r",\s+([^()\[\],]+?)\s*$"), re.compile(r"(?:^|\s)in\s+((?:(?!\sin\s).)+?)\s*$", re.I), re.compile(r"\bin\s+(.+?)\s*$", re.I))
_INSIDE = re.compile(r"[(\[]([^()\[\]]+)[)\]]")


def stated(text: str | None, currency: str | None = None) -> Unit | None:
    """Unit that a heading or title states: set apart by brackets, a dash, a comma or "in", never a word of a name."""
    if not text:
        return None
    for pattern in _LAST:
        if (m := pattern.search(text)) and (unit := complete(phrase(m.group(1)), currency)):
            return unit
    for m in _INSIDE.finditer(text):
        if unit := complete(phrase(m.group(1)), currency):
            return unit
    return None


_NOTE = re.compile(r"^\W*(?:note:?\s*)?(?:all\s+)?(?:amounts?|figures?|values?|numbers?)\b.*?\bin\s+(.+?)[\s:;,]*$", re.I)
#: A written thousand must not be read as part of the number before it.
_THOUSANDS = re.compile(r"(?<![\d.,])['’]?000s?(?![\d.,])", re.I)


def noted(labels: list[str], currency: str | None = None) -> Unit | None:
    for label in labels:
        text = (label or "").strip()
        if (m := _NOTE.match(text)) and (unit := complete(phrase(m.group(1)), currency) or complete(phrase(m.group(1) + "."), currency)):
            return unit
        if re.match(r"^[(\[].*[)\]]$", text) and (unit := complete(phrase(text[1:-1]), currency)):
            return unit
    return None


def written(cells: list[str | None], currency: str | None = None) -> Unit | None:
    """Unit that the cells carry beside their numbers: the commonest, the first of equals."""
    votes: dict[Unit, int] = {}
    for raw in cells:
        if raw and _NUMBER.search(raw):
            rest = _NUMBER.sub(" ", _THOUSANDS.sub(" thousand ", raw), count=1).strip()
            if rest and (unit := complete(phrase(rest), currency)):
                votes[unit] = votes.get(unit, 0) + 1
    return max(votes, key=votes.get) if votes else None


def recorded(unit: str | None, scale: float | None, currency: str | None) -> Unit | None:
    """Unit of the row's own fields, however spelled."""
    word, money = (unit or "").strip().lower(), (currency or "").strip().lower()
    code = _CURRENCY_OF.get(money) or phrase(currency or "")[1]
    own = phrase(unit or "")
    if word in _PHYSICAL_OF or own[2]:
        return complete((None, None, _PHYSICAL_OF.get(word) or own[2]))
    if own[0] or word in _SCALE_OF:
        return complete((own[0] or _SCALE_OF[word], own[1] or code, None))
    if scale is not None and not math.isnan(scale) and code and not word:
        name = next((n for n, (f, _) in SCALES.items() if f == scale), None)
        return complete((name, code, None)) if name else None
    return None


def number(raw: str | None, value: float | None) -> float | None:
    if value is not None:
        return float(value)
    m = _NUMBER.search(_THOUSANDS.sub(" ", raw or ""))
    if not m:
        return None
    text = re.sub(r"[^\d.,]", "", m.group())
    if re.search(r",\d{1,2}$", text) and "." not in text[-3:]:
        text = text.replace(".", "").replace(",", ".")
    text = text.replace(",", "").rstrip(".")
    try:
        amount = float(text)
    except ValueError:
        return None
    return -amount if m.group().lstrip().startswith(("(", "-", "−")) else amount


COLUMNS = (
    "table_id string, workspace_id string, subject string, col_idx int, year int, unit string, factor bigint, currency string, place string, "
    "right_fields boolean, level double, cells array<struct<ridx:int,label:string,value:double>>"
)


def columns_of(tables: DataFrame) -> DataFrame:
    """One row a value column: its unit and base unit, where that is stated, whether the row's fields say the same, and its values."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for table, room, title, unit, scale, currency, grid in frame.itertuples(index=False):
                try:
                    grid = json.loads(grid)
                    paths, lines = grid["col_paths"], [r for r in grid["rows"] if isinstance(r, dict)]
                except (TypeError, ValueError, KeyError):
                    continue
                scale = None if scale is None or math.isnan(scale) else float(scale)
                unit, currency, title = (x if isinstance(x, str) else None for x in (unit, currency, title))
                code = _CURRENCY_OF.get((currency or "").strip().lower())
                whole = [("title", stated(title, code)), ("note", noted([r.get("label") for r in lines], code))]
                subject = re.sub(r"\W+", " ", re.split(r"\s[-–—(\[]|\bas at\b|\bFY|\bin\b", title or "")[0]).strip().lower()
                for c in range(1, len(paths)):
                    head = paths[c] if isinstance(paths[c], str) else " ".join(map(str, paths[c] or []))
                    cells = [(r.get("ridx"), r.get("label"), (r.get("cells") or [])[c]) for r in lines if len(r.get("cells") or []) > c]
                    cells = [(i, label, cell) for i, label, cell in cells if isinstance(cell, dict)]
                    found = [("heading", stated(head, code)), *whole, ("cells", written([k.get("raw") for _, _, k in cells], code)), ("fields", recorded(unit, scale, currency))]
                    place, best = next(((p, u) for p, u in found if u), (None, (None, None, None)))
                    values = [(i, label, number(k.get("raw"), k.get("v"))) for i, label, k in cells]
                    sizes = [abs(v) for _, _, v in values if v]
                    year = re.search(r"(?:FY|\b)((?:19|20)\d\d)", head)
                    rows.append((
                        table, room, subject, c, int(year.group(1)) if year else 0, best[0], best[1], best[2], place,
                        (unit, scale, currency) == (best[0], float(best[1]) if best[1] else None, best[2]),
                        float(np.median(np.log10(sizes))) if sizes else None,
                        [{"ridx": i, "label": label, "value": v} for i, label, v in values],
                    ))
            names = [n.split()[0] for n in re.sub(r"<.*?>>", "", COLUMNS).split(", ")]
            out = pd.DataFrame(rows, columns=names)
            out["factor"] = out["factor"].astype("Int64")
            yield out

    chosen = tables.select("table_id", "workspace_id", "title", "unit", "scale", "currency", "grid_json").distinct()
    base = F.create_map(*(F.lit(x) for name, (unit, _, _) in PHYSICAL.items() for x in (name, unit)))
    return chosen.mapInPandas(run, COLUMNS).withColumn("base_unit", F.coalesce(F.col("currency"), base[F.col("unit")]))


def _common(spans: list[tuple[float, float]], low: float, high: float) -> list[tuple[float, float]]:
    return [(max(a, low), min(b, high)) for a, b in spans if max(a, low) <= min(b, high)]


def _without(spans: list[tuple[float, float]], low: float, high: float) -> list[tuple[float, float]]:
    return [part for a, b in spans for part in ((a, min(b, low)), (max(a, high), b)) if part[0] < part[1]]


def best_partition(values: np.ndarray, penalty: float = PENALTY) -> list[int]:
    """Starts of the levels of least squared error plus ``penalty`` a level: exact, by functional pruning.

    An open segment is a parabola of its cost over its level, kept with the levels at
    which no other open segment is cheaper; it is dropped when none is left.
    """
    y = [float(v) for v in values]
    if not y:
        return []
    every = [(min(y) - 1.0, max(y) + 1.0)]
    cost, last = [-penalty], [0]
    segments: list[list] = []  # start, rows, sum, sum of squares + cost so far, levels
    for t, v in enumerate(y):
        begin = cost[t] + penalty
        fresh = every
        alive = []
        for segment in segments:
            start, n, total, square, spans = segment
            room = (begin - square + total * total / n) / n
            if room <= 0:
                continue
            low, high = total / n - math.sqrt(room), total / n + math.sqrt(room)
            fresh = _without(fresh, low, high)
            if spans := _common(spans, low, high):
                segment[4] = spans
                alive.append(segment)
        if fresh or not alive:
            alive.append([t, 0, 0.0, begin, fresh or every])
        best, at = math.inf, t
        for segment in alive:
            segment[1] += 1
            segment[2] += v
            segment[3] += v * v
            least = segment[3] - segment[2] * segment[2] / segment[1]
            if least < best:
                best, at = least, segment[0]
        segments = alive
        cost.append(best)
        last.append(at)
    starts, t = [], len(y)
    while t > 0:
        starts.append(last[t])
        t = last[t]
    return starts[::-1]


KNOWN_SHIFTS = tuple(sorted({round(math.log10(a / b), 9) for a in (1, 12, 100, 1e3, 1e5, 1e6, 1e7, 1e9) for b in (1, 12, 100, 1e3, 1e5, 1e6, 1e7, 1e9) if a > b}))


def known_shift(step: float) -> float | None:
    near = min(KNOWN_SHIFTS, key=lambda s: abs(s - abs(step)))
    return math.copysign(near, step) if abs(near - abs(step)) <= NEAR else None


_ORDER = ["history", "year", "table_id", "col_idx"]
_PIECES = "history string, year int, table_id string, col_idx int, y double, anchor string, partition int, piece bigint"


def _pieces(ordered: DataFrame) -> DataFrame:
    """Rows with the number of their piece in their partition; pieces end at steps that are certain changepoints."""
    jump = math.sqrt(6 * PENALTY)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        here, piece, history, y = TaskContext.get().partitionId(), 0, None, None
        for frame in frames:
            if frame.empty:
                continue
            before = np.concatenate([[frame["y"].iloc[0] if y is None else y], frame["y"].to_numpy()[:-1]])
            names = np.concatenate([[frame["history"].iloc[0] if history is None else history], frame["history"].to_numpy()[:-1]])
            starts = (names != frame["history"].to_numpy()) | (np.abs(frame["y"].to_numpy() - before) > jump)
            numbers = piece + np.cumsum(starts)
            piece, history, y = int(numbers[-1]), frame["history"].iloc[-1], frame["y"].iloc[-1]
            yield frame.assign(partition=here, piece=numbers)

    return ordered.mapInPandas(cut, _PIECES)


def _glued(pieces: DataFrame) -> dict[int, tuple[int, int]]:
    """First pieces of partitions that go on from a piece before: one row a partition at the driver, whatever the rows."""
    place = F.struct("piece", "year", "table_id", "col_idx")
    ends = pieces.groupBy("partition").agg(
        F.min_by(F.struct("history", "y"), F.struct("history", place)).alias("first"), F.max_by(F.struct("history", "y", "piece"), F.struct("history", place)).alias("last")
    )
    found: dict[int, tuple[int, int]] = {}
    before = None
    for row in sorted(ends.collect(), key=lambda r: r["partition"]):
        if before and before["last"]["history"] == row["first"]["history"] and abs(before["last"]["y"] - row["first"]["y"]) <= math.sqrt(6 * PENALTY):
            at = (before["partition"], before["last"]["piece"])
            found[row["partition"]] = found.get(at[0], at) if at[1] == 0 else at
        before = row
    return found


def segments(columns: DataFrame) -> DataFrame:
    """``history, table_id, col_idx, y, anchor, mean``: every column with a level, and the mean of its segment."""
    spark = columns.sparkSession
    stated_level = F.col("level") + F.coalesce(F.log10(F.col("factor").cast("double")), F.lit(0.0))
    series = columns.filter("level is not null").select(
        F.to_json(F.struct("workspace_id", "subject")).alias("history"), "year", "table_id", "col_idx", stated_level.alias("y"), F.col("base_unit").alias("anchor")
    )
    parts = max(1, math.ceil(columns.count() / BUCKET_ROWS))
    # The checkpoint fixes which rows a partition holds.
    pieces = shared_checkpoint(_pieces(series.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)))
    glue = spark.createDataFrame([(p, *at) for p, at in _glued(pieces).items()] or [(-1, -1, -1)], "partition int, to_partition int, to_piece bigint")
    # One row a partition at most: small by construction.
    glue = F.broadcast(glue.withColumn("piece", F.lit(0).cast("bigint")))
    whole = pieces.join(glue, ["partition", "piece"], "left").select(
        "history", "year", "table_id", "col_idx", "y", "anchor", F.coalesce("to_partition", "partition").alias("p"), F.coalesce("to_piece", "piece").alias("k")
    )

    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["p", "k", "year", "table_id", "col_idx"], kind="stable", ignore_index=True)
        y = part["y"].to_numpy()
        edges = np.flatnonzero((part["p"].diff() != 0) | (part["k"].diff() != 0)).tolist() + [len(part)]
        starts = [a + s for a, b in zip(edges, edges[1:]) for s in best_partition(y[a:b])] + [len(part)]
        sizes = np.diff(starts)
        part["mean"] = np.repeat(np.add.reduceat(y, starts[:-1]) / sizes, sizes) if len(part) else 0.0
        return part[["history", "table_id", "col_idx", "y", "anchor", "mean"]]

    bucket = F.pmod(F.xxhash64("p", "k"), F.lit(parts))
    return whole.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(
        search, "history string, table_id string, col_idx int, y double, anchor string, mean double"
    )


def histories(columns: DataFrame) -> DataFrame:
    """``table_id, col_idx, shift, below, level_unit``.

    ``shift`` is the known factor (log10) by which a stated column's segment stands off
    from the level of its history; ``below`` the decades by which any segment stands
    under it, where the stated columns of base unit ``level_unit`` agree on one.
    """
    cuts = shared_checkpoint(segments(columns))
    # Quantiles by sketch: partial sums of bounded size before the shuffle.
    quarter = F.percentile_approx("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    levels = cuts.filter("anchor is not null").groupBy("history", "anchor").agg(F.count(F.lit(1)).alias("n"), quarter.alias("q"))
    levels = levels.groupBy("history").agg(F.max_by(F.struct("anchor", "q"), F.struct("n", "anchor")).alias("l"))
    levels = levels.select("history", F.col("l.anchor").alias("level_unit"), F.col("l.q")[1].alias("at"), (F.col("l.q")[2] - F.col("l.q")[0]).alias("spread"))

    @F.pandas_udf("double")
    def matched(step: pd.Series) -> pd.Series:
        return step.map(lambda s: known_shift(s) if s == s and abs(s) > NEAR else 0.0).astype(float)

    both = cuts.join(levels, "history")
    shift = F.when(F.col("anchor") == F.col("level_unit"), matched(F.col("mean") - F.col("at")))
    return both.select(
        "table_id", "col_idx", shift.alias("shift"), F.when(F.col("spread") <= AGREED, F.col("at") - F.col("mean")).alias("below"), "level_unit"
    )


#: Name and factor of the units of a base unit, as struct array column.
def _units_of(base: Column) -> Column:
    money = [(name, factor) for name, (factor, _) in SCALES.items()]
    physical = [(name, unit, factor) for name, (unit, factor, _) in PHYSICAL.items()]
    pairs = F.when(base.isin(*CURRENCIES), F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f).cast("bigint").alias("factor")) for n, f in money)))
    for unit in {u for _, u, _ in physical}:
        pairs = pairs.when(base == unit, F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f).cast("bigint").alias("factor")) for n, u, f in physical if u == unit)))
    return pairs


def harmonised(tables: DataFrame) -> DataFrame:
    """Columns with ``base_unit`` and ``factor``, stated or else (place "history") inferred; ``shift`` where a history disagrees."""
    columns = shared_checkpoint(columns_of(tables))
    both = columns.join(histories(columns), ["table_id", "col_idx"], "left")
    near = F.filter(_units_of(F.col("level_unit")), lambda u: F.abs(F.log10(u["factor"].cast("double")) - F.col("below")) <= NEAR_LEVEL)
    one = F.when(F.col("unit").isNull() & (F.size(near) == 1), near[0])
    both = both.withColumn("one", one).withColumn("by_history", F.col("one").isNotNull())
    return both.select(
        "table_id", "col_idx", "cells", (F.col("right_fields") & ~F.col("by_history")).alias("right_fields"), F.coalesce("unit", "one.name").alias("unit"), F.coalesce("factor", "one.factor").alias("factor"),
        F.when(F.col("by_history"), F.col("level_unit")).otherwise(F.col("base_unit")).alias("base_unit"),
        F.when(F.col("by_history"), "history").otherwise(F.col("place")).alias("place"), "shift",
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = harmonised(read_table(spark, folder, "tables_store"))
    return rows.filter("unit is not null and not right_fields").select("table_id", "col_idx", "base_unit", "factor")


def p7_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value in its base unit; ``place`` tells who states the unit, ``shift`` by which known factor a stated column's history says otherwise."""
    rows = harmonised(read_table(spark, folder, "tables_store"))
    cells = rows.select("table_id", "col_idx", "base_unit", "place", "shift", "factor", F.explode("cells").alias("c"))
    value = F.round(F.col("c.value") * F.coalesce("factor", F.lit(1)), 6)
    return cells.filter("c.value is not null").select(
        "table_id", "col_idx", F.col("c.ridx").alias("ridx"), F.col("c.label").alias("label"), "base_unit", "factor", value.alias("base_value"), "place", "shift"
    )


QUERIES = {"p7_found": p7_found, "p7_values": p7_values}
ORACLE: dict[str, str] = {}
