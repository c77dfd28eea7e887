"""One number as written, with its unit and precision, and when two of them say the same.

A text is one quantity or none; prose is never guessed at. Group and decimal marks
are read from the form: the last of two kinds is the decimal mark, one kind that
repeats groups, a single comma before three digits groups (and is ambiguous), any
other single mark is decimal. Short scales in small letters other than "k" need a
currency, as "5 m" may be metres. Null, blank and other texts give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs and codes, scales as powers of ten.
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "INR": "₹"}
SCALES = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
SHORT = {"k": 3, "m": 6, "mm": 6, "mn": 6, "b": 9, "bn": 9, "t": 12, "tn": 12}

_CODE = "|".join(["[$€£¥₹]", *SIGNS])
_SCALE = "|".join([*SCALES, *sorted(SHORT, key=len, reverse=True)])
#: Groups: sign, currency, sign, digits with marks, scale, percent, currency, sign.
FORM = rf"^([-+])?\s?((?i:{_CODE}))?\s?([-+])?\s?(\d[\d.,' ]*\d|\d|[.,]\d+)\s?((?i:{_SCALE}))?\s?((?i:%|percent|pct))?\s?((?i:{_CODE}))?\s?(-)?$"
#: Forms of the digits: name, pattern, whether the marks group.
BODIES = (
    ("whole", r"^\d+$", False),
    ("point_first", r"^[.,]\d+$", False),
    ("comma_grouped", r"^(?:\d{1,3}(?:,\d{3})+|\d{1,2}(?:,\d{2})+,\d{3})\.\d+$", True),
    ("point_grouped", r"^\d{1,3}(?:\.\d{3})+,\d+$", True),
    ("grouped", r"^(?:\d{1,3}(?:,\d{3}){2,}|\d{1,2}(?:,\d{2})+,\d{3}|\d{1,3}(?:\.\d{3}){2,})$", True),
    ("thousands", r"^\d{1,3},\d{3}$", True),
    ("decimal", r"^\d+[.,]\d+$", False),
    ("spaced", r"^\d{1,3}(?:[ ']\d{3})+(?:[.,]\d+)?$", True),
)
AMBIGUOUS = r"^\d{1,3}[.,]\d{3}$"


def _plain(text: Column) -> Column:
    return F.trim(F.translate(text, "−–—", "---"))


def parse_number(text: Column) -> Column:
    """``struct(value decimal, unit, decimals, scale, identifier_like, ambiguous, digits)``, or null."""
    t = _plain(text)
    inside = t.rlike(r"^\(.*\)$")
    t = F.when(inside, F.trim(F.regexp_replace(t, r"^\((.*)\)$", "$1"))).otherwise(t)

    def group(n: int) -> Column:
        return F.regexp_extract(t, FORM, n)

    body, word, percent = group(4), group(5), group(6) != ""
    before, after = F.upper(group(2)), F.upper(group(7))
    code = F.when(before != "", before).otherwise(after)
    code = F.coalesce(F.create_map(*(F.lit(x) for pair in SIGNS.items() for x in pair))[code], code)
    minus = sum(((group(n) == "-").cast("int") for n in (1, 3, 8)), inside.cast("int"))
    power = F.coalesce(F.create_map(*(F.lit(x) for k, v in (SCALES | SHORT).items() for x in (k, v)))[F.lower(word)], F.lit(0))
    loose = (word != "") & F.lower(word).isin(*SHORT) & (F.lower(word) != "k") & (word == F.lower(word)) & (code == "")
    kind = F.lit(None).cast("string")
    for name, form, _ in reversed(BODIES):
        kind = F.when(body.rlike(form), name).otherwise(kind)
    bare = F.regexp_replace(body, "[ ']", "")
    whole = (
        F.when(kind == "point_first", "0").when(kind.isin("comma_grouped"), F.replace(F.substring_index(bare, ".", 1), F.lit(",")))
        .when(kind == "point_grouped", F.replace(F.substring_index(bare, ",", 1), F.lit("."))).when(kind.isin("grouped", "thousands", "whole"), F.regexp_replace(bare, "[.,]", ""))
        .otherwise(F.regexp_extract(bare, r"^(\d+)", 1))
    )
    part = F.when(kind.isin("point_first", "comma_grouped", "point_grouped", "decimal", "spaced"), F.regexp_extract(bare, r"[.,](\d+)$", 1)).otherwise("")
    grouped = kind.isin(*(name for name, _, g in BODIES if g))
    size = F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise("")).try_cast("decimal(30,8)")
    tens = F.create_map(*(x for p in (0, 3, 6, 9, 12) for x in (F.lit(p), F.lit("1" + "0" * p).cast("decimal(13,0)"))))[power]
    value = (size * tens * F.when(minus > 0, F.lit(-1)).otherwise(F.lit(1))).cast("decimal(38,8)")
    ok = t.rlike(FORM) & kind.isNotNull() & (minus <= 1) & ~((before != "") & (after != "")) & ~((code != "") & percent) & ~loose & value.isNotNull()
    return F.when(ok, F.struct(
        value.alias("value"), F.when(percent, "%").otherwise(code).alias("unit"), F.length(part).alias("decimals"), power.alias("scale"),
        (~grouped & (F.length(whole) > 1) & F.startswith(whole, F.lit("0"))).alias("identifier_like"), body.rlike(AMBIGUOUS).alias("ambiguous"), F.concat(whole, part).alias("digits"),
    ))


def written_decimals(number: Column) -> Column:
    """Decimals that are left of a number once its scale is written out."""
    return F.greatest(F.lit(0), number["decimals"] - number["scale"])


def equivalent(a: Column, b: Column, *, precision: bool = True) -> Column:
    """Whether two parsed numbers say the same: unit, value, digits of identifiers and, unless waived, written decimals."""
    same = (a["unit"] == b["unit"]) & (a["value"] == b["value"]) & (~(a["identifier_like"] | b["identifier_like"]) | (a["digits"] == b["digits"]))
    return F.coalesce(same & (written_decimals(a) == written_decimals(b)) if precision else same, F.lit(False))


def canonical(number: Column) -> Column:
    """One spelling of a number: unit, value in full, written decimals; identifiers such as 007 as their digits."""
    text = F.concat(F.when(number["unit"] == "%", "").otherwise(number["unit"]), number["value"].cast("decimal(38,8)").cast("string"))
    keep = written_decimals(number)
    cut = F.when(keep == 0, F.regexp_replace(text, r"\.\d+$", "")).otherwise(F.regexp_extract(text, r"^(.*\.)", 1))
    tail = F.when(keep == 0, "").otherwise(F.substring(F.regexp_extract(text, r"\.(\d+)$", 1), F.lit(1), keep))
    return F.when(number["identifier_like"], number["digits"]).otherwise(F.concat(cut, tail, F.when(number["unit"] == "%", "%").otherwise("")))
