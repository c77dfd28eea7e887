"""Numbers, units, periods, dates and labels of financial text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units with their multiplier, in order of precedence; currencies; concepts; statements.
UNITS = (
    ("crore", 1e7, r"(?i)\bcrores?\b|\bin\s+(?:rs\.?|₹|inr)?\s*cr\.?\b"),
    ("lakh", 1e5, r"(?i)\blakhs?\b|\blacs?\b"),
    ("billion", 1e9, r"(?i)\bbillions?\b|\bbn\b"),
    ("million", 1e6, r"(?i)\bmillions?\b|\bmn\b|\$\s*m\b"),
    ("thousand", 1e3, r"(?i)\bthousands?\b|'000|\b000s\b"),
)
CURRENCIES = (
    ("INR", r"(?i)₹|\brs\.?\s|\binr\b|\brupees?\b"),
    ("USD", r"(?i)\$|\busd\b|\bus dollars?\b"),
    ("EUR", r"(?i)€|\beur\b|\beuros?\b"),
    ("GBP", r"(?i)£|\bgbp\b"),
    ("JPY", r"(?i)¥|\bjpy\b|\byen\b"),
)
CONCEPTS = (
    ("net_debt", r"(?i)^\s*net\s+debt\b"),
    ("ebitda", r"(?i)\bebitda\b"),
    ("revenue", r"(?i)^\s*(?:total\s+)?(?:net\s+)?(?:revenues?(?:\s+from\s+operations)?|sales|turnover)\b"),
    ("pat", r"(?i)^\s*(?:profit\s+after\s+tax|net\s+(?:profit|income)|pat)\b"),
    ("gross_profit", r"(?i)^\s*gross\s+profit\b"),
    ("cash", r"(?i)^\s*cash(?:\s+and\s+(?:cash\s+)?equivalents)?\b"),
    ("total_debt", r"(?i)^\s*(?:total\s+)?(?:debt|borrowings?|indebtedness)\b"),
)
STATEMENTS = (
    ("balance_sheet", r"(?i)balance sheet|statement of financial position|total assets"),
    ("profit_loss", r"(?i)profit and loss|profit or loss|statement of (?:profit|income|operations)|income statement|revenue from operations"),
    ("cash_flow", r"(?i)cash flows?"),
    ("debt_schedule", r"(?i)debt schedule|maturity|borrowings|term loan|repayment"),
)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
EVENT = r"(?i)matur|expir|due|renew|notice|terminat|deadline|repay|payable|effective|commenc|closing|long[- ]stop|redemption"
EVENT_KINDS = (
    ("maturity", r"(?i)matur|redemption|repay"), ("expiry", r"(?i)expir"), ("renewal", r"(?i)renew"), ("notice", r"(?i)notice|deadline"), ("termination", r"(?i)terminat"),
)
AUTHORITY = {"accounts": 0, "agreement": 1, "contract": 1, "schedule": 1}


def first_match(text: Column, rules: tuple) -> Column:
    """Name of the first rule whose pattern (its last part) is found, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(text.rlike(rule[-1]), F.lit(rule[0])).otherwise(out)
    return out


def unit_label(text: Column) -> Column:
    return first_match(text, UNITS)


def unit_scale(label: Column) -> Column:
    return F.create_map(*(x for name, scale, _ in UNITS for x in (F.lit(name), F.lit(scale))))[label]


def currency(text: Column) -> Column:
    return first_match(text, CURRENCIES)


def financial_number(text: Column) -> Column:
    """Value of (1,234), 1.234,56, 12.5%, ₹ 4.6: null where the text is no number. Percent becomes a fraction."""
    t = F.trim(text)
    core = F.regexp_replace(F.regexp_replace(t, r"^\((.*)\)$", "-$1"), r"[₹$€£¥%\s]|(?i)\b(?:rs\.?|inr|usd|eur|gbp|jpy)\b", "")
    plain = core.rlike(r"^[-+]?\d+(\.\d+)?$")
    grouped = core.rlike(r"^[-+]?\d{1,3}(,\d{2,3})+(\.\d+)?$")
    european = core.rlike(r"^[-+]?\d{1,3}(\.\d{3})*,\d{1,2}$")
    value = F.when(plain, core).when(grouped, F.replace(core, F.lit(","))).when(european, F.translate(core, ",.", "."))
    number = value.try_cast("double")
    return F.round(F.when(t.rlike(r"%\s*\)?$"), number / 100).otherwise(number), 10)


def period(text: Column) -> Column:
    """FY2025 or Q2FY2025 from the first period form found, in this order: quarter, fiscal year, range, year end, year."""

    def full(y: Column) -> Column:
        return F.when(F.length(y) == 4, y).otherwise(F.concat(F.lit("20"), F.lpad(y, 2, "0")))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    quarter = r"(?i)\bQ([1-4])\s*(?:FY)?\s*'?(\d{4}|\d{2})\b"
    year = r"(?i)\bFY\s*'?(\d{4}|\d{2})(?:\s*[-/–]\s*'?(\d{4}|\d{2}))?\b"
    span = r"\b(20\d{2})\s*[-–/]\s*(20\d{2}|\d{2})\b"
    ended = (
        r"(?i)(?:year|period|quarter)s?\s+ended\s+(?:on\s+)?(?:\d{1,2}(?:st|nd|rd|th)?\s+)?"
        r"(?:january|february|march|april|may|june|july|august|september|october|november|december)\s*(?:\d{1,2},?\s*)?(20\d{2})"
    )
    bare = r"\b(20[0-4]\d)\b"
    return (
        F.when(text.rlike(quarter), F.concat(F.lit("Q"), part(quarter, 1), F.lit("FY"), full(part(quarter, 2))))
        .when(text.rlike(year), F.concat(F.lit("FY"), full(F.when(part(year, 2) != "", part(year, 2)).otherwise(part(year, 1)))))
        .when(text.rlike(span), F.concat(F.lit("FY"), full(part(span, 2))))
        .when(text.rlike(ended), F.concat(F.lit("FY"), part(ended, 1)))
        .when(text.rlike(bare), F.concat(F.lit("FY"), part(bare, 1)))
    )


def period_key(p: Column) -> Column:
    """Sort key: year times ten plus quarter, a whole year after its quarters."""
    quarter = F.regexp_extract(p, r"^Q([1-4])", 1)
    return F.regexp_extract(p, r"FY(\d{4})", 1).try_cast("int") * 10 + F.when(quarter != "", quarter.try_cast("int")).otherwise(5)


def dates(text: Column) -> Column:
    """Dates written "8 May 2019", "May 8, 2019" or 08/05/2019 (day first), in this order; impossible ones are dropped."""
    months = "|".join(MONTHS)
    one = rf"((?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{months})[a-z]*\.?,?\s+20\d{{2}}\b)"
    two = rf"((?i)\b(?:{months})[a-z]*\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+20\d{{2}}\b)"
    three = r"(\b\d{1,2}[/.-]\d{1,2}[/.-]20\d{2}\b)"

    def month(name: Column) -> Column:
        return F.lpad(F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.lower(F.left(name, F.lit(3)))).cast("string"), 2, "0")

    def iso(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, m, F.lpad(d, 2, "0")))

    def cut(s: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(s, pattern, group)

    p1, p2, p3 = r"^(\d{1,2})\D*?\s+([A-Za-z]+)\D*(20\d{2})$", r"^([A-Za-z]+)\D*(\d{1,2})\D*(20\d{2})$", r"^(\d{1,2})\D(\d{1,2})\D(20\d{2})$"
    found = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(one), F.lit(1)), lambda s: iso(cut(s, p1, 3), month(cut(s, p1, 2)), cut(s, p1, 1))),
        F.transform(F.regexp_extract_all(text, F.lit(two), F.lit(1)), lambda s: iso(cut(s, p2, 3), month(cut(s, p2, 1)), cut(s, p2, 2))),
        F.transform(F.regexp_extract_all(text, F.lit(three), F.lit(1)), lambda s: iso(cut(s, p3, 3), F.lpad(cut(s, p3, 2), 2, "0"), cut(s, p3, 1))),
    )
    return F.array_compact(found)


def printed_page(text: Column) -> Column:
    """The page label of a header or footer, null for anything longer than 14 characters."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    label = F.replace(F.regexp_extract(t, r"(?i)^(?:page\s+)?([a-z]{1,2}\s?[-–]\s?\d{1,4}|\d{1,4})(?:\s+of\s+\d+)?$", 1), F.lit(" "))
    return F.when((F.length(t) <= 14) & (label != ""), label)


def decimals(raw: Column) -> Column:
    return F.length(F.regexp_extract(raw, r"\.(\d+)", 1))


def amount_text(value: Column, scale: Column, code: Column, unit: Column) -> Column:
    """Display of a base value, such as "₹480.0 crore"."""
    symbol = F.coalesce(F.create_map(*(F.lit(x) for x in ("INR", "₹", "USD", "$", "EUR", "€", "GBP", "£", "JPY", "¥")))[code], F.lit(""))
    return F.concat(symbol, F.format_number(value / F.coalesce(scale, F.lit(1.0)), 1), F.coalesce(F.concat(F.lit(" "), unit), F.lit("")))
