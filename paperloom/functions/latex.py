"""LaTeX: balance checks, inline equations and agreement of two readings, as pandas functions of plain Python rules."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMAND = re.compile(r"\\([A-Za-z]+)")
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([^{}]*)\}")
_EQUATION = re.compile(r"(?<![\w.])((?:\\?[A-Za-z]\w*(?:_\{?\w+\}?)?(?:\^\{?\w+\}?)?|\d+(?:\.\d+)?)(?:\s*[=<>≤≥+\-*/^]\s*(?:\\?[A-Za-z]\w*(?:_\{?\w+\}?)?(?:\^\{?\w+\}?)?|\d+(?:\.\d+)?|\([^()]{1,40}\)))+)")


def problems(text: str | None) -> list[str]:
    """Names of what is wrong: braces, environments, left/right, dollars, arguments of fractions."""
    if text is None:
        return []
    found = []
    plain = re.sub(r"\\[{}$\\]", "", text)
    depth = low = 0
    for c in plain:
        depth += (c == "{") - (c == "}")
        low = min(low, depth)
    if depth or low < 0:
        found.append("braces")
    stack = []
    for kind, name in _ENVIRONMENT.findall(text):
        if kind == "begin":
            stack.append(name)
        elif not stack or stack.pop() != name:
            stack.append("?")
            break
    if stack:
        found.append("environments")
    names = Counter(_COMMAND.findall(text))
    if names["left"] != names["right"]:
        found.append("left_right")
    if plain.count("$") % 2:
        found.append("dollars")
    if len(re.findall(r"\\frac\s*(?:\{|\d|\\?[A-Za-z])", text)) != names["frac"]:
        found.append("fraction")
    return found


def inline_equations(text: str | None) -> list[str]:
    """Spans with a relation between names and numbers, in order."""
    return [m.group(1).strip() for m in _EQUATION.finditer(text or "") if re.search(r"[=<>≤≥]", m.group(1)) and re.search(r"[A-Za-z]", m.group(1))]


def agreement(a: str | None, b: str | None) -> float | None:
    """Shared letters and digits of two readings over the larger, order ignored."""
    if a is None or b is None:
        return None
    x, y = (Counter(c for c in _COMMAND.sub(" ", t).lower() if c.isalnum()) for t in (a, b))
    most = max(sum(x.values()), sum(y.values()))
    return 1.0 if not most else sum((x & y).values()) / most


@F.pandas_udf(T.ArrayType(T.StringType()))
def problems_udf(texts: pd.Series) -> pd.Series:
    return texts.map(problems)


@F.pandas_udf(T.ArrayType(T.StringType()))
def inline_equations_udf(texts: pd.Series) -> pd.Series:
    return texts.map(inline_equations)


@F.pandas_udf(T.DoubleType())
def agreement_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([agreement(x, y) for x, y in zip(a, b)], dtype="float64")
