"""Text expressions: everything here is a native Column unless its name ends in ``_udf``."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token pattern, stop words, suffixes of the light stemmer, zero-width and direction marks.
TOKEN = r"([a-z0-9]+(?:\.[0-9]+)?|[₹$€£%])"
STOP_WORDS = (
    "a an and are as at be but by for from has have in is it its of on or that the this to was were will with what which who whom how many "
    "much does do did there their they summarise summarize summary describe explain provide show give tell state find identify please about"
).split()
SUFFIXES = ("ing", "ity", "ed", "es", "s")
ZERO_WIDTH = "[​‌‍⁠﻿]"
BIDI = "[‪-‮⁦-⁩]"


def stem(t: Column) -> Column:
    """Strip one suffix, the longest that leaves four letters; "ies" of words over five letters becomes "y"."""
    cut = F.regexp_replace(t, f"^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$", "$1")
    return F.when(t.endswith("ies") & (F.length(t) > 5), F.concat(F.left(t, F.length(t) - 3), F.lit("y"))).otherwise(cut)


def stem_word(t: str) -> str:
    """``stem`` of one word outside Spark."""
    return t[:-3] + "y" if t.endswith("ies") and len(t) > 5 else re.sub(f"^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$", r"\1", t)


def index_words(text: Column) -> Column:
    """Array of raw index words, stop words out; null text gives null."""
    raw = F.regexp_extract_all(F.replace(F.lower(text), F.lit(",")), F.lit(TOKEN), F.lit(1))
    return F.filter(raw, lambda t: ~t.isin(*STOP_WORDS))


def tokens(text: Column) -> Column:
    """Array of stemmed index terms. For whole tables explode ``index_words`` and stem the rows: that is compiled code."""
    return F.transform(index_words(text), stem)


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after . ! ? and white space."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def token_estimate(text: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return F.floor(words * F.lit(1.3)).cast("int") + 1


def normalise(text: Column, keep_case: bool = True) -> Column:
    """Line breaks, invisible marks, ligatures, quotes, dashes, split words and spaces in one form."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, f"{ZERO_WIDTH}|{BIDI}|[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]", "")
    out = F.regexp_replace(out, "­\n?", "")
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, "‘’‚‛“”„‟–—―−   ", "''''\"\"\"\"----   ")
    out = F.regexp_replace(out, r"(\p{L})-\n(\p{Ll})", "$1$2")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n"))
    return out if keep_case else F.lower(out)


def comparable(text: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def content_words(text: Column) -> Column:
    """Words and numbers, numbers kept whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{N}[\p{N}.,]*\p{N}|[\p{L}\p{N}]+)"), F.lit(1))


def safe_cell(value: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets a quote in front."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def sanitise(text: Column) -> Column:
    """Scripts and handlers out, dangerous schemes blocked, tag openers encoded."""
    out = F.regexp_replace(text, r"(?is)<script\b[^>]*>.*?</script\s*>", "[script removed]")
    out = F.regexp_replace(out, r"(?i)\son[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    out = F.regexp_replace(out, r"(?i)\b(javascript|vbscript|data)\s*:", "blocked:")
    return F.regexp_replace(out, r"<(?=[A-Za-z/!])", "&lt;")


def sanitise_links(markdown: Column) -> Column:
    """Markdown link targets with a scheme that runs code are blocked."""
    return F.regexp_replace(markdown, r"(?i)\]\(\s*(?:javascript|vbscript|data|file)\s*:[^)]*\)", "](blocked:)")



def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def word_coverage(found: Column, expected: Column) -> Column:
    """Share of the distinct expected words that were found; nothing expected counts as 1."""
    have, want = F.array_distinct(content_words(found)), F.array_distinct(content_words(expected))
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(have, want)) / F.size(want))


@F.pandas_udf(T.StringType())
def nfkc_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.DoubleType())
def indel_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * (longest common subsequence) / (sum of lengths); two empty texts are alike."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x and not y:
            return 1.0
        row = [0] * (len(y) + 1)
        for c in x:
            left = 0
            for j, d in enumerate(y, 1):
                left, row[j] = row[j], left + 1 if c == d else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def word_error_rate_udf(found: pd.Series, expected: pd.Series) -> pd.Series:
    """Word edit distance over the number of expected words."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        a, b = x.split(), y.split()
        if not b:
            return 0.0 if not a else 1.0
        before = list(range(len(b) + 1))
        for i, w in enumerate(a, 1):
            now = [i]
            for j, v in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (w != v)))
            before = now
        return before[-1] / len(b)

    return pd.Series([one(x, y) for x, y in zip(found, expected)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("a0", "a1", "b0", "b1"))])))
def sequence_diff_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit blocks between two word sequences, in order."""

    def one(x: str | None, y: str | None) -> list[dict]:
        codes = difflib.SequenceMatcher(None, (x or "").split(), (y or "").split(), autojunk=False).get_opcodes()
        return [dict(zip(("tag", "a0", "a1", "b0", "b1"), code)) for code in codes if code[0] != "equal"]

    return pd.Series([one(x, y) for x, y in zip(a, b)])
