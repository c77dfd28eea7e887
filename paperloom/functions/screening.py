"""Two rule sets for text that addresses a model instead of a reader.

``strict`` is specific and quarantines; ``broad`` reads through leetspeak and
spacing and only flags. A rule is a chain of word groups, one word of each in this
order with at most some words between; ``pattern`` makes the regular expression. All
tests are native, and a cheap search for the rarest words of each rule goes before
them, so that ordinary text meets no pattern at all.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import BIDI, ZERO_WIDTH

_VERBS_OF_DROPPING = "ignore disregard discard forget dismiss override bypass skip"
_VERBS_OF_SHOWING = "reveal show print display output repeat leak expose"
_ORDERS = "instruction instructions prompt prompts rule rules guideline guidelines directive directives command commands"
_EARLIER = "previous prior earlier preceding above your"

#: Reason, words allowed between neighbouring groups, and the groups.
STRICT = (
    ("instruction_override", 2, (_VERBS_OF_DROPPING, _EARLIER, _ORDERS + " context")),
    ("instruction_override", 1, ("ignore forget disregard", "everything anything all", "above earlier before told")),
    ("role_hijack", 0, ("you", "are", "now", "a an the in")),
    ("role_hijack", 0, ("pretend", "to", "be")),
    ("role_hijack", 6, ("act behave respond", "as", "assistant ai model chatbot bot")),
    ("prompt_exfiltration", 2, (_VERBS_OF_SHOWING, "system hidden initial your", "prompt prompts instructions")),
    ("system_prompt_mention", 0, ("system", "prompt")),
    ("answer_steering", 3, ("say state answer respond report reply tell", "company borrower group", "has", "no")),
    ("answer_steering", 3, ("say state answer respond report reply tell", "everything", "fine good")),
    ("answer_steering", 6, ("not never don't", "mention tell reveal disclose", "user reader auditor anyone")),
)
# Marks of chat formats that no prose holds.
CHAT_MARKS = ("<|im_start|>", "<|im_end|>", "[inst]", "[/inst]", "<system>", "</system>", "<assistant>", "</assistant>", "<instructions>", "</instructions>")
#: Words allowed between the groups, and the groups; a word may go on ("instruct" stands for "instructions").
BROAD = (
    (3, (_VERBS_OF_DROPPING, "instruct prompt direct command told above prior previous")),
    (4, ("bypass disable circumvent evade", "filter restrict guideline safety policy rule")),
    (3, ("not never", "follow obey respect adhere", "rule guideline instruct policy")),
    (3, ("you are now", "ai assistant model bot system")),
    (3, ("act as", "unrestricted unfiltered evil opposite jailbroken")),
    (3, ("pretend imagine", "unrestricted without no", "restrict rule limit filter")),
    (2, (_VERBS_OF_SHOWING, "system hidden secret original", "prompt instruct directive")),
    (2, ("developer debug admin root sudo god", "mode")),
    (1, ("no without", "restrict filter guideline safety")),
    (2, ("from now on|henceforth|starting now", "you always never must")),
    (2, ("i will|you will", "reward punish tip hurt")),
    (3, ("new different another", "persona identity character")),
    (0, ("jailbreak unshackle uncensor",)),
)
# Digits and signs written for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"}


def _words(group: str) -> list[str]:
    return group.split("|") if "|" in group else [group] if group in ("you are now", "act as") else group.split()


def pattern(groups: tuple[str, ...], between: int, *, goes_on: bool = False) -> str:
    """Regular expression of a rule; both engines that run it read it alike."""
    gap = rf"(?:[^a-z0-9]+[a-z0-9']+){{0,{between}}}[^a-z0-9]+"
    parts = ["(?:" + "|".join(_words(group)) + ")" + ("[a-z0-9]*" if goes_on else "") for group in groups]
    return r"\b" + gap.join(parts) + ("" if goes_on else r"\b")


STRICT_PATTERNS = tuple((reason, pattern(groups, between)) for reason, between, groups in STRICT)
BROAD_PATTERNS = tuple(pattern(groups, between, goes_on=True) for between, groups in BROAD)


def _needed(rules: tuple) -> list[str]:
    """For every rule one group, that of the longest words: a text without any of them matches none."""
    chosen = {w for *_, groups in rules for w in max((_words(g) for g in groups), key=lambda ws: min(map(len, ws)))}
    return sorted(w for w in chosen if not any(o != w and o in w for o in chosen))


#: One search for what every strict rule needs: a word of its rarest group (chosen by hand, by its place in the rule), or a chat mark.
_RAREST = (0, 0, 2, 0, 2, 2, 1, 0, 1, 1)
TRACE = (
    r"\b(?:" + "|".join(dict.fromkeys(w for (*_, groups), k in zip(STRICT, _RAREST, strict=True) for w in _words(groups[k]))) + r")\b|"
    + "|".join(re.escape(mark) for mark in CHAT_MARKS)
)


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def _not_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def zero_width_count(text: Column) -> Column:
    return F.when(_not_ascii(text), F.regexp_count(text, F.lit(ZERO_WIDTH))).when(text.isNotNull(), 0)


def suspicious(text: Column) -> Column:
    """Whether a text can have a strict finding at all: no text with one fails this."""
    odd = _not_ascii(text) & (text.rlike(BIDI) | text.rlike(ZERO_WIDTH))
    return F.coalesce(F.lower(text).rlike(TRACE) | odd, F.lit(False))


def strict_findings(text: Column) -> Column:
    """Distinct reasons, in alphabetical order; empty for clean or null text."""
    clean = F.lower(F.regexp_replace(text, ZERO_WIDTH, ""))
    reasons = [F.when(clean.rlike(rule), F.lit(reason)) for reason, rule in STRICT_PATTERNS]
    reasons.append(F.when(_any_of(clean, list(CHAT_MARKS)), F.lit("chat_template_tokens")))
    reasons.append(F.when(text.rlike(BIDI), F.lit("bidi_override")))
    reasons.append(F.when(zero_width_count(text) >= 3, F.lit("zero_width_characters")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))


def fold(text: Column) -> Column:
    """Lower case, leetspeak read as letters, other signs as blanks, runs of single letters closed up to words."""
    out = F.translate(F.lower(text), "".join(LEET), "".join(LEET.values()))
    out = F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
    return F.regexp_replace(out, r"\b([a-z0-9]) (?=[a-z0-9]\b)", "$1")


def broad_rules(folded: Column) -> Column:
    """Numbers (from 0) of the broad rules that match folded text."""
    hits = F.array_compact(F.array(*(F.when(folded.rlike(rule), F.lit(k)) for k, rule in enumerate(BROAD_PATTERNS))))
    return F.when(folded.rlike("|".join(_needed(BROAD))), hits).otherwise(F.array().cast("array<int>"))


def homoglyphs(text: Column) -> Column:
    """A word of three letters or more mixes Latin with Cyrillic or Greek."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]{3,})"), F.lit(1))
    return F.exists(words, lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"))
