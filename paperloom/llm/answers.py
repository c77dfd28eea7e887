"""Problem 5: broken question and answer pairs, with the kind of defect.

Method: noisy labelling functions of different kinds vote on each defect of each
answer (for, against, or abstain): patterns, word lists, the form of the end, and
witnesses learned from the collection itself: how much of an answer's information
(words weighted by rarity) its question does not hold, how often the last word ends
a sentence elsewhere, a letter-trigram profile of each language, and the recorded
``abstained``. An expectation-maximization label model per defect learns each
function's hit and false-alarm rate and the defect's share from the counts of vote
patterns, and discounts functions that err together; only those patterns (at most 3
to the number of functions) reach the driver. A pair keeps every defect whose
posterior passes its cutoff.

The language profiles are counted over all questions and answers whose language the
function words show, word counts over all answers. Up to ``BROADCAST_GRAMS`` trigrams the
profiles go to every task; beyond, the trigrams of the texts are joined with them. The
cutoffs were chosen on answers damaged on purpose (tests/llm/test_answers.py, figures there).

Defined cases: a null answer is empty; a null question never counts as copied and
has no language; ``abstained`` is one weak witness of refusals and may be null;
where the question type is unanswerable, declining is right and no case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import read_table, shared_checkpoint

FOR, AGAINST, ABSTAIN = "1", "2", "0"
#: Middles of the ranges in which no other cutoff finds more of the damaged answers with fewer errors.
CUTOFFS = {"empty": 0.3, "truncated": 0.2, "refusal": 0.5, "copies_question": 0.5, "other_language": 0.5}
ROUNDS = 60
#: Texts a language needs for a profile, and trigrams up to which a task holds all of them.
LEAST_TEXTS = 20
BROADCAST_GRAMS = 100_000

# Labels before an answer, refusals, months, units and function words of four languages.
LABEL = re.compile(r"^\W*(?:answer|a|ans|antwort|réponse|respuesta|response|reply)\s*[:：]\s*", re.I)
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
UNITS = {"en": "million billion thousand crore lakh", "de": "mio mrd millionen milliarden", "fr": "milliard milliards", "es": "millón millones"}
FUNCTION_WORDS = {
    "en": "the of and was is are were to in on at by for with from that this which what when who how why did does it not may has have been after before under over up or than",
    "de": "der die das den dem des und ist sind war waren im in am an auf bis zum zur von vom für mit nach nicht ein eine einen einem einer betrug wie wer wann wird werden hat kann laut bei noch zu ich",
    "fr": "le la les l d du de des et est sont était au aux en un une dans sur pour par avec qui que quel quelle ne pas ce cette selon à avant après il elle s je",
    "es": "el la los las de del y es son fue era al en un una por para con que quien quién cual cuál no se según antes después su este esta cuándo puede lo entre más hasta desde sobre tras frente",
}
_OWN = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
_WEIGHT: dict[str, dict[str, float]] = {}
for _lang, _words in _OWN.items():
    for _w in _words:
        _shared = sum(_w in other for other in _OWN.values())
        _WEIGHT.setdefault(_w, {})[_lang] = 1.0 / _shared
_HINTS: dict[str, set[str]] = {}
for _table in (MONTHS, UNITS):
    for _lang, _words in _table.items():
        for _w in _words.split():
            _HINTS.setdefault(_w, set()).add(_lang)

#: Word endings that one of the four languages has to itself.
ENDINGS = {"mente": {"es"}, "ción": {"es"}, "ement": {"fr"}, "ungen": {"de"}, "lich": {"de"}, "keit": {"de"}}

_MONTH = "|".join(sorted({m for v in MONTHS.values() for m in v.split()}, key=len, reverse=True))
_CURRENCY = r"usd|eur|inr|gbp|jpy|chf|us\$|a\$|rs\.?|[$£€₹¥]|[mk]€|euros?|dollars?|pounds?|rupees|yen"
_SCALE = r"million|billion|thousand|crores?|lakhs?|cr\.?|mio\.?|mrd\.?|bn|mn|millions|millionen|millón|millones|milliards?|milliarden|mil|tonnes?|mwh|gwh|kwh|bps|percent|prozent"
BARE = re.compile(
    rf"^\W*(?:(?:{_CURRENCY}|{_SCALE}|de|d['’]|[-+(]?\d[\d.,  ']*\)?|%|x)\s*)+[.\s\"”»)]*$"
    rf"|^\W*(?:\d{{1,2}}(?:\.|st|nd|rd|th|er)?\s*(?:de\s+)?)?(?:{_MONTH})\.?\s+(?:de\s+|del\s+)?(?:\d{{1,2}},\s*)?\d{{4}}\W*$"
    r"|^\W*\d{4}-\d{2}-\d{2}\W*$|^\W*\d{1,2}[./]\d{1,2}[./]\d{2,4}\W*$|^\W*(?:[QH][1-4]\s*)?FY\s?\d{2,4}(?:-\d{2})?\W*$|^\W*(?:yes|no|ja|nein|oui|non|sí)\W*$",
    re.I,
)
REFUSES_SELF = re.compile(
    r"\b(?:i(?:'m| am)?|we)\b[^.;]*\b(?:cannot|can't|can not|unable|not able|won't|will not|don't have|do not have|must decline|decline|not allowed|not permitted)\b"
    r"|\bas an? (?:ai|assistant|language model)\b[^.]*\b(?:can't|cannot|unable|not)\b"
    r"|\b(?:kann|können|darf)\b[^.;]*\bnicht\b[^.;]*\b(?:beantworten|antworten|sagen|helfen|bestimmen|ermitteln)\b"
    r"|\bne (?:peux|peut|pouvons|puis)\b[^.;]*\bpas\b[^.;]*(?:répondre|aider|dire|déterminer)|\bje suis (?:désolé|incapable)"
    r"|\bno (?:puedo|podemos|es posible)\b[^.;]*(?:responder|contestar|ayudar|determinar|decir)|\blo siento\b",
    re.I,
)
REFUSES_SOURCE = re.compile(
    r"\b(?:do(?:es)? not|don't|doesn't|did not) (?:contain|include|provide|mention|state|say|let me|allow|cover|have)\b[^;]*(?:information|answer|this|that|it)?"
    r"|\bno (?:answer|information|data|evidence)\b[^.;]*\b(?:can be|could be|is|are|on|about|available|found|given)\b"
    r"|\bnot (?:found|available|stated|disclosed|provided|mentioned) (?:in|on|by|within)\b|\b(?:not|insufficient|enough) (?:enough )?(?:evidence|information)\b"
    r"|\bnicht (?:gefunden|enthalten|angegeben|vorhanden|ersichtlich)\b|\bkeine (?:angaben?|informationen?|antwort|daten)\b"
    r"|\bintrouvable\b|\baucune? (?:information|réponse|donnée)\b|\bne (?:contien\w+|figure\w*|permet\w*|mentionn\w+)\b[^.]*\bpas\b"
    r"|\bno (?:se )?(?:encontr\w+|contien\w+|figura\w*|hay|menciona\w*|consta\w*)\b",
    re.I,
)
#: Words of declining; two of them in a short answer without any figure are suspicious.
REFUSAL_WORDS = frozenset(
    "unfortunately sorry cannot can't unable information sources documents files context answer question request material provided supplied given "
    "evidence determine help leider beantworten frage unterlagen datenraum angaben désolé malheureusement répondre question documents fournis information introuvable "
    "salle données responder pregunta documentos información sala datos encontró contienen lamentablemente".split()
)
DANGLING = frozenset(
    "the a an of to in on at by for with from and or but as well which that was were is are be been not than its their der die das den dem des und oder von für mit "
    "auf im zu ein eine le la les l de du des et ou à en un une que qui el los las y o del con para por se al una".split()
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_INVISIBLE = re.compile(r"[\s ​-‏ - ⁠﻿]+")


def _strip(text: str | None) -> str:
    text = _INVISIBLE.sub(" ", text or "").strip()
    return LABEL.sub("", text)


def _language(words: list[str]) -> tuple[str | None, float]:
    score = dict.fromkeys(_OWN, 0.0)
    for w in words:
        for part in re.split(r"['’]", w):
            for lang, weight in _WEIGHT.get(part, {}).items():
                score[lang] += weight
    best = sorted(score.items(), key=lambda x: -x[1])
    if best[0][1] < 0.9:
        return None, 0.0
    if best[0][1] == best[1][1]:
        return None, 0.0
    return best[0][0], best[0][1] - best[1][1]


def _hinted(text: str, words: list[str]) -> str | None:
    votes: dict[str, float] = {}
    for w in words:
        langs = _HINTS.get(w) or ENDINGS.get(w[-5:], ENDINGS.get(w[-4:], ())) if len(w) > 6 else _HINTS.get(w, ())
        for lang in langs:
            votes[lang] = votes.get(lang, 0) + 1 / len(langs)
    for lang, letters in {"de": "äöüß", "fr": "êèàçœîôûâë", "es": "ñ¿¡íóú"}.items():
        if any(c in text.lower() for c in letters):
            votes[lang] = votes.get(lang, 0) + 1
    if not votes:
        return None
    best = sorted(votes.items(), key=lambda x: -x[1])
    return best[0][0] if len(best) == 1 or best[0][1] > best[1][1] else None


def trigrams(text: str) -> list[str]:
    flat = " " + " ".join(w for w in re.findall(r"[^\W\d_]+", text.lower())) + " "
    return [flat[i : i + 3] for i in range(len(flat) - 2)]


def likeliest(languages: list[str], sums: np.ndarray, known: float, every: float) -> tuple[str | None, float]:
    """Likeliest language and its lead over the next in nats a trigram; None for texts of few trigrams, or many unknown ones."""
    if known < max(12, 0.7 * every) or len(languages) < 2:
        return None, 0.0
    mean = sums / known
    best, second = np.argsort(-mean)[:2]
    return languages[best], float(mean[best] - mean[second])


class Profiles:
    """Letter trigrams of each language with the logarithms of their shares, all in memory."""

    def __init__(self, languages: list[str], table: pd.DataFrame):
        self.languages = languages
        self.place = {g: i for i, g in enumerate(table["gram"])}
        self.logs = np.array(table["logs"].tolist(), float).reshape(len(table), len(languages)).T

    def guess(self, text: str) -> tuple[str | None, float]:
        grams = trigrams(text)
        at = [self.place[g] for g in grams if g in self.place]
        return likeliest(self.languages, self.logs[:, at].sum(1), len(at), len(grams))


class Told:
    """Guesses from joined sums (all trigrams, known ones, logarithms by language) of a question and an answer."""

    def __init__(self, languages: list[str], held: dict[str | None, np.ndarray | None]):
        self.languages, self.held = languages, held

    def guess(self, text: str) -> tuple[str | None, float]:
        held = self.held[text]
        return (None, 0.0) if held is None else likeliest(self.languages, held[2:], held[1], held[0])


_LABEL_WORDS = frozenset("answer a ans antwort réponse respuesta response reply".split())


def vote_empty(answer: str | None) -> str:
    """No words behind a label; no visible letters or digits; nothing but words of labels."""
    a = AGAINST if _WORD.search(_strip(answer)) else FOR
    seen = sum(c.isalnum() for c in answer or "")
    b = FOR if not seen else AGAINST if seen > 1 else ABSTAIN
    c = FOR if all(w.lower() in _LABEL_WORDS for w in _WORD.findall(answer or "")) else AGAINST
    return a + b + c


def vote_truncated(answer: str | None, ends: float | None = None, known: float | None = None) -> str:
    """No mark at the end; a mark or word that wants more; an open bracket; a last word that elsewhere goes on."""
    text = _strip(answer)
    words = _WORD.findall(text)
    if not words:
        return AGAINST * 4
    bare = bool(BARE.match(text))
    body = re.sub(r"[\"”»'’*\s]+$", "", text)
    ended = bool(re.search(r"[.!?…](?:\))?$", body)) and not re.search(r"(?:\bRs|\bMio|\bMrd|\bNr|\bArt|\bAbs|\bNo)\.$", body)
    a = AGAINST if ended or bare else FOR
    b = FOR if re.search(r"[,;:(\[\-–—/&]$|\.\.\.$|…$", body) or not ended and not bare and words[-1].lower() in DANGLING else (AGAINST if ended or bare else ABSTAIN)
    c = FOR if body.count("(") > body.count(")") else ABSTAIN
    d = ABSTAIN
    if known is not None and known == known:
        d = AGAINST if ended or ends >= 0.2 else FOR if known <= 2 or ends <= 0.05 else ABSTAIN
    return a + b + c + d


def vote_refusal(answer: str | None, abstained: object, shared: float | None = None) -> str:
    """Phrases of declining; words of declining without a figure; a short answer that shares nothing particular with its question; the recorded flag."""
    text = _strip(answer)
    words = [w.lower() for w in _WORD.findall(text)]
    if not words:
        return AGAINST * 3 + ABSTAIN
    own, source = bool(REFUSES_SELF.search(text)), bool(REFUSES_SOURCE.search(text))
    figure = bool(re.search(r"\d", text))
    a = FOR if own or source else AGAINST
    known = sum(w in REFUSAL_WORDS for w in words)
    b = AGAINST if not known or figure else FOR if known >= 2 else ABSTAIN
    c = ABSTAIN
    if shared is not None and shared == shared:
        c = AGAINST if figure or shared >= 0.25 else FOR if len(words) <= 25 and shared <= 0.1 else ABSTAIN
    d = FOR if abstained is True else AGAINST if abstained is False else ABSTAIN
    return a + b + c + d


def vote_copy(question: str | None, answer: str | None, new: float | None = None) -> str:
    """Nothing left without the question's own wording; no other words; no information that the question does not hold."""
    asked = [w.lower() for w in _WORD.findall(question or "")]
    said = [w.lower() for w in _WORD.findall(_strip(answer))]
    if not asked or not said:
        return AGAINST * 3
    rest, whole = f" {' '.join(said)} ", " ".join(asked)
    while whole in rest:
        rest = rest.replace(whole, " ", 1)
    a = FOR if not rest.strip() else AGAINST
    own, spoken = set(asked), set(said)
    b = FOR if not spoken - own and len(spoken) >= 0.7 * len(own) else AGAINST
    # Counts hold all numbers as one word: a figure of the answer's own is new whatever its weight.
    figures = set(re.findall(r"\d+", answer or "")) - set(re.findall(r"\d+", question or ""))
    c = ABSTAIN if new is None or new != new else AGAINST if figures else FOR if new <= 0.05 and len(spoken & own) >= 0.7 * len(own) else AGAINST if new >= 0.15 else ABSTAIN
    return a + b + c


def vote_language(question: str | None, answer: str | None, profiles: Profiles | Told | None = None) -> str:
    """Function words; months, units, endings and letters; the letter-trigram profile."""
    text = _strip(answer)
    asked = [w.lower() for w in _WORD.findall(question or "")]
    said = [w.lower() for w in _WORD.findall(text)]
    if not asked or not said:
        return AGAINST * 3
    mine, _ = _language(asked)
    if question and "¿" in question:
        mine = "es"
    if mine is None and profiles is not None:
        mine, lead = profiles.guess(question)
        mine = mine if lead >= 0.3 else None
    theirs, margin = _language(said)
    hint = _hinted(text, said)
    if mine is None:
        return ABSTAIN * 3
    a = ABSTAIN if theirs is None or margin <= 0 else (FOR if theirs != mine else AGAINST)
    b = ABSTAIN if hint is None or BARE.match(text) else (FOR if hint != mine and (theirs is None or theirs == hint) else AGAINST)
    c = ABSTAIN
    if profiles is not None and not BARE.match(text):
        guess, lead = profiles.guess(text)
        c = ABSTAIN if guess is None or lead < 0.15 else FOR if guess != mine else AGAINST
    if BARE.match(text):
        return AGAINST * 3 if hint in (None, mine) else ABSTAIN + ABSTAIN + AGAINST
    return a + b + c


class LabelModel:
    """Two classes, learned from pattern counts by expectation maximization.

    Functions that err together (correlated residuals given the class, as of copies
    of one function) share one voice: once the rates are learned, each speaks with
    the inverse of one plus its correlations.
    """

    def __init__(self, patterns: list[str], counts: list[int], rounds: int = ROUNDS):
        votes = np.array([[int(v) for v in p] for p in patterns]).reshape(len(patterns), -1)
        weight = np.asarray(counts, float)
        yes, no = votes == 1, votes == 2
        spoken = np.maximum(1, (yes | no).sum(1))
        post = np.clip((yes.sum(1) - no.sum(1)) / spoken * 0.45 + 0.5, 0.02, 0.98)
        post = np.where((yes | no).any(1), post, 0.05)
        # Copies of one function are one voice from the start.
        voice = 1 / (votes[:, :, None] == votes[:, None, :]).all(0).sum(1)
        for _ in range(rounds):
            w1, w0 = weight * post, weight * (1 - post)
            share = np.clip((w1.sum() + 1) / (weight.sum() + 20), 1e-4, 0.5)
            n1, n0 = (w1[:, None] * (yes | no)).sum(0) + 2, (w0[:, None] * (yes | no)).sum(0) + 2
            # A function is better than chance by assumption, and never certain.
            hit = np.clip(((w1[:, None] * yes).sum(0) + 1.6) / n1, 0.6, 0.995)
            alarm = np.clip(((w0[:, None] * yes).sum(0) + 0.2) / n0, 0.001, 0.4)
            post = self._posterior(yes, no, share, hit, alarm, voice)
        voice = self._voices(yes, no, weight, post, hit, alarm)
        post = self._posterior(yes, no, share, hit, alarm, voice)
        self.posterior = dict(zip(patterns, post))
        self.hit, self.alarm, self.voice, self.share = hit, alarm, voice, share

    @staticmethod
    def _posterior(yes: np.ndarray, no: np.ndarray, share: float, hit: np.ndarray, alarm: np.ndarray, voice: np.ndarray) -> np.ndarray:
        odds = np.log(share / (1 - share)) + yes @ (voice * np.log(hit / alarm)) + no @ (voice * np.log((1 - hit) / (1 - alarm)))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    @staticmethod
    def _voices(yes: np.ndarray, no: np.ndarray, weight: np.ndarray, post: np.ndarray, hit: np.ndarray, alarm: np.ndarray) -> np.ndarray:
        expected = post[:, None] * hit + (1 - post[:, None]) * alarm
        off = np.where(yes | no, yes - expected, 0.0)
        cover = (off * weight[:, None]).T @ off
        size = np.sqrt(np.maximum(np.diag(cover), 1e-12))
        related = np.clip(cover / size[:, None] / size[None, :], 0, 1)
        np.fill_diagonal(related, 0)
        return 1 / (1 + related.sum(1))


#: A word, number or amount with the mark that ends its sentence, if one does; all numbers count as one word.
_SPOKEN = r"([\p{L}\p{N}]+(?:['’.,][\p{L}\p{N}]+)*(?:[.!?…]+(?=\s|$))?)"
_LABEL_SQL = r"(?i)^[^\p{L}\p{N}]*(?:answer|a|ans|antwort|réponse|respuesta|response|reply)\s*[:：]\s*"
_KEY = ["qa_id", "side", "text_id"]


def _plain(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"[.!?…]+$", ""), r"\p{N}+(?:[.,]\p{N}+)*", "0")


def evidence(df: DataFrame) -> DataFrame:
    """Key, ``new`` and ``shared`` (parts of an answer's information outside and inside its question), ``ends`` and ``known`` of its last word.

    A word's information is the logarithm of all words over its own; counts cover all answers.
    """
    spoken = F.regexp_extract_all(F.regexp_replace(F.lower("answer"), _LABEL_SQL, ""), F.lit(_SPOKEN), F.lit(1))
    asked = F.transform(F.regexp_extract_all(F.lower(F.coalesce("question", F.lit(""))), F.lit(_SPOKEN), F.lit(1)), _plain)
    rows = df.select(*_KEY, spoken.alias("ws"), F.array_distinct(asked).alias("asked"))
    rows = rows.select(*_KEY, "asked", F.size("ws").alias("n"), F.posexplode("ws").alias("at", "raw")).withColumn("word", _plain(F.col("raw")))
    words = rows.select(
        *_KEY, "word", F.array_contains("asked", F.col("word")).alias("asked"), (F.col("at") == F.col("n") - 1).alias("last"), F.col("raw").rlike(r"[.!?…]$").alias("stop")
    )
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("known"), F.count_if("stop").alias("stops"))
    total = counts.agg(F.sum("known").alias("total"))
    # One row of totals; the counts are joined as Spark sees fit for their size.
    weighed = words.join(counts, "word").crossJoin(F.broadcast(total)).withColumn("info", F.log(F.col("total") / F.col("known")))
    held = F.sum(F.when(F.col("asked"), F.col("info")).otherwise(0.0))
    return weighed.groupBy(*_KEY).agg(
        F.try_divide(F.sum("info") - held, F.sum("info")).alias("new"), F.try_divide(held, F.sum("info")).alias("shared"),
        F.max(F.when(F.col("last"), F.col("stops") / F.col("known"))).alias("ends"), F.max(F.when(F.col("last"), F.col("known").cast("double"))).alias("known"),
    )


def gram_counts(df: DataFrame, most_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``gram`` and its number in the questions and answers of each language; the empty gram numbers the texts themselves.

    All texts whose language their function words show; a task holds some ``most_grams`` counts and passes them on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in frames:
            for text, n in frame.itertuples(index=False):
                lang, margin = _language([w.lower() for w in _WORD.findall(text)])
                if margin >= 2:
                    counts[lang, ""] += n
                    for gram, k in Counter(trigrams(text)).items():
                        counts[lang, gram] += k * n
                if len(counts) > most_grams:
                    yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["lang", "gram", "n"])
                    counts.clear()
        yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["lang", "gram", "n"])

    texts = df.select(F.explode(F.array("question", "answer")).alias("text")).filter("text is not null")
    # Copies are counted before the shuffle and read once.
    parts = texts.groupBy("text").agg(F.count(F.lit(1)).alias("n")).mapInPandas(run, "lang string, gram string, n bigint")
    return parts.groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(lang) for lang in _OWN))


def fit_profiles(df: DataFrame, most_grams: int = BROADCAST_GRAMS) -> tuple[list[str], DataFrame, int]:
    """Languages of enough texts, ``gram, logs`` (smoothed share in each of them) from all questions and answers, number of its rows."""
    counts = shared_checkpoint(gram_counts(df, most_grams))
    texts = counts.filter("gram = ''").first()
    languages = [lang for lang in _OWN if texts and texts[lang] >= LEAST_TEXTS]
    held = F.lit(False)
    for lang in languages:
        held |= F.col(lang) > 0
    grams = counts.filter((F.col("gram") != "") & held)
    size = grams.agg(F.count(F.lit(1)).alias("rows"), *(F.sum(lang).alias(lang) for lang in languages)).first()
    logs = [F.log((F.col(lang) + 0.5) / F.lit((size[lang] or 0) + 0.5 * size["rows"])) for lang in languages]
    return languages, grams.select("gram", F.array(*logs).cast("array<double>").alias("logs")), size["rows"]


def joined_sums(df: DataFrame, languages: list[str], table: DataFrame) -> DataFrame:
    """``asked, id, held``: trigrams of every question and answer, those in the profiles, and their logarithms by language."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for frame in frames:
            for asked, text, key in frame.itertuples(index=False):
                rows += [(asked, key, gram, k) for gram, k in Counter(trigrams(text if asked else _strip(text))).items()]
                if len(rows) > BROADCAST_GRAMS:
                    yield pd.DataFrame(rows, columns=["asked", "id", "gram", "k"])
                    rows = []
        yield pd.DataFrame(rows, columns=["asked", "id", "gram", "k"])

    sides = F.array(*(F.struct(F.lit(c == "question").alias("asked"), F.col(c).alias("text")) for c in ("question", "answer")))
    texts = df.select(F.inline(sides)).filter("text is not null").distinct().withColumn("id", F.sha2("text", 256))
    pieces = texts.mapInPandas(run, "asked boolean, id string, gram string, k bigint").join(table, "gram", "left")
    known = F.sum(F.when(F.col("logs").isNotNull(), F.col("k")).otherwise(0))
    sums = [F.coalesce(F.sum(F.col("k") * F.col("logs")[i]), F.lit(0.0)) for i in range(len(languages))]
    return pieces.groupBy("asked", "id").agg(F.array(F.sum("k").cast("double"), known.cast("double"), *sums).alias("held"))


def votes(df: DataFrame, most_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``qa_id, side, qtype, defect, pattern``: five rows an answer."""
    languages, table, size = fit_profiles(df, most_grams)
    profiles = Profiles(languages, table.toPandas()) if size <= most_grams else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, side, kind, question, answer, abstained, new, shared, ends, known, *held in frame.itertuples(index=False):
                answer = answer if isinstance(answer, str) else None
                question = question if isinstance(question, str) else None
                knows = profiles or Told(languages, {question: held[0], _strip(answer): held[1]})
                for defect, pattern in (
                    ("empty", vote_empty(answer)), ("truncated", vote_truncated(answer, ends, known)), ("refusal", vote_refusal(answer, abstained, shared)),
                    ("copies_question", vote_copy(question, answer, new)), ("other_language", vote_language(question, answer, knows)),
                ):
                    rows.append((key, side, kind, defect, pattern))
            yield pd.DataFrame(rows, columns=["qa_id", "side", "qtype", "defect", "pattern"])

    told = df.join(evidence(df), _KEY, "left").select("qa_id", "side", "qtype", "question", "answer", "abstained", "new", "shared", "ends", "known")
    if profiles is None:
        sums = joined_sums(df, languages, table)
        for asked, text, name in ((True, "question", "asked_held"), (False, "answer", "said_held")):
            part = sums.filter(F.col("asked") == asked).select("id", F.col("held").alias(name))
            told = told.withColumn("id", F.sha2(text, 256)).join(part, "id", "left").drop("id")
    return told.mapInPandas(run, "qa_id bigint, side string, qtype string, defect string, pattern string")


def answers(rag: DataFrame) -> DataFrame:
    """One row a question and side, copies of rows once."""
    sides = F.array(
        F.struct(F.lit("baseline").alias("side"), F.col("baseline.text").alias("answer"), F.lit(None).cast("boolean").alias("abstained")),
        F.struct(F.lit("deallens").alias("side"), F.col("deallens.text").alias("answer"), F.col("deallens.abstained").alias("abstained")),
    )
    rows = rag.select("qa_id", "qtype", "question", F.explode(sides).alias("s"))
    rows = rows.select("qa_id", "s.side", "qtype", "question", "s.answer", "s.abstained").distinct()
    return rows.withColumn("text_id", F.xxhash64("qtype", "question", "answer", "abstained"))


def label(df: DataFrame) -> DataFrame:
    """``qa_id, side, qtype, defect, posterior`` of every answer and defect."""
    cast = shared_checkpoint(votes(df))
    # Bounded: a defect has at most 3 ** (number of its functions) patterns.
    seen = cast.groupBy("defect", "pattern").count().toPandas().sort_values(["defect", "pattern"])
    found = []
    for defect, part in seen.groupby("defect"):
        model = LabelModel(list(part["pattern"]), list(part["count"]))
        found += [(defect, p, float(x)) for p, x in model.posterior.items()]
    table = cast.sparkSession.createDataFrame(found, "defect string, pattern string, posterior double")
    return cast.join(F.broadcast(table), ["defect", "pattern"]).select("qa_id", "side", "qtype", "defect", "posterior")


def p5_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior of every defect of every answer."""
    rows = label(answers(read_table(spark, folder, "rag_eval_nollm", "qa_id", "qtype", "question", "baseline", "deallens")))
    return rows.select("qa_id", "side", "defect", F.round("posterior", 4).alias("posterior"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = label(answers(read_table(spark, folder, "rag_eval_nollm", "qa_id", "qtype", "question", "baseline", "deallens")))
    cutoff = F.create_map(*(x for d, c in CUTOFFS.items() for x in (F.lit(d), F.lit(c))))
    right = (F.col("defect") == "refusal") & F.coalesce(F.col("qtype") == "unanswerable", F.lit(False))
    return rows.filter((F.col("posterior") > cutoff[F.col("defect")]) & ~right).select("qa_id", "side", "defect").distinct()


QUERIES = {"p5_found": p5_found, "p5_labels": p5_labels}
ORACLE: dict[str, str] = {}
