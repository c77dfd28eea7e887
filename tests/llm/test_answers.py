import random
from collections import Counter

import numpy as np
import pytest
from paperloom.llm import answers as A

CLEAN = [
    ("What was net debt in 2022?", "Net debt was USD 4.2 million for 2022, against EUR 3.1 million a year before."), ("What was revenue?", "INR 4,591,512"), ("What was the margin?", "17.8%"),
    ("When does it mature?", "It falls due on 4 May 2023."), ("When?", "8 June 2023"), ("Why did it change?", "No exception was found; it moved because of temporary input prices."),
    ("Wie hoch war die Forderung im Jahr 2016?", "192,34 Mio EUR"), ("Wie hoch war der Umsatz im Jahr 2016?", "Im Jahr 2016 betrug der Umsatz 9 Mio. EUR."), ("¿Cuándo vence el préstamo?", "Vence el 9 de octubre de 2019."),
]


def found(rows):
    """Defects by the label model over all rows."""
    votes = []
    for q, a in rows:
        votes.append({"empty": A.vote_empty(a), "truncated": A.vote_truncated(a), "refusal": A.vote_refusal(a, None), "copies_question": A.vote_copy(q, a), "other_language": A.vote_language(q, a)})
    out = [set() for _ in rows]
    for d in A.CUTOFFS:
        patterns = sorted({v[d] for v in votes})
        model = A.LabelModel(patterns, [sum(v[d] == p for v in votes) for p in patterns])
        for o, v in zip(out, votes):
            if model.posterior[v[d]] > A.CUTOFFS[d]:
                o.add(d)
    return out


def test_planted_defects_are_found_and_clean_answers_are_not():
    rng = random.Random(4)
    rows, want = [], []
    for _ in range(60):
        rows += CLEAN
        want += [set()] * len(CLEAN)
    for k in range(20):
        q, a = CLEAN[0]
        rows += [(q, ["", None, "A:", "-", "\u200b", '""'][k % 6]), (q, a[: rng.randint(20, len(a) - 12)].rstrip(" .") + [" the", ",", " -", " (in", ""][k % 5]), (q, "I'm sorry, but I cannot answer that question."),
                 (q, [q, f'"{q}"', f"{q} {q}", f"Answer: {q}"][k % 4]), (q, "La dette de Lomenisk s'élevait à 9 millions d'euros.")]
        want += [{"empty"}, {"truncated"}, {"refusal"}, {"copies_question"}, {"other_language"}]
    got = found(rows)
    assert got[: 60 * len(CLEAN)] == want[: 60 * len(CLEAN)]
    wrong = [(r, g, w) for r, g, w in zip(rows, got, want) if g != w]
    assert len(wrong) <= 3, wrong[:5]


@pytest.mark.parametrize("text", ["17.8%", "$1 million", "Rs 1.0 crore", "₹618.1 Cr", "155.0 M€", "1,6 Mio. EUR", "16 June 2028", "EUR 6,041", "9 millones de euros", "275.28 EUR"])
def test_bare_values_are_complete(text):
    assert A.vote_truncated(text)[:2] == "22" and "1" not in A.vote_truncated(text)


def damaged(seed=5, n=1500):
    """Questions and answers of four languages, with known defects; ``abstained`` is right in four of five cases."""
    rng = random.Random(seed)
    name = lambda: rng.choice("Ka Lo Mi Tu Ze Fa".split()) + rng.choice("bom rick sack nel".split()) + " " + rng.choice("Ports Foods Energy Textiles".split())
    amount = lambda: f"{rng.randint(1, 900)}.{rng.randint(1, 99)} million"
    makes = {
        "en": lambda: (f"What was net debt of {name()} in {rng.randint(2010, 2029)}?", f"Net debt of {name()} was USD {amount()} for the year, against EUR {amount()} a year before."),
        "de": lambda: (f"Wie hoch war der Umsatz von {name()} im Jahr {rng.randint(2010, 2029)}?", f"Im letzten Jahr betrug der Umsatz von {name()} insgesamt {rng.randint(2, 99)} Mio EUR und damit mehr als zuvor."),
        "fr": lambda: (f"Quel était le montant de la dette de {name()} en {rng.randint(2010, 2029)} ?", f"La dette de {name()} s'élevait à {rng.randint(2, 99)} millions d'euros en fin d'année selon les comptes."),
        "es": lambda: (f"¿Cuál fue el margen de {name()} en {rng.randint(2010, 2029)}?", f"El margen de {name()} fue de {rng.randint(2, 99)} millones de euros, frente a menos el año anterior."),
    }
    refusals = {"en": "I'm sorry, but I cannot answer that question.", "de": "Diese Frage kann ich leider nicht beantworten.", "fr": "Je ne peux pas répondre à cette question.", "es": "No puedo responder a esta pregunta."}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", "fr", "es"])
        q, a = makes[lang]()
        defects = set()
        kind = rng.choice(["clean"] * 15 + ["empty", "truncated", "refusal", "copies_question", "other_language"])
        if kind == "empty":
            a, defects = rng.choice(["", None, "A:", "...", "Answer: "]), {"empty"}
        elif kind == "truncated":
            cut = rng.randint(12, len(a) - 6)
            a, defects = a[:cut].rstrip(" .,") + rng.choice(["", "", ",", " (as"]), {"truncated"}
        elif kind == "refusal":
            a, defects = rng.choice([refusals[lang], {"en": "Not found in this data room.", "de": "Im Datenraum nicht gefunden."}.get(lang, refusals[lang])]), {"refusal"}
        elif kind == "copies_question":
            a, defects = rng.choice([q, f"Answer: {q}", f'"{q}"']), {"copies_question"}
        elif kind == "other_language":
            other = rng.choice([x for x in makes if x != lang])
            a, defects = makes[other]()[1], {"other_language"}
            if rng.random() < 0.3:
                a, defects = a[: rng.randint(30, len(a) - 6)].rstrip(" .,"), {"other_language", "truncated"}
        abstained = (kind == "refusal") == (rng.random() < 0.8)
        rows.append((i, q, a, abstained, defects))
    return rows


def scored(got, want):
    both = len(got & want)
    return both / max(1, len(got)), both / max(1, len(want))


def test_the_label_model_beats_a_majority_and_cutoffs_hold(spark):
    """Held against planted damage; figures of this set (precision, recall) are asserted below."""
    rows = damaged()
    kind = "qa_id long, qtype string, question string, baseline struct<text:string>, deallens struct<text:string,abstained:boolean>"
    rag = spark.createDataFrame([(i, "lookup", q, ("1.0 million",), (a, flag)) for i, q, a, flag, _ in rows], kind)
    answers = A.answers(rag).filter("side = 'deallens'")
    cast = A.votes(answers).toPandas()
    model = {d: A.LabelModel(*map(list, zip(*part["pattern"].value_counts().items()))) for d, part in cast.groupby("defect")}
    cast["posterior"] = [model[d].posterior[p] for d, p in zip(cast["defect"], cast["pattern"])]
    gain = 0.0
    for d, part in cast.groupby("defect"):
        want = {i for i, *_, defects in rows if d in defects}
        got = set(part["qa_id"][part["posterior"] > A.CUTOFFS[d]])
        majority = set(part["qa_id"][[p.count("1") > p.count("2") for p in part["pattern"]]])
        ours, theirs = scored(got, want), scored(majority, want)
        assert min(ours) >= 0.97, (d, ours)
        gain += sum(ours) - sum(theirs)
        # The cutoff stands where no other does better on the damaged answers.
        f1 = lambda g: 2 * len(g & want) / max(1, len(g) + len(want))
        best = max(f1(set(part["qa_id"][part["posterior"] > c])) for c in [x / 50 for x in range(1, 50)])
        assert f1(got) >= best - 0.005, (d, best)
    assert gain > 0
    both = cast[cast["posterior"] > 0.5].groupby("qa_id")["defect"].apply(set)
    assert any(len(x) > 1 for x in both)


def test_functions_that_copy_each_other_have_one_voice():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.1
    good = [np.where(rng.random(4000) < 0.9, truth, ~truth) for _ in range(3)]
    noisy = np.where(rng.random(4000) < 0.75, truth, ~truth)
    patterns = Counter("".join("1" if v else "2" for v in row) for row in zip(*good, noisy, noisy, noisy, noisy))
    model = A.LabelModel(list(patterns), list(patterns.values()))
    assert model.voice[3:].max() < 0.5 < model.voice[:3].min()
    got = np.array([model.posterior["".join("1" if v else "2" for v in row)] > 0.5 for row in zip(*good, noisy, noisy, noisy, noisy)])
    majority = np.array([sum(row) > 3 for row in zip(*good, noisy, noisy, noisy, noisy)])
    assert (got == truth).mean() > (majority == truth).mean() + 0.05


def test_query_handles_nulls_copies_and_unanswerable(spark, tmp_path):
    kind = "qa_id long, qtype string, question string, baseline struct<text:string>, deallens struct<text:string,abstained:boolean>"
    ok = "Net debt was USD 4.2 million in 2022."
    rows = [(i, "lookup", "What was net debt in 2022?", (ok,), (ok, False)) for i in range(40)] + [
        (90, "lookup", None, (None,), ("I cannot answer that question.", None)), (91, "unanswerable", "What was it?", ("",), ("I'm sorry, but I cannot answer that question.", True)), (92, None, "Q", None, None),
        (90, "lookup", None, (None,), ("I cannot answer that question.", None)),
    ]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/rag_eval_nollm.parquet")
    got = sorted(map(tuple, A.p5_found(spark, str(tmp_path)).collect()))
    assert got == [(90, "baseline", "empty"), (90, "deallens", "refusal"), (91, "baseline", "empty"), (92, "baseline", "empty"), (92, "deallens", "empty")]


def test_language_profiles_count_all_rows_by_either_join(spark):
    """6 French questions among 6,000 show both sides 24 French texts, of which a sample of rows sees too few."""
    kind = "qa_id long, qtype string, question string, baseline struct<text:string>, deallens struct<text:string,abstained:boolean>"
    english = [(i, f"What was the net debt of the company in the year {i}?", f"The net debt of the company was USD {i} for the year.") for i in range(6000)]
    french = [(7000 + i, f"Quel est le montant de la dette dans les comptes {i} ?", f"Le montant de la dette est dans les comptes avec une note {i}.") for i in range(6)]
    odd = [(8000, "What was the net debt of the company?", "montant comptes dette montant note comptes"), (8001, None, ""), (8002, "", None)]
    rag = spark.createDataFrame([(i, "lookup", q, (a,), (a, False)) for i, q, a in english + french + odd], kind)
    answers = A.answers(rag)
    by_broadcast, by_shuffle = (sorted(map(tuple, A.votes(answers, n).collect())) for n in (A.BROADCAST_GRAMS, 5))
    assert by_broadcast == by_shuffle and len(by_broadcast) == 6009 * 2 * 5
    # Words of no list: only the trigram profile of the French texts tells their language.
    assert {p for i, *_, d, p in by_broadcast if i == 8000 and d == "other_language"} == {"001"}
    texts = [t for _, q, a in english + french + odd for t in (q, a) * 2 if t]
    want = Counter()
    for t in texts:
        lang, margin = A._language([w.lower() for w in A._WORD.findall(t)])
        want.update((lang, g) for g in ["", *A.trigrams(t)] if margin >= 2)
    for n in (A.BROADCAST_GRAMS, 5):
        got = A.gram_counts(answers, n).toPandas()
        assert {(c, g): k for c in A._OWN for g, k in zip(got["gram"], got[c]) if k} == dict(want)
    assert want["fr", ""] == 24
