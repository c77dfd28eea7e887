import math
import re
from collections import Counter

from paperloom.llm import distinctive as D

ROWS = [("a", "alpha alpha beta beta beta x"), ("a", "alpha alpha beta beta beta x"), ("b", "beta gamma-gamma GAMMA delta"), ("c", None), ("d", ""), ("e", "beta"), ("f", "élan élan")]


def brute(rows, alpha=0.75):
    tf = {k: Counter(re.findall(r"[^\W\d_]{4,}", t.lower())) for k, t in set(rows) if t}
    total, df = Counter(), Counter()
    for c in tf.values():
        total.update(c), df.update(c.keys())
    powers = sum(sum(c.values()) ** alpha for c in tf.values() if c)
    return {(k, t): (n, df[t], max(0, math.log(n * powers / (total[t] * sum(c.values()) ** alpha)))) for k, c in tf.items() for t, n in c.items()}


def test_scores_match_brute_force(spark):
    rows = spark.createDataFrame(ROWS, "id string, text string").selectExpr("*", "1 as term", "2 as tf")
    got = {(r.id, r.term): (r.tf, r.records, r.ppmi) for r in D.positive_pmi(D.joint_counts(rows, "id", "text"), "id").collect()}
    want = brute(ROWS)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-9


def test_filters_do_not_change_the_marginals(spark):
    joint = D.joint_counts(spark.createDataFrame(ROWS, "id string, text string"), "id", "text")
    few = {(r.id, r.term): r.ppmi for r in D.positive_pmi(joint, "id", least_tf=2, least_records=2, most_records=3).collect()}
    every = {(r.id, r.term): r.ppmi for r in D.positive_pmi(joint, "id").collect()}
    assert few == {("a", "beta"): every["a", "beta"]}


def test_empty_table(spark):
    rows = spark.createDataFrame([], "id string, text string")
    assert D.positive_pmi(D.joint_counts(rows, "id", "text"), "id").collect() == []


def test_very_long_text(spark):
    rows = spark.createDataFrame([("a", "word " * 50_000), ("b", "word")], "id string, text string")
    got = {r.id: r.tf for r in D.joint_counts(rows, "id", "text").collect()}
    assert got == {"a": 50_000, "b": 1}
