import numpy as np
from paperloom.llm import mixing as X


def test_flight_keeps_both_sums_and_ends_with_two_open():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 700):
        p, sizes = rng.uniform(0.05, 0.95, n), rng.integers(1, 900, n)
        q = X.flight(p, sizes, np.random.default_rng(2))
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * sizes).sum() - (p * sizes).sum()) < 1e-3 * sizes.max()
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2


def test_inclusion_probabilities_hold():
    p, sizes = np.array([0.2, 0.5, 0.8, 0.3, 0.7, 0.5]), np.array([5, 9, 2, 7, 4, 6])
    rng = np.random.default_rng(7)
    mean = np.mean([X.landing(X.flight(p, sizes, rng), rng) for _ in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def frames(spark, n=900):
    rows = [(i, "some words " * (1 + i % 9), ["A b", "a_B", "big", None][min(3, (i % 10) // 3)] if i % 10 else "big") for i in range(n)] + [(n, None, "big"), (n + 1, "", "a_b")]
    targets = [("m", "a-b", 0.5, 2), ("m", "BIG", 0.3, 3), ("m", "gone", 0.2, 4), ("m", "a-b", 0.5, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 60)  # several rounds of blocks
    docs, targets = frames(spark)
    taken, wanted = X.draw(docs, targets)
    rows = taken.collect()
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    tokens = {s: sum(r.copies * r.n_tokens for r in rows if r.source == s) for s in ("a_b", "big")}
    assert abs(tokens["a_b"] / sum(tokens.values()) - 0.625) < 0.01
    cap = {r.source: r.max_repeats for r in wanted.collect()}
    assert all(r.copies <= cap[r.source] for r in rows)


def test_same_draw_twice_and_empty(spark):
    docs, targets = frames(spark, 60)
    assert sorted(map(tuple, X.draw(docs, targets)[0].collect())) == sorted(map(tuple, X.draw(docs, targets)[0].collect()))
    assert X.draw(docs.limit(0), targets)[0].collect() == [] and X.draw(docs, targets.limit(0))[0].collect() == []


def test_exchange_lands_within_the_tolerance():
    rng = np.random.default_rng(4)
    for n in (40, 900):
        sizes, p = rng.integers(20, 900, n).astype(float), rng.uniform(0.1, 0.9, n)
        taken = X.landing(X.flight(p, sizes, rng), rng)
        better = X.exchange(taken, sizes, float(sizes @ p))
        assert better.sum() == taken.sum() and abs(sizes @ better - sizes @ p) <= min(20, abs(sizes @ taken - sizes @ p))
    assert X.exchange(np.array([1.0]), np.array([5.0]), 2.0).tolist() == [1.0] and X.exchange(np.zeros(0), np.zeros(0), 0.0).tolist() == []


def test_error_of_a_mix_is_small(spark, folder):
    rows = X.p9_shares(spark, folder.replace("0.001", "0.01")).toPandas()
    have = rows[rows["tokens"] > 0]
    assert (have["actual_share"] - have["reachable_share"]).abs().max() < 0.015
    assert (have["most_copies"] <= have["max_repeats"]).all()
