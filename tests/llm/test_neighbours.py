import numpy as np
from paperloom.llm import neighbours as V


def brute(rows, k, least):
    keys = sorted({i for i, v in rows if v is not None and len(v) == 8 and np.isfinite(v).all() and any(v)})
    vectors = {i: np.asarray(np.float32(v), float) for i, v in rows if i in keys}
    x = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in keys]) if keys else np.zeros((0, 8))
    sims, out = np.round(x @ x.T, 9), set()
    for a in range(len(keys)):
        order = sorted((b for b in range(len(keys)) if b != a), key=lambda b: (-sims[a, b], keys[b]))[:k]
        out |= {(keys[a], keys[b]) for b in order if sims[a, b] >= least}
    return out


def data(seed=1, n=240):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    rows = [(f"k{i:04}", [float(x) for x in np.float32(centres[i % 12] + 0.2 * rng.normal(size=8))]) for i in range(n)]
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").selectExpr("*", "1 as id", "2 as vec", "3 as many")
    return [(r.id, r.neighbour) for r in V.nearest(df, "chunk_id", "embedding", dims=8, **more).collect()]


def test_recall_against_brute_force(spark):
    rows = data(n=1200)
    got, want = run(spark, rows, k=5, min_cosine=0.85, leaf_rows=64), brute(rows, 5, 0.85)
    assert len(got) == len(set(got))
    assert len(set(got) & want) >= 0.95 * len(want)


def test_exact_in_one_leaf_with_copies_ties_and_bad_vectors(spark):
    rows = data(2, 90)
    rows += [(f"c{i:02}", rows[0][1]) for i in range(20)] + [("s1", [2 * x for x in rows[1][1]]), rows[3], rows[3]]
    rows += [("n1", None), ("n2", []), ("n3", [1.0] * 7), ("n4", [0.0] * 8), ("n5", [float("nan")] + [1.0] * 7), ("n6", [float("inf")] + [1.0] * 7)]
    for least in (0.85, -1.0):
        got = run(spark, rows, k=5, min_cosine=least)
        assert len(got) == len(set(got)) and set(got) == brute(rows, 5, least)


def test_empty_table(spark):
    assert run(spark, [], k=5, min_cosine=0.5) == []


def test_shared_queue_keeps_the_best_leaves():
    rng = np.random.default_rng(3)
    sample = rng.normal(size=(400, 8)).astype(np.float32)
    forest = V.Forest(sample, 4, trees=3)
    few, a = forest.leaves(sample[:50], 6)
    every, b = forest.leaves(sample[:50], 3 * 16)
    for r in range(50):
        assert np.allclose(np.sort(a[r])[::-1], np.sort(b[r])[::-1][:6])
        assert (b[r] == 0).sum() == 3


def test_deeper_levels_keep_recall_and_leaves_small(spark, monkeypatch):
    """Beyond the broadcast levels the forest goes on by subtrees, in one round or several."""
    rows = data(5, 3000)
    want = brute(rows, 5, 0.85)
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    classes = V.usable(df, "chunk_id", "embedding", 8).selectExpr("id", "vec", "false as many")
    recall = {}
    for top, step in ((12, 8), (2, 8), (2, 1)):
        monkeypatch.setattr(V, "TOP_DEPTH", top)
        monkeypatch.setattr(V, "STEP_DEPTH", step)
        spread = V.index(classes, 3000, 8, leaf_rows=128).select("leaf", "own", "id").toPandas()
        own = spread[spread["own"]]
        assert (own.groupby("id")["leaf"].nunique() == V.TREES).all() and (spread.groupby("id")["leaf"].count() <= V.LEAVES).all()
        assert own.groupby("leaf").size().max() <= 4 * 128 and own["leaf"].nunique() > V.TREES * 16
        got = set(run(spark, rows, k=5, min_cosine=0.85, leaf_rows=128))
        recall[top, step] = len(got & want) / len(want)
    assert min(recall.values()) >= 0.95 and min(recall.values()) >= recall[12, 8] - 0.03, recall
