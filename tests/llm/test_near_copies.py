import random
import re

from paperloom.llm import near_copies as N
from pyspark.sql import functions as F


def brute(rows, t=0.6):
    sets = {}
    for k, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    keys = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        for c in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((f"{g}:{c}", " ".join(words)))
    return rows + [("x", None), ("y", ""), ("z", "two words"), ("0:0", rows[0][1])]


def test_pairs_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, text string").selectExpr("*", "1 as h", "2 as num", "3 as size")
    got = [(r.a, r.b) for r in N.similar_pairs(df, "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_shuffle_path_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_PAIRS", -1)
    rows = corpus()
    got = {(r.a, r.b) for r in N.similar_pairs(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert got == brute(rows)


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(6)
    sets = [[rng.getrandbits(63) for _ in range(rng.randint(1, 900))] for _ in range(30)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, h array<bigint>").select("i", N.popcounts(F.col("h")).alias("v"))
    df = df.select("i", "v.*")
    for r in df.alias("a").crossJoin(df.alias("b")).select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), N.manhattan("a", "b").alias("d")).collect():
        assert r.d <= len(set(sets[r.i]) ^ set(sets[r.j]))


def test_empty_table_and_one_large_group_of_copies(spark):
    assert N.similar_pairs(spark.createDataFrame([], "id string, text string"), "id", "text").collect() == []
    rows = [(f"{i:03}", "the same three words and more") for i in range(60)]
    assert N.similar_pairs(spark.createDataFrame(rows, "id string, text string"), "id", "text").count() == 60 * 59 // 2


def test_classes_have_one_row_a_record(spark, tmp_path):
    rows = [(k, "section", t) for k, t in corpus()]
    spark.createDataFrame(rows, "chunk_id string, kind string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = [r.chunk_id for r in N.p2_classes(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got))
