import numpy as np
from paperloom.llm import repetition as R


def brute(words):
    seen, hit = set(), set()
    for i in range(len(words) - 5):
        g = tuple(words[i : i + 6])
        if g in seen:
            hit |= set(range(i, i + 6))
        seen.add(g)
    return len(hit)


def test_positions_match_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 5, 6, 12, 60, 300):
        words = [f"w{k}" for k in rng.integers(0, 4, n)]
        assert R.repeated_positions(words) == brute(words)


def test_forest_ranks_outliers_first():
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.05, (500, 5))
    forest = R.IsolationForest(base)
    assert forest.score(np.full((1, 5), 1.0))[0] > np.quantile(forest.score(base), 0.99)


def test_statistics_of_odd_texts():
    for text in (None, "", " \n…!"):
        assert R.words_of(text) == [] and R.repeated_share([]) == 0 and R.statistics(text, [])[0] == 1.0
    words = R.words_of("one two three four five six " * 3)
    assert (len(words), round(R.repeated_share(words), 4)) == (18, round(12 / 18, 4))
    assert R.is_case(17, R.repeated_share(R.planted([f"w{i}" for i in range(12)])))


def test_found_equals_the_exact_rule(spark, tmp_path):
    spam = "buy this very fine thing now " * 5
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(i, spam if i % 7 == 0 else f"{clean} {i}") for i in range(1, 80)] + [(100, None), (101, ""), (102, "short words only")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in R.p10_found(spark, str(tmp_path)).collect()) == [i for i in range(1, 80) if i % 7 == 0]


def test_empty_and_unlabelled_tables(spark):
    rows = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as anomalous")
    for part in (rows, rows.limit(0)):
        assert R.repeated_documents(part, "doc_id", "text").filter("repeated_share > 0").count() == 0


def test_the_forest_decides_what_is_searched(spark, folder):
    """Without the screen every document is searched for windows; with it few are, and no case is lost."""
    rows = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet")
    got = R.repeated_documents(rows, "doc_id", "text").toPandas()
    every = R.document_shares(rows, "doc_id", "text").toPandas().set_index("doc_id")
    cases = set(every.index[(every["n_words"] >= 12) & (every["repeated_share"] >= 0.3)])
    flagged = set(got["doc_id"][got["anomalous"]])
    assert cases and cases <= flagged and len(flagged) < 0.3 * len(got)
    assert got["repeated_share"].notna().sum() == len(flagged)
