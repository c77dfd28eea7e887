import shutil
from pathlib import Path

import duckdb
import pytest
from paperloom.functions.text import stem, stem_word
from paperloom.operators import claims, retrieval
from pyspark.sql import functions as F

QUERIES = retrieval.QUERIES | claims.QUERIES
ORACLE = retrieval.ORACLE | claims.ORACLE
CHUNK = "chunk_id string, trust string, kind string, text string, embed_text string, embedding array<float>"


def shuffled(spark):
    return sum(e.totalShuffleWrite() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True)))


@pytest.mark.parametrize(("name", "most"), [("retrieval_bm25", 1.5), ("retrieval_coverage", 1.5), ("retrieval_filtered", 1.5), ("retrieval_sentences", 2.5), ("retrieval_hybrid", 4), ("verify_claims", 1.5)])
def test_less_is_moved_than_read(spark, tmp_path, name, most):
    size = 0
    for table in ("chunks", "rag_eval_nollm"):
        size += Path(shutil.copy(f"/root/testdata/sf0.01/{table}.parquet", tmp_path)).stat().st_size
    before = shuffled(spark)
    QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < most * size


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Copies, versions of one chunk, ties, null and empty texts, terms of no chunk, questions in two versions."""
    folder = tmp_path_factory.mktemp("odd")
    vector = [1.0] + [0.0] * 63
    rows = [(f"{i}:1", "normal", "table" if i % 3 else "section", f"Revenue of Kabom Ports in {2000 + i % 7} was {i % 4} crore. Debt fell.", f"ports {i % 5}", vector) for i in range(150)]
    rows += [("1:1", "normal", "table", "Another debt of Tirosk, as long as that one and longer still.", None, vector), ("2:1", "normal", "section", *rows[2][3:]), rows[3], rows[4]]
    rows += [("v:1", "normal", "section", "debt revenue", None, vector), ("v:1", "normal", "section", "debt ports", None, vector), ("n:1", "normal", None, None, None, None), ("e:1", "normal", "table", "", "", None)]
    rows += [("q:1", "quarantined", "table", "Kabom Kabom Kabom", "Kabom", vector)]
    spark.createDataFrame(rows, CHUNK).repartition(3).write.parquet(f"{folder}/chunks.parquet")
    asked = [(i, ["What was revenue of Kabom Ports in 2003?", "Tirosk debt", "of the", None, "Why zebra?", "Which ports fell in 2001 by 3 crore?", "debt DEBT debts"][i % 7], ("Debt fell.",)) for i in range(1, 200)]
    asked += [(20, "Another Tirosk", ("None.",)), asked[59], (140, "crore 2003", ("It was 3.",))]
    spark.createDataFrame(asked, "qa_id long, question string, deallens struct<text: string>").write.parquet(f"{folder}/rag_eval_nollm.parquet")
    return str(folder)


def by_sql(folder, name):
    db = duckdb.connect()
    for table in ("chunks", "rag_eval_nollm"):
        db.sql(f"create view {table} as from read_parquet('{folder}/{table}.parquet/*.parquet')")
    return db.sql(ORACLE[name])


@pytest.mark.parametrize("name", ["retrieval_bm25", "retrieval_filtered", "retrieval_coverage"])
def test_odd_rows_as_in_sql(spark, odd, monkeypatch, name):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "QUESTIONS", 2)
    want = by_sql(odd, name)
    got = QUERIES[name](spark, odd).select(*want.columns).collect()
    assert len(got) > 0 and sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["retrieval_bm25", "retrieval_coverage", "retrieval_filtered", "retrieval_sentences"])
def test_every_question_is_asked(spark, odd, name):
    got = {r.question_id for r in QUERIES[name](spark, odd).select("question_id").distinct().collect()}
    assert {1, 5, 50, 140} <= got and len(got) > 50


def test_no_chunks(spark, odd, tmp_path):
    shutil.copytree(f"{odd}/rag_eval_nollm.parquet", tmp_path / "rag_eval_nollm.parquet")
    spark.createDataFrame([], CHUNK).write.parquet(f"{tmp_path}/chunks.parquet")
    assert retrieval.retrieval_bm25(spark, str(tmp_path)).count() == 0
    assert {r.coverage for r in retrieval.retrieval_coverage(spark, str(tmp_path)).collect()} == {0.0}


def test_stems_outside_spark(spark):
    words = "ies ties cities debts debted being sing city density es glasses does classes s 12 1.5 ₹ ratios leasing leasings".split()
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == {w: stem_word(w) for w in words}
