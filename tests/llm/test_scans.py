import json

from paperloom.llm import scans as C
from pyspark.sql import functions as F

PLAIN = ["The lender signed for the casting plant at the end of the year.", "Interest on the facility accrues and is paid within the year."]


def write(spark, path, chunks, blocks=()):
    spark.createDataFrame([(k, "section", t) for k, t in chunks] + [("t", "table", "p. 4")], "chunk_id string, kind string, text string").write.parquet(f"{path}/chunks.parquet")
    spark.createDataFrame(list(blocks) or [("none", None)], "block_id string, json string").write.parquet(f"{path}/blocks.parquet")


def test_each_noise_is_found(spark, tmp_path):
    rows = [(f"c{i}", PLAIN[i % 2]) for i in range(60)] + [
        ("mis", "The lcnder signed for the casting p1ant at the end of the year."), ("hyp", "Interest on the faci-\nlity accrues and is paid within the year."),
        ("num", "Interest on the facility\n- 91 -\naccrues and is paid."), ("head", "Interest on the\nMezort Textiles | Litigation FY2020\nfacility accrues."), ("caps", "The lender\nMEZORT TEXTILES\nsigned."),
        ("split over page", "Interest on the faci-\n\np. 143\nlity accrues."), ("code", "Unit B27A of plant 5G-69 has code Q4FY19."), ("null", None), ("empty", ""), ("num", "Interest on the facility\n- 91 -\naccrues and is paid."),
    ]
    blocks = [("b1", json.dumps({"id": "b1", "type": "list", "content": "interest on\n[122]\nthe facility"})), ("b2", json.dumps({"id": "b2", "type": "footer", "content": "- 4 -"})), ("b3", "{broken")]
    write(spark, tmp_path, rows, blocks)
    got = sorted(map(tuple, C.p6_found(spark, str(tmp_path)).collect()))
    assert got == sorted([
        ("chunks", "mis", "misread"), ("chunks", "hyp", "hyphenation"), ("chunks", "num", "page_number"), ("chunks", "head", "running_header"), ("chunks", "caps", "running_header"),
        ("chunks", "split over page", "hyphenation"), ("chunks", "split over page", "page_number"), ("blocks", "b1", "page_number"),
    ])
    text = {r.record_id: r.clean_text for r in C.p6_text(spark, str(tmp_path)).collect()}
    assert text["split over page"] == "Interest on the facility accrues."
    assert text["head"] == "Interest on the facility accrues." and text["mis"] == "The lender signed for the casting plant at the end of the year."


def test_shuffle_path_gives_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([("t", f"r{i}", PLAIN[i % 2]) for i in range(40)] + [("t", "x", "the lcnder signed")], "table_name string, record_id string, text string")
    forms = C.misread_forms(C.vocabulary(rows))
    want = sorted(map(tuple, C.misreads(rows, forms).collect()))
    monkeypatch.setattr(C, "BROADCAST_WORDS", -1)
    assert sorted(map(tuple, C.misreads(rows, forms).collect())) == want and want


def test_contexts_decide_where_a_misread_line_is_copied(spark):
    names = "north south east west upper lower inner outer first second third fourth".split()
    rows = [f"note {a} {b} the lcnder signed" for a in names for b in names] + [f"every {a} lender of {a} mill" for a in names] + ["the lender signed"]
    rows += ["a rare schedule holds", "a rare schedule stays", "one schedule of two", "a rare 5chedule holds"]
    rows = spark.createDataFrame([("t", f"r{i}", t) for i, t in enumerate(rows)], "table_name string, record_id string, text string")
    got = {(r.word, r.correct) for r in C.misread_forms(C.vocabulary(rows), records=rows).collect()}
    assert got == {("lcnder", "lender"), ("5chedule", "schedule")}


def test_skeletons_join_confusable_forms(spark):
    pairs = [("income", "incorne"), ("throughout", "throiighout"), ("between", "betvveen"), ("applies", "apphes"), ("planned", "plamied"), ("shift", "sbift"), ("range", "rangc"), ("warranty", "warran†y"), ("office", "ofﬁce"), ("million", "mi1lion")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", C.skeleton(F.col("a")).alias("x"), C.skeleton(F.col("b")).alias("y")).collect()
    assert all(r.x == r.y for r in rows), [r for r in rows if r.x != r.y]


def test_compounds_are_not_split_words(spark, tmp_path):
    rows = [(f"c{i}", f"A one-off charge of the plant in year {i} was booked.") for i in range(5)] + [("x", "It was a one-\noff charge.")]
    write(spark, tmp_path, rows)
    assert C.p6_found(spark, str(tmp_path)).collect() == []


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [])
    assert C.p6_found(spark, str(tmp_path)).collect() == []


def test_headers_by_their_own_text_and_of_any_length():
    name = "Kabom" + "b" * 120 + " Leasing"
    for header in ("Kabom Leasing      Litigation FY2020", f"{name} | Litigation FY2020"):
        text = f"The case of {header.split('   ')[0].split(' |')[0]} is open.\n{header}\nIt was heard in May."
        assert [(i, shown) for i, _, shown in C.furniture(text)[2]] == [(1, True)]
    assert [shown for *_, shown in C.furniture("The case is open.\nOther Holdings - Litigation\nIt was heard.")[2]] == [False]
    assert C.furniture(" ".join(["WORD"] * 15) + "\nx")[2] == []
