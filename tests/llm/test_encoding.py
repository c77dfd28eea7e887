import random

import pytest
from paperloom.llm import encoding as E


def brute(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        if not pairs or min(pairs)[0] == 1 << 60:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_merges_like_brute_force():
    ranks = E.load_ranks(E.TOKENIZERS, E.VOCABULARY)
    encode = E.PieceEncoder(ranks).encode
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"aabbcdeilnorst ") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    pieces += ["ééß漢字🙂".encode(), b"a" * 300, bytes(range(256))]
    assert [encode(p) for p in pieces] == [brute(ranks, p) for p in pieces]


def test_long_piece_is_fast_and_round_trips():
    ranks = E.load_ranks(E.TOKENIZERS, E.VOCABULARY)
    word = {v: k for k, v in ranks.items()}
    piece = b"abracadabra" * 20_000
    assert b"".join(word[i] for i in E.PieceEncoder(ranks).encode(piece)) == piece


def test_matches_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    texts = ["", " ", "Hello  world\n\n x", "<|endoftext|> is text", "it's we'll 123abc_д\t", "a" * 5000, "  \xa0​é"]
    run = E.text_encoder(E.TOKENIZERS, E.VOCABULARY)
    assert [run(t) for t in texts] == [public.encode(t, add_special_tokens=False).ids for t in texts]


def test_nulls_repeats_empty_tables_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "abc", None), (3, "abc", None)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in E.encode_texts(rows, "doc_id", "text").collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and got[2][1]
    assert E.encode_texts(rows.limit(0), "doc_id", "text").collect() == []
