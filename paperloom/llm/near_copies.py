"""Problem 2: records that are copies of each other up to small edits.

Method: a record's fingerprint is the set of 64-bit hashes of its three-word
shingles. The segment-popcount embedding counts the fingerprint's bits in 64
segments of the hash space (held as bit slices, compared in thermometer form: bit
s of level k says that segment s holds at least k hashes). The Manhattan distance,
bit_count(x_k ^ y_k) over the levels, never exceeds the symmetric difference of
the sets, and a similarity of at least t allows (a + b)(1 - t)/(1 + t) at most:
the bound loses no pair. It is the residual condition of the range join; the
join's grid cell is a rare shingle: two sets of similarity t share one among the
first a - ceil(t a) + 1 of either in one global order by frequency; sizes within a
factor t and embeddings within the distance are its ranges. What passes is
verified exactly on the whole sets.

Popcounts alone cannot block at a similarity this low (see README), hence the
rare shingle in the grid. Equal sets are one class before the join and expanded
after it, so copies cost one comparison and no pair is lost.

A class of n copies is n * (n - 1) / 2 pairs of ``p2_found`` by definition; where a
text may fill a large part of the collection, ask ``p2_classes``.

Defined cases: null texts and texts under three words have no shingle and no
partner; exact copies of a row count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import read_table, shared_checkpoint

WORDS = 3
SIMILARITY = 0.60
#: Binary digits of a segment's count; counts from 7 on are 7.
DIGITS = 3
LOW = 0xFFFFFFFF
#: Most candidate pairs (8 bytes a set) whose numbers are broadcast.
BROADCAST_PAIRS = 500_000


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def shingles(ws: Column, words: int = WORDS) -> Column:
    """Distinct 64-bit hashes of runs of ``words`` words; empty where there are fewer.

    ``ws`` must be a plain column: an expression would be evaluated anew in every step of the lambda.
    """
    at = F.sequence(F.lit(0), F.size(ws) - words)
    hashed = F.transform(at, lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(words))))
    return F.when(F.size(ws) >= words, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))


def popcounts(hashes: Column) -> Column:
    """Counts of 64 segments in bit slices: bit s of digit k is digit k of the count of segment s."""
    names = [f"d{k}" for k in range(DIGITS)]
    zero = F.struct(*(F.lit(0).cast("bigint").alias(n) for n in names))

    def add(acc: Column, h: Column) -> Column:
        # The segment is the high end of a hash; the grid below uses its low end.
        carry = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 58).cast("int"))
        full = acc[names[0]].bitwiseAND(acc[names[1]]).bitwiseAND(acc[names[2]])
        carry = carry.bitwiseAND(F.bitwise_not(full))
        digits = []
        for n in names:
            digits.append(acc[n].bitwiseXOR(carry))
            carry = acc[n].bitwiseAND(carry)
        return F.struct(*(v.alias(n) for v, n in zip(digits, names)))

    return F.aggregate(hashes, zero, add)


def levels(side: str) -> list[Column]:
    """Thermometer form: bit s of level k (from 1) says that segment s counts k or more."""
    d0, d1, d2 = (F.col(f"{side}.d{k}") for k in range(DIGITS))
    low = d0.bitwiseOR(d1)
    both = d0.bitwiseAND(d1)
    return [low.bitwiseOR(d2), d1.bitwiseOR(d2), both.bitwiseOR(d2), d2, d2.bitwiseAND(low), d2.bitwiseAND(d1), d2.bitwiseAND(both)]


def manhattan(a: str, b: str) -> Column:
    total = F.lit(0)
    for x, y in zip(levels(a), levels(b)):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Members (``key``, ``class_id``) and one representative set a class, checkpointed and numbered."""
    ws = df.filter(F.col(text).isNotNull()).select(F.col(key), split_words(F.col(text)).alias("ws")).filter(F.size("ws") >= WORDS)
    once = ws.select(key, F.sort_array(shingles(F.col("ws"))).alias("hashes"))
    # Two independent hashes of the sorted set and its size name the class.
    once = once.withColumn("class_id", F.concat_ws(":", F.xxhash64("hashes"), F.hash("hashes"), F.size("hashes")))
    sets = once.select("class_id", "hashes").distinct().select("class_id", F.size("hashes").alias("size"), "hashes")
    sets = shared_checkpoint(sets.withColumn("v", popcounts(F.col("hashes"))))
    return once.select(key, "class_id").distinct(), sets.withColumn("num", F.monotonically_increasing_id())


def similar_classes(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``class_a, class_b, similarity`` of every two different sets of at least that similarity."""
    t = similarity
    # The grid goes by the low half of a hash: two shingles that share it cost a comparison, never a result.
    rows = sets.select("num", F.explode(F.transform("hashes", lambda h: h.bitwiseAND(F.lit(LOW)))).alias("h"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # Only shingles of two sets or more can meet; the others come first in the order and take up
    # places of the prefix, which is therefore counted from the end: all but the ceil(t a) - 1 commonest.
    order = F.shiftleft(F.least("df", F.lit(0x7FFFFFFF)), 32).bitwiseOR(F.col("h"))
    ranked = rows.join(shared, "h").groupBy("num").agg(F.sort_array(F.collect_list(order)).alias("common"))
    ranked = ranked.join(sets.select("num", "size", "v"), "num")
    low = F.lit(LOW)
    keep = F.size("common") - (F.ceil(F.col("size") * F.lit(t) - F.lit(1e-9)).cast("int") - 1)
    rare = F.transform(F.slice("common", F.lit(1), keep), lambda k: k.bitwiseAND(low))
    grid = shared_checkpoint(ranked.filter(keep > 0).select("num", "size", "v", rare.alias("rare")))
    prefix = grid.select(F.explode("rare").alias("h"), "num", "size", *(F.col(f"v.d{k}").alias(f"d{k}") for k in range(DIGITS)))
    # Both sides are one plan, so its exchange is made once and reused.
    a, b = prefix.alias("a"), prefix.alias("b")
    smaller, larger = F.col("a.size"), F.col("b.size")
    ahead = (smaller < larger) | ((smaller == larger) & (F.col("a.num") < F.col("b.num")))
    within = manhattan("a", "b") <= (smaller + larger) * F.lit((1 - t) / (1 + t)) + F.lit(1e-9)
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & ahead & (smaller >= larger * F.lit(t) - F.lit(1e-9)) & within)
    pairs = shared_checkpoint(met.select(F.col("a.num").alias("x"), F.col("b.num").alias("y")).distinct())
    # Only sets that occur in a pair are moved; their numbers are broadcast up to BROADCAST_PAIRS, joined by shuffle beyond.
    asked = pairs.select(F.col("x").alias("num")).unionAll(pairs.select(F.col("y").alias("num"))).distinct()
    if pairs.count() <= BROADCAST_PAIRS:
        asked = F.broadcast(asked)
    sets = sets.select("num", "class_id", "hashes").join(asked, "num", "left_semi")
    first = sets.select(F.col("num").alias("x"), F.col("class_id").alias("class_a"), F.col("hashes").alias("ha"))
    second = sets.select(F.col("num").alias("y"), F.col("class_id").alias("class_b"), F.col("hashes").alias("hb"))
    both = pairs.join(first, "x").join(second, "y").withColumn("common", F.size(F.array_intersect("ha", "hb")))
    found = both.select("class_a", "class_b", (F.col("common") / (F.size("ha") + F.size("hb") - F.col("common"))).alias("similarity"))
    return found.filter(F.col("similarity") >= t - 1e-12)


def similar_pairs(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b`` of every two records of at least that similarity, the smaller key first."""
    members, sets = classes(df, key, text)
    members = shared_checkpoint(members.withColumnRenamed(key, "_k"))
    links = similar_classes(sets, similarity)
    left = members.select(F.col("_k").alias("x"), F.col("class_id").alias("class_a"))
    right = members.select(F.col("_k").alias("y"), F.col("class_id").alias("class_b"))
    across = links.join(left, "class_a").join(right, "class_b").select("x", "y")
    # Within a class only those with two members or more are joined.
    several = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class_id")
    twins = members.join(several, "class_id")
    same = twins.select("class_id", F.col("_k").alias("x")).join(twins.select("class_id", F.col("_k").alias("y")), "class_id")
    same = same.filter("x < y").select("x", "y")
    return across.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = read_table(spark, folder, "chunks", "chunk_id", "kind", "text").filter("kind = 'section'")
    pairs = similar_pairs(chunks, "chunk_id", "text")
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row a section chunk: its class and the number of other classes it is linked to.

    This is the form for groups of copies: a class counts once however many members it
    has. Texts without shingles are classes of equal texts (null: one class), with 0 links.
    """
    chunks = read_table(spark, folder, "chunks", "chunk_id", "kind", "text").filter("kind = 'section'")
    members, sets = classes(chunks, "chunk_id", "text")
    links = similar_classes(sets)
    ends = links.select(F.col("class_a").alias("class_id")).unionAll(links.select(F.col("class_b").alias("class_id")))
    linked = members.join(ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links")), "class_id", "left")
    short = chunks.filter(F.col("text").isNull() | (F.size(split_words(F.col("text"))) < WORDS))
    short = short.select("chunk_id", F.concat(F.lit("short:"), F.coalesce(F.sha2("text", 256), F.lit("null"))).alias("class_id")).distinct()
    return linked.select("chunk_id", "class_id", F.coalesce("links", F.lit(0)).alias("links")).unionByName(short.withColumn("links", F.lit(0).cast("bigint")))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes}
ORACLE = {
    "p2_found": r"""
        WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE kind = 'section' AND text IS NOT NULL),
        w AS (SELECT chunk_id, regexp_extract_all(lower(replace(text, 'İ', 'i' || chr(775))), '[\p{L}\p{Nd}]+') AS ws FROM c),
        s AS (SELECT DISTINCT chunk_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS g
              FROM (SELECT chunk_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
        n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
        o AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS common
              FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
        SELECT chunk_a, chunk_b FROM o JOIN n x ON x.chunk_id = chunk_a JOIN n y ON y.chunk_id = chunk_b
        WHERE common >= 0.60 * (x.n + y.n - common)""",
}
