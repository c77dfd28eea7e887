"""Problem 1: the k most similar vectors of every vector.

Method: a forest of random-projection trees, searched through one priority queue
shared by all trees, then exact ranking of the leaves' candidates.

* A tree splits by the hyperplane between two random sample points at the median
  projection. Depth follows the number of vectors, so that a leaf holds some
  ``LEAF_ROWS`` of them at any size; every row is indexed and every row searched.
  The first ``TOP_DEPTH`` levels are fitted on a bounded sample (``SAMPLE_ROWS``)
  and broadcast (``TREES * 2**TOP_DEPTH`` hyperplanes, 1 MB a tree). Deeper levels
  are subtrees of ``STEP_DEPTH`` levels, each fitted on a bounded sample of the rows
  of its own node and kept as a table; rows meet their subtrees in a stream sorted
  by node, so that no task holds a node's rows, and go on in the same queue.
* The priority of a leaf is the least signed margin on its path. It never rises
  downwards, so keeping the best ``LEAVES`` nodes over all trees at each level
  gives the leaves that a best-first queue would pop, for a whole batch at once.
* A row is a point of its own leaf in each tree and a query in its other leaves.
  Rows travel as 16-bit integers; a leaf ranks its candidates by their exact
  integer product. Where the cut after k, the least cosine or a tie lies within
  the rounding of that form, the pairs are ranked anew from the full vectors.

Vectors of one direction form a class, searched once and expanded afterwards
with at most k + 1 of its smallest keys, so a group of copies is never compared
with itself.

Defined cases: vectors that are null, of another length, all zero or not finite
take no part; copies of a row count once; ties go to the smaller key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.sources.tables import read_table, shared_checkpoint

TREES = 4
#: Leaves searched for one vector, over all trees (its own leaf of each tree included).
LEAVES = 16
LEAF_ROWS = 256
SAMPLE_ROWS = 32_768
TOP_DEPTH = 12
STEP_DEPTH = 8
#: Sample rows of a node's own subtree, for each of its leaves.
FIT_ROWS = 32
TASK_BYTES = 8 << 20
#: Cosines of the 16-bit form differ by less than this from the exact ones (some 4e-6 as a rule).
SLACK = 5e-5


def usable(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``id, direction, vec``: usable vectors as bytes and a hash of their direction."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("e"))
    rows = rows.filter(F.size("e") == dims)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for frame in frames:
            lists = frame.column(1)
            flat = lists.flatten()
            values = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dims)
            length = np.linalg.norm(values.astype(np.float64), axis=1)
            ok = np.isfinite(length) & (length > 0)
            values, length = values[ok], length[ok]
            turned = np.rint(values / length[:, None] * 1e6).astype(np.int32)
            hashes = [xxhash.xxh64_intdigest(r.tobytes()) - (1 << 63) for r in turned]
            yield pa.RecordBatch.from_arrays(
                [frame.column(0).filter(pa.array(ok)), pa.array(hashes, pa.int64()), pa.array([r.tobytes() for r in values], pa.binary())],
                ["id", "direction", "vec"],
            )

    return rows.mapInArrow(batches, "id string, direction bigint, vec binary")


class Forest:
    """Hyperplanes of all trees in one matrix, laid out level by level."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.depth, self.trees, self.nodes = depth, trees, 2**depth - 1
        self.normals = np.zeros((trees * self.nodes, dims), np.float32)
        self.cuts = np.zeros(trees * self.nodes, np.float32)
        for tree in range(trees):
            parts = [np.arange(len(sample))]
            for level in range(depth):
                halves = []
                for k, part in enumerate(parts):
                    normal = np.zeros(dims, np.float32)
                    if len(part) > 1:
                        i, j = rng.choice(part, 2, replace=False)
                        normal = sample[i] - sample[j]
                    size = np.linalg.norm(normal)
                    if size < 1e-6:
                        normal = rng.standard_normal(dims).astype(np.float32)
                        size = np.linalg.norm(normal)
                    normal = normal / size
                    at = sample[part] @ normal
                    cut = np.median(at) if len(part) else 0.0
                    node = tree * self.nodes + 2**level - 1 + k
                    self.normals[node], self.cuts[node] = normal, cut
                    halves += [part[at < cut], part[at >= cut]]
                parts = halves

    @classmethod
    def of(cls, raw: bytes, depth: int, dims: int) -> Forest:
        """One tree from ``packed``."""
        tree = cls.__new__(cls)
        tree.depth, tree.trees, tree.nodes = depth, 1, 2**depth - 1
        table = np.frombuffer(raw, np.float32).reshape(tree.nodes, dims + 1)
        tree.normals, tree.cuts = table[:, :dims], table[:, dims]
        return tree

    def packed(self) -> bytes:
        return np.concatenate([self.normals, self.cuts[:, None]], 1).astype(np.float32).tobytes()

    def leaves(self, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaf numbers and priorities of the best ``most`` leaves over all trees, own leaves with priority 0."""
        tree = np.tile(np.arange(self.trees), (len(rows), 1))
        place = np.zeros_like(tree)
        priority = np.zeros(tree.shape, np.float32)
        for level in range(self.depth):
            node = tree * self.nodes + 2**level - 1 + place
            margin = np.einsum("bpk,bk->bp", self.normals[node], rows) - self.cuts[node]
            below = np.minimum(np.concatenate([np.minimum(priority, -margin), np.minimum(priority, margin)], 1), 0)
            # A row on the plane goes right only: its priority on the left is the least one under 0.
            below[:, : margin.shape[1]][margin == 0] = np.minimum(below[:, : margin.shape[1]][margin == 0], np.float32(-1e-30))
            place = np.concatenate([2 * place, 2 * place + 1], 1)
            tree = np.concatenate([tree, tree], 1)
            if below.shape[1] > most:
                best = np.argpartition(-below, most - 1, axis=1)[:, :most]
                below, place, tree = (np.take_along_axis(x, best, 1) for x in (below, place, tree))
            priority = below
        return tree * 2**self.depth + place, priority


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


def _short(unit: np.ndarray, kind: type) -> tuple[np.ndarray, pa.Array]:
    """Scale and bytes of unit vectors in small integers."""
    scale = np.abs(unit).max(1).astype(np.float64) / np.iinfo(kind).max
    return scale, pa.array([r.tobytes() for r in np.rint(unit / scale[:, None]).astype(kind)], pa.binary())


def index(
    classes: DataFrame, count: int, dims: int, *, trees: int = TREES, leaves: int = LEAVES, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """``leaf, own, id, many, scale, q`` of ``id, vec, many``: each row in its own leaf of every tree and the others it is searched in.

    A node's number is ``trees`` times its place in heap order, plus its tree; so it tells the depth as well.
    """
    spark = classes.sparkSession
    depth = max(0, math.ceil(math.log2(max(1, count) / leaf_rows)))
    top = min(TOP_DEPTH, depth)
    most = max(leaves, trees)
    # Rows whose hash falls under SAMPLE_ROWS / count: that many on average, whatever the number of partitions.
    share = min(1.0, SAMPLE_ROWS / max(1, count))
    sample = classes.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "vec").toPandas()
    sample = sample.sort_values("id", ignore_index=True)["vec"]
    points = _unit(np.frombuffer(b"".join(map(bytes, sample)), np.float32).reshape(-1, dims)) if len(sample) else np.zeros((0, dims), np.float32)
    forest = spark.sparkContext.broadcast(Forest(points, top, trees))

    def assigned(kind: type, wide: int):
        """Rows in the best ``wide`` nodes of the broadcast levels, vectors in small integers."""

        def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            woods = forest.value
            for frame in frames:
                for start in range(0, frame.num_rows, 2000):
                    part = frame.slice(start, 2000)
                    unit = _unit(_vectors(part.column(1), dims))
                    at, priority = woods.leaves(unit, wide)
                    tree, place = at >> woods.depth, at & (2**woods.depth - 1)
                    yield _rows(part, unit, (2**woods.depth + place) * trees + tree, priority, kind)

        return batches

    def _rows(part: pa.RecordBatch, unit: np.ndarray, node: np.ndarray, priority: np.ndarray, kind: type) -> pa.RecordBatch:
        scale, packed = _short(unit, kind)
        take = pa.array(np.repeat(np.arange(len(unit)), node.shape[1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(node.ravel().astype(np.int64)), pa.array(priority.ravel().astype(np.float32)), part.column(0).take(take),
             part.column(2).take(take), pa.array(scale).take(take), packed.take(take)],
            ["leaf", "priority", "id", "many", "scale", "q"],
        )

    schema = "leaf bigint, priority float, id string, many boolean, scale double, q binary"
    source = classes.select("id", "vec", "many")
    finish = source.mapInArrow(assigned(np.int16, most), schema)
    models: list[tuple[int, DataFrame]] = []
    while top + sum(step for step, _ in models) < depth:
        at = top + sum(step for step, _ in models)
        step = min(STEP_DEPTH, depth - at)
        rate = min(1.0, FIT_ROWS * 2.0 ** (at + step) / count)
        drawn = source.filter(F.pmod(F.xxhash64("id", F.lit(at)), F.lit(1 << 30)) < int(rate * (1 << 30)))
        own = _deepened(drawn.mapInArrow(assigned(np.int8, trees), schema), models, dims, trees, count, only_own=True)
        models.append((step, shared_checkpoint(_subtrees(own, step, dims))))
    if models:
        # What travels to the subtrees is small; the 16-bit vectors join the chosen leaves afterwards.
        met = _deepened(source.mapInArrow(assigned(np.int8, most), schema), models, dims, trees, count, leaves=most)
        chosen = met.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("priority", "leaf")), asc=False), 1, most).alias("c"))

        def given(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                unit = _unit(_vectors(frame.column(1), dims))
                sizes = np.diff(frame.column(3).offsets.to_numpy())
                scale, packed = _short(unit, np.int16)
                take = pa.array(np.repeat(np.arange(len(unit)), sizes))
                flat = frame.column(3).flatten()
                yield pa.RecordBatch.from_arrays(
                    [flat.field("leaf"), flat.field("priority"), frame.column(0).take(take), frame.column(2).take(take), pa.array(scale).take(take), packed.take(take)],
                    ["leaf", "priority", "id", "many", "scale", "q"],
                )

        finish = source.join(chosen, "id").select("id", "vec", "many", "c").mapInArrow(given, schema)
    return finish.select("leaf", (F.col("priority") == 0).alias("own"), "id", "many", "scale", "q")


def _subtrees(own: DataFrame, step: int, dims: int) -> DataFrame:
    """``leaf, model``: a subtree for each node, fitted on the sampled rows of its own (a bounded number, see FIT_ROWS)."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        rows = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(-1, dims) * table.column("scale").to_numpy()[:, None]
        leaf = table.column("leaf")[0].as_py()
        model = Forest(rows.astype(np.float32), step, 1, seed=leaf).packed()
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "model": pa.array([model], pa.binary())})

    return own.groupBy("leaf").applyInArrow(fit, "leaf bigint, model binary")


def _deepened(
    rows: DataFrame, models: list[tuple[int, DataFrame]], dims: int, trees: int, count: int, *, only_own: bool = False, leaves: int = LEAVES
) -> DataFrame:
    """Rows in nodes below, by the subtrees in ``models``; of each node its best few, own nodes more than others."""
    wide = 1 if only_own else max(1, leaves // 2)
    narrow = 1 if only_own else max(1, leaves // 4)
    for step, table in models:

        def down(frames: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            node, tree = None, None
            for frame in frames:
                nodes = frame.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(nodes)) + 1), frame.num_rows]
                for a, b in zip(edges, edges[1:]):
                    if nodes[a] != node:
                        node, tree = nodes[a], None
                    # A node's subtree comes before its rows.
                    if (raw := frame.column(6)[a].as_py()) is not None:
                        tree, a = Forest.of(raw, step, dims), a + 1
                    if a == b:
                        continue
                    part = frame.slice(a, b - a)
                    unit = np.frombuffer(b"".join(part.column(5).to_pylist()), np.int8).reshape(-1, dims) * part.column(4).to_numpy()[:, None]
                    before = part.column(1).to_numpy()
                    if tree is None:
                        place, priority = np.zeros((len(unit), 1), int), np.zeros((len(unit), 1), np.float32)
                    else:
                        place, priority = tree.leaves(unit.astype(np.float32), min(wide, 2**step))
                    priority = np.minimum(priority, before[:, None])
                    order = np.argsort(-priority, axis=1, kind="stable")
                    place, priority = np.take_along_axis(place, order, 1), np.take_along_axis(priority, order, 1)
                    heap, number = divmod(int(node), trees)
                    kept = np.arange(place.shape[1])[None, :] < np.where(before == 0, wide, narrow)[:, None]
                    take = pa.array(np.nonzero(kept)[0])
                    below = (heap * 2**step + place[kept]) * trees + number
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(below.astype(np.int64)), pa.array(priority[kept].astype(np.float32)), *(part.column(c).take(take) for c in (2, 3, 4, 5))],
                        ["leaf", "priority", "id", "many", "scale", "q"],
                    )

        tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count * leaves * (dims + 72) / TASK_BYTES / 4))
        both = rows.withColumn("model", F.lit(None).cast("binary")).unionByName(table, allowMissingColumns=True)
        both = both.withColumn("k", F.col("model").isNull()).repartition(tasks, "leaf").sortWithinPartitions("leaf", "k").drop("k")
        rows = both.mapInArrow(down, "leaf bigint, priority float, id string, many boolean, scale double, q binary")
    return rows


def nearest(
    df: DataFrame, key: str, vector: str, *, dims: int, k: int = 5, min_cosine: float = -1.0,
    trees: int = TREES, leaves: int = LEAVES, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``id, neighbour``: the k nearest others of every usable vector with a cosine of at least ``min_cosine``."""
    spark = df.sparkSession
    rows = usable(df, key, vector, dims)
    members = shared_checkpoint(rows.select("id", "direction").distinct())
    classes = rows.groupBy("direction").agg(F.min("id").alias("id"), F.min_by("vec", "id").alias("vec"), F.min("id") != F.max("id"))
    classes = shared_checkpoint(classes.toDF("direction", "id", "vec", "many"))
    count = classes.count()
    spread = index(classes, count, dims, trees=trees, leaves=leaves, leaf_rows=leaf_rows)

    def search(table: pa.Table) -> pa.Table:
        ids, many = table.column("id").combine_chunks(), table.column("many").to_numpy(zero_copy_only=False)
        q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int16).reshape(-1, dims).astype(np.float64)
        scale = table.column("scale").to_numpy()
        own = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False))
        points, weights = q[own].T.copy(), scale[own]
        xs, ys, sims = [], [], []
        for start in range(0, len(q) if len(own) else 0, 512):
            block = (q[start : start + 512] @ points) * scale[start : start + 512, None] * weights[None, :]
            mine = np.arange(start, start + len(block))
            block[mine[:, None] == own[None, :]] = -2
            floor = np.full(len(block), min_cosine - SLACK)
            if block.shape[1] > k:
                kth = -np.partition(-block, k - 1, axis=1)[:, k - 1]
                floor = np.maximum(floor, kth - 2 * SLACK)
            r, c = np.nonzero((block >= floor[:, None]) & (block > -1.5))
            xs.append(mine[r]), ys.append(own[c]), sims.append(block[r, c])
        x = np.concatenate(xs) if xs else np.zeros(0, int)
        y = np.concatenate(ys) if ys else np.zeros(0, int)
        s = np.concatenate(sims) if sims else np.zeros(0)
        return pa.table({"x": ids.take(pa.array(x)), "y": ids.take(pa.array(y)), "sim": pa.array(s, pa.float64()), "many": pa.array((many[x] | many[y]).astype(bool))})

    # Tasks of a bounded size, however many partitions the session asks for.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count * max(leaves, trees) * (2 * dims + 72) / TASK_BYTES))
    met = spread.repartition(tasks, "leaf").groupBy("leaf").applyInArrow(search, "x string, y string, sim double, many boolean")
    # At most (k + ties) rows a leaf and LEAVES leaves meet in one list.
    best = met.groupBy("x").agg(F.sort_array(F.collect_set(F.struct("sim", "y", "many")), asc=False).alias("c"))
    last = F.coalesce(F.get("c", F.lit(k - 1))["sim"], F.lit(-2.0))
    best = best.withColumn("c", F.filter("c", lambda e: e["sim"] >= last - 2 * SLACK))
    unsure = (F.size("c") > k) | F.exists("c", lambda e: e["many"] | (F.abs(e["sim"] - min_cosine) <= SLACK))
    best = shared_checkpoint(best.withColumn("unsure", unsure))
    settled = best.filter(~F.col("unsure")).select(F.col("x").alias("id"), F.explode("c.y").alias("neighbour"))

    # Exact ranking where the short form leaves the order open, and for classes of several members.
    open_pairs = best.filter("unsure").select("x", F.explode("c.y").alias("y"))
    vx = classes.select(F.col("id").alias("x"), F.col("vec").alias("vx"))
    vy = classes.select(F.col("id").alias("y"), F.col("vec").alias("vy"))

    def exact(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            a, b = (_vectors(frame.column(i), dims).astype(np.float64) for i in (2, 3))
            cos = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(np.round(cos, 9))], ["x", "y", "cos"])

    ranked = open_pairs.join(vx, "x").join(vy, "y").select("x", "y", "vx", "vy").mapInArrow(exact, "x string, y string, cos double")
    order = Window.partitionBy("direction").orderBy("id")
    few = members.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    few = few.groupBy("direction").agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids"))
    others = ranked.join(few.select(F.col("rep").alias("y"), "ids"), "y").select("x", F.explode("ids").alias("n"), "cos")
    several = few.filter(F.size("ids") > 1)
    inside = several.select(F.col("rep").alias("x"), F.explode("ids").alias("n"), F.lit(1.0).alias("cos"))
    lists = others.unionByName(inside).filter(F.col("cos") >= min_cosine).groupBy("x").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("d"), F.col("n")))).alias("c")
    )
    asked = members.join(classes.select("direction", F.col("id").alias("x")), "direction").join(lists, "x")
    opened = asked.select("id", F.explode(F.slice(F.filter("c.n", lambda n: n != F.col("id")), 1, k)).alias("neighbour"))
    return settled.unionByName(opened)


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "chunks", "chunk_id", "embedding")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = nearest(_chunks(spark, folder), "chunk_id", "embedding", dims=64, k=5, min_cosine=0.85)
    return pairs.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


QUERIES = {"p1_found": p1_found}
ORACLE: dict[str, str] = {}
