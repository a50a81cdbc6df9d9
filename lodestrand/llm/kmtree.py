"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The top of the tree is fitted on a bounded sample and deals every vector to a bucket; below each bucket,
a task fits the rest of the tree on all of the bucket's vectors, down to leaves of a few. A query
goes down with a priority queue of the branches that it passes by, nearest first, and visits leaves until the
queue holds nothing nearer than its reach. The reach is a multiple of a bound on the distance
of the query's k-th neighbour, which the first leaves give; the multiple is widened until a sample of the queries,
whose true neighbours are found by brute force, reaches the wanted recall. What a task gives back is at
most k + 1 rows a query, none beyond the bound. Equal vectors are one class with its smallest ids, so copies
of a vector cost one row.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialise

#: Vectors the top is fitted on at most (in expectation), branches of a node, vectors of a leaf at most (but
#: for those that k-means can't part), vectors and bytes of a bucket on average, sample vectors of one at least.
FIT_ROWS, BRANCHES, LEAF_ROWS, BUCKET_ROWS, BUCKET_BYTES, LEAST_SAMPLE = 20_000, 16, 8, 8192, 16 << 20, 8
#: Leaves that are visited for the bound.
FIRST_LEAVES = 64
#: Calibration queries (in expectation) and the recall that they must reach.
CALIBRATION, RECALL = 256, 0.94
#: Queries that meet a bucket in one task.
QUERY_ROWS = 1024
#: Rounds of k-means; vectors of a node that k-means looks at for each centre.
ROUNDS, POINTS_A_CENTRE = 6, 64

VECTORS = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary())])
FOUND = "query long, vec_id long, score double"


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, vec): vectors in double precision, as bytes.

    Null ids, null or zero vectors, and those with null or non-finite components take no part.
    """
    bounded_batches(table.sparkSession)
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            whole = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            bad, some = np.concatenate([[0], np.cumsum(~np.isfinite(whole))]), np.concatenate([[0], np.cumsum(whole != 0)])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            good = (bad[ends] == bad[starts]) & (some[ends] > some[starts])
            cut = [whole[a:b].tobytes() for a, b in zip(starts[good].tolist(), ends[good].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), pa.array(cut, pa.binary())], schema=VECTORS)

    return rows.mapInArrow(run, "vec_id long, vec binary").withColumn("dim", (F.octet_length("vec") / 8).cast("int"))


def matrix(vectors: pa.Array | list[bytes]) -> np.ndarray:
    data = vectors if isinstance(vectors, list) else vectors.to_pylist()
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences themselves."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 20) // max(1, b.size))
    for at in range(0, len(a), step):
        d = a[at : at + step, None, :] - b[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the product, good enough to choose a branch."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    if len(points) > k * POINTS_A_CENTRE:
        points = points[rng.choice(len(points), k * POINTS_A_CENTRE, replace=False)]
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        nearest = _squared(points, centres).argmin(1)
        used, nearest, count = np.unique(nearest, return_inverse=True, return_counts=True)
        sums = np.zeros((len(used), points.shape[1]))
        np.add.at(sums, nearest, points)
        centres = sums / count[:, None]
    return centres


@dataclass
class Tree:
    """A k-means tree over points: nodes in arrays, parents before children, the root first.

    first[n], last[n]: the node's children (a run of numbers), or for a leaf, where `is_leaf`, the run of `order`
    that names its points.
    """

    centres: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    last: np.ndarray
    is_leaf: np.ndarray
    order: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, leaf_rows: int, branches: int = BRANCHES, seed: int = 5) -> Tree:
        rng = np.random.default_rng(seed)
        centres, parent, first, last, is_leaf = [points.mean(0) if len(points) else np.zeros(points.shape[1])], [-1], [0], [0], [True]
        order: list[np.ndarray] = []
        placed, todo, at = 0, [(0, np.arange(len(points)))], 0
        while at < len(todo):
            node, mine = todo[at]
            todo[at] = None
            at += 1
            parts = None
            if len(mine) > leaf_rows:
                own = points[mine]
                found = kmeans(own, min(branches, max(2, math.ceil(len(mine) / leaf_rows))), rng)
                nearest = _squared(own, found).argmin(1)
                parts = [(found[c], mine[nearest == c]) for c in np.unique(nearest)]
            if parts is None or len(parts) == 1:
                order.append(mine)
                first[node], last[node] = placed, placed + len(mine)
                placed += len(mine)
                continue
            is_leaf[node] = False
            first[node] = len(centres)
            for centre, part in parts:
                todo.append((len(centres), part))
                centres.append(centre)
                parent.append(node)
                first.append(0)
                last.append(0)
                is_leaf.append(True)
            last[node] = len(centres)
        # Leaves of one level follow those of the level above, each leaf's points lie together.
        return cls(np.stack(centres), np.array(parent), np.array(first), np.array(last), np.array(is_leaf), np.concatenate(order).astype(np.int64))

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf (as a node) of each point, by the nearest branch at every node."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if self.is_leaf[node]:
                out[at] = node
            elif len(at):
                a, b = self.first[node], self.last[node]
                nearest = _squared(points[at], self.centres[a:b]).argmin(1)
                todo.extend((a + c, at[nearest == c]) for c in range(b - a))
        return out

    def visit(self, to_centres: np.ndarray) -> Iterator[tuple[float, int]]:
        """(priority, leaf) by best bin first, for squared distances to all centres.

        A branch's priority is the larger of its own distance and that of the branch above it, so
        priorities only grow, and the queue may be left at any of them.
        """
        first, last, is_leaf = self.first, self.last, self.is_leaf
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue:
            priority, node = heapq.heappop(queue)
            if is_leaf[node]:
                yield priority, node
                continue
            for child, d in enumerate(to_centres[first[node] : last[node]].tolist(), int(first[node])):
                heapq.heappush(queue, (d if d > priority else priority, child))

    def priorities(self, to_centres: np.ndarray) -> np.ndarray:
        """The priority of every node for every point (rows of squared distances to all centres)."""
        out = to_centres.copy()
        out[:, 0] = 0
        for node in range(1, len(self.parent)):
            np.maximum(out[:, node], out[:, self.parent[node]], out=out[:, node])
        return out

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, **vars(self))
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as held:
            return cls(**dict(held))


@dataclass
class Bucket:
    """A bucket's part of the index: its tree, its vectors and their ids, in the order of the leaves."""

    tree: Tree
    vectors: np.ndarray
    ids: list[list[int]]

    @classmethod
    def of(cls, row: dict) -> Bucket:
        tree = Tree.from_bytes(row["tree"])
        return cls(tree, np.frombuffer(row["vectors"], "<f8").reshape(-1, tree.centres.shape[1]), row["ids"])

    def near(self, query: np.ndarray, leaves: list[int], bound: float, most: int) -> list[tuple[int, float]]:
        """(id, distance) of the `most` nearest ids of some leaves, none beyond the bound; ties by smaller id."""
        spans = [(int(self.tree.first[x]), int(self.tree.last[x])) for x in leaves]
        rows = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.int64)
        if not len(rows):
            return []
        d = distances(query[None, :], self.vectors[rows])[0]
        if len(d) > most:
            bound = min(bound, np.partition(d, most - 1)[most - 1])
        found = [(float(d[x]), i) for x in np.flatnonzero(d <= bound) for i in self.ids[rows[x]]]
        return [(i, s) for s, i in sorted(found)[:most]]


def _share(n: int, wanted: int) -> int:
    """Of 2^20 hash values, how many give `wanted` of n rows."""
    return 1 << 20 if n <= wanted else math.ceil((1 << 20) * wanted / n)


def search(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id `every` divides.

    Scores are Euclidean distances in double precision on the original vectors; ties go to the smaller
    id; a row is never its own neighbour. Rows that repeat an id and vector count once. Only vectors of
    the same length have a distance. Fewer than k candidates give fewer rows; without usable vectors
    the result is empty.
    """
    spark = table.sparkSession
    vectors = materialise(usable(table, id_col, vec_col), "vectors")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for row in vectors.select("dim").distinct().orderBy("dim").collect():  # the lengths of vectors are few
        out = out.unionByName(_search(vectors.filter(F.col("dim") == row["dim"]).drop("dim"), row["dim"], k, every, recall))
    return out


def _search(vectors: DataFrame, dim: int, k: int, every: int, recall: float) -> DataFrame:
    most = k + 1
    index = Index.build(vectors, dim, most)
    queries = vectors.filter(F.col("vec_id") % every == 0).distinct()
    asked = materialise(queries.select("vec").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    factor, _ = index.calibrate(asked, k, recall)
    found = index.nearest(asked, factor)
    mine = queries.join(asked, "vec").select(F.col("vec_id").alias("query_id"), "query")
    out = mine.join(found, "query").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@dataclass
class Index:
    """The written index: `parts` has a row for each bucket (and block of a large one), `top` deals them out."""

    parts: DataFrame  # bucket, block, n_ids, tree, vectors, ids
    top: Tree
    sizes: dict[int, int]  # ids of each bucket; buckets are bounded by FIT_ROWS over LEAST_SAMPLE
    classes: int
    most: int

    @classmethod
    def build(cls, vectors: DataFrame, dim: int, most: int) -> Index:
        """Put every vector (vec_id, vec) into the index; of equal vectors the `most` smallest ids."""
        spark = vectors.sparkSession
        # The limit is taken before rows are dealt out.
        small = Window.partitionBy("vec").orderBy("vec_id")
        limited = vectors.distinct().withColumn("n", F.row_number().over(small)).filter(F.col("n") <= most)
        classes = materialise(limited.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
        n = classes.count()
        hashed = F.pmod(F.xxhash64("vec"), F.lit(1 << 20))
        sample = classes.filter(hashed < _share(n, FIT_ROWS)).orderBy("vec").select("vec").toArrow()
        points = matrix(sample.column("vec").combine_chunks()) if sample.num_rows else np.zeros((0, dim))
        bucket_rows = max(1, min(BUCKET_ROWS, BUCKET_BYTES // (8 * dim)))
        top = Tree.fit(points, max(LEAST_SAMPLE, round(bucket_rows * len(points) / n)))
        dealt = spark.sparkContext.broadcast(top)

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dealt.value.assign(matrix(batch.column("vec"))))], names=[*batch.schema.names, "bucket"])

        placed = materialise(classes.mapInArrow(put, "vec binary, ids array<long>, bucket long"), "placed")
        # Where the sample was too small for buckets of the wanted size, each is cut into blocks with a tree each.
        blocks = placed.groupBy("bucket").agg(F.ceil(F.count("*") / (2 * bucket_rows)).cast("int").alias("blocks"))
        cut = {r["bucket"]: r["blocks"] for r in blocks.filter("blocks > 1").collect()}
        block = F.lit(0)
        if cut:
            count = F.element_at(F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]), F.col("bucket").cast("int"))
            block = F.pmod(F.xxhash64("vec"), F.coalesce(count, F.lit(1))).cast("int")
        parts = placed.withColumn("block", block).groupBy("bucket", "block").applyInArrow(_grow, "bucket long, block int, n_ids long, tree binary, vectors binary, ids array<array<bigint>>")
        parts = materialise(parts, "index")
        sizes = {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}
        discard(placed)
        return cls(parts, top, sizes, n, most)

    def nearest(self, asked: DataFrame, factor: float) -> DataFrame:
        """(query, vec_id, score): the `most` nearest found for rows of (query, vec)."""
        first = materialise(self._first(asked), "first-neighbours")
        bound = first.groupBy("query").agg(F.when(F.count("*") >= self.most, F.max("score")).alias("bound"))
        bounded = asked.join(bound, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        more = self._meet(self._routed(bounded, factor), factor)
        return self._best(first.unionByName(more).distinct())

    def _best(self, found: DataFrame) -> DataFrame:
        best = Window.partitionBy("query").orderBy("score", "vec_id")
        return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= self.most).drop("n")

    def _first(self, asked: DataFrame) -> DataFrame:
        """The `most` nearest of the first leaves: those of the nearest buckets that have enough ids."""
        return self._best(self._meet(self._routed(asked.withColumn("bound", F.lit(None).cast("double")), 0.0), None))

    def _routed(self, asked: DataFrame, factor: float) -> DataFrame:
        """(bucket, query, vec, bound, above): where each query goes; above: the bucket's own priority.

        Without a bound, to the nearest buckets until they have enough ids; with one, to those within reach.
        """
        top, sizes, most = asked.sparkSession.sparkContext.broadcast(self.top), self.sizes, self.most
        names = ["bucket", "query", "vec", "bound", "above"]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows: list[tuple] = []
                columns = [batch.column(c).to_pylist() for c in ("query", "vec", "bound")]
                for query, vec, bound, to_centres in zip(*columns, _squared(matrix(columns[1]), top.value.centres), strict=True):
                    ids = 0
                    for above, bucket in top.value.visit(to_centres):
                        if (ids >= most) if bound is None else (above > factor * bound * bound):
                            break
                        if bucket in sizes:
                            ids += sizes[bucket]
                            rows.append((bucket, query, vec, bound, above))
                    if len(rows) > 4096:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

        return asked.select("query", "vec", "bound").mapInArrow(route, "bucket long, query long, vec binary, bound double, above double")

    def _meet(self, routed: DataFrame, factor: float | None) -> DataFrame:
        """Queries and buckets in one equality join; a bucket that many queries visit is there once for each QUERY_ROWS."""
        routed = materialise(routed, "routed")
        visits = routed.groupBy("bucket").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("salts"))
        # One row a bucket.
        parts = self.parts.join(F.broadcast(visits), "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        spread = F.pmod(F.xxhash64("query"), F.col("salts")).cast("int")
        blocks = self.parts.groupBy("bucket").agg(F.collect_list("block").alias("blocks"))
        routed = routed.join(F.broadcast(visits), "bucket").join(F.broadcast(blocks), "bucket").withColumn("salt", spread).withColumn("block", F.explode("blocks"))
        keys = ["bucket", "block", "salt"]
        left = routed.select(*keys, "query", "vec", "bound", "above").groupBy(*keys)
        right = parts.select(*keys, "tree", "vectors", "ids").groupBy(*keys)
        return left.cogroup(right).applyInArrow(_meeting(self.most, factor), FOUND)

    def calibrate(self, queries: DataFrame, k: int, recall: float) -> tuple[float, float]:
        """(factor, share): the least multiple of the squared bound within which queries find the wanted share of
        their true neighbours, and the share of all vectors that they are then compared with.

        A sample of the queries (query, vec), CALIBRATION in expectation, is compared with all vectors by brute force.
        """
        most, spark = self.most, self.parts.sparkSession
        hashed = F.pmod(F.xxhash64(F.lit("calibration"), "vec"), F.lit(1 << 20))
        chosen = materialise(queries.filter(hashed < _share(queries.count(), CALIBRATION)).select("query", "vec"), "calibration")
        first = materialise(self._first(chosen), "calibration-first")
        bound = first.groupBy("query").agg(F.when(F.count("*") >= most, F.max("score")).alias("bound"))
        asked = chosen.join(bound, "query").filter(F.col("bound") > 0).orderBy("query").collect()
        if not asked:
            return math.inf, 1.0
        place = {r["query"]: q for q, r in enumerate(asked)}
        # What the first leaves have is found whatever the reach.
        early = {(place[r["query"]], r["vec_id"]) for r in first.collect() if r["query"] in place}
        points, bounds = matrix([bytes(r["vec"]) for r in asked]), np.array([r["bound"] for r in asked])
        above = self.top.priorities(_squared(points, self.top.centres))
        held = spark.sparkContext.broadcast((points, bounds, above))
        grid = np.linspace(0, 3, 601)

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points, bounds, above = held.value
            for batch in batches:
                for row in batch.to_pylist():
                    part = Bucket.of(row)
                    nodes = np.flatnonzero(part.tree.is_leaf)
                    size = part.tree.last[nodes] - part.tree.first[nodes]
                    priority = np.maximum(part.tree.priorities(_squared(points, part.tree.centres)), above[:, [row["bucket"]]])[:, nodes]
                    need = priority / (bounds * bounds)[:, None]
                    leaf = np.repeat(np.arange(len(nodes)), size)
                    at = np.concatenate([np.arange(a, b) for a, b in zip(part.tree.first[nodes], part.tree.last[nodes], strict=True)])
                    seen = [float((size * (need <= g)).sum()) for g in grid]
                    rows = [(-1, 0.0, 0.0, 0, seen)]
                    for q, d in enumerate(distances(points, part.vectors[at])):
                        d[d == 0] = np.inf  # the query itself
                        near = np.argpartition(d, min(k, len(d)) - 1)[:k]
                        rows.extend((q, float(d[x]), float(need[q, leaf[x]]), part.ids[at[x]][0], None) for x in near if np.isfinite(d[x]))
                    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["q", "d", "need", "vec_id", "seen"])

        told = materialise(self.parts.mapInArrow(brute, "q long, d double, need double, vec_id long, seen array<double>"), "calibrated")
        best = Window.partitionBy("q").orderBy("d", "vec_id")
        truth = told.filter("q >= 0").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
        need = np.sort([0.0 if (r["q"], r["vec_id"]) in early else r["need"] for r in truth.select("q", "need", "vec_id").collect()])
        if not len(need):
            return math.inf, 1.0
        factor = float(need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)])  # widened until enough are in reach
        cell = int(np.searchsorted(grid, factor))
        seen = told.filter("q < 0").agg(F.sum(F.get("seen", F.lit(min(cell, len(grid) - 1))))).first()[0]
        return factor, min(1.0, seen / len(points) / self.classes) if cell < len(grid) else 1.0


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "query": pa.int64(), "vec": pa.binary(), "bound": pa.float64(), "above": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)


def _grow(key, table):
    """The index row of one bucket's block."""
    vectors = matrix(table.column("vec").to_pylist())
    # By content, so that a repeated task grows the same tree.
    given = np.lexsort(vectors.T[::-1])
    tree = Tree.fit(vectors[given], LEAF_ROWS)
    order = given[tree.order]
    ids = table.column("ids").to_pylist()
    ids = [ids[i] for i in order.tolist()]
    tree.order = np.zeros(0, np.int64)  # what it says is now the order of the rows
    return pa.table(
        [pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([sum(map(len, ids))], pa.int64()), pa.array([tree.to_bytes()], pa.binary()), pa.array([vectors[order].tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.list_(pa.int64())))],
        names=["bucket", "block", "n_ids", "tree", "vectors", "ids"],
    )


def _meeting(most: int, factor: float | None):
    """What a bucket has for the queries that visit it: of its first leaves, or of all within reach."""

    def run(left, right):
        rows = []
        if left.num_rows and right.num_rows:
            part = Bucket.of(right.to_pylist()[0])
            points = matrix(left.column("vec").to_pylist())
            columns = [left.column(c).to_pylist() for c in ("query", "bound", "above")]
            for point, to_centres, query, bound, above in zip(points, _squared(points, part.tree.centres), *columns, strict=True):
                leaves: list[int] = []
                ids = 0
                for priority, leaf in part.tree.visit(to_centres):
                    if factor is None:
                        if len(leaves) >= FIRST_LEAVES and ids >= most:
                            break
                    elif max(priority, above) > factor * bound * bound:
                        break
                    leaves.append(leaf)
                    ids += int(part.tree.last[leaf] - part.tree.first[leaf])
                rows.extend((query, i, s) for i, s in part.near(point, leaves, math.inf if bound is None else bound, most))
        columns = zip(*rows, strict=True) if rows else [[], [], []]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "vec_id", "score"])

    return run
