"""Approximate nearest neighbours by inner product, in a hierarchical k-means tree.

Vectors get one more component that makes all of them as long as the longest; the nearest
by distance to a query (with 0 there) are then those of largest inner product. The tree is
fitted to a bounded sample, every row is indexed by descending it, and a query descends
best-bin-first: a priority queue over all branches passed by hands out leaves, nearest
first. How many leaves are visited is widened until queries of the sample, against brute
force over all rows, reach the wanted recall.

Leaves are packed in blocks of bounded size, so a crowded leaf is several tasks' work.
Equal vectors are one candidate with its smallest ids, and equal queries search once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.session import cut

#: Vectors the tree is fitted to, children of a node, sample vectors in a leaf, and the
#: number of queries that the visits are calibrated with.
SAMPLE, BRANCHES, LEAF, PROBES = 8192, 8, 32, 64
RECALL, BLOCK_ROWS, QUERY_ROWS = 0.97, 4096, 256
_FOUND = "query_id long, rank int, vec_id long, score double"


@dataclass
class Tree:
    """Node centres by number; children of inner nodes; leaves in order of number."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: dict[int, np.ndarray] = field(default_factory=dict)
    leaf_of: dict[int, int] = field(default_factory=dict)
    longest: float = 0.0

    @classmethod
    def fit(cls, points: np.ndarray, longest: float, seed: int = 5) -> Tree:
        tree, rng = cls(longest=longest), np.random.default_rng(seed)
        tree.centres.append(points.mean(axis=0))
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            parts = _kmeans(own, BRANCHES, rng) if len(own) > LEAF else None
            if parts is None:
                tree.leaf_of[node] = len(tree.leaf_of)
                continue
            numbers = []
            for centre, some in parts:
                numbers.append(len(tree.centres))
                tree.centres.append(centre)
                todo.append((numbers[-1], some))
            tree.children[node] = np.array(numbers)
        return tree

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """With the component that makes all as long as the longest."""
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))
        return np.hstack([vectors, rest[:, None]])

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of every lifted point, by descending to the nearest child."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if node in self.leaf_of:
                out[own] = self.leaf_of[node]
                continue
            kids = self.children[node]
            nearest = _nearest(points[own], np.stack([self.centres[c] for c in kids]))
            for i, c in enumerate(kids.tolist()):
                if (nearest == i).any():
                    todo.append((c, own[nearest == i]))
        return out

    def visit(self, query: np.ndarray, leaves: int, held: np.ndarray, least: int) -> list[int]:
        """The first ``leaves`` leaves, best bin first, and more until these hold ``least``.

        ``held`` says how many ids each leaf holds.
        """
        queue, out, found = [(0.0, 0)], [], 0
        while queue and (len(out) < leaves or found < least):
            _, node = heapq.heappop(queue)
            while node not in self.leaf_of:
                kids = self.children[node]
                far = ((np.stack([self.centres[c] for c in kids]) - query) ** 2).sum(axis=1)
                best = int(far.argmin())
                for i, c in enumerate(kids.tolist()):
                    if i != best:
                        heapq.heappush(queue, (float(far[i]), c))
                node = int(kids[best])
            out.append(self.leaf_of[node])
            found += held[out[-1]]
        return out


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (points @ centres.T)).argmin(axis=1)


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator):
    """Centres with their points, or None where the points can't be told apart."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(8):
        nearest = _nearest(points, centres)
        used = np.unique(nearest)
        centres = np.stack([points[nearest == c].mean(axis=0) for c in used])
    nearest = _nearest(points, centres)
    used = np.unique(nearest)
    if len(used) < 2:
        return None
    return [(centres[c], points[nearest == c]) for c in used]


def usable(column: str = "embedding") -> Column:
    """The vector as doubles; null for null, zero, and null or non-finite components."""
    vector = F.col(column).cast("array<double>")
    broken = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.when(~broken & F.exists(vector, lambda x: x != 0), vector)


def _matrix(vectors: list) -> np.ndarray:
    return np.array(vectors, np.float64)


def _pack(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows (key..., part, ids, data) of at most about ``size`` vectors.

    Parts are numbered within a key by hash, so a hot key is spread over many rows.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(size)))
    dealt = rows.join(counts, keys).withColumn("part", F.pmod(F.xxhash64("vector"), parts))
    def gather(table: pa.Table) -> pa.Table:
        vectors = table.column("vector").combine_chunks().flatten().to_numpy()
        lists = table.column("ids").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        return pa.table(
            {
                **{k: table.column(k)[:1] for k in keys},
                "part": table.column("part")[:1],
                "n": pa.array([len(sizes)], pa.int64()),
                "sizes": pa.array([sizes.tobytes()], pa.binary()),
                "ids": pa.array([lists.flatten().to_numpy().tobytes()], pa.binary()),
                "data": pa.array([vectors.tobytes()], pa.binary()),
            }
        )

    schema = ", ".join(f"{k} long" for k in keys)
    schema += ", part long, n long, sizes binary, ids binary, data binary"
    columns = [*keys, "part", "ids", "vector"]
    return dealt.select(*columns).groupBy(*keys, "part").applyInArrow(gather, schema)


def _best(scores: np.ndarray, firsts: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller first id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((firsts[some], -scores[some]))][:k]


def _search(row: dict, k: int) -> Iterator[tuple[int, int, float]]:
    """Hits (vector number of the query, id, score) of a block of queries in a block."""
    n, m = row["n"], row["q_n"]
    if not n or not m:
        return
    data = np.frombuffer(row["data"]).reshape(n, -1)
    queries = np.frombuffer(row["q_data"]).reshape(m, -1)
    sizes, ids = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["ids"], np.int64)
    begin = np.cumsum(sizes) - sizes
    numbers = np.frombuffer(row["q_ids"], np.int64)
    if data.shape[1] != queries.shape[1]:
        return
    for number, query in zip(numbers.tolist(), queries, strict=True):
        # The same sum in the same order for equal vectors, wherever they lie.
        scores = np.einsum("ij,j->i", data, query)
        for at in _best(scores, ids[begin], k).tolist():
            for i in ids[begin[at] : begin[at] + sizes[at]].tolist():
                yield number, i, float(scores[at])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: nearest found of all other rows, nearest first.

    ``vectors`` has ``vec_id`` and ``vector`` (array of double, see ``usable``). Nearness is
    the inner product in double precision, ties go to the smaller id. Rows with a null id or
    vector take no part; rows that share an id are one, with the smallest vector in array
    order. Vectors of each size are searched among their own. A query visits leaves until
    these hold k others, so fewer come back only where there are fewer.
    """
    rows = vectors.filter("vec_id is not null and vector is not null")
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = cut(rows.withColumn("dim", F.size("vector")))
    dims = sorted(r.dim for r in rows.select("dim").distinct().collect())
    found = [_nearest_of(rows.filter(F.col("dim") == d).drop("dim"), is_query, k, recall) for d in dims]
    empty = vectors.sparkSession.createDataFrame([], _FOUND)
    return reduce(DataFrame.unionByName, found or [empty])


def _nearest_of(rows: DataFrame, is_query: Column, k: int, recall: float) -> DataFrame:
    """As ``nearest``, for stored rows of distinct ids whose vectors are of one size."""
    longest = rows.agg(
        F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    ).first()[0]
    ordered = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = ordered.select("vector").toArrow().column("vector").combine_chunks()
    points = sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1)
    tree = Tree(longest=float(np.sqrt(longest)))
    tree = Tree.fit(tree.lift(points), tree.longest)
    leaves = len(tree.leaf_of)
    # A tree has at most SAMPLE leaves, whatever is indexed by it.
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    # One candidate for all rows of a vector, with the ids that can be among the k nearest
    # of any query: k of them, and one more as a query leaves itself out.
    same = Window.partitionBy("vector").orderBy("vec_id")
    distinct = (
        rows.withColumn("n", F.row_number().over(same))
        .filter(F.col("n") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column("vector").to_pylist())
                found = pa.array(tree.assign(tree.lift(points)), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], ["vector", "ids", "leaf"])

    indexed = distinct.mapInArrow(leaf, "vector array<double>, ids array<long>, leaf long")
    blocks = cut(_pack(indexed, ["leaf"], BLOCK_ROWS))
    held = np.zeros(leaves, np.int64)
    of_leaf = blocks.groupBy("leaf").agg(F.sum(F.octet_length("ids") / 8).cast("long").alias("n"))
    for r in of_leaf.collect():
        held[r.leaf] = r.n

    asked = rows.filter(is_query).groupBy("vector").agg(F.min("vec_id").alias("number"))
    asked = cut(asked)

    def plan(queries: DataFrame, visits: int) -> DataFrame:
        """Rows (number, vector, leaf): the leaves each query visits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            for batch in batches:
                numbers, own, found = [], [], []
                for number, vector in zip(
                    batch.column("number").to_pylist(),
                    batch.column("vector").to_pylist(),
                    strict=True,
                ):
                    for at in tree.visit(np.append(np.array(vector), 0.0), visits, held, k + 1):
                        numbers.append([number])
                        own.append(vector)
                        found.append(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own, pa.list_(pa.float64())),
                        pa.array(numbers, pa.list_(pa.int64())),
                        pa.array(found, pa.int64()),
                    ],
                    ["vector", "ids", "leaf"],
                )

        narrow = queries.select("number", "vector")
        return narrow.mapInArrow(run, "vector array<double>, ids array<long>, leaf long")

    def search(queries: DataFrame, visits: int) -> DataFrame:
        packed = _pack(plan(queries, visits), ["leaf"], QUERY_ROWS)
        packed = packed.select(
            "leaf", *(F.col(c).alias("q_" + c) for c in ("part", "n", "ids", "data"))
        )
        pairs = packed.join(blocks.hint("merge"), "leaf").repartition("leaf", "part", "q_part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = list(_search(row, k + 1))
                    number, ids, scores = zip(*found, strict=True) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(number, pa.int64()),
                            pa.array(ids, pa.int64()),
                            pa.array(scores, pa.float64()),
                        ],
                        ["number", "vec_id", "score"],
                    )

        hits = pairs.mapInArrow(run, "number long, vec_id long, score double")
        best = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
        return hits.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)

    probes = cut(asked.orderBy(F.xxhash64("number"), "number").limit(PROBES))
    truth = cut(search(probes, leaves).select("number", "vec_id"))
    wanted, visits = truth.count(), max(1, leaves // 64)
    while visits < leaves:
        found = search(probes, visits).select("number", "vec_id")
        if found.join(truth, ["number", "vec_id"]).count() >= recall * wanted:
            break
        visits = min(leaves, visits * 3 // 2 + 1)

    # Back to the rows that asked: each leaves itself out and keeps k.
    hits = search(asked, visits)
    found = cut(hits.groupBy("number").agg(F.collect_list(F.struct("n", "vec_id", "score")).alias("hits")))
    query_rows = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    own = query_rows.join(asked.hint("merge"), "vector").join(found.hint("merge"), "number")
    others = F.sort_array(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")))
    listed = own.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return listed.select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        F.col("hit.score").alias("score"),
    )
