"""Exact top-k by integer inner product, term at a time.

Vectors are dealt to blocks, each held as postings: for every term the rows that have it
and their weights. A query row scatters its weighted postings into a dense array of scores,
one term after another; a partition selection keeps the best of a block, and the blocks'
best are merged. Query blocks visit every vector block in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.session import cut

BLOCK_ROWS, QUERY_ROWS = 16_384, 1024
_HITS = "query_id long, vec_id long, score long"


def quantised(column: str = "embedding", factor: int = 256) -> Column:
    """floor(factor * x) of every component as double; null for null or non-finite ones."""
    vector = F.col(column).cast("array<double>")
    broken = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    whole = F.transform(vector, lambda x: F.floor(x * F.lit(float(factor))).cast("long"))
    return F.when(~broken, whole)


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows (id, vector) as blocks of about ``size``: rows (name, ids, sizes, values)."""
    n = rows.count()
    blocks = max(1, -(-n // size))

    def gather(table: pa.Table) -> pa.Table:
        vectors = table.column("vector").combine_chunks()
        return pa.table(
            {
                name: table.column(name)[:1],
                "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()),
                "sizes": pa.array(
                    [vectors.value_lengths().to_numpy().astype(np.int64).tobytes()], pa.binary()
                ),
                "values": pa.array([vectors.flatten().to_numpy().tobytes()], pa.binary()),
            }
        )

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    packed = dealt.groupBy(name).applyInArrow(
        gather, f"{name} long, ids binary, sizes binary, values binary"
    )
    return packed, blocks


def _load(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and the terms that are not zero as (row, term, weight)."""
    ids, sizes, values = (
        np.frombuffer(row[prefix + c], np.int64) for c in ("ids", "sizes", "values")
    )
    owner = np.repeat(np.arange(len(ids)), sizes)
    term = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = values != 0
    return ids, owner[some], term[some], values[some]


def _block_hits(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, owner, term, weight = _load(row, "")
    order = np.argsort(term, kind="stable")
    owner, weight = owner[order], weight[order]
    terms, begin = np.unique(term[order], return_index=True)
    postings = {
        int(t): (owner[a:b], weight[a:b])
        for t, a, b in zip(terms, begin, [*begin[1:], len(owner)], strict=True)
    }
    by_id = np.argsort(ids)
    queries, of, query_term, query_weight = _load(row, "q_")
    edges = np.searchsorted(of, np.arange(len(queries) + 1))
    out = ([], [], [])
    scores = np.zeros(len(ids), np.int64)
    for q, query in enumerate(queries):
        scores[:] = 0
        some = slice(edges[q], edges[q + 1])
        for t, x in zip(query_term[some].tolist(), query_weight[some], strict=True):
            if t in postings:
                rows, weights = postings[t]
                scores[rows] += x * weights  # a row is in a posting list once
        alone = np.ones(len(ids), bool)
        alone[by_id[np.searchsorted(ids, query, "left", by_id) : np.searchsorted(ids, query, "right", by_id)]] = False
        at = np.flatnonzero(alone)
        if len(at) > k:
            own = scores[at]
            least = np.partition(own, len(own) - k)[len(own) - k]
            sure, tied = at[own > least], at[own == least]
            tied = tied[np.argsort(ids[tied])][: k - len(sure)]
            at = np.append(sure, tied)
        out[0].append(np.full(len(at), query))
        out[1].append(ids[at])
        out[2].append(scores[at])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other rows for every query.

    ``vectors`` has ``vec_id`` and ``vector`` (array of long). Ties go to the smaller id.
    Rows with a null id or vector take no part. Rows that share an id are one row, the one
    with the smallest vector in array order. Terms one side lacks count as zero, and scores
    wrap as 64-bit integers do. Fewer than k candidates are all returned.
    """
    rows = vectors.filter("vec_id is not null and vector is not null")
    rows = cut(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    blocks, n = _blocks(rows, BLOCK_ROWS, "block")
    queries, _ = _blocks(rows.filter(is_query), QUERY_ROWS, "query_block")
    # A stated query set against all rows, in blocks: each query block goes to every block.
    visits = queries.select(
        "query_block",
        *(F.col(c).alias("q_" + c) for c in ("ids", "sizes", "values")),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                arrays = [pa.array(x, pa.int64()) for x in _block_hits(row, k)]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    pairs = visits.join(blocks, "block").repartition("block", "query_block")
    hits = pairs.mapInArrow(run, _HITS)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
