"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of r + 1 bits; the mask of table v keeps the
positions whose vector has an odd inner product with v. At most r differing positions give
at most r linear equations, so some v other than zero solves them all: its mask leaves all
of these positions out, and the pair meets in table v. So 2^(r+1) - 1 tables find every
pair within radius r, and no probability is involved.

A bucket too large for one task is dealt again by a second family of masks over the bits
the first left out, which covers just as surely, and so on: every level leaves fewer bits
that can differ, which bounds what a bucket can hold. Out of a bucket comes one link for
each member at most, never its pairs.

A similarity of 0.8 between sets of five-word shingles is about ten bits of a fingerprint,
too far for so many tables, and fingerprints cannot give that threshold; ``jaccard`` verifies
what they find and has an exact way for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.workers import forget
from tidelake.session import cut

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Members of a bucket that one task compares.
BUCKET = 16_384
_BITS = 64
_STEP = 1 << 16


def _fingerprint(text: str | None, width: int) -> int:
    """Majority bits over the shingles, repeats counted, as a signed long."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(_BITS, np.int64)
    for lo in range(0, len(ends), _STEP):
        spans = zip(starts[lo : lo + _STEP], ends[lo : lo + _STEP], strict=False)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = (2 * counts > len(ends)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, bits``: the 64-bit SimHash of every whole text, as a signed long.

    A-Z is lower-cased; words are the runs of bytes other than space and 0x09 to 0x0D. The
    hashes are XXH64 of ``width`` words joined by a space, repeats included; fewer words
    are one shingle. Null and empty texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            bits = [_fingerprint(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(bits, pa.int64())], ["doc_id", "bits"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, bits long")


def masks(radius: int, level: int = 0) -> list[int]:
    """The masks of all tables, as signed longs; levels deal the vectors differently."""
    size = (1 << (radius + 1)) - 1
    rng = np.random.default_rng(level)
    rounds = -(-_BITS // size)
    vectors = np.concatenate([rng.permutation(size) + 1 for _ in range(rounds)])[:_BITS]
    out = []
    for v in range(1, size + 1):
        odd = np.array([int(x & v).bit_count() & 1 for x in vectors], np.uint8)
        out.append(int(np.packbits(odd, bitorder="little").view("<i8")[0]))
    return out


def _near(bits: np.ndarray, front: np.ndarray, open_: np.ndarray, radius: int) -> np.ndarray:
    """For each of ``open_`` whether it links with one of ``front``."""
    near = np.zeros(len(open_), bool)
    for lo in range(0, len(front), 64):
        some = front[lo : lo + 64]
        near |= (np.bitwise_count(bits[some, None] ^ bits[None, open_]) <= radius).any(axis=0)
    return near


def _star(bits: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect just what links within the radius connect in a bucket."""
    links = []
    open_ = np.argsort(nodes, kind="stable")
    while len(open_):
        # From the smallest node that is left, take in whatever is near, again and again.
        root, front, open_ = nodes[open_[0]], open_[:1], open_[1:]
        while len(front) and len(open_):
            near = _near(bits, front, open_, radius)
            front, open_ = open_[near], open_[~near]
            links.extend((int(n), int(root)) for n in nodes[front])
    return links


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``u, v``: links (v < u) whose components are those of all pairs within ``radius``.

    ``nodes`` has distinct ``bits`` and a distinct ``node`` for each.
    """
    columns = ["bits", "node"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for members in batch.column("members").to_pylist():
                if len(members) == 2:
                    (a, b), (c, d) = ((m["bits"], m["node"]) for m in members)
                    if ((a ^ c) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius:
                        found.append((max(b, d), min(b, d)))
                    continue
                bits = np.array([m["bits"] for m in members], np.int64).view(np.uint64)
                own = np.array([m["node"] for m in members], np.int64)
                found += _star(bits, own, radius)
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_pydict(
                {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())}
            )

    def dealt(rows: DataFrame, level: int, base: Column) -> DataFrame:
        tables = F.array(
            *(
                F.struct(
                    F.lit(i).alias("t"), F.lit(m).cast("long").bitwiseOR(base).alias("mask")
                )
                for i, m in enumerate(masks(radius, level))
            )
        )
        rows = rows.withColumn("table", F.explode(tables))
        mask = F.col("table.mask")
        return rows.select(*columns, mask.alias("mask"), F.col("bits").bitwiseAND(mask).alias("key"))

    found, level = [], 0
    rows = dealt(nodes.select(*columns), 0, F.lit(0).cast("long"))
    while True:
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = cut(sizes)
        small = rows.join(sizes.filter(F.col("n") <= bucket).drop("n"), ["mask", "key"])
        gathered = small.groupBy("mask", "key").agg(
            F.collect_list(F.struct(*columns)).alias("members")
        )
        found.append(gathered.select("members").mapInArrow(compare, "u long, v long"))
        large = sizes.filter(F.col("n") > bucket)
        level += 1
        if large.isEmpty():
            break
        # Once no bit is left out, a key is one fingerprint and no bucket is large.
        again = rows.join(large.drop("n"), ["mask", "key"]).repartition("bits")
        rows = dealt(again, level, F.col("mask"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for nodes that have a link.

    Alternates large-star and small-star steps, each a join and an aggregate whose hot
    nodes are reduced before the shuffle, and cuts the lineage after each round.
    """
    edges = cut(edges.filter("u <> v").select("u", "v"))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.filter("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), "m")
        small = small.select(
            F.greatest("u", "m").alias("u"), F.least("u", "m").alias("v")
        ).unionByName(least.withColumnRenamed("m", "v"))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, bits, component_id``: the smallest id reachable over near fingerprints.

    Equal fingerprints are one node, so copies cost nothing beyond their row. A row with a
    null id has the group of its fingerprint (null if no row with an id has that one) and
    links no others. Rows that share an id are one document: they and what is near any of
    them are in one group, if that id is the smallest of their fingerprints. An empty table
    has no groups. Other columns are not read.
    """
    rows = cut(fingerprints(docs, width))
    nodes = cut(
        rows.filter("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("node"))
    )
    edges = links(nodes, radius)
    found = components(edges)
    groups = nodes.join(found, "node", "left").select(
        "bits", F.coalesce("component", "node").alias("component_id")
    )
    return rows.join(groups, "bits", "left").select("doc_id", "bits", "component_id")
