"""How filters interact: what each removes, in every order, by contingency tensors.

A document passes or fails each of n filters, so the documents of a part fall into 2^n
cells. Spark counts the cells; a part's counts are then a tensor with one axis of length two
for each filter, and every figure of every step of every order is one contraction of it:
along each axis a vector selects those that pass, those that fail, or all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.session import cut

#: Selectors along an axis; place 1 of an axis holds the documents that fail its filter.
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
#: Parts whose tensors are contracted together.
PARTS = 256
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
LETTERS = "ABCDE"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = re.compile(r"[#$%&*|]")


# ---------------------------------------------------------------- the five filters


def text_failures(text: str) -> int:
    """Bits of the filters on the text alone that it fails: A is bit 0, D is bit 3."""
    data = text.encode()
    words = data.split()
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_SHARE * len(words)) << 1
        | (100 * (len(data) - len(data.translate(None, _CAPITALS))) > CAPITAL_SHARE * len(text)) << 2
        | bool(_SYMBOLS.search(text)) << 3
    )


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, n, A, B, C, D, E``: which filters rows fail; ``n`` equal rows are one.

    A null text is an empty one, a null part an empty string. E is failed by a row whose
    text a smaller id has too, anywhere in the table; texts are compared by 128-bit digests.
    A row without an id neither fails E nor makes another fail it, and rows of one id and
    one text fail it together or not at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            bits = [text_failures(t) for t in texts]
            copies = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("part"),
                    pa.array(bits, pa.int32()),
                    pa.array(copies, pa.binary()),
                ],
                ["doc_id", "part", "bits", "copy"],
            )

    narrow = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("string"),
    )
    rows = cut(narrow.mapInArrow(run, "doc_id long, part string, bits int, copy binary"))
    # One row per text, whoever holds how many copies: reduced before it is shuffled.
    firsts = rows.groupBy("copy").agg(F.min("doc_id").alias("first"))
    firsts = firsts.filter("first is not null").withColumnRenamed("copy", "first_copy")
    rows = rows.groupBy("doc_id", "copy", "part", "bits").agg(F.count("*").alias("n"))
    # Joined by text and id together, so a group of copies is never one key.
    own = (F.col("copy") == F.col("first_copy")) & (F.col("doc_id") == F.col("first"))
    again = F.col("first").isNull() & F.col("doc_id").isNotNull()
    bits = [F.col("bits").bitwiseAND(1 << i) != 0 for i in range(4)]
    fails = dict(zip(LETTERS, [*bits, again], strict=True))
    return rows.join(firsts, own, "left").select(
        "doc_id", "part", "n", *(c.alias(k) for k, c in fails.items())
    )


def marks(labels: DataFrame, **columns: str) -> DataFrame:
    """``doc_id`` and whether any label row of it has 1 in each of ``columns``."""
    flags = [
        F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for name, c in columns.items()
    ]
    named = labels.select(F.col("doc_id").cast("long"), *dict.fromkeys(columns.values()))
    return named.filter("doc_id is not null").groupBy("doc_id").agg(*flags)


# ---------------------------------------------------------------- tensors


def cells(rows: DataFrame, filters: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``part, cells``: of each part the cells with their counts, 2^n at most.

    ``filters`` are boolean columns; the cell's place has bit n-1-i for the i-th. ``sums``
    are the counts to keep; a part has as many rows here as it has cells, so nothing grows
    with the documents.
    """
    n = len(filters)
    cell = sum((F.col(f).cast("int") * (1 << (n - 1 - i)) for i, f in enumerate(filters)), F.lit(0))
    counts = rows.groupBy("part", cell.alias("cell")).agg(
        *(F.sum(c).cast("long").alias(k) for k, c in sums.items())
    )
    return counts.groupBy("part").agg(F.collect_list(F.struct("cell", *sums)).alias("cells"))


def contract(tensor: np.ndarray, axes: Sequence[np.ndarray]) -> np.ndarray:
    """The sums that one selector for each axis picks; other, leading axes stay."""
    letters = "abcdefghijklmnop"[: len(axes)]
    return np.einsum(f"...{letters},{','.join(letters)}->...", tensor, *axes)


def figures(tensor: np.ndarray) -> dict[tuple[int, frozenset[int]], dict[str, np.ndarray]]:
    """For each filter and each set of filters before it: what the step keeps and removes.

    The last n axes of ``tensor`` are the filters. The same contractions serve all orders
    that have the same filters before.
    """
    n = next(i for i in range(tensor.ndim, 0, -1) if tensor.shape[-i:] == (2,) * i)
    out = {}
    for own in range(n):
        others = [i for i in range(n) if i != own]

        def pick(passed: set, at: np.ndarray, rest: np.ndarray = ALL, own: int = own) -> np.ndarray:
            axes = [PASS if i in passed else rest for i in range(n)]
            axes[own] = at
            return contract(tensor, axes)

        failing, alone = pick(set(), FAIL), pick(set(others), FAIL)
        for size in range(n):
            for before in map(set, combinations(others, size)):
                removed = pick(before, FAIL)
                out[own, frozenset(before)] = {
                    "kept": pick(before, PASS),
                    "removed": removed,
                    "redundant": failing - removed,
                    "unique_fails": alone,
                }
    return out


def audit(
    rows: DataFrame, filters: Sequence[str], n: Column, lost: Mapping[str, Column]
) -> DataFrame:
    """Figures of every part, order and step of ``filters``, applied left to right.

    ``rows`` has ``part`` and the boolean columns ``filters`` (true: the row fails), ``n``
    is how many documents a row stands for, and ``lost`` names further counts (columns of
    ``rows``) of which the removed are reported. One row for each part, ``filter_order`` and
    ``step``: ``kept`` after the step, ``removed`` in it, ``redundant`` (failing but removed
    before), ``unique_fails`` (failing no other), one column for each of ``lost``, and
    ``shapley``, the filter's removed summed over all orders. Tables without rows have no
    parts, so no figures.
    """
    counts = cells(rows, filters, {"n": n, **lost})
    lost = list(lost)
    sums = ["n", *lost]
    k, orders = len(filters), list(permutations(range(len(filters))))
    names = ["".join(filters[i] for i in o) for o in orders]
    columns = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, PARTS):
                batch = whole.slice(lo, PARTS)
                tensors = np.zeros((len(sums), batch.num_rows, 2**k), np.int64)
                for p, own in enumerate(batch.column("cells").to_pylist()):
                    for c in own:
                        tensors[:, p, c["cell"]] = [c[s] for s in sums]
                steps = figures(tensors.reshape(len(sums), batch.num_rows, *(2,) * k))
                shapley = np.zeros((k, batch.num_rows), np.int64)
                for order in orders:
                    for at, own in enumerate(order):
                        shapley[own] += steps[own, frozenset(order[:at])]["removed"][0]
                made = {c: [] for c in columns}
                for order in orders:
                    for at, own in enumerate(order):
                        here = steps[own, frozenset(order[:at])]
                        for c in columns[:4]:
                            made[c].append(here[c][0])
                        for i, c in enumerate(lost):
                            made[c].append(here["removed"][1 + i])
                        made["shapley"].append(shapley[own])
                each = len(orders) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(batch.column("part").to_numpy(zero_copy_only=False), each)),
                        pa.array(np.tile(np.repeat(names, k), batch.num_rows), pa.string()),
                        pa.array(np.tile(np.arange(1, k + 1), len(orders) * batch.num_rows), pa.int32()),
                        *(pa.array(np.stack(made[c], axis=1).ravel()) for c in columns),
                    ],
                    ["part", "filter_order", "step", *columns],
                )

    schema = "part string, filter_order string, step int, "
    schema += ", ".join(f"{c} long" for c in columns)
    return counts.mapInArrow(run, schema)


def text_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five text filters, with good and toxic documents lost by labels.

    An id with several label rows is good, or toxic, if any of them says so.
    """
    known = marks(labels, good="quality", toxic="toxic")
    rows = failures(docs, part).join(known, "doc_id", "left")
    n = F.col("n")
    return audit(
        rows,
        LETTERS,
        n,
        {
            "good_lost": F.when(F.col("good"), n).otherwise(0),
            "toxic_lost": F.when(F.col("toxic"), n).otherwise(0),
        },
    )
