"""Exact removal of word windows that an earlier document already has.

Method: a count-min prefilter. Every block of documents sketches its windows as sparse
count-min rows, one sorted list of slots for each shard of the hash space; a shard adds up
the sketches of all blocks and tells each block which of its slots have a count of two or
more. Counts are only ever overestimated, so no repeated window is lost. In the second pass
only windows whose slots are all counted twice are grouped exactly, by a 128-bit hash.

The sketch grows with the corpus (a shard covers a fixed number of windows), so its error
rate is the same at every size, and no part of it is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import blocks as B

WIDTH = 50
DEPTH = 2
#: Windows a shard is meant for, slots per window, and bytes of text per word, about.
SHARD_WINDOWS, SLOTS_PER_WINDOW, BYTES_PER_WORD = 3_000_000, 4, 5
_SCHEMA = "doc_id long, n_words long, n_removed long, text string"


def _slots(hashes: np.ndarray, row: int, slots: int) -> np.ndarray:
    """Slot of each window in one count-min row of its shard."""
    salted = B.mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (row + 1) & 0xFFFFFFFFFFFFFFFF))
    return salted & np.uint64(slots - 1)


def _twice(values: np.ndarray) -> np.ndarray:
    """Sorted values, each at most twice."""
    values = np.sort(values)
    if len(values) > 2:
        values = values[np.append([True, True], values[2:] != values[:-2])]
    return values


def _windows(table: pa.Table, width: int):
    """Words, windows (first word, document) and their hash; rows without id take no part."""
    words = B.Words(B.texts_of(table))
    at, doc = words.spans(width)
    ids = table.column("doc_id")
    known = np.array(ids.is_valid())
    at, doc = at[known[doc]], doc[known[doc]]
    hashes = B.hash_words(words)
    return words, hashes, at, doc, B.hash_windows(hashes, at, width)


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(0).to_numpy().astype(np.int64)


def _ordered(ids: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned values of the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _estimated(hashes: np.ndarray, got: dict, shards: int, slots: int) -> np.ndarray:
    """Which windows the merged sketch counts at least twice, in every row."""
    shard = B.shard_of(hashes, shards)
    keep = np.zeros(len(hashes), bool)
    for s in np.unique(shard):
        repeated = got.get((0, int(s)))
        if repeated is None:
            continue
        here = np.flatnonzero(shard == s)
        size = int.from_bytes(repeated[:4], "little")
        rows = [B.unpack_sorted(repeated[4 : 4 + size]), B.unpack_sorted(repeated[4 + size :])]
        ok = np.ones(len(here), bool)
        for row, listed in enumerate(rows):
            own = _slots(hashes[here], row, slots)
            if not len(listed):
                ok[:] = False
                break
            found = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
            ok &= listed[found] == own
        keep[here[ok]] = True
    return keep


def _pair(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def _candidates(table: pa.Table, got: dict, width: int, shards: int, slots: int):
    """Windows estimated repeated, as distinct 128-bit keys with the block's smallest id."""
    words, _, at, doc, first = _windows(table, width)
    keep = _estimated(first, got, shards, slots)
    at, doc, first = at[keep], doc[keep], first[keep]
    second = B.hash_windows(B.hash_words(words, 1), at, width, 1)
    order = np.lexsort((second, first))
    hi, lo = first[order], second[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    group = np.empty(len(hi), np.int64)
    group[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    own = _ordered(_ids(table))[doc]
    least = np.minimum.reduceat(own[order], begin) if len(begin) else own[:0]
    return words, at, doc, group, hi[begin], lo[begin], least, own


def remove(docs: DataFrame, width: int = WIDTH, row_key: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` of every row, without repeated windows.

    ``row_key`` names a column of longs that tells rows apart where ids repeat; it comes back
    as a last column of that name.

    A window is ``width`` consecutive words of one document, a word a run of bytes other
    than space and 0x09 to 0x0D. A word goes if some window over it also starts in a
    document with a smaller id; windows are judged on the input. The kept words are joined
    by one space.

    Null and empty texts have no words. Rows with a null id are kept whole and make no
    other row lose words. Rows that share an id are no earlier than each other, so both
    stay. Texts of fewer words than ``width`` stay. Other columns are not read.
    """
    keys = [F.col(row_key).cast("long")] if row_key else []
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keys)
    stored = B.write_blocks(rows)
    windows = max(1, B.total_bytes(stored) // BYTES_PER_WORD)
    shards = max(1, math.ceil(windows / SHARD_WINDOWS))
    slots = 1 << math.ceil(math.log2(SHARD_WINDOWS * SLOTS_PER_WINDOW))

    def sketch(block: int, part: int, table: pa.Table, got: dict) -> Iterator[tuple[int, bytes]]:
        hashes = np.sort(_windows(table, width)[4])
        for s, here in B.by_shard(hashes, shards):
            lists = [_twice(_slots(hashes[here], row, slots)) for row in range(DEPTH)]
            yield s, _pair(*map(B.pack_sorted, lists))

    def merge(blocks: list, parts: list, keys: list) -> Iterator[tuple[int, bytes]]:
        counters = np.zeros((DEPTH, slots), np.uint8)
        for row in range(DEPTH):
            for k in keys:
                own = _row(k, row)
                twice = np.append(own[1:] == own[:-1], False) if len(own) else own.astype(bool)
                once = np.append(True, own[1:] != own[:-1]) if len(own) else own.astype(bool)
                counters[row, own[once]] = np.minimum(counters[row, own[once]], 2) + 1
                counters[row, own[twice]] = 2
        for i, k in enumerate(keys):
            lists = []
            for row in range(DEPTH):
                own = np.unique(_row(k, row))
                lists.append(B.pack_sorted(own[counters[row, own] >= 2]))
            yield i, _pair(*lists)

    estimated = B.answer(B.ask(stored, sketch), merge, kind=0)

    def group(block: int, part: int, table: pa.Table, got: dict) -> Iterator[tuple[int, bytes]]:
        _, _, _, _, hi, lo, least, _ = _candidates(table, got, width, shards, slots)
        for s, here in B.by_shard(hi, shards):
            a, b, c = B.pack_sorted(hi[here]), B.pack(lo[here]), B.pack(least[here])
            yield s, _pair(a, _pair(b, c))

    def smallest(blocks: list, parts: list, keys: list) -> Iterator[tuple[int, bytes]]:
        parsed = [_three(k) for k in keys]
        hi, lo, least = (np.concatenate([p[i] for p in parsed]) for i in range(3))
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        lowest = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        out = np.empty_like(lowest)
        out[order] = lowest
        begin = 0
        for i, p in enumerate(parsed):
            # How far below the block's own smallest id: mostly nothing.
            yield i, B.pack(p[2] - out[begin : begin + len(p[2])])
            begin += len(p[2])

    exact = B.answer(B.ask(stored, group, estimated), smallest, kind=1)

    def apply(block: int, part: int, payload: bytes, got: dict) -> pa.Table:
        table = B.open_block(payload)
        words, at, doc, key, hi, lo, least, own = _candidates(table, got, width, shards, slots)
        for s, here in B.by_shard(hi, shards):
            least[here] -= B.unpack(got[1, s])
        hit = least[key] < own
        cover = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(cover, at[hit], 1)
        np.add.at(cover, at[hit] + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        kept, data, starts, ends = [], words.data, words.starts, words.ends
        for i in range(table.num_rows):
            lo_, hi_ = words.first[i], words.first[i + 1]
            left = lo_ + np.flatnonzero(~gone[lo_:hi_])
            kept.append(
                b" ".join([data[a:b] for a, b in zip(starts[left], ends[left], strict=True)])
            )
        sums = np.concatenate([[0], np.cumsum(gone)])
        columns = {row_key: table.column(row_key)} if row_key else {}
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(words.counts(), pa.int64()),
                "n_removed": pa.array(sums[words.first[1:]] - sums[words.first[:-1]], pa.int64()),
                "text": pa.array(kept, pa.binary()).cast(pa.string()),
                **columns,
            }
        )

    schema = f"{_SCHEMA}, {row_key} long" if row_key else _SCHEMA
    return B.with_answers(stored, estimated.unionByName(exact), apply, schema)


def _row(keys: bytes, row: int) -> np.ndarray:
    size = int.from_bytes(keys[:4], "little")
    return B.unpack_sorted(keys[4 + size :] if row else keys[4 : 4 + size])


def _three(keys: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(keys[:4], "little")
    rest = keys[4 + size :]
    second = int.from_bytes(rest[:4], "little")
    return (
        B.unpack_sorted(keys[4 : 4 + size]),
        B.unpack(rest[4 : 4 + second]),
        B.unpack(rest[4 + second :]),
    )
