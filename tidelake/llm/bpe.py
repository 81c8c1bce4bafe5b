"""Byte-level BPE encoding and decoding with a rank queue.

Merges are picked by a queue of merge ranks: a hierarchical bitmap holds which ranks have
work, find-first-set on its words gives the lowest, and the bucket of a rank holds places
in linked lists of symbols. Entries are never removed: one whose pair has changed since is
skipped when it comes up. So a pre-token of n bytes takes O(n) queue operations however
long it is.

Pre-tokens not seen before are encoded together, in one queue for all of a batch: a bucket
then holds the places of many pre-tokens, which are merged in one vectorised step. Long
pre-tokens have a queue of their own, whose buckets are heaps of places.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of more bytes get a queue of their own.
LONG = 96
#: Pre-tokens, and words with all their pre-tokens, remembered by a worker.
REMEMBERED = 600_000
#: Bytes of text taken at once.
CHUNK = 4 << 20
_SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded binary"


class RankBitmap:
    """Which ranks have a bucket: three levels of 64-bit words, a set bit per busy child."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, rank: int) -> None:
        for level in self.levels:
            bit, rank = 1 << (rank & 63), rank >> 6
            word = level[rank]
            if word & bit:
                return
            level[rank] = word | bit

    def first(self) -> int:
        """The lowest rank set, or -1."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = (at << 6) + (word & -word).bit_length() - 1
        return at

    def remove(self, rank: int) -> None:
        for level in self.levels:
            bit, rank = 1 << (rank & 63), rank >> 6
            level[rank] &= ~bit
            if level[rank]:
                return


class Bpe:
    """An encoder for one table of ranks; keeps what it has encoded, within a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        order = np.argsort(np.fromiter(pairs, np.int64, len(pairs)))
        # With a last key that no pair has, so that every search ends inside.
        self.pair_keys = np.append(np.fromiter(pairs, np.int64, len(pairs))[order], 1 << 62)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], 0)
        self.by_space = pattern == public_tokenizers.PATTERN
        self.known: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        """The encoder of a rank file: a base64 token and its rank on each line."""
        key = (path, pattern)
        if key not in _LOADED:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            _LOADED[key] = cls(ranks, pattern)
        return _LOADED[key]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``size`` where the two don't merge."""
        key = left * self.size + right
        at = self.pair_keys.searchsorted(key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.size)

    def encode_long(self, piece: bytes) -> list[int]:
        """One pre-token, by a queue of its own."""
        n, none, pairs, size = len(piece), self.size, self.pairs, self.size
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The rank of the pair that starts at each place, or none.
        current = [pairs.get(ids[i] * size + ids[i + 1], none) for i in range(n - 1)] + [none]
        buckets: dict[int, list[int]] = {}
        busy = RankBitmap(size)
        for i, r in enumerate(current):
            if r != none:
                if r not in buckets:
                    buckets[r] = []
                    busy.add(r)
                buckets[r].append(i)  # ascending places are a heap already
        while (r := busy.first()) >= 0:
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                busy.remove(r)
            if current[i] != r:
                continue  # stale
            j = after[i]
            ids[i], current[j] = r, none
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for at, other in ((before[i], i), (i, k)):
                if at < 0:
                    continue
                new = pairs.get(ids[at] * size + ids[other], none) if other < n else none
                current[at] = new
                if new != none:
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        busy.add(new)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Many pre-tokens, by one queue for all of them.

        A step takes, for the lowest rank, the first live place of each pre-token that has
        one, so every pre-token sees its merges in the same order as alone.
        """
        if not pieces:
            return []
        none = self.size
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        # Places n and n + 1 stand for nothing after and nothing before.
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(sizes)
        after[ends - 1] = n
        before[ends - sizes] = n
        current = np.full(n + 1, none)
        inner = np.flatnonzero(after[:n] < n)
        current[inner] = self._rank(ids[inner], ids[inner + 1])
        ids = np.append(ids, 0)
        alive = np.ones(n, bool)
        live = np.flatnonzero(current[:n] < none)
        order = live[np.argsort(current[live], kind="stable")]
        found, begin = np.unique(current[order], return_index=True)
        buckets: dict[int, list] = {}
        busy = RankBitmap(none)
        for r, places in zip(found.tolist(), np.split(order, begin[1:]), strict=True):
            buckets[r] = places.tolist()
            busy.add(r)
        while (r := busy.first()) >= 0:
            places = np.array(buckets.pop(r))
            busy.remove(r)
            places = places[current[places] == r]  # skips stale entries
            if not len(places):
                continue
            if len(places) > 1:
                places.sort()
                whose = owner[places]
                same = whose[1:] == whose[:-1]
                if same.any():
                    later = places[1:][same]
                    places = places[np.append(True, ~same)]
                    # An entry pushed twice is stale once its first copy is merged.
                    buckets[r] = later.tolist()
                    busy.add(r)
            gone = after[places]
            behind = after[gone]
            ids[places] = r
            alive[gone] = False
            current[gone] = none
            after[places] = behind
            before[behind] = places  # place n takes what falls on it
            ahead = before[places]
            left = ahead[ahead < n]
            right = places[behind < n]
            current[places] = none
            again = np.concatenate([left, right])
            new = self._rank(ids[again], ids[after[again]])
            current[again] = new
            merges = new < none
            for rank, at in zip(new[merges].tolist(), again[merges].tolist(), strict=True):
                if rank in buckets:
                    buckets[rank].append(at)
                else:
                    buckets[rank] = [at]
                    busy.add(rank)
        kept = ids[:n][alive].tolist()
        counts = np.bincount(owner[alive], minlength=len(pieces))
        out, place = [], 0
        for c in counts.tolist():
            out.append(tuple(kept[place : place + c]))
            place += c
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Encode the pre-tokens that are not remembered yet."""
        new = pieces - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = pieces
        some = []
        for p in new:
            raw = p.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[p] = (whole,)
            elif len(raw) > LONG:
                self.known[p] = tuple(self.encode_long(raw))
            else:
                some.append((p, raw))
        found = self.encode_many([raw for _, raw in some])
        self.known.update(zip([p for p, _ in some], found, strict=True))

    def _encode_whole(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.pattern.findall(t) for t in texts]
        self._learn(set().union(*pieces))
        return [_flat(map(self.known.__getitem__, found)) for found in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text, every match of the pattern separately.

        With the usual pattern a match never goes on after a space, so a text without
        double spaces is cut at its spaces, and what stands between two is remembered with
        all its matches.
        """
        gc.disable()  # millions of small tuples and no cycles: collections only cost time
        cuts = [t.split(" ") if self.by_space and "  " not in t else [t] for t in texts]
        words = set().union(*(c[1:] for c in cuts))
        new = words - self.words.keys()
        if len(self.words) + len(new) > REMEMBERED:
            self.words = {}
            new = words
        listed = list(new)
        encoded = self._encode_whole([" " + w for w in listed])
        self.words.update(zip(listed, map(tuple, encoded), strict=True))
        out = self._encode_whole([c[0] for c in cuts])
        get = self.words.__getitem__
        for ids, c in zip(out, cuts, strict=True):
            for some in map(get, c[1:]):
                ids += some
        gc.enable()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _flat(parts: Iterable[tuple[int, ...]]) -> list[int]:
    return list(chain.from_iterable(parts))


_LOADED: dict[tuple[str, str], Bpe] = {}


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids = batch.column("doc_id").to_pylist()
    texts = [t or "" for t in batch.column("text").to_pylist()]
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            yield ids[begin : i + 1], texts[begin : i + 1]
            begin, size = i + 1, 0


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every text; ``decoded`` comes from the ids.

    Null and empty texts have no tokens. A null id stays null; repeated rows are encoded
    each. Texts of any length are taken whole. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path, pattern)
        for batch in batches:
            for doc_ids, texts in _chunks(batch):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([bpe.decode(x) for x in ids], pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return _narrow(docs).mapInArrow(run, _SCHEMA)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``encode``, with SHA-256 of the ids' decimal text and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path, pattern)
        text_of = [str(i) for i in range(bpe.size)].__getitem__
        for batch in batches:
            for doc_ids, texts in _chunks(batch):
                ids = bpe.encode(texts)
                said = [" ".join(map(text_of, x)).encode() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in said]),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _narrow(docs).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, decoded``: the bytes that the ids in ``ids`` stand for; null ids: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path, pattern)
        for batch in batches:
            out = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"]
            )

    rows = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(run, "doc_id long, decoded binary")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
