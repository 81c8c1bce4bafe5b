"""Bigram language-model scores by deleted interpolation.

Maximum-likelihood estimates of bigram, unigram and uniform distribution are mixed, with
weights of their own for every bucket of context frequency. The weights are learned by
expectation-maximisation on counts of a held-out tenth of the training documents, whose own
n-grams are deleted from the counts that predict them. The final model uses the counts of
all training documents.

Every block of documents asks the shards of the hash space once for the counts of its
distinct n-grams (see ``blocks``); neither the vocabulary nor the counts are ever gathered
in one place. N-grams are told apart by a 61-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm import blocks as B

SHARD_TOKENS = 2_000_000
BYTES_PER_TOKEN = 5
BUCKETS = 24
#: Estimates are binned for learning the weights: bins per factor of two, and how many.
STEP, BINS = 8, 480
TEST, HELD, KEPT = 0, 1, 2
_END = np.uint64(0x5851F42D4C957F2D)
_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


@dataclass(frozen=True)
class Sizes:
    tokens: int
    distinct: int


def remainder(doc_id: str = "doc_id", modulus: int = 10) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % modulus).cast("int")


def _grams(table: pa.Table):
    """Keys of every token and of the bigram it ends, and the tokens of each document.

    A text is its words, then an end. What stands before its first word is an end too.
    """
    words = B.Words(B.texts_of(table), lower=True)
    counts = words.counts()
    begin = np.cumsum(counts + 1) - (counts + 1)
    seq = np.full(int(counts.sum()) + len(counts), _END, np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    seq[np.arange(len(doc)) + doc] = B.hash_words(words)
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[begin] = _END
    level = ~np.uint64(7)
    one = B.mix(seq) & level | np.uint64(1)
    two = B.mix(B.mix(before * np.uint64(0x9E3779B97F4A7C15)) ^ seq) & level | np.uint64(2)
    context = B.mix(before) & level | np.uint64(1)
    return one, two, context, begin, counts + 1


def _distinct(one: np.ndarray, two: np.ndarray):
    keys, inverse, counts = np.unique(
        np.concatenate([one, two]), return_inverse=True, return_counts=True
    )
    return keys, inverse[: len(one)], inverse[len(one) :], counts


def _counts(got: dict, keys: np.ndarray, shards: int, kept: bool) -> np.ndarray:
    out = np.zeros(len(keys), np.uint64)
    for s, here in B.by_shard(keys, shards):
        answer = got[0, s]
        size = int.from_bytes(answer[:4], "little")
        out[here] = B.unpack(answer[4 + size :] if kept else answer[4 : 4 + size])
    return out.astype(np.float64)


def _estimates(table: pa.Table, got: dict, shards: int, sizes: Sizes, kept: bool):
    """Bucket, the three estimates and the count of every token."""
    one, two, context, begin, lengths = _grams(table)
    keys, at_one, at_two, _ = _distinct(one, two)
    counts = _counts(got, keys, shards, kept)
    c1, c2 = counts[at_one], counts[at_two]
    # The context of a token is the token before, and that of a first token an end; both
    # are tokens of this block, so their counts were asked for.
    c0 = np.empty_like(c1)
    c0[1:] = c1[:-1]
    c0[begin] = counts[np.searchsorted(keys, context[begin])]
    f2 = np.divide(c2, c0, out=np.zeros_like(c2), where=c0 > 0)
    f1 = c1 / max(sizes.tokens, 1)
    f0 = 1.0 / (sizes.distinct + 1)
    bucket = np.where(c0 > 0, np.log2(np.maximum(c0, 1)).astype(int) + 1, 0)
    return np.minimum(bucket, BUCKETS - 1), f2, f1, f0, c1, begin, lengths


def _bins(f: np.ndarray) -> np.ndarray:
    """0 for nothing, else 1 plus the steps below one."""
    steps = np.round(-np.log2(np.maximum(f, 1e-300)) * STEP).astype(int)
    return np.where(f > 0, np.minimum(steps, BINS - 2) + 1, 0)


def _value(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 2.0 ** (-(b - 1) / STEP), 0.0)


def learn_weights(bins: np.ndarray, weights: np.ndarray, distinct: int) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) per bucket by expectation-maximisation.

    ``bins`` has rows (bucket, bin of the bigram, bin of the unigram estimate) and
    ``weights`` how many held-out tokens fell there. Each component starts with one
    token's worth of belief, so none but the bigram of an unseen context becomes zero.
    """
    out = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    out[0] = [0.0, 0.7, 0.3]
    for b in range(BUCKETS):
        here = bins[:, 0] == b
        if not here.any():
            continue
        f = np.stack(
            [
                _value(bins[here, 1]),
                _value(bins[here, 2]),
                np.full(int(here.sum()), 1.0 / (distinct + 1)),
            ],
            axis=1,
        )
        n, lam = weights[here].astype(float), out[b]
        for _ in range(200):
            share = f * lam
            share *= (n / share.sum(axis=1))[:, None]
            new = share.sum(axis=0) + (lam > 0)
            new /= new.sum()
            done = np.abs(new - lam).max() < 1e-7
            lam = new
            if done:
                break
        out[b] = lam
    return out


def score(docs: DataFrame) -> DataFrame:
    """Score of every text, with the add-0.1 unigram score beside it.

    Texts whose id has crc32 remainder 0 modulo 10 are never learned from; those with
    remainder 1 teach the mixture weights, all others and they the counts. A-Z is
    lower-cased; tokens are the words (runs of bytes other than space and 0x09 to 0x0D)
    and one end for each text.

    A null or empty text has its end only. A null id counts as empty text, whose remainder
    is 0. Repeated rows count as often as they come. Without training texts every token has
    probability one. Other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        F.least(remainder(), F.lit(KEPT)).alias("part"),
    )
    stored = B.write_blocks(rows, part="part")
    shards = max(1, math.ceil(B.total_bytes(stored) / BYTES_PER_TOKEN / SHARD_TOKENS))

    def grams(block: int, part: int, table: pa.Table, got: dict) -> Iterator[tuple[int, bytes]]:
        one, two, _, begin, _ = _grams(table)
        # An end is asked for by every block, as it always has one.
        keys, _, _, counts = _distinct(one, two)
        for s, here in B.by_shard(keys, shards):
            listed = B.pack_sorted(keys[here])
            yield s, len(listed).to_bytes(4, "little") + listed + B.pack(counts[here])

    def count(blocks: list, parts: list, keys: list) -> Iterator[tuple[int, bytes]]:
        asked = []
        for k in keys:
            size = int.from_bytes(k[:4], "little")
            asked.append((B.unpack_sorted(k[4 : 4 + size]), k[4 + size :]))
        every = np.unique(np.concatenate([a for a, _ in asked]))
        total = np.zeros((2, len(every)), np.uint64)
        places = [np.searchsorted(every, a) for a, _ in asked]
        for place, (_, packed), part in zip(places, asked, parts, strict=True):
            if part != TEST:
                total[int(part == KEPT), place] += B.unpack(packed)
        both = total.sum(axis=0)
        for i, (place, part) in enumerate(zip(places, parts, strict=True)):
            first = B.pack(both[place])
            kept = B.pack(total[1, place]) if part == HELD else b""
            yield i, len(first).to_bytes(4, "little") + first + kept
        token = (every & np.uint64(7)) == 1
        found = (both[token], total[1, token])
        said = [int(x) for c in found for x in (c.sum(), (c > 0).sum())]
        yield -1, " ".join(map(str, said)).encode()

    counted = B.answer(B.ask(stored, grams), count)
    parts = F.split(F.col("answer").cast("string"), " ")
    totals = (
        counted.filter("block = -1")
        .agg(*(F.coalesce(F.sum(parts[i].cast("long")), F.lit(0)) for i in range(4)))
        .first()
    )
    everything, kept = Sizes(totals[0], totals[1]), Sizes(totals[2], totals[3])
    counted = counted.filter("block <> -1")

    def tally(block: int, part: int, payload: bytes, got: dict) -> pa.Table:
        bucket, f2, f1, *_ = _estimates(B.open_block(payload), got, shards, kept, kept=True)
        code = (bucket * BINS + _bins(f2)) * BINS + _bins(f1)
        codes, n = np.unique(code, return_counts=True)
        return pa.table({"code": pa.array(codes, pa.int64()), "n": pa.array(n, pa.int64())})

    held = stored.filter(F.col("part") == HELD)
    # At most BUCKETS * BINS * BINS rows, however large the corpus is.
    tallied = (
        B.with_answers(
            held, counted.join(held.select("block"), "block", "left_semi"), tally, "code long, n long"
        )
        .groupBy("code")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    codes = tallied["code"].to_numpy(np.int64)
    bins = np.stack([codes // (BINS * BINS), codes // BINS % BINS, codes % BINS], axis=1)
    weights = learn_weights(bins, tallied["n"].to_numpy(), kept.distinct)

    def apply(block: int, part: int, payload: bytes, got: dict) -> pa.Table:
        table = B.open_block(payload)
        bucket, f2, f1, f0, c1, begin, lengths = _estimates(
            table, got, shards, everything, kept=False
        )
        lam = weights[bucket]
        model = np.log10(lam[:, 0] * f2 + lam[:, 1] * f1 + lam[:, 2] * f0)
        base = np.log10((c1 + 0.1) / (everything.tokens + 0.1 * (everything.distinct + 1)))
        if not everything.tokens:
            model = base = np.zeros(len(c1))
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": pa.array([part == TEST] * table.num_rows),
                "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c1 > 0).astype(np.int64), begin)),
                "train_tokens": pa.array([everything.tokens] * table.num_rows, pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, begin)),
                "score": pa.array(np.add.reduceat(model, begin)),
            }
        )

    return B.with_answers(stored, counted, apply, _SCHEMA)
