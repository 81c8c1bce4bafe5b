"""Groups of texts alike in 0.8 of their five-word shingles, found without a miss and verified.

Candidates come from SimHash fingerprints first, by the covering tables of ``simhash``: texts
whose fingerprints are equal or link within its radius. Each is verified by both whole sets
before it links. Such fingerprints find most near copies but cannot give the threshold, so
what they leave apart goes an exact way, on signatures:

Two sets of a and b shingles with a similarity of 0.8 differ in (a + b) / 9 shingles at most.
Shingles are dealt by hash into more parts than that, so some part is the same in both sets:
its signature finds the pair, whatever the texts are, and no probability is involved. Sizes
are in classes a quarter apart, and a text signs for its own class and the next, where the
larger of a pair may be. A part without shingles signs nothing; a text with too many such
parts to be sure signs again by another dealing, and at last for the empty parts as well.

No row is made per signature: blocks of texts ask shards which of theirs occur twice, as in
``blocks``, and only those become rows. What shares a signature with the smallest text that
has it is verified first, by both whole sets; then every pair with a common signature that
is not in one group yet. Nothing links that was not verified.

Texts of one template share signatures without being alike. A pair is therefore compared by
bitmaps first: each shingle turns one bit over, so bitmaps never differ in more bits than
the sets differ in shingles, and what differs too much is dropped without loss. Signatures
of few texts make rows of pairs; those of many are dealt into blocks that meet in tasks of
bounded size. There only a forest of the pairs that pass becomes rows, one for each text at
most, as a large group of copies is found by a tree of links as well as by all of them. Where
links of a tree fail verification, other trees follow, and at last every pair between groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import blocks as B
from tidelake.llm import simhash
from tidelake.llm.simhash import components
from tidelake.llm.workers import forget
from tidelake.session import cut, scratch

WIDTH = 5
#: Keys a shard is meant for, and bytes of text per key, about.
SHARD_KEYS, BYTES_PER_KEY = 3_000_000, 8
#: Texts of a signature that make rows of pairs, and that a block of a larger one holds.
FEW, BLOCK = 16, 2048
#: Words of bitmaps that one comparison in a block holds at a time, about.
WORDS = 1 << 20
#: Forests, each in another order, before every pair between groups is looked at.
FORESTS = 3
#: Dealings before the empty parts sign as well, and bits of a signature not asked about.
DEALINGS, _LOW = 8, np.uint64(16)
_ODD = 0x9E3779B97F4A7C15


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size of each class, its parts, and how many of them may be empty."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append((5 * least[-1] + 3) // 4)
    differ = [2 * (x - 1) // 9 for x in least[1:]]
    spare = [(3 * d + 19) // 20 for d in differ]
    parts = [d + 1 + s for d, s in zip(differ, spare, strict=True)]
    return np.array(least), np.array(parts), np.array(spare)


_LEAST, _PARTS, _SPARE = _classes()


def _salt(n: int) -> np.uint64:
    return np.uint64(_ODD * (n + 1) & 0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of each text, sorted, and the text each belongs to.

    A-Z is lower-cased; words are the runs of bytes other than space and 0x09 to 0x0D. Fewer
    words than five are one shingle.
    """
    words = B.Words(texts, lower=True)
    hashes, counts = B.hash_words(words), words.counts()
    at, doc = words.spans(WIDTH)
    values, owners = [B.hash_windows(hashes, at, WIDTH)], [doc]
    for n in range(1, WIDTH):
        short = np.flatnonzero(counts == n)
        values.append(B.hash_windows(hashes, words.first[short], n))
        owners.append(short)
    value, doc = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], doc[new]


def signatures(value: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets, and the text each belongs to."""
    sizes = np.bincount(doc, minlength=n_docs)
    own = np.searchsorted(_LEAST, sizes, side="right") - 1
    weights = B.mix(value + _salt(0))
    found, owners = [], []
    for step in (0, 1):
        cls = own + step
        open_ = sizes > 0
        for dealing in range(DEALINGS):
            here = np.flatnonzero(open_[doc])
            if not len(here):
                break
            some = np.flatnonzero(open_)
            parts = _PARTS[cls[some]]
            first = np.cumsum(parts) - parts
            place = np.zeros(n_docs, np.int64)
            place[some] = np.arange(len(some))
            row = place[doc[here]]
            part = B.mix(value[here] ^ _salt(dealing + 1)) >> np.uint64(32)
            part = (part * parts[row].astype(np.uint64)) >> np.uint64(32)
            at = first[row] + part.astype(np.int64)
            total = int(parts.sum())
            sums = np.zeros(total, np.uint64)
            np.add.at(sums, at, weights[here])
            filled = np.bincount(at, minlength=total) > 0
            owner = np.repeat(np.arange(len(some)), parts)
            number = (np.arange(total) - first[owner]).astype(np.uint64)
            kind = (cls[some][owner] * DEALINGS + dealing).astype(np.uint64)
            signed = B.mix(sums ^ B.mix((kind << np.uint64(40)) + number + _salt(0)))
            empty = parts - np.bincount(owner[filled], minlength=len(some))
            unsure = empty > _SPARE[cls[some]]
            if dealing == DEALINGS - 1:
                filled |= unsure[owner]
            found.append(signed[filled])
            owners.append(some[owner[filled]])
            open_ = np.zeros(n_docs, bool)
            open_[some[unsure]] = True
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def bitmaps(value: np.ndarray, doc: np.ndarray, n_docs: int) -> list[bytes]:
    """For each set a bitmap of twice its size or more, in which each shingle turns a bit."""
    sizes = np.bincount(doc, minlength=n_docs)
    wide = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    first = np.cumsum(wide) - wide
    place = first[doc] + (value.astype(np.int64) & (wide[doc] - 1))
    bits = np.packbits((np.bincount(place, minlength=int(wide.sum())) & 1).astype(np.uint8))
    return [bits[a : a + w].tobytes() for a, w in zip(first // 8, wide // 8, strict=True)]


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (one a row) of a smaller width: bits that fall together turn each other."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _signed(table: pa.Table):
    value, doc = shingles(B.texts_of(table))
    return *signatures(value, doc, table.num_rows), value, doc


def by_fingerprint(texts: DataFrame) -> DataFrame:
    """``u, v``: candidates whose fingerprints are equal or link by the covering tables."""
    named = texts.select(F.col("row").alias("doc_id"), "text")
    rows = cut(simhash.fingerprints(named, WIDTH).withColumnRenamed("doc_id", "row"))
    nodes = cut(rows.groupBy("bits").agg(F.min("row").alias("node")))
    same = rows.join(nodes, "bits").filter("row <> node")
    return same.select(F.col("row").alias("u"), F.col("node").alias("v")).unionByName(simhash.links(nodes))


def _shared(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures that occur twice as ``sig, node, n`` (``n``: size of the set), and of their
    texts the bitmaps as ``node, bits`` and the sizes as ``node, n``."""
    with scratch(texts.sparkSession):
        rows = _signature_rows(texts)
    mapped = rows.filter("bits is not null")
    return rows.filter("bits is null").drop("bits"), mapped.select("node", "bits"), mapped.select("node", "n")


def _signature_rows(texts: DataFrame) -> DataFrame:
    """``sig, node, n, bits``: a row for each signature, and one with the bitmap."""
    stored = B.write_blocks(texts)
    shards = max(1, math.ceil(B.total_bytes(stored) / BYTES_PER_KEY / SHARD_KEYS))

    def question(block: int, part: int, table: pa.Table, got: dict) -> Iterator[tuple[int, bytes]]:
        keys = np.sort((_signed(table)[0] >> _LOW) << _LOW)
        if len(keys) > 2:  # each at most twice
            keys = keys[np.append([True, True], keys[2:] != keys[:-2])]
        for s, here in B.by_shard(keys, shards):
            yield s, B.pack_sorted(keys[here] >> _LOW)

    def reply(blocks: list, parts: list, keys: list) -> Iterator[tuple[int, bytes]]:
        asked = [B.unpack_sorted(k) for k in keys]
        every = np.sort(np.concatenate(asked))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        if len(twice):
            for i, own in enumerate(asked):
                own = np.unique(own)
                at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
                own = own[twice[at] == own]
                if len(own):
                    yield i, B.pack_sorted(own)

    def rows(block: int, part: int, payload: bytes, got: dict) -> pa.Table:
        table = B.open_block(payload)
        twice = [B.unpack_sorted(a) for a in got.values()]
        twice = np.sort(np.concatenate(twice)) if twice else np.zeros(0, np.uint64)
        none = np.zeros(0, np.int64)
        signed, owner, value, doc = _signed(table) if len(twice) else (twice, none, twice, none)
        if len(twice):
            keys = signed >> _LOW
            at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            keep = twice[at] == keys
            signed, owner = signed[keep], owner[keep]
        nodes, sizes = table.column("row").to_numpy(), np.bincount(doc, minlength=table.num_rows)
        some = np.unique(owner)
        here = np.isin(doc, some)
        maps = bitmaps(value[here], np.searchsorted(some, doc[here]), len(some))
        both = np.concatenate([owner, some])
        return pa.table(
            {
                "sig": pa.array(np.concatenate([signed.view(np.int64), 0 * some]), pa.int64()),
                "node": pa.array(nodes[both], pa.int64()),
                "n": pa.array(sizes[both].astype(np.int64), pa.int64()),
                "bits": pa.array([None] * len(owner) + maps, pa.binary()),
            }
        )

    answers = B.answer(B.ask(stored, question), reply)
    schema = "sig long, node long, n long, bits binary"
    return cut(B.with_answers(stored, answers, rows, schema), keep=True)


def _differ_little(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether bitmaps (one a row, of one width) differ as little as sets alike in 0.8 do.

    ``sizes`` are those of both sets together; such sets differ in a ninth of that.
    """
    return 9 * np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= sizes


def plausible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The rows ``u, v`` of ``pairs`` (``u, v, n, m``) that bitmaps do not rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            near = np.zeros(batch.num_rows, bool)
            columns = zip(batch.column("a"), batch.column("b"), strict=True)
            for i, (a, b) in enumerate(columns):
                a, b = (np.frombuffer(x.as_buffer(), np.uint8) for x in (a, b))
                width = min(len(a), len(b))
                near[i] = _differ_little(folded(a, width), folded(b, width), sizes[i])
            yield batch.select(["u", "v"]).filter(pa.array(near))

    met = pairs.join(maps.select(F.col("node").alias("v"), F.col("bits").alias("b")), "v")
    met = met.join(maps.select(F.col("node").alias("u"), F.col("bits").alias("a")), "u")
    return met.select("u", "v", "n", "m", "a", "b").mapInArrow(check, "u long, v long")


def forest(near, node: np.ndarray, g: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(u, v)`` of a spanning forest; texts of one group ``g`` are connected already.

    ``near(a, b)`` says which texts ``a`` (places, down) pass with which ``b`` (across).
    """
    open_, found = np.argsort(B.mix(node.astype(np.uint64) ^ _salt(salt))), ([], [])
    while len(open_):
        mates = g[open_] == g[open_[0]]
        front, open_ = open_[mates], open_[~mates]
        while len(front) and len(open_):
            some, front = front[:64], front[64:]
            passed = near(some, open_)
            hit = passed.any(axis=0)
            if hit.any():
                found[0].append(node[open_[hit]])
                found[1].append(node[some[passed[:, hit].argmax(axis=0)]])
                hit |= np.isin(g[open_], g[open_[hit]])
                front, open_ = np.append(front, open_[hit]), open_[~hit]
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def compare_block(table: pa.Table, salt: int | None) -> pa.Table:
    """``u, v`` of one or two blocks of a signature, with a ``salt`` only a forest of it."""
    block, node, n, g = (table.column(c).to_numpy() for c in ("block", "node", "n", "g"))
    bits = table.column("bits").to_pylist()
    width = min(map(len, bits))
    maps = np.stack([folded(np.frombuffer(x, np.uint8), width) for x in bits])
    maps = maps.view(np.uint64)
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = max(1, WORDS // max(1, len(b) * maps.shape[1]))
        if len(a) > step:
            return np.concatenate([near(a[i : i + step], b) for i in range(0, len(a), step)])
        a, b = a[:, None], b[None]
        passed = _differ_little(maps[a], maps[b], n[a] + n[b]) & (g[a] != g[b])
        if lo != hi:
            passed &= block[a] != block[b]
        return passed & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))

    if salt is not None:
        u, v = forest(near, node, g, salt)
    else:
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found = ([], [])
        for at in range(0, len(left), 64):
            x, y = np.nonzero(near(left[at : at + 64], right))
            found[0].append(node[left[at + x]])
            found[1].append(node[right[y]])
        u, v = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
    big, small = np.maximum(u, v), np.minimum(u, v)
    return pa.table({"u": pa.array(big, pa.int64()), "v": pa.array(small, pa.int64())})


def crowded(members: DataFrame, maps: DataFrame, salt: int | None = None) -> DataFrame:
    """``u, v`` of one signature and different groups ``g`` that bitmaps do not rule out.

    ``members`` has ``sig, node, n, g`` and ``k``, how many its signature has. Its blocks meet
    two by two, so no task holds more than two of them; only what passes becomes a row, with
    a ``salt`` only a forest of it.
    """
    blocks = F.ceil(F.col("k") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.withColumns({"block": own, "last": blocks - 1})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.join(maps, "node").select(
        "sig",
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
        "block", "node", "n", "g", "bits",
    )

    return dealt.groupBy("sig", "lo", "hi").applyInArrow(lambda table: compare_block(table, salt), "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows ``u, v`` of ``pairs`` whose shingle sets are alike in 0.8."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            value, doc = shingles(B.texts_of(pa.Table.from_batches([batch])))
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            packed = [value[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(packed, pa.binary())], ["row", "set"]
            )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            columns = zip(batch.column("a"), batch.column("b"), strict=True)
            for i, (a, b) in enumerate(columns):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                near[i] = 9 * int((a[at] == b).sum()) >= 4 * (len(a) + len(b))
            yield batch.select(["u", "v"]).filter(pa.array(near))

    pairs = cut(pairs)
    some = pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct()
    found = cut(texts.join(cut(some), "row", "left_semi").mapInArrow(sets, "row long, set binary"))
    met = pairs.join(found.select(F.col("row").alias("v"), F.col("set").alias("b")), "v")
    met = met.join(found.select(F.col("row").alias("u"), F.col("set").alias("a")), "u")
    return cut(met.select("u", "v", "a", "b").mapInArrow(check, "u long, v long"))


def _sizes_fit(n, m):
    return (F.least(n, m) * 5) >= (F.greatest(n, m) * 4)


def links(texts: DataFrame) -> DataFrame:
    """``u, v``: verified links whose components are those of all pairs alike in 0.8.

    ``texts`` has a distinct ``row`` for each text.
    """
    shared, maps, sizes = _shared(texts)
    # Alike texts share a signature, so what has no size here is alike to no other.
    near = (
        by_fingerprint(texts)
        .join(sizes.withColumnRenamed("node", "u"), "u")
        .join(sizes.select(F.col("node").alias("v"), F.col("n").alias("m")), "v")
        .filter(_sizes_fit(F.col("n"), F.col("m")))
    )
    found = verified(plausible(near, maps), texts)
    # The exact way for what the fingerprints leave apart.
    left = _open(shared, found)
    least = left.groupBy("sig").agg(F.min(F.struct("node", "n", "g")).alias("m"))
    stars = (
        left.drop("k")
        .join(least, "sig")
        .filter((F.col("node") > F.col("m.node")) & (F.col("g") != F.col("m.g")))
        .filter(_sizes_fit(F.col("n"), F.col("m.n")))
        .select(F.col("node").alias("u"), F.col("m.node").alias("v"), "n", F.col("m.n").alias("m"))
        .distinct()
    )
    found = cut(found.unionByName(verified(plausible(stars, maps), texts)))
    # Pairs inside one group need no look; all others with a common signature do.
    for salt in range(FORESTS):
        many = _open(shared, found).filter(F.col("k") > FEW)
        tree = cut(crowded(many, maps, salt).distinct())
        if tree.isEmpty():
            break
        found = cut(found.unionByName(verified(tree, texts)))
    left = _open(shared, found)
    few = left.filter(F.col("k") <= FEW)
    other = few.select("sig", F.col("node").alias("v"), F.col("n").alias("m"), F.col("g").alias("h"))
    pairs = (
        few.withColumnRenamed("node", "u")
        .join(other, "sig")
        .filter((F.col("u") > F.col("v")) & (F.col("g") != F.col("h")))
        .filter(_sizes_fit(F.col("n"), F.col("m")))
        .select("u", "v", "n", "m")
        .distinct()
    )
    rest = plausible(pairs, maps).unionByName(crowded(left.filter(F.col("k") > FEW), maps))
    return found.unionByName(verified(rest.distinct(), texts))


def _open(shared: DataFrame, links: DataFrame) -> DataFrame:
    """``sig, node, n, g, k``: signatures whose texts are not in one group ``g`` yet."""
    group = components(links).select("node", F.col("component").alias("g"))
    left = cut(shared.join(group, "node", "left").withColumn("g", F.coalesce("g", "node")))
    open_ = left.groupBy("sig").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("k"))
    return cut(left.join(open_.filter("lo < hi").select("sig", "k"), "sig"))


def copies(docs: DataFrame) -> DataFrame:
    """``row, doc_id, component, kept``: the group of each row with an id.

    ``docs`` has a stored, distinct ``row`` (long), ``doc_id`` and ``text``. Rows of the same
    words in the same order, empty and null texts among them, are one group; so is whatever
    links of 0.8 similarity connect. ``kept`` is true for one row of each group, that of the
    smallest id. Rows that share an id are judged each by its own text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = B.texts_of(pa.Table.from_batches([batch]))
            words = (b" ".join((t or b"").lower().split()) for t in texts)
            copy = [hashlib.blake2b(w, digest_size=16).digest() for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(copy, pa.binary())],
                ["row", "doc_id", "copy"],
            )

    docs = docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.filter("doc_id is not null")
    rows = cut(docs.mapInArrow(run, "row long, doc_id long, copy binary"))
    nodes = rows.groupBy("copy").agg(F.min("row").alias("node"))
    rows = cut(rows.join(nodes, "copy"))
    again = cut(rows.filter("row <> node").select("row"))
    texts = docs.join(again, "row", "left_anti").select("row", "text")
    found = components(links(texts))
    rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = cut(rows.select("row", "doc_id", "copy", "component"))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "copy", "row")).alias("first"))
    return rows.join(first, "component").select(
        "row", "doc_id", "component", (F.col("row") == F.col("first.row")).alias("kept")
    )
