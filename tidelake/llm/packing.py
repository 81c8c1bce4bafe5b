"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

A solution is a set of bins. Crossover injects whole well-filled bins of one parent into
the other, removes the bins that hold any of their documents, and puts the displaced
documents back by best fit. Documents are dealt at random to shards of bounded size; each
shard is evolved by several islands in tasks of their own, which exchange their elites
between epochs. The well-filled bins of a shard's best solution are final; the documents
of the others are dealt anew to fewer shards, until one shard is left.
"""

from __future__ import annotations

import os
import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.blocks import pack as pack_ints
from tidelake.llm.blocks import unpack as unpack_ints
from tidelake.llm.workers import forget, kept
from tidelake.session import cut

CAPACITY = 4096
END_ID = 1
SHARD_ITEMS, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 8192, 2, 2, 4, 12
#: A bin filled to this share is final.
WELL_FILLED = 0.995
#: Bytes of words and ids that a worker remembers and bytes of text taken at a time, about.
REMEMBERED, TAKEN = 24 << 20, 8 << 20
#: Texts given to the tokenizer at a time, words that share one, and what stands between these.
ASKED, SHARED, BETWEEN = 1024, 16, "0"
#: Closing marks.
MARKS = ".,;:!?"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


# ---------------------------------------------------------------- tokens


class _Words:
    """Token ids, as little-endian 32-bit bytes, of each part of a text between spaces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.between,) = self._ids([BETWEEN])[0].tolist()
        #: What is remembered: stems and marks, and the ids of each in the same place.
        self.known = pa.array([], pa.string())
        self.ids = pa.array([], pa.large_binary())
        #: Whether marks behind a letter are tokens of their own.
        self.whole: dict[str, bool] = {}

    def of(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of each of ``words``: those of its stem, then those of the marks behind it.

        Only what is not remembered is encoded. When there is no room left for that, what
        ``words`` do not use is forgotten.
        """
        stems, marks = self._split(words)
        parts = pa.concat_arrays([stems, marks]).dictionary_encode()
        at = pc.index_in(parts.dictionary, value_set=self.known)
        new = parts.dictionary.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy().copy()
        if len(new):
            found = self._encode(new)
            old = at >= 0
            if sum(a.nbytes for a in (self.known, self.ids, new, found)) > REMEMBERED:
                self.known, self.ids = self.known.take(at[old]), self.ids.take(at[old])
                at[old] = np.arange(len(self.known))
            at[~old] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.ids = pa.concat_arrays([self.ids, found])
        place = at[parts.indices.to_numpy()]
        n = len(words)
        behind = np.flatnonzero(pc.not_equal(marks, "").to_numpy(zero_copy_only=False))
        out = self.ids.take(place[:n])
        if not len(behind):
            return out
        both = pc.binary_join_element_wise(
            out.take(behind), self.ids.take(place[n:][behind]), pa.scalar(b"", pa.large_binary())
        )
        order = np.arange(n)
        order[behind] = n + np.arange(len(behind))
        return pa.concat_arrays([out, both]).take(order)

    def _split(self, words: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
        """The letters before closing marks and the marks, or whole words and nothing.

        Letters and the marks after them are tokens of their own if the letters still end
        in a letter once they are normalised (a few come apart into a letter and an accent,
        which is a mark like those behind it). Letters of a-z have the tokens of their
        capitals, so these are remembered and encoded once.
        """
        stems = pc.ascii_rtrim(words, characters=MARKS)
        last = pc.utf8_slice_codeunits(stems, -1)
        ends = [c for c in last.unique().to_pylist() if self._is_whole(c)]
        apart = pc.and_(pc.utf8_is_alpha(stems), pc.is_in(last, value_set=pa.array(ends, pa.string())))
        stems = pc.if_else(pc.string_is_ascii(stems), pc.ascii_lower(stems), stems)
        stems = pc.if_else(apart, stems, words)
        sizes = pc.binary_length(stems).to_numpy()
        cut_off = np.flatnonzero(sizes < pc.binary_length(words).to_numpy())
        marks = np.full(len(words), "", object)
        marks[cut_off] = [
            w[len(w.rstrip(MARKS)) :] for w in words.take(pa.array(cut_off)).to_pylist()
        ]
        return stems, pa.array(marks, pa.string())

    def _is_whole(self, letter: str) -> bool:
        if letter not in self.whole:
            apart, together = (self._ids(t)[0].tolist() for t in ([letter, "."], [letter + "."]))
            self.whole[letter] = apart == together
        return self.whole[letter]

    def _encode(self, parts: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of each part. Parts share calls, as a call costs more than a part.

        ``BETWEEN`` ends each of these: it is one token of its own and in none of them.
        """
        alone = pc.match_substring(parts, BETWEEN)
        ask = parts.filter(pc.invert(alone)).to_pylist()
        ids, _ = self._ids(
            [f" {BETWEEN} ".join([*ask[i : i + SHARED], ""]) for i in range(0, len(ask), SHARED)]
        )
        ends = np.flatnonzero(ids == self.between) - np.arange(len(ask))
        found = [_binary(ids[ids != self.between], ends)]
        found.append(_binary(*self._ids(parts.filter(alone).to_pylist())))
        order = np.argsort(alone.to_numpy(zero_copy_only=False), kind="stable")
        return pa.concat_arrays(found).take(np.argsort(order))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where those of each end."""
        ids, ends = array("I"), []
        for i in range(0, len(texts), ASKED):
            some = texts[i : i + ASKED]
            for encoding in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
                ids.extend(encoding.ids)
                ends.append(len(ids))
        return np.array(ids, "<u4"), np.array(ends, np.int64)


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    offsets = 4 * np.append(0, ends)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(ids)]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), buffers)


def _encoded(path: str, texts: pa.StringArray | list[str]) -> list[bytes]:
    """Ids of each text: the tokenizer drops white space and never merges across it."""
    texts = pc.fill_null(pa.array(texts, pa.string()), "")
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    words = parts.flatten().dictionary_encode()
    each = kept("packing", path, _Words).of(words.dictionary).take(words.indices)
    _, ends, data = each.buffers()
    if data is None:
        return [b""] * len(texts)
    ends = np.frombuffer(ends, np.int64, len(each) + 1, 8 * each.offset)
    edges = ends[parts.offsets.to_numpy()].tolist()
    return [data[a:b].to_pybytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _taken(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of ``TAKEN`` bytes of text and the text that passes that, about."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // TAKEN
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True
) -> DataFrame:
    """Every text as token ids and ``end_id``, cut into pieces of at most ``capacity``.

    Only longer ones are cut, so only last pieces are short. A null or empty text is its
    end alone. ``ids`` (little-endian 32-bit) is null unless asked for. A null id stays
    null; repeated rows are cut each. Other columns are not read.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _taken(whole)):
            texts = _encoded(path, batch.column("text"))
            rows = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                data += end
                for n, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    kept = part if ids else None
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part), kept))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    [x.split()[0] for x in _PIECES.split(",")],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, _PIECES)


# ---------------------------------------------------------------- the algorithm


class Packing:
    """One solution: the bins, and how much each has left."""

    def __init__(self, capacity: int, bins: list[list[int]], free: list[int]):
        self.capacity, self.bins, self.free = capacity, bins, free

    def best_fit(self, items: list[int], sizes: list[int]) -> Packing:
        """Put ``items`` one by one into the fullest bin that takes each, or a new one."""
        order = sorted((f << 32) | b for b, f in enumerate(self.free))
        for i in items:
            at = bisect_left(order, sizes[i] << 32)
            if at < len(order):
                b = order.pop(at) & 0xFFFFFFFF
            else:
                b = len(self.bins)
                self.bins.append([])
                self.free.append(self.capacity)
            self.bins[b].append(i)
            self.free[b] -= sizes[i]
            insort(order, (self.free[b] << 32) | b)
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then uneven ones: full bins leave the others room."""
        return -len(self.bins), sum((self.capacity - f) ** 2 for f in self.free)

    def places(self, n: int) -> list[int]:
        out = [0] * n
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out


def cross(taker: Packing, giver: Packing, sizes: list[int], rng: random.Random) -> Packing:
    """Inject well-filled bins of ``giver``, drop duplicates, best-fit what is displaced."""
    ranked = sorted(range(len(giver.bins)), key=giver.free.__getitem__)
    best = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(best, max(1, len(best) // rng.choice((3, 6, 12))))
    injected = {i for b in chosen for i in giver.bins[b]}
    place = taker.places(len(sizes))
    hit = {place[i] for i in injected}
    # A few of the emptiest bins are given up as well, as mutation.
    hit.update(sorted(range(len(taker.bins)), key=taker.free.__getitem__)[-rng.randint(1, 8) :])
    displaced = [i for b in hit for i in taker.bins[b] if i not in injected]
    bins = [list(giver.bins[b]) for b in chosen]
    free = [giver.free[b] for b in chosen]
    for b in range(len(taker.bins)):
        if b not in hit:
            bins.append(list(taker.bins[b]))
            free.append(taker.free[b])
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return Packing(taker.capacity, bins, free).best_fit(displaced, sizes)


def evolve(
    sizes: list[int], capacity: int, seed: int, guests: list[list[int]], generations: int
) -> list[int]:
    """The bin of every item, in the best solution of one island.

    ``guests`` are the elites of the islands, as bins of all items. An island stops when
    it has as few bins as the sizes allow at all.
    """
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    least = -(-sum(sizes) // capacity)
    population = []
    for places in guests:
        bins: list[list[int]] = [[] for _ in range(max(places) + 1)]
        for i, b in enumerate(places):
            bins[b].append(i)
        free = [capacity - sum(sizes[i] for i in b) for b in bins]
        population.append(Packing(capacity, bins, free))
    while len(population) < POPULATION:
        # Best fit by falling size, each next one with more disorder among like sizes.
        blur = 1 + 0.15 * len(population) * (1 if population else 0)
        items = sorted(order, key=lambda i: -sizes[i] * rng.uniform(1, blur))
        population.append(Packing(capacity, [], []).best_fit(items, sizes))
        if len(population[-1].bins) == least:
            break
    best = max(population, key=Packing.fitness)
    for _ in range(generations):
        if len(best.bins) == least or len(population) < 2:
            break
        population.sort(key=Packing.fitness, reverse=True)
        children = [
            cross(*rng.sample(population[: max(2, len(population) // 2 + 1)], 2), sizes, rng)
            for _ in range(2)
        ]
        population = population[: POPULATION - 2] + children
        best = max(best, *children, key=Packing.fitness)
    return best.places(len(sizes))


# ---------------------------------------------------------------- islands


def _pack_shard(items: DataFrame, capacity: int, shards: int, seed: int) -> DataFrame:
    """Best solution of every shard: rows (shard, rows, sizes, places), packed."""
    shard_schema = "shard long, rows binary, sizes binary"

    def gather(table: pa.Table) -> pa.Table:
        forget()  # the texts are encoded by now
        order = np.argsort(table.column("row").to_numpy())
        rows, sizes = (table.column(c).to_numpy()[order] for c in ("row", "length"))
        return pa.table(
            {
                "shard": table.column("shard")[:1],
                "rows": pa.array([pack_ints(rows.astype(np.uint64))], pa.binary()),
                "sizes": pa.array([pack_ints(sizes.astype(np.uint64))], pa.binary()),
            }
        )

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(shards)))
    gathered = dealt.select("shard", "row", "length").groupBy("shard").applyInArrow(
        gather, shard_schema
    )
    islands = gathered.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    islands = islands.withColumn("guests", F.array().cast("array<binary>"))
    for epoch in range(EPOCHS):

        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    sizes = unpack_ints(row["sizes"]).astype(int).tolist()
                    guests = [unpack_ints(g).astype(int).tolist() for g in row["guests"]]
                    own = (row["shard"] * ISLANDS + row["island"]) * EPOCHS + epoch
                    places = evolve(sizes, capacity, own, guests, GENERATIONS)
                    out.append(pack_ints(np.array(places, np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("shard", "island", "rows", "sizes")),
                     pa.array(out, pa.binary())],
                    ["shard", "island", "rows", "sizes", "places"],
                )

        spread = islands.repartition("shard", "island")
        evolved = cut(spread.mapInArrow(run, "shard long, island int, rows binary, sizes binary, places binary"))
        if epoch < EPOCHS - 1:
            elites = evolved.groupBy("shard").agg(F.collect_list("places").alias("guests"))
            islands = evolved.drop("places").join(elites, "shard")

    def choose(table: pa.Table) -> pa.Table:
        """The best of a shard's few islands."""
        rows = sorted(table.to_pylist(), key=lambda r: r["island"])
        sizes = unpack_ints(rows[0]["sizes"]).astype(np.int64)

        def merit(row: dict) -> tuple[int, int]:
            filled = np.bincount(unpack_ints(row["places"]).astype(np.int64), sizes)
            return -len(filled), int((filled**2).sum())

        best = max(rows, key=merit)
        return pa.Table.from_pylist(
            [{k: best[k] for k in ("shard", "rows", "sizes", "places")}],
            pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("rows", "sizes", "places"))]),
        )

    return evolved.groupBy("shard").applyInArrow(choose, shard_schema + ", places binary")


def _placed(solved: DataFrame, capacity: int, round_no: int, last: bool) -> DataFrame:
    """Rows (row, length, sequence_id, offset); without a sequence where a bin is dissolved."""
    schema = "row long, length long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for r in batch.to_pylist():
                rows, sizes, places = (
                    unpack_ints(r[c]).astype(np.int64) for c in ("rows", "sizes", "places")
                )
                order = np.lexsort((rows, places))
                rows, sizes, places = rows[order], sizes[order], places[order]
                before = np.cumsum(sizes) - sizes
                first = np.append(True, places[1:] != places[:-1])
                offset = before - before[first][np.cumsum(first) - 1]
                filled = np.bincount(places, sizes)
                final = last | (filled[places] >= WELL_FILLED * capacity)
                sequence = (round_no << 56) + (r["shard"] << 16) + places
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows),
                        pa.array(sizes),
                        pa.array(sequence, mask=~final),
                        pa.array(offset, mask=~final),
                    ],
                    ["row", "length", "sequence_id", "offset"],
                )

    return solved.mapInArrow(run, schema)


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``row, sequence_id, offset`` for items (``row`` unique, ``length`` up to capacity)."""
    full = items.filter(F.col("length") == capacity).select(
        "row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    left = items.filter(F.col("length") < capacity).select("row", "length")
    done = [full]
    shards_before, round_no = None, 0
    while n := left.count():
        shards = -(-n // SHARD_ITEMS)
        # One shard ends it; so does a round that has not made them fewer.
        last = shards == 1 or shards == shards_before
        solved = _pack_shard(left, capacity, shards, round_no)
        placed = cut(_placed(solved, capacity, round_no, last))
        done.append(placed.filter("sequence_id is not null").drop("length"))
        left = placed.filter("sequence_id is null").select("row", "length")
        shards_before, round_no = shards, round_no + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``, gapless from 0.

    An empty table packs into nothing; see ``pieces`` for nulls and repeated rows. Items of
    equal length are told apart by their place in the stored table of pieces.
    """
    made = pieces(docs, path, capacity, end_id, ids)
    stored = cut(made.withColumn("row", F.monotonically_increasing_id()))
    return stored.join(place(stored, capacity), "row").drop("row")
