"""Compression of vectors to codes: product quantisation with exact integer k-means.

A vector is cut into equal parts, and each part is replaced by the number of the nearest
entry of a codebook of its position. Vectors lie in stored chunks; in a chunk every part
position has its own order, that of a Hilbert curve, cut into flat blocks of near vectors
with a box (least and largest of each component) and sums. Each round compares entries with
boxes: an entry whose least distance to a box exceeds another's largest cannot be nearest to
anything in it. What is left is the block's shortlist. A block with one entry gives its sums
as they are; the others go through a small kernel over the shortlist alone.

All values are whole numbers, so neither order nor grouping of rows changes any result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.session import cut

PARTS, ENTRIES, ROUNDS, FACTOR = 8, 16, 6, 4096
#: Vectors of a stored chunk, and of a block.
CHUNK_ROWS, BLOCK_ROWS = 16_384, 64
#: Bits of the Hilbert index for each component, where it has few of them.
CURVE_BITS = 8
#: Whole numbers are held within this, so that their differences are 64-bit numbers.
LARGEST = 1 << 62
_DECIMAL = pa.decimal128(38, 0)
_CHUNKS = "dim int, n long, payload binary"


# ---------------------------------------------------------------- numbers


def finite(column: str = "embedding") -> Column:
    """The vector as doubles; null where it is null or holds null or non-finite components."""
    vector = F.col(column).cast("array<double>")
    broken = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.when(~broken, vector)


def whole(values: np.ndarray, factor: int = FACTOR) -> np.ndarray:
    """floor(factor * x), kept within ``LARGEST`` on both sides."""
    scaled = np.floor(factor * np.asarray(values, np.float64))
    inside = np.clip(scaled, -float(LARGEST), float(LARGEST))
    return inside.astype(np.int64)


def exact(values: np.ndarray, largest: int, terms: int) -> np.ndarray:
    """As 64-bit integers where sums of ``terms`` squared differences fit, else as Python's."""
    fits = terms * (2 * largest) ** 2 < 1 << 62
    return values.astype(np.int64 if fits else object)


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """Order of integer points along a Hilbert curve over their box.

    By Skilling's transposition (2004). The curve has ``CURVE_BITS`` per component.
    """
    n, dims = points.shape
    low = points.min(axis=0).astype(np.float64)
    width = np.maximum(points.max(axis=0).astype(np.float64) - low, 1)
    top = (1 << CURVE_BITS) - 1
    x = ((points.astype(np.float64) - low) / width * top).astype(np.uint32).T.copy()
    bit = 1 << (CURVE_BITS - 1)
    while bit > 1:
        below = np.uint32(bit - 1)
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below).astype(np.uint32)
            x[0] ^= np.where(on, below, swap).astype(np.uint32)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint32)
    bit = 1 << (CURVE_BITS - 1)
    while bit > 1:
        turn ^= np.where(x[dims - 1] & bit, np.uint32(bit - 1), 0).astype(np.uint32)
        bit >>= 1
    x ^= turn
    planes = [(x[i] >> np.uint32(b)) & 1 for b in range(CURVE_BITS - 1, -1, -1) for i in range(dims)]
    keys = np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)
    return np.lexsort(keys.T[::-1])


# ---------------------------------------------------------------- blocks


class Part:
    """The vectors of a chunk at one part position, in blocks along the curve."""

    def __init__(self, values: np.ndarray, order: np.ndarray):
        self.order, self.values = order, values[order]
        self.begin = np.arange(0, len(order), BLOCK_ROWS)
        self.sizes = np.diff(self.begin, append=len(order))
        self.low = np.minimum.reduceat(self.values, self.begin)
        self.high = np.maximum.reduceat(self.values, self.begin)
        self.largest = int(max(abs(int(self.low.min())), abs(int(self.high.max()))))
        wide = self.values if self.largest * len(order) < 1 << 62 else self.values.astype(object)
        self.sums = np.add.reduceat(wide, self.begin)

    def shortlists(self, book: np.ndarray) -> np.ndarray:
        """Which entries may be nearest to something in each block: (block, entry)."""
        terms, width = book.shape[1], max(self.largest, int(abs(book).max()))
        low, high, book = (exact(a, width, terms) for a in (self.low, self.high, book))
        below = low[:, None] - book[None]
        above = book[None] - high[:, None]
        out = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(abs(below), abs(above))
        least, most = (out * out).sum(axis=2), (far * far).sum(axis=2)
        return least <= most.min(axis=1)[:, None]

    def nearest(self, block: int, book: np.ndarray, entries: np.ndarray) -> tuple:
        """Of a block's vectors the nearest of some entries, ties to the first; and how far."""
        own = self.values[self.begin[block] : self.begin[block] + self.sizes[block]]
        width = max(self.largest, int(abs(book).max()))
        own, some = (exact(a, width, book.shape[1]) for a in (own, book[entries]))
        apart = own[:, None] - some[None]
        far = (apart * apart).sum(axis=2)
        at = np.argmin(far, axis=1)
        return entries[at], far[np.arange(len(own)), at]

    def gather(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors nearest to each entry: their number and component sums."""
        lists = self.shortlists(book)
        counts = np.zeros(len(book), np.int64)
        sums = np.zeros(book.shape, object)
        only = lists.sum(axis=1) == 1
        np.add.at(counts, lists[only].argmax(axis=1), self.sizes[only])
        np.add.at(sums, lists[only].argmax(axis=1), self.sums[only].astype(object))
        for block in np.flatnonzero(~only).tolist():
            at, _ = self.nearest(block, book, np.flatnonzero(lists[block]))
            own = self.values[self.begin[block] : self.begin[block] + self.sizes[block]]
            wide = own.astype(self.sums.dtype)
            for e in np.unique(at).tolist():
                counts[e] += int((at == e).sum())
                sums[e] += wide[at == e].sum(axis=0)
        return counts, sums

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every vector, and squared distance, in the order of the chunk."""
        lists = self.shortlists(book)
        codes, far = np.zeros(len(self.order), np.uint8), np.zeros(len(self.order), object)
        for block in range(len(self.begin)):
            at, apart = self.nearest(block, book, np.flatnonzero(lists[block]))
            rows = self.order[self.begin[block] : self.begin[block] + self.sizes[block]]
            codes[rows], far[rows] = at, apart
        return codes, far


def _stored(batch: pa.Table, dim: int) -> dict:
    """A chunk as one row: narrow columns, whole numbers in few bytes, and the orders."""
    vectors = batch.column("vector").combine_chunks().flatten().to_numpy()
    values = whole(vectors.reshape(batch.num_rows, dim))
    kind = next(k for k in ("i2", "i4", "i8") if abs(values).max() <= np.iinfo(k).max)
    width = dim // PARTS
    place = "u2" if batch.num_rows <= 1 << 16 else "u4"
    orders = [hilbert_order(values[:, p * width : (p + 1) * width]) for p in range(PARTS)]
    table = pa.table(
        {
            "vec_id": batch.column("vec_id"),
            "label": batch.column("label"),
            "values": pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(dim * int(kind[1])), batch.num_rows, [None, pa.py_buffer(values.astype(kind).tobytes())]
            ),
            "orders": pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(PARTS * int(place[1])),
                batch.num_rows,
                [None, pa.py_buffer(np.stack(orders, axis=1).astype(place).tobytes())],
            ),
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return {"dim": dim, "n": batch.num_rows, "payload": sink.getvalue().to_pybytes()}


def _open(payload: bytes, dim: int) -> tuple[pa.Table, list[Part]]:
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    kinds = [table.schema.field(c).type.byte_width for c in ("values", "orders")]
    values, orders = (
        np.frombuffer(b"".join(table.column(c).to_pylist()), f"{k}{w // n}").reshape(-1, n)
        for c, k, w, n in (("values", "i", kinds[0], dim), ("orders", "u", kinds[1], PARTS))
    )
    values, width = values.astype(np.int64), dim // PARTS
    return table, [
        Part(values[:, p * width : (p + 1) * width], orders[:, p].astype(np.int64)) for p in range(PARTS)
    ]


def chunks(vectors: DataFrame) -> DataFrame:
    """Store ``vec_id, label, vector`` as rows of about ``CHUNK_ROWS`` vectors of one size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        total = 0

        def close() -> Iterator[pa.RecordBatch]:
            rows = [_stored(pa.concat_tables(t), dim) for dim, t in sorted(held.items())]
            held.clear()
            schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])
            yield from pa.Table.from_pylist(rows, schema).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = table.column("vector").combine_chunks().value_lengths().to_numpy()
            for lo in range(0, len(sizes), CHUNK_ROWS):
                for dim in np.unique(sizes[lo : lo + CHUNK_ROWS]).tolist():
                    own = table.slice(lo, CHUNK_ROWS).filter(pa.array(sizes[lo : lo + CHUNK_ROWS] == dim))
                    held.setdefault(dim, []).append(own)
                    total += own.num_rows
                if total >= CHUNK_ROWS:
                    yield from close()
                    total = 0
        yield from close()

    return cut(vectors.select("vec_id", "label", "vector").mapInArrow(run, _CHUNKS))


# ---------------------------------------------------------------- rounds

_BOOK = "dim int, part int, entry int, n long, sums array<decimal(38,0)>"


def _books(row: dict) -> list[np.ndarray]:
    """A codebook for each part position, as whole numbers."""
    return [
        np.array([[int(x) for x in e["values"]] for e in part["entries"]], np.int64)
        for part in sorted(row["books"], key=lambda b: b["part"])
    ]


def first_books(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """``dim, books``: of each vector size the parts of the vectors with the smallest ids."""
    by_id = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    limit = F.lit(float(LARGEST))
    number = lambda x: F.floor(F.greatest(F.least(F.floor(x * FACTOR + F.lit(0.0)), limit), -limit))
    some = (
        vectors.withColumn("dim", F.size("vector"))
        .withColumn("entry", F.row_number().over(by_id) - 1)
        .filter(F.col("entry") < ENTRIES)
        .select("dim", "entry", F.transform("vector", lambda x: number(x).cast("long")).alias("v"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )
    width = (F.col("dim") / parts).cast("int")
    piece = F.slice("v", F.col("part") * width + 1, width)
    return _together(some.select("dim", "part", "entry", piece.alias("values")))


def _together(entries: DataFrame) -> DataFrame:
    """Entries (dim, part, entry, values) as one row for each size: bounded by its books."""
    parts = entries.groupBy("dim", "part").agg(
        F.sort_array(F.collect_list(F.struct("entry", "values"))).alias("entries")
    )
    return cut(parts.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("part", "entries"))).alias("books")))


def _round(stored: DataFrame, books: DataFrame) -> DataFrame:
    """The codebooks after one round over all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                _, parts = _open(row["payload"], row["dim"])
                for p, (part, book) in enumerate(zip(parts, _books(row), strict=True)):
                    counts, sums = part.gather(book)
                    found += [
                        (row["dim"], p, e, int(counts[e]), [Decimal(int(x)) for x in sums[e]])
                        for e in range(len(book))
                        if counts[e]
                    ]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(_DECIMAL)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)],
                    [x.split()[0] for x in ("dim", "part", "entry", "n", "sums")],
                )

    met = stored.join(books, "dim").select("dim", "payload", "books")
    # One row per entry and chunk; components apart, so that sums are plain aggregates.
    own = met.mapInArrow(run, _BOOK).select("dim", "part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
    sums = own.groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    # floor(sum / n) by whole numbers: Spark's div drops the fraction towards zero.
    n = F.col("n").cast("decimal(20,0)")
    down = F.when((F.col("sum") < 0) & (F.expr("sum % cast(n as decimal(20,0))") != 0), 1).otherwise(0)
    mean = F.expr("sum div cast(n as decimal(20,0))") - down
    mean = F.when(n > 0, mean.cast("long"))
    means = sums.select("dim", "part", "entry", "at", mean.alias("x")).groupBy("dim", "part", "entry")
    means = means.agg(F.sort_array(F.collect_list(F.struct("at", "x")))["x"].alias("new"))
    old = books.select("dim", F.explode("books").alias("b")).select(
        "dim", "b.part", F.explode("b.entries").alias("e")
    )
    old = old.select("dim", "part", F.col("e.entry").alias("entry"), F.col("e.values").alias("values"))
    joined = old.join(means, ["dim", "part", "entry"], "left")
    return _together(
        joined.select("dim", "part", "entry", F.coalesce("new", "values").alias("values"))
    )


def train(stored: DataFrame, books: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Codebooks after ``rounds`` rounds; an entry that is nearest to nothing stays."""
    for _ in range(rounds):
        books = _round(stored, books)
    return books


def book_digest() -> Column:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    numbers = F.flatten(F.flatten(F.transform("books", lambda b: b["entries"]["values"])))
    return F.sha2(F.array_join(numbers.cast("array<string>"), ","), 256)


def encode(stored: DataFrame, books: DataFrame) -> DataFrame:
    """``vec_id, label, code, error, codebooks_sha256`` of every stored vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table, parts = _open(row["payload"], row["dim"])
                codes, error = [], np.zeros(table.num_rows, object)
                for part, book in zip(parts, _books(row), strict=True):
                    code, far = part.assign(book)
                    codes.append(code)
                    error += far
                text = np.stack(codes, axis=1).tobytes().hex()
                size = 2 * PARTS
                error = [min(int(e), (1 << 63) - 1) for e in error]
                yield from pa.table(
                    {
                        "vec_id": table.column("vec_id"),
                        "label": table.column("label"),
                        "code": pa.array([text[i : i + size] for i in range(0, len(text), size)]),
                        "error": pa.array(error, pa.int64()),
                        "codebooks_sha256": pa.array([row["digest"]] * table.num_rows),
                    }
                ).to_batches()

    met = stored.join(books.withColumn("digest", book_digest()), "dim")
    schema = "vec_id long, label string, code string, error long, codebooks_sha256 string"
    return met.select("dim", "payload", "books", "digest").mapInArrow(run, schema)


def compress(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every usable vector.

    ``vectors`` has ``vec_id``, ``label`` and ``vector`` (array of double, see ``finite``).
    Rows without a vector take no part, nor do those whose size is no multiple of the number
    of parts, as they have no equal parts. Vectors of each other size have codebooks and a
    digest of their own. Rows that share an id are coded each; those without an id begin no
    codebook unless there are too few others. Components beyond 2^62 after scaling are held
    there, and an error beyond 64 bits is the largest 64-bit number, as are sums of labels.
    Errors are summed over equal labels, nulls together. An empty table gives no rows.
    """
    rows = vectors.filter(F.col("vector").isNotNull() & (F.size("vector") > 0))
    rows = rows.filter(F.size("vector") % PARTS == 0).select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"), "vector"
    )
    stored = chunks(rows)
    books = train(stored, first_books(rows))
    coded = cut(encode(stored, books))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal((1 << 63) - 1)))
    labels = cut(coded.groupBy("label").agg(total.cast("long").alias("label_error")))
    named = labels.select(F.col("label").alias("same"), "label_error")
    joined = coded.join(named, F.col("label").eqNullSafe(F.col("same")))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
