"""Documents in compressed blocks, and questions that blocks ask of hashed shards.

Several operators need, for every window or n-gram of every text, something that only the
whole corpus knows. A row per window would cost a hundred times the text, so here a block
of documents is one row, asks each shard of the hash space one question (a packed, sorted
list of keys), and gets one packed answer. The questions of one block never repeat a key
more often than needed, so a passage found in a third of all documents costs a shard one
entry per block. Work and shuffle grow in proportion to the text; nothing is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.workers import forget
from tidelake.session import cut

BLOCK_BYTES = 8 << 20
BLOCK_SCHEMA = "block long, part int, n_docs long, n_bytes long, payload binary"
ASK_SCHEMA = "shard int, block long, part int, keys binary"
ANSWER_SCHEMA = "block long, shard int, kind int, answer binary"
_CHUNK = 1 << 18
_LONG_WORD = 1024
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


# ---------------------------------------------------------------- packed integers


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers as compressed byte planes."""
    values = np.ascontiguousarray(values, np.uint64)
    planes = values.view(np.uint8).reshape(-1, 8).T
    used = max([1, *(i + 1 for i in range(8) if planes[i].any())])
    return bytes([used]) + zstandard.ZstdCompressor(1).compress(planes[:used].tobytes())


def unpack(packed: bytes) -> np.ndarray:
    used = packed[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8)
    out = np.zeros((len(planes) // used, 8), np.uint8)
    out[:, :used] = planes.reshape(used, -1).T
    return out.view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """As ``pack``, for sorted values: their differences are small."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=np.uint64)


# ---------------------------------------------------------------- words and their hashes


class Words:
    """The words of some texts: where they are, and how many each text has."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        data = b"\n".join([t or b"" for t in texts]) + b"\n"
        self.data = data.lower() if lower else data
        self.buffer = np.frombuffer(self.data, np.uint8)
        sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
        word = ~_SEPARATOR[self.buffer]
        edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        begins = np.cumsum(sizes) - sizes
        self.first = np.append(np.searchsorted(self.starts, begins), len(self.starts))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def spans(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and document of every run of ``width`` words inside one document."""
        n = len(self.starts)
        doc = np.repeat(np.arange(len(self.first) - 1), self.counts())
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
        return at, doc[at]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    table = np.full(n, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


_TABLES: dict[int, np.ndarray] = {}


def _table(base: int) -> np.ndarray:
    if base not in _TABLES:
        _TABLES[base] = _powers(base, 2 * _CHUNK + 2)
    return _TABLES[base]


def _span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end], independent of where the span lies."""
    table = _table(base)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * table[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * table[_CHUNK - starts]


def hash_words(words: Words, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word; ``seed`` 0 or 1 gives independent ones."""
    base = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)[seed]
    starts, ends = words.starts, words.ends
    out = np.zeros(len(starts), np.uint64)
    short = np.flatnonzero(ends - starts <= _LONG_WORD)
    short_ends = ends[short]
    place = 0
    while place < len(short):
        begin = starts[short[place]]
        stop = np.searchsorted(short_ends, begin + _CHUNK, side="right")
        some = short[place:stop]
        values = words.buffer[begin : ends[some[-1]]].astype(np.uint64) + np.uint64(1)
        out[some] = _span_sums(values, starts[some] - begin, ends[some] - begin, base)
        place = stop
    for i in np.flatnonzero(ends - starts > _LONG_WORD):
        digest = hashlib.blake2b(words.data[starts[i] : ends[i]], digest_size=16).digest()
        out[i] = np.frombuffer(digest, np.uint64)[seed]
    return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def hash_windows(hashes: np.ndarray, at: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of ``width`` consecutive word hashes, at each given first word."""
    base = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[seed]
    out = np.zeros(len(at), np.uint64)
    step = _CHUNK - width
    for begin in range(0, len(hashes), step):
        lo, hi = np.searchsorted(at, [begin, begin + step])
        if lo < hi:
            here = at[lo:hi] - begin
            out[lo:hi] = _span_sums(hashes[begin : begin + _CHUNK], here, here + width, base)
    return mix(out)


# ---------------------------------------------------------------- blocks of documents


def write_blocks(
    docs: DataFrame, part: str | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Store ``docs`` (``text`` and narrow columns) as rows of about ``block_bytes`` each.

    The integer column ``part`` may deal rows to classes; a block holds one class. Blocks
    keep their ids whatever is computed again later, because they are a stored table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        task, made = TaskContext.get().partitionId(), 0
        open_blocks: dict[int, list] = {}

        def close(cls: int) -> pa.RecordBatch:
            nonlocal made
            rows, size = open_blocks.pop(cls)
            made += 1
            table = pa.Table.from_batches(rows).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            payload = zstandard.ZstdCompressor(3).compress(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(task << 32) + made], pa.int64()),
                    "part": pa.array([cls], pa.int32()),
                    "n_docs": pa.array([table.num_rows], pa.int64()),
                    "n_bytes": pa.array([size], pa.int64()),
                    "payload": pa.array([payload], pa.binary()),
                }
            )

        for batch in batches:
            classes = (
                batch.column(part).to_numpy(zero_copy_only=False)
                if part
                else np.zeros(batch.num_rows, int)
            )
            for cls in np.unique(classes):
                rows = batch.filter(pa.array(classes == cls))
                text = rows.column("text")
                sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
                held = open_blocks.setdefault(int(cls), [[], 0])
                number = (held[1] + np.cumsum(sizes + 16) - 1) // block_bytes
                for n in np.unique(number):
                    lo, hi = np.searchsorted(number, [n, n + 1])
                    if n and int(cls) in open_blocks and open_blocks[int(cls)][0]:
                        yield close(int(cls))
                    held = open_blocks.setdefault(int(cls), [[], 0])
                    held[0].append(rows.slice(lo, hi - lo))
                    held[1] += int(sizes[lo:hi].sum() + 16 * (hi - lo))
        for cls in list(open_blocks):
            yield close(cls)

    return cut(docs.mapInArrow(run, BLOCK_SCHEMA))


def open_block(payload: bytes) -> pa.Table:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    return pa.ipc.open_stream(raw).read_all()


def texts_of(table: pa.Table) -> list[bytes | None]:
    return table.column("text").cast(pa.binary()).to_pylist()


def total_bytes(blocks: DataFrame) -> int:
    return int(blocks.agg(F.sum("n_bytes")).first()[0] or 0)


# ---------------------------------------------------------------- questions and answers


def _table_of(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.table(arrays, names=names)


def ask(
    blocks: DataFrame,
    question: Callable[[int, int, pa.Table, dict], Iterable[tuple[int, bytes]]],
    answers: DataFrame | None = None,
) -> DataFrame:
    """What each block asks of the shards: rows (shard, block, part, keys).

    ``question(block, part, table, got)`` yields (shard, packed keys); ``got`` holds the
    answers to earlier questions by (kind, shard).
    """
    names = ["shard", "block", "part", "keys"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def rows(block: int, part: int, payload: bytes, got: dict) -> pa.Table:
        asked = question(block, part, open_block(payload), got)
        return _table_of([(s, block, part, k) for s, k in asked], names, kinds)

    if answers is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in batches:
                for block, part, payload in zip(
                    *(batch.column(c).to_pylist() for c in ("block", "part", "payload")),
                    strict=True,
                ):
                    yield from rows(block, part, payload, {}).to_batches()

        return blocks.select("block", "part", "payload").mapInArrow(run, ASK_SCHEMA)

    return with_answers(blocks, answers, rows, ASK_SCHEMA)


def answer(
    asked: DataFrame,
    reply: Callable[[list[int], list[int], list[bytes]], Iterable[tuple[int, bytes]]],
    kind: int = 0,
) -> DataFrame:
    """Answers of every shard, stored: rows (block, shard, kind, answer).

    ``reply(blocks, parts, keys)`` yields (index of the question, packed answer). A shard
    holds a bounded share of the hash space, so it fits in a task. An index of -1 answers
    no block; such rows have block -1 and carry what the shard found out as a whole.
    """
    names = ["block", "shard", "kind", "answer"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(table: pa.Table) -> pa.Table:
        forget()
        shard = table.column("shard")[0].as_py()
        blocks, parts = table.column("block").to_pylist(), table.column("part").to_pylist()
        answers = reply(blocks, parts, table.column("keys").to_pylist())
        rows = [(blocks[i] if i >= 0 else -1, shard, kind, a) for i, a in answers]
        return _table_of(rows, names, kinds)

    return cut(asked.groupBy("shard").applyInArrow(run, ANSWER_SCHEMA))


def with_answers(
    blocks: DataFrame,
    answers: DataFrame,
    work: Callable[[int, int, bytes, dict], pa.Table],
    schema: str,
) -> DataFrame:
    """``work(block, part, payload, answers by (kind, shard))`` for every block."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        forget()
        got = {
            (k, s): a
            for k, s, a in zip(
                *(right.column(c).to_pylist() for c in ("kind", "shard", "answer")), strict=True
            )
        }
        made = [
            work(block, part, payload, got)
            for block, part, payload in zip(
                *(left.column(c).to_pylist() for c in ("block", "part", "payload")), strict=True
            )
        ]
        return pa.concat_tables(made).select(names) if made else None

    def run_or_empty(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        return out if out is not None else _empty(schema)

    narrow = blocks.select("block", "part", "payload")
    return narrow.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run_or_empty, schema
    )


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
}


def _empty(schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(",")]
    return pa.schema([(n, _ARROW[k]) for n, k in fields]).empty_table()


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the high 32 bits, so that sorted keys are sorted by shard as well."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The slices of sorted ``keys`` that belong to each shard."""
    edges = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    for s in range(shards):
        if edges[s] < edges[s + 1]:
            yield s, slice(edges[s], edges[s + 1])
