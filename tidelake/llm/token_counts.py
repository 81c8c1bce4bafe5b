"""Token counts of whole texts, by a two-tier table of pre-token lengths.

Pieces of the vocabulary never go on after a space that follows something else, so a text
is cut there and its count is the sum over the cuts. Tier one is a compact table of the
most frequent pre-tokens and their lengths, made once and broadcast; it has a fixed number
of entries. Tier two is a bounded cache in every worker, filled by the tokenizer itself.
Neither changes a count, and no pre-token is ever shuffled: what finds the frequent ones
is a bounded summary for each partition, merged as a tree.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the broadcast table, of a partition's summary, and of a worker's cache.
FREQUENT, SUMMARY, CACHED = 32_768, 65_536, 400_000
#: Pre-tokens of more characters are counted each time and not kept.
LONGEST = 64
_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_RUN = re.compile(" *[^ ]+| +")
_MODELS: dict[str, sentencepiece.SentencePieceProcessor] = {}
_CACHES: dict[tuple, dict] = {}


def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _MODELS:
        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def pretokens(text: str) -> list[str]:
    """The text cut before every run of spaces; a leading space is left off each.

    The tokenizer puts a space before what it encodes and treats U+2581 as a space, so a
    pre-token without its first space has the tokens it has inside the text.
    """
    if not text:
        return []
    if "\u2581" in text:
        text = text.replace("\u2581", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [p[1:] for p in _RUN.findall(" " + text)]


def _prune(counts: Counter, size: int) -> Counter:
    return Counter(dict(counts.most_common(size))) if len(counts) > size else counts


def frequent(docs: DataFrame, size: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all texts, nearly: summaries keep a bounded number."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(pretokens(text or ""))
                if len(counts) > 8 * SUMMARY:
                    counts = _prune(counts, SUMMARY)
        yield pa.RecordBatch.from_pydict({"summary": [_dump(_prune(counts, SUMMARY // 4))]})

    def merge(a: bytes, b: bytes) -> bytes:
        return _dump(_prune(_load(a) + _load(b), SUMMARY))

    # The tree is as deep as it takes for no task, the driver included, to merge many.
    rows = docs.select("text").mapInArrow(summarise, "summary binary").rdd
    merged = rows.map(lambda row: bytes(row.summary)).treeReduce(
        merge, depth=2 if rows.getNumPartitions() < 1000 else 4
    )
    return [p for p, n in _load(merged).most_common(size) if n > 1 and len(p) <= LONGEST]


def _dump(counts: Counter) -> bytes:
    return zstandard.ZstdCompressor(1).compress(pickle.dumps(dict(counts)))


def _load(packed: bytes) -> Counter:
    return Counter(pickle.loads(zstandard.ZstdDecompressor().decompress(packed)))


class _Lengths(dict):
    """Number of tokens by pre-token: the broadcast table, and what the worker adds."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.model, self.table = _model(path), table

    def __missing__(self, piece: str) -> int:
        # An empty one was a single space, which is a token.
        n = len(self.model.encode(piece, num_threads=1)) if piece else 1
        if len(piece) <= LONGEST:
            if len(self) >= len(self.table) + CACHED:
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


def count(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Null and empty texts have no bytes and no tokens. A null id stays null; repeated rows
    are counted each. Texts of any length are taken whole. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = frequent(rows)
    model = _model(path)
    table = {p: len(model.encode(p, num_threads=1)) for p in pieces if p}
    shared = docs.sparkSession.sparkContext.broadcast(_dump(Counter(table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, hash(shared.value))
        if key not in _CACHES:
            _CACHES.clear()
            _CACHES[key] = _Lengths(path, _load(shared.value))
        get = _CACHES[key].__getitem__
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = [sum(map(get, pretokens(t))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens]),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, _SCHEMA)
