"""WARC archives with a two-level capture index.

Archives hold one gzip member per record, so a record can be read alone by its place. The
index sorts captures by reversed-host URL key and page, writes them in compressed blocks,
and keeps a sparse directory of the first key of every block. A look-up searches the
directory, reads the one block by its byte range, searches it, and then reads the record
by its byte range.

Archives, blocks and directory lie in a folder that all executors reach, by any scheme
that ``pyarrow.fs`` knows. A file is named in the tables stored beside it only by the task
that finished, so what a lost executor leaves behind is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.session import cut, new_dir

#: Captures in a block at least, and blocks at most: the directory stays small at any size.
BLOCK_LINES, BLOCKS = 3000, 65_536
#: Records that a task reads, about.
READ_ROWS = 50_000
#: Payloads of fewer bytes are never replaced by a revisit.
REVISIT_BYTES = 0
_CAPTURES = "row long, page_id long, url string, surt string, file string, offset long, length long"


# ---------------------------------------------------------------- files


def _filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))


class _Reader:
    """Byte ranges of files, keeping the last file open."""

    def __init__(self, folder: str):
        self.fs, self.root = _filesystem(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.root}/{name}")
        return self.file.read_at(length, offset)


def _create(folder: str, kind: str):
    """A new file that no other task or attempt writes; its name and stream."""
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    name = f"{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
    return name, fs.open_output_stream(f"{root}/{name}", compression=None)


# ---------------------------------------------------------------- records


def surt(url: str) -> Column:
    """Reversed-host key of a URL column: com,example,www)/path?query, in lower case."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(text, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    path = F.substr(rest, F.length(host) + 1)
    return F.concat(F.concat_ws(",", F.reverse(F.split(bare, r"\."))), F.lit(")"), path)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(row: dict) -> bytes:
    """One record as a gzip member. A revisit has no payload, but names its response."""
    payload = (row["html"] or "").encode()
    headers = [
        ("WARC-Type", row["kind"]),
        ("WARC-Record-ID", f"<urn:page:{row['row']}>"),
        ("WARC-Page-ID", "" if row["page_id"] is None else str(row["page_id"])),
        ("WARC-Target-URI", json.dumps(row["url"] or "")[1:-1]),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + _digest(payload)),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if row["kind"] == "revisit":
        headers += [
            ("WARC-Refers-To", f"<urn:page:{row['to_row']}>"),
            ("WARC-Refers-To-Page-ID", str(row["to_page"])),
            ("WARC-Refers-To-Payload-Length", str(len(payload))),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
        payload = b""
    headers.append(("Content-Length", str(len(payload))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return gzip.compress(head.encode() + payload + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises ValueError where it is damaged."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return headers, rest[:size]


def classify(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages with ``row`` (unique), ``kind``, and for revisits ``to_page`` and ``to_row``.

    Of pages with equal payloads of ``least`` bytes or more, that with the largest id is
    the response. A null id comes before all; among rows that share an id, the last in
    storage is the response.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    payload = F.coalesce("html", F.lit(""))
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).withColumns(
        {"hash": F.sha2(payload, 256), "size": F.octet_length(payload)}
    )
    # Stored, so that rows keep their numbers; in a tight encoding, as it is all payloads.
    path = new_dir(pages.sparkSession, "pages")
    numbered.write.option("compression", "zstd").parquet(path)
    numbered = pages.sparkSession.read.schema(numbered.schema).parquet(path)
    last = (
        numbered.filter(F.col("size") >= least)
        .groupBy("hash")
        .agg(F.max(F.struct("page_id", "row")).alias("last"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    joined = numbered.join(last, "hash", "left")
    revisit = F.col("last.row").isNotNull() & (F.col("last.row") != F.col("row"))
    return joined.select(
        "row",
        "page_id",
        "url",
        "html",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("last.page_id")).alias("to_page"),
        F.when(revisit, F.col("last.row")).alias("to_row"),
        surt("url").alias("surt"),
    )


def write(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Write archives of all pages; the stored captures, a row for each record.

    Null payloads are empty. An empty table writes no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, offset = None, None, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if stream is None:
                    name, stream = _create(folder, "archive")
                member = _record(row)
                stream.write(member)
                rows.append(
                    (row["row"], row["page_id"], row["url"], row["surt"], name, offset, len(member))
                )
                offset += len(member)
            if rows:
                yield _batch(rows, _CAPTURES)
        if stream is not None:
            stream.close()

    return cut(classify(pages, least).mapInArrow(run, _CAPTURES))


_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(",")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)],
        [n for n, _ in fields],
    )


# ---------------------------------------------------------------- the index


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the captures as sorted, compressed blocks; the stored directory of blocks."""
    schema = "first_surt string, first_row long, file string, offset long, length long, n long"
    lines_of_block = max(BLOCK_LINES, captures.count() // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, offset, lines, entries = None, None, 0, [], []

        def close_block() -> None:
            nonlocal name, stream, offset
            if stream is None:
                name, stream = _create(folder, "index")
            block = gzip.compress("\n".join(map(json.dumps, lines)).encode(), 6, mtime=0)
            stream.write(block)
            entries.append((lines[0][0], lines[0][1], name, offset, len(block), len(lines)))
            offset += len(block)
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                lines.append((r["surt"], r["row"], r["file"], r["offset"], r["length"]))
                if len(lines) >= lines_of_block:
                    close_block()
        if lines:
            close_block()
        if stream is not None:
            stream.close()
            yield _batch(entries, schema)

    ordered = captures.select("surt", "row", "file", "offset", "length")
    ordered = ordered.repartitionByRange("surt", "row").sortWithinPartitions("surt", "row")
    return cut(ordered.mapInArrow(run, schema))


class Index:
    """The directory of an index: bounded, and enough to find any block."""

    def __init__(self, folder: str, entries: list[tuple]):
        self.folder = folder
        self.entries = sorted(entries)
        self.keys = [(e[0], e[1]) for e in self.entries]

    @classmethod
    def load(cls, folder: str, directory: DataFrame) -> Index:
        columns = ("first_surt", "first_row", "file", "offset", "length")
        return cls(folder, [tuple(r) for r in directory.select(*columns).collect()])

    def block_of(self, surt_key: str, row: int) -> int:
        return max(0, bisect_right(self.keys, (surt_key, row)) - 1)

    def read_block(self, reader: _Reader, number: int) -> list[list]:
        _, _, name, offset, length = self.entries[number]
        lines = gzip.decompress(reader.read(name, offset, length)).decode().split("\n")
        return [json.loads(line) for line in lines]

    def captures(self, url_key: str) -> list[list]:
        """All captures of one URL key: surt, row, file, offset and length of each."""
        reader, found = _Reader(self.folder), []
        if not self.entries:
            return found
        number = self.block_of(url_key, -1)
        while number < len(self.entries) and self.keys[number][0] <= url_key:
            found += [x for x in self.read_block(reader, number) if x[0] == url_key]
            number += 1
        return found

    def read(self, url_key: str) -> list[tuple[dict[str, str], bytes]]:
        """The records of one URL key, each by its byte range."""
        reader = _Reader(self.folder)
        return [parse(reader.read(*x[2:])) for x in self.captures(url_key)]


def _tasks(rows: DataFrame) -> int:
    """Tasks for reading records: their rows are narrow, but what they stand for is not."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // READ_ROWS)


_LOCATED = "row long, file string, offset long, length long"


def locate(keys: DataFrame, index: Index) -> DataFrame:
    """Where the records of many (``surt``, ``row``) keys lie, by the index."""
    # The directory has a bounded number of blocks, however many captures there are.
    shared = keys.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        reader = _Reader(found.folder)

        @lru_cache(2)
        def block(number: int) -> dict:
            return {(x[0], x[1]): x[2:] for x in found.read_block(reader, number)}

        for batch in batches:
            rows = []
            for key, row in zip(
                batch.column("surt").to_pylist(), batch.column("row").to_pylist(), strict=True
            ):
                rows.append((row, *block(found.block_of(key, row))[key, row]))
            if rows:
                yield _batch(rows, _LOCATED)

    # Neighbours in the index are looked up together, so each block is read about once.
    near = keys.select("surt", "row").repartitionByRange(_tasks(keys), "surt", "row")
    return near.sortWithinPartitions("surt", "row").mapInArrow(run, _LOCATED)


_READ = (
    "row long, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, to_row long"
)


def read_back(located: DataFrame, folder: str) -> DataFrame:
    """Records by their byte ranges: ids, type, size and digest of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                headers, payload = parse(reader.read(r["file"], r["offset"], r["length"]))
                page, kind = headers["WARC-Page-ID"], headers["WARC-Type"]
                own = r["row"], int(page) if page else None
                if kind == "response":
                    digest = _digest(payload)
                    if headers["WARC-Payload-Digest"] != "sha1:" + digest:
                        raise ValueError(f"payload of row {r['row']} does not match its digest")
                    rows.append((*own, len(payload), digest, kind, None, None))
                else:
                    to = headers["WARC-Refers-To-Page-ID"]
                    rows.append(
                        (
                            *own,
                            int(headers["WARC-Refers-To-Payload-Length"]),
                            headers["WARC-Payload-Digest"].partition(":")[2],
                            kind,
                            int(to) if to != "None" else None,
                            int(headers["WARC-Refers-To"][10:-1]),
                        )
                    )
            if rows:
                yield _batch(rows, _READ)

    near = located.repartitionByRange(_tasks(located), "file", "offset")
    near = near.sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, _READ)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, index them, and read every record back through the index.

    A revisit's size and digest are those that its response was read with. Null payloads
    are empty; null URLs have the key of an empty one; a null id stays null.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    captures = write(pages, folder)
    index = Index.load(folder, write_index(captures, folder))
    read = cut(read_back(cut(locate(captures, index)), folder))
    own = read.filter("record_type = 'response'")
    seen = own.select(
        F.col("row").alias("to_row"),
        F.col("payload_bytes").alias("seen_bytes"),
        F.col("payload_digest").alias("seen_digest"),
    )
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = (
        read.filter("record_type = 'revisit'")
        .drop("payload_bytes", "payload_digest")
        .join(seen, "to_row")
        .withColumnsRenamed({"seen_bytes": "payload_bytes", "seen_digest": "payload_digest"})
    )
    return own.select(*columns).unionByName(revisits.select(*columns))
