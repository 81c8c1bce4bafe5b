"""A mutable table over Parquet: immutable versions, rewritten one date at a time.

Parquet has no delete or merge. A commit writes new rows, and rewrites only the dates
that hold changed keys; then it publishes a manifest that says which versions make up
each date::

    root/data/__v=N-<attempt>/year=YYYY/month=MM/day=DD/*.parquet
    root/manifest/v<N>.json     the live dates and which attempts' folders hold them

Every attempt writes a folder of its own, and its manifest aside; publishing is one rename
that fails if the version exists. So a losing writer or a crash leaves files that no
manifest names, and neither harms what is published nor stands in the way of the next
commit. A reader uses one manifest from start to end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.entities import last_change, patch
from tidelake.operators.ingest import REMOVE, with_partitions
from tidelake.session import cut
from tidelake.sources.feeds import CHANGE_ORDER
from tidelake.sources.files import TableSpec, empty_frame, scan, write_lake
from tidelake.specs import PARTITIONS

Day = tuple[str, str, str]


@dataclass(frozen=True)
class Manifest:
    """Which folders make up each live date, and the last numbered batch of each source.

    ``sizes`` says how many dates each of those folders has.
    """

    version: int
    batches: dict[str, int]
    days: dict[Day, tuple[str, ...]]
    sizes: dict[str, int]


class LakeTable:
    """One entity or relation table."""

    def __init__(self, spark: SparkSession, root: str, spec: TableSpec):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec

    # -- files ---------------------------------------------------------------

    def _glob(self, pattern: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [str(s.getPath().toString()) for s in (fs.globStatus(path) or [])]

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        return sorted(int(p.split("/v")[-1][:-5]) for p in self._glob("manifest/v*.json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The given manifest, the newest one when left out."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, {}, {}, {})
        path, fs = self._file(f"manifest/v{version:012d}.json")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(
                stream, "UTF-8"
            )
        finally:
            stream.close()
        entry = json.loads(text)
        days = {tuple(day.split("-")): tuple(vs) for day, vs in entry["days"].items()}
        return Manifest(version, entry["batches"], days, entry["sizes"])

    def _file(self, name: str):
        """A path below the root, and the file system it is on."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def _create(self, name: str, text: str) -> None:
        """Put a whole file in place, unless there is one already: then RuntimeError."""
        context = self.spark.sparkContext
        aside, fs = self._file(f"manifest/_aside-{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = fs.makeQualified(self._file(name)[0])
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            fs.getUri(), context._jsc.hadoopConfiguration()
        )
        rename = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
        try:  # a rename without options fails where the target exists
            files.rename(
                fs.makeQualified(aside), target, context._gateway.new_array(rename, 0)
            )
        except Py4JJavaError as taken:
            fs.delete(aside, False)
            raise RuntimeError(f"another writer published {name}") from taken

    def _written(self, version: str) -> set[Day]:
        paths = self._glob(f"data/__v={version}/year=*/month=*/day=*")
        parts = [[piece.split("=")[-1] for piece in p.split("/")[-3:]] for p in paths]
        return {(y, m, d) for y, m, d in parts}

    def _paths(self, base: Manifest, days: dict[Day, tuple[str, ...]]) -> list[str]:
        """Directories to read: a whole folder where every date of it is wanted."""
        by_version: dict[str, set[Day]] = {}
        for day, versions in days.items():
            for v in versions:
                by_version.setdefault(v, set()).add(day)
        paths = []
        for v, wanted in sorted(by_version.items()):
            top = f"{self.root}/data/__v={v}"
            if len(wanted) == base.sizes[v]:
                paths.append(top)
            else:
                paths += [f"{top}/year={y}/month={m}/day={d}" for y, m, d in sorted(wanted)]
        return paths

    # -- reading -------------------------------------------------------------

    def _read(self, base: Manifest, wanted: Callable[[Day], bool], **options) -> DataFrame:
        days = {d: vs for d, vs in base.days.items() if wanted(d)}
        if not days:
            return empty_frame(self.spark, self.spec.schema())
        paths = self._paths(base, days)
        return scan(self.spark, self.spec, paths, base_path=f"{self.root}/data", **options)

    def scan(
        self,
        where: Column | str | None = None,
        years: tuple[int, int] | None = None,
        version: int | None = None,
        days: tuple[str, str] | None = None,
    ) -> DataFrame:
        """Live rows of one version with the declared columns.

        ``days`` is a first and last date as ``YYYY-MM-DD``. It picks directories from the
        manifest, so a short range of a long table does not even list the rest.
        """
        first, last = days or ("", "~")
        return self._read(
            self.manifest(version), lambda d: first <= "-".join(d) <= last, where=where, years=years
        )

    # -- writing -------------------------------------------------------------

    def _publish(
        self,
        base: Manifest,
        rows: DataFrame,
        replaced: Iterable[Day],
        batch: tuple[str, int] | None = None,
    ) -> int:
        """Write ``rows`` as the next version; they replace some dates and extend the others."""
        number = base.version + 1
        version = f"{number}-{uuid.uuid4().hex[:12]}"
        write_lake(rows, self.spec, f"{self.root}/data/__v={version}", mode="errorifexists")
        dropped = set(replaced)
        days = {d: vs for d, vs in base.days.items() if d not in dropped}
        written = self._written(version)
        for day in written:
            days[day] = (*days.get(day, ()), version)
        live = {v for vs in days.values() for v in vs}
        sizes = {v: n for v, n in base.sizes.items() if v in live} | {version: len(written)}
        entry = {
            "batches": base.batches | (dict([batch]) if batch else {}),
            "days": {"-".join(day): vs for day, vs in sorted(days.items())},
            "sizes": sizes,
        }
        self._create(f"manifest/v{number:012d}.json", json.dumps(entry))
        return number

    def _rewrite(
        self,
        base: Manifest,
        touched: set[Day],
        change: Callable[[DataFrame], DataFrame],
        batch: tuple[str, int] | None = None,
    ) -> int:
        """Publish ``change`` applied to the touched dates; other dates keep their files."""
        old = self._read(base, touched.__contains__)
        return self._publish(base, change(old), touched, batch)

    def _home(self, base: Manifest, keys: DataFrame) -> set[Day]:
        """Dates that hold any of ``keys``: a scan of the key column only.

        As many rows as the calendar has days reach the driver at most.
        """
        current = self._read(base, lambda day: True).select(self.spec.key, *PARTITIONS)
        hit = current.join(keys, self.spec.key, "left_semi")
        return {tuple(r) for r in hit.select(*PARTITIONS).distinct().collect()}

    def append(self, rows: DataFrame, now: datetime | str | Column) -> int:
        """Add rows with new keys; nothing stored is read or rewritten."""
        return self._publish(self.manifest(), with_partitions(rows, now), ())

    def merge(
        self,
        changes: DataFrame,
        now: datetime | str | Column,
        order: Iterable[str] = CHANGE_ORDER,
        batch: int | None = None,
        source: str = "",
    ) -> int:
        """Apply typed changes: the last one per key wins, removals delete.

        A row found under another date than its new creation date moves. Applying the
        same changes, or the same numbered batch of a source, again changes nothing, and
        a batch without changes publishes nothing. Batches must come in their order: what
        is stored has no order columns to tell an older batch by.
        """
        if batch is not None and self.applied(source, batch):
            return self.manifest().version
        return self.merge_reduced(self.reduced(changes, now, order), batch, source)

    def reduced(
        self, changes: DataFrame, now: datetime | str | Column, order: Iterable[str] = CHANGE_ORDER
    ) -> DataFrame:
        """Typed changes as one dated row per changed key, stored, as several jobs use it."""
        return cut(with_partitions(last_change(changes, self.spec.key, order), now))

    def merge_reduced(self, last: DataFrame, batch: int | None = None, source: str = "") -> int:
        """``merge`` for changes that are ``reduced`` already."""
        base = self.manifest()
        if batch is not None and self.applied(source, batch, base):
            return base.version
        key = self.spec.key
        if last.isEmpty():
            return base.version
        alive = last.filter(F.col("op") != REMOVE).select(*self.spec.columns, *PARTITIONS)
        keys = last.select(key)
        return self._rewrite(
            base,
            self._home(base, keys),
            lambda old: old.join(keys, key, "left_anti").unionByName(alive),
            None if batch is None else (source, batch),
        )

    def applied(self, source: str, batch: int, base: Manifest | None = None) -> bool:
        """Whether this table has that numbered batch, or a later one, of the source."""
        return batch <= (base or self.manifest()).batches.get(source, -1)

    def patch(
        self, patches: DataFrame, now: datetime | str | Column | None = None, order=CHANGE_ORDER
    ) -> DataFrame:
        """Partial updates of known rows in place; returns the keys that name no row."""
        base = self.manifest()
        patches = cut(patches)
        keys = patches.select(self.spec.key).distinct()
        touched = self._home(base, keys)
        if not touched:
            return keys
        before = self._read(base, touched.__contains__).select(self.spec.key)
        known = before.join(keys, self.spec.key, "left_semi")
        self._rewrite(base, touched, lambda old: patch(old, patches, self.spec, now, order)[0])
        return keys.join(known, self.spec.key, "left_anti")

    def remove(self, keys: DataFrame) -> int:
        """Delete rows by key."""
        base = self.manifest()
        keys = cut(keys.select(self.spec.key).distinct())
        touched = self._home(base, keys)
        if not touched:
            return base.version
        return self._rewrite(
            base, touched, lambda old: old.join(keys, self.spec.key, "left_anti")
        )

    def remove_where(
        self, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], base: Manifest | None = None
    ) -> int:
        """Delete the rows that a condition selects, in the newest version or in ``base``.

        ``split`` parts rows, with their dates, into those to remove and the others. No key
        is sought in the table, so its rows are only moved where the condition moves them.
        """
        base = base or self.manifest()
        hit, _ = split(self._read(base, lambda day: True))
        touched = {tuple(r) for r in hit.select(*PARTITIONS).distinct().collect()}
        if not touched:
            return base.version
        return self._rewrite(base, touched, lambda old: split(old)[1])

    # -- maintenance ---------------------------------------------------------

    def compact(self, where: Callable[[Day], bool] = lambda day: True) -> int:
        """Merge the small files of the chosen dates into full-sized, key-sorted ones."""
        base = self.manifest()
        touched = {d for d in base.days if where(d)}
        return self._rewrite(base, touched, lambda old: old)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drop data folders that none of the last ``keep`` manifests uses.

        Folders of versions after the newest manifest may be a commit under way and stay.
        """
        kept = self.versions()[-keep:]
        if not kept:
            return []
        used = {v for n in kept for vs in self.manifest(n).days.values() for v in vs}
        dropped = []
        for text in self._glob("data/__v=*"):
            v = text.rsplit("=", 1)[-1]
            if v not in used and int(v.split("-")[0]) <= kept[-1]:
                path, fs = self._file(f"data/__v={v}")
                fs.delete(path, True)
                dropped.append(v)
        for n in self.versions():
            if n < kept[0]:
                path, fs = self._file(f"manifest/v{n:012d}.json")
                fs.delete(path, False)
        return sorted(dropped)
