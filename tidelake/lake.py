"""Entities, relations, declared queries and runs of one lake, under one root folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce
from threading import Thread

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidelake.operators import entities, queries, relations, runs
from tidelake.operators.ingest import REMOVE, dealt, dealt_rows, dealt_unknown
from tidelake.session import configure, cut, split_code
from tidelake.sources.files import load_result, save_result
from tidelake.sources.journal import Journal, source_id
from tidelake.sources.lake import LakeTable
from tidelake.specs import EntitySpec, QuerySpec, RelationSpec
from tidelake.streaming.ingest import for_each_batch

Now = datetime | str | Column
RUN = EntitySpec(
    "Run",
    {
        "taskId": "ID!",
        "taskType": "String",
        "mutationName": "String",
        "taskStatus": "String!",
        "startDate": "AWSDateTime!",
        "finishDate": "AWSDateTime",
    },
    key="taskId",
)


class Lake:
    """Typed tables under ``root`` and everything declared over them."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        entities: Iterable[EntitySpec] = (),
        relations: Iterable[RelationSpec] = (),
        queries: Iterable[QuerySpec] = (),
    ):
        self.spark, self.root = configure(spark), root.rstrip("/")
        self.entities = {e.table: e for e in entities}
        self.relations = {r.table: r for r in relations}
        self.queries = {q.name: q for q in queries}
        self.runs = LakeTable(spark, f"{self.root}/runs", RUN)
        self._cancelled: set[str] = set()
        self.journal = Journal(spark, f"{self.root}/batches")

    def table(self, name: str) -> LakeTable:
        """The stored table of an entity or relation, in any letter case."""
        key = name.lower()
        spec = self.entities.get(key) or self.relations.get(key)
        if spec is None:
            raise KeyError(f"no entity or relation {name!r}")
        return LakeTable(self.spark, f"{self.root}/tables/{key}", spec)

    def tables(self, sql: str | None = None) -> dict[str, DataFrame]:
        """Every table by name, or only those whose name occurs in a statement."""
        names = (*self.entities, *self.relations)
        return {n: self.table(n).scan() for n in names if sql is None or n in sql.lower()}

    # -- entities ------------------------------------------------------------

    def create(
        self, entity: str, rows: DataFrame, now: Now, request_key: Sequence[str] | None = None
    ) -> DataFrame:
        """Store new rows and return them with their ids."""
        table = self.table(entity)
        made = cut(entities.create(rows, table.spec, now, request_key))
        table.append(made, now)
        return made

    def read(self, entity: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with the given ids, and the ids that name no row."""
        table = self.table(entity)
        return entities.read(table.scan(), ids, table.spec.key)

    def update(
        self, entity: str, patches: DataFrame, now: Now, order: Sequence[str] = ("ts", "seq")
    ) -> tuple[DataFrame, DataFrame]:
        """Set the supplied fields; returns what was supplied and the unknown ids."""
        table = self.table(entity)
        patches = cut(patches)
        unknown = table.patch(patches, now, order)
        return entities.patch_ack(patches, table.spec, now, order), unknown

    def delete(self, entity: str, ids: DataFrame) -> DataFrame:
        """Delete rows and every relation they take part in."""
        table = self.table(entity)
        ids = cut(ids.select(table.spec.key))
        table.remove(ids)
        self.cascade(
            ids.select(
                F.lit(table.spec.table).alias("entityType"),
                F.col(table.spec.key).cast("string").alias("entityId"),
            )
        )
        return entities.delete_ack(ids, table.spec.key)

    def cascade(self, deleted: DataFrame) -> None:
        """Remove the relations of deleted entities from every relation table."""
        for name, spec in self.relations.items():
            table = self.table(name)
            index = relations.edges(spec, table.scan())
            table.remove(relations.doomed_relations(deleted, index).select(relations.ID))

    def apply(
        self,
        changes: DataFrame,
        now: Now,
        bad_path: str,
        batch: int | None = None,
        source: str = "",
    ) -> None:
        """Merge a batch of change records into all tables; bad rows go to ``bad_path``.

        Bad rows are those with a cast error, without a required field, or of a table that
        is not declared as what the record says it is; they lie in ``<table>/source=/batch=``
        of their own. A numbered batch is done as a whole or applied again from the start:
        one that comes again after that changes nothing. An entity that the batch leaves
        removed takes its relations with it.
        """
        if batch is not None and self.journal.done(source, batch):
            return
        # Parsed, typed and stored once; every table then reads only its own part. The folder
        # names are numbers of declared tables and never come from the records.
        every = dealt(changes, self.entities.values(), self.relations.values())
        with split_code(every.sparkSession):
            rows = cut(every, "_slot", "_sound")
        attempt = f"source={source_id(source)}/batch={uuid.uuid4().hex if batch is None else batch}"
        dealt_unknown(rows).write.mode("overwrite").parquet(f"{bad_path}/_unknown/{attempt}")
        gone = []
        for slot, (name, spec) in enumerate([*self.entities.items(), *self.relations.items()]):
            bad = dealt_rows(rows, spec, slot, sound=False)
            bad.write.mode("overwrite").parquet(f"{bad_path}/{name}/{attempt}")
            table = self.table(name)
            last = table.reduced(dealt_rows(rows, spec, slot, sound=True), now)
            if slot < len(self.entities):
                removed = last.filter(F.col("op") == REMOVE)
                gone.append(
                    removed.select(
                        F.lit(name).alias("entityType"),
                        F.col(spec.key).cast("string").alias("entityId"),
                    )
                )
            table.merge_reduced(last, batch, source)
        if gone and self.relations:
            self.cascade(cut(reduce(DataFrame.unionByName, gone).distinct()))
        if batch is not None:
            self.journal.finish(source, batch)

    def start(
        self, changes: DataFrame, checkpoint: str, now: datetime | str, bad_path: str
    ) -> StreamingQuery:
        """One stream of change records into all tables, relations and cascade, then stop.

        Each micro-batch is one numbered batch of ``apply``, whose source is the stream that
        the checkpoint names; a restart repeats the batch that was not finished.
        """
        return for_each_batch(
            changes,
            checkpoint,
            lambda rows, number, source: self.apply(rows, now, bad_path, number, source),
        )

    # -- relations -----------------------------------------------------------

    def relate(
        self, relation: str, batch: DataFrame, now: Now, bad_path: str | None = None
    ) -> Row:
        """Insert associations that are not there yet; returns the three counts.

        Rejected ones, whose members are incomplete, are stored at ``bad_path``.
        """
        table = self.table(relation)
        done = relations.insert(table.spec, batch, table.scan(), now)
        rejected = cut(done.rejected)
        if bad_path is not None:
            rejected.write.mode("overwrite").parquet(bad_path)
        counts = Row(
            inserted=done.rows.count(), repeats=done.repeats.count(), rejected=rejected.count()
        )
        table.append(done.rows, now)
        return counts

    def unrelate(
        self,
        relation: str,
        where: Column | str | None = None,
        other: DataFrame | None = None,
        on: Column | list[str] | None = None,
    ) -> int:
        """Delete the associations a condition or a joined table selects."""
        table = self.table(relation)
        other = relations.partners(other, on)
        return table.remove_where(lambda rows: relations.split(rows, where, other, on))

    def edges(self) -> DataFrame:
        """Every (entity, relation) pair of every relation table."""
        parts = [relations.edges(s, self.table(n).scan()) for n, s in self.relations.items()]
        if not parts:
            raise LookupError("no relations are declared")
        return reduce(DataFrame.unionByName, parts)

    # -- queries and runs ----------------------------------------------------

    def query(self, name: str, args: Mapping[str, object] | None = None) -> DataFrame:
        """A declared query over the current tables, in its declared shape."""
        declared = self.queries[name]
        return queries.run(self.spark, declared, args, self.tables(declared.sql))

    def submit(
        self, name: str, run_id: str, now: Now, args: Mapping[str, object] | None = None
    ) -> str:
        """Run a declared query as a task: open the run, store the result, close the run.

        A failing query closes the run as FAILED and raises.
        """
        self._open(name, run_id, now)
        self._work(name, run_id, now, args)
        return run_id

    def submit_background(
        self, name: str, run_id: str, now: Now, args: Mapping[str, object] | None = None
    ) -> Thread:
        """As ``submit``, but the query runs in a thread of its own, which is returned.

        Its jobs carry the run's tag, so ``cancel`` reaches these and no others. A failure
        is told by the run's state.
        """
        self._open(name, run_id, now)

        def work() -> None:
            self.spark.addTag(self._tag(run_id))
            try:
                self._work(name, run_id, now, args)
            except Exception:  # the run says so
                pass
            finally:
                self.spark.removeTag(self._tag(run_id))

        thread = InheritableThread(target=work)
        thread.start()
        return thread

    def cancel(self, run_id: str) -> None:
        """Stop the query of a run in the background; the run then closes as CANCELLED."""
        self._cancelled.add(run_id)
        self.spark.interruptTag(self._tag(run_id))

    @staticmethod
    def _tag(run_id: str) -> str:
        return f"run-{source_id(run_id)}"

    def _open(self, name: str, run_id: str, now: Now) -> None:
        request = self.spark.range(1).select(
            F.lit(run_id).alias("taskId"), F.lit(name).alias("mutationName")
        )
        opened = runs.open_runs(request, now, self.runs.scan())
        self.runs.append(opened, now)
        self._settle(now, request.select("taskId"))

    def _work(self, name: str, run_id: str, now: Now, args: Mapping[str, object] | None) -> None:
        try:
            if run_id not in self._cancelled:
                save_result(self.query(name, args), f"{self.root}/results", run_id)
        except Exception:
            if run_id not in self._cancelled:
                self._close(run_id, runs.FAILED, now)
                raise
        cancelled = run_id in self._cancelled
        self._cancelled.discard(run_id)
        self.spark.removeTag(self._tag(run_id))
        self._close(run_id, runs.CANCELLED if cancelled else runs.SUCCEEDED, now)

    def submit_deletion(
        self,
        relation: str,
        run_id: str,
        now: Now,
        where: Column | str | None = None,
        other: DataFrame | None = None,
        on: Column | list[str] | None = None,
    ) -> str:
        """Delete the associations that ``unrelate`` would as a task: open the run, store
        its targets as its result, remove them, close the run.

        A run that failed half-way can come again: it removes its stored targets and what
        the condition selects by then. A failing one is closed as FAILED and raises.
        """
        request = self.spark.range(1).select(
            F.lit(run_id).alias("taskId"),
            F.lit(runs.DELETION).alias("taskType"),
            F.lit(relation).alias("mutationName"),
        )
        self.runs.append(runs.open_runs(request, now, self.runs.scan()), now)
        self._settle(now, request.select("taskId"))
        table, results = self.table(relation), f"{self.root}/results"
        try:
            base, other = table.manifest(), relations.partners(other, on)
            due, _ = relations.split(table.scan(version=base.version), where, other, on)
            # Each attempt stores what it selects beside the others, so none is ever lost.
            attempts, own = f"{self.root}/deletions/{source_id(run_id)}", uuid.uuid4().hex
            due.select("relationId").write.parquet(f"{attempts}/attempt={own}")
            every = self.spark.read.parquet(attempts)
            save_result(every.select("relationId").distinct(), results, run_id)
            table.remove_where(lambda rows: relations.split(rows, where, other, on), base)
            if not every.filter(F.col("attempt") != own).isEmpty():
                table.remove(load_result(self.spark, results, run_id))
        except Exception:
            self._close(run_id, runs.FAILED, now)
            raise
        self._close(run_id, runs.SUCCEEDED, now)
        return run_id

    def _close(self, run_id: str, state: str, now: Now) -> None:
        event = self.spark.range(1).select(
            F.lit(run_id).alias("queryExecutionId"),
            F.lit(state).alias("currentState"),
            F.lit(None).cast("timestamp").alias("ts"),
        )
        self.track(event, now)

    def track(self, events: DataFrame, now: Now) -> None:
        """Bring the run log up to date with execution events.

        All terminal events are kept, so one that comes before its run, or after a later
        one, has the same effect as in order.
        """
        ended = cut(runs.terminal(events).select("queryExecutionId", "currentState", "ts"))
        ended.write.mode("append").parquet(self._events)
        self._settle(now, ended.select(F.col("queryExecutionId").alias("taskId")).distinct())

    @property
    def _events(self) -> str:
        return f"{self.root}/run_events"

    def _settle(self, now: Now, ids: DataFrame) -> None:
        """Reduce the kept events of some runs to their state."""
        try:
            events = self.spark.read.parquet(self._events)
        except AnalysisException:  # no event yet
            return
        own = events.join(
            ids.select(F.col("taskId").alias("queryExecutionId")), "queryExecutionId", "left_semi"
        )
        touched = self.runs.scan().join(runs.last_terminal(own), "taskId", "left_semi")
        state = runs.run_state(touched.select(*runs.RUN_COLUMNS), own, now)
        closed = state.select(
            "*", F.lit("MODIFY").alias("op"), F.col("updatedAt").alias("ts"), F.lit(0).alias("seq")
        )
        self.runs.merge(closed, now)

    def result(self, run_id: str) -> tuple[Row, DataFrame | None]:
        """Status row of a run and, once it succeeded, its result.

        That of a deletion is the ids of what it removed.
        """
        row = self.runs.scan().filter(F.col("taskId") == run_id).select(*runs.RUN_COLUMNS).first()
        if row is None:
            raise LookupError(f"no run {run_id!r}")
        if row.taskStatus != runs.SUCCEEDED:
            return row, None
        asked = None if row.taskType == runs.DELETION else self.queries.get(row.mutationName)
        shape = asked.returns if asked else None
        return row, load_result(self.spark, f"{self.root}/results", run_id, shape)
