"""Tables under change: versions, replays, moves between dates, streams, the facade."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake import EntitySpec, Lake, QuerySpec, RelationSpec, ResponseSpec
from tidelake.operators import entities, queries, relations, runs
from tidelake.operators.ingest import with_partitions
from tidelake.plans import fixtures as fx
from tidelake.sources import feeds, files
from tidelake.sources.journal import Journal
from tidelake.sources.lake import LakeTable
from tidelake.sources.ordered import OrderedTable
from tidelake.streaming.ingest import start_apply, start_ingest
from tidelake.streaming.relations import start_relate
from tidelake.streaming.tracker import start_run_tracker, tracked_state

NOW = "2024-06-01T00:00:00Z"
SF = "/root/testdata/sf0.001"
ITEM = EntitySpec("Item", {"id": "ID!", "v": "Int"})
CHANGE = "id string, v long, createdAt timestamp, updatedAt timestamp, op string, ts timestamp, seq long"
DAY0 = datetime(2024, 1, 1)


def change(key, v, day, op, seq):
    at = DAY0 + timedelta(days=day)
    return (key, v, at, at, op, DAY0 + timedelta(seconds=seq // 2), seq)


def random_changes(seed, count):
    rng = random.Random(seed)
    ops = ["INSERT", "MODIFY", "MODIFY", "REMOVE"]
    return [
        change(str(rng.randrange(12)), i, rng.randrange(5), rng.choice(ops), i) for i in range(count)
    ]


def model(changes):
    state = {}
    for key, v, at, _, op, _, _ in changes:
        state.pop(key, None)
        if op != "REMOVE":
            state[key] = (v, at.strftime("%Y-%m-%d"))
    return state


def content(table, version=None):
    rows = table.scan(version=version).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: (r.v, f"{r.year}-{r.month}-{r.day}") for r in rows}


def numbers(folders):
    return [int(v.split("-")[0]) for v in folders]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merges_equal_a_simple_model(spark, tmp_path, seed):
    changes = random_changes(seed, 60)
    table = LakeTable(spark, str(tmp_path / "t"), ITEM)
    for i in range(0, 60, 20):
        part = changes[i : i + 20]
        shuffled = random.Random(seed).sample(part, len(part))
        df = spark.createDataFrame(shuffled, CHANGE)
        table.merge(df, NOW)
        assert content(table) == model(changes[: i + 20])
        table.merge(df, NOW)
        assert content(table) == model(changes[: i + 20])
    table.compact()
    assert content(table) == model(changes)
    assert entities.latest(spark.createDataFrame(changes, CHANGE), "id").count() == len(model(changes))


def test_numbered_batches_apply_once(spark, tmp_path):
    table = LakeTable(spark, str(tmp_path / "t"), ITEM)
    first = spark.createDataFrame([change("a", 1, 0, "INSERT", 0)], CHANGE)
    second = spark.createDataFrame([change("a", 2, 0, "MODIFY", 1)], CHANGE)
    assert table.merge(first, NOW, batch=0) == 1
    assert table.merge(second, NOW, batch=1) == 2
    assert table.merge(first, NOW, batch=0) == 2
    assert content(table)["a"][0] == 2


def test_old_versions_stay_readable_until_vacuum(spark, tmp_path):
    table = LakeTable(spark, str(tmp_path / "t"), ITEM)
    for i in range(3):
        table.merge(spark.createDataFrame([change("a", i, 0, "MODIFY", i)], CHANGE), NOW)
    assert [content(table, v)["a"][0] for v in table.versions()] == [0, 1, 2]
    assert [v.split("-")[0] for v in table.vacuum(keep=1)] == ["1", "2"]
    assert table.versions() == [3] and content(table)["a"][0] == 2


def test_untouched_dates_keep_their_files(spark, tmp_path):
    table = LakeTable(spark, str(tmp_path / "t"), ITEM)
    rows = [change(str(d), d, d, "INSERT", d) for d in range(4)]
    table.merge(spark.createDataFrame(rows, CHANGE), NOW)
    table.merge(spark.createDataFrame([change("2", 9, 2, "MODIFY", 9)], CHANGE), NOW)
    days = table.manifest().days
    assert numbers(days[("2024", "01", "03")]) == [2]
    assert [numbers(v) for d, v in days.items() if d != ("2024", "01", "03")] == [[1]] * 3
    table.merge(spark.createDataFrame([change("new", 1, 0, "INSERT", 10)], CHANGE), NOW)
    assert numbers(table.manifest().days[("2024", "01", "01")]) == [1, 3]
    assert len(content(table)) == 5
    some = table.scan(days=("2024-01-02", "2024-01-03"))
    assert sorted(r.id for r in some.collect()) == ["1", "2"]
    assert len(some.inputFiles()) == 2


def test_removing_the_last_row_of_a_date_removes_the_date(spark, tmp_path):
    table = LakeTable(spark, str(tmp_path / "t"), ITEM)
    table.merge(spark.createDataFrame([change("a", 1, 0, "INSERT", 0)], CHANGE), NOW)
    table.remove(spark.createDataFrame([("a",)], "id string"))
    assert content(table) == {} and table.manifest().days == {}


def test_second_writer_of_a_version_fails(spark, tmp_path):
    one, two = (LakeTable(spark, str(tmp_path / "t"), ITEM) for _ in range(2))
    rows = spark.createDataFrame([change("a", 1, 0, "INSERT", 0)], CHANGE)
    base = two.manifest()
    one.merge(rows, NOW)
    other = spark.createDataFrame([change("b", 2, 0, "INSERT", 0)], CHANGE)
    with pytest.raises(RuntimeError):
        two._publish(base, with_partitions(other, NOW), ())
    assert content(two) == {"a": (1, "2024-01-01")}
    two.merge(other, NOW)
    assert set(content(one)) == {"a", "b"}


def test_a_half_written_publish_is_ignored(spark, tmp_path):
    table = LakeTable(spark, str(tmp_path / "t"), ITEM)
    table.merge(spark.createDataFrame([change("a", 1, 0, "INSERT", 0)], CHANGE), NOW)
    (tmp_path / "t/manifest/_aside-dead").write_text('{"batches": {')
    (tmp_path / "t/data/__v=2-dead/year=2024/month=01/day=01").mkdir(parents=True)
    table.merge(spark.createDataFrame([change("b", 2, 0, "INSERT", 1)], CHANGE), NOW)
    assert table.versions() == [1, 2] and set(content(table)) == {"a", "b"}


def test_batch_numbers_belong_to_their_source(spark, tmp_path):
    table = LakeTable(spark, str(tmp_path / "t"), ITEM)
    one = spark.createDataFrame([change("a", 1, 0, "INSERT", 0)], CHANGE)
    two = spark.createDataFrame([change("b", 2, 0, "INSERT", 1)], CHANGE)
    table.merge(one, NOW, batch=0, source="x")
    table.merge(two, NOW, batch=0, source="y")
    assert set(content(table)) == {"a", "b"}
    assert table.merge(two.limit(0), NOW) == 2  # nothing to publish


def test_a_new_checkpoint_applies_its_batches(spark, tmp_path):
    table = LakeTable(spark, str(tmp_path / "t"), fx.ACCOUNT)
    rows = fx.encoded_changes(spark, SF)
    half = F.lit("2024-01-16T00:00:00Z").cast("timestamp")
    for name, part in (("one", F.col("ts") < half), ("two", F.col("ts") >= half)):
        rows.filter(part).coalesce(1).write.parquet(str(tmp_path / name))
        stream = feeds.changes(spark, str(tmp_path / name), streaming=True)
        start_apply(
            stream, table, str(tmp_path / f"cp-{name}"), NOW, str(tmp_path / "bad")
        ).awaitTermination()
    batch = entities.latest(fx.typed_events(spark, SF), "id").select("id", "eventId").collect()
    assert sorted(table.scan().select("id", "eventId").collect()) == sorted(batch)


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "changes")
    fx.encoded_changes(spark, SF).repartition(4).write.parquet(source)
    batch = entities.latest(fx.typed_events(spark, SF), "id").select("id", "eventId").collect()
    log = str(tmp_path / "log")
    for _ in range(2):  # a restart from the checkpoint adds nothing
        stream = feeds.changes(spark, source, streaming=True, files_per_batch=1)
        start_ingest(stream, fx.ACCOUNT, log, str(tmp_path / "cp1"), NOW).awaitTermination()
    logged = spark.read.parquet(log)
    assert logged.count() == fx.typed_events(spark, SF).count()
    assert sorted(entities.latest(logged, "id").select("id", "eventId").collect()) == sorted(batch)


def test_stream_merge_in_time_order_equals_batch(spark, tmp_path):
    source = tmp_path / "changes"
    rows = fx.encoded_changes(spark, SF)
    half = F.lit("2024-01-16T00:00:00Z").cast("timestamp")
    table = LakeTable(spark, str(tmp_path / "t"), fx.ACCOUNT)
    for part in (F.col("ts") < half, F.col("ts") >= half):
        rows.filter(part).coalesce(1).write.mode("append").parquet(str(source))
        stream = feeds.changes(spark, str(source), streaming=True)
        start_apply(
            stream, table, str(tmp_path / "cp"), NOW, str(tmp_path / "bad")
        ).awaitTermination()
    batch = entities.latest(fx.typed_events(spark, SF), "id").select("id", "eventId").collect()
    assert sorted(table.scan().select("id", "eventId").collect()) == sorted(batch)


def test_run_event_before_its_run_is_kept(spark, tmp_path):
    source, log, cp = (str(tmp_path / n) for n in ("ev", "log", "cp"))
    schema = feeds.EXEC_EVENT_SCHEMA
    spark.createDataFrame([("late", "SUCCEEDED", DAY0)], schema).write.parquet(source)
    start_run_tracker(feeds.exec_events(spark, source, streaming=True), log, cp).awaitTermination()
    none = runs.open_runs(spark.createDataFrame([("other",)], "taskId string"), NOW)
    assert tracked_state(spark, none, log, NOW).first().taskStatus == "RUNNING"
    opened = runs.open_runs(spark.createDataFrame([("late",)], "taskId string"), NOW)
    assert tracked_state(spark, opened, log, NOW).first().taskStatus == "SUCCEEDED"


def test_cascade_leaves_no_dangling_edge(spark):
    rng = random.Random(5)
    specs = {
        "likes": RelationSpec("likes", {"userId": "User", "productId": "Product"}),
        "knows": RelationSpec("knows", {"a": "User", "b": "User"}),
    }
    pairs = [(str(rng.randrange(15)), str(rng.randrange(15))) for _ in range(120)]
    rels = {
        n: relations.insert(s, spark.createDataFrame(pairs, ", ".join(f"{c} string" for c in s.members)), now=NOW).rows
        for n, s in specs.items()
    }
    index = relations.edges(specs["likes"], rels["likes"]).unionByName(
        relations.edges(specs["knows"], rels["knows"])
    )
    deleted = spark.createDataFrame([("user", "3"), ("user", "7"), ("product", "1")], "entityType string, entityId string")
    left_edges, left = relations.cascade(deleted, index, rels)
    alive = {r.relationId for df in left.values() for r in df.collect()}
    remaining = left_edges.collect()
    assert {r.relationId for r in remaining} == alive
    dead = {("user", "3"), ("user", "7"), ("product", "1")}
    assert not dead & {(r.relatedEntityType, r.relatedEntityId) for r in remaining}
    want = {p for p in pairs if p[0] not in "37" and p[1] != "1"}
    assert left["likes"].count() == len({(a, b) for a, b in want if a not in ("3", "7")})


def test_relation_id_ignores_column_order(spark):
    rows = spark.createDataFrame([("1", "2", "3")], "u string, p string, r string")
    kinds = {"u": "User", "p": "Project", "r": "Role"}
    ids = set()
    for order in (("u", "p", "r"), ("r", "u", "p"), ("p", "r", "u")):
        spec = RelationSpec("assigned", {c: kinds[c] for c in order})
        ids.add(rows.select(relations.relation_id(spec)).first()[0])
    assert len(ids) == 1


def test_one_key_with_a_third_of_all_rows(spark):
    """A hot key changes no result: latest state, insert, run state, counts."""
    n = 30000
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").alias("v"),
        F.lit("MODIFY").alias("op"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
        F.col("id").alias("seq"),
    )
    state = entities.latest(base, "id")
    assert state.count() == n - n // 3 + 1
    assert state.filter("id = 'hot'").first().v == n - 3
    rel = RelationSpec("r", {"a": "A", "b": "B"})
    pairs = base.select(F.col("id").alias("a"), (F.col("v") % 1000).cast("string").alias("b"))
    assert relations.insert(rel, pairs, now=NOW).rows.count() == pairs.distinct().count()


@pytest.fixture()
def lending(spark, tmp_path):
    return Lake(
        spark,
        str(tmp_path / "lending"),
        entities=[
            EntitySpec("Reader", {"id": "ID!", "name": "String!", "city": "String"}),
            EntitySpec("Book", {"id": "ID!", "name": "String!", "shelf": "String!", "weight": "Float!"}),
        ],
        relations=[RelationSpec("reader_loans", {"readerId": "Reader", "bookId": "Book"})],
        queries=[
            QuerySpec(
                "booksOnLoan",
                """SELECT book.* FROM reader_loans AS loan, book
                WHERE book.id = loan.bookId AND loan.readerId = :reader ORDER BY book.id""",
                {"reader": "String!"},
                returns=ResponseSpec(
                    "LoanedBook",
                    {"id": "ID!", "name": "String!", "shelf": "String!", "weight": "Float!",
                     "createdAt": "AWSDateTime!", "updatedAt": "AWSDateTime!"},
                ),
            )
        ],
    )


def test_lending_end_to_end(spark, lending, tmp_path):
    readers = lending.create("Reader", spark.createDataFrame([("ann", "Oslo"), ("bob", "Rome")], "name string, city string"), NOW, ["name"])
    books = lending.create(
        "Book",
        spark.createDataFrame([("pen", "b1", 1.5), ("cup", "b2", 4.0), ("hat", "b2", 9.0)], "name string, shelf string, weight double"),
        NOW, ["name"],
    )
    uid = {r.name: r.id for r in readers.collect()}
    pid = {r.name: r.id for r in books.collect()}
    pairs = [(uid["ann"], p) for p in pid.values()] + [(uid["bob"], pid["pen"])]
    batch = spark.createDataFrame(pairs, "readerId string, bookId string")
    assert lending.relate("reader_loans", batch, NOW).inserted == 4
    again = lending.relate("reader_loans", batch, "2024-07-01T00:00:00Z")
    assert (again.inserted, again.repeats) == (0, 4)

    lending.submit("booksOnLoan", "run-1", NOW, {"reader": uid["ann"]})
    row, result = lending.result("run-1")
    assert row.taskStatus == "SUCCEEDED" and row.finishDate is not None
    assert {r.name for r in result.collect()} == {"pen", "cup", "hat"}

    at = datetime(2024, 6, 2)
    patches = spark.createDataFrame(
        [(uid["ann"], None, ["city"], at, 1), ("ghost", "Bonn", ["city"], at, 2)],
        "id string, city string, _present array<string>, ts timestamp, seq long",
    )
    ack, unknown = lending.update("Reader", patches, NOW)
    assert [r.id for r in unknown.collect()] == ["ghost"]
    assert lending.read("Reader", readers.filter("name = 'ann'"))[0].first().city is None

    shelf_books = lending.tables()["book"].filter("shelf = 'b2'").select(F.col("id").alias("bookId"))
    lending.unrelate("reader_loans", other=shelf_books, on=["bookId"])
    names = [r.name for r in lending.query("booksOnLoan", {"reader": uid["ann"]}).collect()]
    assert names == ["pen"]

    assert lending.delete("Book", books.filter("name = 'pen'")).first().deleted
    assert lending.query("booksOnLoan", {"reader": uid["ann"]}).count() == 0
    assert lending.edges().count() == 0

    with pytest.raises(Exception):
        lending.submit("booksOnLoan", "run-2", NOW, {})
    assert lending.result("run-2")[0].taskStatus == "FAILED"


def test_change_feed_into_all_tables(spark, lending, tmp_path):
    import json

    def image(**attributes):
        return json.dumps({k: {"S": v} for k, v in attributes.items()})

    at = "2024-05-05T10:00:00.000Z"
    ann = image(PK="reader#1", entityType="reader", id="1", name="ann", createdAt=at, updatedAt=at)
    pen = image(PK="book#7", entityType="book", id="7", name="pen", shelf="b", weight="x", createdAt=at)
    cup = json.dumps(json.loads(image(PK="book#8", entityType="book", id="8", name="cup", shelf="b", createdAt=at)) | {"weight": {"N": "2.5"}})
    likes = image(
        PK="joinTableData#r1", SK="joinTableData#r1", entityType="reader_loans",
        joinTable="reader_loans", joinTableName="reader_loans", relationId="r1",
        readerId="1", bookId="8", s3Key="k", createdAt=at,
    )
    old = image(
        PK="relation#reader_loans#reader#1", SK="relation#reader_loans#book#9",
        entityType="reader_loans", joinTable="reader_loans",
        readerId="1", bookId="9", createdAt=at,
    )
    rows = [("INSERT", i, None, i + 1, img) for i, img in enumerate((ann, pen, cup, likes, old))]

    def feed(rows):
        records = [
            ("k", op, DAY0 + timedelta(hours=n), n, img if op == "REMOVE" else None, None if op == "REMOVE" else img)
            for op, _, _, n, img in rows
        ]
        return spark.createDataFrame(records, feeds.CHANGE_SCHEMA)

    bad = str(tmp_path / "bad")
    for _ in range(2):
        lending.apply(feed(rows), NOW, bad, batch=1)
    tables = lending.tables()
    assert {r.id for r in tables["book"].collect()} == {"8"}
    assert spark.read.parquet(f"{bad}/book").first()._cast_errors == ["weight"]
    assert {r.relationId for r in tables["reader_loans"].collect()} == {"r1", "reader_1_book_9"}
    lending.apply(feed([("REMOVE", 0, None, 9, ann)]), NOW, bad, batch=2)
    assert lending.tables()["reader"].count() == 0
    assert lending.tables()["reader_loans"].count() == 0


def test_a_replayed_removal_leaves_new_relations(spark, lending, tmp_path):
    import json

    def record(op, n, **attributes):
        img = json.dumps({k: {"S": v} for k, v in attributes.items()})
        at = DAY0 + timedelta(hours=n)
        return ("k", op, at, n, *((img, None) if op == "REMOVE" else (None, img)))

    def feed(*records):
        return spark.createDataFrame(records, feeds.CHANGE_SCHEMA)

    bad = str(tmp_path / "bad")
    ann = {"PK": "reader#1", "entityType": "reader", "id": "1", "name": "ann"}
    lending.apply(feed(record("INSERT", 1, **ann)), NOW, bad, batch=1)
    removal = feed(record("REMOVE", 2, **ann))
    lending.apply(removal, NOW, bad, batch=2)
    again = feed(record("REMOVE", 3, **ann), record("INSERT", 4, **ann))
    pair = spark.createDataFrame([("1", "8")], "readerId string, bookId string")
    lending.apply(again, NOW, bad, batch=3)
    lending.relate("reader_loans", pair, NOW)
    lending.apply(removal, NOW, bad, batch=2)
    lending.apply(feed(record("REMOVE", 5, **ann), record("INSERT", 6, **ann)), NOW, bad, batch=4)
    assert lending.tables()["reader"].count() == 1
    assert lending.tables()["reader_loans"].count() == 1

    # Rows that lack a required field, or whose table nobody declared, are kept aside.
    odd = feed(
        record("INSERT", 7, PK="reader#2", entityType="reader", id="2"),
        record("INSERT", 8, PK="x#2", entityType="../x", id="2"),
    )
    lending.apply(odd, NOW, bad, batch=5)
    assert spark.read.parquet(f"{bad}/reader").first()._cast_errors == ["name"]
    assert spark.read.parquet(f"{bad}/_unknown").count() == 1
    assert lending.tables()["reader"].count() == 1

    pairs = spark.createDataFrame([("1", None), ("1", "9")], "readerId string, bookId string")
    assert lending.relate("reader_loans", pairs, NOW, f"{bad}/pairs").rejected == 1
    assert spark.read.parquet(f"{bad}/pairs").count() == 1


def feed_of(spark, *records):
    """Change records (op, hour, attributes), each in the order given."""
    import json

    rows = []
    for n, (op, hour, attributes) in enumerate(records):
        img = json.dumps({k: {"S": v} for k, v in attributes.items()})
        at = DAY0 + timedelta(hours=hour)
        rows.append(("k", op, at, n, *((img, None) if op == "REMOVE" else (None, img))))
    return spark.createDataFrame(rows, feeds.CHANGE_SCHEMA)


def reader(n, name="x"):
    return {"PK": f"reader#{n}", "entityType": "reader", "id": str(n), "name": name}


def loan(n, reader_id, table="reader_loans"):
    return {
        "PK": f"joinTableData#{n}", "entityType": table, "joinTable": table, "joinTableName": table,
        "relationId": n, "readerId": reader_id, "bookId": "8", "s3Key": "k",
        "createdAt": "2024-05-05T10:00:00.000Z",
    }


def test_no_record_vanishes(spark, lending, tmp_path):
    """Records of a declared name that is something else go to the bad rows."""
    bad = str(tmp_path / "bad")
    feed = feed_of(
        spark,
        ("INSERT", 1, reader(1)),
        ("INSERT", 1, reader(2) | {"entityType": "reader_loans"}),
        ("INSERT", 1, loan("r1", "1")),
        ("INSERT", 1, loan("r2", "1", "reader")),
    )
    lending.apply(feed, NOW, bad, batch=0)
    assert lending.table("reader").scan().count() == 1
    assert lending.table("reader_loans").scan().count() == 1
    assert spark.read.parquet(f"{bad}/_unknown").count() == 2
    # Another source, and batches without a number, leave these where they are.
    lending.apply(feed_of(spark, ("INSERT", 2, {"PK": "x", "entityType": "y"})), NOW, bad, 0, "other")
    for _ in range(2):
        lending.apply(feed_of(spark, ("INSERT", 2, {"PK": "x", "entityType": "z"})), NOW, bad)
    assert spark.read.parquet(f"{bad}/_unknown").count() == 5


READER = EntitySpec("Reader", {"id": "ID!", "name": "String!"})
READER_LOANS = RelationSpec("reader_loans", {"readerId": "Reader", "bookId": "Book"})


class Crash(Exception):
    pass


def crashing(monkeypatch, at):
    """From now on the step number ``at`` that makes anything visible fails before it does."""
    steps = []

    def fail_at(owner, name):
        whole = getattr(owner, name)

        def step(self, *args, **kwargs):
            steps.append(name)
            if len(steps) == at:
                raise Crash(name)
            return whole(self, *args, **kwargs)

        monkeypatch.setattr(owner, name, step)

    fail_at(LakeTable, "_create")
    fail_at(Journal, "finish")
    return steps


def test_a_batch_that_crashes_anywhere_is_finished_by_its_replay(spark, tmp_path):
    """The lake stream, killed before each step that is visible, against one never killed."""
    parts = [
        [("INSERT", 1, reader(1)), ("INSERT", 1, reader(2)), ("INSERT", 1, loan("a", "1")), ("INSERT", 1, loan("b", "2"))],
        [("REMOVE", 2, reader(1)), ("MODIFY", 2, reader(2, "new")), ("INSERT", 2, loan("c", "2"))],
    ]

    def new_lake(name):
        return Lake(spark, str(tmp_path / name), [READER], [READER_LOANS])

    def add(source, number):
        feed_of(spark, *parts[number]).coalesce(1).write.mode("append").parquet(source)

    def run(lake, name):
        stream = feeds.changes(spark, str(tmp_path / f"src-{name}"), streaming=True)
        lake.start(stream, str(tmp_path / f"cp-{name}"), NOW, str(tmp_path / f"bad-{name}")).awaitTermination()

    def state(lake):
        return (
            sorted(tuple(r) for r in lake.table("reader").scan().select("id", "name").collect()),
            sorted(r.relationId for r in lake.table("reader_loans").scan().collect()),
        )

    at, crashed = 0, True
    while crashed:
        at += 1
        name = f"n{at}"
        add(str(tmp_path / f"src-{name}"), 0)
        lake = new_lake(name)
        run(lake, name)
        add(str(tmp_path / f"src-{name}"), 1)
        with pytest.MonkeyPatch.context() as patch:
            steps = crashing(patch, at)
            try:
                run(lake, name)
                crashed = False
            except Exception as e:
                assert "Crash" in str(e)
        run(new_lake(name), name)
        run(new_lake(name), name)
        assert state(lake) == ([("2", "new")], ["b", "c"]), (at, steps)
    # Both tables, the cascade and the journal were each crashed before.
    assert at > 4


def test_batches_in_any_order_leave_the_same_state(spark, tmp_path):
    changes = random_changes(5, 60)
    batches = [changes[i : i + 15] for i in range(0, 60, 15)]
    for n, order in enumerate(((3, 2, 1, 0), (1, 3, 1, 0, 2, 3), (0, 1, 2, 3))):
        table = OrderedTable(spark, str(tmp_path / f"t{n}"), ITEM)
        for i in order:
            table.merge(spark.createDataFrame(batches[i], CHANGE), NOW)
        assert content(table) == model(changes)
    # A failure between rows and marks: the same changes once more change nothing.
    table = OrderedTable(spark, str(tmp_path / "half"), ITEM)
    frames = [spark.createDataFrame(b, CHANGE) for b in batches]
    table.rows.merge(table.newer(frames[3]), NOW)
    for i in (3, 0, 1, 2):
        table.merge(frames[i], NOW)
    assert content(table) == model(changes)


def test_stream_keeps_rows_without_a_required_field_aside(spark, tmp_path):
    rows = fx.faulty_changes(spark, SF)
    table = LakeTable(spark, str(tmp_path / "t"), fx.ACCOUNT)
    rows.coalesce(1).write.parquet(str(tmp_path / "src"))
    for n in range(2):  # a new checkpoint begins at batch 0 again and keeps what is there
        stream = feeds.changes(spark, str(tmp_path / "src"), streaming=True)
        start_apply(stream, table, str(tmp_path / f"cp{n}"), NOW, str(tmp_path / "bad")).awaitTermination()
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert {tuple(r._cast_errors) for r in bad.select("_cast_errors").distinct().collect()} == {("eventId",), ("kind",)}
    assert bad.select("source").distinct().count() == 2
    assert table.scan().filter("kind is null").count() == 0


def test_repeats_inside_the_window_never_reach_the_table(spark, tmp_path, monkeypatch):
    table = LakeTable(spark, str(tmp_path / "t"), READER_LOANS)
    schema = "readerId string, bookId string, createdAt timestamp"
    src, bad, seen = str(tmp_path / "src"), str(tmp_path / "bad"), []
    insert = relations.insert

    def counted(spec, batch, *args):
        seen.append(batch.count())
        return insert(spec, batch, *args)

    monkeypatch.setattr(relations, "insert", counted)

    def run(*pairs):
        rows = [(a, b, DAY0 + timedelta(minutes=m)) for a, b, m in pairs]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        start_relate(stream, table, str(tmp_path / "cp"), NOW, bad).awaitTermination()
        return sorted((r.readerId, r.bookId) for r in table.scan().collect())

    assert run(("1", "8", 0), ("1", "8", 1), ("2", "8", 2), (None, "8", 3)) == [("1", "8"), ("2", "8")]
    assert run(("1", "8", 10), ("3", "8", 11)) == [("1", "8"), ("2", "8"), ("3", "8")]
    assert sum(seen) == 4  # two pairs, an incomplete one, then one new pair
    # Rows whose own times are old are not late, and what comes again is in the table.
    later = run(("9", "9", 5000)) and run(("1", "8", -3000), ("9", "9", -3000), ("0", "0", -9000))
    assert later == [("0", "0"), ("1", "8"), ("2", "8"), ("3", "8"), ("9", "9")]
    assert spark.read.parquet(bad).count() == 1


def test_early_and_late_run_events_settle_alike(spark, lending):
    schema = "queryExecutionId string, currentState string, ts timestamp"
    late, early = datetime(2024, 6, 2), datetime(2024, 6, 1)
    lending.track(spark.createDataFrame([("r", "SUCCEEDED", late)], schema), NOW)
    lending.track(spark.createDataFrame([("r", "FAILED", early)], schema), NOW)
    request = spark.createDataFrame([("r", "booksOnLoan")], "taskId string, mutationName string")
    lending.runs.append(runs.open_runs(request, NOW, lending.runs.scan()), NOW)
    lending._settle(NOW, request.select("taskId"))
    row = lending.runs.scan().first()
    assert row.taskStatus == "SUCCEEDED" and row.finishDate == late


def test_null_aggregates_stay_null(spark):
    base = spark.createDataFrame([(1, None), (2, 5), (3, None)], "k int, total int")
    grouped = spark.createDataFrame([(1, None, 1), (2, 3.0, 2)], "k int, s double, n int")
    got = queries.agg_star(base, "k", grouped, {"s": 0.0, "n": 0, "total": 9}).collect()
    assert sorted((r.k, r.total, r.s, r.n) for r in got) == [
        (1, None, None, 1), (2, 5, 3.0, 2), (3, None, 0.0, 0),
    ]


def test_run_ids_stay_in_their_folder(spark, tmp_path):
    for run_id in ("x/../../y", "", "a b", ".."):
        with pytest.raises(ValueError):
            files.save_result(spark.range(1), str(tmp_path), run_id)


def test_nanoseconds_are_floored_to_microseconds(spark, tmp_path):
    spec = EntitySpec("Tick", {"id": "ID!", "at": "AWSDateTime!"})
    micros = [1_700_000_000_123_456 + 7 * i for i in range(1000)] + [-1, -1_000_001]
    rows = [(str(i), m * 1000 + i % 1000) for i, m in enumerate(micros)]
    path = str(tmp_path / "ticks")
    spark.createDataFrame(rows, "id string, at long").write.parquet(path)
    got = files.scan_nanos(spark, spec, path).selectExpr("id", "unix_micros(at) as m").collect()
    assert {int(r.id): r.m for r in got} == dict(enumerate(micros))


def test_a_deep_offset_sorts_only_its_ranges(spark):
    df = spark.range(300_000).selectExpr("id", "id % 7 as g")
    page = queries.page(df, [("g", True), ("id", False)], 5, offset=200_000)
    want = sorted(((i % 7, i) for i in range(300_000)), key=lambda r: (-r[0], r[1]))[200_000:200_005]
    assert [(r.g, r.id) for r in page.collect()] == want
    assert queries.page(df, [("id", False)], 5, offset=10**6).collect() == []


def test_thousands_of_undeclared_names(spark):
    from tidelake.operators import ingest

    image = "{" + ",".join(f'"n{i}": {{"N": "{i}"}}' for i in range(6000)) + "}"
    df = spark.createDataFrame([(image,)], "image string")
    kinds = ingest.infer_kinds(df)
    assert kinds.count() == 6000
    assert [r.kind for r in kinds.select("kind").distinct().collect()] == ["Int"]
    row = ingest.infer(df, ["n7", "absent"]).first()
    assert (row.n7, row.absent, len(row._others)) == (7, None, 5999)
    assert ingest.infer_fields(df, []) == []
    assert len(ingest.infer(df, []).first()._others) == 6000


def test_deletion_is_a_run(spark, tmp_path):
    lake = Lake(
        spark,
        str(tmp_path / "lake"),
        relations=[RelationSpec("loans", {"readerId": "Reader", "bookId": "Book"})],
    )
    pairs = [("1", "7"), ("1", "8"), ("2", "7")]
    lake.relate("loans", spark.createDataFrame(pairs, "readerId string, bookId string"), NOW)
    lake.submit_deletion("loans", "gone-1", NOW, where="bookId = '7'")
    row, removed = lake.result("gone-1")
    assert (row.taskStatus, row.taskType, removed.count()) == ("SUCCEEDED", "deletionTask", 2)
    assert [(r.readerId, r.bookId) for r in lake.table("loans").scan().collect()] == [("1", "8")]
    # A run that comes again keeps its targets and removes what is due by then.
    lake.submit_deletion("loans", "gone-1", NOW, where="bookId = '7'")
    assert lake.result("gone-1")[1].count() == 2
    with pytest.raises(Exception):
        lake.submit_deletion("loans", "gone-2", NOW, where="no_such_column = 1")
    assert lake.result("gone-2")[0].taskStatus == "FAILED"
    assert lake.table("loans").scan().count() == 1


def test_a_run_in_the_background_can_be_cancelled(spark, tmp_path):
    import time

    long = "SELECT sum(a.id * b.id) AS n FROM range(0, 100000000) a, range(0, 1000000) b WHERE a.id <> b.id"
    lake = Lake(
        spark,
        str(tmp_path / "lake"),
        queries=[QuerySpec("forever", long), QuerySpec("quick", "SELECT count(*) AS n FROM range(0, 10)")],
    )
    quick = lake.submit_background("quick", "q", NOW)
    quick.join(120)
    assert lake.result("q")[0].taskStatus == "SUCCEEDED"
    assert [r.n for r in lake.result("q")[1].collect()] == [10]
    thread = lake.submit_background("forever", "f", NOW)
    time.sleep(3)
    assert lake.result("f")[0].taskStatus == "RUNNING"
    lake.cancel("f")
    thread.join(120)
    assert not thread.is_alive()
    status, rows = lake.result("f")
    assert status.taskStatus == "FAILED" and rows is None


def test_declared_dates_as_iso_text(spark):
    asked = QuerySpec(
        "opened",
        "SELECT timestamp '2024-05-05 10:00:00' AS openedAt",
        returns=ResponseSpec("Shop", {"openedAt": "AWSDateTime!"}),
        iso_dates=True,
    )
    assert queries.run(spark, asked).first().openedAt == "2024-05-05T10:00:00.000Z"
