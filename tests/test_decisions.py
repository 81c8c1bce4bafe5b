"""The behaviour contracts, one small frame each."""

import json
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelake import EntitySpec, Field, QuerySpec, RelationSpec, ResponseSpec
from tidelake.functions.ids import legacy_key, relation_id
from tidelake.operators import entities, ingest, queries, relations, results, runs
from tidelake.sources import files

NOW = "2024-06-01T00:00:00Z"
UTC_NOW = datetime(2024, 6, 1)
FAVOURITES = RelationSpec("user_favorite_products", {"userId": "User", "productId": "Product"})


def images(spark, *items):
    return spark.createDataFrame([(json.dumps(i),) for i in items], "image string")


def naive(spark, df, column):
    return [r[0] for r in df.select(F.col(column).cast("timestamp_ntz")).collect()]


def test_int_is_long_and_float_is_double(spark):
    fields = [Field.of("n", "Int"), Field.of("x", "Float")]
    df = ingest.decode(images(spark, {"n": {"N": "5000000000"}, "x": {"N": "0.1"}}), fields)
    row = ingest.enforce(df, fields).first()
    assert (row.n, row.x) == (5000000000, 0.1)


@pytest.mark.parametrize(
    "text,value,errors",
    [("4.9", 4, []), ("-4.9", -4, []), ("1e3", 1000, []), ("abc", None, ["n"]), (None, None, [])],
)
def test_int_from_text(spark, text, value, errors):
    df = spark.createDataFrame([(text,)], "n string")
    row = ingest.enforce(df, [Field.of("n", "Int")]).first()
    assert (row.n, row._cast_errors) == (value, errors)


def test_boolean_keeps_null_and_parses_text(spark):
    df = spark.createDataFrame([("true",), ("false",), (None,), ("perhaps",)], "b string")
    rows = ingest.enforce(df, [Field.of("b", "Boolean")]).collect()
    assert [r.b for r in rows] == [True, False, None, None]
    assert [r._cast_errors for r in rows] == [[], [], [], ["b"]]


def test_lists_stay_lists(spark):
    fields = [Field.of("tags", "[String!]"), Field.of("ns", "[Int]")]
    item = {
        "tags": {"L": [{"S": "a"}, {"NULL": True}, {"N": "7"}, {"BOOL": True}, {"M": {"k": {"S": "v"}}}]},
        "ns": {"L": [{"N": "1"}, {"S": "two"}]},
    }
    row = ingest.enforce(ingest.decode(images(spark, item), fields), fields).first()
    assert row.tags == ["a", None, "7", "true", '{"k":{"S":"v"}}']
    assert row.ns == [1, None]
    assert row._cast_errors == ["ns"]


def test_nested_values_of_a_scalar_field_become_json(spark):
    fields = [Field.of("m", "String"), Field.of("l", "String"), Field.of("gone", "String")]
    item = {"m": {"M": {"k": {"N": "69"}}}, "l": {"L": [{"S": "x"}]}, "gone": {"NULL": True}}
    row = ingest.decode(images(spark, item), fields).first()
    assert (row.m, row.l, row.gone) == ('{"k":"69"}', '["x"]', None)


def test_malformed_image_does_not_fail_the_batch(spark):
    df = spark.createDataFrame([("not json",), ('{"id":{"S":"1"}}',)], "image string")
    assert sorted(r.id or "" for r in ingest.decode(df, [Field.of("id", "ID")]).collect()) == ["", "1"]


def test_text_declared_as_string_is_never_a_number(spark):
    fields = [Field.of("zip", "String")]
    assert ingest.enforce(ingest.decode(images(spark, {"zip": {"S": "00123"}}), fields), fields).first().zip == "00123"


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2025-06-15T13:27:31.659Z", datetime(2025, 6, 15, 13, 27, 31, 659000)),
        ("2025-06-15T23:30:00-05:00", datetime(2025, 6, 16, 4, 30)),
        ("2025-06-15 10:00:00", datetime(2025, 6, 15, 10)),
        ("2025-06-15", datetime(2025, 6, 15)),
        ("2025", None),
        ("soon", None),
        ("2025-13-45T00:00:00Z", None),
    ],
)
def test_iso_text_to_timestamp_ignores_session_zone(spark, text, expected):
    df = spark.createDataFrame([(text,)], "at string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        micros = ingest.enforce(df, [Field.of("at", "AWSDateTime")]).select(F.unix_micros("at")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = None if expected is None else int((expected - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert micros == want


def test_partition_is_the_utc_date_and_falls_back_to_now(spark):
    rows = [("2025-06-15T23:30:00-05:00",), ("nonsense",), (None,), ("2031-01-02T00:00:00Z",)]
    df = ingest.with_partitions(spark.createDataFrame(rows, "createdAt string"), NOW)
    got = [(r.year, r.month, r.day) for r in df.collect()]
    assert got == [("2025", "06", "16"), ("2024", "06", "01"), ("2024", "06", "01"), ("2031", "01", "02")]


def test_inference_needs_every_value_to_agree(spark):
    df = images(
        spark,
        {"a": {"S": "2024-01-01T00:00:00Z"}, "b": {"S": "2024"}, "c": {"N": "1"}, "d": {"BOOL": True}},
        {"a": {"S": "later"}, "b": {"S": "2025"}, "c": {"N": "1.5"}, "d": {"NULL": True}},
        {"e": {"S": "2024-01-01"}, "f": {"N": "3"}, "g": {"N": "3"}},
        {"g": {"S": "three"}},
    )
    kinds = {f.name: f.kind for f in ingest.infer_fields(df, list("abcdefg"))}
    assert kinds == {
        "a": "String", "b": "String", "c": "Float", "d": "Boolean", "e": "AWSDateTime",
        "f": "Int", "g": "String",
    }


def test_routing(spark):
    rows = [
        ("INSERT", "user#1", "user", None, None, None, "entity"),
        ("REMOVE", "user#1", "user", None, None, None, "entity"),
        ("INSERT", "task#1", "task", None, None, None, "dropped"),
        ("INSERT", "x", None, None, None, None, "dropped"),
        ("INSERT", "joinRelation#user#1", "joinRelation", None, None, "r", "dropped"),
        ("REMOVE", "joinRelation#user#1", "joinRelation", None, None, "r", "dropped"),
        ("INSERT", "joinTableData#r", "fav", "fav", "fav", "r", "relation"),
        ("REMOVE", "joinTableData#r", "fav", "fav", "fav", "r", "dropped"),
        ("INSERT", "joinTableData#r", "fav", "fav", None, None, "dropped"),
        ("INSERT", "relation#fav#user#1", "fav", "fav", None, None, "legacy_relation"),
        ("REMOVE", "relation#fav#user#1", "fav", "fav", None, None, "legacy_relation"),
    ]
    schema = "op string, PK string, entityType string, joinTable string, joinTableName string, relationId string, want string"
    df = spark.createDataFrame(rows, schema).withColumn("got", ingest.route_of())
    assert [r.got for r in df.collect()] == [r[-1] for r in rows]


def test_relation_id_matches_the_worked_value(spark):
    import hashlib

    df = spark.createDataFrame([("123", "456")], "userId string, productId string")
    text = "user_favorite_products|product:456|user:123"
    got = df.select(relation_id(FAVOURITES)).first()[0]
    assert got == hashlib.sha256(text.encode()).hexdigest()[:32]


def test_self_relation_direction(spark):
    both = spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string")
    plain = RelationSpec("follows", {"x": "User", "y": "User"})
    directed = RelationSpec("follows", {"x": "User", "y": "User"}, directed=True)
    assert both.select(relation_id(plain)).distinct().count() == 1
    assert both.select(relation_id(directed)).distinct().count() == 2
    assert relations.insert(plain, both, now=NOW).rows.count() == 1
    assert relations.insert(directed, both, now=NOW).rows.count() == 2


def test_members_that_spell_one_id_count_once(spark):
    rel = RelationSpec("t", {"a": "A", "b": "B"})
    rows = spark.createDataFrame([("1|b:2", "3"), ("1", "2|b:3")], "a string, b string")
    assert relations.insert(rel, rows, now=NOW).rows.count() == 1


def test_incomplete_members_are_rejected(spark):
    rows = spark.createDataFrame([("1", None), ("", "2"), ("1", "2")], "userId string, productId string")
    done = relations.insert(FAVOURITES, rows, now=NOW)
    assert (done.rows.count(), done.rejected.count()) == (1, 2)
    with pytest.raises(ValueError):
        RelationSpec("empty", {})


def test_only_declared_columns_are_stored(spark):
    rows = spark.createDataFrame([("1", "2", "x")], "userId string, productId string, extra string")
    stored = relations.insert(FAVOURITES, rows, now=NOW).rows
    assert stored.columns == ["relationId", "userId", "productId", "s3Key", "createdAt"]
    row = stored.first()
    assert row.s3Key == f"tables/user_favorite_products/year=2024/month=06/day=01/{row.relationId}.parquet"


def test_storage_key_is_lower_case(spark):
    rel = RelationSpec("UserLikes", {"userId": "User"})
    df = relations.insert(rel, spark.createDataFrame([("1",)], "userId string"), now=NOW).rows
    assert df.first().s3Key.startswith("tables/userlikes/")


def test_targets_without_keys_are_ignored(spark):
    rel = relations.insert(
        FAVOURITES, spark.createDataFrame([("1", "2"), ("1", "3")], "userId string, productId string"), now=NOW
    ).rows
    ids = [r.relationId for r in rel.orderBy("productId").collect()]
    targets = spark.createDataFrame([("k", ids[0]), (None, ids[1]), ("k", None)], "s3Key string, relationId string")
    left, index = relations.apply_delete(rel, relations.edges(FAVOURITES, rel), targets)
    assert [r.relationId for r in left.collect()] == [ids[1]]
    assert {r.relationId for r in index.collect()} == {ids[1]}


def test_legacy_key(spark):
    df = spark.createDataFrame([("relation#user_posts#user#123", "relation#user_posts#post#456"), ("a", "b#c")], "pk string, sk string")
    assert [r[0] for r in df.select(legacy_key(F.col("pk"), F.col("sk"))).collect()] == ["user_123_post_456", ""]


def test_tie_on_time_is_broken_by_sequence(spark):
    at = datetime(2024, 1, 1)
    rows = [("a", 1, "MODIFY", at, 1), ("a", 2, "MODIFY", at, 2), ("b", 1, "INSERT", at, 1), ("b", 2, "REMOVE", at, 2)]
    df = spark.createDataFrame(rows, "id string, v int, op string, ts timestamp, seq long")
    assert [(r.id, r.v) for r in entities.latest(df, "id").collect()] == [("a", 2)]


def test_patch_tells_null_from_absent(spark):
    spec = EntitySpec("User", {"id": "ID!", "name": "String", "age": "Int"})
    old = datetime(2020, 1, 1)
    table = spark.createDataFrame(
        [("1", "ann", 30, old, old), ("2", "bob", 40, old, old)],
        "id string, name string, age long, createdAt timestamp, updatedAt timestamp",
    )
    at = datetime(2024, 1, 1)
    patches = spark.createDataFrame(
        [("1", None, None, ["name"], at, 1), ("1", None, 31, ["age"], at, 2), ("9", "zoe", None, ["name"], at, 3)],
        "id string, name string, age long, _present array<string>, ts timestamp, seq long",
    )
    got, unknown = entities.patch(table, patches, spec)
    rows = {r.id: r for r in got.collect()}
    assert (rows["1"].name, rows["1"].age) == (None, 31)
    assert rows["1"].updatedAt == at and rows["1"].createdAt == old
    assert (rows["2"].name, rows["2"].updatedAt) == ("bob", old)
    assert [r.id for r in unknown.collect()] == ["9"]
    ack = {r.id: r for r in entities.patch_ack(patches, spec, NOW).collect()}
    assert sorted(ack["1"]._present) == ["age", "name"] and ack["9"]._present == ["name"]


def test_presence_comes_from_the_image(spark):
    fields = [Field.of("a", "String"), Field.of("b", "String")]
    df = ingest.decode(images(spark, {"a": {"NULL": True}}), fields, presence=True)
    assert df.first()._present == ["a"]


def test_create_overrides_timestamps_and_ignores_given_id(spark):
    spec = EntitySpec("User", {"id": "ID!", "name": "String!"})
    rows = spark.createDataFrame([("mine", "ann", "1999-01-01")], "id string, name string, createdAt string")
    row = entities.create(rows, spec, NOW).first()
    assert row.id != "mine" and len(row.id) == 36
    assert row.createdAt == row.updatedAt == UTC_NOW
    again = [entities.create(rows, spec, NOW, ["name"]).first().id for _ in range(2)]
    assert again[0] == again[1]


def test_read_strict_names_a_missing_id(spark):
    table = spark.createDataFrame([("1",)], "id string")
    with pytest.raises(LookupError):
        entities.read_strict(table, spark.createDataFrame([("1",), ("2",)], "id string")).count()


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_non_finite_numbers_are_refused(bad):
    with pytest.raises(ValueError):
        queries.check_args({"x": bad})


@pytest.mark.parametrize("bad", [[1], {"a": 1}, (1,), object()])
def test_other_argument_kinds_are_refused(bad):
    with pytest.raises(TypeError):
        queries.check_args({"x": bad})


def test_arguments_are_values_not_text(spark):
    text = "it's $args.other; :name -- x"
    row = queries.bound(spark, "SELECT :name AS a, :other AS b", {"name": text, "other": "o"}).first()
    assert (row.a, row.b) == (text, "o")
    idlike = queries.bound(spark, "SELECT :id AS a, :idType AS b", {"id": "1", "idType": "t"}).first()
    assert (idlike.a, idlike.b) == ("1", "t")


def test_declared_defaults_and_missing_arguments():
    q = QuerySpec("q", "", {"days": "Int", "name": "String", "need": "ID!"}, {"days": 7})
    assert queries.resolve_args(q, {"need": 5}) == {"days": 7, "name": None, "need": "5"}
    with pytest.raises(ValueError):
        queries.resolve_args(q, {})
    with pytest.raises(ValueError):
        queries.resolve_args(q, {"need": "1", "typo": 1})
    with pytest.raises(TypeError):
        queries.resolve_args(q, {"need": "1", "days": True})
    with pytest.raises(TypeError):
        queries.resolve_args(QuerySpec("q", "", {"ids": "[ID!]"}), {"ids": ["1"]})


def test_shape_matches_by_case_not_by_spelling(spark):
    spec = ResponseSpec("R", {"totalOrders": "Int!"})
    assert results.shape(spark.sql("SELECT 3 AS totalorders"), spec).first().totalOrders == 3
    with pytest.raises(ValueError):
        results.shape(spark.sql("SELECT 3 AS total_orders"), spec)


def test_shape_last_duplicate_wins_and_extras_go(spark):
    spec = ResponseSpec("R", {"id": "ID!", "note": "String"})
    df = results.shape(spark.sql("SELECT 1 AS id, 'x' AS other, 2 AS ID"), spec)
    assert df.columns == ["id", "note"]
    assert tuple(df.first()) == ("2", None)


def test_iso_text(spark):
    df = spark.createDataFrame(
        [("2025-12-09 09:38:26.778",), ("2025-12-09T09:38:26",), ("2025-12-09T09:38:26+02:00",), (None,)], "at string"
    )
    got = [r.at for r in results.iso(df, ["at"]).collect()]
    assert got == ["2025-12-09T09:38:26.778Z", "2025-12-09T09:38:26Z", "2025-12-09T09:38:26+02:00", None]


def test_single_statement_gives_row_or_none(spark):
    rows = spark.createDataFrame([(1,), (2,)], "n int")
    one = QuerySpec("q", "SELECT n FROM t_single WHERE n > :low ORDER BY n", {"low": "Int!"}, is_list=False)
    assert queries.statement(spark, one, {"low": 0}, {"t_single": rows}).n == 1
    assert queries.statement(spark, one, {"low": 9}, {"t_single": rows}) is None


def test_pages_cover_everything_once_with_nulls(spark):
    values = [(k, None if k % 7 == 0 else k % 5) for k in range(100)]
    df = spark.createDataFrame(values, "id int, v int")
    for order in ([("v", True), ("id", False)], [("v", False), ("id", True)]):
        seen, after = [], None
        while True:
            rows = queries.page(df, order, 13, after=after).collect()
            if not rows:
                break
            seen += [r.id for r in rows]
            after = {"v": rows[-1].v, "id": rows[-1].id}
        assert sorted(seen) == list(range(100)) and len(seen) == 100
    assert queries.page(df, [("id", False)], 10, offset=10**9).count() == 0


def test_left_counts_equal_the_plain_joins(spark):
    base = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    a = spark.createDataFrame([(1, 10), (1, 11), (1, None), (2, 12), (None, 9)], "k int, x int")
    b = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 7)], "k int, y int")
    got = queries.left_counts(
        base, "k",
        queries.Branch(a.withColumnRenamed("k", "ak"), "ak", "x", "xs"),
        queries.Branch(b.withColumnRenamed("k", "bk"), "bk", "y", "ys", distinct=True),
        queries.Branch(b.withColumnRenamed("k", "bk2"), "bk2", "y", "all_ys"),
    )
    for name, df in (("lc_base", base), ("lc_a", a), ("lc_b", b)):
        df.createOrReplaceTempView(name)
    want = spark.sql(
        """SELECT lc_base.k, count(lc_a.x) xs, count(DISTINCT b1.y) ys, count(b2.y) all_ys FROM lc_base
        LEFT JOIN lc_a ON lc_base.k = lc_a.k LEFT JOIN lc_b b1 ON lc_base.k = b1.k
        LEFT JOIN lc_b b2 ON lc_base.k = b2.k GROUP BY lc_base.k"""
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_run_state_rules(spark):
    ids = spark.createDataFrame([(i,) for i in "abcd"], "taskId string")
    opened = runs.open_runs(ids, NOW)
    t = datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [
            ("a", "SUCCEEDED", t), ("b", "FAILED", None), ("c", "RUNNING", t), ("zz", "FAILED", t),
            ("d", "SUCCEEDED", t), ("d", "CANCELLED", datetime(2024, 1, 2)), (None, "FAILED", t), ("", "FAILED", t),
        ],
        "queryExecutionId string, currentState string, ts timestamp",
    )
    state = {r.taskId: r for r in runs.run_state(opened, events, NOW).collect()}
    assert {k: r.taskStatus for k, r in state.items()} == {
        "a": "SUCCEEDED", "b": "FAILED", "c": "RUNNING", "d": "FAILED",
    }
    assert state["a"].finishDate == t and state["b"].finishDate == UTC_NOW and state["c"].finishDate is None
    assert [r.queryExecutionId for r in runs.unknown_events(events, opened).collect()] == ["zz"]


def test_reconcile_keeps_stored_outcomes(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "taskId string")
    t = datetime(2024, 1, 1)
    schema = "queryExecutionId string, currentState string, ts timestamp"
    stored = runs.run_state(runs.open_runs(ids, NOW), spark.createDataFrame([("a", "FAILED", t)], schema), NOW)
    seen = spark.createDataFrame([("a", "SUCCEEDED", t), ("b", "SUCCEEDED", t), ("c", "QUEUED", t)], "taskId string, state string, changedAt timestamp")
    got = {r.taskId: r.taskStatus for r in runs.reconcile(stored, seen, NOW).collect()}
    assert got == {"a": "FAILED", "b": "SUCCEEDED", "c": "RUNNING"}


def test_deletion_succeeds_only_after_removal(spark):
    ids = spark.createDataFrame([(i, "deletionTask") for i in "abc"], "taskId string, taskType string")
    opened = runs.open_runs(ids, NOW)
    seen = spark.createDataFrame(
        [("a", "SUCCEEDED", datetime(2024, 1, 1)), ("b", "SUCCEEDED", datetime(2024, 1, 1))],
        "taskId string, state string, changedAt timestamp",
    )
    gone = spark.createDataFrame([("a",)], "taskId string")
    got = {r.taskId: (r.taskStatus, r.finishDate is not None) for r in runs.deletion_view(opened, seen, NOW, gone).collect()}
    assert got == {"a": ("SUCCEEDED", True), "b": ("RUNNING", False), "c": ("FAILED", False)}


@pytest.mark.parametrize("top,kind", [(127, "tinyint"), (-128, "smallint"), (32768, "int"), (2**31, "bigint")])
def test_narrow_widths(spark, top, kind):
    df = spark.createDataFrame([(top,), (None,)], "n long")
    assert files.narrow(df).schema["n"].dataType.simpleString() == kind


def test_specs():
    spec = EntitySpec("User", {"PK": "ID", "id": "ID!", "age": "Int", "tags": "[String!]!", "kind": "UserKind"})
    assert spec.columns == ["id", "age", "tags", "kind", "createdAt", "updatedAt"]
    assert spec.schema().simpleString().startswith("struct<id:string,age:bigint,tags:array<string>,kind:string")
    assert [f.name for f in spec.input_fields("create")] == ["age", "tags", "kind"]
    assert not any(f.required for f in spec.input_fields("update"))
    for name in ("year", "Month", "__v"):
        with pytest.raises(ValueError):
            EntitySpec("Bad", {"id": "ID!", name: "Int"})


def test_scan_of_nanosecond_files_with_narrow_types(spark, tmp_path):
    spec = EntitySpec("Old", {"id": "ID!", "n": "Int", "x": "Float", "missing": "String"})
    folder = tmp_path / "year=2024" / "month=01" / "day=02"
    folder.mkdir(parents=True)
    stamp = pa.array([1704153600123456789], pa.timestamp("ns", tz="UTC"))
    columns = {
        "id": pa.array(["1"]), "n": pa.array([5], pa.int8()), "x": pa.array([0.5], pa.float32()),
        "createdAt": stamp, "updatedAt": stamp, "_event_name": pa.array(["INSERT"]),
    }
    pq.write_table(pa.table(columns), folder / "1.parquet", version="2.6")
    df = files.scan_nanos(spark, spec, str(tmp_path))
    assert df.columns == spec.columns + ["year", "month", "day"]
    row = df.first()
    assert (row.id, row.n, row.x, row.missing, row.month) == ("1", 5, 0.5, None, "01")
    assert naive(spark, df, "createdAt") == [datetime(2024, 1, 2, 0, 0, 0, 123456)]


def test_binary_and_sets(spark):
    fields = [Field.of("b", "Binary"), Field.of("ss", "[String]"), Field.of("ns", "[Int]"), Field.of("t", "String")]
    item = {"b": {"B": "aGk="}, "ss": {"SS": ["x", "y"]}, "ns": {"NS": ["1", "2"]}, "t": {"SS": ["z"]}}
    row = ingest.enforce(ingest.decode(images(spark, item), fields), fields).first()
    assert (bytes(row.b), row.ss, row.ns, row.t) == (b"hi", ["x", "y"], [1, 2], '["z"]')
    assert row._cast_errors == []


def test_text_members_deduplicate_with_and_without_separators(spark):
    rel = RelationSpec("t", {"a": "A", "b": "B"})
    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [("1", "2", late), ("1", "2", early), ("1|b:2", "3", late), ("1", "2|b:3", early), ("x", "y", late)]
    batch = spark.createDataFrame(rows, "a string, b string, createdAt timestamp")
    got = relations.insert(rel, batch).rows
    assert sorted((r.a, r.b, r.createdAt) for r in got.collect()) == [
        ("1", "2", early), ("1", "2|b:3", early), ("x", "y", late),
    ]
