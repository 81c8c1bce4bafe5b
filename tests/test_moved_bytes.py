"""What relations store and shuffle: members, not the ids and keys that follow from them."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tests.test_plans import plan
from tidelake import Lake, RelationSpec
from tidelake.operators import relations
from tidelake.plans import fixtures as fx
from tidelake.sources import files
from tidelake.sources.lake import LakeTable

NOW = "2024-06-01T00:00:00Z"
SF = "/root/testdata/sf0.001"
LOANS = RelationSpec("loans", {"readerId": "Reader", "bookId": "Book"})
PAIRS = [("1", "7"), ("1", "8"), ("2", "7"), ("3", "9")]


def pairs_of(spark, pairs):
    return spark.createDataFrame(pairs, "readerId string, bookId string")


def stored_columns(spark, df):
    return {c for f in df.inputFiles() for c in spark.read.parquet(f).columns}


@pytest.mark.parametrize("name", ["duplicate_column", "relation_ordered", "relation_delete_join"])
def test_the_stored_relation_is_narrow(spark, name):
    entry_points.queries()[name](spark, SF)
    rel = fx.customer_parts_relation(spark, SF)
    assert stored_columns(spark, rel) == {"customerId", "partId", "createdAt"}
    assert set(fx.CUSTOMER_PARTS.columns) <= set(rel.columns)


def test_a_deleting_join_knows_the_size_of_its_partners(spark, tmp_path):
    """A filtered table whose file is beyond the broadcast threshold, but whose keys are not."""
    path = str(tmp_path / "books")
    wide = F.concat(*[F.sha2(F.concat("id", F.lit(str(i))), 256) for i in range(8)])
    books = spark.range(4000).select(F.col("id").cast("string").alias("id"))
    books.select(F.col("id").alias("bookId"), wide.alias("text")).coalesce(1).write.parquet(path)
    rel = relations.relation_rows(LOANS, pairs_of(spark, PAIRS), NOW)
    rel.write.parquet(str(tmp_path / "rel"))
    rel = spark.read.parquet(str(tmp_path / "rel"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        other = spark.read.parquet(path).filter("bookId = '7' and text is not null").select("bookId")
        hit = relations.delete_targets(rel, other=other, on=["bookId"])
        text = plan(hit)
        assert hit.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_an_insert_stores_members_only(spark):
    stored = relations.insert(LOANS, pairs_of(spark, PAIRS[:2]), now=NOW).rows
    done = relations.insert(LOANS, pairs_of(spark, PAIRS), stored, NOW)
    assert (done.rows.count(), done.repeats.count()) == (2, 2)
    assert not stored_columns(spark, done.rows) & {"s3Key"}
    columns = [set(spark.read.parquet(f).columns) for f in done.rows.inputFiles()]
    assert {"readerId", "bookId", "createdAt"} in columns and {"relationId"} in columns
    empty = spark.createDataFrame([], LOANS.schema())
    first = relations.insert(LOANS, pairs_of(spark, PAIRS), empty, NOW)
    assert (first.rows.count(), first.repeats.count()) == (4, 0)


def test_whole_rows_move_without_what_follows_from_them(spark):
    """Own ids, own keys, nulls and missing members come back as they were."""
    own = relations.relation_rows(LOANS, pairs_of(spark, PAIRS), NOW)
    odd = own.limit(1)
    rows = (
        own.unionByName(odd.withColumn("relationId", F.lit("own")))
        .unionByName(odd.withColumn("s3Key", F.lit("k")))
        .unionByName(odd.withColumn("s3Key", F.lit(None).cast("string")))
        .unionByName(odd.withColumn("relationId", F.lit(None).cast("string")))
        .unionByName(odd.withColumn("bookId", F.lit(None).cast("string")))
        .unionByName(odd.withColumn("createdAt", F.lit(None).cast("timestamp")))
    )
    packed = relations.packed(LOANS, rows)
    assert packed.filter("_id and _key").filter("relationId is not null or s3Key is not null").isEmpty()
    assert packed.filter("_id and _key").count() == 4
    back = relations.unpacked(LOANS, packed).select(*rows.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    dated = rows.withColumns({"year": F.lit("2024"), "month": F.lit("06"), "day": F.lit("01")})
    arranged = files.arrange(dated, "relationId", LOANS).select(*rows.columns)
    assert sorted(map(repr, arranged.collect())) == sorted(map(repr, rows.collect()))


def test_a_relation_is_written_packed(spark, tmp_path, monkeypatch):
    moved, packed = [], files.packed
    monkeypatch.setattr(files, "packed", lambda spec, df: moved.append(spec) or packed(spec, df))
    table = LakeTable(spark, str(tmp_path / "t"), LOANS)
    table.append(relations.insert(LOANS, pairs_of(spark, PAIRS), now=NOW).rows, NOW)
    assert moved == [LOANS] and table.scan().count() == 4


def test_a_deletion_seeks_no_keys_and_a_repeat_removes_what_was_stored(spark, tmp_path, monkeypatch):
    lake, removed, remove = Lake(spark, str(tmp_path / "lake"), relations=[LOANS]), [], LakeTable.remove

    def counted(self, keys):
        removed.append(keys.count())
        return remove(self, keys)

    monkeypatch.setattr(LakeTable, "remove", counted)
    lake.relate("loans", pairs_of(spark, PAIRS), NOW)
    books = spark.createDataFrame([("7",), ("7",)], "bookId string")
    lake.submit_deletion("loans", "r1", NOW, where="readerId <> '2'", other=books, on=["bookId"])
    left = lambda: sorted((r.readerId, r.bookId) for r in lake.table("loans").scan().collect())
    assert left() == [("1", "8"), ("2", "7"), ("3", "9")] and removed == []
    assert lake.result("r1")[1].count() == 1
    # What an attempt stored is removed by the next one, even where the condition misses it now.
    lake.relate("loans", pairs_of(spark, PAIRS), NOW)
    lake.submit_deletion("loans", "r1", NOW, where="bookId = '9'")
    assert left() == [("1", "8"), ("2", "7")] and removed == [2]


def test_rows_that_a_condition_does_not_settle_stay(spark):
    rel = relations.relation_rows(LOANS, pairs_of(spark, [*PAIRS, ("4", "7")]), NOW)
    rel = rel.withColumn("s3Key", F.when(F.col("readerId") != "4", F.col("s3Key")))
    rel = rel.withColumn("bookId", F.when(F.col("readerId") != "3", F.col("bookId")))
    hit, rest = relations.split(rel, "bookId = '7'")
    assert sorted(r.readerId for r in hit.collect()) == ["1", "2"]
    assert sorted(r.readerId for r in rest.collect()) == ["1", "3", "4"]


@pytest.mark.parametrize("how", ["apply", "cascade"])
def test_what_is_deleted_is_stored_once(spark, how):
    rel = relations.relation_rows(LOANS, pairs_of(spark, PAIRS), NOW)
    index = relations.edges(LOANS, rel)
    if how == "apply":
        targets = relations.delete_targets(rel, F.col("bookId") == "7")
        left, edges = relations.apply_delete(rel, index, targets)
    else:
        gone = spark.createDataFrame([("book", "7")], "entityType string, entityId string")
        edges, kept = relations.cascade(gone, index, {"loans": rel})
        left = kept["loans"]
    assert left.inputFiles() and set(left.inputFiles()) == set(edges.inputFiles())
    assert (left.count(), edges.count()) == (2, 4)
