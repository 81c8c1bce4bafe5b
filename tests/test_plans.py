"""Physical plans: what is pruned, pushed, and kept off single tasks."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tidelake.operators import queries
from tidelake.plans import QUERIES
from tidelake.plans import fixtures as fx
from tidelake.sources import files

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_joins_no_python_no_global_window(spark, name):
    text = plan(entry_points.queries()[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in text, f"{operator} in\n{text}"
    assert "Window [count(1)" not in text


def test_partition_filter_reaches_the_scan(spark):
    lake = fx.lake_of(spark, SF, "order")
    df = files.scan(spark, fx.ORDER, lake, where="year = '2000' and month = '06'").select("total")
    text = plan(df)
    scan = text[text.index("PartitionFilters"):].split("\n")[0]
    assert "2000" in scan and "06" in scan
    assert "ReadSchema: struct<total:double>" in text


def test_value_filter_is_pushed_and_columns_pruned(spark):
    text = plan(entry_points.queries()["lookback_window"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_count_over_has_no_window(spark):
    df = queries.count_over(fx.table(spark, SF, "orders").select("o_orderkey"))
    text = plan(df)
    assert "Window" not in text and "partial_count" in text


@pytest.mark.parametrize("name", ["top_k", "page", "page_offset", "single_row"])
def test_ordered_limits_keep_k_rows_per_task(spark, name):
    assert "TakeOrderedAndProject" in plan(entry_points.queries()[name](spark, SF))


def test_rank_filter_limits_groups_before_the_shuffle(spark):
    text = plan(entry_points.queries()["sql_rank"](spark, SF))
    assert text.count("WindowGroupLimit") >= 2


def test_writes_rebalance_instead_of_hashing_a_day_to_one_task(spark):
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(files.arrange(fx.order_rows(spark, SF), "id"))


@pytest.mark.parametrize("name", ["latest_state", "run_state", "partial_update", "left_join_count"])
def test_aggregates_reduce_before_the_shuffle(spark, name):
    assert "partial_" in plan(entry_points.queries()[name](spark, SF))


def test_numeric_relations_deduplicate_by_hash(spark):
    text = plan(entry_points.queries()["nary_relation"](spark, SF))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_edges_need_no_shuffle(spark):
    assert "Exchange" not in plan(entry_points.queries()["relation_edges"](spark, SF))


def test_ingest_is_one_pass_without_a_shuffle(spark):
    text = plan(entry_points.queries()["enforce_types"](spark, SF))
    assert "Exchange" not in text
    # The image is parsed in one place only.
    steps = text.split("\n(1) ")[-1]
    assert steps.count("from_json(") == 1


def test_upsert_broadcasts_the_changed_keys_not_the_table(spark):
    from tidelake.operators import entities

    changes = fx.typed_events(spark, SF)
    table = entities.latest(changes, "id").select(*fx.ACCOUNT.columns)
    big = spark.read.parquet(f"{SF}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("id"), "c_name"
    )
    kept = big.join(table.select("id"), "id", "left_anti")
    kept.collect()
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "LeftAnti, BuildRight" in text
