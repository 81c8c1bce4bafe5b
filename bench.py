"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts. The
whole result is computed and thrown away. Next to the times stand the measurements
"""

from __future__ import annotations

import json
import os
import statistics
import time

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import entities, relations
from tidelake.plans import QUERIES
from tidelake.plans import fixtures as fx
from tidelake.session import build_session, new_dir
from tidelake.sources import files
from tidelake.sources.lake import LakeTable

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "m2m_join",
    "m2m_join_shaped",
    "inner_join",
    "left_join_count",
    "double_left_join",
    "global_agg",
    "group_report",
    "count_over",
    "top_k",
    "ilike_contains",
    "lookback_window",
    "partition_filter",
    "agg_star",
    "relation_ordered",
    "shape_result",
    "page",
    "relation_id",
    "relation_insert",
    "relation_edges",
    "relation_delete_join",
    "apply_relation_delete",
    "cascade_delete",
    "nary_relation",
    "decode_image",
    "enforce_types",
    "latest_state",
    "upsert_entities",
    "partial_update",
    "upsert_out_of_order",
    "ingest_rejects",
    "stream_lake",
    "run_state",
    "run_reconcile",
    "lake_write",
    "sql_rank",
    "sql_range_join",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def headline(spark: SparkSession) -> dict[str, float]:
    times = {}
    for name in HEADLINE:
        query = QUERIES[name]
        run(query(spark, SF_DIR))
        laps = [seconds(lambda q=query: run(q(spark, SF_DIR))) for _ in range(RUNS)]
        times[name] = round(statistics.median(laps), 3)
    return times


def _size(path: str) -> int:
    return sum(
        os.path.getsize(os.path.join(folder, name))
        for folder, _, names in os.walk(path)
        for name in names
        if name.startswith("part-")
    )


def sizes(spark: SparkSession) -> dict[str, float]:
    """Bytes of SNAPPY Parquet per byte of JSON."""
    ratios = {}
    for name in ("orders", "events", "documents"):
        table = fx.table(spark, SF_DIR, name)
        parquet, text = new_dir(spark, "size-parquet"), new_dir(spark, "size-json")
        table.write.option("compression", "snappy").parquet(parquet)
        table.write.json(text)
        ratios[name] = round(_size(parquet) / _size(text), 3)
    return ratios


def _column_bytes(name: str, column: str) -> int:
    """Compressed bytes of a column, which is what a scan of it alone reads."""
    meta = pq.ParquetFile(f"{SF_DIR}/{name}.parquet").metadata
    at = meta.schema.names.index(column)
    groups = (meta.row_group(i).column(at) for i in range(meta.num_row_groups))
    return sum(c.total_compressed_size for c in groups)


def pruning(spark: SparkSession) -> dict[str, float]:
    """A narrow column against the wide one, a month against the whole table."""
    documents = fx.table(spark, SF_DIR, "documents")
    lake = fx.lake_of(spark, SF_DIR, "order")
    month = files.scan(spark, fx.ORDER, lake, where="year = '2000' and month = '06'")
    whole = files.scan(spark, fx.ORDER, lake)
    work = {
        "documents_narrow_sec": documents.select(F.sum("n_chars")),
        "documents_wide_sec": documents.select(F.sum(F.length("text"))),
        "orders_month_sec": month.agg(F.sum("total")),
        "orders_all_sec": whole.agg(F.sum("total")),
    }
    out = {}
    for name, df in work.items():
        run(df)
        out[name] = round(seconds(lambda d=df: run(d)), 3)
    for name, df in (("orders_month_files", month), ("orders_all_files", whole)):
        out[name] = df.select(F.input_file_name()).distinct().count()
    for name, column in (("documents_narrow_bytes", "n_chars"), ("documents_wide_bytes", "text")):
        out[name] = _column_bytes("documents", column)
    return out


def applying(spark: SparkSession) -> dict[str, float]:
    """Change rows per second into a table, the replay, and what compaction is worth."""
    changes = fx.typed_events(spark, SF_DIR)
    rows = changes.count()
    table = LakeTable(spark, new_dir(spark, "bench-account"), fx.ACCOUNT)
    first = seconds(lambda: table.merge(changes, fx.NOW, batch=1))
    replay = seconds(lambda: table.merge(changes, fx.NOW, batch=1))
    few = changes.orderBy("seq").limit(10)
    again = seconds(lambda: table.merge(few, fx.NOW, batch=2))
    scattered = new_dir(spark, "bench-scattered")
    state = entities.latest(changes, "id").select("id", "value", "createdAt")
    dated = fx.with_partitions(state, fx.NOW)
    dated.repartition(dated.count()).write.partitionBy("year", "month", "day").parquet(scattered)
    compacted = new_dir(spark, "bench-compacted")
    scattered_df = spark.read.parquet(scattered)
    files.arrange(scattered_df).write.partitionBy("year", "month", "day").parquet(compacted)
    out = {"merge_rows_per_sec": round(rows / first), "replay_sec": round(replay, 3)}
    out["merge_10_rows_into_filled_sec"] = round(again, 3)
    for name, path in (("file_per_row_scan_sec", scattered), ("compacted_scan_sec", compacted)):
        df = spark.read.parquet(path).agg(F.sum("value"))
        run(df)
        out[name] = round(seconds(lambda d=df: run(d)), 3)
    return out


def cascades(spark: SparkSession) -> dict[str, float]:
    """Cascading deletes of about 1 % and 10 % of all customers, by balance."""
    rel = fx.customer_parts_relation(spark, SF_DIR)
    index = relations.edges(fx.CUSTOMER_PARTS, rel)
    customers = fx.table(spark, SF_DIR, "customer")
    out = {}
    for share in (0.01, 0.10):
        limit = customers.approxQuantile("c_acctbal", [share], 0.0)[0]
        deleted = customers.filter(F.col("c_acctbal") < limit).select(
            F.lit("customer").alias("entityType"),
            F.col("c_custkey").cast("string").alias("entityId"),
        )

        def work(deleted=deleted):
            left_edges, left = relations.cascade(deleted, index, {"customer_parts": rel})
            run(left["customer_parts"])
            run(left_edges)

        work()
        out[f"cascade_{share:.0%}_sec"] = round(seconds(work), 3)
    return out


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = headline(spark)
    measured = {"parquet_to_json": sizes(spark)}
    for part in (pruning, applying, cascades):
        measured |= part(spark)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rsplit("sf", 1)[-1].strip("/"),
        "measurements": measured,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
