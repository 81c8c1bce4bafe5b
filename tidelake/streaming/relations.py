"""Associations from a stream, inserted if absent."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidelake.functions.ids import relation_id
from tidelake.operators import relations
from tidelake.session import cut
from tidelake.sources.journal import source_id
from tidelake.sources.lake import LakeTable
from tidelake.streaming.ingest import for_each_batch


def start_relate(
    pairs: DataFrame,
    table: LakeTable,
    checkpoint: str,
    now: datetime | str | Column,
    bad_path: str,
    within: str = "1 hour",
) -> StreamingQuery:
    """Insert each association that is not there yet, then stop; incomplete ones go to ``bad_path``.

    An association that arrives again inside ``within`` is dropped by the stream's own
    state, which forgets it after that, so it never reaches the table; the first to arrive
    is kept. What comes again later is found in the table. The window is one of arrival, as
    a watermark over the rows' own times would drop whatever is late. A batch that is
    delivered again finds its own rows there and inserts nothing. Equal incomplete rows
    inside the window are one.
    """
    spec = table.spec
    whole_row = F.to_json(F.struct(*pairs.columns))
    keyed = pairs.withColumn("_key", F.coalesce(relation_id(spec), whole_row))
    arrived = keyed.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    once = arrived.dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_arrived")

    def apply(batch: DataFrame, number: int, source: str) -> None:
        done = relations.insert(spec, cut(batch), table.scan(), now)
        attempt = f"source={source_id(source)}/batch={number}"
        done.rejected.write.mode("overwrite").parquet(f"{bad_path}/{attempt}")
        if not done.rows.isEmpty():
            table.append(done.rows, now)

    return for_each_batch(once, checkpoint, apply)
