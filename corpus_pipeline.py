"""A corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
``documents``. A stage's result is to be written before the next stage is called, which
deletes what the one before has stored for it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import jaccard, packing, substrings, toxicity
from tidelake.llm.workers import ready
from tidelake.session import cut, delete, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Tables that the results of earlier stages still read.
_HELD: list[str] = []


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; a null text scores as an empty one."""
    model = toxicity.train(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select(*COLUMNS), model, "_score")
    return scored.filter(F.col("_score") < toxicity.THRESHOLD).drop("_score")


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents, stored with a key ``row`` of each, as ids may repeat."""
    keyed = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row"))
    return _held(cut(keyed, codec="zstd"))


def _held(table: DataFrame) -> DataFrame:
    """A stored table that the next stage deletes."""
    _HELD.extend({os.path.dirname(f) for f in table.inputFiles()})
    return table


def _release(spark: SparkSession) -> None:
    """Delete what the last stage's result has read: it is written by now."""
    delete(spark, _HELD)
    _HELD.clear()


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group alike in 0.8 of five-word shingles: that of the smallest id.

    Candidates by SimHash and covering tables, then by exact signatures; both are verified by
    the whole shingle sets. Rows without an id are in no group and stay.
    """
    _release(ready(spark))
    docs = _keyed(docs)
    with scratch(spark):
        gone = _held(cut(jaccard.copies(docs).filter("not kept").select("row"), keep=True))
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows that earlier ones have.

    Only texts that lose words change; those that lose all of them go. Null and empty texts
    have none to lose and stay as they are. Rows that share an id are judged each by its own
    text.
    """
    _release(ready(spark))
    docs = _keyed(docs)
    with scratch(spark):
        cut_texts = substrings.remove(docs, row_key="row").filter("n_removed > 0")
        changed = cut_texts.select("row", F.col("text").alias("_text"))
        changed = _held(cut(changed, keep=True, codec="zstd"))
    joined = docs.join(changed, "row", "left")
    text = F.coalesce("_text", "text")
    return joined.filter("_text is null or _text <> ''").select(
        "doc_id",
        text.alias("text"),
        "lang",
        "source",
        F.when(F.col("_text").isNull(), F.col("n_chars"))
        .otherwise(F.char_length("_text").cast("long"))
        .alias("n_chars"),
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    A null or empty text is one piece, its end alone.
    """
    _release(ready(spark))
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: A trained network and a genetic algorithm have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
