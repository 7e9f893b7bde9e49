"""Records with many items, held as bounded chunks of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialise, require, small

#: Items in a chunk, about. A record with more items is held as several rows.
CHUNK_ITEMS = 512


def bounded_baskets(df: DataFrame, record: str, item: str, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """One row for a record (_r) and chunk: _chunks (chunks of the record), _items (sorted array of (i, tf)).

    A record with up to chunk_items rows has one chunk. The items of a larger record are dealt by
    their hash to ceil(rows / chunk_items) chunks, so no row, task or shuffle key ever holds an
    unbounded record: a record with a third of all rows becomes many keys, and equal items are
    counted before the shuffle. Rows whose record or item is null don't count. tf is how often the
    item stands in the record. Written to the shared folder, as several passes read it.
    """
    src = require(df, [record, item]).toDF("_r", "_i").where("_r IS NOT NULL AND _i IS NOT NULL")
    large = (
        src.groupBy("_r")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > chunk_items)
        .select("_r", F.ceil(F.col("_n") / chunk_items).cast("int").alias("_chunks"))
    )
    large = materialise(large)
    counted = (
        src.join(small(large), "_r", "left")
        .withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
        .withColumn("_chunk", F.when(F.col("_chunks") > 1, F.pmod(F.xxhash64("_i"), F.col("_chunks")).cast("int")).otherwise(0))
        .groupBy("_r", "_chunks", "_chunk", "_i")
        .agg(F.count(F.lit(1)).alias("_tf"))
    )
    return materialise(
        counted.groupBy("_r", "_chunks", "_chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_tf").alias("tf")))).alias("_items"))
    )


def totals(baskets: DataFrame, of: Column) -> DataFrame:
    """Sum of an expression over the chunks of each record that has several; few rows."""
    return baskets.where("_chunks > 1").groupBy("_r").agg(F.sum(of).alias("_total"))
