"""Items that appear together more often than chance."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.baskets import CHUNK_ITEMS, bounded_baskets
from millrace.runtime import materialise, small


def cooccurrence(df: DataFrame, record: str, item: str, min_count: int = 1, min_lift: int | str | Decimal = 0, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """How often every two items stand in the same record, and how much more often than by chance.

    Columns: item_a, item_b (item_a < item_b), n_both, n_a, n_b (records with both, a, b),
    n_records (records with any item), lift, pmi (natural logarithm), npmi.
    Keeps pairs with n_both >= min_count and n_both * n_records >= min_lift * n_a * n_b; the second
    test is exact in decimals.

    Large-basket blocking: a record is held in chunks of about chunk_items items. Each chunk gives
    the pairs within it; of a record with several chunks every pair of chunks is a key of its own that
    gives the pairs across, and those keys are dealt over all tasks. All pairs are counted
    in the task that makes them, so what is shuffled is bounded by the different pairs, not by
    the pairs of the largest record.

    Null records or items are left out; a repeated item counts once for a record; a record with
    one item gives no pair but counts in n_records; an empty table gives no rows.
    """
    baskets = bounded_baskets(df, record, item, chunk_items)
    # the item with itself stands for its own count, so that one aggregation counts items and pairs
    items = baskets.select("_r", "_chunks", "_chunk", F.col("_items.i").alias("_l"))
    within = items.select(F.posexplode("_l").alias("_p", "_a"), "_l").select("_a", F.explode(F.slice("_l", F.col("_p") + 1, F.size("_l"))).alias("_b"))
    chunked = items.where("_chunks > 1")
    # each chunk goes to its pairs before the join, so that no task meets all chunks of a record
    last = F.col("_chunks") - 1
    firsts = chunked.where(F.col("_chunk") < last).select("_r", F.col("_chunk").alias("_c1"), F.explode(F.sequence(F.col("_chunk") + 1, last)).alias("_c2"), F.col("_l").alias("_x"))
    seconds = chunked.where("_chunk > 0").select("_r", F.explode(F.sequence(F.lit(0), F.col("_chunk") - 1)).alias("_c1"), F.col("_chunk").alias("_c2"), F.col("_l").alias("_y"))
    across = (
        firsts.hint("shuffle_hash").join(seconds, ["_r", "_c1", "_c2"])
        .select(F.explode("_x").alias("_p"), "_y")
        .select("_p", F.explode("_y").alias("_q"))
        .select(F.least("_p", "_q").alias("_a"), F.greatest("_p", "_q").alias("_b"))
    )
    single = items.where("_chunks = 1").agg(F.count(F.lit(1)).alias("_s"))
    several = chunked.agg(F.countDistinct("_r").alias("_m"))
    records = single.crossJoin(several).select((F.col("_s") + F.col("_m")).alias("n_records"))

    counts = within.unionByName(across).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialise(counts)
    alone = small(materialise(counts.where("_a = _b").select("_a", "_n")))
    pairs = (
        counts.where(F.col("_a") < F.col("_b"))
        .where(F.col("_n") >= min_count)
        .withColumnRenamed("_n", "n_both")
        .join(alone.withColumnRenamed("_n", "n_a"), "_a")
        .join(alone.select(F.col("_a").alias("_b"), F.col("_n").alias("n_b")), "_b")
        .crossJoin(F.broadcast(records))  # one row
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    pairs = pairs.where(wide("n_both") * wide("n_records") >= F.lit(str(min_lift)).cast("decimal(12,6)") * (F.col("n_a").cast("decimal(13,0)") * F.col("n_b").cast("decimal(13,0)")))
    lift = F.col("n_both").cast("double") * F.col("n_records") / (F.col("n_a").cast("double") * F.col("n_b"))
    pmi = F.log(lift)
    share = F.col("n_both").cast("double") / F.col("n_records")
    return pairs.select(
        F.col("_a").alias("item_a"), F.col("_b").alias("item_b"), "n_both", "n_a", "n_b", "n_records",
        lift.alias("lift"), pmi.alias("pmi"), F.when(share < 1, pmi / -F.log(share)).otherwise(F.lit(1.0)).alias("npmi"),
    )
