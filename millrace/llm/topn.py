"""The N best rows of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import BROADCAST_ROWS, at_most, materialise, require, salted_join, small

#: Buckets of a group's score histogram.
BUCKETS = 64
#: Groups up to this many rows are ranked without a histogram, by one task each.
PLAIN_GROUP = 1_000


def top_n(df: DataFrame, group: str, score: str, ties: Sequence[str], n: int, buckets: int = BUCKETS, plain_group: int = PLAIN_GROUP) -> DataFrame:
    """The n rows of greatest score of every group, equal scores in the order of the tie columns.

    Columns: group, place (1..n), the tie columns, score. Each group of more than plain_group
    rows gets a histogram of its scores over its own range; the highest bucket edge that leaves
    n rows above is a safe lower threshold, and rows below it are dropped where they are read, before
    anything but counts is shuffled. Copies can leave fewer than n different rows above; such groups are found by a count
    and ranked from all of their rows. What is left of a large group, as when all scores are equal, is ranked
    in parts by hash, n of each part going on, until one task can take the rest. So no task ranks an unbounded group, whatever n.

    Rows with a null group, null or NaN score don't count. Rows equal in group and all tie
    columns count once, at their highest score. Null tie values come first. Empty in, empty out.
    """
    ties = list(ties)
    key = [f"_t{k}" for k in range(len(ties))]
    src = require(df, [group, score, *ties]).toDF("_g", "_s", *key).withColumn("_s", F.col("_s").cast("double"))
    src = src.where("_g IS NOT NULL AND _s IS NOT NULL AND NOT isnan(_s)")
    order = [F.desc("_s"), *[F.col(k).asc_nulls_first() for k in key]]

    large = src.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).where(F.col("_n") > max(plain_group, n)).drop("_n")
    large = materialise(large)
    plain = src
    if not large.isEmpty():
        plain = src.join(small(large.select("_g")), "_g", "left_anti")
    # a plain group is a bounded number of rows, so it goes to one task at once, where its copies fall together
    best = _placed(_once(plain.repartition("_g"), key), order, n)
    if not large.isEmpty():
        best = best.unionByName(_placed(_above(src, large, key, order, n, buckets, max(plain_group, 4 * n)), order, n))
    return best.select(F.col("_g").alias(group), F.col("_place").alias("place"), *[F.col(k).alias(t) for k, t in zip(key, ties, strict=True)], F.col("_s").alias(score))


def _once(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy("_g", *key).agg(F.max("_s").alias("_s"))


def _placed(rows: DataFrame, order: list[Column], n: int, *salt: str) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("_g", *salt).orderBy(*order))).where(F.col("_place") <= n)


def _of(src: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of some groups, with what groups says of each."""
    return src.join(F.broadcast(groups), "_g") if at_most(groups, BROADCAST_ROWS) else salted_join(src, groups, "_g")


def _above(src: DataFrame, large: DataFrame, key: list[str], order: list[Column], n: int, buckets: int, part: int) -> DataFrame:
    """Rows of the large groups, few of each, that hold the n best."""
    width = F.col("_hi") - F.col("_lo")
    # infinite scores make the width infinite or NaN: such a group keeps one bucket
    at = F.when((width > 0) & (width < F.lit(float("inf"))), F.least(F.lit(buckets - 1), F.floor((F.col("_s") - F.col("_lo")) / width * buckets))).otherwise(0).cast("int")
    down = Window.partitionBy("_g").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = _of(src, large).select("_g", at.alias("_b")).groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_up", F.sum("_c").over(down))
    safe = materialise(held.where(F.col("_up") >= n).groupBy("_g").agg(F.max("_b").alias("_least")).join(large, "_g"))
    rows = materialise(_once(_of(src, safe).where(at >= F.col("_least")).select("_g", *key, "_s"), key))

    few = safe.where("_least > 0").select("_g").join(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= n).select("_g"), "_g", "left_anti")
    few = materialise(few)
    if not few.isEmpty():
        rows = materialise(rows.join(small(few), "_g", "left_anti").unionByName(_once(_of(src, few), key)))
    while True:
        crowded = materialise(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 4 * part).select("_g", F.ceil(F.col("_c") / part).cast("int").alias("_parts")))
        if crowded.isEmpty():
            return rows
        # a part has some four times n rows, so each round leaves about a quarter
        salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*key, "_s"), F.col("_parts")).cast("int")).otherwise(0)
        rows = materialise(_placed(rows.join(small(crowded), "_g", "left").withColumn("_salt", salt), order, n, "_salt").select("_g", *key, "_s"))
