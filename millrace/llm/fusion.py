"""One ranking from scores on different scales."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import materialise, materialised, require, salted_join, small

#: Groups of more rows are ranked in slices, by several tasks.
PLAIN_GROUP = 500_000
#: Rows of a slice of such a group, about.
SLICE_ROWS = 100_000


def rank_fusion(df: DataFrame, group: str, item: str, scores: Mapping[str, bool], k: int = 60, plain_group: int = PLAIN_GROUP, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Reciprocal rank fusion: items ranked for each score, then by the sum of 1 / (k + rank).

    scores maps each score column to whether high values are better. Only ranks count, so no
    score weighs more for its unit or spread. Equal values have the same (smallest) rank. Columns:
    group, item, fused, place (1.. by falling fused, of equals the smaller item).

    A null or NaN score gives its item no term for that score. Rows equal in group, item and all scores
    count once. Rows with a null group or item don't count. Empty in, empty out.

    A group of more than plain_group rows isn't sorted in one task: its different values, each with
    its count, are dealt to slices by ranges, summed within the slice and shifted by the
    sums of the earlier slices. Equal values are counted first, so they don't gather either.
    """
    names = [f"_s{i}" for i in range(len(scores))]
    src = require(df, [group, item, *scores]).toDF("_g", "_i", *names).where("_g IS NOT NULL AND _i IS NOT NULL")
    up = list(scores.values())
    # one direction: the greater, the better; NaN counts as null
    src = src.select("_g", "_i", *[_value(n, u).alias(n) for n, u in zip(names, up, strict=True)]).distinct()
    large, seen = materialised(src.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > plain_group), rows=F.sum("_n"))
    large, slices = large.select("_g"), -(-(seen["rows"] or 0) // slice_rows)
    if not slices:
        fused = _plain(src, names, k)
        return _out(fused.withColumn("_place", F.row_number().over(_order("_g"))), group, item)
    large = small(large)
    plain = _plain(src.join(large, "_g", "left_anti"), names, k)
    plain = plain.withColumn("_place", F.row_number().over(_order("_g")))
    sliced = materialise(_sliced(src.join(large, "_g", "left_semi"), names, k, slices))
    return _out(plain.unionByName(_place_sliced(sliced, slices)), group, item)


def _value(name: str, high: bool) -> Column:
    c = F.col(name).cast("double")
    return F.when(F.isnan(c), None).otherwise(c if high else -c)


def _order(*by: str):
    return Window.partitionBy(*by).orderBy(F.desc("_fused"), F.asc("_i"))


def _sum(terms: list[Column]) -> Column:
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total


def _plain(src: DataFrame, names: list[str], k: int) -> DataFrame:
    terms = []
    for n in names:
        rank = F.rank().over(Window.partitionBy("_g").orderBy(F.col(n).desc_nulls_last()))
        terms.append(F.when(F.col(n).isNull(), 0.0).otherwise(1.0 / (k + rank)))
    return src.select("_g", "_i", _sum(terms).alias("_fused"))


def _ranged(df: DataFrame, by: list[str], order: list[Column], weight: Column, slices: int) -> DataFrame:
    """Adds _before, the sum of weight over the rows of the same group that come earlier in a strict order.

    Rows are dealt to slices by ranges of (group, order), so a group lies over many tasks. The slice
    of each row is written down: a task run again must not see other ranges.
    """
    dealt = materialise(df.repartitionByRange(slices, *[F.col(c) for c in by], *order).withColumn("_w", weight).withColumn("_slice", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*by, "_slice").agg(F.sum("_w").alias("_c")).withColumn("_shift", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).drop("_c")
    within = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_in", F.coalesce(F.sum("_w").over(within), F.lit(0))).join(small(materialise(shift)), [*by, "_slice"])
    return summed.withColumn("_before", F.col("_shift") + F.col("_in")).drop("_w", "_slice", "_shift", "_in")


def _sliced(src: DataFrame, names: list[str], k: int, slices: int) -> DataFrame:
    long = src.select("_g", "_i", F.monotonically_increasing_id().alias("_row"), *names)
    long = materialise(long)  # the ids must stay what they are
    tall = long.select("_g", "_i", "_row", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(n).alias("v")) for i, n in enumerate(names)])).alias("_x"))
    tall = tall.select("_g", "_i", "_row", F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v"))
    valued = tall.where("_v IS NOT NULL")
    counted = materialise(valued.groupBy("_g", "_m", "_v").agg(F.count(F.lit(1)).alias("_n")))
    ranks = _ranged(counted, ["_g", "_m"], [F.desc("_v")], F.col("_n"), slices).select("_g", "_m", "_v", (F.col("_before") + 1).alias("_rank"))
    # a frequent value is a hot key: salted; rows without a value need no rank and don't enter the join
    key = F.struct("_g", "_m", "_v").alias("_k")
    ranked = salted_join(valued.select("_i", "_row", key), ranks.select(key, "_rank"), "_k").select("_k._g", "_i", "_row", "_k._m", (1.0 / (k + F.col("_rank"))).alias("t"))
    terms = ranked.unionByName(tall.where("_v IS NULL").select("_g", "_i", "_row", "_m", F.lit(0.0).alias("t")))
    # summed in the order of the scores, as in the plain path, so that both give equal doubles
    terms = terms.groupBy("_g", "_i", "_row").agg(F.array_sort(F.collect_list(F.struct("_m", "t"))).alias("_terms"))
    return terms.select("_g", "_i", F.aggregate("_terms", F.lit(0.0), lambda s, x: s + x["t"]).alias("_fused"))


def _place_sliced(fused: DataFrame, slices: int) -> DataFrame:
    placed = _ranged(fused, ["_g"], [F.desc("_fused"), F.asc("_i")], F.lit(1), slices)
    return placed.select("_g", "_i", "_fused", (F.col("_before") + 1).alias("_place"))


def _out(df: DataFrame, group: str, item: str) -> DataFrame:
    return df.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_fused").alias("fused"), F.col("_place").cast("bigint").alias("place"))
