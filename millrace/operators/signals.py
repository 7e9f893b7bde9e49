"""Demand signals: vote groups, shrinkage, demeaning, weighted means, shares, z-scores, lift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_if_zero(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Vote groups in which all members are zero or missing become null as a whole: nobody voted. Others stay as they are, missing members null."""
    out = {}
    for members in groups.values():
        voted = sum((F.coalesce(F.col(m), F.lit(0)) for m in members), F.lit(0)) != 0
        out |= {m: F.when(voted, F.col(m)) for m in members}
    return df.withColumns(out)


def shrunk(df: DataFrame, value: str, votes: str, out: str) -> DataFrame:
    """(v R + m C) / (v + m) with m the median of votes and C the mean of values over all rows; null where value or votes is."""
    prior = df.agg(F.percentile(votes, F.lit(0.5)).alias("_m"), F.avg(value).alias("_c"))
    v, r = F.col(votes).cast("double"), F.col(value)
    return df.crossJoin(F.broadcast(prior)).withColumn(out, F.try_divide(v * r + F.col("_m") * F.col("_c"), v + F.col("_m"))).drop("_m", "_c")  # one row


def ratio(part: str, others: Sequence[str]) -> Column:
    """part over the sum of part and others; null if one of them is null or the sum is 0."""
    return F.try_divide(F.col(part).cast("double"), sum((F.col(o) for o in others), F.col(part)))


def demeaned(df: DataFrame, group: str, values: Sequence[str], least: int, fallback: bool = True) -> DataFrame:
    """value_demeaned: the value less its group's mean. Groups of fewer than least rows keep the raw value, or get null without fallback.

    is_demeaned says which. A null group is no group: its rows are never demeaned. Group means are aggregated and
    joined back, so that a large group isn't gathered in a window.
    """
    means = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(v).alias(f"_mean_{v}") for v in values])
    means = means.where(F.col("_n") >= least)
    out = df.join(means, group, "left").withColumn("is_demeaned", F.col("_n").isNotNull())
    made = {f"{v}_demeaned": F.when(F.col("is_demeaned"), F.col(v) - F.col(f"_mean_{v}")).otherwise(F.col(v) if fallback else F.lit(None)) for v in values}
    return out.withColumns(made).drop("_n", *[f"_mean_{v}" for v in values])


def weighted_means(df: DataFrame, by: Sequence[str], weight: str, values: Sequence[str]) -> DataFrame:
    """Weighted mean of each value over the rows where it isn't null, and their total weight as value_weight."""
    w = F.col(weight)
    aggs = []
    for v in values:
        own = F.sum(F.when(F.col(v).isNotNull(), w))
        aggs += [F.try_divide(F.sum(F.col(v) * w), own).alias(v), F.coalesce(own, F.lit(0.0)).alias(f"{v}_weight")]
    return df.groupBy(*by).agg(F.sum(w).alias("total_weight"), *aggs)


def shares(df: DataFrame, keys: Sequence[str], weight: str, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Sum of weight by keys as a share of the total, or of the total within some of the keys."""
    sums = df.groupBy(*keys).agg(F.sum(weight).alias("_s"))
    return sums.withColumn(out, F.try_divide(F.col("_s"), F.sum("_s").over(Window.partitionBy(*within)))).drop("_s")


def momentum(yearly: DataFrame, key: str, year: str, share: str, early: tuple[int, int], late: tuple[int, int]) -> DataFrame:
    """Mean yearly share in the late years less that in the early ones. Years without the key don't count as 0."""
    mean = lambda years: F.avg(F.when(F.col(year).between(*years), F.col(share)))
    return yearly.groupBy(key).agg(mean(early).alias("early_share"), mean(late).alias("late_share"), (mean(late) - mean(early)).alias("momentum"))


def z_scores(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """z_value: population z-score over all rows, or by group; null where all are equal. Null groups are groups.

    Means are aggregated and joined back, so that neither a large group nor the whole table is gathered in a window.
    """
    stats = df.groupBy(*by).agg(*[f(v).alias(f"_{n}_{v}") for v in values for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    if by:
        stats = stats.select(*[F.col(b).alias(f"_by_{b}") for b in by], *[c for c in stats.columns if c not in by])
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
        out = df.join(stats, same)
    else:
        out = df.crossJoin(F.broadcast(stats))  # one row
    out = out.withColumns({f"z_{v}": F.try_divide(F.col(v) - F.col(f"_m_{v}"), F.col(f"_s_{v}")) for v in values})
    return out.drop(*[f"_{n}_{v}" for v in values for n in "ms"], *[f"_by_{b}" for b in by])


def lift(pairs: DataFrame, left: str, right: str, weight: str | None = None, records: str = "product_id", least: int = 0) -> DataFrame:
    """How much more often right stands with left than in general: mention_rate / base_rate.

    pairs has a row for each record with left and right; weight is the record's share in left. mention_rate is the weight with right over
    the weight of left, base_rate the records with right over all records. Rights in fewer than least records are left out.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    base = pairs.groupBy(right).agg(F.countDistinct(records).alias("_n")).where(F.col("_n") >= least)
    total = pairs.agg(F.countDistinct(records).alias("_total"))
    whole = pairs.select(records, left, w.alias("_w")).distinct().groupBy(left).agg(F.sum("_w").alias("_whole"))
    both = pairs.select(records, left, right, w.alias("_w")).distinct().groupBy(left, right).agg(F.sum("_w").alias("_both"))
    out = both.join(base, right).join(whole, left).crossJoin(F.broadcast(total))  # one row
    rate, general = F.col("_both") / F.col("_whole"), F.col("_n") / F.col("_total")
    return out.select(left, right, rate.alias("mention_rate"), general.alias("base_rate"), (rate / general).alias("lift"))


def polarity(positive: str, negative: str) -> Column:
    """(p - n) / (p + n), null where nothing was said."""
    return F.try_divide(F.col(positive) - F.col(negative), F.col(positive) + F.col(negative))


def confidence(weight: str, high: float = 500, medium: float = 200) -> Column:
    return F.when(F.col(weight) >= high, "HIGH").when(F.col(weight) >= medium, "MEDIUM").otherwise("LOW")
