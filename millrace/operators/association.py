"""Association of tokens, and token weights of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import top_per_group


def cooccurrence(df: DataFrame, record: str, item: str) -> DataFrame:
    """a, b, n: records that hold both items, a < b. Items of a record are paired in the task that holds them and counted there; the vocabulary should be bounded."""
    sets = df.where(F.col(record).isNotNull() & F.col(item).isNotNull()).groupBy(record).agg(F.array_sort(F.collect_set(item)).alias("_l"))
    pairs = sets.select(F.posexplode("_l").alias("_p", "a"), "_l").select("a", F.explode(F.slice("_l", F.col("_p") + 2, F.size("_l"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions."""
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")]))


def ppmi(counts: DataFrame, shift: int = 1) -> DataFrame:
    """max(0, ln(n T / (r_a r_b)) - ln(shift)) of counts a, b, n given once; r are sums by item, T of all, both directions counted. Zeros are left out."""
    sums = both_ways(counts).groupBy("a").agg(F.sum("n").alias("_r"))
    total = counts.agg((2 * F.sum("n")).alias("_t"))
    rows = counts.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("_r").alias("_q")), "b").crossJoin(F.broadcast(total))  # one row
    value = F.log(F.col("n").cast("double") * F.col("_t") / (F.col("_r").cast("double") * F.col("_q"))) - F.log(F.lit(float(max(shift, 1))))
    return rows.select("a", "b", "n", value.alias("ppmi")).where("ppmi > 0")


def partners(pairs: DataFrame, score: str, n: int) -> DataFrame:
    """The n best partners of each item; equal scores by name."""
    return top_per_group(both_ways(pairs), ["a"], [F.desc(score), F.asc("b")], n).select("a", "rank", "b", score)


def partner_lookup(pairs: DataFrame, score: str, n: int) -> DataFrame:
    """The pairs among the n best partners of either side, once each under one key."""
    best = partners(pairs, score, n)
    return best.select(F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b")).alias("pair"), score).distinct()


def tf_idf(df: DataFrame, record: str, term: str, weight: str | None = None, use_idf: bool = True, sublinear: bool = False, least_records: int = 1, digits: int | None = None) -> DataFrame:
    """L2-normalised weights: record, term, weight. Term frequency is 1 or the greatest weight; idf = ln((1 + N) / (1 + df)) + 1.

    sublinear takes 1 + ln(tf). Terms in fewer than least_records records are left out.
    """
    rows = df.where(F.col(record).isNotNull() & F.col(term).isNotNull()).groupBy(record, term).agg((F.max(weight).cast("double") if weight else F.lit(1.0)).alias("_tf"))
    count = rows.agg(F.countDistinct(record).alias("_n"))
    seen = rows.groupBy(term).agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") >= least_records)
    tf = 1 + F.log("_tf") if sublinear else F.col("_tf")
    idf = F.log((1.0 + F.col("_n")) / (1.0 + F.col("_df"))) + 1 if use_idf else F.lit(1.0)
    raw = rows.join(seen, term).crossJoin(F.broadcast(count)).select(record, term, (tf * idf).alias("_w"))  # one row
    norm = raw.groupBy(record).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    out = raw.join(norm, record).select(record, term, (F.col("_w") / F.col("_norm")).alias("weight"))
    return out.withColumn("weight", F.round("weight", digits)) if digits is not None else out


def combos(df: DataFrame, record: str, item: str, items: Sequence[str]) -> DataFrame:
    """Number of records that hold all of the given items."""
    held = df.where(F.col(item).isin(list(items))).groupBy(record).agg(F.countDistinct(item).alias("_n")).where(F.col("_n") == len(set(items)))
    return held.agg(F.count(F.lit(1)).alias("n_records"))


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Most frequent label of each cluster (of equals the smallest), its share, and the cluster's size."""
    counts = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("_n"))
    size = F.sum("_n").over(Window.partitionBy(cluster))
    ranked = counts.withColumn("size", size).withColumn("_k", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("_n"), F.asc(label))))
    return ranked.where("_k = 1").select(cluster, F.col(label).alias("mode"), "size", (F.col("_n") / F.col("size")).alias("purity"))


def overall() -> Column:
    """Size-weighted mean of purities."""
    return F.sum(F.col("purity") * F.col("size")) / F.sum("size")
