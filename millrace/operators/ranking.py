"""Rankings, and how well ranked lists meet a ground truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in an order that should have no ties; tasks keep n rows of a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def joined_top(df: DataFrame, by: str, item: str, order: Sequence[Column], n: int, out: str, sep: str = ", ") -> DataFrame:
    """The first n items of each group as one string, in order."""
    top = top_per_group(df, [by], order, n, "_rank")
    return top.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", item))), lambda x: x[item]), sep).alias(out))


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank by falling value, equal values with the mean of their places."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def nearest_rank(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Of the sorted values, number floor(n * share) counted from 0, by group: one row a share. Nulls don't count.

    Equal values are counted first, so what is sorted is the different values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    rows = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    rows = rows.withColumn("_at", F.explode(F.array(*[F.lit(s) for s in shares])))
    at = F.floor(F.col("_n") * F.col("_at"))
    return rows.where((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c"))).select(*by, F.col("_at").alias("share"), value)


def ranking_metrics(lists: DataFrame, truth: DataFrame, query: str, item: str, rank: str, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, mrr and hit at each k over the queries that have both a list and a truth; precision over k whatever was returned.

    lists: query, item, rank from 1 (and by). truth: query, item. Ties and repeats in truth count once.
    """
    truth = truth.select(query, item).distinct()
    sizes = truth.groupBy(query).agg(F.count(F.lit(1)).alias("_size"))
    seen = lists.select(*by, query).distinct().join(sizes, query)
    hits = lists.join(truth, [query, item]).groupBy(*by, query).agg(F.min(rank).alias("_first"), *[F.count_if(F.col(rank) <= k).alias(f"_h{k}") for k in ks])
    each = seen.join(hits, [*by, query], "left")
    aggs = [F.count(F.lit(1)).alias("n_evaluated")]
    for k in ks:
        h = F.coalesce(F.col(f"_h{k}"), F.lit(0))
        aggs += [
            F.avg(h / F.lit(float(k))).alias(f"precision_{k}"), F.avg(h / F.col("_size")).alias(f"recall_{k}"),
            F.avg(F.when(F.col("_first") <= k, 1.0 / F.col("_first")).otherwise(0.0)).alias(f"mrr_{k}"), F.avg(F.when(h > 0, 1.0).otherwise(0.0)).alias(f"hit_{k}"),
        ]
    return each.groupBy(*by).agg(*aggs)


def popularity_lists(queries: DataFrame, items: DataFrame, query: str, item: str, popularity: str, k: int) -> DataFrame:
    """The k most popular other items for every query. Only the k + 1 most popular rows are joined."""
    best = items.where(F.col(popularity).isNotNull()).orderBy(F.desc(popularity), item).limit(k + 1).select(F.col(item).alias("_item"), F.col(popularity).alias("_p"))
    rows = queries.select(query).distinct().crossJoin(F.broadcast(best)).where(F.col(query) != F.col("_item"))  # k + 1 rows
    return top_per_group(rows, [query], [F.desc("_p"), F.asc("_item")], k).select(query, F.col("_item").alias(item), "rank")


def same_group_lists(queries: DataFrame, items: DataFrame, query: str, item: str, group: str, popularity: str, k: int) -> DataFrame:
    """The k most popular other items of the query's own group. A group's k + 1 best are found before the join."""
    held = items.where(F.col(group).isNotNull())
    best = top_per_group(held, [group], [F.col(popularity).desc_nulls_last(), F.asc(item)], k + 1, "_r").select(group, F.col(item).alias("_item"), "_r")
    own = held.select(F.col(item).alias(query), group).join(queries.select(query).distinct(), query)
    rows = own.join(best, group).where(F.col(query) != F.col("_item"))
    return top_per_group(rows, [query], [F.asc("_r")], k).select(query, F.col("_item").alias(item), "rank")


def hashed_lists(queries: DataFrame, items: DataFrame, query: str, item: str, k: int, seed: str, draws: int = 4, bucket: int = 8) -> DataFrame:
    """k pseudo-random other items for each query, without pairing all queries with all items or sorting them.

    Items lie in buckets of about `bucket` by the md5 of seed and id. Of draws * k draws each names a bucket and a place in it by an
    md5 of seed, query and number; the first k different items count. Few items give shorter lists.
    """
    number = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("bigint")
    held = items.select(item).distinct()
    count = held.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / bucket)).alias("_buckets"))
    lain = held.crossJoin(F.broadcast(count)).select(F.col(item).alias("_item"), (number(F.col(item)) % F.col("_buckets")).alias("_b"))  # one row
    size = lain.groupBy("_b").agg(F.count(F.lit(1)).alias("_size"))
    placed = lain.withColumn("_place", F.row_number().over(Window.partitionBy("_b").orderBy("_item")) - 1)
    spots = queries.select(query).distinct().crossJoin(F.broadcast(count)).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws * k - 1))))  # one row
    spots = spots.withColumn("_u", number(F.col(query), F.col("_d"))).withColumn("_b", F.col("_u") % F.col("_buckets"))
    drawn = spots.join(size, "_b").withColumn("_place", F.floor(F.col("_u") / F.col("_buckets")) % F.col("_size")).join(placed, ["_b", "_place"]).where(F.col(query) != F.col("_item"))
    first = drawn.groupBy(query, "_item").agg(F.min("_d").alias("_d"))
    return top_per_group(first, [query], [F.asc("_d")], k).select(query, F.col("_item").alias(item), "rank")


def hashed_split(df: DataFrame, key: str, shares: Mapping[str, float], seed: str) -> DataFrame:
    """Each key in a split by the md5 of seed and key: key, split. A key is in one split only."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(16**8)
    split, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        split = F.when(u < upto, name) if split is None else split.when(u < upto, name)
    return df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("split", split.otherwise(list(shares)[-1]))


def dominates(rows: DataFrame, name: str, metrics: Sequence[str]) -> DataFrame:
    """Pairs of names of which the first is greater in every metric. rows is a result table, of few names."""
    a, b = rows.alias("a"), rows.alias("b")
    better = F.lit(True)
    for m in metrics:
        better = better & (F.col(f"a.{m}") > F.col(f"b.{m}"))
    return a.join(b, better & (F.col(f"a.{name}") != F.col(f"b.{name}"))).select(F.col(f"a.{name}").alias("better"), F.col(f"b.{name}").alias("worse"))
