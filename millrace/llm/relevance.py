"""How characteristic a term is of a record among all records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.baskets import CHUNK_ITEMS, bounded_baskets, totals
from millrace.runtime import BROADCAST_ROWS, at_most, materialise, salted_join, small


def term_relevance(df: DataFrame, record: str, term: str, k1: float = 1.2, b: float = 0.75, chunk_items: int = CHUNK_ITEMS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Score of each term of each record by probabilistic relevance weighting.

    df has a row for each occurrence of a term in a record. Columns: record, term, tf, df (records
    with the term), n_records, length (occurrences in the record), score:

        ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length))

    The term frequency saturates, long records are damped, and a term in every record scores
    close to 0 but never below. Of one record, terms of equal tf order strictly by rarity.

    Null records or terms don't count; an empty table gives no rows. A record of any size is held
    in bounded chunks, and its length is summed over them; df is counted before the shuffle.
    """
    baskets = bounded_baskets(df, record, term, chunk_items)
    own = F.aggregate("_items", F.lit(0).cast("bigint"), lambda s, x: s + x["tf"])
    sums = baskets.select(
        F.sum(own).alias("_all"), F.count(F.when(F.col("_chunks") == 1, 1)).alias("_one"), F.countDistinct(F.when(F.col("_chunks") > 1, F.col("_r"))).alias("_more")
    ).select((F.col("_one") + F.col("_more")).alias("n_records"), (F.col("_all") / F.greatest(F.lit(1), F.col("_one") + F.col("_more"))).alias("_mean"))
    seen = materialise(baskets.select(F.explode("_items.i").alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("df")))
    long = materialise(totals(baskets, own))
    rows = (
        baskets.withColumn("_own", own)
        .join(small(long), "_r", "left")
        .select("_r", F.coalesce("_total", "_own").alias("length"), F.explode("_items").alias("_x"))
        .select("_r", "length", F.col("_x.i").alias("_t"), F.col("_x.tf").alias("tf"))
    )
    # a term in every record is a hot key where the terms are too many to broadcast
    rows = (rows.join(F.broadcast(seen), "_t") if at_most(seen, broadcast_rows) else salted_join(rows, seen, "_t")).crossJoin(F.broadcast(sums))  # one row
    n, d = F.col("n_records").cast("double"), F.col("df").cast("double")
    idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
    tf = F.col("tf").cast("double")
    score = idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("_mean"))))
    return rows.select(F.col("_r").alias("record"), F.col("_t").alias("term"), "tf", "df", "n_records", "length", score.alias("score"))
