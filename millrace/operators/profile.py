"""Profiles of a table: coverage, funnels, nulls, thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _long(one_row: DataFrame, names: Sequence[str], name: str, value: str) -> DataFrame:
    return one_row.select(F.explode(F.array(*[F.struct(F.lit(n).alias(name), F.col(f"_{i}").alias(value)) for i, n in enumerate(names)])).alias("x"), *[c for c in one_row.columns if not c.startswith("_")]).select(
        "x.*", *[c for c in one_row.columns if not c.startswith("_")]
    )


def true(c: Column) -> Column:
    """Unknown is false."""
    return F.coalesce(c, F.lit(False))


def coverage(df: DataFrame, present: Mapping[str, Column]) -> DataFrame:
    """field, n_present, n_rows, pct: how many rows have each field, in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(true(c)).alias(f"_{i}") for i, c in enumerate(present.values())])
    return _long(row, list(present), "field", "n_present").withColumn("pct", F.try_divide(100.0 * F.col("n_present"), F.col("n_rows")))


def funnel(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """step, n_left, n_dropped: rows that pass each condition and all before it, in one pass."""
    upto, aggs = F.lit(True), [F.count(F.lit(1)).alias("_all")]
    for i, c in enumerate(steps.values()):
        upto = upto & true(c)
        aggs.append(F.count_if(upto).alias(f"_{i}"))
    row = df.agg(*aggs)
    names = list(steps)
    items = [F.struct(F.lit("all").alias("step"), F.col("_all").alias("n_left"), F.lit(0).cast("bigint").alias("n_dropped"))]
    for i, n in enumerate(names):
        before = F.col("_all") if i == 0 else F.col(f"_{i - 1}")
        items.append(F.struct(F.lit(n).alias("step"), F.col(f"_{i}").alias("n_left"), (before - F.col(f"_{i}")).alias("n_dropped")))
    return row.select(F.inline(F.array(*items)))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, n_null of each column, in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    return _long(row, columns, "column_name", "n_null")


def thresholds(df: DataFrame, value: str, levels: Sequence[int], measures: Mapping[str, Column]) -> DataFrame:
    """threshold, n_rows and measures over the rows with at least that value; rows are copied only to the levels they reach."""
    reached = F.array_compact(F.array(*[F.when(F.col(value) >= n, F.lit(n)) for n in levels]))
    rows = df.withColumn("threshold", F.explode(reached))
    return rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_rows"), *[c.alias(n) for n, c in measures.items()])


def gate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """verdict VIABLE or ISSUES and the names of the rules that don't hold, of a one-row table."""
    failed = F.array_compact(F.array(*[F.when(~true(c), F.lit(n)) for n, c in rules.items()]))
    return df.select(F.when(F.size(failed) == 0, "VIABLE").otherwise("ISSUES").alias("verdict"), F.array_join(failed, ", ").alias("issues"))
