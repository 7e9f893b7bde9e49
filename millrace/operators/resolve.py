"""Resolution of name variants into canonical tokens."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import gloss
from millrace.functions.text import token as as_token
from millrace.runtime import forget, materialise, materialised, salted_join, ship


@F.pandas_udf(T.DoubleType())
def sequence_ratio(short: pd.Series, long: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity. It depends on the order of its arguments, so the caller gives the shorter, of equals the smaller, first."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(short, long, strict=True)])


def _ordered(pairs: DataFrame) -> DataFrame:
    first = (F.length("_x") < F.length("_y")) | ((F.length("_x") == F.length("_y")) & (F.col("_x") < F.col("_y")))
    return pairs.select(F.when(first, F.col("_x")).otherwise(F.col("_y")).alias("short"), F.when(first, F.col("_y")).otherwise(F.col("_x")).alias("long")).where("short <> long").distinct()


def prefix_pairs(tokens: DataFrame, token: str, prefix: int = 3) -> DataFrame:
    """short, long: distinct tokens of equal first characters of which the longer contains the shorter."""
    t = tokens.select(token).where(F.length(token) >= prefix).distinct()
    a, b = t.select(F.col(token).alias("_x"), F.substring(token, 1, prefix).alias("_k")), t.select(F.col(token).alias("_y"), F.substring(token, 1, prefix).alias("_k"))
    return _ordered(a.join(b, "_k").where((F.col("_x") != F.col("_y")) & F.col("_y").contains(F.col("_x"))))


def compound_evidence(pairs: DataFrame, tokens: DataFrame, token: str, least: int = 5, ratio: float = 0.5, rest: int = 2) -> DataFrame:
    """Pairs with whether they merge: the shorter long enough, a big enough part, and the remainder long enough and no token itself."""
    at = F.expr("instr(long, short)")
    remainder = F.trim(F.concat(F.expr("substring(long, 1, instr(long, short) - 1)"), F.expr("substring(long, instr(long, short) + length(short))")))
    known = tokens.select(F.col(token).alias("remainder"), F.lit(True).alias("_known")).distinct()
    rows = pairs.where(at > 0).withColumn("remainder", remainder).join(known, "remainder", "left")
    good = (F.length("short") >= least) & (F.length("short") / F.length("long") >= ratio) & (F.length("remainder") >= rest) & F.col("_known").isNull()
    return rows.select("short", "long", "remainder", good.alias("merges"))


def banded_pairs(tokens: DataFrame, token: str, band: int = 4) -> DataFrame:
    """short, long, distance: distinct tokens of equal first character and lengths at most band apart.

    Tokens meet by first character and length, the one side once for each length within the band, so that a frequent letter isn't one key.
    """
    t = tokens.select(token).where(F.length(token) > 0).distinct()
    first, size = F.substring(token, 1, 1).alias("_k"), F.length(token)
    lengths = F.explode(F.sequence(F.greatest(F.lit(1), size - band), size + band)).alias("_n")
    rows = t.select(F.col(token).alias("_x"), first, size.alias("_n")).join(t.select(F.col(token).alias("_y"), first, lengths), ["_k", "_n"]).where(F.col("_x") < F.col("_y"))
    return _ordered(rows).withColumn("distance", F.levenshtein("short", "long"))


def fuzzy_pairs(tokens: DataFrame, token: str, merge_ratio: float = 0.90, review_ratio: float = 0.80, edits: int = 2, band: int = 4) -> DataFrame:
    """short, long, distance, ratio, merges: pairs alike enough to look at.

    The ratio is 2 M / (|a| + |b|) with M matching characters in order. With M matches the distance is at most
    |a| + |b| - 2 M, and M is at most |short|: pairs that can't reach review_ratio are dropped before Python sees them.
    """
    ship(tokens.sparkSession)
    rows = banded_pairs(tokens, token, band)
    both = F.length("short") + F.length("long")
    rows = rows.where((2.0 * F.length("short") >= review_ratio * both) & (F.col("distance") <= (1 - review_ratio) * both + 1e-9))
    rows = rows.withColumn("ratio", sequence_ratio("short", "long")).where(F.col("ratio") >= review_ratio)
    return rows.withColumn("merges", (F.col("ratio") >= merge_ratio) & (F.col("distance") <= edits))


def word_pairs(tokens: DataFrame, token: str) -> DataFrame:
    """word, phrase: tokens that are one whole word of a longer token."""
    t = tokens.select(token).distinct()
    split = t.select(F.col(token).alias("phrase"), F.explode(F.array_distinct(F.split(token, " "))).alias("word"))
    return split.join(t.select(F.col(token).alias("word")), "word").where("word <> phrase").select("word", "phrase")


def gloss_pairs(names: DataFrame, name: str) -> DataFrame:
    """short, long: the token of a typed name and that of its bracketed gloss, where they differ."""
    rows = names.select(as_token(F.col(name)).alias("_x"), gloss(F.col(name)).alias("_y")).where("_x <> '' AND _y IS NOT NULL")
    return _ordered(materialise(rows))  # written down, else the order works both out again and again


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, component: the smallest node of each connected component.

    Alternates taking the smallest neighbour's label with following labels of labels, so long paths take few rounds. Each round is written down;
    ends when nothing changes. Nulls tie nothing.
    """
    e = edges.select(F.col(left).alias("_a"), F.col(right).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    e = materialise(e.unionByName(e.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct())
    n = e.count()
    labels = materialise(e.groupBy("_a").agg(F.min("_b").alias("_m")).select(F.col("_a").alias("node"), F.least("_a", "_m").alias("component")))
    while True:
        near = salted_join(e, labels.select(F.col("node").alias("_b"), F.col("component").alias("_c")), "_b", rows=n).groupBy("_a").agg(F.min("_c").alias("_c"))
        step = labels.join(near, labels.node == near["_a"]).select("node", F.least("component", "_c").alias("_l"), F.col("component").alias("_old"))
        jump = step.join(labels.select(F.col("node").alias("_l"), F.col("component").alias("_j")), "_l", "left")
        to = F.least("_l", F.coalesce("_j", "_l"))
        new, seen = materialised(jump.select("node", to.alias("component"), (to != F.col("_old")).alias("_moved")), moved=F.count_if("_moved"))
        forget(labels)
        labels = new.select("node", "component")
        if not seen["moved"]:
            return labels


def canonical_pick(members: DataFrame, group: str, token: str, count: str, forced: DataFrame | None = None) -> DataFrame:
    """group, canonical: the most frequent token, of equals the shortest, then the smallest; a forced token of the group first."""
    rows = members
    first = F.lit(0)
    if forced is not None:
        rows = rows.join(forced.select(F.col(forced.columns[0]).alias(token), F.lit(1).alias("_forced")), token, "left")
        first = F.coalesce("_forced", F.lit(0))
    w = Window.partitionBy(group).orderBy(F.desc("_first"), F.desc(count), F.length(token), token)
    return rows.withColumn("_first", first).withColumn("_k", F.row_number().over(w)).where("_k = 1").select(group, F.col(token).alias("canonical"))


def resolve(occurrences: DataFrame, token: str, record: str, merges: DataFrame, placeholders: str, rare: int, excluded: Sequence[tuple[str, str]] = (), forced: Sequence[tuple[str, str]] = (), review: DataFrame | None = None, canonical: Sequence[str] = ()) -> DataFrame:
    """raw_token, n_products, canonical, action, reason, review for every token.

    merges: short, long of tokens that mean the same, and if known the reason. review: short, long, reason, ratio (null if it isn't likeness) of pairs to look
    at that merge nothing; every token that is no placeholder has all of its own in the column review, as other, reason, ratio. The reason of a MERGE is
    the evidence between the token and its canonical form, or that others tie them; that of a KEEP names what to look at, null if nothing. Excluded pairs block the direct edge, forced ones add it; a token of canonical, a list given by hand, is the canonical form of its group whatever the counts. Placeholders (a pattern) and groups
    in fewer than rare records are dropped. The group's records are counted distinctly over its members, without sets.
    """
    spark = occurrences.sparkSession
    held = occurrences.select(F.col(token).alias("raw_token"), F.col(record).alias("_r")).where("raw_token IS NOT NULL AND raw_token <> ''").distinct()
    counts = materialise(held.groupBy("raw_token").agg(F.count("_r").alias("n_products")))
    edges = merges.select("short", "long", F.col("reason") if "reason" in merges.columns else F.lit("given pair").alias("reason"))
    if forced:
        edges = edges.unionByName(spark.createDataFrame([(*p, "forced") for p in forced], "short string, long string, reason string"))
    if excluded:
        blocked = spark.createDataFrame([p for a, b in excluded for p in ((a, b), (b, a))], "short string, long string")
        edges = edges.join(F.broadcast(blocked), ["short", "long"], "left_anti")  # a list given by hand
    noted = counts.withColumn("_drop", F.col("raw_token").rlike(placeholders))
    kept = noted.where("NOT _drop").select("raw_token")
    edges = edges.join(kept.withColumnRenamed("raw_token", "short"), "short", "left_semi").join(kept.withColumnRenamed("raw_token", "long"), "long", "left_semi")
    edges = materialise(edges)
    groups = components(edges, "short", "long")
    member = noted.where("NOT _drop").join(groups.withColumnRenamed("node", "raw_token"), "raw_token", "left").withColumn("component", F.coalesce("component", "raw_token"))
    member = materialise(member)
    total = held.join(member.select("raw_token", "component"), "raw_token").groupBy("component").agg(F.countDistinct("_r").alias("_total"))
    out = member.join(canonical_pick(member, "component", "raw_token", "n_products", spark.createDataFrame([(c,) for c in sorted(set(canonical))], "token string") if canonical else None), "component").join(total, "component", "left")
    action = F.when(F.coalesce("_total", F.lit(0)) < rare, "DROP_RARE").when(F.col("canonical") == F.col("raw_token"), "KEEP").otherwise("MERGE")
    direct = _both(edges).groupBy(F.col("short").alias("raw_token"), F.col("long").alias("canonical")).agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("_direct"))
    seen = "array<struct<other:string,reason:string,ratio:double>>"
    out = out.join(direct, ["raw_token", "canonical"], "left")
    if review is None:
        out = out.withColumn("review", F.array().cast(seen))
    else:
        # both ends must be tokens that aren't placeholders, as with the merges
        pairs = _both(review.select("short", "long", "reason", F.col("ratio").cast("double").alias("ratio"))).withColumnsRenamed({"short": "raw_token", "long": "other"})
        pairs = pairs.join(kept.withColumnRenamed("raw_token", "other"), "other", "left_semi")
        found = pairs.groupBy("raw_token").agg(F.collect_set(F.struct(F.coalesce(-F.col("ratio"), F.lit(0.0)).alias("_o"), "other", "reason", "ratio")).alias("_l"))  # a token's pairs, at most the vocabulary
        found = found.select("raw_token", F.transform(F.array_sort("_l"), lambda x: F.struct(x["other"].alias("other"), x["reason"].alias("reason"), x["ratio"].alias("ratio"))).alias("review"))
        out = out.join(found, "raw_token", "left").withColumn("review", F.coalesce("review", F.array().cast(seen)))
    parts = []
    if excluded:
        kept_apart = blocked.groupBy(F.col("short").alias("raw_token")).agg(F.array_join(F.array_sort(F.collect_set("long")), ", ").alias("_apart"))
        out = out.join(F.broadcast(kept_apart), "raw_token", "left")  # a list given by hand
        parts.append(F.concat(F.lit("kept apart by hand from "), "_apart"))
    like, held_in = F.try_element_at(F.filter("review", lambda x: x["ratio"].isNotNull()), F.lit(1)), F.array_distinct(F.transform(F.filter("review", lambda x: x["ratio"].isNull()), lambda x: x["other"]))
    out = materialise(out.withColumns({"action": action, "_like": like, "_held": held_in}))  # written down, as the reason names each of them several times
    parts.append(F.when(F.col("_like").isNotNull(), F.format_string("REVIEW: like '%s' (ratio %.2f)", "_like.other", "_like.ratio")))
    parts.append(F.when(F.size("_held") > 0, F.concat(F.lit("REVIEW: contained with "), F.array_join(F.slice("_held", 1, 5), ", "), F.when(F.size("_held") > 5, F.format_string(" (+%d more)", F.size("_held") - 5)).otherwise(""))))
    noticed = F.concat_ws("; ", *parts)
    reason = (
        F.when(F.col("action") == "DROP_RARE", F.format_string(f"group '%s' in %d records, fewer than {rare}", "canonical", F.coalesce("_total", F.lit(0))))
        .when(F.col("action") == "MERGE", F.coalesce("_direct", F.lit("tied through others of the group")))
        .when(noticed != "", noticed)
    )
    out = out.withColumn("reason", reason).select("raw_token", "n_products", F.when(F.col("action") != "DROP_RARE", F.col("canonical")).alias("canonical"), "action", "reason", "review")
    dropped = noted.where("_drop").select("raw_token", "n_products", F.lit(None).cast("string").alias("canonical"), F.lit("DROP_PLACEHOLDER").alias("action"), F.lit("name of no single note").alias("reason"), F.array().cast(seen).alias("review"))
    return out.unionByName(dropped)


def _both(pairs: DataFrame) -> DataFrame:
    """Pairs in both directions."""
    return pairs.unionByName(pairs.select(F.col("long").alias("short"), F.col("short").alias("long"), *[c for c in pairs.columns if c not in ("short", "long")]))
