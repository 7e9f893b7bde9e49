"""Splits that keep related records together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.runtime import forget, materialise, materialised, require, salted_join, small

#: Groups that hold less than this share of all records are pooled by hash before the assignment.
LARGE_SHARE = 1e-4
#: Pools of small groups.
POOLS = 2048
#: Passes over the placed units, at most, in which they may move.
MOVES = 20


def bipartite_groups(links: DataFrame, record: str, entity: str) -> DataFrame:
    """Smallest entity each entity is tied to through records: columns entity, group.

    links is the bipartite graph, one row where a record names an entity. Entities of one record are
    in one group, and so on from record to record. Iterative minimum-label propagation: every record
    takes the smallest label of its entities, every entity the smallest of its records. Two
    things make the rounds few. Chains of labels are followed to their end by pointer doubling, so a
    path of n entities takes about log n steps; and the graph is contracted to its labels after each round,
    so a hub is one vertex after the first and every round works on fewer links.

    Rows with a null on either side don't count. Repeated links count once. An entity alone is its own
    group. No rows in, no rows out. A record or entity may hold any share of the links:
    minima are taken before the shuffle, and labels come back by a join whose hot keys are salted.
    """
    src = require(links, [record, entity]).toDF("_r", "_e").where("_r IS NOT NULL AND _e IS NOT NULL")
    src = materialise(src)
    lowest = src.groupBy("_r").agg(F.min("_e").alias("_v"))
    # a record as a star around its smallest entity: as many edges as links, never all pairs
    edges = salted_join(src, lowest, "_r").select(F.col("_e").alias("_u"), "_v")
    return _labels(edges.distinct(), src.select("_e").distinct())


def pair_groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The groups of bipartite_groups, where each row of pairs is a record that names two entities.

    A row with one side null or both sides equal ties nothing, but what it names is its own group.
    """
    src = require(pairs, [left, right]).toDF("_l", "_r")
    records = src.select(F.least("_l", "_r").alias("_a"), F.greatest("_l", "_r").alias("_b")).where("_a IS NOT NULL").distinct()
    links = records.select(F.struct("_a", "_b").alias("_r"), F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_e"))
    return bipartite_groups(links, "_r", "_e")


def _labels(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edges: distinct (_u, _v) with _u >= _v."""
    edges, seen = materialised(edges.where("_u <> _v"), n=F.count(F.lit(1)))
    maps: list[tuple[DataFrame, int]] = []
    while n := seen["n"]:
        roots = _roots(edges, n)
        maps.append((roots, n))
        # contract: both ends become their label
        ends = salted_join(edges, roots.select("_u", F.col("_root").alias("_ru")), "_u", rows=n).select("_ru", "_v")
        ends = salted_join(ends, roots.select(F.col("_u").alias("_v"), F.col("_root").alias("_rv")), "_v", "left", rows=n).select("_ru", F.coalesce("_rv", "_v").alias("_rv"))
        ends = ends.where("_ru <> _rv").select(F.greatest("_ru", "_rv").alias("_u"), F.least("_ru", "_rv").alias("_v")).distinct()
        new, seen = materialised(ends, n=F.count(F.lit(1)))
        forget(edges)
        edges = new
    if not maps:
        return entities.select(F.col("_e").alias("entity"), F.col("_e").alias("group"))
    # the last map is whole; each earlier one is carried on through the next
    final = maps[-1][0]
    for m, n in reversed(maps[:-1]):
        onward = final.select(F.col("_u").alias("_root"), F.col("_root").alias("_on"))
        carried = salted_join(m, onward, "_root", "left", rows=n).select("_u", F.coalesce("_on", "_root").alias("_root"))
        # a vertex in final was a root in m, so no vertex is in both
        final = materialise(carried.unionByName(final))
    return entities.join(final.withColumnRenamed("_u", "_e"), "_e", "left").select(F.col("_e").alias("entity"), F.coalesce("_root", "_e").alias("group"))


def _roots(edges: DataFrame, n: int) -> DataFrame:
    """Each larger end takes its smallest neighbour; then pointers are followed, four times as far in each step, until all are roots."""
    roots = materialise(edges.groupBy("_u").agg(F.min("_v").alias("_root")))
    while True:
        stepped = roots
        up = roots.select(F.col("_u").alias("_root"), F.col("_root").alias("_next"))
        for _ in range(3):
            stepped = salted_join(stepped.select("_u", "_root"), up, "_root", "left", rows=n).select("_u", F.coalesce("_next", "_root").alias("_root"), F.col("_next").isNotNull().alias("_moved"))
        new, seen = materialised(stepped, moved=F.count_if("_moved"))
        forget(roots)
        roots = new.select("_u", "_root")
        if not seen["moved"]:
            return roots


def assign_splits(
    groups: DataFrame, group: str, label: str | None, proportions: Mapping[str, float], large_share: float = LARGE_SHARE, pools: int = POOLS, seed: int = 42, main: str | None = None
) -> DataFrame:
    """A split for every group: columns group, split. groups has one row for each record.

    Whole groups are assigned so that each split's number of records, in all and of each label, is as near to
    its proportion as possible. Groups with at least large_share of all records stand alone, at
    most 1 / large_share of them; the others are pooled by a hash of the group and the seed. The counts of
    these units by label, bounded whatever the data, go to the driver. There the units
    are placed from the largest down, each in the split that leaves the smallest sum of
    squared deviations, and then moved one by one as long as that makes the sum smaller, in at most MOVES passes.

    main names a label whose proportions count ten times as much as those of the others and stand for the number of records.
    Null labels are a label of their own; rows with a null group don't count. labels should be few (a bounded
    column such as a class). Empty in, empty out.
    """
    if not proportions or any(p < 0 for p in proportions.values()) or abs(sum(proportions.values()) - 1) > 1e-9:
        raise ValueError("proportions must be at least 0 and add up to 1")
    src = require(groups, [group] + [label] * bool(label)).toDF("_g", *["_label"] * bool(label)).where("_g IS NOT NULL")
    if not label:
        src = src.withColumn("_label", F.lit(None).cast("string"))
    counts = materialise(src.groupBy("_g", F.col("_label").cast("string").alias("_label")).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    heavy = materialise(counts.groupBy("_g").agg(F.sum("_n").alias("_size")).where(F.col("_size") >= large_share * total).select("_g", F.lit(True).alias("_heavy")))
    pool = F.pmod(F.xxhash64(F.lit(seed), "_g"), F.lit(pools))
    units = counts.join(F.broadcast(heavy), "_g", "left").withColumn("_unit", F.when(F.col("_heavy"), F.concat(F.lit("g"), F.col("_g").cast("string"))).otherwise(F.concat(F.lit("p"), pool.cast("string"))))
    by_unit = units.groupBy("_unit", "_label").agg(F.sum("_n").alias("_n")).collect()  # at most (1 / large_share + pools) * labels rows
    placed = _place([(r["_unit"], r["_label"], r["_n"]) for r in by_unit], proportions, main)
    spark = groups.sparkSession
    schema = T.StructType([T.StructField("_unit", T.StringType()), T.StructField("split", T.StringType())])
    where = F.broadcast(spark.createDataFrame(list(placed.items()), schema))
    return units.select("_g", "_unit").distinct().join(where, "_unit").select(F.col("_g").alias("group"), "split")


def _place(counts: Sequence[tuple[str, str | None, int]], proportions: Mapping[str, float], main: str | None = None) -> dict[str, str]:
    units: dict[str, dict] = {}
    labels: dict = {}
    for unit, label, n in counts:
        units.setdefault(unit, {})[label] = n
        labels[label] = labels.get(label, 0) + n
    left = {s: {x: p * n for x, n in labels.items()} for s, p in proportions.items()}
    placed = {}

    def cost(split: str, own: dict) -> float:
        # how much the squared deviations, each relative to its label's size, and that of the whole size grow
        gain = sum((10 if x == main else 1) * (n * n - 2 * n * left[split][x]) / max(1, labels[x]) ** (1 if main is None else 2) for x, n in own.items())
        if main is not None:
            return gain
        size, room = sum(own.values()), sum(left[split].values())
        return gain + (size * size - 2 * size * room) / max(1, sum(labels.values()))

    for unit, own in sorted(units.items(), key=lambda u: (-sum(u[1].values()), u[0])):
        best = min((s for s in proportions if proportions[s] > 0), key=lambda s: (cost(s, own), list(proportions).index(s)))
        placed[unit] = best
        for x, n in own.items():
            left[best][x] -= n

    # then single units move as long as that brings the splits nearer to their proportions
    for _ in range(MOVES):
        moved = False
        for unit, own in sorted(units.items(), key=lambda u: (sum(u[1].values()), u[0])):
            now = placed[unit]
            for x, n in own.items():
                left[now][x] += n
            best = min((s for s in proportions if proportions[s] > 0), key=lambda s: (cost(s, own), s != now))
            for x, n in own.items():
                left[best][x] -= n
            moved |= best != now
            placed[unit] = best
        if not moved:
            break
    return placed


def related_splits(records: DataFrame, left: str, right: str, label: str | None, proportions: Mapping[str, float], seed: int = 42) -> DataFrame:
    """The records of a table of ties with a split: no tie, direct or through others, runs between two splits.

    Columns: entity, group, split, one row for each id named on either side. The proportions hold for the entities, and for the
    ties of each label; a tie counts in the group of its left id, or its right where that is null.
    """
    groups = materialise(pair_groups(records, left, right))
    src = require(records, [left, right] + [label] * bool(label)).toDF("_l", "_r", *["_label"] * bool(label))
    src = src.withColumn("_e", F.coalesce("_l", "_r")).where("_e IS NOT NULL")
    tied = salted_join(src, groups.select(F.col("entity").alias("_e"), F.col("group").alias("_g")), "_e")
    # entities are balanced as one more label beside those of the ties
    kind = F.concat(F.lit("tie "), F.coalesce(F.col("_label").cast("string"), F.lit(""))) if label else F.lit("tie")
    counted = tied.select("_g", kind.alias("_label")).unionByName(groups.select(F.col("group").alias("_g"), F.lit("entity").alias("_label")))
    splits = materialise(assign_splits(counted, "_g", "_label", proportions, seed=seed, main="entity"))
    # a group without a tie's left id can't be: every id named is left, or right beside a left of its group
    return groups.join(small(splits), "group").select("entity", "group", "split")


__all__ = ["assign_splits", "bipartite_groups", "pair_groups", "related_splits"]
