"""Operators on tables of ids and scores, against plain Python."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm.cooccur import cooccurrence
from millrace.llm.fusion import rank_fusion
from millrace.llm.relevance import term_relevance
from millrace.llm.splits import assign_splits, bipartite_groups, pair_groups, related_splits
from millrace.llm.topn import top_n

NAN = float("nan")


def baskets(seed=1):
    rng = random.Random(seed)
    rows = [(r, rng.randrange(12)) for r in range(40) for _ in range(rng.randrange(0, 5))]
    rows += [(99, i) for i in range(12)] * 2  # one record with everything, twice over
    return rows + [(None, 1), (3, None), (None, None)]


@pytest.mark.parametrize("chunk_items", [3, 512])
def test_cooccurrence(spark, chunk_items):
    rows = baskets()
    df = spark.createDataFrame([(r, i, "x", 0) for r, i in rows], "rec long, it long, _r string, item_a int")
    held = defaultdict(set)
    for r, i in rows:
        if r is not None and i is not None:
            held[r].add(i)
    one, both = Counter(), Counter()
    for items in held.values():
        one.update(items)
        both.update(itertools.combinations(sorted(items), 2))
    got = {(x.item_a, x.item_b): x for x in cooccurrence(df, "rec", "it", chunk_items=chunk_items).collect()}
    assert {k: x.n_both for k, x in got.items()} == both
    for (a, b), x in got.items():
        assert (x.n_a, x.n_b, x.n_records) == (one[a], one[b], len(held))
        assert x.lift == pytest.approx(both[a, b] * len(held) / (one[a] * one[b]))
        assert x.pmi == pytest.approx(math.log(x.lift), abs=1e-12)
    strict = cooccurrence(df, "rec", "it", min_count=3, min_lift=1, chunk_items=chunk_items).collect()
    assert {(x.item_a, x.item_b) for x in strict} == {k for k, c in both.items() if c >= 3 and c * len(held) >= one[k[0]] * one[k[1]]}


def test_cooccurrence_strings_and_empty(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, ""), (2, "a"), (2, "é" * 5000)], "r int, i string")
    got = {(x.item_a, x.item_b): x.n_both for x in cooccurrence(df, "r", "i").collect()}
    assert got == {("a", "b"): 1, ("", "a"): 1, ("", "é" * 5000): 1, ("a", "é" * 5000): 1}
    assert cooccurrence(df.where("false"), "r", "i").count() == 0


@pytest.mark.parametrize("chunk_items", [3, 512])
def test_relevance(spark, chunk_items):
    rows = baskets(2)
    df = spark.createDataFrame([(r, i, 1.0) for r, i in rows], "record long, term long, score double")
    tf = Counter((r, i) for r, i in rows if r is not None and i is not None)
    length, seen = Counter(), Counter()
    for (r, i), n in tf.items():
        length[r] += n
        seen[i] += 1
    n, mean = len(length), sum(length.values()) / len(length)
    got = term_relevance(df, "record", "term", chunk_items=chunk_items).collect()
    assert {(x.record, x.term): x.tf for x in got} == tf
    for x in got:
        assert (x.df, x.n_records, x.length) == (seen[x.term], n, length[x.record])
        idf = math.log(1 + (n - x.df + 0.5) / (x.df + 0.5))
        assert x.score == pytest.approx(idf * x.tf * 2.2 / (x.tf + 1.2 * (0.25 + 0.75 * x.length / mean)))
    assert term_relevance(df.where("false"), "record", "term").count() == 0


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def graph(seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    pairs += [(1000 + i, 1001 + i) for i in range(120)] + [(2121 - i, 2120 - i) for i in range(60)]  # long paths, both ways
    order = list(range(4000, 4060))
    rng.shuffle(order)
    return pairs + list(itertools.pairwise(order)) + [(3000, 3000 + i) for i in range(100)] + [(5000 - i, 9000) for i in range(50)]


@pytest.mark.parametrize("seed", [1, 2])
def test_pair_groups(spark, seed):
    pairs = graph(seed)
    rows = [(a, b, "k", 1) for a, b in pairs + pairs[:20]] + [(None, 7000, "k", 1), (7001, None, "k", 1), (None, None, "k", 1), (7002, 7002, "k", 1)]
    df = spark.createDataFrame(rows, "a long, b long, entity string, _u int")
    got = {x.entity: x.group for x in pair_groups(df, "a", "b").collect()}
    assert got == union_find(pairs) | {7000: 7000, 7001: 7001, 7002: 7002}
    assert pair_groups(df.where("false"), "a", "b").count() == 0


def test_salted_path(spark, monkeypatch):
    from millrace import runtime

    monkeypatch.setattr(runtime, "SALT_ROWS", 0)
    pairs = graph(3)
    got = {x.entity: x.group for x in pair_groups(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == union_find(pairs)


def test_bipartite_groups(spark):
    rng = random.Random(5)
    links = [(f"r{rng.randrange(60)}", rng.randrange(200)) for _ in range(120)] + [("hub", e) for e in range(200, 260)]
    df = spark.createDataFrame(links + [(None, 1), ("r1", None)], "r string, e long")
    by = defaultdict(list)
    for r, e in links:
        by[r].append(e)
    want = union_find([(e, es[0]) for es in by.values() for e in es])
    assert {x.entity: x.group for x in bipartite_groups(df, "r", "e").collect()} == want


def test_splits(spark):
    pairs = graph(6)
    df = spark.createDataFrame([(a, b, "x" if a % 3 else None) for a, b in pairs], "a long, b long, kind string")
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = {x.entity: x for x in related_splits(df, "a", "b", "kind", shares).collect()}
    assert set(got) == set(union_find(pairs))
    for a, b in pairs:
        assert got[a].split == got[b].split and got[a].group == got[b].group
    uneven = spark.createDataFrame([(i, i + 1, "k") for i in range(500)] + [(1000 + 2 * i, 1001 + 2 * i, "k") for i in range(2000)], "a long, b long, kind string")
    sizes = {x["split"]: x["count"] for x in related_splits(uneven, "a", "b", "kind", shares).groupBy("split").count().collect()}
    assert all(abs(sizes[s] - p * 4501) < 60 for s, p in shares.items())
    singles = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20_000)], "g long, l string")
    split = assign_splits(singles, "g", "l", shares)
    counts = {(x["split"], x["l"]): x["count"] for x in singles.join(split, singles.g == split.group).groupBy("split", "l").count().collect()}
    for s, p in shares.items():
        for x in "ab":
            assert abs(counts[s, x] - p * 10_000) < 100
    assert assign_splits(singles.where("false"), "g", "l", shares).count() == 0
    with pytest.raises(ValueError):
        assign_splits(singles, "g", None, {"a": 0.5})


@pytest.mark.parametrize("plain_group", [5, 1000])
def test_top_n(spark, plain_group):
    rng = random.Random(7)
    rows = [(g, round(rng.random(), 2), rng.randrange(50)) for g in (1, 2, 3) for _ in range(200)]
    rows += [(4, 0.5, i) for i in range(100)]  # all equal
    rows += [(5, float("inf"), 1), (5, float("-inf"), 2)] + [(5, float(i), 100 + i) for i in range(20)]
    rows += [(6, 0.1, 1), (None, 0.5, 1), (1, None, 1), (1, NAN, 2), (7, NAN, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g long, s double, i long, place int")
    best = {}
    for g, s, i in rows:
        if g is not None and s is not None and s == s:
            best[g, i] = max(s, best.get((g, i), -math.inf))
    want = set()
    for group in {g for g, _ in best}:
        ordered = sorted(((s, i) for (g, i), s in best.items() if g == group), key=lambda x: (-x[0], x[1]))
        want |= {(group, k, i, s) for k, (s, i) in enumerate(ordered[:10], 1)}
    got = top_n(df, "g", "s", ["i"], 10, buckets=8, plain_group=plain_group)
    assert {tuple(x) for x in got.select("g", "place", "i", "s").collect()} == want
    assert top_n(df.where("false"), "g", "s", ["i"], 10).count() == 0


@pytest.mark.parametrize("plain_group", [3, 10_000])
def test_rank_fusion(spark, plain_group):
    rng = random.Random(8)
    rows = [(g, i, rng.choice([None, NAN, rng.randrange(5) * 1.0, rng.gauss(0, 1e6)]), rng.randrange(4) * 0.1) for g in (1, 2) for i in range(60)]
    rows += rows[:10] + [(3, 1, None, None), (None, 1, 1.0, 1.0), (1, None, 1.0, 1.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g long, i long, a double, b double, fused string")
    clean = {(g, i, None if a is None or a != a else a, b) for g, i, a, b in rows if g is not None and i is not None}
    want = {}
    for group in (1, 2, 3):
        own = [r for r in clean if r[0] == group]
        scored = []
        for r in own:
            total = 0.0
            for k, high in ((2, True), (3, False)):
                v = r[k]
                if v is not None:
                    total += 1 / (60 + 1 + sum(1 for o in own if o[k] is not None and (o[k] > v if high else o[k] < v)))
            scored.append((-total, r[1]))
        want[group] = [i for _, i in sorted(scored)]
    got = rank_fusion(df, "g", "i", {"a": True, "b": False}, plain_group=plain_group, slice_rows=30)
    out = defaultdict(list)
    for x in got.orderBy("g", "place").collect():
        out[x.g].append(x.i)
        assert x.place == len(out[x.g])
    assert out == want
    assert rank_fusion(df.where("false"), "g", "i", {"a": True}).count() == 0


@pytest.mark.parametrize("n", [10, 1500])
def test_top_n_of_hot_groups(spark, n):
    """A group of equal scores, one of copies, and one with a third of all rows; none is ranked by one task as a whole."""
    rows = [(1, 0.5, i) for i in range(30_000)] + [(2, 1.0, 7)] * 20_000 + [(2, 0.5 - i / 1e6, i) for i in range(3_000)] + [(3 + i % 500, i / 7, i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g long, s double, i long")
    got = {(x.g, x.place, x.i) for x in top_n(df, "g", "s", ["i"], n, plain_group=200).collect()}
    best = {}
    for g, s, i in rows:
        best[g, i] = max(s, best.get((g, i), 0))
    by = defaultdict(list)
    for (g, i), s in best.items():
        by[g].append((-s, i))
    assert got == {(g, k, i) for g, own in by.items() for k, (_, i) in enumerate(sorted(own)[:n], 1)}


def test_hot_keys_are_salted(spark, monkeypatch):
    """A record, a term and a value that hold a third of all rows, on the paths for data that is too large to broadcast."""
    from millrace import runtime

    monkeypatch.setattr(runtime, "SALT_ROWS", 0)
    rows = [(i, 0) for i in range(2_000)] + [(9_999, i) for i in range(2_000)] + [(i, i % 37) for i in range(2_000)]
    df = spark.createDataFrame(rows, "r long, t long")
    plain = {(x.record, x.term): (x.df, x.score) for x in term_relevance(df, "r", "t", chunk_items=50).collect()}
    assert plain == {(x.record, x.term): (x.df, x.score) for x in term_relevance(df, "r", "t", chunk_items=50, broadcast_rows=0).collect()}
    scored = spark.createDataFrame([(1, i, 0.0 if i % 3 else None, float(i % 97)) for i in range(3_000)], "g long, i long, a double, b double")
    by_slices, whole = (rank_fusion(scored, "g", "i", {"a": True, "b": True}, plain_group=p, slice_rows=100).select("i", "place", "fused").collect() for p in (10, 10_000))
    assert sorted(by_slices) == sorted(whole)
    pairs = spark.createDataFrame([(1, i) for i in range(400)] + [(r, i) for r in range(2, 100) for i in (r, r + 1)], "r long, i long")
    chunked, plain = ({(x.item_a, x.item_b): x.n_both for x in cooccurrence(pairs, "r", "i", chunk_items=c).collect()} for c in (16, 512))
    assert chunked == plain and len(plain) == 400 * 399 // 2


def test_missing_column(spark):
    with pytest.raises(ValueError):
        top_n(spark.range(3).withColumn("s", F.lit(1.0)), "g", "s", [], 1)
