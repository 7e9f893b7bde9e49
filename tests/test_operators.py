import difflib
import math
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.text import folded, gloss, token
from millrace.operators import association, cluster, profile, ranking, resolve, signals, vectors
from millrace.runtime import materialise, salted_join


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_if_zero(spark):
    df = spark.createDataFrame([(0, 0, 0), (3, None, 0), (None, None, None), (0, None, 0)], "have int, had int, want int")
    got = signals.null_if_zero(df, {"relation": ["have", "had", "want"]}).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (3, None, 0), (None, None, None), (None, None, None)]


def test_ratio_and_shrinkage(spark):
    df = spark.createDataFrame([(1, 2, 1, 4.0, 10), (0, 0, 0, 2.0, 30), (1, None, 1, None, 20)], "want int, have int, had int, rating double, people int")
    assert [r[0] for r in df.select(signals.ratio("want", ["have", "had"])).collect()] == [0.25, None, None]
    got = [r.out for r in signals.shrunk(df, "rating", "people", "out").collect()]
    assert got[0] == pytest.approx((10 * 4 + 20 * 3) / 30) and got[2] is None


def test_demeaned_keeps_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("b", float(i)) for i in range(5)] + [(None, 2.0)] * 6, "brand string, v double")
    got = signals.demeaned(df, "brand", ["v"], 5)
    assert rows(got.where("brand = 'a'").select("v_demeaned", "is_demeaned").distinct()) == [(1.0, False)]
    assert got.where("brand = 'b'").agg(F.sum("v_demeaned")).first()[0] == 0
    assert got.where("brand IS NULL").select("is_demeaned").distinct().collect()[0][0] is False
    assert signals.demeaned(df, "brand", ["v"], 5, fallback=False).where("brand = 'a' AND v_demeaned IS NULL").count() == 4


def test_weighted_means_skip_nulls(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 3.0, None), ("y", 1.0, None)], "k string, w double, v double")
    assert rows(signals.weighted_means(df, ["k"], "w", ["v"]).select("k", "v", "v_weight", "total_weight")) == [("x", 2.0, 1.0, 4.0), ("y", None, 0.0, 1.0)]


def test_momentum_and_confidence(spark):
    df = spark.createDataFrame([("a", 2000, 0.2), ("a", 2001, 0.4), ("a", 2005, 0.5), ("b", 2005, 0.1)], "k string, y int, s double")
    got = {r.k: r.momentum for r in signals.momentum(df, "k", "y", "s", (2000, 2001), (2005, 2006)).collect()}
    assert got["a"] == pytest.approx(0.2) and got["b"] is None
    w = spark.createDataFrame([(499.0,), (500.0,), (199.0,), (None,)], "w double")
    assert [r[0] for r in w.select(signals.confidence("w")).collect()] == ["MEDIUM", "HIGH", "LOW", "LOW"]


def test_text(spark):
    df = spark.createDataFrame([("Agarwood (Oud)",), ("Oak-Moss  X",), ("a (b) c (d)",), (None,), ("Ｆｌáур\xa0Q",)], "s string")
    got = df.select(token(F.col("s")).alias("t"), gloss(F.col("s")).alias("g"), folded(F.col("s")).alias("f")).collect()
    assert [(r.t, r.g) for r in got[:4]] == [("agarwood", "oud"), ("oak moss x", None), ("a c", "b"), (None, None)]
    assert got[4].f == "flayp q"


def test_ranking_metrics(spark):
    lists = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (3, 10, 1)], "q long, i long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 11), (1, 99), (2, 5)], "q long, i long")
    r = ranking.ranking_metrics(lists, truth, "q", "i", "rank", (2, 5)).first()
    assert r.n_evaluated == 2 and r.precision_2 == 0.25 and r.precision_5 == pytest.approx(0.1) and r.recall_5 == 0.25 and r.mrr_5 == 0.25 and r.hit_2 == 0.5


def test_average_and_nearest_rank(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (1.0,), (9.0,)], "v double")
    assert sorted(r[0] for r in df.select(ranking.average_rank("v")).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert rows(ranking.nearest_rank(df, "v", (0.0, 0.5, 0.9))) == [(0.0, 1.0), (0.5, 5.0), (0.9, 9.0)]


def test_hashed_lists_are_other_items(spark):
    items = spark.range(50).withColumnRenamed("id", "i")
    got = ranking.hashed_lists(items.withColumnRenamed("i", "q"), items, "q", "i", 5, "s")
    assert got.where("q = i").count() == 0 and got.groupBy("q").count().where("count <> 5").count() == 0


def test_ppmi_and_tfidf(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "d"), (None, "a"), (5, None)], "r int, t string")
    counts = association.cooccurrence(df, "r", "t")
    assert rows(counts) == [("a", "b", 2), ("a", "c", 1)]
    value = {(r.a, r.b): r.ppmi for r in association.ppmi(counts).collect()}
    assert value[("a", "b")] == pytest.approx(math.log(2 * 6 / (3 * 2)))
    w = {(r.r, r.t): r.weight for r in association.tf_idf(df, "r", "t").collect()}
    idf = {t: math.log(5 / (1 + n)) + 1 for t, n in (("a", 3), ("b", 2))}
    assert w[1, "a"] == pytest.approx(idf["a"] / math.hypot(*idf.values())) and w[4, "d"] == pytest.approx(1)


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (None, 5), (3, 6)], "a int, b int")
    assert rows(profile.null_counts(df, ["a", "b"])) == [("a", 1), ("b", 1)]
    assert rows(profile.funnel(df, {"a": F.col("a") > 0, "b": F.col("b") > 0})) == [("a", 2, 1), ("all", 3, 0), ("b", 1, 1)]
    assert {r.field: r.n_present for r in profile.coverage(df, {"a": F.col("a").isNotNull()}).collect()} == {"a": 2}
    assert rows(profile.thresholds(df, "b", (5, 6, 9), {"m": F.max("a")})) == [(5, 2, 3), (6, 1, 3)]


def test_top_k_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6))
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    df = vectors.from_dense(df, "id", "v")
    got = vectors.top_k(df.where("id % 10 = 0"), df, "id", 5, block=32)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = []
    for q in range(0, 120, 10):
        sim = np.round(unit[q] @ unit.T, 6)
        best = sorted((i for i in range(120) if i != q), key=lambda i: (-sim[i], i))[:5]
        want += [(q, k, i) for k, i in enumerate(best, 1)]
    assert rows(got.select("query", "rank", "neighbour")) == sorted(want, key=repr)
    pair = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] and round(r[0], 6) for r in pair.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None]


def test_top_k_by_variant(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(c, i, v.tolist()) for c in (0, 1) for i, v in enumerate(rng.normal(size=(70, 4)))], "c int, id long, v array<double>")
    df = df.select("c", "id", F.transform("v", lambda x, i: i).alias("idx"), vectors.unit(F.col("v")).alias("val"))
    got = rows(vectors.top_k(df.where("id % 10 = 0"), df, "id", 5, block=32, by="c"))
    want = []
    for c in (0, 1):
        one = df.where(F.col("c") == c)
        want += [(c, *r) for r in rows(vectors.top_k(one.where("id % 10 = 0"), one, "id", 5))]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("first", [1_000, 60])
def test_places_are_those_of_the_lists(spark, first):
    # functions of the test, so that they reach the workers by value
    def first_two(lists):
        n, v = lists["v"]
        x = v.reshape(len(n), -1)[:, :2]
        return x[:, 0] != 2, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def all_columns(lists):
        n, v = lists["v"]
        return np.ones(len(n), bool), vectors.sparse_unit(len(n), np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]), v)

    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, size=(300, 4)).astype(float)  # many equal rows, some of zeros
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    pairs = [(int(q), int(i)) for q, i in rng.integers(0, 310, size=(1_500, 2))] + [(3, 3), (4, None)]  # some to themselves or unknown
    asked = spark.createDataFrame(pairs, "q long, i long")
    got = rows(vectors.places(asked, held, "q", "i", "id", 20, {7: all_columns, 2: first_two}, first=first, alive=200).select("variant", "query", "item", "rank"))
    want = []
    for variant, of in ((7, held), (2, held.where("v[0] <> 2").select("id", F.slice("v", 1, 2).alias("v")))):
        lists = vectors.top_k(vectors.from_dense(of, "id", "v"), vectors.from_dense(of, "id", "v"), "id", 20)
        want += [(variant, *r) for r in rows(lists.select("query", F.col("neighbour").alias("item"), "rank")) if (r[0], r[1]) in set(pairs)]
    assert len(want) > 50 and {w[0] for w in want} == {2, 7}
    assert got == sorted(want, key=repr)


def test_components_and_pick(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), (None, "x")], "a string, b string")
    got = dict(rows(resolve.components(edges, "a", "b")))
    assert set(got.values()) == {"n000", "x"} and len(got) == 63
    members = spark.createDataFrame([("g", "long name", 5), ("g", "name", 5), ("g", "rare", 1)], "g string, t string, n int")
    assert rows(resolve.canonical_pick(members, "g", "t", "n")) == [("g", "name")]
    forced = spark.createDataFrame([("rare",)], "t string")
    assert rows(resolve.canonical_pick(members, "g", "t", "n", forced)) == [("g", "rare")]


def test_token_pairs(spark):
    names = ["pepper", "peppermint", "mint", "vanilla", "vanila", "clove", "clover", "rose", "rose petal", "bruváer", "bruvaer", "brazilian redwood", "brazilian rosewood"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    evidence = {(r.short, r.long): r.merges for r in resolve.compound_evidence(resolve.prefix_pairs(df, "t"), df, "t").collect()}
    assert evidence[("pepper", "peppermint")] is False
    assert rows(resolve.word_pairs(df, "t")) == [("rose", "rose petal")]
    found = {(r.short, r.long): r for r in resolve.fuzzy_pairs(df, "t").collect()}
    want = {}
    for a in names:
        for b in names:
            s, l = sorted((a, b), key=lambda x: (len(x), x))
            if a < b and a[0] == b[0] and abs(len(a) - len(b)) <= 4 and (q := difflib.SequenceMatcher(None, s, l).ratio()) >= 0.8:
                want[s, l] = q
    assert {k: r.ratio for k, r in found.items()} == want
    assert found[("vanila", "vanilla")].merges and not found[("brazilian redwood", "brazilian rosewood")].merges


def test_resolve(spark):
    seen = [(p, "vanilla") for p in range(40)] + [(p, "vanila") for p in range(40, 45)] + [(p, "rare") for p in range(3)] + [(p, "warm notes") for p in range(50)] + [(p, "clove") for p in range(35)] + [(p, "clover") for p in range(35)]
    df = spark.createDataFrame([(p, t) for p, t in seen] + [(1, ""), (1, None)], "p long, t string")
    merges = spark.createDataFrame([("vanila", "vanilla"), ("clove", "clover")], "short string, long string")
    got = {r.raw_token: (r.canonical, r.action) for r in resolve.resolve(df, "t", "p", merges, "notes$", 30, excluded=[("clover", "clove")]).collect()}
    assert got == {"vanilla": ("vanilla", "KEEP"), "vanila": ("vanilla", "MERGE"), "rare": (None, "DROP_RARE"), "warm notes": (None, "DROP_PLACEHOLDER"), "clove": ("clove", "KEEP"), "clover": ("clover", "KEEP")}


def test_resolve_gives_reasons_and_reads_glosses(spark):
    names = spark.createDataFrame([("Agarwood (Oud)",), ("Oud",), ("Rose (fresh)",), ("Musk (Musk)",), (None,)], "n string")
    glosses = resolve.gloss_pairs(names, "n")
    assert rows(glosses) == [("oud", "agarwood"), ("rose", "fresh")]
    seen = [(p, "agarwood") for p in range(20)] + [(p, "oud") for p in range(20, 35)] + [(p, "rose") for p in range(40)] + [(p, "rose petal") for p in range(40)] + [(1, "rare"), (1, "warm notes")]
    df = spark.createDataFrame(seen, "p long, t string")
    review = spark.createDataFrame([("rose", "rose petal", "whole word", None), ("rose", "rosa", "like spelling", 0.85), ("oud", "rose", "like spelling", 0.8)], "short string, long string, reason string, ratio double")
    got = {r.raw_token: r for r in resolve.resolve(df, "t", "p", glosses.withColumn("reason", F.lit("gloss")), "notes$", 30, review=review).collect()}
    assert {t: (r.canonical, r.action, r.reason) for t, r in got.items()} == {
        "agarwood": ("agarwood", "KEEP", None), "oud": ("agarwood", "MERGE", "gloss"), "rose": ("rose", "KEEP", "REVIEW: like 'oud' (ratio 0.80); REVIEW: contained with rose petal"),
        "rose petal": ("rose petal", "KEEP", "REVIEW: contained with rose"), "rare": (None, "DROP_RARE", "group 'rare' in 1 records, fewer than 30"), "warm notes": (None, "DROP_PLACEHOLDER", "name of no single note"),
    }
    assert [tuple(x) for x in got["rose"].review] == [("oud", "like spelling", 0.8), ("rose petal", "whole word", None)] and [x.other for x in got["oud"].review] == ["rose"]


def test_salted_join(spark, monkeypatch):
    from millrace import runtime

    big = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id")
    other = spark.createDataFrame([(1, "hot"), (4500, "x"), (9999, "y")], "k long, v string")
    want = rows(big.join(other, "k", "left").select("id", "v"))
    monkeypatch.setattr(runtime, "SALT_ROWS", 0)
    assert rows(salted_join(big, other, "k", "left").select("id", "v")) == want
    assert rows(materialise(big).select("id")) == rows(big.select("id"))


def blobs():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (5, 0), (0, 5))]), np.repeat([0, 1, 2], 30)


def agree(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_small_clusterings():
    x, truth = blobs()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for method in ("single", "complete", "average", "ward"):
        merges = cluster.linkage(d, method)
        assert agree(cluster.cut(merges, 3), truth)
        assert cluster.cophenetic(merges, d) > 0.7
    assert agree(cluster.lloyd(x, 3), truth)
    assert agree(cluster.spectral(np.exp(-(d**2)), 3), truth)
    assert agree(cluster.diagonal_gmm(x, 3)[0], truth)
    assert agree(cluster.louvain(np.where(d < 1.5, 1.0, 0) - np.eye(90)), truth)
    labels = cluster.density_clusters(d, 5)
    assert len(set(labels[labels >= 0])) == 3 and all(len(set(truth[labels == k])) == 1 for k in range(3))
    cells, gaps, error = cluster.self_organising_map(x, 3, 3)
    assert len(cells) == 90 and len(gaps) == 9 and error < 1.5
    assert cluster.silhouette_exact(x, truth) > 0.8
    assert cluster.knee([1, 2, 3, 4, 5], [100, 20, 15, 12, 10]) == 2
    m = np.array([[0, 2, 0], [2, 0, 1], [0, 1, 0]], float)
    u = cluster.svd_embedding(m, 3)
    assert np.allclose(u.T @ u, np.diag(np.diag(u.T @ u)))


def test_table_validity(spark):
    x, truth = blobs()
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, truth))], "id long, c int, v array<double>")
    means = np.stack([x[truth == k].mean(0) for k in range(3)])
    between = sum(30 * ((m - x.mean(0)) ** 2).sum() for m in means)
    within = ((x - means[truth]) ** 2).sum()
    assert cluster.calinski_harabasz(df, "id", "c", "v").first()[0] == pytest.approx(between * 87 / (within * 2))
    spread = [np.linalg.norm(x[truth == k] - means[k], axis=1).mean() for k in range(3)]
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(means[i] - means[j]) for j in range(3) if j != i) for i in range(3)]
    assert cluster.davies_bouldin(df, "id", "c", "v").first()[0] == pytest.approx(np.mean(worst))
    assert cluster.adjusted_rand(df.withColumn("d", -F.col("c")), "c", "d").first()[0] == pytest.approx(1)
    assert cluster.adjusted_mutual_information(df.withColumn("d", F.col("id") % 2), "c", "d") == pytest.approx(0, abs=0.05)
    found = cluster.kmeans(df, "v", 3, seeds=range(3)).select("cluster", "c").collect()
    assert agree([r[0] for r in found], [r[1] for r in found])
    with pytest.raises(ValueError):
        cluster.matrix(spark.range(cluster.LIMIT + 1).select("id", F.array(F.lit(1.0)).alias("v")), "id", "v")


def test_mixtures_read_all_dimensions(spark, monkeypatch):
    x, truth = blobs()
    x = np.concatenate([np.random.default_rng(5).normal(size=(90, 4)), x], 1)  # what sets the groups apart stands last
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    got = {(kind, k): (ll, b) for kind, k, ll, b in cluster.gmm_bic(df, "v", (1, 2, 3, 4))}
    for kind in ("full", "diag"):
        assert min(range(1, 5), key=lambda k: got[kind, k][1]) == 3
    cov = np.cov(x.T, bias=True) + 1e-6 * np.eye(6)
    want = -0.5 * (90 * (6 * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1]) + np.einsum("ij,jk,ik", x - x.mean(0), np.linalg.inv(cov), x - x.mean(0)))
    assert got["full", 1] == pytest.approx((want, -2 * want + (6 + 21) * math.log(90)))
    monkeypatch.setattr(cluster, "LIMIT", 60)  # in tasks, from a start of 60 rows
    far = {(kind, k): ll for kind, k, ll, _ in cluster.gmm_bic(df, "v", (1, 3))}
    assert all(far[m] == pytest.approx(got[m][0], abs=0.5) for m in far)


def test_validity_of_a_matrix(spark):
    x, truth = blobs()
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, truth))], "id long, c int, v array<double>")
    mine = cluster.validity(x, truth)
    assert mine["calinski_harabasz"] == pytest.approx(cluster.calinski_harabasz(df, "id", "c", "v").first()[0])
    assert mine["davies_bouldin"] == pytest.approx(cluster.davies_bouldin(df, "id", "c", "v").first()[0])
    assert (mine["mean_size"], mine["largest"], mine["n_singletons"]) == (30, 30, 0) and mine["silhouette"] == cluster.silhouette_exact(x, truth)


def test_salted_join_with_clashing_names(spark, monkeypatch):
    from millrace import runtime

    monkeypatch.setattr(runtime, "SALT_ROWS", 0)
    big = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 1), (None, 2)], "_t long, _n long")
    other = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "_t long, v string")
    assert sorted(x.v for x in runtime.salted_join(big, other, "_t").collect()) == ["a"] * 200 + ["b"]


def test_prepared_follows_its_inputs(spark, tmp_path):
    from millrace.runtime import prepared

    at, built = str(tmp_path / "x.parquet"), []
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(at)
        for _ in range(2):
            assert prepared(spark, "x", [at], lambda: (built.append(1), spark.read.parquet(at))[1]).count() == n
    assert len(built) == 2
    shutil.rmtree(prepared(spark, "x", [at], lambda: None).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert prepared(spark, "x", [at], lambda: spark.read.parquet(at)).count() == 5


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from millrace import runtime

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, type("Conf", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        runtime.scratch(Session)


def test_banded_pairs_against_brute_force(spark):
    import random

    from millrace.operators.resolve import banded_pairs

    rng = random.Random(11)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(80)})
    got = {(x.short, x.long) for x in banded_pairs(spark.createDataFrame([(w,) for w in words + words[:5] + [None, ""]], "t string"), "t", 2).collect()}
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if a < b and a[0] == b[0] and abs(len(a) - len(b)) <= 2}
    assert got == want


def test_contingency_table_is_not_cut(spark, monkeypatch):
    from millrace.operators import cluster

    monkeypatch.setattr(cluster, "CELLS", 3)
    df = spark.createDataFrame([(i, i % 2) for i in range(4)], "a long, b long")
    with pytest.raises(ValueError):
        cluster.adjusted_mutual_information(df, "a", "b")


def test_canonical_form_by_hand(spark):
    from millrace.operators.resolve import resolve

    said = spark.createDataFrame([(t, r) for t, n in (("rose", 9), ("roses", 3)) for r in range(n)], "t string, r long")
    pairs = spark.createDataFrame([("rose", "roses")], "short string, long string")
    for by_hand, want in (((), "rose"), (("roses",), "roses")):
        got = {x.raw_token: x for x in resolve(said, "t", "r", pairs, "^none$", rare=1, canonical=by_hand).collect()}
        assert {x.canonical for x in got.values()} == {want} and got[want].action == "KEEP"
