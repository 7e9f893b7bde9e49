"""What the searches over configurations try and report."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster as C
from millrace.operators import vectors as V
from millrace.plans import clusters as P
from millrace.plans import similarity as S

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_grid_search_tries_all_and_tests_the_best(spark, monkeypatch):
    # the smallest tables have nine ties within the population, too few for three splits: all products' ties stand in
    monkeypatch.setattr(S, "_inside", lambda spark, folder, ties: ties)
    got = S.grid_search(spark, FOLDER).collect()
    tried = [r for r in got if r.split == "validation"]
    assert {n: sum(r.representation == n for r in tried) for n in S.UNTUNED} == {"note_tfidf": 24, "note_svd": 15, "hybrid": 9}
    split = S.split_md5(spark, FOLDER)
    asked = split.where("split = 'test'").count()
    for name in S.UNTUNED:
        best = {r.config for r in tried if r.representation == name and r.place == 1}
        untuned = {r.config for r in tried if r.representation == name and r.untuned}
        tested = [r for r in got if r.split == "test" and r.representation == name]
        assert len(best) == len(untuned) == 1 and {r.config for r in tested} == best | untuned
        assert all(0 < r.n_evaluated <= asked for r in tested) and all(r.gain == 0 for r in got if r.untuned)
    # the untuned configurations are the vectors of the other queries
    true = S.truth(spark, FOLDER).join(split, "product_id").where("split = 'validation'")
    for name, whole in (("note_tfidf", S.note_vectors(spark, FOLDER)), ("hybrid", V.blend(S.note_vectors(spark, FOLDER), S.accord_vectors(spark, FOLDER), "product_id", 0.5))):
        lists = V.top_k(whole.join(true, "product_id", "left_semi"), whole, "product_id", S.KS[-1]).select(F.col("query").alias("product_id"), F.col("neighbour").alias("related_id"), "rank")
        want = S._metrics(lists, true).first()
        mine = next(r for r in tried if r.representation == name and r.untuned)
        assert {c: mine[c] for c in want.asDict()} == want.asDict()


def test_grid_search_writes_no_vectors_of_each_configuration(spark, monkeypatch):
    # with 24 copies of the products' vectors and lists of all queries it ran out of disk and time
    monkeypatch.setattr(S, "_inside", lambda spark, folder, ties: ties)
    written, plain = [], S.materialise

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    for module in (S, V):
        monkeypatch.setattr(module, "materialise", counted)
    assert len(S.grid_search(spark, FOLDER).collect()) >= 48 + 3
    notes, pairs = S.product_notes(spark, FOLDER).count(), S.counts(spark, FOLDER).count()
    queries = S.truth(spark, FOLDER).select("product_id").distinct().count()
    assert max(written) <= max(notes, pairs, 2 * 48 * queries)


def test_stability_has_a_row_for_each_k(spark):
    got = P.bootstrap_stability(spark, FOLDER).collect()
    assert [(r.k, r.n_pairs) for r in got] == [(k, 190) for k in (8, 10, 12, 15, 18, 20, 25)]
    assert all(0 < r.mean_ari < 1 and r.std_ari > 0 for r in got)
    a, b = np.array([0, 0, 1, 1, 2, 2]), np.array([0, 0, 1, 2, 2, 2])
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    assert C.rand_of(a, b) == pytest.approx(C.adjusted_rand(df, "a", "b").first()[0]) and C.rand_of(a, a) == 1


def test_sweep_covers_every_k(spark):
    got = P.kmeans_sweep(spark, FOLDER).collect()
    assert [r.k for r in got] == list(range(2, 31)) and sum(r.knee for r in got) == 1
    assert all(-1 < r.silhouette < 1 and r.calinski_harabasz > 0 and r.davies_bouldin > 0 and r.largest >= r.mean_size for r in got)


def test_ties_and_records_have_tables(spark):
    from millrace.plans import records

    found = records.p4_found(spark, FOLDER).where("path LIKE 'similar.%'").select("product_id", "path", "pos")
    ties = records.p4_ties(spark, FOLDER)
    usable = ties.where(F.col("id_").rlike(r"(?U)\S")).select("product_id", F.col("place").alias("path"), F.col("pos").cast("int").alias("pos"))
    assert {"up_votes", "down_votes"} <= set(ties.columns) and usable.count() > 0
    assert sorted(map(tuple, usable.collect())) == sorted(map(tuple, found.collect()))
    root = records.p4_records(spark, FOLDER)
    assert {"relation_have", "relation_had", "relation_want", "seasons_winter", "seasons_autumn"} <= set(root.columns)
    want = records.p4_found(spark, FOLDER).where("path = 'relation.have'").count()
    assert root.count() == root.select("product_id").distinct().count() and 0 < root.where("relation_have IS NOT NULL").count() <= want


def test_alternatives_have_all_minimum_sizes_and_the_strong_graph(spark):
    got = {r.algorithm: r for r in P.alternative_clusterings(spark, FOLDER).collect()}
    assert {"density_5", "density_10", "density_20"} <= set(got) and len(got) == 14
    names, _ = P._embedded(spark, FOLDER)
    strong = C.square(P.A.ppmi(P.counts(spark, FOLDER)).where("ppmi >= 1"), "a", "b", "ppmi", names)
    assert got["louvain"].n_clusters == len(set(C.louvain(strong)))


def test_map_and_nesting(spark):
    cells = P.som_map(spark, FOLDER).collect()
    notes = P.svd_embedding(spark, FOLDER).count()
    assert len(cells) == 36 and sum(r.n_notes for r in cells) == notes and all(r.ridge >= 0 and r.quantisation_error > 0 for r in cells)
    nested = P.family_nesting(spark, FOLDER).collect()
    assert sum(r.n_notes for r in nested) == notes and all(0 < r.purity <= 1 for r in nested) and len({(r.linkage, r.degenerate) for r in nested}) == 1


def test_svd_neighbours(spark):
    rows = {r.product_id: dict(zip(r.idx, r.val)) for r in S._svd_grid(spark, FOLDER, [S.UNTUNED["note_svd"]]).collect()}
    got = S.svd_topk(spark, FOLDER).collect()
    dense = {k: np.array([v[i] for i in range(len(v))]) for k, v in rows.items()}
    query = min(r.query for r in got)
    want = sorted(((-round(float(dense[query] @ v), 6), k) for k, v in dense.items() if k != query))[:10]
    assert [(r.neighbour, r.similarity) for r in sorted((r for r in got if r["query"] == query), key=lambda r: r["rank"])] == [(k, pytest.approx(-s, abs=2e-6)) for s, k in want]
