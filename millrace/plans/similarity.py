"""Association of notes, product vectors, neighbours, and how good they are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import association as A
from millrace.operators import cluster as C
from millrace.operators import ranking as K
from millrace.operators import vectors as V
from millrace.plans import Registry, table
from millrace.plans.catalogue import ACCORDS, FAMILY, NOTES, PRODUCTS, _REC, _tier_weighted, accords, membership, product_notes, products
from millrace.runtime import dealt, materialise, ship, small

R = Registry()

_COOC = f"{NOTES}, co AS (SELECT a.note AS a, b.note AS b, count(*) AS n FROM pn a JOIN pn b ON a.product_id = b.product_id AND a.note < b.note GROUP BY 1, 2)"
_PPMI = f"""{_COOC}, two AS (SELECT a, b, n FROM co UNION ALL SELECT b, a, n FROM co), sums AS (SELECT a, sum(n)::BIGINT AS r FROM two GROUP BY 1), tot AS (SELECT sum(n)::BIGINT AS t FROM two),
pp AS (SELECT co.a, co.b, n, ln(n::DOUBLE * t / (x.r::DOUBLE * y.r)) AS ppmi FROM co JOIN sums x ON x.a = co.a JOIN sums y ON y.a = co.b CROSS JOIN tot)"""


def counts(spark, folder) -> DataFrame:
    return A.cooccurrence(product_notes(spark, folder), "product_id", "note")


@R.query("cooc_pairs", f"WITH {_COOC} SELECT a, b, n FROM co")
def cooc_pairs(spark, folder):
    """Products that hold two notes."""
    return counts(spark, folder)


@R.query("ppmi", f"WITH {_PPMI} SELECT a, b, n, round(ppmi, 6) AS ppmi FROM pp WHERE ppmi > 0")
def ppmi(spark, folder):
    """Positive pointwise mutual information."""
    return A.ppmi(counts(spark, folder)).withColumn("ppmi", F.round("ppmi", 6))


@R.query("ppmi_shifted", f"WITH {_PPMI} SELECT a, b, n, round(ppmi - ln(3), 6) AS ppmi FROM pp WHERE ppmi - ln(3) > 0")
def ppmi_shifted(spark, folder):
    """The same less ln 3."""
    return A.ppmi(counts(spark, folder), shift=3).withColumn("ppmi", F.round("ppmi", 6))


_TWO = "q AS (SELECT a, b, v FROM (SELECT a, b, round({v}, 6) AS v FROM {f}) UNION ALL SELECT b, a, v FROM (SELECT a, b, round({v}, 6) AS v FROM {f})), k AS (SELECT a, row_number() OVER (PARTITION BY a ORDER BY v DESC, b)::INT AS rank, b, v FROM q)"


@R.query("ppmi_top_partners", f"WITH {_PPMI}, pos AS (SELECT * FROM pp WHERE ppmi > 0), {_TWO.format(v='ppmi', f='pos')} SELECT a, rank, b, v AS ppmi FROM k WHERE rank <= 20")
def ppmi_top_partners(spark, folder):
    """Twenty best partners of each note."""
    return A.partners(ppmi(spark, folder), "ppmi", 20)


@R.query("cooc_top_partners", f"WITH {_COOC}, {_TWO.format(v='n', f='co').replace('round(n, 6)', 'n')} SELECT a, rank, b, v AS n FROM k WHERE rank <= 20")
def cooc_top_partners(spark, folder):
    """Twenty most frequent partners of each note."""
    return A.partners(counts(spark, folder), "n", 20)


@R.query("ppmi_lookup", f"WITH {_PPMI}, pos AS (SELECT * FROM pp WHERE ppmi > 0), {_TWO.format(v='ppmi', f='pos')} SELECT DISTINCT least(a, b) || '|' || greatest(a, b) AS pair, v AS ppmi FROM k WHERE rank <= 50")
def ppmi_lookup(spark, folder):
    """Pairs among the fifty best of either note."""
    return A.partner_lookup(ppmi(spark, folder), "ppmi", 50)


@R.query("note_combo_count", f"WITH {NOTES} SELECT count(*) AS n_records FROM (SELECT product_id FROM pn WHERE note IN ('briarski bloom', 'vaelthond pollen', 'taewia pollen') GROUP BY 1 HAVING count(DISTINCT note) = 3)")
def note_combo_count(spark, folder):
    """Products that hold all of several notes."""
    return A.combos(product_notes(spark, folder), "product_id", "note", ["briarski bloom", "vaelthond pollen", "taewia pollen"])


_TFIDF = """d AS (SELECT note, count(*) AS df FROM {src} GROUP BY 1), t AS (SELECT count(DISTINCT product_id) AS n FROM {src}), w AS (SELECT product_id, note, {tf} * {idf} AS x FROM {src} JOIN d USING (note) CROSS JOIN t{where}),
tf AS (SELECT product_id, note, x / sqrt(sum(x * x) OVER (PARTITION BY product_id)) AS weight FROM w)"""
_IDF = "(ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1)"
_PLAIN = f"{NOTES}, {_TFIDF.format(src='pn', tf='1.0::DOUBLE', idf=_IDF, where='')}"


@R.query("tfidf_weights", f"WITH {_PLAIN} SELECT product_id, note, round(weight, 6) AS weight FROM tf")
def tfidf_weights(spark, folder):
    """Binary term frequency, smooth idf, unit length."""
    return A.tf_idf(product_notes(spark, folder), "product_id", "note", digits=6)


_TIER = "CASE tier WHEN 'top' THEN 0 WHEN 'middle' THEN 1 WHEN 'base' THEN 2 ELSE 3 END"
_MAP_ONLY = NOTES.rsplit(", pn AS", 1)[0]


@R.query(
    "tfidf_variants",
    f"WITH {_MAP_ONLY}, tw AS (SELECT product_id, note, max(1.0::DOUBLE / (1 + {_TIER})) AS q FROM typed JOIN map USING (raw_token) GROUP BY 1, 2), {_TFIDF.format(src='tw', tf='(1 + ln(q))', idf='1.0::DOUBLE', where=' WHERE df >= 20')} SELECT product_id, note, round(weight, 6) AS weight FROM tf WHERE weight IS NOT NULL AND NOT isnan(weight)",
)
def tfidf_variants(spark, folder):
    """Tier weights, sublinear, without idf, notes of at least twenty products. Products whose weights are all 0 have none."""
    rows = _tier_weighted(spark, folder)
    out = A.tf_idf(rows, "product_id", "note", weight="weight", use_idf=False, sublinear=True, least_records=20)
    return out.where("weight IS NOT NULL AND NOT isnan(weight)").withColumn("weight", F.round("weight", 6))


_KNN = """sim AS (SELECT q.product_id AS query, b.product_id AS neighbour, round(sum(q.weight * b.weight), 6) AS similarity FROM tf q JOIN tf b USING (note) WHERE q.product_id % 50 = 0 AND q.product_id <> b.product_id GROUP BY 1, 2),
pad AS (SELECT query, neighbour, coalesce(similarity, 0) AS similarity FROM (SELECT DISTINCT q.product_id AS query, b.product_id AS neighbour FROM (SELECT DISTINCT product_id FROM tf WHERE product_id % 50 = 0) q, (SELECT DISTINCT product_id FROM tf) b WHERE q.product_id <> b.product_id) LEFT JOIN sim USING (query, neighbour)),
kn AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour)::INT AS rank, neighbour, similarity FROM pad)"""


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """A bounded vocabulary with numbers from 0."""
    from pyspark.sql import Window

    return df.select(column).distinct().select(column, (F.row_number().over(Window.partitionBy().orderBy(column)) - 1).alias("idx"))


def note_vectors(spark, folder) -> DataFrame:
    notes = materialise(product_notes(spark, folder))
    return V.sparse(A.tf_idf(notes, "product_id", "note"), "product_id", "note", "weight", _numbered(notes, "note"))


def accord_vectors(spark, folder) -> DataFrame:
    rows = accords(spark, folder).where("strength IS NOT NULL").groupBy("product_id", "accord").agg(F.max("strength").cast("double").alias("weight"))
    rows = materialise(rows)
    return V.sparse(rows, "product_id", "accord", "weight", _numbered(rows, "accord"))


def _queries(df: DataFrame) -> DataFrame:
    """The stated query set: ids divisible by 50."""
    return df.where("product_id % 50 = 0")


def _knn(df: DataFrame, k: int = 10) -> DataFrame:
    return V.top_k(_queries(df), df, "product_id", k)


@R.query("tfidf_topk", f"WITH {_PLAIN}, {_KNN} SELECT query, rank, neighbour, similarity FROM kn WHERE rank <= 10")
def tfidf_topk(spark, folder):
    """Ten products of nearest notes, for every query against all."""
    return _knn(materialise(note_vectors(spark, folder)))


_ACC_TF = f"{ACCORDS}, aw AS (SELECT product_id, accord AS note, max(strength)::DOUBLE AS x FROM acc WHERE strength IS NOT NULL GROUP BY 1, 2), tf AS (SELECT product_id, note, x / sqrt(sum(x * x) OVER (PARTITION BY product_id)) AS weight FROM aw)"


@R.query("accord_topk", f"{_REC}, {_ACC_TF}, {_KNN} SELECT query, rank, neighbour, similarity FROM kn WHERE rank <= 10")
def accord_topk(spark, folder):
    """Ten products of nearest accords."""
    return _knn(materialise(accord_vectors(spark, folder)))


@R.query(
    "hybrid_topk",
    f"""{_REC}, {_ACC_TF.replace("tf AS (SELECT", "af AS (SELECT")}, {_PLAIN.replace("tf AS (SELECT product_id", "nf AS (SELECT product_id")},
tf AS (SELECT product_id, 'n' || note AS note, weight * sqrt(0.5::DOUBLE) AS weight FROM nf SEMI JOIN af USING (product_id) UNION ALL SELECT product_id, 'a' || note, weight * sqrt(0.5::DOUBLE) FROM af SEMI JOIN nf USING (product_id)), {_KNN} SELECT query, rank, neighbour, similarity FROM kn WHERE rank <= 10""",
)
def hybrid_topk(spark, folder):
    """Half notes, half accords, in one product."""
    return _knn(materialise(V.blend(note_vectors(spark, folder), accord_vectors(spark, folder), "product_id", 0.5)))


_FAM_TF = f"{FAMILY}, tf AS (SELECT product_id, cluster AS note, share / sqrt(sum(share * share) OVER (PARTITION BY product_id)) AS weight FROM fam)"


def family_vectors(spark, folder) -> DataFrame:
    """Memberships as vectors: one place a family, 0 where a product has no note of it."""
    rows = membership(spark, folder)
    return V.sparse(rows, "product_id", "cluster", "share", _numbered(rows, "cluster"))


@R.query("family_topk", f"WITH {_FAM_TF}, {_KNN} SELECT query, rank, neighbour, similarity FROM kn WHERE rank <= 10")
def family_topk(spark, folder):
    """Ten products of nearest family memberships."""
    return _knn(materialise(family_vectors(spark, folder)))


@R.query("svd_topk")
def svd_topk(spark, folder):
    """Ten products whose notes' mean vectors are nearest."""
    rows = materialise(_svd_grid(spark, folder, [UNTUNED["note_svd"]]))
    return _knn(rows.drop("config"))


_FAMILIES = list(range(15))


@R.query("family_pivot", f"WITH {FAMILY} SELECT product_id, {', '.join(f'round(coalesce(max(share) FILTER (cluster = {c}), 0), 6) AS family_{c}' for c in _FAMILIES)} FROM (SELECT DISTINCT product_id FROM pn) LEFT JOIN fam USING (product_id) GROUP BY 1")
def family_pivot(spark, folder):
    """Memberships of the fifteen families as columns, a row for every product with notes, 0 where absent."""
    rows = membership(spark, folder).groupBy("product_id").pivot("cluster", _FAMILIES).agg(F.max("share"))
    rows = product_notes(spark, folder).select("product_id").distinct().join(rows, "product_id", "left").na.fill(0.0, [str(c) for c in _FAMILIES])
    return rows.select("product_id", *[F.round(F.col(str(c)), 6).alias(f"family_{c}") for c in _FAMILIES])


@R.query(
    "vector_topk",
    "WITH s AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0) SELECT query, rank, neighbour, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour)::INT AS rank FROM s) WHERE rank <= 10",
)
def vector_topk(spark, folder):
    """Ten nearest embeddings, for every query against all."""
    rows = V.from_dense(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return V.top_k(rows.where("vec_id % 50 = 0"), rows, "vec_id", 10)


@R.query(
    "mean_vectors",
    "WITH u AS (SELECT label, unnest(range(len(embedding))) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, p, avg(x) AS m FROM u GROUP BY 1, 2) SELECT label, p::INT AS p, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM m",
)
def mean_vectors(spark, folder):
    """Mean embedding of each label, of unit length."""
    return V.mean_vectors(table(spark, folder, "embeddings"), "label", "embedding").select("label", F.posexplode("embedding").alias("p", "x")).withColumn("x", F.round("x", 6))


# --- edges and evaluation ---

_EDGES = "e AS (SELECT DISTINCT product_id, related_id FROM similar_pairs WHERE product_id IS NOT NULL AND related_id IS NOT NULL AND product_id <> related_id)"
_INSIDE = "(SELECT product_id FROM products WHERE in_population)"
_TRUTH = f"""{PRODUCTS}, tr AS (SELECT DISTINCT s.product_id, related_id FROM similar_pairs s SEMI JOIN {_INSIDE} a ON s.product_id = a.product_id SEMI JOIN {_INSIDE} b ON related_id = b.product_id
  WHERE kind = 'reminds_me_of' AND up_votes - down_votes >= 5 AND s.product_id <> related_id)"""
#: Places down to which lists are measured.
KS = (5, 10, 20)


def edges(spark, folder) -> DataFrame:
    rows = table(spark, folder, "similar_pairs").where("product_id IS NOT NULL AND related_id IS NOT NULL AND product_id <> related_id")
    return rows.select("product_id", "related_id").distinct()


def truth(spark, folder) -> DataFrame:
    """Outgoing ties within the population with at least five net votes; unknown votes don't count."""
    rows = table(spark, folder, "similar_pairs").where("kind = 'reminds_me_of' AND up_votes - down_votes >= 5 AND product_id <> related_id")
    return _inside(spark, folder, rows.select("product_id", "related_id").distinct())


def _inside(spark, folder, ties: DataFrame) -> DataFrame:
    """Ties with both ends in the population."""
    inside = products(spark, folder).where("in_population").select("product_id")
    return ties.join(inside, "product_id", "left_semi").join(inside.withColumnRenamed("product_id", "related_id"), "related_id", "left_semi").select("product_id", "related_id")


@R.query("edge_reciprocity", f"WITH {_EDGES} SELECT count(*) AS n_edges, count(*) FILTER (r.product_id IS NOT NULL) AS n_reciprocated FROM e LEFT JOIN e r ON e.product_id = r.related_id AND e.related_id = r.product_id")
def edge_reciprocity(spark, folder):
    """Ties that are also given the other way."""
    e = edges(spark, folder)
    back = e.select(F.col("related_id").alias("product_id"), F.col("product_id").alias("related_id"), F.lit(True).alias("back"))
    return e.join(back, ["product_id", "related_id"], "left").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("back").alias("n_reciprocated"))


@R.query("edge_confidence", "SELECT kind, count(*) AS n, count(*) FILTER (up_votes - down_votes >= 5) AS n_confident, count(*) FILTER (up_votes >= 1000 OR down_votes >= 1000) AS n_approximate FROM similar_pairs GROUP BY 1")
def edge_confidence(spark, folder):
    """Ties by their votes."""
    rows = table(spark, folder, "similar_pairs")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("up_votes") - F.col("down_votes") >= 5).alias("n_confident"), F.count_if((F.col("up_votes") >= 1000) | (F.col("down_votes") >= 1000)).alias("n_approximate"))


@R.query("vote_summary", "SELECT count(up_votes) AS n, round(avg(up_votes), 6) AS mean, min(up_votes) AS min, round(quantile_cont(up_votes, 0.25), 6) AS p25, round(quantile_cont(up_votes, 0.5), 6) AS p50, round(quantile_cont(up_votes, 0.75), 6) AS p75, max(up_votes) AS max FROM similar_pairs")
def vote_summary(spark, folder):
    """Summary of a column."""
    at = lambda q: F.round(F.percentile("up_votes", F.lit(q)), 6)
    return table(spark, folder, "similar_pairs").agg(
        F.count("up_votes").alias("n"), F.round(F.avg("up_votes"), 6).alias("mean"), F.min("up_votes").alias("min"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), F.max("up_votes").alias("max")
    )


@R.query("edges_in_population", f"{PRODUCTS}, {_EDGES} SELECT e.* FROM e SEMI JOIN products p ON e.product_id = p.product_id AND p.in_population SEMI JOIN products q ON e.related_id = q.product_id AND q.in_population")
def edges_in_population(spark, folder):
    """Ties with both ends in the population."""
    return _inside(spark, folder, edges(spark, folder))


@R.query("symmetric_edges", f"WITH {_EDGES} SELECT product_id, related_id FROM e UNION SELECT related_id, product_id FROM e")
def symmetric_edges(spark, folder):
    """Ties in both directions."""
    e = edges(spark, folder)
    return e.unionByName(e.select(F.col("related_id").alias("product_id"), F.col("product_id").alias("related_id"))).distinct()


@R.query("truth_sets", f"{_TRUTH} SELECT product_id, count(*) AS n, string_agg(related_id::VARCHAR, ',' ORDER BY related_id) AS items FROM tr GROUP BY 1")
def truth_sets(spark, folder):
    """True neighbours of each query, in order."""
    return truth(spark, folder).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("related_id")), lambda x: x.cast("string")), ",").alias("items"))


def _metrics_sql(lists: str, truth: str) -> str:
    cells = ", ".join(
        f"round(avg(coalesce(h{k}, 0) / {k}.0::DOUBLE), 6) AS precision_{k}, round(avg(coalesce(h{k}, 0)::DOUBLE / size), 6) AS recall_{k}, round(avg(CASE WHEN first <= {k} THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr_{k}, round(avg(CASE WHEN h{k} > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_{k}"
        for k in KS
    )
    return f"""sz AS (SELECT product_id, count(*) AS size FROM {truth} GROUP BY 1), hi AS (SELECT l.product_id, min(rank) AS first, {", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}" for k in KS)} FROM {lists} l JOIN {truth} t ON l.product_id = t.product_id AND l.related_id = t.related_id GROUP BY 1)
SELECT count(*) AS n_evaluated, {cells} FROM (SELECT DISTINCT product_id FROM {lists}) JOIN sz USING (product_id) LEFT JOIN hi USING (product_id)"""


_LISTS = "li AS (SELECT product_id, related_id, row_number() OVER (PARTITION BY product_id ORDER BY s DESC, related_id) AS rank FROM (SELECT product_id, neighbour_id AS related_id, max(similarity) AS s FROM neighbours WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND neighbour_id <> product_id GROUP BY 1, 2))"


def stored_lists(spark, folder, k: int = KS[-1]) -> DataFrame:
    rows = table(spark, folder, "neighbours").where("similarity IS NOT NULL AND NOT isnan(similarity) AND neighbour_id <> product_id")
    best = rows.groupBy("product_id", F.col("neighbour_id").alias("related_id")).agg(F.max("similarity").alias("s"))
    return K.top_per_group(best, ["product_id"], [F.desc("s"), F.asc("related_id")], k)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _metrics(lists: DataFrame, true: DataFrame) -> DataFrame:
    return _rounded(K.ranking_metrics(lists, true, "product_id", "related_id", "rank", KS))


@R.query("rank_metrics", f"{_TRUTH}, {_LISTS}, {_metrics_sql('(SELECT * FROM li WHERE rank <= 20)', 'tr')}")
def rank_metrics(spark, folder):
    """Precision, recall, reciprocal rank and hit rate of the stored neighbours."""
    return _metrics(stored_lists(spark, folder), truth(spark, folder))


@R.query("symmetric_inflation", f"{_TRUTH}, {_LISTS}, sy AS (SELECT product_id, related_id FROM tr UNION SELECT related_id, product_id FROM tr), {_metrics_sql('(SELECT * FROM li WHERE rank <= 20)', 'sy')}")
def symmetric_inflation(spark, folder):
    """The same, if ties count both ways."""
    t = truth(spark, folder)
    both = t.unionByName(t.select(F.col("related_id").alias("product_id"), F.col("product_id").alias("related_id"))).distinct()
    return _metrics(stored_lists(spark, folder), both)


_SIDES = f"dire AS (SELECT * FROM (WITH {_metrics_sql('(SELECT * FROM li WHERE rank <= 20)', 'tr')})), symm AS (SELECT * FROM (WITH {_metrics_sql('(SELECT * FROM li WHERE rank <= 20)', 'sy')}))"
_CELLS = [f"{m}_{k}" for k in KS for m in ("precision", "recall", "mrr", "hit")]


@R.query(
    "inflation",
    f"{_TRUTH}, {_LISTS}, sy AS (SELECT product_id, related_id FROM tr UNION SELECT related_id, product_id FROM tr), {_SIDES} "
    + " UNION ALL ".join(f"SELECT '{c}' AS metric, dire.{c} AS directional, symm.{c} AS symmetric, round(symm.{c} - dire.{c}, 6) AS inflation FROM dire, symm" for c in _CELLS),
)
def inflation(spark, folder):
    """Each metric with ties as given, with ties both ways, and the difference."""
    one = rank_metrics(spark, folder).select(F.lit(1).alias("_"), *_CELLS).unpivot(["_"], _CELLS, "metric", "directional").drop("_")
    two = symmetric_inflation(spark, folder).select(F.lit(1).alias("_"), *_CELLS).unpivot(["_"], _CELLS, "metric", "symmetric").drop("_")
    return one.join(two, "metric").withColumn("inflation", F.round(F.col("symmetric") - F.col("directional"), 6))


@R.query(
    "baseline_popularity",
    f"{_TRUTH}, be AS (SELECT product_id AS related_id, have FROM products WHERE in_population AND have IS NOT NULL ORDER BY have DESC, product_id LIMIT 21), pl AS (SELECT q.product_id, related_id, row_number() OVER (PARTITION BY q.product_id ORDER BY have DESC, related_id) AS rank FROM (SELECT DISTINCT product_id FROM tr) q, be WHERE q.product_id <> related_id), {_metrics_sql('(SELECT * FROM pl WHERE rank <= 20)', 'tr')}",
)
def baseline_popularity(spark, folder):
    """The products that most people have, for everyone."""
    items = products(spark, folder).where("in_population").select(F.col("product_id").alias("related_id"), "have")
    true = truth(spark, folder)
    return _metrics(K.popularity_lists(true, items, "product_id", "related_id", "have", KS[-1]), true)


@R.query(
    "baseline_same_brand",
    f"{_TRUTH}, pl AS (SELECT q.product_id, b.product_id AS related_id, row_number() OVER (PARTITION BY q.product_id ORDER BY b.have DESC NULLS LAST, b.product_id) AS rank FROM (SELECT DISTINCT product_id FROM tr) t JOIN products q USING (product_id) JOIN products b ON q.brand = b.brand AND q.product_id <> b.product_id AND b.in_population), {_metrics_sql('(SELECT * FROM pl WHERE rank <= 20)', 'tr')}",
)
def baseline_same_brand(spark, folder):
    """The products of the same brand that most people have."""
    items = products(spark, folder).where("in_population").select(F.col("product_id").alias("related_id"), "brand", "have")
    true = truth(spark, folder)
    return _metrics(K.same_group_lists(true, items, "product_id", "related_id", "brand", "have", KS[-1]), true)


_DRAW = lambda parts: f"('0x' || substr(md5('random|' || {parts}), 1, 12))::BIGINT"


@R.query(
    "baseline_md5_random",
    f"""{_TRUTH}, it AS (SELECT DISTINCT product_id AS item FROM products WHERE in_population), nb AS (SELECT greatest(1, floor(count(*) / 8))::BIGINT AS n FROM it),
ln AS (SELECT item, {_DRAW("item")} % n AS b FROM it, nb), sz2 AS (SELECT b, count(*) AS size FROM ln GROUP BY 1), pc AS (SELECT item, b, row_number() OVER (PARTITION BY b ORDER BY item) - 1 AS place FROM ln),
sp AS (SELECT product_id, d, {_DRAW("product_id || '|' || d")} AS u FROM (SELECT DISTINCT product_id FROM tr), (SELECT unnest(range({4 * KS[-1]})) AS d)),
dr AS (SELECT sp.product_id, item, min(d) AS d FROM sp CROSS JOIN nb JOIN sz2 ON sz2.b = u % n JOIN pc ON pc.b = sz2.b AND place = (u // n) % size WHERE item <> sp.product_id GROUP BY 1, 2),
pl AS (SELECT product_id, item AS related_id, row_number() OVER (PARTITION BY product_id ORDER BY d) AS rank FROM dr), {_metrics_sql('(SELECT * FROM pl WHERE rank <= 20)', 'tr')}""",
)
def baseline_md5_random(spark, folder):
    """Products drawn by hash."""
    items = products(spark, folder).where("in_population").select(F.col("product_id").alias("related_id"))
    true = truth(spark, folder)
    return _metrics(K.hashed_lists(true, items, "product_id", "related_id", KS[-1], "random"), true)


_SPLIT = f"""{_TRUTH}, u AS (SELECT DISTINCT product_id, ('0x' || substr(md5('split' || product_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM tr),
sp AS (SELECT product_id, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS split FROM u), n(split) AS (VALUES ('train'), ('validation'), ('test'))"""


@R.query(
    "split_md5",
    f"{_TRUTH}, u AS (SELECT DISTINCT product_id, ('0x' || substr(md5('split' || product_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM tr) SELECT product_id, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS split FROM u",
)
def split_md5(spark, folder):
    """Queries in three disjoint splits, the same in every engine."""
    return K.hashed_split(truth(spark, folder), "product_id", {"train": 0.6, "validation": 0.2, "test": 0.2}, "split")


@R.query("split_overlap", f"{_SPLIT} SELECT a.split AS one, b.split AS other, count(*) FILTER (p.product_id IS NOT NULL AND q.product_id IS NOT NULL) AS n_shared FROM n a JOIN n b ON a.split < b.split CROSS JOIN (SELECT DISTINCT product_id FROM sp) i LEFT JOIN sp p ON p.product_id = i.product_id AND p.split = a.split LEFT JOIN sp q ON q.product_id = i.product_id AND q.split = b.split GROUP BY 1, 2")
def split_overlap(spark, folder):
    """No query is in two splits: three intersections that must be empty."""
    s = materialise(split_md5(spark, folder))
    pick = lambda n: s.where(F.col("split") == n).select("product_id")
    out = None
    for a, b in (("test", "train"), ("test", "validation"), ("train", "validation")):
        one = pick(a).intersect(pick(b)).agg(F.count(F.lit(1)).alias("n_shared")).select(F.lit(a).alias("one"), F.lit(b).alias("other"), "n_shared")
        out = one if out is None else out.unionByName(one)
    return out


#: The surveyed grids, and the configuration of each that is used untuned.
TIER_WEIGHTS = {"none": {}, "top_heavy": {"top": 1.5, "middle": 1.0, "base": 0.7, "flat": 1.0}}
TFIDF_GRID = tuple((sub, least, idf, tiers) for sub in (False, True) for least in (1, 5, 20) for idf in (False, True) for tiers in TIER_WEIGHTS)
SVD_GRID = tuple((size, shift) for size in (10, 25, 50, 100, 200) for shift in (0, 1, 2))
ALPHAS = tuple(i / 10 for i in range(1, 10))
UNTUNED = {"note_tfidf": TFIDF_GRID.index((False, 1, True, "none")), "note_svd": SVD_GRID.index((50, 0)), "hybrid": ALPHAS.index(0.5)}


def _held(spark, folder) -> tuple[DataFrame, DataFrame, list]:
    """Products with notes: product_id, and as arrays their notes' numbers, tier weights, accords' numbers and strengths; products and notes in rows; notes in order with their numbers of products."""
    rows = product_notes(spark, folder, ("tier",))
    heavy = F.create_map(*[F.lit(x) for kv in TIER_WEIGHTS["top_heavy"].items() for x in kv])
    rows = materialise(rows.groupBy("product_id", "note").agg(F.max(F.coalesce(F.try_element_at(heavy, F.col("tier")), F.lit(1.0))).alias("heavy")))
    seen = rows.groupBy("note").agg(F.count(F.lit(1)).alias("df")).orderBy("note").limit(C.LIMIT + 1).collect()
    at = spark.createDataFrame([(r["note"], i) for i, r in enumerate(seen)], "note string, idx int")
    lists = lambda df, *cs: df.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(*cs))).alias("_l")).select("product_id", *[F.col(f"_l.{c}").alias(c) for c in cs])
    notes = lists(dealt(rows, F.col("product_id")).join(small(at), "note"), "idx", "heavy")  # of the bounded vocabulary
    acc = materialise(accords(spark, folder).where("strength IS NOT NULL").groupBy("product_id", "accord").agg(F.max("strength").cast("double").alias("strength")))
    acc = lists(acc.join(small(materialise(_numbered(acc, "accord").withColumnRenamed("idx", "acc"))), "accord"), "acc", "strength")
    held = notes.join(acc, "product_id", "left")
    none = lambda c: F.coalesce(c, F.expr(f"CAST(array() AS {dict(held.dtypes)[c]})")).alias(c)
    return materialise(held.select("product_id", "idx", "heavy", none("acc"), none("strength"))), rows, seen


def _tfidf_vectors(sub: bool, least: int, idf: bool, tiers: str, df: np.ndarray, n: int):
    """Vectors of one configuration of TFIDF_GRID. Products whose notes are all too rare have empty ones, so that every configuration is asked the same queries."""
    kept, scale = df >= least, np.log((1.0 + n) / (1.0 + df)) + 1 if idf else np.ones(len(df))

    def build(lists):
        (size, at), tf = lists["idx"], lists["heavy"][1]
        tf = tf if tiers == "top_heavy" else np.ones(len(at))
        held = kept[at]
        row, at, tf = np.repeat(np.arange(len(size)), size)[held], at[held], tf[held]
        return np.ones(len(size), bool), V.sparse_unit(len(size), row, at, (1 + np.log(tf) if sub else tf) * scale[at])

    return build


def _svd_vectors(full, size: int):
    """Vectors of one configuration of SVD_GRID: means of the notes' vectors; full is broadcast."""

    def build(lists):
        n, at = lists["idx"]  # no product is without notes
        x = np.add.reduceat(full.value[at, :size], np.cumsum(n) - n, axis=0) / n[:, None] if len(n) else np.zeros((0, size))
        return np.ones(len(n), bool), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    return build


def _hybrid_vectors(alpha: float, notes):
    """Vectors of one of ALPHAS, of products that have accords: notes and accords side by side, as V.blend."""

    def build(lists):
        _, a = notes(lists)
        size, at = lists["acc"]
        b = V.sparse_unit(len(size), np.repeat(np.arange(len(size)), size), at, lists["strength"][1])
        return size > 0, V.Sparse(a.n, *[np.concatenate(x) for x in ((a.row, b.row), (a.col, b.col.astype(np.int64) + (1 << 24)), (a.val * alpha**0.5, b.val * (1 - alpha) ** 0.5))])

    return build


def _svd_of(pairs: DataFrame, names: list, shifts) -> dict[int, np.ndarray]:
    """The notes' vectors by shift. U S of fewer dimensions is the beginning of that of more."""
    return {shift: C.svd_embedding(C.square(A.ppmi(pairs, shift=shift), "a", "b", "ppmi", names), max(size for size, _ in SVD_GRID)) for shift in shifts}


def _svd_grid(spark, folder, picked) -> DataFrame:
    """config, product_id, idx, val for the picked numbers of SVD_GRID: means of the notes' vectors."""
    ship(spark)
    notes = materialise(product_notes(spark, folder))
    names = [r["note"] for r in notes.select("note").distinct().orderBy("note").limit(C.LIMIT + 1).collect()]
    found, grid = materialise(A.cooccurrence(notes, "product_id", "note")), {i: SVD_GRID[i] for i in picked}
    full = _svd_of(found, names, {s for _, s in grid.values()})
    at = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "note string, idx int")
    held = notes.join(small(at), "note").groupBy("product_id").agg(F.collect_list("idx").alias("_l"))
    kind = held.schema["product_id"].dataType.simpleString()

    def means(batches):
        for batch in batches:
            for config, (size, shift) in grid.items():
                x = np.array([full[shift][np.sort(l), :size].mean(0) for l in batch["_l"]]).reshape(len(batch), -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({"config": config, "product_id": batch["product_id"], "idx": [range(x.shape[1])] * len(x), "val": list(x)})

    return held.mapInPandas(means, f"config int, product_id {kind}, idx array<int>, val array<double>")


def _named(representation: str, config: int) -> str:
    if representation == "note_tfidf":
        return "sublinear={}, min_df={}, idf={}, tiers={}".format(*TFIDF_GRID[config])
    return "components={}, shift={}".format(*SVD_GRID[config]) if representation == "note_svd" else f"alpha={ALPHAS[config]}"


@R.query("grid_search")
def grid_search(spark, folder):
    """Every configuration of three representations on the validation queries; of each representation the best one and the untuned one on the test queries.

    place is the configuration's among those of its representation by precision at 10 on validation, equal ones in the order of the grid; gain is its precision
    at 10 less that of the untuned one on the same queries.
    """
    true = materialise(truth(spark, folder).join(split_md5(spark, folder), "product_id"))
    held, rows, seen = _held(spark, folder)
    grids = {"note_tfidf": TFIDF_GRID, "note_svd": SVD_GRID, "hybrid": ALPHAS}
    numbered = {(name, i): v for v, (name, i) in enumerate((name, i) for name, grid in grids.items() for i in range(len(grid)))}
    df = np.array([r["df"] for r in seen], float)
    n, n_accords = held.agg(F.count(F.lit(1)), F.count_if(F.size("acc") > 0)).first()
    lists_of = {"note_tfidf": n > 1, "note_svd": n > 1, "hybrid": n_accords > 1}  # else there is nothing to list
    names = [r["note"] for r in seen]
    full = _svd_of(materialise(A.cooccurrence(rows, "product_id", "note")), names, sorted({s for _, s in SVD_GRID})) if n > 1 else {}
    full = {shift: spark.sparkContext.broadcast(m) for shift, m in full.items()}
    notes = _tfidf_vectors(*TFIDF_GRID[UNTUNED["note_tfidf"]], df, n)

    def vectors(name: str, i: int):
        if name == "note_tfidf":
            return _tfidf_vectors(*TFIDF_GRID[i], df, n)
        return _svd_vectors(full[SVD_GRID[i][1]], SVD_GRID[i][0]) if name == "note_svd" else _hybrid_vectors(ALPHAS[i], notes)

    def alike(name: str, i: int) -> tuple:
        """What the vectors depend on: without tier weights 1 + ln(1) is 1, and bounds below the rarest note leave nothing out."""
        if name != "note_tfidf":
            return name, i
        sub, least, idf, tiers = TFIDF_GRID[i]
        return name, sub and tiers != "none", tuple(np.flatnonzero(df < least)), idf, tiers

    def measured(picked: list, split: str) -> list:
        picked = [x for x in picked if lists_of[x[0]]]
        if not picked:
            return []
        firsts = {}
        for x in picked:
            firsts.setdefault(alike(*x), []).append(numbered[x])
        asked = true.where(F.col("split") == split).select("product_id", "related_id")
        variants = {numbered[x]: vectors(*x) for x in picked if numbered[x] == firsts[alike(*x)][0]}
        found = V.places(asked, held, "product_id", "related_id", "product_id", KS[-1], variants)
        same = spark.createDataFrame([(vs[0], v) for vs in firsts.values() for v in vs], "variant int, config int")  # configurations, few
        found = found.join(F.broadcast(same), "variant").select("config", F.col("query").alias("product_id"), F.col("item").alias("related_id"), "rank")
        # a row that hits nothing stands for the list of each query
        tried = F.filter(F.array(*[F.struct(F.lit(numbered[x]).alias("c"), F.lit(x[0] == "hybrid").alias("a")) for x in picked]), lambda x: ~x["a"] | (F.size("acc") > 0))
        lists = held.join(small(materialise(asked.select("product_id").distinct())), "product_id").select(F.explode(tried).alias("c"), "product_id")
        lists = lists.select("c.c", "product_id", F.lit(None).cast(dict(true.dtypes)["related_id"]).alias("related_id"), F.lit(None).cast("int").alias("rank")).withColumnRenamed("c", "config")
        return _rounded(K.ranking_metrics(materialise(lists.unionByName(found)), true, "product_id", "related_id", "rank", KS, by=["config"])).collect()  # configurations, few

    columns, out = None, []
    by_number = {v: x for x, v in numbered.items()}
    all_tried = sorted(measured(list(numbered), "validation"), key=lambda r: (-r["precision_10"], r["config"]))
    tried_of = {name: [r for r in all_tried if by_number[r["config"]][0] == name] for name in grids}
    picked = [x for name, rs in tried_of.items() if rs for x in sorted({by_number[rs[0]["config"]], (name, UNTUNED[name])})]
    all_tested = sorted(measured(picked, "test"), key=lambda r: r["config"])
    for name, tried in tried_of.items():
        place = {r["config"]: i for i, r in enumerate(tried, 1)}
        for split, found in (("validation", tried), ("test", [r for r in all_tested if by_number[r["config"]][0] == name])):
            untuned = next((r["precision_10"] for r in found if r["config"] == numbered[name, UNTUNED[name]]), None)
            for r in found:
                columns = [c for c in r.asDict() if c != "config"]
                gain = None if untuned is None else round(r["precision_10"] - untuned, 6)
                out.append((name, _named(*by_number[r["config"]]), split, place[r["config"]], r["config"] == numbered[name, UNTUNED[name]], gain, *[r[c] for c in columns]))
    columns = columns or ["n_evaluated", *[f"{m}_{k}" for k in KS for m in ("precision", "recall", "mrr", "hit")]]
    return spark.createDataFrame(out, "representation string, config string, split string, place int, untuned boolean, gain double, " + ", ".join(f"{c} {'bigint' if c == 'n_evaluated' else 'double'}" for c in columns))


_ALL = " UNION ALL ".join(f"SELECT '{n}' AS algorithm, * FROM ({R.sql[q]})" for n, q in (("stored", "rank_metrics"), ("popularity", "baseline_popularity"), ("same_brand", "baseline_same_brand")))


@R.query(
    "best_per_metric",
    f"""WITH al AS ({_ALL}), lo AS ({" UNION ALL ".join(f"SELECT algorithm, '{c}' AS metric, {c} AS value FROM al" for c in _CELLS)}),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, algorithm) AS k FROM lo) WHERE k = 1),
wi AS (SELECT a.algorithm, count(*) AS n FROM al a JOIN al b ON {" AND ".join(f"a.{c} > b.{c}" for c in _CELLS)} GROUP BY 1)
SELECT metric, algorithm, value, coalesce(n, 0)::BIGINT AS n_beaten FROM be LEFT JOIN wi USING (algorithm)""",
)
def best_per_metric(spark, folder):
    """Which list is best in each metric, and who beats whom in all of them."""
    named = lambda df, n: df.withColumn("algorithm", F.lit(n))
    rows = named(rank_metrics(spark, folder), "stored").unionByName(named(baseline_popularity(spark, folder), "popularity")).unionByName(named(baseline_same_brand(spark, folder), "same_brand"))
    rows = materialise(rows)
    metrics = [c for c in rows.columns if c not in ("algorithm", "n_evaluated")]
    long = rows.unpivot(["algorithm"], metrics, "metric", "value")
    best = K.top_per_group(long, ["metric"], [F.desc("value"), F.asc("algorithm")], 1).select("metric", "algorithm", "value")
    beaten = K.dominates(rows, "algorithm", metrics).groupBy(F.col("better").alias("algorithm")).agg(F.count(F.lit(1)).alias("n_beaten"))
    return best.join(beaten, "algorithm", "left").na.fill(0, ["n_beaten"])
