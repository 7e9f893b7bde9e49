"""Token resolution, clusterings and their validity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import token
from millrace.operators import association as A
from millrace.operators import cluster as C
from millrace.operators import resolve as E
from millrace.operators import vectors as V
from millrace.plans import Registry, table
from millrace.plans.catalogue import _TYPED, NOTES, PLACEHOLDERS, product_notes
from millrace.plans.similarity import _PPMI, counts, ppmi
from millrace.runtime import materialise, scratch
from millrace.sources import cached_vectors

R = Registry()

# --- resolution ---

_TOK = f"{_TYPED}, tok AS (SELECT raw_token AS t FROM typed WHERE raw_token <> '' GROUP BY 1 HAVING count(DISTINCT product_id) >= 3)"


def typed(spark, folder) -> DataFrame:
    return table(spark, folder, "notes_long").where("product_id IS NOT NULL").select("product_id", token(F.col("note_raw")).alias("t")).where("t <> ''")


def tokens(spark, folder) -> DataFrame:
    """Tokens of at least three products."""
    return typed(spark, folder).groupBy("t").agg(F.countDistinct("product_id").alias("n")).where("n >= 3").select("t")


_ORDERED = "CASE WHEN length(a.t) < length(b.t) OR (length(a.t) = length(b.t) AND a.t < b.t) THEN a.t ELSE b.t END AS short, CASE WHEN length(a.t) < length(b.t) OR (length(a.t) = length(b.t) AND a.t < b.t) THEN b.t ELSE a.t END AS long"


@R.query("prefix_block_pairs", f"WITH {_TOK} SELECT DISTINCT {_ORDERED} FROM tok a JOIN tok b ON substr(a.t, 1, 3) = substr(b.t, 1, 3) AND a.t <> b.t AND contains(b.t, a.t) WHERE length(a.t) >= 3")
def prefix_block_pairs(spark, folder):
    """Tokens of equal beginning of which one contains the other."""
    return E.prefix_pairs(tokens(spark, folder), "t")


@R.query(
    "compound_evidence",
    f"""WITH {_TOK}, p AS (SELECT DISTINCT {_ORDERED} FROM tok a JOIN tok b ON substr(a.t, 1, 3) = substr(b.t, 1, 3) AND a.t <> b.t AND contains(b.t, a.t) WHERE length(a.t) >= 3),
r AS (SELECT short, long, trim(substr(long, 1, instr(long, short) - 1) || substr(long, instr(long, short) + length(short)), ' ') AS remainder FROM p)
SELECT short, long, remainder, (length(short) >= 5 AND length(short)::DOUBLE / length(long) >= 0.5 AND length(remainder) >= 2 AND remainder NOT IN (SELECT t FROM tok)) AS merges FROM r""",
)
def compound_evidence(spark, folder):
    """Which of those mean the same."""
    t = tokens(spark, folder)
    return E.compound_evidence(E.prefix_pairs(t, "t"), t, "t")


@R.query("levenshtein_pairs")
def levenshtein_pairs(spark, folder):
    """Tokens at most two edits apart, of equal first letter and near lengths."""
    return E.banded_pairs(tokens(spark, folder), "t").where("distance <= 2")


@R.query("word_pairs", f"WITH {_TOK}, w AS (SELECT DISTINCT t AS phrase, unnest(string_split(t, ' ')) AS word FROM tok) SELECT word, phrase FROM w JOIN tok ON tok.t = word WHERE word <> phrase")
def word_pairs(spark, folder):
    """Tokens that are a word of another."""
    return E.word_pairs(tokens(spark, folder), "t")


@R.query("fuzzy_ratio_pairs")
def fuzzy_ratio_pairs(spark, folder):
    """Tokens of like sequence, to merge or to review."""
    return E.fuzzy_pairs(tokens(spark, folder), "t").withColumn("ratio", F.round("ratio", 6))


@R.query(
    "components",
    f"""WITH RECURSIVE {_TOK}, e AS (SELECT a.t AS x, b.t AS y FROM tok a JOIN tok b ON substr(a.t, 1, 3) = substr(b.t, 1, 3) AND a.t <> b.t AND (contains(b.t, a.t) OR contains(a.t, b.t)) WHERE length(a.t) >= 3 AND length(b.t) >= 3),
r AS (SELECT x AS node, x AS low FROM e UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.node) SELECT node, min(low) AS component FROM r GROUP BY 1""",
)
def components(spark, folder):
    """Groups of tokens joined by those pairs."""
    return E.components(prefix_block_pairs(spark, folder), "short", "long")


@R.query("resolved_tokens")
def resolved_tokens(spark, folder):
    """Every token with its canonical form, what was decided and why, and the pairs to look at."""
    t = materialise(tokens(spark, folder))
    like, parts = materialise(E.fuzzy_pairs(t, "t")), materialise(E.compound_evidence(E.prefix_pairs(t, "t"), t, "t"))
    because = lambda df, reason, ratio=F.lit(None).cast("double"): df.select("short", "long", F.lit(reason).alias("reason"), ratio.alias("ratio"))
    named = table(spark, folder, "notes_long").where("product_id IS NOT NULL").select("note_raw").distinct()
    merges = because(E.gloss_pairs(named, "note_raw"), "bracketed gloss").unionByName(because(parts.where("merges"), "compound")).unionByName(because(like.where("merges"), "like spelling"))
    words = E.word_pairs(t, "t").where(F.length("word") >= 3).select(F.col("word").alias("short"), F.col("phrase").alias("long"))
    review = because(words, "whole word").unionByName(because(parts.where("NOT merges AND length(short) >= 5"), "containment")).unionByName(because(like.where("NOT merges"), "like spelling", F.round("ratio", 6)))
    return E.resolve(typed(spark, folder), "t", "product_id", merges, PLACEHOLDERS, rare=30, review=review)


# --- labelings ---

_LAB = "lab AS (SELECT canonical_note AS note, cluster, substr(canonical_note, 1, 1) AS label FROM taxonomy_map)"


def labelled(spark, folder) -> DataFrame:
    """Notes with their family and a second, fixed labeling: their first letter."""
    return table(spark, folder, "taxonomy_map").select(F.col("canonical_note").alias("note"), "cluster", F.substring("canonical_note", 1, 1).alias("label"))


_ARI = """c AS (SELECT cluster, label, count(*)::DOUBLE AS n FROM lab GROUP BY 1, 2), ij AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n) AS t FROM c),
i AS (SELECT sum(s * (s - 1) / 2) AS v FROM (SELECT sum(n) AS s FROM c GROUP BY cluster)), k AS (SELECT sum(s * (s - 1) / 2) AS v FROM (SELECT sum(n) AS s FROM c GROUP BY label))"""


@R.query("ari", f"WITH {_LAB}, {_ARI} SELECT round((ij.v - i.v * k.v / (t * (t - 1) / 2)) / ((i.v + k.v) / 2 - i.v * k.v / (t * (t - 1) / 2)), 6) AS ari FROM ij, i, k")
def ari(spark, folder):
    """Adjusted Rand index."""
    return C.adjusted_rand(labelled(spark, folder), "cluster", "label").withColumn("ari", F.round("ari", 6))


@R.query(
    "mutual_information",
    f"WITH {_LAB}, c AS (SELECT cluster, label, count(*)::DOUBLE AS n FROM lab GROUP BY 1, 2), w AS (SELECT n, sum(n) OVER (PARTITION BY cluster) AS a, sum(n) OVER (PARTITION BY label) AS b, sum(n) OVER () AS t FROM c) SELECT round(sum(n / t * ln(n * t / (a * b))), 6) AS mi, round(-sum(n / t * ln(a / t)), 6) AS entropy_a, round(-sum(n / t * ln(b / t)), 6) AS entropy_b FROM w",
)
def mutual_information(spark, folder):
    """Mutual information and entropies."""
    row = C.mutual_information(labelled(spark, folder), "cluster", "label")
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@R.query("ami_counts", f"WITH {_LAB}, c AS (SELECT cluster, label, count(*) AS n FROM lab GROUP BY 1, 2) SELECT count(*) AS n_cells, sum(n)::BIGINT AS n_rows, count(DISTINCT cluster) AS n_a, count(DISTINCT label) AS n_b, sum(n * n)::BIGINT AS squares FROM c")
def ami_counts(spark, folder):
    """What the adjusted index is worked out from: the contingency table's size and sums."""
    c = labelled(spark, folder).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_rows"), F.countDistinct("cluster").alias("n_a"), F.countDistinct("label").alias("n_b"), F.sum(F.col("n") * F.col("n")).alias("squares"))


@R.query("ami")
def ami(spark, folder):
    """Adjusted mutual information."""
    return spark.createDataFrame([(C.adjusted_mutual_information(labelled(spark, folder), "cluster", "label"),)], "ami double")


@R.query("crosstab", f"WITH {_LAB} SELECT cluster, label, count(*) AS n FROM lab GROUP BY 1, 2")
def crosstab(spark, folder):
    """How two labelings meet."""
    return labelled(spark, folder).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))


_PURE = f"WITH {_LAB}, c AS (SELECT cluster, label, count(*) AS n FROM lab GROUP BY 1, 2), p AS (SELECT cluster, label AS mode, sum(n) OVER (PARTITION BY cluster)::BIGINT AS size, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS k FROM c)"


@R.query("purity", f"{_PURE} SELECT cluster, mode, size, round(n::DOUBLE / size, 6) AS purity FROM p WHERE k = 1")
def purity(spark, folder):
    """Most frequent label of each family and its share."""
    return A.purity(labelled(spark, folder), "cluster", "label").withColumn("purity", F.round("purity", 6))


@R.query("weighted_purity", f"{_PURE} SELECT round(sum(n)::DOUBLE / sum(size), 6) AS purity FROM p WHERE k = 1")
def weighted_purity(spark, folder):
    """Purity of all families by size."""
    return A.purity(labelled(spark, folder), "cluster", "label").agg(F.round(A.overall(), 6).alias("purity"))


_EMB = "u AS (SELECT vec_id, label, unnest(range(len(embedding))) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, p, count(*)::DOUBLE AS n, avg(x) AS m FROM u GROUP BY 1, 2)"


@R.query(
    "calinski_harabasz",
    f"WITH {_EMB}, g AS (SELECT p, avg(x) AS g FROM u GROUP BY 1), b AS (SELECT sum(n * (m - g) ** 2) AS b FROM m JOIN g USING (p)), w AS (SELECT sum((x - m) ** 2) AS w FROM u JOIN m USING (label, p)), s AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings) SELECT round(b * (s.n - s.k) / (w * (s.k - 1)), 4) AS calinski_harabasz FROM b, w, s",
)
def calinski_harabasz(spark, folder):
    """Spread between labels over that within."""
    return C.calinski_harabasz(table(spark, folder, "embeddings"), "vec_id", "label", "embedding").withColumn("calinski_harabasz", F.round("calinski_harabasz", 4))


@R.query(
    "davies_bouldin",
    f"WITH {_EMB}, d AS (SELECT vec_id, label, sqrt(sum((x - m) ** 2)) AS d FROM u JOIN m USING (label, p) GROUP BY 1, 2), s AS (SELECT label, avg(d) AS s FROM d GROUP BY 1), g AS (SELECT a.label, b.label AS o, sqrt(sum((a.m - b.m) ** 2)) AS gap FROM m a JOIN m b ON a.p = b.p AND a.label <> b.label GROUP BY 1, 2) SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT g.label, max((x.s + y.s) / gap) AS w FROM g JOIN s x ON x.label = g.label JOIN s y ON y.label = g.o GROUP BY 1)",
)
def davies_bouldin(spark, folder):
    """Mean of each label's worst neighbour."""
    return C.davies_bouldin(table(spark, folder, "embeddings"), "vec_id", "label", "embedding").withColumn("davies_bouldin", F.round("davies_bouldin", 6))


@R.query(
    "silhouette_centres",
    f"WITH {_EMB}, d AS (SELECT u.vec_id, u.label, m.label AS c, sqrt(sum((x - m) ** 2)) AS d FROM u JOIN m USING (p) GROUP BY 1, 2, 3), e AS (SELECT vec_id, min(d) FILTER (label = c) AS a, min(d) FILTER (label <> c) AS b FROM d GROUP BY 1) SELECT round(avg((b - a) / nullif(greatest(a, b), 0)), 6) AS silhouette FROM e",
)
def silhouette_centres(spark, folder):
    """Silhouette by distances to centres."""
    return C.silhouette_centres(table(spark, folder, "embeddings"), "vec_id", "label", "embedding").withColumn("silhouette", F.round("silhouette", 6))


@R.query(
    "modularity",
    f"WITH {_PPMI}, ed AS (SELECT a, b, ppmi AS w FROM pp WHERE ppmi >= 1), {_LAB}, e AS (SELECT w, x.cluster AS x, y.cluster AS y FROM ed JOIN lab x ON x.note = a JOIN lab y ON y.note = b), dg AS (SELECT l, sum(w) AS deg FROM (SELECT x AS l, w FROM e UNION ALL SELECT y, w FROM e) GROUP BY 1), s AS (SELECT sum(CASE WHEN x = y THEN w ELSE 0 END) AS i, sum(w) AS m FROM e) SELECT round(i / m - (SELECT sum(deg * deg) FROM dg) / (4 * m * m), 6) AS modularity FROM s",
)
def modularity(spark, folder):
    """Modularity of the families on the graph of strong associations."""
    strong = A.ppmi(counts(spark, folder)).where("ppmi >= 1")
    row = C.modularity(strong, labelled(spark, folder), "a", "b", "ppmi", "note", "cluster")
    return row.withColumn("modularity", F.round("modularity", 6))


@R.query(
    "graph_stats",
    f"WITH {_PPMI}, ed AS (SELECT a, b FROM pp WHERE ppmi >= 1), n AS (SELECT count(*) AS n FROM taxonomy_map), e AS (SELECT count(*) AS e FROM ed), i AS (SELECT count(*) AS i FROM taxonomy_map WHERE canonical_note NOT IN (SELECT a FROM ed UNION SELECT b FROM ed)) SELECT n AS n_nodes, e AS n_edges, round(2.0::DOUBLE * e / (n * (n - 1)), 6) AS density, i AS n_isolated FROM n, e, i",
)
def graph_stats(spark, folder):
    """Size and density of that graph."""
    strong = A.ppmi(counts(spark, folder)).where("ppmi >= 1")
    return C.graph_stats(strong, labelled(spark, folder), "a", "b", "note").withColumn("density", F.round("density", 6))


# --- fitted models: rows and invariants ---


def _embedded(spark, folder) -> tuple[list, np.ndarray]:
    """Notes and their 50 dimensions from the association matrix, of bounded vocabulary."""
    names = [r["note"] for r in product_notes(spark, folder).select("note").distinct().orderBy("note").limit(C.LIMIT + 1).collect()]
    # one table of vectors for all queries of the session; it is only taken if it is of this very vocabulary
    inputs = [f"{folder}/{t}.parquet" for t in ("notes_long", "note_normalisation")]
    return names, cached_vectors(spark, f"{scratch(spark)}/millrace/note_vectors", names, inputs, lambda: C.svd_embedding(C.square(ppmi(spark, folder), "a", "b", "ppmi", names), 50))


@R.query("svd_embedding")
def svd_embedding(spark, folder):
    """Note vectors."""
    names, points = _embedded(spark, folder)
    return spark.createDataFrame([(n, p.tolist()) for n, p in zip(names, points, strict=True)], "note string, vector array<double>")


@R.query("cosine_partners")
def cosine_partners(spark, folder):
    """Ten notes of nearest vectors to each note."""
    rows = materialise(V.from_dense(svd_embedding(spark, folder), "note", "vector"))
    return V.top_k(rows, rows, "note", 10)


@R.query("kmeans_families")
def kmeans_families(spark, folder):
    """Families of the note vectors."""
    return C.kmeans(svd_embedding(spark, folder), "vector", 15).select("note", "cluster")


@R.query("kmeans_sweep")
def kmeans_sweep(spark, folder, ks=range(2, 31), starts: int = 10):
    """Cost, validity and sizes by number of families, of the best of several starts, with the knee of the cost."""
    _, points = _embedded(spark, folder)
    rows = [{"k": k} | C.validity(points, C.lloyd(points, k, runs=starts)) for k in ks if k < len(points)]
    at = C.knee([r["k"] for r in rows], [r["cost"] for r in rows]) if len(rows) > 1 else None
    schema = "k int, cost double, silhouette double, calinski_harabasz double, davies_bouldin double, mean_size double, largest int, n_singletons int, knee boolean"
    return spark.createDataFrame([(*r.values(), r["k"] == at) for r in rows], schema)


@R.query("gmm_bic")
def gmm_bic(spark, folder, ks=range(2, 31)):
    """Mixtures of the whole embeddings, with full and with diagonal covariances, by BIC."""
    return spark.createDataFrame(C.gmm_bic(table(spark, folder, "embeddings"), "embedding", ks), "covariance string, k int, log_likelihood double, bic double")


@R.query("product_sentences", f"WITH {NOTES} SELECT product_id, count(*) AS n_words, string_agg(note, ' | ' ORDER BY note) AS sentence FROM pn GROUP BY 1")
def product_sentences(spark, folder):
    """The notes of each product in order, as the skip-gram reads them."""
    said = product_notes(spark, folder).groupBy("product_id").agg(F.array_sort(F.collect_list("note")).alias("words"))
    return said.select("product_id", F.size("words").cast("bigint").alias("n_words"), F.array_join("words", " | ").alias("sentence"))


@R.query("word_vectors")
def word_vectors(spark, folder):
    """Skip-gram vectors of notes, whole products as sentences."""
    said = product_notes(spark, folder).groupBy("product_id").agg(F.array_sort(F.collect_list("note")).alias("words"))
    return C.word_vectors(said, "words", 50, 30)


@R.query("alternative_clusterings")
def alternative_clusterings(spark, folder):
    """Other algorithms over the note vectors, each with its agreement with k-means."""
    names, points = _embedded(spark, folder)
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    euclid = np.sqrt(np.maximum(0, (points**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * points @ points.T))
    cosine = np.maximum(0, 1 - unit @ unit.T)
    plane = np.sqrt(((points[:, None, :2] - points[None, :, :2]) ** 2).sum(2))  # the two strongest dimensions
    base = C.lloyd(points, 15)
    affinity = np.maximum(0, unit @ unit.T)
    others = {
        "ward": C.cut(C.linkage(euclid, "ward"), 15), "cosine_average": C.cut(C.linkage(cosine, "average"), 15), "complete": C.cut(C.linkage(euclid, "complete"), 15), "single": C.cut(C.linkage(euclid, "single"), 15),
        "spectral": C.spectral(affinity, 15), "gmm_diagonal": C.diagonal_gmm(points, 15)[0], "som": C.self_organising_map(points, 6, 6)[0],
        "louvain": C.louvain(C.square(A.ppmi(counts(spark, folder)).where("ppmi >= 1"), "a", "b", "ppmi", names)), **{f"density_{n}": C.density_clusters(euclid, n) for n in (5, 10, 20)},
        **{f"plane_density_{n}": C.density_clusters(plane, n) for n in (5, 10, 20)},
    }
    rows = [(n, a, int(b), int(x)) for a, labels in others.items() for n, b, x in zip(names, base, labels, strict=True)]
    long = spark.createDataFrame(rows, "note string, algorithm string, kmeans int, label int")
    out = None
    for a in others:
        one = C.adjusted_rand(long.where(F.col("algorithm") == a), "kmeans", "label").withColumn("algorithm", F.lit(a))
        out = one if out is None else out.unionByName(one)
    sizes = long.groupBy("algorithm", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("algorithm").agg(F.count(F.lit(1)).alias("n_clusters"), (F.max("n") / F.sum("n")).alias("largest_share"))
    return out.join(sizes, "algorithm").withColumn("degenerate", F.col("largest_share") >= 0.8)


@R.query("som_map")
def som_map(spark, folder):
    """Each cell of a self-organising map of the notes: its notes, its mean distance to the cells beside it, and the map's quantisation error."""
    names, points = _embedded(spark, folder)
    side = 6
    cells, ridges, error = C.self_organising_map(points, side, side)
    held = np.bincount(cells, minlength=side * side)
    return spark.createDataFrame([(i // side, i % side, int(held[i]), float(ridges[i]), error) for i in range(side * side)], "row int, col int, n_notes int, ridge double, quantisation_error double")


@R.query("family_nesting")
def family_nesting(spark, folder):
    """Whether families lie within the five groups of the best linkage: each family's main group and purity; degenerate where one group holds four fifths."""
    names, points = _embedded(spark, folder)
    d = np.sqrt(np.maximum(0, (points**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * points @ points.T))
    trees = {m: C.linkage(d, m) for m in ("single", "complete", "average", "ward")}
    best = max(trees, key=lambda m: C.cophenetic(trees[m], d))
    groups = C.cut(trees[best], 5)
    flat = bool(np.bincount(groups).max() >= 0.8 * len(groups))
    rows = spark.createDataFrame([(int(f), int(g)) for f, g in zip(C.lloyd(points, 15), groups, strict=True)], "family int, super_group int")
    return A.purity(rows, "family", "super_group").select("family", F.col("mode").alias("super_group"), F.col("size").alias("n_notes"), "purity", F.lit(best).alias("linkage"), F.lit(flat).alias("degenerate"))


@R.query("bootstrap_stability")
def bootstrap_stability(spark, folder, runs: int = 20, ks=(8, 10, 12, 15, 18, 20, 25), dimensions: int = 50):
    """Agreement of families over resampled products for each k: each product counts as often as drawn, once on the pair."""
    notes = product_notes(spark, folder)
    # a Poisson draw by hash for each product and run, so that any task draws the same: the number of values of its distribution function below a fraction of 2^-30 steps
    u = lambda b: (F.pmod(F.xxhash64(F.lit(b), "product_id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    upto = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)]).tolist()  # the last is above every fraction
    sets = notes.groupBy("product_id").agg(F.array_sort(F.collect_set("note")).alias("_l"))
    weights = sets.select("_l", F.transform(F.array(*[u(b) for b in range(runs)]), lambda x: F.size(F.filter(F.lit(upto), lambda p: p <= x))).alias("_w"))
    pairs = weights.select(F.posexplode("_l").alias("_p", "a"), "_l", "_w").select("a", F.explode(F.slice("_l", F.col("_p") + 2, F.size("_l"))).alias("b"), "_w")
    counted = materialise(pairs.groupBy("a", "b").agg(*[F.sum(F.col("_w")[i]).alias(f"n{i}") for i in range(runs)]))
    names = [r["note"] for r in notes.select("note").distinct().orderBy("note").limit(C.LIMIT + 1).collect()]
    labels = {k: [] for k in ks if k <= len(names)}
    for i in range(runs):
        m = C.square(A.ppmi(counted.select("a", "b", F.col(f"n{i}").alias("n")).where("n > 0")), "a", "b", "ppmi", names)
        points = C.svd_embedding(m, dimensions)
        for k, found in labels.items():
            found.append(C.lloyd(points, k))
    rows = []
    for k, found in labels.items():
        aris = [C.rand_of(found[i], found[j]) for i in range(runs) for j in range(i + 1, runs)]
        rows.append((k, float(np.mean(aris)), float(np.std(aris)), len(aris)))
    return spark.createDataFrame(rows, "k int, mean_ari double, std_ari double, n_pairs int")


@R.query("hierarchy")
def hierarchy(spark, folder):
    """Cuts of four linkages with their cophenetic correlation and purity."""
    names, points = _embedded(spark, folder)
    d = np.sqrt(np.maximum(0, (points**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * points @ points.T))
    rows = []
    for method in ("single", "complete", "average", "ward"):
        merges = C.linkage(d, method)
        fit = C.cophenetic(merges, d)
        for k in (5, 8, 15, 25):
            labels = C.cut(merges, k)
            rows.append((method, k, fit, float(np.bincount(labels).max() / len(labels)), C.silhouette_exact(points, labels)))
    return spark.createDataFrame(rows, "method string, k int, cophenetic double, largest_share double, silhouette double")
