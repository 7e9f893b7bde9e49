"""Clusterings and how good they are.

The first part works on tables of any size. The second is for matrices of a vocabulary, bounded by LIMIT rows, on the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import materialise, ship

#: Rows of a matrix that may go to the driver.
LIMIT = 5_000
#: Cells of a contingency table that may go to the driver.
CELLS = 1_000_000


def kmeans(df: DataFrame, vector: str, k: int, seeds: Sequence[int] = range(10)) -> DataFrame:
    """Adds cluster: of one run a seed, the one of least cost."""
    rows = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    models = [KMeans(k=k, seed=s, featuresCol="_v", predictionCol="cluster").fit(rows) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(rows).drop("_v")
    return out


def gmm_bic(df: DataFrame, vector: str, ks: Sequence[int], kinds: Sequence[str] = ("full", "diag"), seed: int = 42, rounds: int = 100, tolerance: float = 1e-3, floor: float = 1e-6) -> list[tuple[str, int, float, float]]:
    """kind, k, log-likelihood and BIC of Gaussian mixtures with full and with diagonal covariances, over all rows and all dimensions.

    EM of all mixtures at once: each round is one pass that adds up every mixture's sums, in tasks, or for at most LIMIT rows on the driver. A mixture
    rests when its mean log-likelihood grows by less than tolerance. Starts are k-means labels of at most LIMIT rows chosen by hash; floor is added to
    variances, so components of fewer rows than dimensions stay finite. Rows without a vector don't count; ks above the number of rows are left out.
    """
    rows = df.select(F.transform(vector, lambda x: x.cast("double")).alias("_v")).where("_v IS NOT NULL")
    rows = materialise(rows)
    n = rows.count()
    start = np.array([r[0] for r in rows.orderBy(F.xxhash64(F.lit(seed), "_v"), "_v").limit(LIMIT).collect()], float)
    models = {}
    for k in (k for k in ks if k <= len(start)):
        r = np.eye(k)[lloyd(start, k, seed, 1)]
        for kind in kinds:
            models[kind, k] = _gaussians(kind, *_moments(kind, start, r), floor)
    out, last, moving = {}, {}, set(models)
    for step in range(rounds + 1):  # the last pass only measures
        at = {m: models[m] for m in moving}

        def sums(x: np.ndarray, at=at) -> dict:
            found = {}
            for (kind, k), model in at.items():
                logs = _log_densities(kind, x, model)
                top = logs.max(1, keepdims=True)
                total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
                found[kind, k] = (total.sum(), *_moments(kind, x, np.exp(logs - total[:, None])))
            return found

        if n <= LIMIT:
            parts = [sums(start)]
        else:
            ship(df.sparkSession)

            def task(batches, sums=sums):
                for batch in batches:
                    yield pd.DataFrame({"part": [pickle.dumps(sums(np.array(batch["_v"].tolist(), float)))]})

            parts = (pickle.loads(r[0]) for r in rows.mapInPandas(task, "part binary").toLocalIterator())
        whole = {}
        for part in parts:
            for m, values in part.items():
                whole[m] = [a + b for a, b in zip(whole[m], values, strict=True)] if m in whole else list(values)
        for (kind, k), (ll, *moments) in whole.items():
            m = (kind, k)
            out[m] = float(ll)
            if m in last and (ll - last[m]) / n < tolerance or step == rounds:
                moving.discard(m)
            else:
                last[m], models[m] = ll, _gaussians(kind, *moments, floor)
        if not moving:
            break
    d = start.shape[1] if len(start) else 0
    free = {"full": lambda k: k - 1 + k * d + k * d * (d + 1) // 2, "diag": lambda k: k - 1 + 2 * k * d}
    return [(kind, k, ll, -2 * ll + free[kind](k) * float(np.log(n))) for (kind, k), ll in sorted(out.items())]


def _moments(kind: str, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masses, sums and sums of squares (diag) or of products (full) of each component."""
    squares = r.T @ x**2 if kind == "diag" else np.stack([(x * c[:, None]).T @ x for c in r.T])
    return r.sum(0), r.T @ x, squares


def _gaussians(kind: str, mass: np.ndarray, total: np.ndarray, squares: np.ndarray, floor: float) -> tuple:
    """Log weights, means, inverse factors of the covariances, and half the log determinants of their inverses."""
    safe = mass + 1e-10
    mean = total / safe[:, None]
    if kind == "diag":
        scale = 1 / np.sqrt(np.maximum(squares / safe[:, None] - mean**2, 0) + floor)
        return np.log(safe / safe.sum()), mean, scale, np.log(scale).sum(1)
    # through eigenvalues, kept at the floor or above: sums less squares of means may fall below 0 by rounding
    values, vectors = np.linalg.eigh(squares / safe[:, None, None] - mean[:, :, None] * mean[:, None])
    scale = 1 / np.sqrt(np.maximum(values, 0) + floor)
    return np.log(safe / safe.sum()), mean, vectors * scale[:, None], np.log(scale).sum(1)


def _log_densities(kind: str, x: np.ndarray, model: tuple) -> np.ndarray:
    weights, mean, scale, half = model
    if kind == "diag":
        p = scale**2
        apart = x**2 @ p.T - 2 * x @ (mean * p).T + (mean**2 * p).sum(1)
    else:
        apart = np.stack([(((x - m) @ f) ** 2).sum(1) for m, f in zip(mean, scale, strict=True)], 1)
    return weights + half - 0.5 * (x.shape[1] * np.log(2 * np.pi) + apart)


def word_vectors(sentences: DataFrame, words: str, size: int, least: int, window: int = 999, seed: int = 42) -> DataFrame:
    """word, vector by skip-gram over whole records."""
    model = Word2Vec(vectorSize=size, minCount=least, windowSize=window, seed=seed, inputCol=words, outputCol="_v", maxSentenceLength=100_000).fit(sentences)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings of the same rows, from their contingency counts."""
    two = lambda c: c * (c - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    pair = cells.agg(F.sum(two(F.col("_n"))).alias("_ij"), F.sum("_n").alias("_all"))
    left = cells.groupBy(a).agg(F.sum("_n").alias("_s")).agg(F.sum(two(F.col("_s"))).alias("_i"))
    right = cells.groupBy(b).agg(F.sum("_n").alias("_s")).agg(F.sum(two(F.col("_s"))).alias("_j"))
    row = pair.crossJoin(left).crossJoin(right)  # one row each
    expected = F.col("_i") * F.col("_j") / two(F.col("_all"))
    return row.select(F.coalesce(F.try_divide(F.col("_ij") - expected, (F.col("_i") + F.col("_j")) / 2 - expected), F.lit(1.0)).alias("ari"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two labelings and their entropies, natural logarithm."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    whole = F.sum("_n").over(Window.partitionBy())
    cells = cells.select(a, b, "_n", F.sum("_n").over(Window.partitionBy(a)).alias("_a"), F.sum("_n").over(Window.partitionBy(b)).alias("_b"), whole.alias("_t"))  # labels, few
    return cells.agg(
        F.sum(F.col("_n") / F.col("_t") * F.log(F.col("_n") * F.col("_t") / (F.col("_a") * F.col("_b")))).alias("mi"),
        (-F.sum(F.col("_n") / F.col("_t") * F.log(F.col("_a") / F.col("_t")))).alias("entropy_a"),
        (-F.sum(F.col("_n") / F.col("_t") * F.log(F.col("_b") / F.col("_t")))).alias("entropy_b"),
    )


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> float:
    """Mutual information less what chance gives, over the mean entropy less that. Works on the contingency table of labels; refuses more than CELLS cells."""
    from math import lgamma

    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).limit(CELLS + 1).collect()
    if len(cells) > CELLS:
        raise ValueError(f"more than {CELLS} cells")
    left, right = {}, {}
    for r in cells:
        left[r[0]] = left.get(r[0], 0) + r["n"]
        right[r[1]] = right.get(r[1], 0) + r["n"]
    n = sum(left.values())
    mi = sum(r["n"] / n * np.log(n * r["n"] / (left[r[0]] * right[r[1]])) for r in cells)
    emi = 0.0
    for x in left.values():
        for y in right.values():
            for m in range(max(1, x + y - n), min(x, y) + 1):
                p = lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(m + 1) - lgamma(x - m + 1) - lgamma(y - m + 1) - lgamma(n - x - y + m + 1)
                emi += m / n * np.log(n * m / (x * y)) * np.exp(p)
    h = [-sum(c / n * np.log(c / n) for c in s.values()) for s in (left, right)]
    return float((mi - emi) / (np.mean(h) - emi)) if abs(np.mean(h) - emi) > 1e-15 else 1.0


def _long(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    return df.select(key, cluster, F.posexplode(vector).alias("_p", "_x")).withColumn("_x", F.col("_x").cast("double"))


def calinski_harabasz(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """Spread between clusters over that within, each by its degrees of freedom. Sums by cluster and position only."""
    long = _long(df, key, cluster, vector)
    cells = long.groupBy(cluster, "_p").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_x").alias("_m"), (F.var_pop("_x") * F.count(F.lit(1))).alias("_ss"))
    mean = F.sum(F.col("_n") * F.col("_m")).over(Window.partitionBy("_p")) / F.sum("_n").over(Window.partitionBy("_p"))
    cells = cells.withColumn("_b", F.col("_n") * (F.col("_m") - mean) * (F.col("_m") - mean))
    row = cells.agg(F.sum("_b").alias("_between"), F.sum("_ss").alias("_within"), F.countDistinct(cluster).alias("_k"), F.sum(F.when(F.col("_p") == 0, F.col("_n"))).alias("_rows"))
    return row.select(F.try_divide(F.col("_between") * (F.col("_rows") - F.col("_k")), F.col("_within") * (F.col("_k") - 1)).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / distance to another. Clusters are few; rows meet only their own centre."""
    long = _long(df, key, cluster, vector)
    centres = long.groupBy(cluster, "_p").agg(F.avg("_x").alias("_m"))
    apart = long.join(centres, [cluster, "_p"]).groupBy(key, cluster).agg(F.sqrt(F.sum((F.col("_x") - F.col("_m")) * (F.col("_x") - F.col("_m")))).alias("_d"))
    spread = apart.groupBy(cluster).agg(F.avg("_d").alias("_s"))
    other = centres.select(F.col(cluster).alias("_o"), "_p", F.col("_m").alias("_n"))
    gaps = centres.join(other, "_p").where(F.col(cluster) != F.col("_o")).groupBy(cluster, "_o").agg(F.sqrt(F.sum((F.col("_m") - F.col("_n")) * (F.col("_m") - F.col("_n")))).alias("_gap"))
    rows = gaps.join(spread, cluster).join(spread.select(F.col(cluster).alias("_o"), F.col("_s").alias("_t")), "_o")
    return rows.groupBy(cluster).agg(F.max(F.try_divide(F.col("_s") + F.col("_t"), F.col("_gap"))).alias("_w")).agg(F.avg("_w").alias("davies_bouldin"))


def silhouette_centres(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """Simplified silhouette: distances to cluster centres in place of mean distances to all members. Linear in the rows.

    The exact form is silhouette_exact, for a bounded table.
    """
    long = _long(df, key, cluster, vector)
    centres = long.groupBy(F.col(cluster).alias("_c"), "_p").agg(F.avg("_x").alias("_m"))
    d = long.join(centres, "_p").groupBy(key, cluster, "_c").agg(F.sqrt(F.sum((F.col("_x") - F.col("_m")) * (F.col("_x") - F.col("_m")))).alias("_d"))
    each = d.groupBy(key).agg(F.min(F.when(F.col(cluster) == F.col("_c"), F.col("_d"))).alias("_a"), F.min(F.when(F.col(cluster) != F.col("_c"), F.col("_d"))).alias("_b"))
    return each.agg(F.avg(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b"))).alias("silhouette"))


def modularity(edges: DataFrame, labels: DataFrame, left: str, right: str, weight: str, node: str, label: str) -> DataFrame:
    """Modularity of a labeling of an undirected weighted graph; each edge stands once."""
    side = lambda c, out: labels.select(F.col(node).alias(c), F.col(label).alias(out))
    e = edges.join(side(left, "_x"), left).join(side(right, "_y"), right)
    ends = e.select(F.explode(F.array("_x", "_y")).alias("_l"), F.col(weight).alias("_w")).groupBy("_l").agg(F.sum("_w").alias("_deg"))
    inside = e.agg(F.sum(F.when(F.col("_x") == F.col("_y"), F.col(weight)).otherwise(0.0)).alias("_in"), F.sum(weight).alias("_m"))
    squares = ends.agg(F.sum(F.col("_deg") * F.col("_deg")).alias("_sq"))
    return inside.crossJoin(squares).select((F.col("_in") / F.col("_m") - F.col("_sq") / (4 * F.col("_m") * F.col("_m"))).alias("modularity"))  # one row each


def graph_stats(edges: DataFrame, nodes: DataFrame, left: str, right: str, node: str) -> DataFrame:
    """n_nodes, n_edges, density and n_isolated of an undirected graph whose edges stand once."""
    touched = edges.select(F.explode(F.array(left, right)).alias(node)).distinct()
    n, e = nodes.select(node).distinct().agg(F.count(F.lit(1)).alias("n_nodes")), edges.agg(F.count(F.lit(1)).alias("n_edges"))
    alone = nodes.select(node).distinct().join(touched, node, "left_anti").agg(F.count(F.lit(1)).alias("n_isolated"))
    row = n.crossJoin(e).crossJoin(alone)  # one row each
    return row.select("n_nodes", "n_edges", F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)).alias("density"), "n_isolated")


# --- bounded matrices, on the driver ---


def matrix(df: DataFrame, key: str, vector: str) -> tuple[list, np.ndarray]:
    """Keys, sorted, and their vectors; refuses more than LIMIT rows."""
    rows = df.select(key, vector).orderBy(key).limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"more than {LIMIT} rows")
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def square(pairs: DataFrame, left: str, right: str, value: str, names: Sequence) -> np.ndarray:
    """A symmetric matrix of pairs that stand once."""
    if len(names) > LIMIT:
        raise ValueError(f"more than {LIMIT} names")
    at = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for a, b, v in pairs.select(left, right, value).collect():  # at most LIMIT * LIMIT / 2
        out[at[a], at[b]] = out[at[b], at[a]] = v
    return out


def svd_embedding(m: np.ndarray, size: int) -> np.ndarray:
    """Rows of U S, each column's sign such that its largest entry is positive."""
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    out = u[:, :size] * s[:size]
    return out * np.where(out[np.abs(out).argmax(0), range(out.shape[1])] < 0, -1, 1)


def rand_of(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index of two labelings of the rows of a matrix."""
    cells = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(cells, (a, b), 1)
    two = lambda c: (c * (c - 1) / 2).sum()
    ij, i, j = two(cells), two(cells.sum(1)), two(cells.sum(0))
    expected = i * j / max(len(a) * (len(a) - 1) / 2, 1)
    return float((ij - expected) / ((i + j) / 2 - expected)) if (i + j) / 2 != expected else 1.0


def silhouette_exact(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette with euclidean distances; a cluster of one counts 0."""
    d = np.sqrt(np.maximum(0, (points**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * points @ points.T))
    kinds = np.unique(labels)
    sums = np.stack([d[:, labels == c].sum(1) for c in kinds], 1)
    sizes = np.array([(labels == c).sum() for c in kinds])
    own = np.searchsorted(kinds, labels)
    at = np.arange(len(labels))
    a = sums[at, own] / np.maximum(1, sizes[own] - 1)
    means = sums / sizes
    means[at, own] = np.inf
    b = means.min(1)
    return float(np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def validity(points: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """Of a labeling of a matrix: cost, exact silhouette, Calinski-Harabasz and Davies-Bouldin, and the sizes of clusters."""
    kinds, own, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    centres = np.stack([points[own == c].mean(0) for c in range(len(kinds))])
    apart = np.sqrt(((points - centres[own]) ** 2).sum(1))
    within, between = float((apart**2).sum()), float((sizes[:, None] * (centres - points.mean(0)) ** 2).sum())
    spread = np.bincount(own, apart) / sizes
    gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    np.fill_diagonal(gaps, np.inf)
    return {
        "cost": within, "silhouette": silhouette_exact(points, labels), "calinski_harabasz": between * (len(points) - len(kinds)) / max(within * (len(kinds) - 1), 1e-300),
        "davies_bouldin": float(((spread[:, None] + spread[None]) / np.maximum(gaps, 1e-300)).max(1).mean()), "mean_size": float(sizes.mean()), "largest": int(sizes.max()), "n_singletons": int((sizes == 1).sum()),
    }


def knee(xs: Sequence[float], ys: Sequence[float]) -> float:
    """Of a convex falling curve the x farthest below the chord between its ends, both axes scaled to 0..1."""
    x, y = np.asarray(xs, float), np.asarray(ys, float)
    x, y = (x - x[0]) / (x[-1] - x[0]), (y - y[-1]) / (y[0] - y[-1])
    return float(xs[int(np.argmax(1 - x - y))])


def linkage(distances: np.ndarray, method: str) -> np.ndarray:
    """Agglomerative merges (i, j, height, size) by Lance-Williams updates: single, complete, average or ward (distances euclidean)."""
    n = len(distances)
    d = distances.astype(float) ** (2 if method == "ward" else 1)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    ids, sizes, out = list(range(n)), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        flat = np.where(alive[:, None] & alive[None], d, np.inf)
        i, j = divmod(int(flat.argmin()), n)
        i, j = min(i, j), max(i, j)
        h, a, b = d[i, j], sizes[i], sizes[j]
        if method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        elif method == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        elif method == "ward":
            new = ((a + sizes) * d[i] + (b + sizes) * d[j] - sizes * h) / (a + b + sizes)
        else:
            raise ValueError(method)
        x, y = sorted((ids[i], ids[j]))
        out.append((x, y, np.sqrt(h) if method == "ward" else h, a + b))
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        alive[j] = False
        sizes[i], ids[i] = a + b, n + step
    return np.array(out)


def cut(merges: np.ndarray, k: int) -> np.ndarray:
    """Labels 0..k-1 of the k clusters left, in the order of their first rows."""
    n = len(merges) + 1
    parent = {}
    for step, (a, b, _, _) in enumerate(merges[: n - k]):
        parent[int(a)] = parent[int(b)] = n + step
    roots, labels = {}, []
    for i in range(n):
        while i in parent:
            i = parent[i]
        labels.append(roots.setdefault(i, len(roots)))
    return np.array(labels)


def cophenetic(merges: np.ndarray, distances: np.ndarray) -> float:
    """Correlation of merge heights with the distances."""
    n = len(merges) + 1
    members = {i: [i] for i in range(n)}
    c = np.zeros((n, n))
    for step, (a, b, h, _) in enumerate(merges):
        x, y = members.pop(int(a)), members.pop(int(b))
        c[np.ix_(x, y)] = c[np.ix_(y, x)] = h
        members[n + step] = x + y
    upper = np.triu_indices(n, 1)
    return float(np.corrcoef(c[upper], distances[upper])[0, 1])


def spectral(affinity: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Labels by k-means on the leading eigenvectors of the normalised affinity."""
    deg = affinity.sum(1)
    scale = 1 / np.sqrt(np.maximum(deg, 1e-12))
    _, vectors = np.linalg.eigh(affinity * scale[:, None] * scale[None])
    points = vectors[:, -k:] * scale[:, None]
    return lloyd(points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12), k, seed)


def lloyd(points: np.ndarray, k: int, seed: int = 42, runs: int = 10) -> np.ndarray:
    """k-means labels of a small matrix, the best of several starts."""
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(points), int))
    for _ in range(runs):
        centres = points[rng.choice(len(points), k, replace=False)]
        for _ in range(100):
            d = np.maximum(0, (points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T)
            labels = d.argmin(1)
            new = np.stack([points[labels == c].mean(0) if (labels == c).any() else points[d.min(1).argmax()] for c in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        cost = d.min(1).sum()
        if cost < best[0]:
            best = (cost, labels)
    return best[1]


def diagonal_gmm(points: np.ndarray, k: int, seed: int = 42, rounds: int = 200) -> tuple[np.ndarray, float, float]:
    """Labels, log-likelihood and BIC of a Gaussian mixture with diagonal covariances, by EM from k-means."""
    n, d = points.shape
    r = np.eye(k)[lloyd(points, k, seed)]
    last = -np.inf
    for _ in range(rounds):
        mass = r.sum(0) + 1e-12
        mean = r.T @ points / mass[:, None]
        var = np.maximum(r.T @ points**2 / mass[:, None] - mean**2, 1e-6)
        logs = np.log(mass / n) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((points[:, None] - mean) ** 2 / var).sum(2))
        top = logs.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        r = np.exp(logs - total[:, None])
        ll = total.sum()
        if ll - last < 1e-6 * abs(ll):
            break
        last = ll
    return r.argmax(1), float(ll), float(-2 * ll + (k - 1 + 2 * k * d) * np.log(n))


def self_organising_map(points: np.ndarray, rows: int, cols: int, steps: int = 5_000, rate: float = 0.5, radius: float = 1.5, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """Cell of each point, mean distance of each cell to its neighbours, and the mean distance of points to their cells."""
    rng = np.random.default_rng(seed)
    grid = np.array([(i, j) for i in range(rows) for j in range(cols)], float)
    w = points[rng.integers(len(points), size=rows * cols)].copy()
    for t in range(steps):
        x = points[rng.integers(len(points))]
        near = ((w - x) ** 2).sum(1).argmin()
        fade = 1 / (1 + t / (steps / 2))
        pull = np.exp(-((grid - grid[near]) ** 2).sum(1) / (2 * (radius * fade) ** 2))
        w += rate * fade * pull[:, None] * (x - w)
    d = np.sqrt(((points[:, None] - w[None]) ** 2).sum(2))
    touch = np.abs(grid[:, None] - grid[None]).max(2) == 1
    gaps = np.sqrt(((w[:, None] - w[None]) ** 2).sum(2))
    return d.argmin(1), (gaps * touch).sum(1) / touch.sum(1), float(d.min(1).mean())


def louvain(weights: np.ndarray, seed: int = 42) -> np.ndarray:
    """Communities by greedy modularity: nodes moved while it grows, then communities made nodes."""
    rng, labels, w = np.random.default_rng(seed), np.arange(len(weights)), weights.astype(float)
    while True:
        n, total, deg = len(w), w.sum(), w.sum(1)
        own = np.arange(n)
        mass = deg.copy()
        moved = True
        any_move = False
        while moved:
            moved = False
            for i in rng.permutation(n):
                to = np.bincount(own, w[i], n)
                to[own[i]] -= w[i, i]
                mass[own[i]] -= deg[i]
                gain = to - deg[i] * mass / max(total, 1e-300)
                best = int(gain.argmax())
                if gain[best] <= gain[own[i]] + 1e-12:
                    best = own[i]
                if best != own[i]:
                    moved = any_move = True
                own[i] = best
                mass[best] += deg[i]
        kinds, own = np.unique(own, return_inverse=True)
        labels = own[labels]
        if not any_move:
            return labels
        onehot = np.eye(len(kinds))[own]
        w = onehot.T @ w @ onehot


def density_clusters(distances: np.ndarray, least: int) -> np.ndarray:
    """HDBSCAN labels, -1 for noise: mutual reachability, its spanning tree condensed by size, clusters of greatest stability."""
    n = len(distances)
    core = np.sort(distances, 1)[:, min(least, n - 1)]
    reach = np.maximum(distances, np.maximum(core[:, None], core[None]))
    np.fill_diagonal(reach, 0)
    merges = linkage(reach, "single")
    kids = {n + s: (int(a), int(b), h) for s, (a, b, h, _) in enumerate(merges)}
    count = {i: 1 for i in range(n)} | {n + s: int(m[3]) for s, m in enumerate(merges)}

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += kids[x][:2]
        return out

    births, stable, below, held, order = {}, {}, {}, {}, []
    todo = [(2 * n - 2, 0.0)]
    while todo:  # a cluster: the node at which it begins
        top, birth = todo.pop()
        births[top], stable[top], below[top] = birth, 0.0, []
        order.append(top)
        node = top
        while node >= n:
            a, b, h = kids[node]
            level = 1 / max(h, 1e-12)
            big = [x for x in (a, b) if count[x] >= least]
            if len(big) == 2:
                stable[top] += count[node] * (level - birth)
                below[top] = [a, b]
                todo += [(a, level), (b, level)]
                break
            if not big:
                stable[top] += count[node] * (level - birth)
                break
            lost = b if big[0] == a else a
            stable[top] += count[lost] * (level - birth)
            node = big[0]
        held[top] = leaves(top)
    chosen = {}
    for top in reversed(order):
        kids_sum = sum(stable[x] for x in below[top])
        if below[top] and (kids_sum > stable[top] or top == order[0]):
            stable[top] = kids_sum
            chosen[top] = [c for x in below[top] for c in chosen[x]]
        else:
            chosen[top] = [top] if top != order[0] else []
    labels = np.full(n, -1)
    for k, top in enumerate(sorted(chosen[order[0]], key=lambda x: min(held[x]))):
        labels[held[top]] = k
    return labels
