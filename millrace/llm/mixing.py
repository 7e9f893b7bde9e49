"""Mixing sources to target shares."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import count_tokens
from millrace.runtime import materialise, require

#: Labelled texts of each source that the classifier is fitted on, at most.
SAMPLE = 400
#: Hashed word features.
FEATURES = 2_048
#: Rounds of the projected gradient, at most; it ends when no source's tokens change by more than this share of all any more.
ROUNDS, TOLERANCE = 200, 1e-5
#: A mix may be smaller than asked, down to this share, where that brings its shares nearer to the targets.
LEAST_TOTAL = 0.5
#: Steps that a posterior is rounded to, at least; documents of equal rounded posteriors have equal rates.
GRID = 128
#: Buckets of the hash by which fractions of rates are dealt.
BUCKETS = 1_024


@dataclass
class Mix:
    """documents: id, source, domain, n_tokens, rate, copies. report: a row for each target."""

    documents: DataFrame
    report: DataFrame


def mix_sources(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame, share: str = "target_share", repeats: str = "max_repeats",
    vocabulary: str | None = None, sample: int = SAMPLE, features: int = FEATURES, rounds: int = ROUNDS, least_total: float = LEAST_TOTAL, seed: int = 42,
) -> Mix:
    """How often to use each document so that each target source has its share of all tokens.

    Soft-membership mixing: a document of a target source belongs to it; one without a source belongs to all target
    sources by the posteriors of a classifier, fitted on at most sample labelled texts of each; one of
    a source without a target isn't used. Document rates, at least 0 and at most the source's repeats (the
    smallest repeats for a document without a source), are fitted by projected-gradient least squares. A rate
    is the projection of the memberships times one slope a source; each round one aggregation gives the sources' expected tokens
    and moves the slopes by the gaps over the sources' tokens. So the slopes are all there is to
    carry on from round to round, and a rate is worked out from the last ones alone.

    The fit has two stages. First the named documents alone are fitted to the shares of the tokens of all rows. Sources whose rate
    ends at its bound are looked at exactly: short are those whose rows, all repeated as often as may be, don't
    reach the share of the tokens of all rows. If there are any, the shares are solved again: the mix gets
    the total, between least_total times that of all rows and that of all rows, at which the best reachable shares come nearest to the targets,
    the largest of equally good ones; what short sources lack is spread over the others. Then the fit goes on to these, with the documents without a source.

    copies is the rate, rounded up or down by buckets of the hash of id and size: of a source those buckets are rounded up that make its
    tokens; what the rounding of the documents without a source gave is known by then. Rows equal in id and size have equal copies.

    report: source, target_share, max_repeats, own_docs, own_tokens (rows that name the source), all_tokens (of all
    rows), needed_tokens (share of all_tokens), short, rate (of own rows), best_share (the nearest to the target that can be reached),
    reached_tokens and reached_share (own copies, and the other copies by their memberships), gap (reached_share less
    best_share), rounds, converged (whether the fit ended before the rounds did).

    A row comes out as one row, whatever its id: null and repeated ids don't matter. Null and empty texts have 0 tokens. Of several targets for one source the first in order of share counts;
    targets with a null source, share or repeats don't. Empty docs give a report of zeros; empty targets an empty one.
    """
    spark = docs.sparkSession
    goal = require(targets, [source_col, share, repeats]).toDF("source", "target_share", "max_repeats").where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL")
    goal = goal.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*")
    wanted = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in goal.orderBy("source").collect()]  # a list of sources, given by hand
    names, k = [w[0] for w in wanted], len(wanted)
    most = [float(w[2]) for w in wanted]
    lowest = min(most, default=0.0)

    src = require(docs, [id_col, text_col, source_col]).toDF("_id", "_text", "_source")
    grid = max(GRID, 8 * k)
    keyed = _posteriors(src, names, grid, sample, features, seed)
    # the membership travels in the key, so that no row has to be found again by its id
    sized = count_tokens(keyed.select(F.struct(F.col("_id").alias("i"), F.col("_source").alias("s"), F.col("_q").alias("q")).alias("_k"), "_text"), "_k", "_text", vocabulary)
    sized = materialise(sized.select(F.col("_k.i").alias("_id"), F.col("_k.s").alias("_source"), F.col("_k.q").alias("_q"), F.col("n_tokens").cast("bigint").alias("_t")))
    by_source = {r["_source"]: (r["n"], r["t"]) for r in sized.where(F.col("_source").isin(names)).groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum("_t").alias("t")).collect()}  # one row a target
    all_tokens = sized.agg(F.sum("_t")).first()[0] or 0
    owned = [by_source.get(s, (0, 0)) for s in names]
    own = [t for _, t in owned]
    groups = materialise(sized.where("_q IS NOT NULL").groupBy("_q").agg(F.sum("_t").alias("_t")))

    needed = [w[1] * all_tokens for w in wanted]
    slopes, _, ended = _fit([0.0] * k, needed, own, most, own, None, lowest, rounds, all_tokens)
    at_bound = [_clip(x, m) >= m or not t for x, m, t in zip(slopes, most, own, strict=True)]
    short = [b and y > m * t for b, y, m, t in zip(at_bound, needed, most, own, strict=True)]
    soft = _by_membership(groups, F.col("_t"), k)
    total, best = _reachable([w[1] for w in wanted], [m * t + lowest * x for m, t, x in zip(most, own, soft, strict=True)], all_tokens, least_total)
    slopes, used, ended = _fit(slopes, best, own, most, [a + b for a, b in zip(own, soft, strict=True)], groups, lowest, rounds, all_tokens)

    bucket = F.pmod(F.xxhash64(F.lit(seed), "_id", "_t"), F.lit(BUCKETS)).cast("int")
    rate = _rate(slopes, lowest)
    unnamed = sized.where("_source IS NULL").withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    likeliest = F.element_at(F.array(*[F.lit(n) for n in names] or [F.lit(None).cast("string")]), F.array_position("_q", F.array_max("_q")).cast("int"))
    whole = F.floor("rate")
    unnamed = unnamed.select("_id", "_source", likeliest.alias("domain"), "_t", "_q", "rate", (whole + F.when((bucket + 0.5) / BUCKETS < F.col("rate") - whole, 1).otherwise(0)).cast("int").alias("copies"))
    unnamed = materialise(unnamed)
    given = _by_membership(unnamed.where("_q IS NOT NULL"), F.col("_t") * F.col("copies"), k)

    # what the documents without a source don't give, the sources' own do
    rates = [min(m, max(0.0, (x - g) / t)) if t else 0.0 for x, g, t, m in zip(best, given, own, most, strict=True)]
    held: dict[str, list[int]] = {s: [0] * BUCKETS for s in names}
    for r in sized.where(F.col("_source").isin(names)).groupBy("_source", bucket.alias("b")).agg(F.sum("_t").alias("t")).collect():  # at most BUCKETS rows a target
        held[r["_source"]][r["b"]] = r["t"]
    plan = spark.createDataFrame([(n, r, _dealt(held[n], r % 1)) for n, r in zip(names, rates, strict=True)], "_source string, rate double, _up array<int>")
    named = sized.where("_source IS NOT NULL").join(F.broadcast(plan), "_source", "left")  # a row a target
    copies = F.coalesce(F.floor("rate") + F.when(F.array_contains("_up", bucket), 1).otherwise(0), F.lit(0)).cast("int")
    named = named.select("_id", "_source", F.when(F.col("rate").isNotNull(), F.col("_source")).alias("domain"), "_t", F.coalesce("rate", F.lit(0.0)).alias("rate"), copies.alias("copies"))
    documents = materialise(named.unionByName(unnamed.drop("_q")).select(F.col("_id").alias("id"), F.col("_source").alias("source"), "domain", F.col("_t").alias("n_tokens"), "rate", "copies"))

    mine = {r["source"]: r["t"] for r in documents.where(F.col("source").isin(names)).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}  # one row a target
    reached = [float(mine.get(n, 0)) + g for n, g in zip(names, given, strict=True)]
    part = [x / sum(reached) if sum(reached) else 0.0 for x in reached]
    best = [x / total if total else 0.0 for x in best]
    rows = [(*w, *o, all_tokens, y, s, r, b, x, p, p - b, used, ended) for w, o, y, s, r, b, x, p in zip(wanted, owned, needed, short, rates, best, reached, part, strict=True)]
    schema = "source string, target_share double, max_repeats int, own_docs bigint, own_tokens bigint, all_tokens bigint, needed_tokens double, short boolean, rate double"
    schema += ", best_share double, reached_tokens double, reached_share double, gap double, rounds int, converged boolean"
    return Mix(documents, spark.createDataFrame(rows, schema))


def _clip(x: float, most: float) -> float:
    return min(most, max(0.0, x))


def _fit(slopes: list[float], goal: Sequence[float], own: Sequence[int], most: Sequence[float], mass: Sequence[float], groups: DataFrame | None, lowest: float, rounds: int, all_tokens: int) -> tuple[list[float], int, bool]:
    """The slopes at which the rates' expected tokens are nearest to the goal, the rounds that took, and whether they were enough.

    In the metric of the tokens a step of the gaps over the mass can't overshoot: each token's step is spread over sources
    by memberships that add up to 1.
    """
    before = None
    for n in range(rounds + 1):
        got = [_clip(x, m) * t for x, m, t in zip(slopes, most, own, strict=True)]
        if groups is not None:
            got = [a + b for a, b in zip(got, _by_membership(groups, F.col("_t") * _rate(slopes, lowest), len(got)), strict=True)]
        if all(abs(a - b) <= TOLERANCE * all_tokens for a, b in zip(got, goal if before is None else before, strict=True)):
            return slopes, n, True
        before = got
        slopes = [x + (y - g) / m if m else x for x, y, g, m in zip(slopes, goal, got, mass, strict=True)]
    return slopes, rounds, False


def _by_membership(df: DataFrame, amount: Column, k: int) -> list[float]:
    """Sums of an amount by the memberships _q of its rows."""
    if not k:
        return []
    row = df.select(amount.alias("_x"), "_q", _norm().alias("_z")).agg(*[F.sum(F.col("_x") * F.col("_q")[i] / F.col("_z")) for i in range(k)]).first()
    return [x or 0.0 for x in row]


def _norm() -> Column:
    return F.aggregate("_q", F.lit(0), lambda a, b: a + b)


def _rate(slopes: Sequence[float], most: float) -> Column:
    """Memberships times slopes, kept between 0 and most; null without memberships."""
    total = F.lit(0.0)
    for i, x in enumerate(slopes):
        total = total + F.col("_q")[i] * F.lit(float(x))
    return F.when(F.col("_q").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(float(most)), total / _norm())))


def _reachable(shares: Sequence[float], bounds: Sequence[float], total: float, least_total: float) -> tuple[float, list[float]]:
    """The total and the tokens of each source whose shares are nearest to the targets, no source above its bound."""
    whole = min(float(total), sum(bounds))
    if whole <= 0 or sum(shares) <= 0:
        return 0.0, [0.0] * len(shares)
    target = [x / sum(shares) for x in shares]

    def at(size: float) -> list[float]:
        low, high = -1.0, 1.0  # what is added to each share so that they fill the total
        for _ in range(100):
            mid = (low + high) / 2
            if sum(min(b / size, max(0.0, t + mid)) for t, b in zip(target, bounds, strict=True)) < 1:
                low = mid
            else:
                high = mid
        return [min(b / size, max(0.0, t + high)) for t, b in zip(target, bounds, strict=True)]

    def off(size: float) -> float:
        return sum((x - t) ** 2 for x, t in zip(at(size), target, strict=True))

    # a smaller total is never worse
    low, high = least_total * whole, whole
    enough = off(low) + 1e-9
    if off(high) > enough:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if off(mid) <= enough else (low, mid)
    else:
        low = high
    return low, [x * low for x in at(low)]


def _dealt(held: Sequence[int], fraction: float) -> list[int]:
    """Buckets that together hold nearest below the fraction of all: in order, those that still fit, and one more where that is nearer."""
    room, picked = fraction * sum(held), []
    for b, t in enumerate(held):
        if 0 < t <= room:
            room -= t
            picked.append(b)
    left = [(abs(room - t), b) for b, t in enumerate(held) if t and b not in set(picked)]
    if left and min(left)[0] < room:
        picked.append(min(left)[1])
    return picked


def _posteriors(src: DataFrame, names: list[str], grid: int, sample: int, features: int, seed: int) -> DataFrame:
    """src with _q, the probability of each name in steps of one grid-th, for the rows without a source; null for the others."""
    none = F.lit(None).cast("array<int>")
    order = F.xxhash64(F.lit(seed), "_id", "_text")
    labelled = src.where(F.col("_source").isin(names) & F.col("_text").isNotNull()).withColumn("_h", order)
    if not names or src.where("_source IS NULL AND _text <> ''").isEmpty():
        return src.withColumn("_q", none)
    # the hash up to which a source's different texts number no more than the sample
    ranked = labelled.select("_source", "_h").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("_source").orderBy("_h"))).where(F.col("_n") <= sample)
    upto = materialise(ranked.groupBy("_source").agg(F.max("_h").alias("_upto")))  # one row a name
    terms = HashingTF(numFeatures=features, inputCol="_w", outputCol="_raw")

    def featured(df: DataFrame, text: Column) -> DataFrame:
        split = df.withColumn("_w", F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}#>*|=%\n]+"))
        return Normalizer(inputCol="_raw", outputCol="features", p=2.0).transform(terms.transform(split))

    picked = labelled.join(F.broadcast(upto), "_source").where(F.col("_h") <= F.col("_upto")).dropDuplicates(["_source", "_h"])
    label = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("_source")).cast("double") - 1
    train = materialise(featured(picked, F.col("_text")).select(label.alias("label"), "features"))
    if train.select("label").distinct().count() < 2:
        return src.withColumn("_q", F.when(F.col("_source").isNull(), F.array_repeat(F.lit(1), len(names))))
    model = LogisticRegression(maxIter=25, regParam=1e-4, family="multinomial").fit(train)
    p = vector_to_array("probability")
    # classes that no labelled row has beyond the largest label are 0
    steps = F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda i: F.round(F.coalesce(F.try_element_at(p, i), F.lit(0.0)) * grid).cast("int"))
    scored = model.transform(featured(src, F.when(F.col("_source").isNull(), F.col("_text"))))
    return scored.select("_id", "_text", "_source", F.when(F.col("_source").isNull(), steps).alias("_q"))
