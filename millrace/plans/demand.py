"""Demand signals and the composite score by family."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import any_word
from millrace.operators import signals as S
from millrace.operators.ranking import top_per_group
from millrace.plans import Registry, table
from millrace.plans.catalogue import ACCORDS, CLAIMS, FAMILY, PRODUCTS, SEASONS, _REC, accords, claims, membership, product_notes, products
from millrace.runtime import materialise, small

R = Registry()

LEAST_BRAND = 5
EARLY, LATE = (2014, 2018), (2019, 2024)
#: Accords of a family that name it, and products of the population that an accord must have (100 where a population has 32,000; those of the test tables start below 1,000).
TOP_ACCORDS, ACCORD_SUPPORT = 5, 20
#: Words of accords and the forms in which claims name them.
SYNONYMS = {
    "sour": ("sour", "sourness"),
    "aquatic": ("aquatic", "aqua"),
    "tropical": ("tropical", "tropics"),
    "ozonic": ("ozonic", "ozone"),
    "floral": ("floral", "flowery", "flower", "flowers"),
    "camphor": ("camphor", "camphorous"),
    "cannabis": ("cannabis", "weed", "hemp"),
    "bitter": ("bitter", "bitterness"),
    "conifer": ("conifer", "pine", "pines"),
    "herbal": ("herbal", "herbaceous", "herbs", "herb"),
    "balsamic": ("balsamic", "balsam", "balsamy"),
    "rum": ("rum",),
    "mineral": ("mineral", "minerally", "minerals"),
    "vanilla": ("vanilla", "vanillic"),
    "almond": ("almond", "almondy"),
    "tuberose": ("tuberose",),
    "earthy": ("earthy", "earth", "earthiness"),
    "iris": ("iris", "orris"),
    "patchouli": ("patchouli",),
    "soapy": ("soapy", "soap", "soapiness"),
    "lavender": ("lavender", "lavandin"),
    "violet": ("violet", "violets"),
    "cherry": ("cherry", "cherries"),
    "lactonic": ("lactonic", "creamy", "milky", "cream"),
    "nutty": ("nutty", "nut", "nuts"),
    "caramel": ("caramel", "caramelized", "caramelised"),
    "rose": ("rose", "rosy", "roses"),
    "musky": ("musky", "musk", "musks"),
    "aldehydic": ("aldehydic", "aldehyde", "aldehydes"),
    "oud": ("oud", "agarwood"),
    "animalic": ("animalic", "animal", "animalistic"),
    "smoky": ("smoky", "smoke", "smokey", "smokiness"),
    "leather": ("leather", "leathery"),
    "whiskey": ("whiskey", "whisky", "bourbon"),
    "cacao": ("cacao", "cocoa"),
    "coffee": ("coffee", "espresso"),
    "honey": ("honey", "honeyed"),
    "terpenic": ("terpenic", "terpene", "terpenes"),
    "savory": ("savory", "savoury"),
    "chocolate": ("chocolate", "chocolatey", "chocolaty"),
    "metallic": ("metallic", "metal", "metals"),
    "coconut": ("coconut", "coconutty"),
    "salty": ("salty", "salt", "saline"),
    "anis": ("anis", "anise", "licorice", "liquorice"),
    "tobacco": ("tobacco",),
    "yellow": ("yellow",),
    "warm": ("warm", "warmth"),
    "spicy": ("spicy", "spice", "spices"),
    "white": ("white",),
    "fresh": ("fresh", "freshness"),
    "sweet": ("sweet", "sweetness"),
    "woody": ("woody", "wood", "woods"),
    "citrus": ("citrus", "citrusy", "citric"),
    "powdery": ("powdery", "powder"),
    "aromatic": ("aromatic", "aroma"),
    "fruity": ("fruity", "fruit", "fruits"),
    "amber": ("amber", "ambery"),
    "green": ("green", "greenery"),
    "gourmand": ("gourmand", "gourmet"),
}
#: Words of claims and what they stand for.
VOCABULARY = {"sweet": "sweet|honeyed|creamy", "fresh": "fresh|airy|clean|bright", "dark": "dark|smoky|dusty|dense", "soft": "soft|quiet|plush|pale"}

SIGNALS = f"""{PRODUCTS},
prior AS (SELECT quantile_cont(people, 0.5) AS m, avg(rating_average) AS c FROM products WHERE in_population),
sig AS (SELECT product_id, brand, year, (people * rating_average + m * c) / nullif(people + m, 0) AS approval, want::DOUBLE / nullif(have + had + want, 0) AS desire, ln(1 + people) AS adoption
  FROM products CROSS JOIN prior WHERE in_population),
brands AS (SELECT brand, count(*) AS n, avg(approval) AS a, avg(desire) AS d FROM sig WHERE brand IS NOT NULL GROUP BY 1 HAVING count(*) >= {LEAST_BRAND}),
dem AS (SELECT s.*, b.brand IS NOT NULL AS is_demeaned, CASE WHEN b.brand IS NOT NULL THEN approval - b.a ELSE approval END AS approval_demeaned,
  CASE WHEN b.brand IS NOT NULL THEN desire - b.d ELSE desire END AS desire_demeaned FROM sig s LEFT JOIN brands b ON s.brand = b.brand)
"""


def population(spark, folder) -> DataFrame:
    return products(spark, folder).where("in_population").drop("n_pros", "n_cons")


def demand(spark, folder, fallback: bool = True, inside: DataFrame | None = None) -> DataFrame:
    """Shrunken approval, desire, adoption, and the first two less the brand's mean."""
    rows = S.shrunk(population(spark, folder) if inside is None else inside, "rating_average", "people", "approval").withColumns({"desire": S.ratio("want", ["have", "had"]), "adoption": F.log1p("people")})
    return S.demeaned(rows, "brand", ["approval", "desire"], LEAST_BRAND, fallback)


def _r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


@R.query("approval_shrunk", f"{SIGNALS} SELECT product_id, round(approval, 6) AS approval FROM sig")
def approval_shrunk(spark, folder):
    """Ratings drawn to the mean the more, the fewer people rated."""
    return demand(spark, folder).select("product_id", *_r("approval"))


@R.query("desire_ratio", f"{SIGNALS} SELECT product_id, round(desire, 6) AS desire, round(adoption, 6) AS adoption FROM sig")
def desire_ratio(spark, folder):
    """Share of those who want it, and log of the people who know it."""
    return demand(spark, folder).select("product_id", *_r("desire", "adoption"))


@R.query("brand_demeaned", f"{SIGNALS} SELECT product_id, is_demeaned, round(approval_demeaned, 6) AS approval_demeaned, round(desire_demeaned, 6) AS desire_demeaned FROM dem")
def brand_demeaned(spark, folder):
    """Signals less their brand's mean; small brands keep theirs."""
    return demand(spark, folder).select("product_id", "is_demeaned", *_r("approval_demeaned", "desire_demeaned"))


@R.query("brand_demeaned_strict", f"{SIGNALS} SELECT product_id, round(approval_demeaned, 6) AS approval_demeaned FROM dem WHERE is_demeaned")
def brand_demeaned_strict(spark, folder):
    """Only where a brand has enough products."""
    return demand(spark, folder, fallback=False).where("is_demeaned").select("product_id", *_r("approval_demeaned"))


_FAMILY_SIGNALS = f"""{SIGNALS}, {FAMILY}, fd AS (SELECT cluster, sum(share) AS total_weight,
  sum(approval_demeaned * share) / nullif(sum(CASE WHEN approval_demeaned IS NOT NULL THEN share END), 0) AS approval_demeaned,
  sum(desire_demeaned * share) / nullif(sum(CASE WHEN desire_demeaned IS NOT NULL THEN share END), 0) AS desire_demeaned FROM fam JOIN dem USING (product_id) GROUP BY 1)"""


def family_demand(spark, folder, member: DataFrame | None = None, inside: DataFrame | None = None) -> DataFrame:
    rows = (membership(spark, folder) if member is None else member).join(demand(spark, folder, inside=inside), "product_id")
    return S.weighted_means(rows, ["cluster"], "share", ["approval_demeaned", "desire_demeaned"])


@R.query(
    "family_weighted_means",
    f"{_FAMILY_SIGNALS} SELECT cluster, round(total_weight, 6) AS n_products_weighted, CASE WHEN total_weight >= 500 THEN 'HIGH' WHEN total_weight >= 200 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, round(approval_demeaned, 6) AS approval_demeaned, round(desire_demeaned, 6) AS desire_demeaned FROM fd",
)
def family_weighted_means(spark, folder):
    """Membership-weighted means by family, nulls left out of their weight."""
    rows = family_demand(spark, folder)
    return rows.select("cluster", F.round("total_weight", 6).alias("n_products_weighted"), S.confidence("total_weight").alias("confidence"), *_r("approval_demeaned", "desire_demeaned"))


@R.query(
    "season_shares",
    f"{PRODUCTS}, {FAMILY}, s AS (SELECT cluster, {', '.join(f'sum({m} * share) AS {m}' for m in SEASONS)} FROM fam JOIN products USING (product_id) WHERE {' AND '.join(f'{m} IS NOT NULL' for m in SEASONS)} GROUP BY 1)\nSELECT cluster, {', '.join(f'round({m} / nullif({" + ".join(SEASONS)}, 0), 6) AS {m}_share' for m in SEASONS)} FROM s",
)
def season_shares(spark, folder):
    """Season votes of each family, weighted, as shares."""
    rows = membership(spark, folder).join(products(spark, folder).dropna(how="any", subset=list(SEASONS)), "product_id")
    sums = rows.groupBy("cluster").agg(*[F.sum(F.col(m) * F.col("share")).alias(m) for m in SEASONS])
    total = sum((F.col(m) for m in SEASONS), F.lit(0.0))
    return sums.select("cluster", *[F.round(F.try_divide(F.col(m), total), 6).alias(f"{m}_share") for m in SEASONS])


_YEARLY = f"{PRODUCTS}, {FAMILY}, y AS (SELECT year, cluster, sum(share) / sum(sum(share)) OVER (PARTITION BY year) AS supply_share FROM fam JOIN products USING (product_id) WHERE in_population GROUP BY 1, 2)"


def yearly_shares(spark, folder) -> DataFrame:
    rows = membership(spark, folder).join(population(spark, folder).select("product_id", "year"), "product_id")
    return S.shares(rows, ["year", "cluster"], "share", "supply_share", within=["year"])


@R.query("supply_by_year", f"{_YEARLY} SELECT year, cluster, cluster_name, round(supply_share, 6) AS supply_share FROM y LEFT JOIN (SELECT DISTINCT cluster, cluster_name FROM taxonomy_map) USING (cluster)")
def supply_by_year(spark, folder):
    """Families' shares of each year's products, with their names."""
    names = small(table(spark, folder, "taxonomy_map").select("cluster", "cluster_name").distinct())
    return yearly_shares(spark, folder).join(names, "cluster", "left").select("year", "cluster", "cluster_name", *_r("supply_share"))


@R.query("supply_share", f"{PRODUCTS}, {FAMILY} SELECT cluster, round(sum(share) / sum(sum(share)) OVER (), 6) AS supply_share FROM fam JOIN products USING (product_id) WHERE in_population GROUP BY 1")
def supply_share(spark, folder):
    """Families' shares of all products."""
    rows = membership(spark, folder).join(population(spark, folder).select("product_id"), "product_id", "left_semi")
    return S.shares(rows, ["cluster"], "share", "supply_share").select("cluster", *_r("supply_share"))


def _mean(years: tuple[int, int]) -> str:
    return f"avg(CASE WHEN year BETWEEN {years[0]} AND {years[1]} THEN supply_share END)"


@R.query("momentum", f"{_YEARLY} SELECT cluster, round({_mean(EARLY)}, 6) AS early_share, round({_mean(LATE)}, 6) AS late_share, round({_mean(LATE)} - {_mean(EARLY)}, 6) AS momentum FROM y GROUP BY 1")
def momentum(spark, folder):
    """Late share less early share."""
    return S.momentum(yearly_shares(spark, folder), "cluster", "year", "supply_share", EARLY, LATE).select("cluster", *_r("early_share", "late_share", "momentum"))


@R.query(
    "momentum_beside_stored",
    f"{_YEARLY}, mo AS (SELECT cluster, {_mean(EARLY)} AS early_share, {_mean(LATE)} AS late_share FROM y GROUP BY 1) SELECT run_id, territory_id, t.cluster, round(t.momentum, 6) AS stored, round(late_share - early_share, 6) AS momentum, round(early_share, 6) AS early_share, round(late_share, 6) AS late_share FROM (SELECT DISTINCT run_id, territory_id, cluster, momentum FROM territory_scores) t LEFT JOIN mo ON mo.cluster = t.cluster",
)
def momentum_beside_stored(spark, folder):
    """Stored momentum of each scored territory beside its family's shares in both windows."""
    stored = table(spark, folder, "territory_scores").select("run_id", "territory_id", "cluster", F.round("momentum", 6).alias("stored")).distinct()
    return stored.join(small(materialise(momentum(spark, folder))), "cluster", "left").select("run_id", "territory_id", "cluster", "stored", "momentum", "early_share", "late_share")


_PATTERNS = ", ".join(f"('{k}', '{v}')" for k, v in VOCABULARY.items())


@R.query(
    "sentiment_regex",
    f"""{_REC}, {CLAIMS}, w(topic, pattern) AS (VALUES {_PATTERNS}), hit AS (SELECT topic, polarity, greatest(coalesce(up_votes, 0) - coalesce(down_votes, 0), 0) AS weight FROM claims JOIN w ON regexp_matches(text, '(?i)\\b(' || pattern || ')\\b')),
s AS (SELECT topic, count(*) FILTER (polarity = 'pros') AS n_pro, count(*) FILTER (polarity = 'cons') AS n_con, coalesce(sum(weight) FILTER (polarity = 'pros'), 0)::BIGINT AS positive, coalesce(sum(weight) FILTER (polarity = 'cons'), 0)::BIGINT AS negative FROM hit GROUP BY 1)
SELECT *, round((positive - negative)::DOUBLE / nullif(positive + negative, 0), 6) AS polarity FROM s""",
)
def sentiment_regex(spark, folder):
    """Votes of claims that name a topic, for and against. The topics are a list by hand."""
    words = spark.createDataFrame([(k, "|".join(map(re.escape, v.split("|")))) for k, v in VOCABULARY.items()], "topic string, pattern string")
    rows = claims(spark, folder).join(F.broadcast(words), any_word(F.col("text"), F.col("pattern")))
    weight = F.greatest(F.coalesce("up_votes", F.lit(0)) - F.coalesce("down_votes", F.lit(0)), F.lit(0))
    pro, con = F.col("polarity") == "pros", F.col("polarity") == "cons"
    sums = rows.withColumn("weight", weight).groupBy("topic").agg(
        F.count_if(pro).alias("n_pro"), F.count_if(con).alias("n_con"), F.sum(F.when(pro, F.col("weight")).otherwise(0)).alias("positive"), F.sum(F.when(con, F.col("weight")).otherwise(0)).alias("negative")
    )
    return sums.withColumn("polarity", F.round(S.polarity("positive", "negative"), 6))


_ACC = f"{_REC}, {ACCORDS}, ap AS (SELECT DISTINCT product_id, accord FROM acc)"
_VALID = f"""{ACCORDS}, apop AS (SELECT DISTINCT product_id, lower(accord) AS accord FROM acc SEMI JOIN (SELECT product_id FROM products WHERE in_population) USING (product_id)), mpop AS (SELECT * FROM fam SEMI JOIN (SELECT product_id FROM products WHERE in_population) USING (product_id)),
asz AS (SELECT accord, count(*) AS n FROM apop SEMI JOIN mpop USING (product_id) GROUP BY 1 HAVING count(*) >= {ACCORD_SUPPORT}), fsz AS (SELECT cluster, sum(share) AS w FROM mpop GROUP BY 1), tsz AS (SELECT count(DISTINCT product_id) AS n FROM mpop),
val AS (SELECT cluster, accord, sum(share) / w AS mention_rate, asz.n::DOUBLE / tsz.n AS base_rate FROM mpop JOIN apop USING (product_id) JOIN asz USING (accord) JOIN fsz USING (cluster) CROSS JOIN tsz GROUP BY cluster, accord, w, asz.n, tsz.n),
top AS (SELECT *, mention_rate / base_rate AS lift, row_number() OVER (PARTITION BY cluster ORDER BY round(mention_rate / base_rate, 9) DESC, accord)::INT AS rank FROM val QUALIFY rank <= {TOP_ACCORDS})"""
_SAID = f"""{_VALID}, syn(word, forms) AS (VALUES {", ".join(f"('{w}', '{'|'.join(f)}')" for w, f in SYNONYMS.items())}),
wd AS (SELECT DISTINCT cluster, unnest(string_split(accord, ' ')) AS word FROM top), pat AS (SELECT cluster, string_agg(coalesce(forms, regexp_escape(word)), '|') AS p FROM wd LEFT JOIN syn USING (word) GROUP BY 1),
cl AS (SELECT split_part(path, '.', 2) AS polarity, val AS text, greatest(coalesce(TRY_CAST(el->>'$.up_votes' AS BIGINT), 0) - coalesce(TRY_CAST(el->>'$.down_votes' AS BIGINT), 0), 0) AS weight FROM nodes SEMI JOIN (SELECT product_id FROM products WHERE in_population AND has_ai_summary) USING (product_id) WHERE path LIKE 'ai_summary.%'),
hi AS (SELECT cluster, polarity, weight FROM cl JOIN pat ON regexp_matches(text, '(?i)\\b(' || p || ')\\b')),
sd AS (SELECT cluster, count(*) FILTER (polarity = 'pros') AS n_pro, count(*) FILTER (polarity = 'cons') AS n_con, coalesce(sum(weight) FILTER (polarity = 'pros'), 0)::BIGINT AS positive, coalesce(sum(weight) FILTER (polarity = 'cons'), 0)::BIGINT AS negative FROM pat LEFT JOIN hi USING (cluster) GROUP BY 1)"""


def validation(spark, folder) -> DataFrame:
    """cluster, accord, mention_rate, base_rate, lift, rank: a family's accords of greatest lift in the population, of accords that are not too rare."""
    inside = products(spark, folder).where("in_population").select("product_id")
    member = membership(spark, folder).join(inside, "product_id", "left_semi")
    said = accords(spark, folder).join(inside, "product_id", "left_semi").select("product_id", F.lower("accord").alias("accord")).distinct()
    n = member.agg(F.countDistinct("product_id").alias("_all"))
    base = said.join(member.select("product_id"), "product_id", "left_semi").groupBy("accord").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= ACCORD_SUPPORT)
    sizes = member.groupBy("cluster").agg(F.sum("share").alias("_w"))
    rates = member.join(said, "product_id").groupBy("cluster", "accord").agg(F.sum("share").alias("_s")).join(base, "accord").join(sizes, "cluster").crossJoin(F.broadcast(n))  # one row
    rates = rates.select("cluster", "accord", (F.col("_s") / F.col("_w")).alias("mention_rate"), (F.col("_n") / F.col("_all")).alias("base_rate")).withColumn("lift", F.col("mention_rate") / F.col("base_rate"))
    return top_per_group(rates, ["cluster"], [F.desc(F.round("lift", 9)), F.asc("accord")], TOP_ACCORDS)


@R.query("family_validation", f"{PRODUCTS}, {FAMILY}, {_VALID} SELECT cluster, accord, rank, round(mention_rate, 6) AS mention_rate, round(base_rate, 6) AS base_rate, round(lift, 6) AS lift FROM top")
def family_validation(spark, folder):
    """Five accords that stand with each family most above chance."""
    return validation(spark, folder).select("cluster", "accord", "rank", *_r("mention_rate", "base_rate", "lift"))


def family_said(spark, folder) -> DataFrame:
    """cluster, n_pro, n_con, positive, negative, net, polarity: what claims of the population that name a word of a family's accords weigh for and against.

    A family's words are those of its accords with their forms; families are few, so their patterns are broadcast. A claim counts once for a family,
    with its votes for it less those against, at least 0. The polarity is null where nothing weighs.
    """
    forms = spark.createDataFrame([(w, "|".join(map(re.escape, f))) for w, f in SYNONYMS.items()], "word string, forms string")
    words = validation(spark, folder).select("cluster", F.explode(F.split("accord", " ")).alias("word")).distinct().join(F.broadcast(forms), "word", "left")  # a fixed list
    own = F.coalesce("forms", F.regexp_replace("word", r"([^\p{L}\p{N}])", r"\\$1"))
    patterns = materialise(words.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set(own)), "|").alias("pattern")))
    inside = products(spark, folder).where("in_population AND has_ai_summary").select("product_id")
    said = claims(spark, folder).join(inside, "product_id", "left_semi").withColumn("weight", F.greatest(F.coalesce("up_votes", F.lit(0)) - F.coalesce("down_votes", F.lit(0)), F.lit(0)))
    hits = said.join(small(patterns), any_word(F.col("text"), F.col("pattern")))
    pro, con = F.col("polarity") == "pros", F.col("polarity") == "cons"
    sums = hits.groupBy("cluster").agg(F.count_if(pro).alias("n_pro"), F.count_if(con).alias("n_con"), F.sum(F.when(pro, F.col("weight")).otherwise(0)).alias("positive"), F.sum(F.when(con, F.col("weight")).otherwise(0)).alias("negative"))
    sums = patterns.select("cluster").join(sums, "cluster", "left").na.fill(0, ["n_pro", "n_con", "positive", "negative"])
    return sums.withColumns({"net": F.col("positive") - F.col("negative"), "polarity": S.polarity("positive", "negative")})


@R.query("family_sentiment", f"{PRODUCTS}, {FAMILY}, {_SAID} SELECT cluster, n_pro, n_con, positive, negative, positive - negative AS net, round((positive - negative)::DOUBLE / nullif(positive + negative, 0), 6) AS polarity FROM sd")
def family_sentiment(spark, folder):
    """What claims say of each family, for and against, by votes."""
    return family_said(spark, folder).withColumn("polarity", F.round("polarity", 6))


_SCORE = f"""{_FAMILY_SIGNALS}, {_SAID},
y AS (SELECT year, cluster, sum(share) / sum(sum(share)) OVER (PARTITION BY year) AS supply_share FROM fam JOIN products USING (product_id) WHERE in_population GROUP BY 1, 2),
mo AS (SELECT cluster, {_mean(LATE)} - {_mean(EARLY)} AS momentum FROM y GROUP BY 1),
su AS (SELECT cluster, sum(share) / sum(sum(share)) OVER () AS supply_share FROM fam JOIN products USING (product_id) WHERE in_population GROUP BY 1),
se AS (SELECT cluster, (positive - negative)::DOUBLE / nullif(positive + negative, 0) AS polarity FROM sd),
al AS (SELECT fd.cluster, approval_demeaned, desire_demeaned, polarity, supply_share, momentum, row_number() OVER (ORDER BY supply_share DESC, fd.cluster) = 1 AS backbone
  FROM fd JOIN mo USING (cluster) JOIN su USING (cluster) LEFT JOIN se USING (cluster)),
zs AS (SELECT cluster, {", ".join(f"({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) AS z_{c}" for c in ("approval_demeaned", "desire_demeaned", "polarity", "supply_share", "momentum"))} FROM al WHERE NOT backbone),
sc AS (SELECT *, z_approval_demeaned + z_desire_demeaned + z_polarity - z_supply_share + 0.5::DOUBLE * z_momentum AS score, z_approval_demeaned + z_desire_demeaned - z_supply_share + 0.5::DOUBLE * z_momentum AS plain FROM zs)
"""
_PARTS = {"approval_demeaned": 1.0, "desire_demeaned": 1.0, "polarity": 1.0, "supply_share": -1.0, "momentum": 0.5}


def composite(spark, folder) -> DataFrame:
    """Families with their z-scores and score; the family of greatest supply is the backbone and isn't scored."""
    member, held = membership(spark, folder), products(spark, folder)
    inside = member.join(held.where("in_population").select("product_id", "year"), "product_id")
    supply = S.shares(inside, ["cluster"], "share", "supply_share")
    moves = S.momentum(S.shares(inside, ["year", "cluster"], "share", "supply_share", within=["year"]), "cluster", "year", "supply_share", EARLY, LATE).select("cluster", "momentum")
    said = family_said(spark, folder)
    rows = family_demand(spark, folder, member, held.where("in_population")).join(moves, "cluster").join(supply, "cluster").join(said.select("cluster", "polarity"), "cluster", "left")
    rows = materialise(rows)
    rows = rows.withColumn("backbone", F.row_number().over(Window.partitionBy().orderBy(F.desc("supply_share"), "cluster")) == 1)  # families, few
    scored = S.z_scores(rows.where("NOT backbone"), list(_PARTS))
    score = lambda parts: sum((F.col(f"z_{c}") * w for c, w in parts.items()), F.lit(0.0))
    return scored.withColumns({"score": score(_PARTS), "plain": score({c: w for c, w in _PARTS.items() if c != "polarity"})}).unionByName(rows.where("backbone"), allowMissingColumns=True)


@R.query(
    "composite_score",
    f"{_SCORE} SELECT cluster, false AS backbone, round(score, 4) AS score, (row_number() OVER (ORDER BY round(score, 9) DESC, cluster))::INT AS place FROM sc UNION ALL SELECT cluster, true, NULL, NULL FROM al WHERE backbone",
)
def composite_score(spark, folder):
    """Families by under-supply relative to demand; the backbone last, without a place."""
    rows = composite(spark, folder)
    place = F.when(~F.col("backbone"), F.row_number().over(Window.partitionBy("backbone").orderBy(F.desc(F.round("score", 9)), "cluster")))
    return rows.select("cluster", "backbone", F.round("score", 4).alias("score"), place.alias("place")).orderBy("backbone", "place")


@R.query(
    "score_rank_compare",
    f"{_SCORE} SELECT cluster, (row_number() OVER (ORDER BY round(score, 9) DESC, cluster) - row_number() OVER (ORDER BY round(plain, 9) DESC, cluster))::BIGINT AS moved FROM sc",
)
def score_rank_compare(spark, folder):
    """Places gained or lost if sentiment is left out."""
    w = lambda c: Window.partitionBy().orderBy(F.desc(F.round(c, 9)), "cluster")  # noqa: E731  # families, few
    return composite(spark, folder).where("NOT backbone").select("cluster", (F.row_number().over(w("score")) - F.row_number().over(w("plain"))).cast("bigint").alias("moved"))


@R.query("score_decomposition", f"{_SCORE} SELECT cluster, {', '.join(f'round({w}::DOUBLE * z_{c}, 4) AS {c}' for c, w in _PARTS.items())} FROM sc")
def score_decomposition(spark, folder):
    """What each part gives to the score."""
    return composite(spark, folder).where("NOT backbone").select("cluster", *[F.round(F.col(f"z_{c}") * w, 4).alias(c) for c, w in _PARTS.items()])


@R.query(
    "demand_index",
    f"{_SCORE} SELECT cluster, round(z_approval_demeaned + z_desire_demeaned + z_polarity, 4) AS demand_index, round(al.supply_share / max(al.supply_share) OVER (), 6) AS bubble FROM sc JOIN al USING (cluster)",
)
def demand_index(spark, folder):
    """Data of the demand chart: three z-scores added, and sizes scaled by the largest."""
    rows = composite(spark, folder).where("NOT backbone")
    largest = F.max("supply_share").over(Window.partitionBy())
    return rows.select("cluster", F.round(F.col("z_approval_demeaned") + F.col("z_desire_demeaned") + F.col("z_polarity"), 4).alias("demand_index"), F.round(F.col("supply_share") / largest, 6).alias("bubble"))


_TRACED = f"{_SCORE}, tot AS (SELECT cluster, sum(share) AS w FROM fam SEMI JOIN dem USING (product_id) GROUP BY 1), se2 AS (SELECT cluster, {', '.join(f'sum({m} * share) AS {m}' for m in SEASONS)} FROM fam JOIN products USING (product_id) WHERE {' AND '.join(f'{m} IS NOT NULL' for m in SEASONS)} GROUP BY 1)"


@R.query(
    "evidence_trace",
    f"{_TRACED}, ranked AS (SELECT cluster, score, (row_number() OVER (ORDER BY round(score, 9) DESC, cluster))::INT AS place FROM sc) SELECT place, cluster, cluster_name, round(score, 3) AS score, CASE WHEN w >= 500 THEN 'HIGH' WHEN w >= 200 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, round(approval_demeaned, 3) + 0.0::DOUBLE AS approval_demeaned, round(desire_demeaned, 3) + 0.0::DOUBLE AS desire_demeaned, round(polarity, 3) + 0.0::DOUBLE AS polarity, round(supply_share, 3) + 0.0::DOUBLE AS supply_share, round(momentum, 3) + 0.0::DOUBLE AS momentum, round(w, 3) AS n_products_weighted, CASE greatest({', '.join(SEASONS)}) {' '.join(f"WHEN {m} THEN '{m}'" for m in SEASONS)} END AS season FROM ranked JOIN al USING (cluster) JOIN tot USING (cluster) LEFT JOIN se2 USING (cluster) LEFT JOIN (SELECT cluster, min(cluster_name) AS cluster_name FROM taxonomy_map GROUP BY 1) USING (cluster) WHERE place <= 3",
)
def evidence_trace(spark, folder):
    """The three families of greatest score with all that the score rests on."""
    rows = composite(spark, folder).where("NOT backbone")
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("score", 9)), "cluster"))  # families, few
    names = table(spark, folder, "taxonomy_map").groupBy("cluster").agg(F.min("cluster_name").alias("cluster_name"))
    rows = rows.withColumn("place", place).where("place <= 3").join(strongest_season(spark, folder), "cluster", "left").join(names, "cluster", "left")
    held = ("approval_demeaned", "desire_demeaned", "polarity", "supply_share", "momentum")
    return rows.select("place", "cluster", "cluster_name", *_r("score", digits=3), S.confidence("total_weight").alias("confidence"), *[(F.round(c, 3) + 0.0).alias(c) for c in held], F.round("total_weight", 3).alias("n_products_weighted"), "season")


@R.query(
    "strongest_season",
    f"{PRODUCTS}, {FAMILY}, s AS (SELECT cluster, {', '.join(f'sum({m} * share) AS {m}' for m in SEASONS)} FROM fam JOIN products USING (product_id) WHERE {' AND '.join(f'{m} IS NOT NULL' for m in SEASONS)} GROUP BY 1)\nSELECT cluster, CASE greatest({', '.join(SEASONS)}) {' '.join(f'''WHEN {m} THEN '{m}' ''' for m in SEASONS)} END AS season FROM s",
)
def strongest_season(spark, folder):
    """Season of most votes of each family: argmax over columns."""
    rows = membership(spark, folder).join(products(spark, folder).dropna(how="any", subset=list(SEASONS)), "product_id")
    sums = rows.groupBy("cluster").agg(*[F.sum(F.col(m) * F.col("share")).alias(m) for m in SEASONS])
    best = F.greatest(*SEASONS)
    return sums.select("cluster", F.coalesce(*[F.when(F.col(m) == best, F.lit(m)) for m in SEASONS]).alias("season"))


@R.query(
    "accord_lift_family",
    f"""{_ACC}, {FAMILY}, p AS (SELECT product_id, cluster, share, accord FROM fam JOIN ap USING (product_id)), b AS (SELECT accord, count(DISTINCT product_id) AS n FROM p GROUP BY 1),
w AS (SELECT cluster, sum(share) AS whole FROM (SELECT DISTINCT product_id, cluster, share FROM p) GROUP BY 1), t AS (SELECT count(DISTINCT product_id) AS n FROM p)
SELECT cluster, accord, round(sum(share) / whole, 6) AS mention_rate, round(b.n::DOUBLE / t.n, 6) AS base_rate, round(sum(share) / whole / (b.n::DOUBLE / t.n), 6) AS lift
FROM p JOIN b USING (accord) JOIN w USING (cluster) CROSS JOIN t GROUP BY cluster, accord, whole, b.n, t.n""",
)
def accord_lift_family(spark, folder):
    """Accords that stand with a family more than in general, by membership."""
    pairs = membership(spark, folder).join(accords(spark, folder).select("product_id", "accord").distinct(), "product_id")
    return S.lift(pairs, "cluster", "accord", "share").select("cluster", "accord", *_r("mention_rate", "base_rate", "lift"))


_NOTE_LIFT = f"""{_ACC}, {FAMILY}, p AS (SELECT product_id, note, accord FROM pn JOIN ap USING (product_id)), b AS (SELECT accord, count(DISTINCT product_id) AS n FROM p GROUP BY 1),
w AS (SELECT note, count(DISTINCT product_id) AS whole FROM p GROUP BY 1), t AS (SELECT count(DISTINCT product_id) AS n FROM p),
li AS (SELECT note, accord, (count(*)::DOUBLE / whole) / (b.n::DOUBLE / t.n) AS lift FROM p JOIN b USING (accord) JOIN w USING (note) CROSS JOIN t GROUP BY note, accord, whole, b.n, t.n)"""


def _note_lift(spark, folder):
    return S.lift(product_notes(spark, folder).join(accords(spark, folder).select("product_id", "accord").distinct(), "product_id"), "note", "accord")


@R.query("accord_lift_note", f"{_NOTE_LIFT} SELECT note, accord, round(lift, 6) AS lift FROM li")
def accord_lift_note(spark, folder):
    """The same for single notes."""
    return _note_lift(spark, folder).select("note", "accord", *_r("lift"))


@R.query("hard_label", f"{_NOTE_LIFT} SELECT note, accord FROM (SELECT *, row_number() OVER (PARTITION BY note ORDER BY round(lift, 9) DESC, accord) AS k FROM li) WHERE k = 1")
def hard_label(spark, folder):
    """Each note's accord of greatest lift."""
    return top_per_group(_note_lift(spark, folder), ["note"], [F.desc(F.round("lift", 9)), F.asc("accord")], 1).select("note", "accord")


@R.query(
    "accord_pivot",
    f"{_ACC} SELECT product_id, " + ", ".join(f"coalesce(max(strength) FILTER (accord = '{a}'), 0) AS {a}" for a in ("honeyed", "smoky", "dusty", "clean")) + " FROM acc GROUP BY 1",
)
def accord_pivot(spark, folder):
    """Strength of some accords as columns, 0 where absent."""
    names = ["honeyed", "smoky", "dusty", "clean"]
    return accords(spark, folder).groupBy("product_id").pivot("accord", names).agg(F.max("strength")).na.fill(0, names)


@R.query(
    "vote_shares_note",
    f"{PRODUCTS}, {FAMILY}, s AS (SELECT note, sum(have) AS have, sum(had) AS had, sum(want) AS want FROM pn JOIN products USING (product_id) WHERE have IS NOT NULL AND had IS NOT NULL AND want IS NOT NULL GROUP BY 1), g AS (SELECT sum(want)::DOUBLE / sum(have + had + want) AS w FROM products WHERE have IS NOT NULL AND had IS NOT NULL AND want IS NOT NULL)\nSELECT note, round(want::DOUBLE / nullif(have + had + want, 0), 6) AS want_share, round(want::DOUBLE / nullif(have + had + want, 0) - w, 6) AS over_all FROM s CROSS JOIN g",
)
def vote_shares_note(spark, folder):
    """Share of wanting votes of each note's products beside all products; products without votes don't count."""
    voted = products(spark, folder).dropna(how="any", subset=["have", "had", "want"])
    whole = voted.agg((F.sum("want") / F.sum(F.col("have") + F.col("had") + F.col("want"))).alias("_all"))
    sums = product_notes(spark, folder).join(voted, "product_id").groupBy("note").agg(*[F.sum(c).alias(c) for c in ("have", "had", "want")])
    share = S.ratio("want", ["have", "had"])
    return sums.crossJoin(F.broadcast(whole)).select("note", F.round(share, 6).alias("want_share"), F.round(share - F.col("_all"), 6).alias("over_all"))  # one row


_COLS = {"approval_demeaned": 1, "desire_demeaned": 1, "sentiment_polarity": 1, "supply_share": -1}


@R.query(
    "run_z_scores",
    "WITH t AS (SELECT DISTINCT * FROM territory_scores) SELECT run_id, territory_id, " + ", ".join(f"round(({c} - avg({c}) OVER (PARTITION BY run_id)) / nullif(stddev_pop({c}) OVER (PARTITION BY run_id), 0), 6) AS z_{c}" for c in _COLS) + " FROM t",
)
def run_z_scores(spark, folder):
    """z-scores within each scoring run."""
    rows = table(spark, folder, "territory_scores").distinct()
    return S.z_scores(rows, list(_COLS), ["run_id"]).select("run_id", "territory_id", *_r(*[f"z_{c}" for c in _COLS]))


@R.query("territory_lookup", "SELECT territory_id, cluster_name, round(approval_raw, 3) AS approval, round(sentiment_polarity, 3) AS polarity FROM (SELECT DISTINCT territory_id, cluster_name, approval_raw, sentiment_polarity FROM territory_scores)")
def territory_lookup(spark, folder):
    """Territories with rounded scores, nulls kept."""
    rows = table(spark, folder, "territory_scores").select("territory_id", "cluster_name", "approval_raw", "sentiment_polarity").distinct()
    return rows.select("territory_id", "cluster_name", F.round("approval_raw", 3).alias("approval"), F.round("sentiment_polarity", 3).alias("polarity"))
