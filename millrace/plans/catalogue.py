"""The catalogue tables that the analyses start from, and queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import gloss, token
from millrace.operators import profile
from millrace.operators.nested import _elements, is_object, json_path, latest, many, shred
from millrace.operators.ranking import average_rank, joined_top, nearest_rank, top_per_group
from millrace.operators.signals import null_if_zero
from millrace.plans import Registry, table
from millrace.plans.records import _NODES, RECORD
from millrace.runtime import materialise, new_path, prepared, small
from millrace.sources import read_json_lines

R = Registry()

PEOPLE, YEARS = 50, (1990, 2025)
SEASONS = ("winter", "spring", "summer", "autumn")
RELATION = ("have", "had", "want")
#: Names that are no single note.
PLACEHOLDERS = r"^(various|mixed flowers|unknown|none listed|see description|secret formula|tbd|n/a|.* notes?|notes:?)$"
TIERS = {"top": 0, "middle": 1, "base": 2, "flat": 3}


def products(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record: scalars, vote groups that are null where nobody voted, number of notes, population flag.

    The first query of a session that needs it writes the table, the others read it.
    """
    return prepared(spark, "products", [f"{folder}/perfumes.parquet"], lambda: flattened(spark, folder))


def flattened(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of products from the raw records, each parsed once."""
    src = table(spark, folder, "perfumes")
    payload = F.struct("record", "brand", "year", "gender", "people", "rating_average")
    rows = latest(src.select("id", "scraped_at", payload.alias("row")), "id", "scraped_at", "row").select("id", "row.*")
    rows = rows.withColumn("v", F.try_parse_json("record"))

    def usable(path: str, member: str):
        held = lambda x: F.coalesce(F.try_variant_get(x["v"], f"$['{member}']", "string").rlike(r"[^\s]"), F.lit(False))
        return F.size(F.filter(_elements(tuple(path.split(".")), many("_")), held))

    votes = {m: F.try_variant_get("v", json_path(("relation", m)), "bigint") for m in RELATION} | {m: F.try_variant_get("v", json_path(("seasons", m)), "bigint") for m in SEASONS}
    tiered = usable("notes.tiered.top", "name") + usable("notes.tiered.middle", "name") + usable("notes.tiered.base", "name")
    made = F.struct(
        F.col("id").alias("product_id"), "brand", "year", "gender", "people", "rating_average", *[c.alias(n) for n, c in votes.items()], tiered.alias("_tiered"), usable("notes.flat", "name").alias("_flat"),
        usable("ai_summary.pros", "text").alias("n_pros"), usable("ai_summary.cons", "text").alias("n_cons"),
    )
    # not filtered: a filter would parse once more
    rows = rows.select(F.inline(F.filter(F.array(F.when(F.col("v").isNotNull(), made)), lambda x: x.isNotNull())))
    rows = null_if_zero(rows, {"relation": RELATION, "seasons": SEASONS})
    rows = rows.withColumn("n_notes", F.when(F.col("_tiered") > 0, F.col("_tiered")).otherwise(F.col("_flat")).cast("bigint")).drop("_tiered", "_flat")
    voted = F.coalesce(*[F.col(c) for c in (*RELATION, *SEASONS)]).isNotNull()
    inside = profile.true((F.col("n_notes") >= 1) & F.col("year").between(*YEARS) & (F.col("people") >= PEOPLE))
    return rows.withColumns({"has_votes": voted, "has_ai_summary": (F.col("n_pros") > 0) | (F.col("n_cons") > 0), "in_population": inside})


_REC = """
WITH last AS (SELECT id, max(scraped_at) AS scraped_at FROM perfumes WHERE id IS NOT NULL GROUP BY id),
rec AS (
  SELECT p.id AS product_id, min(brand) AS brand, min(year) AS year, min(gender) AS gender, min(people) AS people, min(rating_average) AS rating_average, max(p.record) AS record
  FROM perfumes p JOIN last l ON p.id = l.id AND p.scraped_at IS NOT DISTINCT FROM l.scraped_at GROUP BY p.id
), j AS (SELECT *, record::JSON AS r FROM rec WHERE json_valid(record))"""
_VOTES = ", ".join([f"TRY_CAST(r->>'$.relation.{m}' AS BIGINT) AS {m}" for m in RELATION] + [f"TRY_CAST(r->>'$.seasons.{m}' AS BIGINT) AS {m}" for m in SEASONS])
_ANY = lambda ms: " + ".join(f"coalesce({m}, 0)" for m in ms)
PRODUCTS = f"""{_REC}, nodes AS ({_NODES}),
size AS (SELECT product_id, count(*) FILTER (path LIKE 'notes.tiered.%') AS tiered, count(*) FILTER (path = 'notes.flat') AS flat,
  count(*) FILTER (path = 'ai_summary.pros') AS n_pros, count(*) FILTER (path = 'ai_summary.cons') AS n_cons
  FROM nodes WHERE val IS NOT NULL AND regexp_matches(val, '[^\\s]') GROUP BY 1),
votes AS (SELECT j.product_id, brand, year, gender, people, rating_average, {_VOTES}, coalesce(n_pros, 0) AS n_pros, coalesce(n_cons, 0) AS n_cons,
  CASE WHEN coalesce(tiered, 0) > 0 THEN tiered ELSE coalesce(flat, 0) END AS n_notes FROM j LEFT JOIN size USING (product_id)),
products AS (SELECT product_id, brand, year, gender, people, rating_average, {", ".join(f"CASE WHEN {_ANY(g)} <> 0 THEN {m} END AS {m}" for g in (RELATION, SEASONS) for m in g)},
  n_notes, ({_ANY(RELATION)} <> 0 OR {_ANY(SEASONS)} <> 0) AS has_votes, (n_pros > 0 OR n_cons > 0) AS has_ai_summary,
  coalesce(n_notes >= 1 AND year BETWEEN {YEARS[0]} AND {YEARS[1]} AND people >= {PEOPLE}, false) AS in_population FROM votes)
"""


def token_map(spark: SparkSession, folder: str) -> DataFrame:
    """raw_token and the canonical note it is kept as or merged into; a list of fixed size."""
    rows = table(spark, folder, "note_normalisation").where(F.col("action").isin("KEEP", "MERGE") & F.col("canonical").isNotNull())
    return rows.select("raw_token", F.lower(F.trim("canonical")).alias("note")).distinct()


def product_notes(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Distinct products and canonical notes, by the token map."""
    if not extra:
        return prepared(spark, "product_notes", [f"{folder}/{t}.parquet" for t in ("notes_long", "note_normalisation")], lambda: _product_notes(spark, folder))
    return _product_notes(spark, folder, extra)


def _product_notes(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> DataFrame:
    rows = table(spark, folder, "notes_long").where("product_id IS NOT NULL").select("product_id", *extra, token(F.col("note_raw")).alias("raw_token"))
    return rows.join(small(token_map(spark, folder)), "raw_token").select("product_id", "note", *extra).distinct()


_TOKEN = r"trim(regexp_replace(replace(lower(regexp_replace(note_raw, '\([^)]*\)', '', 'g')), '-', ' '), '[\s\p{Z}]+', ' ', 'g'))"
_MAP = "map AS (SELECT DISTINCT raw_token, lower(trim(canonical)) AS note FROM note_normalisation WHERE action IN ('KEEP', 'MERGE') AND canonical IS NOT NULL)"
_TYPED = f"typed AS (SELECT product_id, tier, {_TOKEN} AS raw_token FROM notes_long WHERE product_id IS NOT NULL)"
NOTES = f"{_MAP}, {_TYPED}, pn AS (SELECT DISTINCT t.product_id, m.note FROM typed t JOIN map m USING (raw_token))"
FAMILY = f"""{NOTES}, fam AS (SELECT product_id, cluster, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY product_id) AS share
  FROM pn JOIN taxonomy_map ON note = canonical_note GROUP BY 1, 2)"""


def membership(spark: SparkSession, folder: str) -> DataFrame:
    """product_id, cluster, share: how much of a product's notes is of each family; shares of a product add up to 1."""
    return prepared(spark, "membership", [f"{folder}/{t}.parquet" for t in ("notes_long", "note_normalisation", "taxonomy_map")], lambda: _membership(spark, folder))


def _membership(spark: SparkSession, folder: str) -> DataFrame:
    notes = product_notes(spark, folder)
    listed = small(table(spark, folder, "taxonomy_map").select(F.col("canonical_note").alias("note"), "cluster"))  # of fixed size
    counts = notes.join(listed, "note").groupBy("product_id", "cluster").agg(F.count(F.lit(1)).alias("_n"))
    # families are few, so a product has few rows here
    return counts.select("product_id", "cluster", (F.col("_n") / F.sum("_n").over(Window.partitionBy("product_id"))).alias("share"))


def _children(spark: SparkSession, folder: str) -> DataFrame:
    """Accords and claims of all records, from one parse."""

    def build() -> DataFrame:
        nodes = shred(latest(table(spark, folder, "perfumes"), "id", "scraped_at", "record"), "id", "record", RECORD).nodes
        held = {"name": "string", "strength": "bigint", "text": "string", "up_votes": "bigint", "down_votes": "bigint"}
        rows = nodes.where(F.col("type").isin("accord", "claim") & is_object(F.col("v")))
        return rows.select(F.col("key").alias("product_id"), "type", "place", *[F.try_variant_get("v", json_path((n,)), t).alias(n) for n, t in held.items()])

    return prepared(spark, "children", [f"{folder}/perfumes.parquet"], build)


def accords(spark: SparkSession, folder: str) -> DataFrame:
    """product_id, accord, strength."""
    return _children(spark, folder).where("type = 'accord' AND name IS NOT NULL").select("product_id", F.col("name").alias("accord"), "strength")


ACCORDS = """acc AS (SELECT product_id, el->>'$.name' AS accord, TRY_CAST(el->>'$.strength' AS BIGINT) AS strength FROM (
  SELECT product_id, unnest(CASE json_type(r, '$.accords') WHEN 'ARRAY' THEN json_extract(r, '$.accords[*]') WHEN 'OBJECT' THEN [json_extract(r, '$.accords')] ELSE [] END) AS el FROM j)
  WHERE json_type(el) = 'OBJECT' AND el->>'$.name' IS NOT NULL)"""


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """product_id, polarity, text, up_votes, down_votes."""
    return _children(spark, folder).where("type = 'claim'").select("product_id", F.element_at(F.split("place", r"\."), 2).alias("polarity"), "text", "up_votes", "down_votes")


CLAIMS = f"""nodes AS ({_NODES}), claims AS (SELECT product_id, split_part(path, '.', 2) AS polarity, val AS text,
  TRY_CAST(el->>'$.up_votes' AS BIGINT) AS up_votes, TRY_CAST(el->>'$.down_votes' AS BIGINT) AS down_votes FROM nodes WHERE path LIKE 'ai_summary.%')"""

_PRODUCT_COLUMNS = ["product_id", "brand", "year", "gender", "people", "rating_average", *RELATION, *SEASONS, "n_notes", "has_votes", "has_ai_summary", "in_population"]


@R.query("flat_products", f"{PRODUCTS} SELECT * FROM products")
def flat_products(spark, folder):
    """Records as wide rows (nested access, vote groups nulled, flags)."""
    return products(spark, folder).select(*_PRODUCT_COLUMNS)


@R.query("jsonl_scan", "SELECT count(*) AS n_rows, (count(*) FILTER (NOT json_valid(record))) AS n_bad FROM perfumes WHERE record IS NOT NULL AND trim(record) <> ''")
def jsonl_scan(spark, folder):
    """JSON lines read back from text, bad lines counted."""
    path = new_path(spark)
    table(spark, folder, "perfumes").select(F.regexp_replace("record", r"[\r\n]", " ").alias("value")).where("value IS NOT NULL AND trim(value) <> ''").write.text(path)
    rows = materialise(read_json_lines(spark, path, "id STRING"))  # Spark refuses a query of the bad lines alone on the raw file
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("n_bad"))


@R.query(
    "population_funnel",
    f"""{PRODUCTS}, c AS (SELECT count(*) AS a, count(*) FILTER (n_notes >= 1) AS b, count(*) FILTER (n_notes >= 1 AND year BETWEEN 1990 AND 2025) AS d, count(*) FILTER (in_population) AS e FROM products)
SELECT 'all' AS step, a AS n_left, 0::BIGINT AS n_dropped FROM c UNION ALL SELECT 'notes', b, a - b FROM c UNION ALL SELECT 'year', d, b - d FROM c UNION ALL SELECT 'people', e, d - e FROM c""",
)
def population_funnel(spark, folder):
    """Products left after each condition of the population."""
    return profile.funnel(products(spark, folder), {"notes": F.col("n_notes") >= 1, "year": F.col("year").between(*YEARS), "people": F.col("people") >= PEOPLE})


@R.query(
    "threshold_table",
    f"""{PRODUCTS} SELECT threshold, count(*) AS n_rows, count(DISTINCT brand) AS n_brands, round(avg(n_notes), 6) AS mean_notes, count(*) FILTER (has_ai_summary) AS n_summaries
FROM products JOIN (SELECT unnest([10, 25, 50, 100, 200])::INT AS threshold) ON people >= threshold GROUP BY 1""",
)
def threshold_table(spark, folder):
    """What is left at several least numbers of people."""
    measures = {"n_brands": F.countDistinct("brand"), "mean_notes": F.round(F.avg("n_notes"), 6), "n_summaries": F.count_if("has_ai_summary")}
    return profile.thresholds(products(spark, folder), "people", (10, 25, 50, 100, 200), measures)


_FIELDS = {"brand": "brand IS NOT NULL", "year": "year IS NOT NULL", "gender": "gender IS NOT NULL", "people": "people IS NOT NULL", "rating": "rating_average IS NOT NULL", "relation": "have IS NOT NULL OR had IS NOT NULL OR want IS NOT NULL", "all_seasons": "winter IS NOT NULL AND spring IS NOT NULL AND summer IS NOT NULL AND autumn IS NOT NULL", "notes": "n_notes > 0", "summary": "has_ai_summary"}


@R.query(
    "field_coverage",
    f"{PRODUCTS} " + " UNION ALL ".join(f"SELECT '{n}' AS field, count(*) FILTER ({c}) AS n_present, count(*) AS n_rows, round(100.0::DOUBLE * count(*) FILTER ({c}) / count(*), 6) AS pct FROM products" for n, c in _FIELDS.items()),
)
def field_coverage(spark, folder):
    """How many records have each field."""
    return profile.coverage(products(spark, folder), {n: F.expr(c) for n, c in _FIELDS.items()}).withColumn("pct", F.round("pct", 6))


@R.query("null_report", f"{PRODUCTS} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null FROM products" for c in _PRODUCT_COLUMNS))
def null_report(spark, folder):
    """Nulls of each column."""
    return profile.null_counts(products(spark, folder), _PRODUCT_COLUMNS)


@R.query(
    "viability_gate",
    f"""{PRODUCTS}, m AS (SELECT count(*) >= 1000 AS a, avg((year IS NOT NULL)::INT) >= 0.5 AS b, avg(has_votes::INT) >= 0.99 AS c, avg(n_notes) >= 4 AS d, avg(has_ai_summary::INT) >= 0.9 AS e FROM products)
SELECT CASE WHEN a AND b AND c AND d AND e THEN 'VIABLE' ELSE 'ISSUES' END AS verdict,
  concat_ws(', ', CASE WHEN NOT a THEN 'rows' END, CASE WHEN NOT b THEN 'years' END, CASE WHEN NOT c THEN 'votes' END, CASE WHEN NOT d THEN 'notes' END, CASE WHEN NOT e THEN 'summaries' END) AS issues FROM m""",
)
def viability_gate(spark, folder):
    """Whether the data carry the analyses: five rules over one row of means."""
    share = lambda c: F.avg(c.cast("int"))
    row = products(spark, folder).agg(F.count(F.lit(1)).alias("n"), share(F.col("year").isNotNull()).alias("y"), share(F.col("has_votes")).alias("v"), F.avg("n_notes").alias("m"), share(F.col("has_ai_summary")).alias("s"))
    return profile.gate(row, {"rows": F.col("n") >= 1000, "years": F.col("y") >= 0.5, "votes": F.col("v") >= 0.99, "notes": F.col("m") >= 4, "summaries": F.col("s") >= 0.9})


@R.query("year_histogram", f"{PRODUCTS} SELECT year, count(*) AS n_products FROM products WHERE year > 1900 AND year < 2030 GROUP BY 1")
def year_histogram(spark, folder):
    """Products a year."""
    return products(spark, folder).where("year > 1900 AND year < 2030").groupBy("year").agg(F.count(F.lit(1)).alias("n_products"))


@R.query(
    "percentile_nearest_rank",
    f"""{PRODUCTS}, o AS (SELECT n_notes, row_number() OVER (ORDER BY n_notes) - 1 AS k, count(*) OVER () AS n FROM products)
SELECT share, n_notes FROM o, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS share) WHERE k = floor(n * share)""",
)
def percentile_nearest_rank(spark, folder):
    """p10, upper median and p90 of the number of notes."""
    return nearest_rank(products(spark, folder).select("n_notes"), "n_notes", (0.1, 0.5, 0.9))


@R.query(
    "word_counts",
    r"""SELECT word, count(*) AS n FROM (SELECT regexp_replace(lower(unnest(regexp_split_to_array(text, '[ \t\n\r]+'))), '^[^a-z]+|[^a-z]+$', '', 'g') AS word FROM documents WHERE text IS NOT NULL)
WHERE length(word) > 3 GROUP BY 1 ORDER BY n DESC, word LIMIT 50""",
)
def word_counts(spark, folder):
    """Most frequent words of more than three letters."""
    words = table(spark, folder, "documents").select(F.explode(F.split("text", r"[ \t\n\r]+")).alias("w")).select(F.regexp_replace(F.lower("w"), "^[^a-z]+|[^a-z]+$", "").alias("word"))
    return words.where(F.length("word") > 3).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


@R.query("normalise_tokens", f"SELECT note_raw, {_TOKEN} AS token FROM (SELECT DISTINCT note_raw FROM notes_long WHERE note_raw IS NOT NULL)")
def normalise_tokens(spark, folder):
    """Typed notes as tokens."""
    return table(spark, folder, "notes_long").select("note_raw").where("note_raw IS NOT NULL").distinct().withColumn("token", token(F.col("note_raw")))


@R.query(
    "glosses",
    r"""SELECT DISTINCT note_raw, nullif(trim(regexp_replace(replace(lower(regexp_extract(note_raw, '\(([^)]*)\)', 1)), '-', ' '), '[\s\p{Z}]+', ' ', 'g')), '') AS gloss FROM notes_long WHERE note_raw LIKE '%(%'""",
)
def glosses(spark, folder):
    """First bracketed gloss of typed notes."""
    return table(spark, folder, "notes_long").select("note_raw").where("note_raw LIKE '%(%'").distinct().withColumn("gloss", gloss(F.col("note_raw")))


@R.query("token_products", f"WITH {_TYPED} SELECT raw_token, count(DISTINCT product_id) AS n_products FROM typed WHERE raw_token <> '' GROUP BY 1 HAVING count(DISTINCT product_id) >= 5")
def token_products(spark, folder):
    """Tokens in at least five products."""
    rows = table(spark, folder, "notes_long").where("product_id IS NOT NULL").select("product_id", token(F.col("note_raw")).alias("raw_token")).where("raw_token <> ''")
    return rows.groupBy("raw_token").agg(F.countDistinct("product_id").alias("n_products")).where("n_products >= 5")


@R.query("placeholder_tokens", f"WITH {_TYPED} SELECT raw_token, count(*) AS n FROM typed WHERE regexp_matches(raw_token, '{PLACEHOLDERS}') GROUP BY 1")
def placeholder_tokens(spark, folder):
    """Tokens that are no single note."""
    rows = table(spark, folder, "notes_long").where("product_id IS NOT NULL").select(token(F.col("note_raw")).alias("raw_token"))
    return rows.where(F.col("raw_token").rlike(PLACEHOLDERS)).groupBy("raw_token").agg(F.count(F.lit(1)).alias("n"))


@R.query("unmapped_tokens", f"WITH {_MAP}, {_TYPED} SELECT raw_token, count(*) AS n FROM typed ANTI JOIN map USING (raw_token) WHERE raw_token <> '' GROUP BY 1")
def unmapped_tokens(spark, folder):
    """Tokens that the map doesn't have: an anti-join."""
    rows = table(spark, folder, "notes_long").where("product_id IS NOT NULL").select(token(F.col("note_raw")).alias("raw_token")).where("raw_token <> ''")
    return rows.join(small(token_map(spark, folder)), "raw_token", "left_anti").groupBy("raw_token").agg(F.count(F.lit(1)).alias("n"))


@R.query("note_prevalence", f"WITH {NOTES} SELECT note, count(DISTINCT product_id) AS n_products FROM pn GROUP BY 1")
def note_prevalence(spark, folder):
    """Products of each canonical note."""
    return product_notes(spark, folder).groupBy("note").agg(F.count(F.lit(1)).alias("n_products"))


_TIER = "CASE tier WHEN 'top' THEN 0 WHEN 'middle' THEN 1 WHEN 'base' THEN 2 ELSE 3 END"


@R.query("best_tier", f"WITH {_MAP}, {_TYPED} SELECT product_id, note, min({_TIER})::INT AS tier_rank FROM typed JOIN map USING (raw_token) GROUP BY 1, 2")
def best_tier(spark, folder):
    """Each product's notes once, in the best tier they stand in."""
    ranks = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    rows = product_notes(spark, folder, ("tier",)).withColumn("tier_rank", F.coalesce(F.try_element_at(ranks, F.col("tier")), F.lit(3)))
    return top_per_group(rows, ["product_id", "note"], [F.asc("tier_rank")], 1).select("product_id", "note", "tier_rank")


@R.query("tier_weights", f"WITH {_MAP}, {_TYPED} SELECT product_id, note, max(1.0::DOUBLE / (1 + {_TIER})) AS weight FROM typed JOIN map USING (raw_token) GROUP BY 1, 2")
def tier_weights(spark, folder):
    """Greatest tier weight of each note of a product."""
    return _tier_weighted(spark, folder).groupBy("product_id", "note").agg(F.max("weight").alias("weight"))


def _tier_weighted(spark, folder):
    ranks = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    return product_notes(spark, folder, ("tier",)).withColumn("weight", 1.0 / (1 + F.coalesce(F.try_element_at(ranks, F.col("tier")), F.lit(3))))


@R.query(
    "tier_distribution",
    f"WITH {_MAP}, {_TYPED}, d AS (SELECT DISTINCT product_id, tier, note FROM typed JOIN map USING (raw_token) WHERE tier IN ('top', 'middle', 'base', 'flat')) SELECT note, round(100.0::DOUBLE * count(*) FILTER (tier = 'top') / count(*), 6) AS pct_top, round(100.0::DOUBLE * count(*) FILTER (tier = 'middle') / count(*), 6) AS pct_middle, round(100.0::DOUBLE * count(*) FILTER (tier = 'base') / count(*), 6) AS pct_base, round(100.0::DOUBLE * count(*) FILTER (tier = 'flat') / count(*), 6) AS pct_flat FROM d GROUP BY 1",
)
def tier_distribution(spark, folder):
    """Share of each tier among a note's rows: a pivot over known values."""
    wide = product_notes(spark, folder, ("tier",)).where(F.col("tier").isin(list(TIERS))).groupBy("note").pivot("tier", list(TIERS)).count().na.fill(0)
    total = sum((F.col(t) for t in TIERS), F.lit(0))
    return wide.select("note", *[F.round(100.0 * F.col(t) / total, 6).alias(f"pct_{t}") for t in TIERS])


@R.query("membership_shares", f"WITH {FAMILY} SELECT product_id, cluster, round(share, 6) AS share FROM fam")
def membership_shares(spark, folder):
    """Fractional family membership."""
    return membership(spark, folder).withColumn("share", F.round("share", 6))


@R.query("dominant_family", f"WITH {FAMILY} SELECT product_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY share DESC, cluster) AS k FROM fam) WHERE k = 1")
def dominant_family(spark, folder):
    """Family of the greatest share; of equals the smallest."""
    return top_per_group(membership(spark, folder), ["product_id"], [F.desc("share"), F.asc("cluster")], 1).select("product_id", "cluster")


@R.query(
    "family_top_notes",
    f"WITH {NOTES}, c AS (SELECT cluster, note, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, note) AS k FROM pn JOIN taxonomy_map ON note = canonical_note GROUP BY 1, 2) SELECT cluster, string_agg(note, ', ' ORDER BY k) AS top_notes FROM c WHERE k <= 5 GROUP BY 1",
)
def family_top_notes(spark, folder):
    """The five most frequent notes of each family as a string."""
    listed = small(table(spark, folder, "taxonomy_map").select(F.col("canonical_note").alias("note"), "cluster"))
    counts = product_notes(spark, folder).join(listed, "note").groupBy("cluster", "note").agg(F.count(F.lit(1)).alias("n"))
    return joined_top(counts, "cluster", "note", [F.desc("n"), F.asc("note")], 5, "top_notes")


@R.query(
    "note_examples",
    f"{PRODUCTS}, {NOTES} SELECT note, rank, product_id FROM (SELECT note, product_id, row_number() OVER (PARTITION BY note ORDER BY coalesce(have, 0) DESC, product_id)::INT AS rank FROM pn JOIN products USING (product_id)) WHERE rank <= 3",
)
def note_examples(spark, folder):
    """Most owned products of each note; unknown counts as 0."""
    rows = product_notes(spark, folder).join(products(spark, folder).select("product_id", F.coalesce("have", F.lit(0)).alias("have")), "product_id")
    return top_per_group(rows, ["note"], [F.desc("have"), F.asc("product_id")], 3).select("note", "rank", "product_id")


@R.query("average_ranks", "SELECT territory_id, rank() OVER (PARTITION BY run_id ORDER BY supply_share DESC) + (count(*) OVER (PARTITION BY run_id, supply_share) - 1) / 2.0::DOUBLE AS supply_rank FROM (SELECT DISTINCT run_id, territory_id, supply_share FROM territory_scores)")
def average_ranks(spark, folder):
    """Ranks in which equal values share the mean place."""
    rows = table(spark, folder, "territory_scores").select("run_id", "territory_id", "supply_share").distinct()
    return rows.select("territory_id", average_rank("supply_share", ["run_id"]).alias("supply_rank"))


@R.query("global_top", f"{PRODUCTS} SELECT product_id, people FROM products WHERE people IS NOT NULL ORDER BY people DESC, product_id LIMIT 20")
def global_top(spark, folder):
    """Twenty best known products."""
    return products(spark, folder).where("people IS NOT NULL").orderBy(F.desc("people"), "product_id").limit(20).select("product_id", "people")


@R.query(
    "subpopulation_means",
    f"{PRODUCTS} SELECT has_ai_summary, count(*) AS n, round(avg(people), 6) AS mean_people, round(avg(rating_average), 6) AS mean_rating, round(avg(n_notes), 6) AS mean_notes FROM products GROUP BY 1",
)
def subpopulation_means(spark, folder):
    """Products with a summary beside those without."""
    return products(spark, folder).groupBy("has_ai_summary").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{n}") for n, c in (("people", "people"), ("rating", "rating_average"), ("notes", "n_notes"))])


@R.query("action_counts", "SELECT action, count(*) AS n, count(DISTINCT raw_token) AS n_tokens FROM note_normalisation GROUP BY 1")
def action_counts(spark, folder):
    """Decisions by kind."""
    return table(spark, folder, "note_normalisation").groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("raw_token").alias("n_tokens"))


@R.query(
    "merge_groups",
    "SELECT note, count(*) AS n_members, string_agg(raw_token, ', ' ORDER BY raw_token) AS members, (row_number() OVER (ORDER BY count(*) DESC, note))::INT AS place FROM (SELECT DISTINCT raw_token, lower(trim(canonical)) AS note FROM note_normalisation WHERE action IN ('KEEP', 'MERGE') AND canonical IS NOT NULL) GROUP BY 1 HAVING count(*) > 1",
)
def merge_groups(spark, folder):
    """Canonical notes with all their spellings, the largest groups first."""
    groups = token_map(spark, folder).groupBy("note").agg(F.count(F.lit(1)).alias("n_members"), F.array_join(F.array_sort(F.collect_list("raw_token")), ", ").alias("members")).where("n_members > 1")
    return groups.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("n_members"), "note"))).orderBy("place")  # of a list of fixed size


@R.query(
    "group_size_stats",
    "SELECT round(avg(n), 6) AS mean_size, max(n) AS max_size, count(*) FILTER (n = 1) AS n_singletons FROM (SELECT cluster, count(*) AS n FROM taxonomy_map GROUP BY 1)",
)
def group_size_stats(spark, folder):
    """Sizes of the families."""
    sizes = table(spark, folder, "taxonomy_map").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("max_size"), F.count_if(F.col("n") == 1).alias("n_singletons"))


@R.query("json_props", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE props IS NOT NULL")
def json_props(spark, folder):
    """A member of a JSON column."""
    return table(spark, folder, "events").where("props IS NOT NULL").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@R.query(
    "note_documents",
    f"WITH {NOTES} SELECT note, '{{\"note\":\"' || note || '\",\"n\":' || count(*) || '}}' AS document FROM pn GROUP BY 1",
)
def note_documents(spark, folder):
    """One JSON document for each note."""
    counts = product_notes(spark, folder).groupBy("note").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("note", F.to_json(F.struct("note", "n")).alias("document"))
