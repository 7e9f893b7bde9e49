"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.canon import canonical_values
from millrace.llm.cooccur import cooccurrence
from millrace.llm.fusion import rank_fusion
from millrace.llm.mixing import mix_sources
from millrace.llm.pieces import oversized, split_texts
from millrace.llm.relevance import term_relevance
from millrace.llm.splits import pair_groups, related_splits
from millrace.llm.tokens import count_tokens, encode
from millrace.llm.topn import top_n
from millrace.plans import Registry, table

R = Registry()

SCORES = {"approval_demeaned": True, "desire_demeaned": True, "sentiment_polarity": True, "supply_share": False}
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def counted_notes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """product_id and the number of a counted note, a row each time it stands; the numbered notes, which follow their order.

    The reference list has a fixed size (hundreds of rows), so it is broadcast and numbered in one task.
    """
    listed = table(spark, folder, "taxonomy_map").select("canonical_note").where("canonical_note IS NOT NULL").distinct()
    listed = F.broadcast(listed.select(F.row_number().over(Window.orderBy("canonical_note")).alias("note"), "canonical_note"))
    notes = table(spark, folder, "notes_long").where("product_id IS NOT NULL AND note_raw IS NOT NULL")
    notes = notes.select("product_id", F.lower(F.trim("note_raw")).alias("canonical_note"))
    return notes.join(listed, "canonical_note").select("product_id", "note"), listed


_COUNTED = """
WITH counted AS (
  SELECT DISTINCT n.product_id, t.canonical_note AS note FROM notes_long n JOIN taxonomy_map t ON lower(trim(n.note_raw, ' ')) = t.canonical_note
  WHERE n.product_id IS NOT NULL
), total AS (SELECT count(DISTINCT product_id) AS n FROM counted),
one AS (SELECT note, count(*) AS n FROM counted GROUP BY note)
"""
_PAIRS = f"""{_COUNTED}, pair AS (
  SELECT a.note AS note_a, b.note AS note_b, count(*) AS c FROM counted a JOIN counted b ON a.product_id = b.product_id AND a.note < b.note GROUP BY 1, 2
)
"""
_JOINED = "FROM pair JOIN one a ON a.note = note_a JOIN one b ON b.note = note_b CROSS JOIN total t"


@R.query("p1_found", f"{_PAIRS} SELECT note_a, note_b {_JOINED} WHERE c >= 8 AND c::HUGEINT * t.n >= 4 * a.n::HUGEINT * b.n")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that stand together in at least eight products and four times as often as by chance."""
    return _named_pairs(spark, folder, 8, 4).select("note_a", "note_b")


@R.query("p1_lift", f"{_PAIRS} SELECT note_a, note_b, c AS n_both, a.n AS n_a, b.n AS n_b, t.n AS n_records, round(c::DOUBLE * t.n / (a.n::DOUBLE * b.n), 6) AS lift {_JOINED}")
def p1_lift(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of notes that stand together, with how much more often than by chance."""
    pairs = _named_pairs(spark, folder, 1, 0)
    return pairs.select("note_a", "note_b", "n_both", "n_a", "n_b", "n_records", F.round("lift", 6).alias("lift"))


def _named_pairs(spark: SparkSession, folder: str, count: int, lift: int) -> DataFrame:
    notes, listed = counted_notes(spark, folder)
    pairs = cooccurrence(notes, "product_id", "note", min_count=count, min_lift=lift)
    for side in "ab":
        pairs = pairs.join(F.broadcast(listed.select(F.col("note").alias(f"item_{side}"), F.col("canonical_note").alias(f"note_{side}"))), f"item_{side}")
    return pairs


@R.query(
    "p2_found",
    """WITH RECURSIVE tie AS (
  SELECT DISTINCT product_id AS a, related_id AS b FROM similar_pairs WHERE product_id <> related_id
  UNION SELECT related_id, product_id FROM similar_pairs WHERE product_id <> related_id
), reach AS (SELECT a AS id, a AS low FROM tie UNION SELECT t.b, r.low FROM reach r JOIN tie t ON t.a = r.id WHERE r.low < t.b)
SELECT min(low) AS group_id, id AS product_id FROM reach GROUP BY id HAVING min(low) <> id""",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every product that isn't the smallest of its group of products tied to one another."""
    groups = pair_groups(table(spark, folder, "similar_pairs"), "product_id", "related_id")
    return groups.where(F.col("entity") != F.col("group")).select(F.col("group").alias("group_id"), F.col("entity").alias("product_id"))


@R.query("p2_splits")
def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Products in train, validation and test, no tie between two of them, kinds of tie as even as can be."""
    split = related_splits(table(spark, folder, "similar_pairs"), "product_id", "related_id", "kind", SPLITS)
    return split.select(F.col("entity").alias("product_id"), F.col("group").alias("group_id"), "split")


def mapped_notes(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_values(
        table(spark, folder, "notes_long"), "note_raw", table(spark, folder, "taxonomy_map"), "canonical_note",
        table(spark, folder, "note_normalisation"), "raw_token", "canonical", "action", undecided=("REVIEW",),
    )


@R.query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each note as typed with the canonical note it means, or (none)."""
    listed = F.broadcast(table(spark, folder, "taxonomy_map").select(F.col("canonical_note").alias("value")).distinct())  # of fixed size
    mapped = mapped_notes(spark, folder).join(listed, "value", "left_anti")
    return mapped.select(F.col("value").alias("note_raw"), F.coalesce("canonical", F.lit("(none)")).alias("canonical_note"))


@R.query("p3_how")
def p3_how(spark: SparkSession, folder: str) -> DataFrame:
    """By which way values were mapped."""
    return mapped_notes(spark, folder).groupBy("how", "distance").agg(F.count(F.lit(1)).alias("n_values"))


_SCORES = f"""{_COUNTED}, len AS (SELECT product_id, count(*) AS l FROM counted GROUP BY 1), mean AS (SELECT avg(l) AS m FROM len)
SELECT c.product_id, c.note AS canonical_note, round(ln(1 + (t.n - o.n + 0.5::DOUBLE) / (o.n + 0.5::DOUBLE)) * (1.2::DOUBLE + 1) / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)), 6) AS score
FROM counted c JOIN one o ON o.note = c.note JOIN len ON len.product_id = c.product_id CROSS JOIN total t CROSS JOIN mean"""


def _note_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    notes, listed = counted_notes(spark, folder)
    return term_relevance(notes.distinct(), "product_id", "note"), listed


@R.query(
    "p5_found",
    f"{_COUNTED} SELECT product_id, canonical_note FROM (SELECT c.product_id, c.note AS canonical_note, row_number() OVER (PARTITION BY c.product_id ORDER BY o.n, c.note) AS k FROM counted c JOIN one o ON o.note = c.note) WHERE k = 1",
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each product's most characteristic note."""
    scores, listed = _note_scores(spark, folder)
    best = scores.groupBy("record").agg(F.min(F.struct((-F.col("score")).alias("s"), "df", "term")).alias("b"))
    return best.select(F.col("record").alias("product_id"), F.col("b.term").alias("note")).join(listed, "note").select("product_id", "canonical_note")


@R.query("p5_scores", _SCORES)
def p5_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How characteristic each note is of each product that has it."""
    scores, listed = _note_scores(spark, folder)
    return scores.select(F.col("record").alias("product_id"), F.col("term").alias("note"), F.round("score", 6).alias("score")).join(listed, "note").select("product_id", "canonical_note", "score")


@R.query(
    "p5_repeats",
    """WITH occ AS (SELECT n.product_id, t.canonical_note AS note, count(*) AS tf FROM notes_long n JOIN taxonomy_map t ON lower(trim(n.note_raw, ' ')) = t.canonical_note WHERE n.product_id IS NOT NULL GROUP BY 1, 2),
total AS (SELECT count(DISTINCT product_id) AS n FROM occ), one AS (SELECT note, count(*) AS n FROM occ GROUP BY note), len AS (SELECT product_id, sum(tf)::BIGINT AS l FROM occ GROUP BY 1), mean AS (SELECT avg(l) AS m FROM len)
SELECT occ.product_id, occ.note AS canonical_note, tf, round(ln(1 + (t.n - o.n + 0.5::DOUBLE) / (o.n + 0.5::DOUBLE)) * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)), 6) AS score
FROM occ JOIN one o ON o.note = occ.note JOIN len ON len.product_id = occ.product_id CROSS JOIN total t CROSS JOIN mean""",
)
def p5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """The scores if a note counts as often as it was typed for a product: its frequency saturates."""
    notes, listed = counted_notes(spark, folder)
    scores = term_relevance(notes, "product_id", "note")
    return scores.select(F.col("record").alias("product_id"), F.col("term").alias("note"), "tf", F.round("score", 6).alias("score")).join(listed, "note").select("product_id", "canonical_note", "tf", "score")


@R.query(
    "p6_found",
    """WITH best AS (SELECT product_id, neighbour_id, max(similarity) AS s FROM neighbours
  WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND product_id <> neighbour_id GROUP BY 1, 2)
SELECT product_id, place::INT AS place, neighbour_id FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY s DESC, neighbour_id) AS place FROM best) WHERE place <= 10""",
)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ten nearest neighbours of each product."""
    scored = table(spark, folder, "neighbours").where("neighbour_id <> product_id")
    return top_n(scored, "product_id", "similarity", ["neighbour_id"], 10).select("product_id", "place", "neighbour_id")


_FUSED = """WITH t AS (SELECT DISTINCT run_id, territory_id, approval_demeaned AS a, desire_demeaned AS b, CASE WHEN isnan(sentiment_polarity) THEN NULL ELSE sentiment_polarity END AS c, -supply_share AS d
  FROM territory_scores WHERE run_id IS NOT NULL AND territory_id IS NOT NULL),
r AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY run_id ORDER BY a DESC NULLS LAST)) END AS ra,
  CASE WHEN b IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY run_id ORDER BY b DESC NULLS LAST)) END AS rb,
  CASE WHEN c IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY run_id ORDER BY c DESC NULLS LAST)) END AS rc,
  CASE WHEN d IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY run_id ORDER BY d DESC NULLS LAST)) END AS rd FROM t),
p AS (SELECT run_id, territory_id, ra + rb + rc + rd AS fused FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY fused DESC, territory_id) AS place FROM p)
"""


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    return rank_fusion(table(spark, folder, "territory_scores"), "run_id", "territory_id", SCORES)


@R.query("p7_found", f"{_FUSED} SELECT run_id, territory_id FROM o WHERE place = 1")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The leading territory of each run."""
    return _fused(spark, folder).where("place = 1").select("run_id", "territory_id")


@R.query("p7_ranking", f"{_FUSED} SELECT run_id, territory_id, place, round(fused, 9) AS fused FROM o")
def p7_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """All territories of each run in one ranking."""
    return _fused(spark, folder).select("run_id", "territory_id", "place", F.round("fused", 9).alias("fused"))


@R.query("p8_ids")
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, folder, "documents"), "doc_id", "text")


@R.query("p8_counts")
def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of tokens of every document."""
    return count_tokens(table(spark, folder, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, folder: str):
    return mix_sources(table(spark, folder, "documents"), "doc_id", "text", "source", table(spark, folder, "mix_targets"))


@R.query("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose own documents can't fill their share, however often they are repeated."""
    return _mix(spark, folder).report.where("short").select("source")


@R.query("p9_shares")
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mix(spark, folder).report


@R.query("p9_mix")
def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used."""
    return _mix(spark, folder).documents.withColumnRenamed("id", "doc_id")


@R.query("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents above the limit."""
    return oversized(table(spark, folder, "documents"), "doc_id", "text").where("piece = 0").select("doc_id")


@R.query("p10_pieces")
def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in pieces."""
    return split_texts(table(spark, folder, "documents"), "doc_id", "text")
