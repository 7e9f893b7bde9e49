"""Nested perfume records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.nested import SchemaGraph, Shredded, latest, many, one, shred, value
from millrace.plans import Registry, table

R = Registry()

VOTES = {"up_votes": value("bigint"), "down_votes": value("bigint")}
RECORD = SchemaGraph(
    "record",
    {
        "record": {
            "id": value("bigint"), "name": value(), "brand": value(), "notes": one("notes"), "relation": one("relation"),
            "ai_summary": one("summary"), "similar": one("similar"), "accords": many("accord"), "seasons": one("seasons"),
        },
        "notes": {"tiered": one("tiered"), "flat": many("note")},
        "tiered": {"top": many("note"), "middle": many("note"), "base": many("note")},
        "note": {"name": value()},
        "relation": {"have": value("bigint"), "had": value("bigint"), "want": value("bigint")},
        "summary": {"pros": many("claim"), "cons": many("claim")},
        "claim": {"text": value(), **VOTES},
        "similar": {"reminds_me_of": many("tie"), "also_liked": many("tie")},
        "tie": {"id": value(), **VOTES},
        "accord": {"name": value(), "strength": value("bigint")},
        "seasons": {"winter": value("bigint"), "spring": value("bigint"), "summer": value("bigint"), "autumn": value("bigint")},
    },
)
#: The member that an element of each type must have.
NEEDED = {"note": "name", "claim": "text", "tie": "id"}


def shredded(spark: SparkSession, folder: str) -> Shredded:
    return shred(latest(table(spark, folder, "perfumes"), "id", "scraped_at", "record"), "id", "record", RECORD)


_LATEST = """
WITH last AS (SELECT id, max(scraped_at) AS scraped_at FROM perfumes WHERE id IS NOT NULL GROUP BY id),
rec AS (
  SELECT p.id AS product_id, max(p.record) AS record
  FROM perfumes p JOIN last l ON p.id = l.id AND p.scraped_at IS NOT DISTINCT FROM l.scraped_at GROUP BY p.id
),
j AS (SELECT product_id, record::JSON AS r FROM rec WHERE json_valid(record))
"""


def _places(path: str, member: str) -> str:
    dotted = "$." + path
    return f"""
SELECT product_id, '{path}' AS path, (pos)::INT AS pos, el, el->>'$.{member}' AS val FROM (
  SELECT product_id, unnest(range(len(a))) AS pos, unnest(a) AS el FROM (
    SELECT product_id, CASE json_type(r, '{dotted}') WHEN 'ARRAY' THEN json_extract(r, '{dotted}[*]') WHEN 'OBJECT' THEN [json_extract(r, '{dotted}')] ELSE [] END AS a FROM j))
WHERE json_type(el) = 'OBJECT'"""


_NODES = " UNION ALL ".join(
    _places(p, m)
    for p, m in (
        ("notes.tiered.top", "name"), ("notes.tiered.middle", "name"), ("notes.tiered.base", "name"), ("notes.flat", "name"),
        ("ai_summary.pros", "text"), ("ai_summary.cons", "text"), ("similar.reminds_me_of", "id"), ("similar.also_liked", "id"),
    )
)
_RELATION = " UNION ALL ".join(f"SELECT product_id, 'relation.{m}' AS path, 0 AS pos FROM j WHERE json_type(r, '$.relation.{m}') NOT IN ('NULL')" for m in ("have", "had", "want"))


@R.query(
    "p4_found",
    f"{_LATEST}, nodes AS ({_NODES}) SELECT product_id, path, pos FROM nodes WHERE val IS NOT NULL AND regexp_matches(val, '[^[:space:]]') UNION ALL {_RELATION}",
)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable element of the notes, claims and ties, and every relation count, with its place and position."""
    nodes = shredded(spark, folder).nodes
    held = F.coalesce(*[F.when(F.col("type") == t, F.try_variant_get("v", f"$['{m}']", "string")) for t, m in NEEDED.items()])
    usable = F.col("type").isin(list(NEEDED)) & held.isNotNull() & held.rlike(r"(?U)\S")
    counts = F.filter(
        F.array(*[F.struct(F.lit(f"relation.{m}").alias("path"), F.when(F.try_variant_get("v", f"$['relation']['{m}']", "string").isNotNull(), 0).alias("pos")) for m in ("have", "had", "want")]),
        lambda x: x["pos"].isNotNull(),
    )
    none = F.array().cast("array<struct<path:string,pos:int>>")
    rows = F.when(F.col("place") == "", counts).when(usable, F.array(F.struct(F.col("place").alias("path"), F.col("pos").cast("int").alias("pos")))).otherwise(none)
    return nodes.select(F.col("key").alias("product_id"), F.inline(rows))


@R.query(
    "p4_notes",
    f"{_LATEST}, nodes AS ({_NODES}) SELECT product_id, path || '[' || pos || ']' AS id, '' AS parent, path AS place, pos, val AS name FROM nodes WHERE path LIKE 'notes.%'",
)
def p4_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The shared table of notes from all four places, with its foreign key to the record."""
    return shredded(spark, folder).table("note").withColumnRenamed("key", "product_id")


@R.query(
    "p4_claims",
    f"""{_LATEST}, nodes AS ({_NODES}) SELECT product_id, path || '[' || pos || ']' AS id, '' AS parent, path AS place, pos, val AS text,
  TRY_CAST(el->>'$.up_votes' AS BIGINT) AS up_votes, TRY_CAST(el->>'$.down_votes' AS BIGINT) AS down_votes FROM nodes WHERE path LIKE 'ai_summary.%'""",
)
def p4_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The shared table of pros and cons."""
    return shredded(spark, folder).table("claim").withColumnRenamed("key", "product_id")


_REJECTED = " UNION ALL ".join(
    f"""SELECT product_id, '{p}[' || pos || ']' AS id, '' AS parent, '{p}' AS place, (pos)::INT AS pos, CASE WHEN json_type(el) <> 'NULL' THEN el::VARCHAR END AS json FROM (
  SELECT product_id, unnest(range(len(a))) AS pos, unnest(a) AS el FROM (SELECT product_id, json_extract(r, '$.{p}[*]') AS a FROM j WHERE json_type(r, '$.{p}') = 'ARRAY')) WHERE json_type(el) <> 'OBJECT'"""
    for p in ("notes.tiered.top", "notes.tiered.middle", "notes.tiered.base", "notes.flat", "ai_summary.pros", "ai_summary.cons", "similar.reminds_me_of", "similar.also_liked", "accords")
)


@R.query("p4_rejects", f"{_LATEST}, bad AS ({_REJECTED}) SELECT * FROM bad")
def p4_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Array elements that aren't the expected object."""
    return shredded(spark, folder).rejects().withColumnRenamed("key", "product_id")


@R.query(
    "p4_ties",
    f"""{_LATEST}, nodes AS ({_NODES}) SELECT product_id, path || '[' || pos || ']' AS id, '' AS parent, path AS place, pos, val AS id_,
  TRY_CAST(el->>'$.up_votes' AS BIGINT) AS up_votes, TRY_CAST(el->>'$.down_votes' AS BIGINT) AS down_votes FROM nodes WHERE path LIKE 'similar.%'""",
)
def p4_ties(spark: SparkSession, folder: str) -> DataFrame:
    """The shared table of similar products; id_ is the product that a tie names."""
    return shredded(spark, folder).table("tie").withColumnRenamed("key", "product_id")


_INLINED = ", ".join([f"TRY_CAST(r->>'$.relation.{m}' AS BIGINT) AS relation_{m}" for m in ("have", "had", "want")] + [f"TRY_CAST(r->>'$.seasons.{m}' AS BIGINT) AS seasons_{m}" for m in ("winter", "spring", "summer", "autumn")])


@R.query("p4_records", f"{_LATEST} SELECT product_id, '' AS id, NULL::VARCHAR AS parent, '' AS place, 0::INT AS pos, TRY_CAST(r->>'$.id' AS BIGINT) AS id_, r->>'$.name' AS name, r->>'$.brand' AS brand, {_INLINED} FROM j WHERE json_type(r) = 'OBJECT'")
def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """The root table, with the relation and the seasons inlined."""
    return shredded(spark, folder).table("record").withColumnRenamed("key", "product_id")


_KNOWN = {p: sorted(RECORD.types[t]) for p, t in (("", "record"), ("notes", "notes"), ("notes.tiered", "tiered"), ("relation", "relation"), ("ai_summary", "summary"), ("similar", "similar"), ("seasons", "seasons"))}
_ELEMENT = {"note": "notes.%", "claim": "ai_summary.%", "tie": "similar.%", "accord": "accords"}
_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_REST = " UNION ALL ".join(
    [f"SELECT product_id, '' AS parent, '{p}{'.' if p else ''}' || k AS member FROM (SELECT product_id, unnest(json_keys(r, '${'.' if p else ''}{p}')) AS k FROM j WHERE json_type(r, '${'.' if p else ''}{p}') = 'OBJECT') WHERE k NOT IN ({_LIST(n)})" for p, n in _KNOWN.items()]
    + [f"SELECT product_id, path || '[' || pos || ']', k FROM (SELECT product_id, path, pos, unnest(json_keys(el)) AS k FROM nodes WHERE path LIKE '{p}') WHERE k NOT IN ({_LIST(RECORD.types[t])})" for t, p in _ELEMENT.items()]
)


@R.query("p4_rest", f"{_LATEST}, nodes AS ({_NODES} UNION ALL {_places('accords', 'name')}), rest AS ({_REST}) SELECT * FROM rest")
def p4_rest(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the records and their elements that the graph doesn't know, with the element that has them."""
    rows = shred(latest(table(spark, folder, "perfumes"), "id", "scraped_at", "record"), "id", "record", RECORD, rest=True)
    return rows.rest().select(F.col("key").alias("product_id"), "parent", "member")
