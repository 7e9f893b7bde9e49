import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.nested import SchemaGraph, latest, many, one, shred, value
from millrace.plans.records import RECORD, p4_found


def test_plan_inlines_and_shares():
    plans = RECORD.tables()
    assert set(plans) == {"record", "note", "claim", "tie", "accord"}
    assert ("relation_have", ("relation", "have"), "bigint") in plans["record"].columns
    assert [p for p, m in plans["record"].children if m.type == "note"] == [("notes", "tiered", "top"), ("notes", "tiered", "middle"), ("notes", "tiered", "base"), ("notes", "flat")]


def test_graph_of_a_schema():
    note = T.StructType([T.StructField("name", T.StringType())])
    schema = T.StructType([
        T.StructField("a", T.ArrayType(note)), T.StructField("b", T.StructType([T.StructField("c", T.ArrayType(note)), T.StructField("d", T.LongType())])), T.StructField("e", T.ArrayType(T.StringType())),
    ])
    plans = SchemaGraph.of(schema).tables()
    assert set(plans) == {"record", "a"}
    assert [(n, k) for n, _, k in plans["record"].columns] == [("b_d", "bigint"), ("e", "array<string>")]


def test_latest(spark):
    rows = [(1, 1, "a"), (1, 3, "b"), (1, 3, "b"), (1, 2, "c"), (2, None, "d"), (2, None, "e"), (3, None, "f"), (3, 1, None), (None, 9, "g"), (4, 1, "h")]
    got = latest(spark.createDataFrame(rows, "k long, t long, p string"), "k", "t", "p").collect()
    assert sorted((r.k, r.p) for r in got) == [(1, "b"), (2, "e"), (3, None), (4, "h")]


def test_latest_with_a_filter_of_keys(spark, monkeypatch):
    from millrace.operators import nested

    rows = [(k, t, f"{k}-{t}") for k in range(300) for t in range(1 + (k % 3 == 0))] + [(None, 1, "x"), (900, None, "a"), (900, None, "b"), (901, None, "c"), (901, 1, None)]
    df = spark.createDataFrame(rows, "k long, t long, p string")
    want = sorted(map(tuple, latest(df, "k", "t", "p").collect()))
    assert len(want) == 302
    for bits in (1 << 28, 1 << 6):  # with few bits most rows that stand once are taken along
        monkeypatch.setattr(nested, "FILTER_BITS", bits)
        assert sorted(map(tuple, latest(df, "k", "t", "p", broadcast_rows=0).collect())) == want
    assert latest(spark.createDataFrame([], "k long, t long, p string"), "k", "t", "p").count() == 0


def test_dirty_records(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    records = {
        1: {"id": 1, "notes": {"tiered": {"top": [{"name": "a"}, {"name": " "}, {"name": None}, 7, "x", [1], {"other": 1}, {"name": 5, "deep": {"q": [1]}}], "middle": {"name": "single"}, "base": None}, "flat": []}, "relation": {"have": 0, "had": None}},
        2: {"id": "2", "notes": None, "similar": {"reminds_me_of": [{"id": "33"}, {"id": None}, {"id": ""}, {"id": 4}], "also_liked": {"id": 5}}, "ai_summary": {"pros": [], "cons": [{"text": "t"}, None]}, "new": 1},
        3: "broken",
        4: [],
        5: {"notes": [], "relation": [], "ai_summary": 7, "similar": "x"},
    }
    rows = [(i, json.dumps(r) if i != 3 else '{"id": 3, "notes": {"flat": [{"name": "q"', at) for i, r in records.items()]
    rows += [(6, None, at), (7, "", at), (1, '{"notes": {"flat": [{"name": "old"}]}}', dt.datetime(2023, 1, 1)), (8, '{"notes": {"flat": [{"name": "gone"}]}}', at), (8, "not json", dt.datetime(2025, 1, 1)), (None, '{"relation": {"have": 1}}', at)]
    rows += [(9, '{"notes": {"flat": [{"name": "twice"}]}}', at)] * 2
    df = spark.createDataFrame(rows, "id long, record string, scraped_at timestamp").withColumn("key", F.lit("clash")).withColumn("v", F.lit(1))
    df.write.parquet(f"{tmp_path}/perfumes.parquet")
    got = sorted(tuple(r) for r in p4_found(spark, str(tmp_path)).select("product_id", "path", "pos").collect())
    assert got == sorted([
        (1, "notes.tiered.top", 0), (1, "notes.tiered.top", 7), (1, "notes.tiered.middle", 0), (1, "relation.have", 0), (2, "similar.reminds_me_of", 0), (2, "similar.reminds_me_of", 3),
        (2, "similar.also_liked", 0), (2, "ai_summary.cons", 0), (9, "notes.flat", 0),
    ])
    parts = shred(df.where("id = 1 AND scraped_at > '2023-06-01'"), "id", "record", RECORD)
    assert [r.name for r in parts.table("note").orderBy("place", "pos").collect()] == ["single", "a", " ", None, None, "5"]
    assert sorted(r.json for r in parts.rejects().collect()) == ['"x"', "7", "[1]"]
    assert parts.table("record").collect()[0].relation_have == 0


def test_recursive_and_nested(spark):
    graph = SchemaGraph("thread", {"thread": {"title": value(), "best": one("post"), "posts": many("post")}, "post": {"text": value(), "author": one("author"), "replies": many("post")}, "author": {"name": value()}})
    assert set(graph.tables()) == {"thread", "post"}
    leaf = {"text": "c", "author": {"name": "z"}}
    record = {"title": "t", "best": {"text": "best"}, "posts": [{"text": "a", "replies": [{"text": "b", "replies": [leaf]}, {"text": "b2"}]}]}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, "{}"), (3, None)], "k long, r string")
    parts = shred(df, "k", "r", graph)
    posts = {r.id: r for r in parts.table("post").collect()}
    assert {i: (r.parent, r.text) for i, r in posts.items()} == {
        "best[0]": ("", "best"), "posts[0]": ("", "a"), "posts[0].replies[0]": ("posts[0]", "b"), "posts[0].replies[1]": ("posts[0]", "b2"), "posts[0].replies[0].replies[0]": ("posts[0].replies[0]", "c"),
    }
    assert posts["posts[0].replies[0].replies[0]"].author_name == "z"
    assert sorted((r.key, r.title) for r in parts.table("thread").collect()) == [(1, "t"), (2, None)]
    assert shred(df.where("false"), "k", "r", graph).nodes.count() == 0


def test_rest_keeps_unknown_members(spark):
    records = [
        (1, json.dumps({"id": 1, "odd": {"x": [1]}, "notes": {"flat": [{"name": "a", "extra": True}, "text"], "why": None}, "relation": {"have": 1, "lost": 2}})),
        (2, json.dumps({"similar": {"also_liked": {"id": 5, "seen": "s"}}})), (3, "{bad"), (4, None), (5, "[1]"),
    ]
    df = spark.createDataFrame(records, "k long, r string")
    got = {(x.key, x.parent, x.member, x.json) for x in shred(df, "k", "r", RECORD, rest=True).rest().collect()}
    assert got == {
        (1, "", "odd", '{"x":[1]}'), (1, "", "notes.why", "null"), (1, "", "relation.lost", "2"), (1, "notes.flat[0]", "extra", "true"), (2, "similar.also_liked[0]", "seen", '"s"'),
    }
    # without it the records' own aren't carried, those of the elements are
    assert {x.member for x in shred(df, "k", "r", RECORD).rest().collect()} == {"extra", "seen"}
    assert shred(df.where("false"), "k", "r", RECORD, rest=True).rest().count() == 0


def test_products_parse_once(spark, tmp_path):
    from millrace.plans.catalogue import flattened

    rows = [(1, "r", "b", 2000, "g", 60, 7.0, json.dumps({"notes": {"flat": [{"name": "x"}, {"name": " "}]}, "relation": {"have": 0, "want": 0}}), i) for i in (1, 2)] + [(2, "r", None, None, None, None, None, "{", 1)]
    df = spark.createDataFrame(rows, "id long, slug string, brand string, year long, gender string, people long, rating_average double, record string, at long")
    df.withColumn("scraped_at", F.timestamp_seconds("at")).drop("at").write.parquet(str(tmp_path / "perfumes.parquet"))
    out = flattened(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2  # once in each branch: ids that stand once, ids that stand more often
    (row,) = out.collect()
    assert (row.product_id, row.n_notes, row.have, row.has_votes, row.in_population) == (1, 1, None, False, True)
