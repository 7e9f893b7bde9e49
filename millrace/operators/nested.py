"""Nested records as related flat tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.runtime import BROADCAST_ROWS, at_most, materialise, require

_ELEMENTS = "array<struct<type:string,place:string,pos:int,v:variant>>"
#: Bits of the filter of keys that come more than once, where they are too many to broadcast: 32 MB.
FILTER_BITS = 1 << 28
VALUE, ONE, MANY = "value", "one", "many"


@dataclass(frozen=True)
class Member:
    """A member of an element type: a value of a Spark type, one element of a type, or many."""

    kind: str
    type: str


def value(type_: str = "string") -> Member:
    return Member(VALUE, type_)


def one(type_: str) -> Member:
    return Member(ONE, type_)


def many(type_: str) -> Member:
    return Member(MANY, type_)


@dataclass
class Plan:
    """Of one table: its inlined columns (name, path, type) and its child places (path, member)."""

    columns: list[tuple[str, tuple[str, ...], str]] = field(default_factory=list)
    children: list[tuple[tuple[str, ...], Member]] = field(default_factory=list)


class SchemaGraph:
    """Element types and what members they have; types may be shared and may refer to themselves."""

    def __init__(self, root: str, types: Mapping[str, Mapping[str, Member]]):
        self.root, self.types = root, {k: dict(v) for k, v in types.items()}
        for members in self.types.values():
            for m in members.values():
                if m.kind != VALUE and m.type not in self.types:
                    raise ValueError(f"unknown element type {m.type}")

    @classmethod
    def of(cls, schema: T.StructType, root: str = "record") -> SchemaGraph:
        """The graph of a Spark schema. Structs with the same fields are one shared type, named after where it stands first."""
        types: dict[str, dict[str, Member]] = {}
        names: dict[str, str] = {}

        def visit(s: T.StructType, name: str) -> str:
            shape = s.json()
            if shape in names:
                return names[shape]
            while name in types:
                name += "_"
            names[shape], types[name] = name, {}
            for f in s.fields:
                d = f.dataType
                if isinstance(d, T.StructType):
                    types[name][f.name] = one(visit(d, f.name))
                elif isinstance(d, T.ArrayType) and isinstance(d.elementType, T.StructType):
                    types[name][f.name] = many(visit(d.elementType, f.name))
                else:
                    types[name][f.name] = value(d.simpleString())
            return name

        return cls(visit(schema, root), types)

    def _edges(self) -> list[tuple[str, Member]]:
        return [(t, m) for t, members in self.types.items() for m in members.values() if m.kind != VALUE]

    def _recursive(self) -> set[str]:
        below = {t: {m.type for m in members.values() if m.kind != VALUE} for t, members in self.types.items()}
        reach = {t: set(s) for t, s in below.items()}
        for _ in self.types:
            for t in reach:
                reach[t] |= set().union(*[reach[s] for s in reach[t]]) if reach[t] else set()
        return {t for t in reach if t in reach[t]}

    def known(self) -> dict[str, dict[tuple[str, ...], list[str]]]:
        """Of each type with a table the members known of it and, by path, of the types inlined in it."""
        own, out = set(self.tables()), {}
        for t in own:
            out[t] = {}

            def visit(type_: str, path: tuple[str, ...], held: dict = out[t]) -> None:
                held[path] = sorted(self.types[type_])
                for name, m in self.types[type_].items():
                    if m.kind != VALUE and m.type not in own:
                        visit(m.type, (*path, name))

            visit(t, ())
        return out

    def tables(self) -> dict[str, Plan]:
        """Shared inlining: the root and every type that is repeated, shared or recursive has a table; the others are inlined in what holds them."""
        edges = self._edges()
        repeated = {m.type for _, m in edges if m.kind == MANY}
        shared = {t for t in self.types if sum(m.type == t for _, m in edges) > 1}
        own = {self.root} | repeated | shared | self._recursive()
        plans = {}
        for t in self.types:
            if t not in own:
                continue
            plan = Plan()

            def inline(type_: str, path: tuple[str, ...], plan: Plan = plan) -> None:
                for name, m in self.types[type_].items():
                    at = (*path, name)
                    if m.kind == VALUE:
                        plan.columns.append(("_".join(at), at, m.type))
                    elif m.type in own:
                        plan.children.append((at, m))
                    else:
                        inline(m.type, at)

            inline(t, ())
            plans[t] = plan
        return plans


@dataclass
class Shredded:
    """nodes: one row for each element of a table: key, type, place, pos, id, parent, v (its variant).

    key is the record's; id (place and position all the way from the root, empty for the root) is unique within the
    record, and parent is the id of the element that holds it: (key, parent) is the foreign key to (key, id).
    """

    nodes: DataFrame
    plans: dict[str, Plan]
    known: dict[str, dict[tuple[str, ...], list[str]]] = field(default_factory=dict)

    def rest(self) -> DataFrame:
        """Members that the graph doesn't know, of every object of a type: key, id, parent (the element that has them), place, pos, member, json."""
        out = []
        for type_, held in self.known.items():
            for path, names in held.items():
                out.append(F.when((F.col("type") == type_), _unknown(path, names)))
        members = F.flatten(F.filter(F.array(*out), lambda x: x.isNotNull()))
        rows = self.nodes.select("key", "id", "parent", "place", "pos", F.inline(members))
        return rows.select("key", F.col("id").alias("parent"), "place", "pos", "member", "json")

    def table(self, type_: str) -> DataFrame:
        """The flat table of a type: key, id, parent, place, pos and its inlined columns. Elements that aren't objects are in rejects."""
        rows = self.nodes.where((F.col("type") == type_) & is_object(F.col("v")))
        columns = [F.try_variant_get("v", json_path(path), kind).alias(_free(name)) for name, path, kind in self.plans[type_].columns]
        return rows.select("key", "id", "parent", "place", "pos", *columns)

    def rejects(self) -> DataFrame:
        """Elements that aren't objects, as JSON text; null for a JSON null."""
        return self.nodes.where(~is_object(F.col("v"))).select("key", "id", "parent", "place", "pos", F.when(~F.is_variant_null("v"), F.to_json("v")).alias("json"))


def _unknown(path: tuple[str, ...], names: list[str]) -> Column:
    """The members of the object at path whose names aren't listed, as (member, json); the member is named with its path."""
    held = F.map_filter(F.try_variant_get("v", json_path(path), "map<string,variant>"), lambda k, v: ~k.isin(names))
    pairs = F.transform(F.array_sort(F.map_keys(held)), lambda k: F.struct(F.concat(F.lit("".join(f"{p}." for p in path)), k).alias("member"), k.alias("_k")))
    return F.transform(pairs, lambda x: F.struct(x["member"].alias("member"), F.to_json(F.element_at(held, x["_k"])).alias("json")))


def _free(name: str) -> str:
    return name + "_" if name in ("key", "id", "parent", "place", "pos") else name


def json_path(path: tuple[str, ...]) -> str:
    return "$" + "".join(f"['{p}']" for p in path)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def latest(df: DataFrame, key: str, at: str, payload: str, broadcast_rows: int = 5 * BROADCAST_ROWS) -> DataFrame:
    """For each key its payload with the greatest at, of equals the greatest payload: columns key, payload.

    Few keys come more than once. Only those are looked up, in a set that is broadcast if a count proves it small, so the
    payloads of all others stay where they are. Of the keys that do, rows but the latest are dropped
    before the shuffle and equal ones merged in the task that reads them, so that a key with a third of all rows doesn't gather.
    Where the keys are too many for that, a filter of FILTER_BITS bits of their hashes is broadcast: rows whose bit isn't set stand
    once and stay where they are; the others, among them some that stand once, are merged by key.
    A null at is the earliest. Rows with a null key are left out.
    """
    src = require(df, [key, at, payload]).toDF("_k", "_at", "_p").where("_k IS NOT NULL")
    again = src.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.max("_at").alias("_last")).where("_n > 1").select("_k", "_last")
    again = materialise(again)
    if not at_most(again, broadcast_rows):  # two numbers a row
        return _latest_filtered(src, again).toDF(key, payload)
    again = F.broadcast(again)
    once = src.join(again.select("_k"), "_k", "left_anti").select("_k", "_p")
    more = src.join(again, "_k").where(F.col("_at").eqNullSafe(F.col("_last"))).groupBy("_k").agg(F.max("_p").alias("_p"))
    return once.unionByName(more).toDF(key, payload)


def _latest_filtered(src: DataFrame, again: DataFrame) -> DataFrame:
    bit = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS))
    # at most FILTER_BITS / 8 bytes
    held = again.select(bit("_k").alias("_b")).groupBy(F.bitmap_bucket_number("_b").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_bits"))
    held = F.broadcast(materialise(held))
    rows = src.withColumn("_bucket", F.bitmap_bucket_number(bit("_k"))).join(held, "_bucket", "left").withColumn("_at_bit", F.bitmap_bit_position(bit("_k")))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    seen = F.col("_bits").isNotNull() & (F.coalesce(byte, F.lit(0)).bitwiseAND(F.expr("shiftleft(1, cast(_at_bit % 8 as int))")) != 0)
    more = rows.where(seen).groupBy("_k").agg(F.max(F.struct("_at", "_p")).alias("_m")).select("_k", "_m._p")
    return rows.where(~seen).select("_k", "_p").unionByName(more)


def shred(df: DataFrame, key: str, record: str, graph: SchemaGraph, rest: bool = False) -> Shredded:
    """Records of JSON text as flat tables by shared inlining.

    Each text is parsed once, in one pass over df, and all elements of all repeated places come out of that
    pass; a further level of nesting is a pass over the elements of the level before it. Nothing is shuffled.
    Recursive types are followed as deep as the data go.

    A text that isn't valid JSON, or null, gives no rows. A missing or null member gives none below it. An object where
    an array is expected is its element 0. An element that isn't an object is kept in rejects. Members
    that the graph doesn't know are in Shredded.rest(); those of the record itself only if rest is set, as each record is then carried whole. A null key is kept.
    """
    plans = graph.tables()
    root = plans[graph.root]
    src = require(df, [key, record]).toDF("key", "_record")
    parsed = src.select("key", F.try_parse_json("_record").alias("v"))  # not filtered: a filter would parse once more
    own = F.struct(F.lit(graph.root).alias("type"), F.lit("").alias("place"), F.lit(0).alias("pos"), (F.col("v") if rest else _slim(root)).alias("v"))
    found = parsed.select("key", F.inline(F.concat(F.when(F.col("v").isNotNull(), F.array(own)).otherwise(F.array().cast(_ELEMENTS)), *[_elements(path, m) for path, m in root.children])))
    ids = F.when(F.col("place") == "", "").otherwise(F.concat("place", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    nodes = level = found.select("key", "type", "place", "pos", ids.alias("id"), F.when(F.col("place") != "", "").alias("parent"), "v")
    deeper = {t for t, p in plans.items() if p.children and t != graph.root}
    while deeper:
        level = materialise(level.where("place <> ''"))
        if level.where(F.col("type").isin(sorted(deeper))).isEmpty():
            break
        below = None
        for t in sorted(deeper):
            at = level.where(F.col("type") == t).select("key", F.col("id").alias("parent"), F.inline(F.concat(*[_elements(path, m) for path, m in plans[t].children])))
            at = at.select("key", "type", "place", "pos", F.concat("parent", F.lit("."), "place", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("id"), "parent", "v")
            below = at if below is None else below.unionByName(at)
        nodes, level = nodes.unionByName(below), below
    return Shredded(nodes, plans, graph.known())


def _slim(plan: Plan) -> Column:
    """The root with its inlined values alone, so that its row doesn't carry the whole record."""

    def build(columns: list, at: int) -> Column:
        members: dict[str, list] = {}
        for c in columns:
            members.setdefault(c[1][at], []).append(c)
        made = []
        for name, held in members.items():
            leaf = len(held[0][1]) == at + 1
            got = F.try_variant_get("v", json_path(held[0][1]), "variant") if leaf else build(held, at + 1)
            made.append(got.alias(name))
        return F.struct(*made)

    if not plan.columns:
        return F.try_parse_json(F.lit("{}"))
    return F.to_variant_object(build(plan.columns, 0))


def _elements(path: tuple[str, ...], member: Member) -> Column:
    at = json_path(path)
    single = F.when(F.try_variant_get("v", at, "map<string,variant>").isNotNull(), F.array(F.try_variant_get("v", at, "variant")))
    held = single if member.kind == ONE else F.coalesce(F.try_variant_get("v", at, "array<variant>"), single)
    held = F.coalesce(held, F.array().cast("array<variant>"))
    return F.transform(held, lambda x, i: F.struct(F.lit(member.type).alias("type"), F.lit(".".join(path)).alias("place"), i.alias("pos"), x.alias("v")))
