"""Mapping of freely typed values to a reference list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import folded, words
from millrace.runtime import materialise, require, small

#: Most edits between a value and a reference entry.
EDITS = 2
#: Different entries that words must have been found before, or after, to count as an addition to any entry.
SUPPORT = 3
#: Digits typed for letters, and the letters.
DIGIT_LETTERS = ("013457", "oieast")


def canonical_values(
    df: DataFrame,
    value: str,
    reference: DataFrame,
    entry: str,
    decisions: DataFrame | None = None,
    raw: str = "raw_token",
    decided: str = "canonical",
    decided_by: str | None = None,
    undecided: Sequence[str] = (),
    edits: int = EDITS,
    support: int = SUPPORT,
) -> DataFrame:
    """The reference entry that each distinct value means: columns value, canonical, how, distance.

    canonical is as written in the reference, or null for a value that means none. how is
    - decision: an earlier decision names it. decisions maps raw to decided (any writing of an entry; null
      means none). Rows whose decided_by is in undecided don't count. Of several decisions on one
      spelling, one that names an entry wins, then the smallest entry;
    - same: equal to an entry once case, accents, look-alike letters, invisible characters, separators and digits
      typed for letters are taken away;
    - words: the same words in another order;
    - added: an entry or decided spelling with additions before or after it;
    - near: the closest entry or decided spelling within the edits allowed, with or without additions: edits for those of at least
      3 * edits characters, half as many from half that length, none below. Of equals the value without
      additions goes first, then the entry before the decided spelling, then the smallest entry;
    - none: no entry is that close.

    Partition-based pigeonhole join: a reference string is cut in edits + 1 segments; of two strings within the
    edits one segment is unchanged and near its place, so values meet entries by equality on
    (length, segment number, substring) and only those are verified with levenshtein. All values go through that join, equal
    ones come out of it at distance 0. Values with no match are found by an anti-join.

    Additions (lot numbers, processes, claims) aren't listed anywhere: they are words, with any number standing for all numbers, that
    the values themselves show before, or after, at least support different entries and that aren't
    like a word of any entry. Null and blank values give no row. Equal values are one row however often they stand. An empty reference maps all to none.
    """
    values = require(df, [value]).toDF("_v").where("_v IS NOT NULL AND trim(_v) <> ''").distinct()
    lists = materialise(_reference(reference, entry, decisions, raw, decided, decided_by, undecided))
    forms = materialise(values.select("_v", words(_typed(folded(F.col("_v")))).alias("_w")))

    used = require(reference, [entry]).toDF("_e").select(F.explode(words(folded(F.col("_e")))).alias("_word")).distinct()
    cores = _cores(forms, lists, used, support, edits)
    asked = forms.select("_v", F.explode(_spellings(F.col("_w"), 0)).alias("_x")).unionByName(cores.select("_v", F.explode(_spellings(F.col("_core"), 2)).alias("_x")))
    asked = asked.groupBy("_v", F.col("_x.q").alias("_q")).agg(F.min("_x.level").alias("_level"))
    near = _near(asked, lists, edits)
    # words in another order are sought for what isn't equal to an entry
    bags = lists.where("_target IS NOT NULL").groupBy("_bag").agg(F.min("_target").alias("_target"))
    bagged = forms.select("_v", F.array_join(F.array_sort("_w"), " ").alias("_bag")).join(small(materialise(bags)), "_bag")
    bagged = bagged.select("_v", F.struct(F.lit(0).alias("_d"), F.lit(1).alias("_level"), F.lit(False).alias("_decided"), "_target").alias("_b"))
    best = near.unionByName(bagged).groupBy("_v").agg(F.min("_b").alias("_b")).select("_v", "_b.*")
    how = F.when(F.col("_d") > 0, "near").when(F.col("_level") >= 2, "added").when(F.col("_level") == 1, "words").when(F.col("_decided"), "decision").otherwise("same")
    found = materialise(best.select("_v", "_target", how.alias("_how"), F.col("_d").cast("int").alias("_d")))
    unmatched = values.join(found.select("_v"), "_v", "left_anti").select("_v", F.lit(None).cast("string").alias("_target"), F.lit("none").alias("_how"), F.lit(None).cast("int").alias("_d"))
    return found.unionByName(unmatched).select(F.col("_v").alias("value"), F.col("_target").alias("canonical"), F.col("_how").alias("how"), F.col("_d").alias("distance"))


def _typed(c: Column) -> Column:
    """Digits in words with letters as the letters that they stand for."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when(w.rlike("[a-z]"), F.translate(w, *DIGIT_LETTERS)).otherwise(w)), " ")


def _spellings(w: Column, level: int) -> Column:
    """The words put together, and with the first one last, each with its level: plain before turned."""
    turned = F.array_join(F.concat(F.slice(w, 2, F.greatest(F.lit(1), F.size(w))), F.slice(w, 1, 1)), "")
    return F.array(F.struct(F.array_join(w, "").alias("q"), F.lit(level).alias("level")), F.struct(turned.alias("q"), F.lit(level + 1).alias("level")))


def _reference(reference: DataFrame, entry: str, decisions: DataFrame | None, raw: str, decided: str, decided_by: str | None, undecided: Sequence[str]) -> DataFrame:
    """One row for each spelling: _key (compact), _bag (sorted words), _target, _decided."""
    key = lambda c: F.array_join(words(folded(F.col(c))), "")
    entries = require(reference, [entry]).toDF("_e").where("_e IS NOT NULL AND trim(_e) <> ''").distinct()
    own = entries.select(key("_e").alias("_key"), F.array_join(F.array_sort(words(folded(F.col("_e")))), " ").alias("_bag"), F.col("_e").alias("_target"), F.lit(False).alias("_decided"))
    own = own.groupBy("_key").agg(F.min_by("_bag", "_target").alias("_bag"), F.min("_target").alias("_target"), F.first("_decided").alias("_decided"))
    if decisions is None:
        return own.where("_key <> ''")
    made = require(decisions, [raw, decided] + [decided_by] * bool(decided_by)).toDF("_raw", "_to", *["_by"] * bool(decided_by)).where("_raw IS NOT NULL AND trim(_raw) <> ''")
    if decided_by:
        made = made.where(F.col("_by").isNull() | ~F.col("_by").isin(list(undecided)))
    made = made.select(key("_raw").alias("_key"), key("_to").alias("_to"), F.array_join(F.array_sort(words(folded(F.col("_raw")))), " ").alias("_bag"))
    named = made.join(own.select(F.col("_key").alias("_to"), "_target"), "_to", "left")
    # a decision for an entry that the reference doesn't have can't be followed
    named = named.where("_to IS NULL OR _target IS NOT NULL").groupBy("_key").agg(F.min("_bag").alias("_bag"), F.min("_target").alias("_target"))
    named = named.select("_key", "_bag", "_target", F.lit(True).alias("_decided"))
    return named.unionByName(own.join(named.select("_key"), "_key", "left_anti").select("_key", "_bag", "_target", "_decided")).where("_key <> ''")


def _cores(forms: DataFrame, lists: DataFrame, used: DataFrame, support: int, edits: int) -> DataFrame:
    """_v and _core, its words without the additions before and after them, for the values that have any.

    Every run of words of a value, no longer than the longest spelling, is sought among the spellings; what stands before and after
    the longest one found are its additions. Those seen with enough entries, in values that need not be alike, are taken off.
    """
    named = lists.where("_target IS NOT NULL")
    longest = named.agg(F.coalesce(F.max(F.size(F.split("_bag", " "))), F.lit(1)).alias("_longest"))
    size = F.size("_w")
    runs = forms.where(size > 1).crossJoin(F.broadcast(longest)).select("_v", "_w", "_longest", F.explode(F.sequence(F.lit(1), size)).alias("_at"))  # one row
    runs = runs.select("_v", "_w", "_at", F.explode(F.sequence(F.lit(1), F.least("_longest", size - F.col("_at") + 1))).alias("_n")).where(F.col("_n") < size)
    met = runs.select("_v", "_at", "_n", F.array_join(F.slice("_w", F.col("_at"), F.col("_n")), "").alias("_key")).join(small(named.select("_key", "_target")), "_key")
    met = met.groupBy("_v").agg(F.max(F.struct(F.length("_key").alias("l"), (-F.col("_at")).alias("a"), F.col("_n").alias("n"), F.col("_target").alias("t"))).alias("_m"))
    around = forms.join(met, "_v").select(F.col("_m.t").alias("_target"), F.explode(_around(-F.col("_m.a"), F.col("_m.n"))).alias("_x")).select("_target", "_x.*")
    seen = around.where("said <> ''").groupBy("before", "said").agg(F.countDistinct("_target").alias("_s")).where(F.col("_s") >= support)
    # words that are, or are like, those of an entry may tell entries apart
    told = materialise(seen.select("before", "said", F.explode(F.split("said", " ")).alias("_v")))
    alike = _near(told.select("_v", F.col("_v").alias("_q"), F.lit(0).alias("_level")).distinct(), used.select(F.col("_word").alias("_key"), F.col("_word").alias("_target"), F.lit(False).alias("_decided")), edits)
    owned = told.join(alike.select("_v").distinct(), "_v", "left_semi").select("before", "said").distinct()
    known = small(materialise(seen.join(owned, ["before", "said"], "left_anti").select("before", "said", F.size(F.split("said", " ")).alias("_words"))))

    most = known.agg(F.coalesce(F.max("_words"), F.lit(0)).alias("_most"))
    tried = forms.where(size > 1).crossJoin(F.broadcast(most)).where("_most > 0")  # one row
    tried = tried.select("_v", F.explode(F.sequence(F.lit(1), F.least("_most", size - 1))).alias("_n"), "_w")
    tried = tried.select("_v", F.explode(F.array(_side(True, F.slice("_w", 1, F.col("_n"))), _side(False, F.slice("_w", size - F.col("_n") + 1, F.col("_n"))))).alias("_x")).select("_v", "_x.*")
    off = tried.join(known, ["before", "said"]).groupBy("_v").agg(F.coalesce(F.max(F.when(F.col("before"), F.col("_words"))), F.lit(0)).alias("_p"), F.coalesce(F.max(F.when(~F.col("before"), F.col("_words"))), F.lit(0)).alias("_s"))
    cut = forms.join(off, "_v").where(F.col("_p") + F.col("_s") < size)
    return materialise(cut.select("_v", F.slice("_w", F.col("_p") + 1, size - F.col("_p") - F.col("_s")).alias("_core")))


def _side(before: bool, w: Column) -> Column:
    return F.struct(F.lit(before).alias("before"), F.array_join(F.transform(w, lambda x: F.regexp_replace(x, r"\p{N}+", "0")), " ").alias("said"))


def _around(at: Column, n: Column) -> Column:
    after = F.size("_w") - at - n + 1
    return F.array(_side(True, F.slice("_w", F.lit(1), at - 1)), _side(False, F.slice("_w", at + n, after)))


def _allowed(n: Column, edits: int) -> Column:
    return F.when(n >= 3 * edits, edits).when(n >= (3 * edits + 1) // 2, edits // 2).otherwise(0)


def _near(asked: DataFrame, lists: DataFrame, edits: int) -> DataFrame:
    """_v and _b, a struct of _d, _level, _decided and _target, for each spelling within the edits of what is asked (_v, _q, _level)."""
    parts = edits + 1
    # segment i of a string of n characters: the first parts - n mod parts have n div parts, the others one more
    n, base = F.length("_key"), F.floor(F.length("_key") / parts).cast("int")
    extra = n - base * parts
    from_start = lambda i: i * base + F.greatest(F.lit(0), i - (parts - extra))
    span = lambda i: base + F.when(F.lit(i) >= parts - extra, 1).otherwise(0)
    cut = F.array(*[F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring("_key", from_start(F.lit(i)) + 1, span(i)).alias("s")) for i in range(parts)])
    # too short to be cut: it allows no edits either and is one segment
    entire = F.array(F.struct(n.alias("n"), F.lit(-1).alias("i"), F.col("_key").alias("s")))
    segments = lists.select(F.col("_key").alias("_r"), "_target", "_decided", F.explode(F.when(n >= parts, cut).otherwise(entire)).alias("_x")).select("_r", "_target", "_decided", "_x.*")
    segments = small(materialise(segments))

    lengths = lists.agg(F.min(n).alias("_min"), F.max(n).alias("_max"))
    m = F.length("_q")
    # few bytes make many keys: an explicit number of partitions isn't put together by adaptive execution
    spread = asked.repartition(3 * asked.sparkSession.sparkContext.defaultParallelism, "_v", "_q")
    queries = spread.where(m >= 1).crossJoin(F.broadcast(lengths)).where((m >= F.col("_min") - edits) & (m <= F.col("_max") + edits)).drop("_min", "_max")  # one row
    short = queries.where(m < parts).select("_v", "_q", "_level", m.alias("n"), F.lit(-1).alias("i"), F.col("_q").alias("s"))
    queries = queries.where(m + edits >= parts).select("_v", "_q", "_level", F.explode(F.sequence(F.greatest(F.lit(parts), m - edits), m + edits)).alias("n"))
    keys = queries.select("_v", "_q", "_level", "n", F.explode(F.array(*[F.lit(i) for i in range(parts)])).alias("i"))
    base, delta = F.floor(F.col("n") / parts).cast("int"), F.length("_q") - F.col("n")
    extra = F.col("n") - base * parts
    at = F.col("i") * base + F.greatest(F.lit(0), F.col("i") - (parts - extra)) + 1
    size = base + F.when(F.col("i") >= parts - extra, 1).otherwise(0)
    # segment i moves by at most i edits before it, and by at most parts - 1 - i after it, counted from the end
    first = F.greatest(F.lit(1), at - F.col("i"), at + delta - (parts - 1 - F.col("i")))
    last = F.least(F.length("_q") - size + 1, at + F.col("i"), at + delta + (parts - 1 - F.col("i")))
    keys = keys.withColumn("_first", first).withColumn("_last", last).withColumn("_size", size).where("_first <= _last")
    keys = keys.select("_v", "_q", "_level", "n", "i", "_size", F.explode(F.sequence("_first", "_last")).alias("_p"))
    keys = keys.select("_v", "_q", "_level", "n", "i", F.substring(F.col("_q"), F.col("_p"), F.col("_size")).alias("s")).unionByName(short)

    d = F.levenshtein("_q", "_r", edits)
    close = keys.join(segments, ["n", "i", "s"]).select("_v", "_q", "_level", "_r", "_target", "_decided").distinct().withColumn("_d", d)
    close = close.where((F.col("_d") >= 0) & (F.col("_d") <= _allowed(F.length("_r"), edits)))
    return close.select("_v", F.struct(F.col("_d").cast("int").alias("_d"), "_level", "_decided", "_target").alias("_b"))
