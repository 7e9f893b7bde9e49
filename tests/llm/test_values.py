"""Mapping of typed values, against brute force."""

import random

from millrace.llm.canon import canonical_values

ENTRIES = ["black water", "harsti wood", "harstie wood", "saemilt", "drepei kelp", "nethfil", "nethfil accord", "golden posflork moss", "ab"]
DECISIONS = [
    ("biaxdrael", " Saemilt ", "MERGE"), ("BIAXDRAEL", "drepei kelp", "REVIEW"), ("warm notes", None, "DROP_PLACEHOLDER"), ("old name", "not listed", "MERGE"),
    ("drepei kelp", "drepei kelp", "KEEP"), (None, "saemilt", "KEEP"), ("", None, "KEEP"), ("undecided", None, None),
]


def mapped(spark, values, entries=ENTRIES, decisions=DECISIONS):
    df = spark.createDataFrame([(v, "x") for v in values], "v string, canonical string")
    ref = spark.createDataFrame([(e,) for e in entries], "e string")
    dec = spark.createDataFrame(decisions, "r string, c string, a string") if decisions is not None else None
    rows = canonical_values(df, "v", ref, "e", dec, "r", "c", "a", ("REVIEW",)).collect()
    out = {x.value: x for x in rows}
    assert len(out) == len(rows)
    return out


def test_ways(spark):
    want = {
        "Black  Water": "black water", "black-water": "black water", "blackwater": "black water", "BLA​CK\xa0WATER": "black water", "blаck wаter": "black water", "bláck wäter": "black water",
        "b1ack water": "black water", "Water, Black": "black water", "black watre": "black water", "Black Water (organic)": "black water", "real black water": "black water",
        '"Black Water"': "black water", "black water #12": "black water", "black water 7%.": "black water", "black water type": "black water", "note of black water,": "black water",
        "harstie wood": "harstie wood", "Harsti Wood": "harsti wood", "harsti woood": "harsti wood", "NETHFIL ACCORDS": "nethfil accord", "nethfill": "nethfil", "golden posflrk mos": "golden posflork moss",
        "Biaxdrael": "saemilt", "warm notes": None, "Warm  Notes": None, "old name": None, "Casa Falnu base": None, "like drepei": None, "???": None, "12": None, "ac": None, "ab": "ab", "x" * 20_000: None,
        "undecided": None,
    }
    # additions count where the values show them with three entries
    for e in ("saemilt", "drepei kelp", "harsti wood"):
        want |= {f"{e} ({a})": e for a in ("organic", "lot 12")} | {f"{e} {a}": e for a in ("#7", "31%", "type")} | {f"{a} {e}": e for a in ("real", "note of")}
    got = mapped(spark, [*want, *want, None, "", "   "])
    assert {v: x.canonical for v, x in got.items()} == want
    assert got["Black Water (organic)"].how == "added"
    assert got["Biaxdrael"].how == "decision" and got["Water, Black"].how == "words" and got["black watre"].how == "near" and got["???"].how == "none"


def test_additions(spark):
    seen = ["rare saemilt", "rare nethfil", "saemilt wodd", "nethfil wodd", "drepei kelp wodd", "saemilt cold 7", "nethfil cold 88", "drepei kelp Cold 123", "nethfill cold 5", "77777 saemilt cold 1"]
    got = {v: x.canonical for v, x in mapped(spark, seen, decisions=None).items()}
    assert got["rare saemilt"] is None and got["rare nethfil"] is None  # with two entries only
    assert got["saemilt wodd"] is None  # like a word of an entry
    assert got["saemilt cold 7"] == "saemilt" and got["drepei kelp Cold 123"] == "drepei kelp" and got["nethfill cold 5"] == "nethfil"
    assert got["77777 saemilt cold 1"] is None  # no other value has a number before an entry


def test_long_values(spark):
    entries = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(80))]
    moved = " ".join(entries[0].split()[1:] + entries[0].split()[:1])
    got = {v: x.canonical for v, x in mapped(spark, [entries[0].upper(), moved, " ".join(entries[0].split()[:70])], entries, None).items()}
    assert list(got.values()).count(entries[0]) == 2 and got[moved] == entries[0]


def test_empty(spark):
    assert mapped(spark, []) == {}
    assert {v: x.canonical for v, x in mapped(spark, ["a b", None], entries=[], decisions=None).items()} == {"a b": None}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_near_is_complete(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    entries = sorted({word(rng.randrange(1, 15)) for _ in range(60)})
    values = []
    for _ in range(300):
        v = list(rng.choice(entries))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(v) + 1)
            op = rng.randrange(3)
            if op == 0:
                v.insert(at, rng.choice("abcd"))
            elif v and op == 1:
                del v[min(at, len(v) - 1)]
            elif v:
                v[min(at, len(v) - 1)] = rng.choice("abcd")
        values.append("".join(v) or "a")
    got = mapped(spark, values, entries, None)
    allowed = lambda e: 2 if len(e) >= 6 else 1 if len(e) >= 3 else 0
    for v in set(values):
        near = [(distance(v, e), e) for e in entries]
        near = sorted((d, e) for d, e in near if d <= allowed(e))
        assert (got[v].distance, got[v].canonical) == (near[0] if near else (None, None)), v
