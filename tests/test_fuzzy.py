import random

import pytest
from pyspark.sql import functions as F

from plumbline import scan
from plumbline.operators import fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_pairs(values, edits):
    order = sorted(set(values))
    return {(a, b): d for i, a in enumerate(order) for b in order[i + 1 :] if abs(len(a) - len(b)) <= edits and (d := distance(a, b)) <= edits}


def values_of(rng, n):
    roots = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 14))) for _ in range(12)]
    out = []
    for _ in range(n):
        word = list(rng.choice(roots))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(word))
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "x"])
        out.append("".join(word))
    return out


@pytest.mark.parametrize("edits,meetings", [(1, 1 << 14), (1, 4), (2, 1 << 14), (2, 4), (3, 20)])
def test_all_pairs(spark, monkeypatch, edits, meetings):
    """Short and long values; with few meetings allowed, most segments are keyed by their rests."""
    monkeypatch.setattr(fuzzy, "MEETINGS", meetings)
    values = values_of(random.Random(edits), 160)
    df = spark.createDataFrame([(v,) for v in [*values, None]], "value string")
    got = {(r.left, r.right): r.distance for r in fuzzy.fuzzy_pairs(df, edits).collect()}
    assert got == slow_pairs(values, edits)


def test_a_shared_beginning_does_not_bring_all_values_together(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "MEETINGS", 100)
    df = spark.range(3000).select(F.format_string("CUSTOMER#%09d", F.col("id") * 1017).alias("value"))
    entries = fuzzy._entries(df, 1)
    assert fuzzy._meetings(entries).count() > 1_000_000
    crowded = entries.groupBy("key").count().where("count > 200").select("key")
    assert fuzzy._meetings(fuzzy._rests(entries.join(crowded, "key", "left_semi"), 1)).count() < 20_000
    want = slow_pairs([f"CUSTOMER#{i * 1017:09d}" for i in range(300)], 1)
    few = fuzzy.fuzzy_pairs(df.where("value < 'CUSTOMER#000305100'"), 1)
    assert {(r.left, r.right): r.distance for r in few.collect()} == want


def test_groups_and_the_check(spark):
    rows = [("Smith", 1), ("smith ", 2), ("Smyth", 3), ("Smythe", 4), ("Jones", 5), ("Jonas", 6), ("Miller", 7), (None, 8), (None, 9), ("", 10), ("Q", 11), ("Zoë", 12)]
    df = spark.createDataFrame(rows, "name string, group int")
    got = {(r.value, r.rows, r.group) for r in fuzzy.fuzzy_groups(df, [F.col("name")], 1).collect()}
    assert got == {("SMITH", 2, "SMITH"), ("SMYTH", 1, "SMITH"), ("SMYTHE", 1, "SMITH"), ("JONES", 1, "JONAS"), ("JONAS", 1, "JONAS"), (None, 2, None), ("", 1, ""), ("Q", 1, "")}
    specs = [{"check_id": 7, "table": "t", "column": "name", "extra": {"max_edits": k}} for k in (0, 1, 2)]
    found = scan(spark, specs, {"t": df}).materialize().checks.orderBy("seq").collect()
    assert [r.metric_value for r in found] == [2.0, 4.0, 4.0] and not any(r.error for r in found)
    tuples = {(r.value, r.rows) for r in fuzzy.fuzzy_groups(df.where("group > 3"), [F.col("name"), F.lit("x")], 1).collect()}
    assert ("JONES\x1fX", 1) in tuples and ("\x1e\x1fX", 2) in tuples and ("MILLER\x1fX", 1) not in tuples


def test_nothing_is_broadcast(spark, monkeypatch):
    """Not even where the tables are small as files."""
    plans, kept = [], fuzzy.kept
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(fuzzy, "kept", lambda df: plans.append(plan_of(df)) or kept(df))
    monkeypatch.setattr(fuzzy, "MEETINGS", 4)
    df = spark.createDataFrame([(v,) for v in values_of(random.Random(1), 40)], "value string")
    plans.append(plan_of(fuzzy.fuzzy_groups(df, [F.col("value")], 1)))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_long_chains_and_nothing(spark):
    chain = spark.range(200).selectExpr("format_string('%04d', id) AS a", "format_string('%04d', id + 1) AS b")
    assert {r.group for r in fuzzy.connected(chain).collect()} == {"0000"} and fuzzy.connected(chain).count() == 201
    empty = spark.createDataFrame([], "name string")
    assert fuzzy.fuzzy_groups(empty, [F.col("name")], 2).count() == 0
    with pytest.raises(ValueError):
        fuzzy.fuzzy_pairs(empty.toDF("value"), 0)


def slow_groups(nodes, links):
    over = {n: n for n in nodes}
    top = lambda n: n if over[n] == n else top(over[n])
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        over[b] = a
    return {n: top(n) for n in nodes}


def long_values(rng, n):
    """Values of 25 to 45 characters in a few families, with some of the characters that the operator uses itself."""
    roots = ["".join(rng.choice("ab/é\x1c\x1d") for _ in range(rng.randint(25, 45))) for _ in range(3)]
    out = []
    for _ in range(n):
        word = list(rng.choice(roots))
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(word))
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "\x1c", "\x1d"])
        out.append("".join(word))
    return out


@pytest.mark.parametrize("edits,meetings,few,made", [(1, 4, 5, values_of), (2, 4, 5, values_of), (3, 4, 1 << 18, values_of), (2, 1 << 14, 5, values_of), (1, 2, 5, long_values), (2, 2, 1 << 18, long_values)])
def test_links_hold_together_what_all_pairs_do(spark, monkeypatch, edits, meetings, few, made):
    """Crowded keys are cut and spelled; links are within the edits, and groups are those of all pairs."""
    monkeypatch.setattr(fuzzy, "MEETINGS", meetings)
    monkeypatch.setattr(fuzzy, "FEW", few)
    values = sorted(set(made(random.Random(edits + 7), 110)))
    pairs = slow_pairs(values, edits)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, value string")
    links = {tuple(sorted((values[r.a], values[r.b]))) for r in fuzzy._links(df, edits).collect()}
    assert links <= set(pairs)
    assert slow_groups(values, links) == slow_groups(values, pairs)
    monkeypatch.setattr(fuzzy, "normalised", lambda parts: parts[0])
    got = {r.value: r.group for r in fuzzy.fuzzy_groups(df, [F.col("value")], edits).collect()}
    assert got == {v: g for v, g in slow_groups(values, pairs).items() if any(v in p for p in pairs)}


def test_groups_do_not_write_all_pairs(spark, monkeypatch):
    """3,600 values with 118 neighbours each: what is written grows with the values, not with their 212,400 pairs."""
    rows, kept = [], fuzzy.kept

    def counted(df):
        rows.append((out := kept(df)).count())
        return out

    monkeypatch.setattr(fuzzy, "kept", counted)
    letters = [chr(0x4E00 + i) for i in range(60)]
    df = spark.createDataFrame([(f"CUSTOMER#{a}{b}",) for a in letters for b in letters], "value string")
    got = fuzzy.fuzzy_groups(df, [F.col("value")], 1).agg(F.count_distinct("group"), F.min("group"), F.count("value")).first()
    assert tuple(got) == (1, f"CUSTOMER#{letters[0]}{letters[0]}", 3600) and max(rows) < 5 * 3600


def test_components_of_many_links(spark, monkeypatch):
    """Rounds of joins before the last links are left to one task."""
    monkeypatch.setattr(fuzzy, "FEW", 20)
    rng = random.Random(5)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + (i * 7) % 90) for i in range(90)]
    got = {r.node: r.group for r in fuzzy.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == slow_groups({n for a, b in links if a != b for n in (a, b)}, [(a, b) for a, b in links if a != b])
    chain = spark.range(200).selectExpr("format_string('%04d', id) AS a", "format_string('%04d', id + 1) AS b")
    assert {(r.group, r.n) for r in fuzzy.connected(chain).groupBy("group").agg(F.count("node").alias("n")).collect()} == {("0000", 201)}
