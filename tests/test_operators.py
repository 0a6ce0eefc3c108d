import random

import pytest
from pyspark.sql import functions as F

from gleanwork.operators import dedup, ledger, planner, ranking, skew, summary

KEYS = "array<struct<rank:int,kind:string,key:string>>"


def sequential(rows):
    owned, out = set(), {}
    for seq, keys in sorted(rows):
        k = {(kind, key) for _, kind, key in keys}
        out[seq] = not (k & owned)
        if out[seq]:
            owned |= k
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, f"seq long, keys {KEYS}")
    return {r.seq: (r.accepted, r.duplicate_of) for r in dedup.greedy_unique(df, "seq", "keys").collect()}


def test_chain_keeps_third(spark):
    rows = [(1, [(3, "email", "x")]), (2, [(3, "email", "x"), (4, "phone", "y")]), (3, [(4, "phone", "y")]), (4, [(2, "name", "x")]), (5, [])]
    assert run(spark, rows) == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (True, None), 5: (True, None)}


def test_greedy_equals_sequential_rule(spark):
    rng = random.Random(5)
    rows = [(i, [(1 + j, "k%d" % j, str(rng.randrange(12))) for j in range(rng.randrange(4))]) for i in range(60)]
    assert {k: v[0] for k, v in run(spark, rows).items()} == sequential(rows)


def test_prefix_is_stable(spark):
    rng = random.Random(8)
    rows = [(i, [(1, "a", str(rng.randrange(9))), (2, "b", str(rng.randrange(9)))]) for i in range(30)]
    whole, part = run(spark, rows), run(spark, rows[:15])
    assert all(whole[k] == part[k] for k in part)


def test_greedy_on_nothing(spark):
    assert run(spark, []) == {}


def test_hot_keys_join_whole(spark):
    rows = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") % 500).cast("string")).alias("k"))
    groups = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    assert skew.join_group_facts(rows, groups, "k", "n", 30_000).count() == rows.filter("k is not null").count()
    facts = groups.select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("f"))
    assert skew.join_salted(rows, facts, "k", groups, "n", 30_000, most=500).count() == 2 * rows.filter("k is not null").count()


def test_positional_percentile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 10), ("b", None)], "g string, v int")
    assert [tuple(r) for r in ledger.positional_percentile(df, "g", "v", 0.95).collect()] == [("a", 3, 2)]


def test_moving_average(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.5), ("a", 3, 0.0)], "g string, seq int, v double")
    assert ledger.moving_average(df, "g", "seq", F.col("v")).first()["average"] == pytest.approx(0.375)


def test_failure_streaks(spark):
    df = spark.createDataFrame([(i, "c", s) for i, s in enumerate(["ok", "x", "x", "x", "ok", "x"])], "seq long, client string, status string")
    assert [r.streak for r in ledger.failure_streaks(df).orderBy("seq").collect()] == [0, 1, 2, 3, 0, 1]


def test_streaks_and_stalls_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ledger, "BLOCK", 4)
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice(["ok", "x", "x", "x"]), i * 50_000 + rng.randrange(100)) for i in range(80)]
    df = spark.createDataFrame(rows, "seq long, client string, status string, t long").withColumn("ts", F.timestamp_seconds("t"))
    streak, last, want, idle = {"a": 0, "b": 0}, {}, {}, {}
    for seq, c, status, t in rows:
        streak[c] = 0 if status == "ok" else streak[c] + 1
        want[seq] = streak[c]
        if c in last and t - last[c] > 60_000:
            idle[seq] = t - last[c]
        last[c] = t
    assert {r.seq: r.streak for r in ledger.failure_streaks(df).collect()} == want
    assert {r.seq: r.idle for r in ledger.stalls(df, 60_000).collect()} == idle
    recent = {r.seq: r.recent for r in ledger.restarts_allowed(df, "client", "ts", 5, 200_000).collect()}
    assert recent == {s: sum(1 for q, d, _, u in rows if d == c and t - 200_000 <= u <= t) for s, c, _, t in rows}


def test_merge_missing(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), (["a", "b", "c", "d"], ["e"]), (None, ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(dedup.merge_missing(F.col("a"), F.col("b"), 3)).collect()] == [["a", "b", "c"], ["a", "b", "c", "d"], ["x"]]


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "category string, email string, website string, phonenumber string, address string")
    found = spark.createDataFrame([], "category string, discovered long, duplicates long, failed_urls long")
    assert [r.category for r in summary.summary_with_total(empty, found).collect()] in ([], ["TOTAL"])


def test_numbers_and_eviction(spark):
    df = spark.createDataFrame([(i * 7919 % 101,) for i in range(101)], "v int").repartition(5)
    assert sorted((r.v, r.rank) for r in ranking.numbered(df, [F.col("v")]).collect()) == [(i, i + 1) for i in range(101)]
    assert ranking.numbered(df.limit(0), [F.col("v")]).count() == 0
    assert sorted(r.v for r in ledger.evict_oldest(df, ["v"], 50, 4).collect()) == list(range(25, 101))
    assert ledger.evict_oldest(df, ["v"], 200, 4).count() == 101


def test_no_best_cell_is_missed(spark):
    rng = random.Random(4)
    rows = [(i, "places", f"p{rng.randrange(9)} in town{rng.randrange(7)}", 1, "api", 1, 10, rng.randrange(11)) for i in range(45)]
    log = spark.createDataFrame(rows, "seq long, kind string, query string, page int, source string, credits int, results int, new_results int")
    quality = {r.phrase: round(r.quality, 6) for r in planner.phrase_quality(log).collect()}
    fresh = {r.place: round(r.freshness, 6) for r in planner.place_freshness(log).collect()} | {"never been": planner.UNTRIED}
    tried = {tuple(X.split("@")) for X in (f"{q.split(' in ')[0]}@{q.split(' in ')[1]}" for _, _, q, *_ in rows)}
    want = sorted(((-quality[p] * fresh[g], p, g) for p in quality for g in fresh if (p, g) not in tried and quality[p] * fresh[g] > planner.LEAST))[:12]
    places = spark.createDataFrame([("never been",), ("town1",)], "place string")
    assert [(r.phrase, r.place) for r in planner.next_cells(log, 12, None, places).collect()] == [(p, g) for _, p, g in want]


def test_new_phrases_keep_their_order(spark):
    phrases_ = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "phrase string, nr int")
    got = planner.new_phrases(phrases_, spark.createDataFrame([("a",)], "phrase string"), spark.createDataFrame([("c", 1)], "phrase string, searches int"))
    assert {r.phrase: round(r.quality, 4) for r in got.collect()} == {"b": 0.698, "c": 0.522}


def test_retries(spark):
    df = spark.sql("select 1 id, 0 attempt, timestamp'2026-01-01 00:00:00' failed_at union all select 2, 1, timestamp'2026-01-01 00:00:00' union all select 3, 2, timestamp'2026-01-01 00:00:00'")
    assert {r.id: r.state for r in planner.retries(df, F.lit("2026-01-01 00:00:06").cast("timestamp")).collect()} == {1: "due", 2: "waiting", 3: "failed"}


def test_claims_and_upserts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "ident string, seq int")
    assert sorted(r.seq for r in dedup.claimed(df, "ident", "seq", spark.createDataFrame([("b",)], "ident string")).collect()) == [1, 4]
    assert sorted(r.seq for r in dedup.last_wins(df, ["ident"], ["seq"]).collect()) == [2, 3, 4]
    assert sorted(r.seq for r in dedup.without_known(df, spark.createDataFrame([("a",), (None,)], "ident string"), "ident").collect()) == [3, 4]


def test_ordered_union(spark):
    a = spark.createDataFrame([("Tax", 1)], "k string, v int")
    b = spark.createDataFrame([("tax", 2), ("law", 3)], "k string, v int")
    assert sorted(tuple(r) for r in summary.ordered_union([a, b], "k").collect()) == [("Tax", 1), ("law", 3)]


def test_signature_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1")], "k string, s string")
    b = spark.createDataFrame([("y", "2"), ("z", "1")], "k string, s string")
    assert sorted(tuple(r) for r in summary.signature_diff(a, b, "k", "s").collect()) == [("x", "upsert"), ("y", "upsert"), ("z", "delete")]
