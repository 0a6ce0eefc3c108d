from gleanwork.operators import folds, ledger


def test_refused_hits_do_not_count(spark):
    hits = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate([0, 1, 2, 3, 60, 61, 90, 119, 300])] + [("b", 99, 5.0)], "client string, seq long, at double")
    got = {r.seq: r.allowed for r in folds.rate_limited(hits, 3).collect()}
    # the first minute allows three; at its end they still weigh fully, then less and less
    assert [got[i] for i in range(9)] == [True, True, True, False, False, True, True, True, True] and got[99]


def test_adaptive_rate(spark):
    # starts at the ceiling, where successes leave it; two refusals, then ten successes raise it once
    rows = [("s", i, "ok") for i in range(12)] + [("s", 12, "429"), ("s", 13, "429")] + [("s", 14 + i, "ok") for i in range(10)] + [("s", 30 + i, "429") for i in range(12)]
    got = {r.seq: r.rate for r in folds.adaptive_rate(spark.createDataFrame(rows, "source string, seq long, status string")).collect()}
    assert got[11] == 8 and abs(got[13] - 3.92) < 1e-9 and abs(got[23] - 4.42) < 1e-9 and got[41] == folds.FLOOR


def test_startable(spark):
    queue = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "c", "y")], "seq long, client string, category string")
    running = spark.createDataFrame([("b", "x")], "client string, category string")
    assert sorted(r.seq for r in ledger.startable(queue, running, 3).collect()) == [1, 4]
    assert ledger.startable(queue, running, 1).count() == 0


def test_merge_cache(spark):
    kind = "key string, ts timestamp, value string"
    held = spark.createDataFrame([("k", None, "x")], kind).filter("ts is not null").unionByName(spark.sql("select 'a' key, timestamp'2026-01-09' ts, 'held' value"))
    loaded = spark.sql("select 'a' key, timestamp'2026-01-10' ts, 'new' value union all select 'b', timestamp'2026-01-08', 'b' union all select 'c', timestamp'2025-01-01', 'old'")
    assert sorted((r.key, r.value) for r in ledger.merge_cache(held, loaded, "2026-01-10 00:00:00").collect()) == [("a", "held"), ("b", "b")]
