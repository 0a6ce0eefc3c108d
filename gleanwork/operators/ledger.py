"""What searches cost and brought: entries, totals, ratios and statistics for planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanwork.functions import text as X
from gleanwork.operators.ranking import without_first


def paid() -> Column:
    return F.col("source") == "api"


def _sum_if(condition: Column, col: str) -> Column:
    return F.sum(F.when(condition, F.coalesce(F.col(col), F.lit(0))).otherwise(0)).cast("long")


def entries(log: DataFrame) -> DataFrame:
    """One row for each search (kind, canonical query, page) with what its paid calls brought.

    Duplicates of a call are results that were not new, never fewer than none.
    """
    x = log.withColumn("key", X.ledger_key(F.col("kind"), F.col("query"), F.col("page"))).withColumn("dup", F.greatest(F.lit(0), F.coalesce("results", F.lit(0)) - F.coalesce("new_results", F.lit(0))))
    last = F.struct("ts", "seq")
    return x.groupBy("key").agg(
        F.count_if(paid()).alias("requests"), _sum_if(paid(), "credits").alias("credits"), _sum_if(paid(), "results").alias("results"), _sum_if(paid(), "new_results").alias("new_results"), _sum_if(paid(), "dup").alias("duplicates"),
        F.count_if(F.col("source") == "cache").alias("cache_hits"), _sum_if(F.lit(True), "timeouts").alias("timeouts"), F.max_by("seq", F.when(paid(), last)).alias("last_seq"),
    )


def totals(log: DataFrame, valid: DataFrame) -> DataFrame:
    """Totals for each kind and overall (kind 'all'), with ratios that are null without a denominator.

    ``valid`` has (seq, valid), the records that searches led to.
    """
    found = valid.groupBy("seq").agg(F.sum("valid").alias("valid"))
    api = log.filter(paid() & F.col("kind").isNotNull()).join(found, "seq", "left")
    t = api.rollup("kind").agg(F.count("*").alias("requests"), F.sum("credits").alias("credits"), F.sum("results").alias("results"), F.sum("new_results").alias("new_results"), F.sum(F.coalesce("valid", F.lit(0))).alias("valid"), F.grouping("kind").alias("all_kinds"))
    return t.select(
        F.when(F.col("all_kinds") == 1, "all").otherwise(F.col("kind")).alias("kind"), "requests", F.col("credits").cast("long").alias("credits"), "results", "new_results", (F.col("results") - F.col("new_results")).alias("duplicates"), "valid",
        F.round(F.try_divide("new_results", F.col("credits")), 2).alias("new_per_credit"), F.round(F.try_divide("valid", F.col("credits")), 2).alias("valid_per_credit"), F.round(F.try_divide("credits", F.col("valid")), 3).alias("credits_per_valid"),
        F.round(F.try_divide(100 * (F.col("results") - F.col("new_results")), "results"), 1).alias("repeat_percent"),
    )


def ranked_queries(log: DataFrame, valid: DataFrame, n: int = 10, best: bool = True) -> DataFrame:
    """The n searches with most valid records a credit, then new results, then first seen; or the exact reverse.

    ``valid`` has (seq, valid), the records that searches led to.
    """
    found = valid.groupBy("seq").agg(F.sum("valid").alias("valid"))
    q = log.filter(paid() & F.col("query").isNotNull()).withColumn("key", X.ledger_key(F.col("kind"), F.col("query"), F.col("page"))).join(found, "seq", "left")
    q = q.groupBy("key").agg(_sum_if(F.lit(True), "credits").alias("credits"), _sum_if(F.lit(True), "results").alias("results"), _sum_if(F.lit(True), "new_results").alias("new_results"), _sum_if(F.lit(True), "valid").alias("valid"), F.min("seq").alias("first_seq"))
    q = q.filter("credits > 0").withColumn("rate", F.col("valid") / F.col("credits"))
    order = [F.desc("rate"), F.desc("new_results"), F.asc("first_seq")] if best else [F.asc("rate"), F.asc("new_results"), F.desc("first_seq")]
    shown = [F.round("rate", 2).alias("valid_per_credit"), F.round(100 * F.try_divide(F.col("results") - F.col("new_results"), "results"), 1).alias("duplicate_percent")]
    return q.orderBy(*order).limit(n).select("key", "credits", "results", "new_results", "valid", "first_seq", *shown)


def moving_average(log: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    """(group, n, average): the first value, then half the old and half the new one, in order.

    The weights are powers of two over the row number, so the fold is a running rank, which streams
    through a group in order, and a sum that is aggregated in parts.
    """
    w = W.partitionBy(group).orderBy(F.desc(order))
    x = log.select(group, order, value.alias("v")).filter(F.col("v").isNotNull() & F.col(group).isNotNull()).withColumn("back", F.row_number().over(w) - 1)
    n = x.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("v") * F.pow(F.lit(0.5), F.col("back") + 1)).alias("s"), F.max_by("v", "back").alias("oldest"))
    return n.select(group, "n", (F.col("s") + F.col("oldest") * F.pow(F.lit(0.5), F.col("n"))).alias("average"))


def positional_percentile(df: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, n, value): the element at floor(share * (n - 1)) of the sorted values, without collecting them."""
    x = df.filter(F.col(value).isNotNull())
    counts = x.groupBy(group, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(group).orderBy(value)
    run = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(W.partitionBy(group)))
    hit = run.filter(F.col("upto") > F.floor(share * (F.col("n") - 1)))
    return hit.groupBy(group).agg(F.max("n").alias("n"), F.min(value).alias("at"))


#: Rows of a client are worked on in blocks of so many numbers, so that a client of many rows is not one task.
BLOCK = 1 << 16


def rolling(df: DataFrame, group: str, at: str, seconds: int, value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: an aggregate over the rows of the group in the ``seconds`` up to each row.

    A group is cut into spans of ``seconds``; a row is given to its own span and, as what came
    before, to the next, so that a group of many rows is spread by time. Rows without a time are left out.
    """
    t = F.col(at).cast("timestamp").cast("long")
    x = df.withColumn("_t", t).withColumn("_own", F.floor(F.col("_t") / seconds))
    both = x.withColumn("_span", F.explode(F.array("_own", F.col("_own") + 1)))
    w = W.partitionBy(group, "_span").orderBy("_t").rangeBetween(-seconds, 0)
    return both.withColumn(out, value.over(w)).filter("_span = _own").drop("_t", "_own", "_span")


def rolling_credits(log: DataFrame, hours: int = 24) -> DataFrame:
    """(seq, client, spent): credits of the client in the hours up to each paid request. Requests without a time are left out."""
    x = log.filter(paid() & F.col("client").isNotNull() & F.col("ts").isNotNull()).select("seq", "client", "ts", F.coalesce("credits", F.lit(0)).alias("credits"))
    return rolling(x, "client", "ts", hours * 3600, F.sum("credits"), "spent").select("seq", "client", F.col("spent").cast("long").alias("spent"))


def request_source(requests: DataFrame, now: str, cache_days: int = 7, executed_days: int = 30) -> DataFrame:
    """(key, source): where a repeated search is answered from at ``now``: the cache, the executed registry, or a new call."""
    keyed = requests.filter(paid()).withColumn("key", X.ledger_key(F.col("kind"), F.col("query"), F.col("page")))
    at = F.lit(now).cast("timestamp")
    last = keyed.groupBy("key").agg(F.max(F.col("ts").cast("timestamp")).alias("last"), F.sum(F.coalesce("credits", F.lit(0))).alias("credits"))
    age = lambda days: F.col("last") > at - F.expr(f"INTERVAL {days} DAYS")
    return last.select("key", F.when(age(cache_days), "cache").when(age(executed_days) & (F.col("credits") > 0), "executed").otherwise("api").alias("source"))


def failure_streaks(log: DataFrame) -> DataFrame:
    """(seq, streak, pause): failures in a row for a client up to each request, and the pause they call for.

    Streaks are counted within blocks; what a block ends with is added up over the blocks of a
    client and carried to the next, up to the block's first success.
    """
    x = log.filter(F.col("client").isNotNull()).select("seq", "client", F.coalesce((F.col("status") == "ok").cast("int"), F.lit(0)).alias("ok")).withColumn("block", F.floor(F.col("seq") / BLOCK))
    x = x.withColumn("island", F.sum("ok").over(W.partitionBy("client", "block").orderBy("seq")))
    s = x.withColumn("run", F.sum(1 - F.col("ok")).over(W.partitionBy("client", "block", "island").orderBy("seq")))
    ends = s.groupBy("client", "block").agg(F.max("ok").alias("ok"), F.max_by("run", "seq").alias("tail"))
    w = W.partitionBy("client").orderBy("block")
    since = ends.withColumn("part", F.sum("ok").over(w)).withColumn("upto", F.sum("tail").over(W.partitionBy("client", "part").orderBy("block")))
    carried = since.select("client", "block", F.coalesce(F.lag("upto").over(w), F.lit(0)).alias("carry"))
    y = s.join(carried, ["client", "block"]).withColumn("streak", F.col("run") + F.when(F.col("island") == 0, F.col("carry")).otherwise(0))
    pause = F.when(F.col("streak") >= 3, F.least(F.lit(30.0), 2 * F.pow(F.lit(2.0), F.least(F.lit(8), F.floor((F.col("streak") - 3) / 2))))).otherwise(0.0)
    return y.select("seq", F.col("streak").cast("long").alias("streak"), pause.alias("pause"))


def stalls(log: DataFrame, idle_seconds: int = 300) -> DataFrame:
    """(seq, idle): requests that came more than ``idle_seconds`` after the client's previous one.

    Requests are compared within days; the last one of each day is carried to the next with any.
    """
    t = F.col("ts").cast("timestamp").cast("long")
    x = log.filter("client is not null and ts is not null").select("seq", "client", "ts", t.alias("t")).withColumn("day", F.floor(F.col("t") / 86_400))
    days = x.groupBy("client", "day").agg(F.max("t").alias("last"))
    before = days.select("client", "day", F.lag("last").over(W.partitionBy("client").orderBy("day")).alias("before"))
    y = x.withColumn("same", F.lag("t").over(W.partitionBy("client", "day").orderBy("ts", "seq"))).join(before, ["client", "day"])
    return y.select("seq", (F.col("t") - F.coalesce("same", "before")).alias("idle")).filter(F.col("idle") > idle_seconds)


def dry_spells(log: DataFrame, last: int = 10, least: int = 5) -> DataFrame:
    """(seq): requests at which the client's last ones brought nothing new, once there are ``least``."""
    w = W.partitionBy("client").orderBy("seq").rowsBetween(-(last - 1), 0)
    x = log.filter("client is not null").select("seq", F.sum(F.coalesce("new_results", F.lit(0))).over(w).alias("s"), F.count("*").over(w).alias("n"))
    return x.filter((F.col("s") == 0) & (F.col("n") >= least)).select("seq")


def last_rows(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group, newest first, with the group's size, which is counted in parts."""
    last = df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))).filter(F.col("rank") <= n)
    return last.join(df.groupBy(group).agg(F.count("*").alias("total")), group)


def since(df: DataFrame, cursor: int, order: str = "seq", held: int = 300) -> DataFrame:
    """Rows after ``cursor`` with ``reset``: of the ``held`` newest ones all, if the cursor is older than they are."""
    newest = df.agg(F.max(order).alias("_newest"))
    x = df.join(F.broadcast(newest)).withColumn("reset", F.lit(cursor) < F.col("_newest") - held)
    return x.filter((F.col(order) > F.col("_newest") - held) & (F.col("reset") | (F.col(order) > cursor))).drop("_newest")


def restarts_allowed(events: DataFrame, group: str, at: str, most: int = 5, seconds: int = 600) -> DataFrame:
    """``events`` with ``recent``, those of the group in the last ``seconds``, and ``allowed``, whether they are few enough."""
    return rolling(events, group, at, seconds, F.count("*"), "recent").withColumn("allowed", F.col("recent") <= most)


def access_stats(events: DataFrame, group: str, value: str, failed: Column, throttled: Column, minutes: Column) -> DataFrame:
    """(group, minute, n, p50, p95, errors, throttled): the n // 2-th and floor(0.95 n)-th sorted value of each minute.

    Values are counted before they are ranked, so equal ones are one row; null values count as requests only.
    """
    x = events.withColumn("minute", minutes)
    totals_ = x.groupBy(group, "minute").agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.count_if(throttled).alias("throttled"))
    counts = x.filter(F.col(value).isNotNull()).groupBy(group, "minute", value).agg(F.count("*").alias("c"))
    w = W.partitionBy(group, "minute")
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("m", F.sum("c").over(w))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(share * F.col("m")), F.col(value)))
    marks = run.groupBy(group, "minute").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return totals_.join(marks, [group, "minute"], "left")


def timings(events: DataFrame, stage: str, millis: str) -> DataFrame:
    """(stage, count, total, average) of durations."""
    return events.filter(F.col(stage).isNotNull()).groupBy(stage).agg(F.count(millis).alias("count"), F.sum(millis).alias("total"), F.avg(millis).alias("average"))


def slowest(events: DataFrame, millis: str, ident: str, n: int = 10) -> DataFrame:
    """The n events that took longest, of equal ones the smaller id first."""
    return events.filter(F.col(millis).isNotNull()).orderBy(F.desc(millis), ident).limit(n)


def queue_summary(jobs: DataFrame) -> DataFrame:
    """(state, jobs, clients) of the jobs of each state."""
    return jobs.groupBy("state").agg(F.count("*").alias("jobs"), F.count_distinct("client").alias("clients"))


def run_rates(log: DataFrame) -> DataFrame:
    """(client, ...): requests and new results a minute between a client's first and last request, share of repeats and of successes."""
    t = F.col("ts").cast("timestamp").cast("double")
    x = log.filter("client is not null and ts is not null").groupBy("client").agg(
        F.count("*").alias("requests"), F.sum(F.coalesce("results", F.lit(0))).cast("long").alias("results"), F.sum(F.coalesce("new_results", F.lit(0))).cast("long").alias("new_results"),
        F.count_if(F.col("status") == "ok").alias("ok"), (F.max(t) - F.min(t)).alias("elapsed"),
    )
    minute = F.greatest(F.col("elapsed"), F.lit(0.001)) / 60
    rates = [F.round(F.col(c) / minute, 1).alias(f"{c}_per_minute") for c in ("requests", "new_results")]
    return x.select("client", "requests", "new_results", *rates, F.round(1 - F.try_divide("new_results", "results"), 3).alias("repeat_share"), F.round(F.col("ok") / F.col("requests"), 3).alias("success_share"))


def newest_version(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the highest version of each key, pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest]).select(*df.columns)


def rate_pressure(log: DataFrame, seconds: int = 60) -> DataFrame:
    """(client, minute, hits, pressure): requests of a window and, at its end, those that a sliding limit counts."""
    m = log.filter("client is not null and ts is not null").groupBy("client", F.floor(F.col("ts").cast("timestamp").cast("long") / seconds).alias("minute")).agg(F.count("*").alias("hits"))
    prev = F.lag("hits").over(W.partitionBy("client").orderBy("minute"))
    gap = F.col("minute") - F.lag("minute").over(W.partitionBy("client").orderBy("minute"))
    return m.select("client", "minute", "hits", (F.col("hits") + F.when(gap == 1, prev * 0.5).otherwise(0.0)).alias("pressure"))


def evict_oldest(df: DataFrame, order: list[str], most: int, part: int) -> DataFrame:
    """Without the oldest 1/part of the rows, if there are more than ``most``; numbered by ranges, not in one task."""
    total = df.count()
    return df if total <= most else without_first(df, [F.col(c) for c in order], total // part)


def run_metrics(log: DataFrame) -> DataFrame:
    """(client, ...): what a client's run cost and saved: paid, cached and skipped requests, ratios, timeouts."""
    new = F.sum(F.coalesce("new_results", F.lit(0)))
    return log.filter("client is not null").groupBy("client").agg(
        F.count("*").alias("requests"), F.count_if(paid()).alias("paid"), F.count_if(F.col("source") == "cache").alias("cached"), F.count_if(F.col("source") == "executed").alias("skipped"),
        _sum_if(paid(), "credits").alias("credits"), new.cast("long").alias("new_results"), _sum_if(F.lit(True), "timeouts").alias("timeouts"), F.count_if(F.col("status") != "ok").alias("failed"),
    ).withColumn("new_per_credit", F.round(F.try_divide("new_results", "credits"), 2))


def merge_cache(held: DataFrame, loaded: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Cache entries (key, ts, value) that are not older than ``days``; of one key what is held goes first."""
    fresh = lambda df, rank: df.filter(F.col("ts").cast("timestamp") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")).select("key", F.lit(rank).alias("rank"), "ts", "value")
    both = fresh(held, 0).unionByName(fresh(loaded, 1))
    return both.groupBy("key").agg(F.min_by(F.struct("ts", "value"), F.struct("rank", F.unix_micros(F.col("ts").cast("timestamp")) * -1)).alias("v")).select("key", "v.ts", "v.value")


def startable(queue: DataFrame, running: DataFrame, slots: int) -> DataFrame:
    """The queued jobs (seq, client, category) to start: first come, first served, over blocked ones.

    A job waits while one of its client and category runs or is queued before it; of the others
    as many start as there are free slots.
    """
    free = queue.join(running.select("client", "category").distinct(), ["client", "category"], "left_anti")
    first = free.groupBy("client", "category").agg(F.min("seq").alias("seq"))
    return first.orderBy("seq").limit(max(0, slots - running.count())).select("seq", "client", "category")


def fairness(log: DataFrame, group: str = "category", ahead: int = 2) -> DataFrame:
    """(group, rounds, wait): searches of each category; those more than ``ahead`` over the slowest wait."""
    n = log.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("rounds"))
    return n.withColumn("wait", F.col("rounds") - F.min("rounds").over(W.partitionBy()) > ahead)
