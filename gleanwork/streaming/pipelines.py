"""Streams of search events: windows with watermarks, first-wins state, retries with timers, and records added once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanwork.operators.dedup import greedy_unique
from gleanwork.sources import storage

#: Parts of the registry of keys; a batch reads those its own keys fall into.
PARTS = 256
#: Fixed values of retries: seconds before the first one, which double, and their number.
RETRY_SECONDS, MOST_RETRIES = 5.0, 2


def minute_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "10 minutes") -> DataFrame:
    """Events of each minute and key; events later than ``late`` are dropped."""
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", "1 minute"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), key, "n")


def sliding_counts(events: DataFrame, ts: str = "ts", key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Events of each key in two-minute windows that start every minute."""
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", "2 minutes", "1 minute"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def claimed_once(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def latest_states(events: DataFrame, key: str, version: str, state: str) -> DataFrame:
    """The state of each key by its highest version, however late versions arrive; write it in update mode."""
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(state, version).alias(state), F.max(version).alias(version))


def retry_queue(events: DataFrame, key: str = "request", ts: str = "ts", status: str = "status", late: str = "1 minute") -> DataFrame:
    """(request, attempt, state) of requests that failed: 'due' when a retry may be made, 'failed' after the last one.

    The wait doubles with each failure of a request. A success ends it. Timers run by the events'
    own time, which has to pass the end of a wait by ``late``.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if held.hasTimedOut:
            out.append((keys[0], held.get[0], "due"))
            held.update((held.get[0],))
        else:
            attempt = held.get[0] if held.exists else 0
            rows = sorted(((t, s) for pdf in batches for t, s in zip(pdf["at"], pdf["status"])), key=lambda r: r[0])
            wait = None
            for at, said in rows:
                attempt, wait = (0, None) if said == "ok" else (attempt + 1, at)
            if attempt > MOST_RETRIES:
                out.append((keys[0], attempt, "failed"))
                held.remove()
            elif attempt:
                held.update((attempt,))
                due = int(wait.timestamp() * 1000 + RETRY_SECONDS * 1000 * 2 ** (attempt - 1))
                held.setTimeoutTimestamp(max(due, held.getCurrentWatermarkMs() + 1))
            elif held.exists:
                held.remove()
        yield pd.DataFrame(out, columns=["request", "attempt", "state"])

    x = events.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("request"), F.col(ts).cast("timestamp").alias("at"), F.coalesce(status, F.lit("")).alias("status")).withWatermark("at", late)
    return x.groupBy("request").applyInPandasWithState(step, "request string, attempt int, state string", "attempt int", "append", GroupStateTimeout.EventTimeTimeout)


def add_records(stream: DataFrame, registry: str, checkpoint: str, seq: str = "seq", keys: str = "keys") -> StreamingQuery:
    """Accept records batch by batch against a registry of keys, first wins over all batches.

    ``registry`` holds the judged records (``records``) and the keys of the accepted ones (``keys``) in
    PARTS parts by hash; a batch reads the parts that its own keys fall into. Each batch is
    written under its number, so a batch that is run again overwrites itself.
    """

    def parted(rows: DataFrame) -> DataFrame:
        each = rows.select("seq", F.explode("keys").alias("k")).select("seq", F.concat_ws("\u0001", "k.kind", "k.key").alias("key"))
        return each.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col(seq).alias("seq"), F.col(keys).alias("keys"))
        if storage.exists(spark, f"{registry}/keys"):
            each = parted(rows)
            parts = [r[0] for r in each.select("part").distinct().collect()]
            owned = spark.read.parquet(f"{registry}/keys").filter((F.col("batch") != number) & F.col("part").isin(parts)).select("key", "part")
            fresh = rows.join(each.join(owned, ["part", "key"], "left_semi").select("seq").distinct(), "seq", "left_anti")
        else:
            fresh = rows
        accepted = greedy_unique(fresh, "seq", "keys").filter("accepted").select("seq", "accepted")
        judged = rows.join(accepted, "seq", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
        judged.write.mode("overwrite").parquet(f"{registry}/records/batch={number}")
        kept = spark.read.parquet(f"{registry}/records/batch={number}").filter("accepted")
        parted(kept).select("key", "part").distinct().repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{registry}/keys/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
