from pyspark.sql import functions as F

from gleanwork.streaming import pipelines


def test_minute_counts(spark, data):
    batch = spark.read.parquet(f"{data}/sf0.001/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(f"{data}/sf0.001")
    q = pipelines.minute_counts(stream).writeStream.format("memory").queryName("minutes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = batch.groupBy(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute"), "event_type").agg(F.count("*").alias("n"))
    assert spark.table("minutes").exceptAll(want).count() == 0 and want.exceptAll(spark.table("minutes")).count() == 0


def test_records_are_added_once(spark, tmp_path):
    kind = "seq long, keys array<struct<rank:int,kind:string,key:string>>"
    rows = [(1, [(1, "domain", "a")]), (2, [(1, "domain", "a"), (2, "name", "n")]), (3, [(2, "name", "n")])]
    for part in (rows[:2], rows[2:] + [(4, [(1, "domain", "a")])], [(5, [])]):
        spark.createDataFrame(part, kind).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], kind).schema).parquet(str(tmp_path / "in"))
        pipelines.add_records(stream, str(tmp_path / "reg"), str(tmp_path / "chk")).awaitTermination(120)
    got = {r.seq: r.accepted for r in spark.read.parquet(str(tmp_path / "reg" / "records")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def run_through(spark, tmp_path, parts, kind, made, name, mode):
    """Feed the parts as one batch each and return what the stream wrote."""
    for part in parts:
        spark.createDataFrame(part, kind).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(f"{kind}, ts timestamp").parquet(str(tmp_path / name))
        sink = lambda df, n: df.write.mode("append").parquet(str(tmp_path / f"{name}-out"))
        made(stream).writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"{name}-chk")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_retries_fall_due_and_end(spark, tmp_path):
    parts = [[("a", 100, "500"), ("b", 100, "500"), ("c", 100, "ok")], [("b", 102, "ok"), ("z", 300, "ok")], [("a", 301, "500"), ("z", 900, "ok")], [("a", 901, "500"), ("z", 2000, "ok")]]
    got = run_through(spark, tmp_path, parts, "request string, t long, status string", pipelines.retry_queue, "retries", "append")
    assert sorted((r.request, r.attempt, r.state) for r in got.collect()) == [("a", 1, "due"), ("a", 2, "due"), ("a", 3, "failed")]


def test_states_by_version(spark, tmp_path):
    parts = [[("j", 2, "running"), ("k", 1, "queued")], [("j", 1, "pending")], [("k", 3, "done")]]
    got = run_through(spark, tmp_path, parts, "job string, t long, state string", lambda s: pipelines.latest_states(s, "job", "t", "state"), "states", "update")
    last = {r.job: r.state for r in got.groupBy("job").agg(F.max_by("state", "t").alias("state")).collect()}
    assert last == {"j": "running", "k": "done"}
