from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import temporal
from threadloom.streaming import jobs


def test_late_turns_supersede_ranges_in_the_stream_as_in_the_batch(spark, tmp_path):
    turns = [(c, t) for c in range(2, 6) for t in range(1, 4 * c)] + [(7, 2), (7, 9)]
    late = lambda c, t: t % 5 == 3 or (c, t) == (7, 2)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(rows, day):
        df = spark.createDataFrame([(c, t, f"2024-01-{day:02} 00:{n % 60:02}:00") for n, (c, t) in enumerate(rows)], "conv_id bigint, turn bigint, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = jobs.event_stream(spark, source, "conv_id bigint, turn bigint, ts timestamp_ntz", 1)
        jobs.to_parquet(jobs.ranges(stream), out, str(tmp_path / "state")).awaitTermination(120)

    put([x for x in turns if not late(*x)], 1)
    run()
    # another conversation's turns move the watermark, so the timers close what is left
    put([(99, 1)], 9)
    run()
    put([x for x in turns if late(*x)], 10)
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(out).filter("conv_id <> 99").select("conv_id", "range_no", "version", "first", "last", "turns", "supersedes").collect())
    batch = temporal.superseding_ranges(spark.createDataFrame([(c, t, late(c, t)) for c, t in turns], "conv_id bigint, turn bigint, late boolean"))
    expected = sorted(tuple(r) for r in batch.select("conv_id", "range_no", "version", "first", "last", "turns", "supersedes").collect())
    assert got == expected and sum(r[2] > 0 for r in got) == sum(late(*x) for x in turns)
    assert (7, 0, 1, 2, 9, 2, "7:0:0") in got


def test_ranges_of_odd_turns(spark):
    df = spark.createDataFrame([(1, 3, True), (1, 4, True), (2, None, False), (None, 1, False), (3, 1, None), (3, 1, False)], "conv_id int, turn int, late boolean")
    got = sorted(tuple(r) for r in temporal.superseding_ranges(df).collect())
    assert got == [(1, 0, 0, 3, 4, 2, None), (3, 0, 0, 1, 1, 2, None)]
    assert temporal.superseding_ranges(df.limit(0)).count() == 0
