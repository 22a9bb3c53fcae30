"""Streams of turns and events: tail a folder, drop re-sent turns, close sessions, count by day.

Every job reads files with a checkpoint, so it takes up where it stopped; with once=True it works off what is there and ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.turns import normalised

LATE = "1 day"


def event_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    """Parquet files of events as they arrive; ts becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def fresh_turns(turns: DataFrame, late: str = LATE) -> DataFrame:
    """Each turn of a conversation once, however often it is sent within the watermark."""
    return normalised(turns.withWatermark("ts", late).dropDuplicatesWithinWatermark(["conv_id", "turn"]))


def sessions(events: DataFrame, key: str = "user_id", gap: str = "6 hours", late: str = LATE) -> DataFrame:
    """Sessions by inactivity, written when the watermark has passed their end."""
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", late).groupBy(key, w).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("closes"), "events", "value")


def daily(events: DataFrame, late: str = LATE) -> DataFrame:
    """Counts and sums by day and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "value")


def counted(events: DataFrame, every: int, key: str = "user_id") -> DataFrame:
    """A row each time a key has every more events; the count is kept as state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def count(k: tuple, batches, state: GroupState):
        n = state.get[0] if state.exists else 0
        fired = []
        for batch in batches:
            before = n
            n += len(batch)
            fired += list(range(before // every + 1, n // every + 1))
        state.update((n,))
        yield pd.DataFrame({key: [k[0]] * len(fired), "fired": fired})

    return events.groupBy(key).applyInPandasWithState(count, f"{key} bigint, fired bigint", "n bigint", "append", GroupStateTimeout.NoTimeout)


def ranges(turns: DataFrame, every: int = 5, idle: str = "6 hours", late: str = LATE) -> DataFrame:
    """Extraction ranges of conversations as turns (conv_id, turn, ts) arrive: temporal.superseding_ranges as a stream.

    A range is closed by its last turn, or by a timer when a conversation has been idle so long. A turn that is not behind what
    has been closed is late and gives its range another version, which names the one it supersedes. A conversation's state
    are its ranges' ends and the turns that no range has yet.
    """
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    pause = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches, state: GroupState):
        closed, pending = map(json.loads, state.get) if state.exists else ([], [])
        out: list[tuple] = []

        def close() -> None:
            closed.append([pending[0], pending[-1], len(pending), 0])
            out.append((key[0], len(closed) - 1, 0, pending[0], pending[-1], len(pending), None))
            pending.clear()

        if state.hasTimedOut:
            if pending:
                close()
        else:
            rows = pd.concat(list(batches)).dropna(subset=["turn"]).sort_values("turn", kind="stable")
            for turn in map(int, rows["turn"]):
                if closed and turn <= closed[-1][1]:
                    no = max([k for k, r in enumerate(closed) if r[0] <= turn], default=0)
                    r = closed[no]
                    r[:] = [min(r[0], turn), max(r[1], turn), r[2] + 1, r[3] + 1]
                    out.append((key[0], no, r[3], r[0], r[1], r[2], f"{key[0]}:{no}:{r[3] - 1}"))
                    continue
                pending.append(turn)
                if len(pending) == every:
                    close()
            if pending and len(rows):
                last = int(rows["ts"].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(last + pause, state.getCurrentWatermarkMs() + 1))
        state.update((json.dumps(closed), json.dumps(pending)))
        yield pd.DataFrame(out, columns=["conv_id", "range_no", "version", "first", "last", "turns", "supersedes"])

    timed = turns.select("conv_id", "turn", "ts").withWatermark("ts", late)
    return timed.groupBy("conv_id").applyInPandasWithState(step, "conv_id bigint, range_no bigint, version bigint, first bigint, last bigint, turns bigint, supersedes string", "closed string, pending string", "append", GroupStateTimeout.EventTimeTimeout)


def to_parquet(stream: DataFrame, out: str, checkpoint: str, once: bool = True, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_turns(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Micro-batches of turns, each written to a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["conv_id", "turn"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
