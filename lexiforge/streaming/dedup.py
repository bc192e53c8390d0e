"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_contents(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of each content within the watermark."""
    return stream.withColumn("hash", F.sha2("text", 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])


def usage_by_day(stream: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Uses by user and day; late events up to the delay count."""
    return stream.withWatermark(time, delay).groupBy("user_id", F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.to_date("w.start").alias("day"), "n")


def ttl_accepted(stream: DataFrame, key: str, ttl_seconds: float, time: str = "ts") -> DataFrame:
    """M8: event_id of the events that start a job: none of their key was accepted within the time to live before.

    State is one time a key; it is dropped once it has run out."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(keys, frames, state):
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        rows = pd.concat(list(frames)).sort_values([time, "event_id"])
        for event, at in zip(rows["event_id"], rows[time]):
            t = at.timestamp()
            if last is None or t - last > ttl_seconds:
                last = t
                out.append((keys[0], event))
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + ttl_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "event_id"])

    rows = stream.withWatermark(time, "0 seconds")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def sink_chunks(stream: DataFrame, path: str, checkpoint: str, index) -> object:
    """Indexes each micro-batch of documents (index: DataFrame -> chunks) and appends it; one batch's files are written once."""

    def write(batch: DataFrame, number: int) -> None:
        index(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
