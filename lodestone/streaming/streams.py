"""Streaming forms of the sketches with Structured Streaming.

Each function takes a stream of events and runs it to the end of what is there, keeping its
state in the state store and its last result in the shared folder. ``follow`` runs a stream
with any trigger, for ever with a processing time, and appends each batch's report lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sketch
from ..scratch import Scratch
from ..sources.sinks import append_report


def events_of(stream: DataFrame) -> DataFrame:
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("tag"))


def drained(stream: DataFrame, scratch: Scratch, mode: str, each: Callable[[DataFrame, int], DataFrame | None]) -> DataFrame:
    """Run the stream over what is there; ``each`` batch's frame is saved, and the last one returned.

    A batch that runs again after a failure writes a table of its own, and only the last table
    counts, so results stay right.
    """
    last: list[DataFrame] = []

    def save(df: DataFrame, batch: int) -> None:
        if (out := each(df, batch)) is not None:
            last[:] = [scratch.save(out)]

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.path()).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    if not last:
        raise ValueError("the stream had no batch")
    return last[0]


def follow(stream: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None], **trigger):
    """Start a query that hands each batch to ``each``; by default what is there, or as ``processingTime="10 seconds"``."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start()


def report_bloom(stream: DataFrame, value: str, batch: Column, path: str, checkpoint: str, **trigger):
    """Append Time,FPR lines, those of the filter over all that was seen so far, after each batch."""
    seen = events_of(stream).groupBy(F.col(value).cast("string").alias("value")).agg(F.min(F.struct("ts", "event_id")).alias("seen"))

    def each(df: DataFrame, _: int) -> None:
        sights = df.withColumn("ts", F.col("seen.ts")).withColumn("batch", batch).drop("ts")
        append_report(sketch.bloom(sights).orderBy(F.desc("batch")).limit(1), path, {"Time": "batch", "FPR": "fpr"})

    return follow(seen, checkpoint, "complete", each, **trigger)


def report_fm(stream: DataFrame, value: str, size: str, slide: str, path: str, checkpoint: str, delay: str = "0 seconds", **trigger):
    """Append Time,Ground Truth,Estimation lines of the windows that are over, with a watermark of ``delay``; older state goes."""
    by = events_of(stream).withWatermark("ts", delay).groupBy(F.window("ts", size, slide)).agg(F.collect_set(F.col(value)).alias("values"), *sketch.fm_maxima(F.col(value).cast("string")))

    def each(df: DataFrame, _: int) -> None:
        lines = df.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("t"), F.size("values").alias("truth"), sketch.fm_estimate().alias("estimate")).orderBy("t")
        append_report(lines, path, {"Time": "t", "Ground Truth": "truth", "Estimation": "estimate"})

    return follow(by, checkpoint, "append", each, **trigger)


def fm_windows(stream: DataFrame, value: str, size: str, slide: str, scratch: Scratch) -> DataFrame:
    """As sketch.fm_windows: 45 maxima a window are all the state there is."""
    by = events_of(stream).groupBy(F.window("ts", size, slide)).agg(*sketch.fm_maxima(F.col(value).cast("string")))
    return drained(by, scratch, "complete", lambda df, _: df.select(F.col("window.start").alias("window_start"), sketch.fm_estimate().alias("estimate")))


def distinct_windows(stream: DataFrame, value: str, size: str, slide: str, scratch: Scratch) -> DataFrame:
    """As sketch.distinct_windows: state is a row for each window and value."""
    by = events_of(stream).groupBy(F.window("ts", size, slide).alias("w"), F.col(value).alias("v")).count()
    return drained(by, scratch, "complete", lambda df, _: df.groupBy(F.col("w.start").alias("window_start")).agg(F.count("v").alias("n_distinct")))


def late_tolerant_counts(stream: DataFrame, size: str, delay: str) -> DataFrame:
    """Tumbling counts with a watermark, for append sinks: a window is given out once it is ``delay`` old."""
    return events_of(stream).withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def bloom(stream: DataFrame, value: str, batch: Column, scratch: Scratch) -> DataFrame:
    """As sketch.bloom: state is each value's first sight."""
    seen = events_of(stream).groupBy(F.col(value).cast("string").alias("value")).agg(F.min(F.struct("ts", "event_id")).alias("seen"))
    return drained(seen, scratch, "complete", lambda df, _: sketch.bloom(df.withColumn("ts", F.col("seen.ts")).withColumn("batch", batch).drop("ts")))


def _sampled(df: DataFrame, batch: int, folder: str, k: int) -> DataFrame:
    """The sample after a batch: the last one, from its table in ``folder``, merged with the batch's.

    Tables are named by batch, so a batch that runs again, or a stream that starts again
    from its checkpoint, reads what the batch before left and writes the same table.
    """
    new = sketch.reservoir(df, k)
    if batch:
        new = new.unionByName(df.sparkSession.read.schema(new.schema).parquet(f"{folder}/{batch - 1}"))
    new.distinct().orderBy("priority", "event_id").limit(k).write.mode("overwrite").parquet(f"{folder}/{batch}")
    return df.sparkSession.read.schema(new.schema).parquet(f"{folder}/{batch}")


def reservoir(stream: DataFrame, scratch: Scratch, k: int = sketch.RESERVOIR) -> DataFrame:
    """As sketch.reservoir: each batch's sample is merged into the last one."""
    folder = scratch.path()
    return drained(events_of(stream), scratch, "append", lambda df, batch: _sampled(df, batch, folder, k))


def tag_tiers(tags: DataFrame, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None], k: int = sketch.RESERVOIR, tiers: int = 3, **trigger):
    """The tiers of a reservoir's tags after each batch of a stream of tags (event_id, ts, tag), handed to ``each``."""
    return follow(tags, checkpoint, "append", lambda df, batch: each(sketch.tag_tiers(_sampled(df, batch, folder, k), tiers), batch), **trigger)


def last_tiers(tags: DataFrame, scratch: Scratch, k: int = sketch.RESERVOIR, tiers: int = 3) -> DataFrame:
    """The tiers after the last batch of what is there."""
    folder = scratch.path()
    return drained(tags, scratch, "append", lambda df, batch: sketch.tag_tiers(_sampled(df, batch, folder, k), tiers))
