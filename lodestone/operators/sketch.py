"""Stream sketches in declarative batch form: Bloom filter, Flajolet-Martin, reservoir, tag tiers.

``events`` is (event_id, ts, user_id, event_type, tag). The streaming forms are in
``lodestone.streaming.streams``; both give the same rows for the same events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bytes_modulo, linear, trailing_zeros

BLOOM_BITS, FM_BITS = 200, 450
#: (a, b) of the filter's 10 and the estimator's 45 linear hashes, by a rule.
BLOOM_HASHES = tuple((37 * h % 100 + 1, 53 * h % 100 + 11) for h in range(10))
FM_HASHES = tuple((41 * h % 97 + 3, 59 * h % 89 + 7) for h in range(45))
GROUP = 5
RESERVOIR = 100
SEED = "lodestone"


def first_sights(events: DataFrame, value: str, batch: Column) -> DataFrame:
    """(value, seen, batch): each value's first event in (ts, event_id) order and its batch."""
    return events.groupBy(F.col(value).cast("string").alias("value")).agg(F.min(F.struct("ts", "event_id")).alias("seen")).withColumn("ts", F.col("seen.ts")).withColumn("batch", batch).drop("ts")


def bloom(sights: DataFrame, hashes=BLOOM_HASHES, bits: int = BLOOM_BITS) -> DataFrame:
    """(batch, fp, tn, fpr): cumulative false positives and true negatives of first sights.

    A bit is set from the first sight of any value that hashes to it; a value is a false
    positive if all its bits were set before it. Rows are distinct values and ``bits`` bits;
    the running sums are over batches only. No scored value: 0.0.
    """
    x = bytes_modulo(F.col("value"), bits)
    places = sights.select("value", "seen", "batch", F.explode(F.array_distinct(F.array(*(linear(x, a, b, bits) for a, b in hashes)))).alias("bit"))
    set_at = places.groupBy("bit").agg(F.min("seen").alias("first"))
    judged = places.join(F.broadcast(set_at), "bit").groupBy("value", "batch").agg(F.min((F.col("first") < F.col("seen")).cast("int")).alias("fp"))  # a row for each bit
    by = judged.groupBy("batch").agg(F.sum("fp").alias("f"), F.sum(1 - F.col("fp")).alias("t"))
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = by.select("batch", F.sum("f").over(upto).alias("fp"), F.sum("t").over(upto).alias("tn"))
    return sums.select("batch", "fp", "tn", F.coalesce(F.try_divide("fp", F.col("fp") + F.col("tn")), F.lit(0.0)).alias("fpr"))


def fm_maxima(value: Column, hashes=FM_HASHES, bits: int = FM_BITS) -> list[Column]:
    """Aggregates: the most trailing zeros for each hash."""
    x = bytes_modulo(value, bits)
    return [F.max(trailing_zeros(linear(x, a, b, bits))).alias(f"z{i}") for i, (a, b) in enumerate(hashes)]


def fm_estimate(n: int = len(FM_HASHES)) -> Column:
    """Median over groups of the rounded mean of 2 ** z."""
    means = [F.bround(sum((F.pow(F.lit(2.0), F.col(f"z{i}")) for i in range(g, g + GROUP)), F.lit(0.0)) / GROUP, 0) for g in range(0, n, GROUP)]
    return F.sort_array(F.array(*means))[len(means) // 2].cast("long")


def fm_windows(events: DataFrame, value: str, size: str, slide: str) -> DataFrame:
    """(window_start, estimate) over sliding windows; a window without events has no row."""
    by = events.groupBy(F.window("ts", size, slide)).agg(*fm_maxima(F.col(value).cast("string")))
    return by.select(F.col("window.start").alias("window_start"), fm_estimate().alias("estimate"))


def distinct_windows(events: DataFrame, value: str, size: str, slide: str) -> DataFrame:
    """(window_start, n_distinct), exactly."""
    pairs = events.select(F.window("ts", size, slide).alias("w"), F.col(value).alias("v")).distinct()
    return pairs.groupBy(F.col("w.start").alias("window_start")).agg(F.count("v").alias("n_distinct"))


def tumbling_counts(events: DataFrame, size: str) -> DataFrame:
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def priority(seed: str = SEED) -> Column:
    return F.md5(F.concat(F.col("event_id").cast("string"), F.lit(seed)))


def reservoir(events: DataFrame, k: int = RESERVOIR, seed: str = SEED) -> DataFrame:
    """A uniform sample of ``k`` tagged events: those of smallest hash, so samples merge by taking the smallest again."""
    return events.where("tag is not null").select("event_id", "tag", priority(seed).alias("priority")).orderBy("priority", "event_id").limit(k)


def tag_tiers(sample: DataFrame, tiers: int = 3) -> DataFrame:
    """(tier, tag, n) of the ``tiers`` largest counts of a sample, ties included."""
    counts = sample.groupBy("tag").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("tier", F.dense_rank().over(Window.orderBy(F.desc("n"))))  # of a sample's tags
    return ranked.where(F.col("tier") <= tiers).select("tier", "tag", "n").orderBy("tier", "tag")
