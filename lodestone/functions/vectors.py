"""Mergeable vector summaries: count, sum and sum of squares by dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summaries(points: DataFrame, key: str, features: str = "features") -> DataFrame:
    """(key, n, sum, sumsq): dimensions are summed as rows, so partial sums are combined map-side."""
    long = points.select(key, F.posexplode(features).alias("i", "x"))
    by = long.groupBy(key, "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return by.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s", "q"))).alias("d")).select(key, "n", F.transform("d", lambda d: d["s"]).alias("sum"), F.transform("d", lambda d: d["q"]).alias("sumsq"))


def merged(rows: DataFrame, key: str) -> DataFrame:
    """Summaries of one key added up, dimension by dimension."""
    long = rows.select(key, "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("i", "d"))
    by = long.groupBy(key, "i").agg(F.sum("n").alias("n"), F.sum("d.sum").alias("s"), F.sum("d.sumsq").alias("q"))
    return by.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s", "q"))).alias("d")).select(key, "n", F.transform("d", lambda d: d["s"]).alias("sum"), F.transform("d", lambda d: d["q"]).alias("sumsq"))


def centroid(n: str = "n", total: str = "sum") -> Column:
    return F.transform(total, lambda s: s / F.col(n))


def deviation(n: str = "n", total: str = "sum", squares: str = "sumsq") -> Column:
    """Population standard deviation by dimension."""
    return F.zip_with(total, squares, lambda s, q: F.sqrt(F.greatest(q / F.col(n) - (s / F.col(n)) * (s / F.col(n)), F.lit(0.0))))
