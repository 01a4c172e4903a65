"""Exploration of review tables: counts, distincts, top lists, averages over a join, partition statistics."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def count_in_year(df: DataFrame, year: int, name: str) -> DataFrame:
    """Rows whose date is in the year, as a range that a scan can be pruned by; strings compare by their first four characters."""
    if dict(df.dtypes)["date"] == "string":
        return df.where(F.substring("date", 1, 4) == str(year)).agg(F.count("*").alias(name))
    kind = dict(df.dtypes)["date"]
    start, end = (F.lit(f"{y}-01-01 00:00:00").cast(kind) for y in (year, year + 1))
    return df.where((F.col("date") >= start) & (F.col("date") < end)).agg(F.count("*").alias(name))


def count_distinct(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias(name))


def top(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent keys, ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def average_by(facts: DataFrame, dimension: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Mean of ``value`` by ``group`` over the join on ``key``.

    Facts are summed by the join key first, so what is shuffled or joined is a row for each
    key of each task, not for each fact.
    """
    sums = facts.groupBy(key).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return sums.join(dimension, key).groupBy(group).agg((F.sum("_s") / F.sum("_n")).alias(value))


def ranked(df: DataFrame, value: str, key: str, n: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc(value), key)
    return out.limit(n) if n else out


def items_per_partition(df: DataFrame) -> DataFrame:
    """(partition, n_items) of the frame's own partitions, empty ones left out."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))


def repartitioned(df: DataFrame, n: int, key: str) -> DataFrame:
    """The custom partitioning: ``n`` partitions by the key's hash."""
    return df.repartition(n, key)


def items_by_key_modulo(df: DataFrame, key: str, n: int) -> DataFrame:
    """Items in each of ``n`` partitions by the key modulo ``n``, which any engine can recompute."""
    return df.groupBy(F.pmod(F.col(key), F.lit(n)).alias("partition")).agg(F.count("*").alias("n_items"))


def timed(action: Callable[[], Any]) -> tuple[Any, float]:
    """What an action returns and the seconds it took, as the collect-against-take comparison reports."""
    start = time.perf_counter()
    return action(), time.perf_counter() - start


def collect_against_take(df: DataFrame, n: int = 10) -> dict[str, float]:
    """Seconds to collect all rows and cut them to ``n`` (m1) and to take ``n`` rows (m2)."""
    return {"m1": timed(lambda: df.collect()[:n])[1], "m2": timed(lambda: df.take(n))[1]}


def exploration_report(reviews: DataFrame, year: int) -> dict[str, Any]:
    """The exploration's answers: counts, and the ten most frequent users and businesses as [key, n]."""
    rows = lambda df: [list(r) for r in df.collect()]  # noqa: E731  (ten rows)
    return {
        "n_review": count_rows(reviews, "n").first()[0], f"n_review_{year}": count_in_year(reviews, year, "n").first()[0],
        "n_user": count_distinct(reviews, "user", "n").first()[0], "top10_user": rows(top(reviews, "user")),
        "n_business": count_distinct(reviews, "business", "n").first()[0], "top10_business": rows(top(reviews, "business")),
    }


def all_partitions(df: DataFrame) -> list[int]:
    """Rows of each of the frame's partitions, empty ones too, in their order."""
    n = df.rdd.getNumPartitions()
    found = {r.partition: r.n_items for r in items_per_partition(df).collect()}  # a row for each partition
    return [found.get(i, 0) for i in range(n)]


def partition_report(df: DataFrame, key: str, n: int, action: Callable[[DataFrame], Any]) -> dict[str, dict[str, Any]]:
    """n_partition, n_items and the seconds of ``action``, for the frame's own partitions and for ``n`` by the key's hash."""
    return {name: {"n_partition": len(items := all_partitions(x)), "n_items": items, "exe_time": timed(lambda x=x: action(x))[1]} for name, x in (("default", df), ("customized", repartitioned(df, n, key)))}


def timing_report(df: DataFrame, n: int = 10) -> dict[str, Any]:
    """Seconds to collect all rows (m1) against taking ``n`` (m2), and why they differ."""
    took = collect_against_take(df, n)
    return took | {"explanation": f"m1 moves every row to the driver and cuts the list there; m2 stops once {n} rows are found."}
