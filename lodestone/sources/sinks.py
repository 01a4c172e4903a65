"""Sinks: the reports that the mining operators write.

Reports of a few lines are formatted from a small result on the driver; anything that grows
with the data is written by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_object(path: str, values: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, ensure_ascii=False)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def itemset_line(sets: Iterable[tuple[str, ...]]) -> str:
    """Itemsets of one size: ('a'),('b') or ('a', 'b'),('a', 'c')."""
    return ",".join("(" + ", ".join(f"'{x}'" for x in s) + ")" for s in sorted(sets))


def itemset_report(candidates: Iterable[tuple[str, ...]], frequent: Iterable[tuple[str, ...]]) -> str:
    """Candidates and frequent itemsets, a line for each size and a blank line between."""

    def part(title: str, sets: Iterable[tuple[str, ...]]) -> list[str]:
        by_size: dict[int, list] = {}
        for s in sets:
            by_size.setdefault(len(s), []).append(s)
        return [title, *("\n".join([itemset_line(by_size[n]), ""]) for n in sorted(by_size))]

    return "\n".join([*part("Candidates:", candidates), *part("Frequent Itemsets:", frequent)])


def write_communities(communities: DataFrame, path: str) -> None:
    """One community a line, members as 'a', 'b'; ``communities`` has ``members`` (sorted strings) and ``size``."""
    quoted = F.array_join(F.transform("members", lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", ")
    communities.orderBy("size", "members").select(quoted.alias("value")).write.mode("overwrite").text(path)


def write_betweenness(edges: DataFrame, path: str) -> None:
    """('a', 'b'), value by value descending, then by edge."""
    line = F.format_string("('%s', '%s'), %s", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("betweenness").cast("string"))
    edges.orderBy(F.desc("betweenness"), "src", "dst").select(line.alias("value")).write.mode("overwrite").text(path)


def cluster_report(rounds: Iterable[tuple[int, int, int, int, int]]) -> str:
    return "\n".join(f"Round {i}: {ds},{clusters},{points},{rs}" for i, ds, clusters, points, rs in rounds)


def write_assignments(points: DataFrame, path: str) -> None:
    points.select(F.col("id").cast("long").alias("id"), "cluster").orderBy("id").write.mode("overwrite").option("header", True).csv(path)


def append_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger):
    """A streaming query that appends parquet files."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_report(df: DataFrame, path: str, names: dict[str, str]) -> None:
    """Append a batch's report lines as CSV with a header; ``names`` maps the titles to columns, as {"Time": "batch", "FPR": "fpr"}."""
    df.select(*(F.col(c).alias(title) for title, c in names.items())).coalesce(1).write.mode("append").option("header", True).csv(path)  # lines of one batch


def console(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)
