"""Dropping of lines that repeat across documents, with DataFrame functions only.

A line's key is the line stripped and lower-cased (ASCII); it is carried as a 128-bit hash.
Lines are range-partitioned by (hash, document, position) and stand sorted so in their
ranges, so a line that a third of all documents hold is split over as many ranges as its
rows need. In a range a window streams over each hash, and its first document keeps its
lines. A hash that goes on into further ranges is the last one of its first range: the last
hashes of all ranges, with their first documents, are carried over (one row for each range,
whatever the data holds), and later ranges take the first document from there.

The result is a keep bitmap for each document that loses lines, compressed to its runs: the
[from, to) of lines that stay, the last without an end. No text moves until ``apply_bitmaps``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import hash128, lower_ascii, strip_ascii

MIN_CODE_POINTS = 10


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity(docs: DataFrame) -> list[Column]:
    """A row of documents: its id and a hash of its text, as rows may share an id."""
    return [F.col("doc_id").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")]


def repeated_lines(docs: DataFrame, *, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """(_doc, _text, _pos) of the lines to drop."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = docs.select("doc_id", "text").where("doc_id is not null").select(*_identity(docs), F.posexplode(split_lines(F.col("text"))).alias("_pos", "_line"))
    lines = lines.withColumn("_key", lower_ascii(strip_ascii(F.col("_line")))).where(F.char_length("_key") >= min_code_points)
    a, b = hash128(F.col("_key"))
    lines = scratch.save(lines.select(a.alias("_a"), b.alias("_b"), "_doc", "_text", "_pos"))

    ranges = lines.repartitionByRange("_a", "_b", "_doc", "_pos").withColumn("_range", F.spark_partition_id())
    stream = Window.partitionBy("_range", "_a", "_b").orderBy("_doc", "_pos")
    ranges = ranges.withColumn("_first", F.first("_doc").over(stream))
    streamed = scratch.save(ranges)
    ends = streamed.groupBy("_range").agg(F.max(F.struct("_a", "_b", "_first")).alias("e"))
    carried = ends.groupBy("e._a", "e._b").agg(F.min("e._first").alias("_before"))
    found = streamed.join(F.broadcast(carried), ["_a", "_b"], "left")
    return found.where(F.col("_doc") > F.least("_first", "_before")).select("_doc", "_text", "_pos")


def line_bitmaps(docs: DataFrame, *, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """Keep bitmaps: _doc, _text, keep (array of struct(from, to): the runs of lines that stay), n_dropped.

    One row for each document that loses lines; the last run has no end. Rows with a null
    doc_id take no part.
    """
    gone = repeated_lines(docs, min_code_points=min_code_points)
    at = Window.partitionBy("_doc", "_text").orderBy("_pos")
    runs = gone.withColumn("_run", F.col("_pos") - F.dense_rank().over(at)).groupBy("_doc", "_text", "_run").agg(F.min("_pos").alias("s"), (F.max("_pos") + 1).alias("e"))
    found = runs.groupBy("_doc", "_text").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("gone"), F.sum(F.col("e") - F.col("s")).alias("n_dropped"))
    keep = F.expr("transform(sequence(0, size(gone)), i -> struct(if(i = 0, 0, gone[greatest(i - 1, 0)].e) as from, get(gone, i).s as to))")
    return found.select("_doc", "_text", keep.alias("keep"), F.col("n_dropped").cast("long"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``_kept`` (the lines that stay, joined), ``_n_lines`` and ``_n_dropped``."""
    names = docs.columns
    safe = docs.toDF(*(f"c{i}" for i in range(len(names))))  # columns of docs may have any names
    text = F.coalesce(F.col(f"c{names.index('text')}"), F.lit(""))
    safe = safe.withColumns({"_lines": split_lines(text), "_row": F.xxhash64(text), "_whole": text, "_id": F.col(f"c{names.index('doc_id')}")})
    out = safe.join(bitmaps, (F.col("_id") == F.col("_doc")) & (F.col("_row") == F.col("_text")), "left")
    stays = F.expr("array_join(flatten(transform(keep, k -> slice(_lines, k.from + 1, coalesce(k.to, size(_lines)) - k.from))), '\n')")
    kept = F.when(F.col("keep").isNull(), F.col("_whole")).otherwise(stays)
    return out.select(*(f"c{i}" for i in range(len(names))), kept.alias("_kept"), F.size("_lines").cast("long").alias("_n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("_n_dropped")).toDF(*names, "_kept", "_n_lines", "_n_dropped")


def drop_repeated_lines(docs: DataFrame, *, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """``docs`` with ``_kept``, ``_n_lines`` and ``_n_dropped``.

    Keys of ``min_code_points`` or more in two documents or more lose all their lines but
    those of the smallest doc_id that holds them. Defined results: a null or empty text is
    one empty line; rows that share a doc_id count as one document; a row whose doc_id is
    null stays as it is and counts for no key; an empty table gives no rows; other columns
    pass through.
    """
    return apply_bitmaps(docs, line_bitmaps(docs, min_code_points=min_code_points))
