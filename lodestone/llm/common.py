"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def strip_ascii(col: Column) -> Column:
    """Both ends without [\\x20\\x09-\\x0D]."""
    return F.btrim(col, F.lit(" \t\n\x0b\x0c\r"))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes, together the identity of a value."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


#: Rows and bytes of texts in one Arrow batch to a Python worker.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, since one text may be very long; settings of the user's stay."""
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1), BATCH_BYTES)):
        if spark.conf.get(key, None) in (None, default):
            spark.conf.set(key, str(value))


def aside(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns but doc_id and text renamed, so that no name of an operator's clashes; ``docs.columns`` in the same order name them again."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"other{i}" for i, c in enumerate(docs.columns)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: str) -> list[bytes]:
    """UTF-8 of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, which is what bytes take for white space and letters."""
    return text.encode().lower().split()
