"""Hash functions of the sketches as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_modulo(col: Column, m: int) -> Column:
    """The UTF-8 bytes as one big-endian integer, modulo ``m``, folded byte by byte."""
    code = F.hex(F.encode(col, "UTF-8"))
    size = F.octet_length(col)
    byte = lambda i: F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    steps = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(steps, byte), F.lit(0).cast("long"), lambda acc, x: (acc * 256 + x) % m)


def linear(x: Column, a: int, b: int, m: int) -> Column:
    return (F.lit(a).cast("long") * x + F.lit(b).cast("long")) % m


def trailing_zeros(x: Column) -> Column:
    """Zeros at the end of the binary form; 1 for zero, whose form is a single 0."""
    return F.when(x == 0, 1).otherwise(F.length(F.bin(x)) - F.length(F.rtrim(F.bin(x), F.lit("0"))))
