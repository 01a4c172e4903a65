"""Frequent itemsets over baskets in long form (basket, item): A-priori, two-phase SON, FP-growth.

Itemsets are sorted arrays. Long form keeps a basket's items in rows, so neither a basket
nor an item of any size gathers in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def baskets(pairs: DataFrame, key: str, item: str) -> DataFrame:
    """Distinct (basket, item); swap the arguments for the other basket model."""
    return pairs.select(F.col(key).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()


def larger_than(rows: DataFrame, threshold: int) -> DataFrame:
    """Baskets of more than ``threshold`` items."""
    big = rows.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > threshold).select("basket")
    return rows.join(big, "basket", "left_semi")


def basket_arrays(rows: DataFrame) -> DataFrame:
    return rows.groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items"))


def candidates(level: DataFrame, keys: list[str]) -> DataFrame:
    """Itemsets one longer: pairs of frequent ones that differ in their last item only, all of whose parts are frequent."""
    prefix = lambda c: F.slice(c, 1, F.size(c) - 1)
    a = level.select(*keys, prefix(F.col("items")).alias("p"), F.element_at("items", -1).alias("x"))
    b = level.select(*keys, prefix(F.col("items")).alias("p"), F.element_at("items", -1).alias("y"))
    joined = a.join(b, [*keys, "p"]).where("x < y").select(*keys, F.concat("p", F.array("x", "y")).alias("items"))
    parts = F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.filter("items", lambda v, j: j + 1 != i))
    size = F.size("items")
    kept = joined.select(*keys, "items", F.explode(parts).alias("part")).join(level.select(*keys, F.col("items").alias("part")), [*keys, "part"]).groupBy(*keys, "items").count()
    return kept.where(F.col("count") == size).select(*keys, "items")


def apriori(rows: DataFrame, support: Column | int | float, scratch: Scratch, max_size: int | None = None, keys: list[str] = ()) -> DataFrame:
    """(items, n): itemsets held by at least ``support`` baskets, all sizes up to ``max_size``.

    With ``keys`` each group of baskets is counted on its own and ``support`` may be an
    expression over the keys. A level's occurrences are the last level's joined to the
    basket's later items, only for candidates; each level is written once.
    """
    keys = list(keys)
    support = support if isinstance(support, Column) else F.lit(support)
    count = lambda occ: occ.groupBy(*keys, "items").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    singles = scratch.save(count(rows.select(*keys, F.array("item").alias("items"))))
    kept = scratch.save(rows.join(singles.select(*keys, F.col("items")[0].alias("item")), [*keys, "item"], "left_semi"))
    occ, levels, size = kept.select(*keys, "basket", F.array("item").alias("items")), [singles], 1
    while max_size is None or size < max_size:
        wanted = scratch.save(candidates(levels[-1].select(*keys, "items"), keys))
        if not wanted.limit(1).count():
            break
        grown = occ.join(kept, [*keys, "basket"]).where(F.col("item") > F.element_at("items", -1)).select(*keys, "basket", F.concat("items", F.array("item")).alias("items"))
        occ = scratch.save(grown.join(wanted, [*keys, "items"], "left_semi"))
        level = scratch.save(count(occ))
        if not level.limit(1).count():
            break
        levels.append(level)
        occ = occ.join(level.select(*keys, "items"), [*keys, "items"], "left_semi")
        size += 1
    return reduce(DataFrame.unionByName, levels)


def son_candidates(rows: DataFrame, support: int | float, chunks: int, scratch: Scratch, max_size: int | None = None) -> DataFrame:
    """(items): itemsets that reach the chunk's share of the support in some chunk (basket modulo ``chunks``)."""
    dealt = rows.withColumn("chunk", F.pmod(F.col("basket"), F.lit(chunks)))
    return apriori(dealt, support / chunks, scratch, max_size, ["chunk"]).select("items").distinct()


def son(rows: DataFrame, support: int | float, chunks: int, scratch: Scratch, max_size: int | None = None) -> DataFrame:
    """(items, n): the candidates of all chunks, counted over all baskets and kept if they reach the support."""
    dealt = rows.withColumn("chunk", F.pmod(F.col("basket"), F.lit(chunks)))
    local = scratch.save(apriori(dealt, support / chunks, scratch, max_size, ["chunk"]))
    found = scratch.save(local.select("items").distinct())
    sizes = [r[0] for r in found.select(F.size("items")).distinct().orderBy(F.size("items")).collect()]
    occ, out = rows.select("basket", F.array("item").alias("items")), []
    for size in sizes:
        if size > 1:  # parts of a chunk's frequent set are frequent in that chunk, so no size is missing
            occ = occ.join(rows, "basket").where(F.col("item") > F.element_at("items", -1)).select("basket", F.concat("items", F.array("item")).alias("items"))
        occ = scratch.save(occ.join(found.where(F.size("items") == size), "items", "left_semi"))
        out.append(occ.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    return reduce(DataFrame.unionByName, out) if out else local.select("items", "n")


def fpgrowth(rows: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """(items, n) by distributed FP-growth, with an absolute support."""
    arrays = Scratch(rows.sparkSession, "fpgrowth").save(basket_arrays(rows))
    n = arrays.count()
    if not n:
        return arrays.select("items", F.lit(0).cast("long").alias("n"))
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, min(1.0, (support - 0.5) / n))).fit(arrays).freqItemsets
    out = found.select(F.sort_array("items").alias("items"), F.col("freq").alias("n"))
    return out.where(F.size("items") <= max_size) if max_size else out
