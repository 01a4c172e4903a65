"""Recommenders over ratings (user, item, rating): ALS, user-based, item-based, LSH-pruned item-based, RMSE.

Similarities are computed only for pairs that a test row needs, so the joins are bounded by
the test rows' neighbourhoods. Every ordering has a total order, so results are repeatable.
A test row whose user or item the training rows lack is predicted as 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Ratings in each of the two blocks that a task compares.
BLOCK = 2_000_000
#: Times that ratings may stand on disk at once as they are dealt over pairs of blocks.
COPIES = 4


def averages(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.avg("rating").alias("avg_rating"), F.count("*").alias("n"))


def als(train: DataFrame, test: DataFrame, rank: int = 3, iterations: int = 10, reg: float = 0.1, seed: int = 42) -> DataFrame:
    """(user, item, prediction); rows of unseen users or items are dropped."""
    model = ALS(rank=rank, maxIter=iterations, regParam=reg, seed=seed, userCol="user", itemCol="item", ratingCol="rating", coldStartStrategy="drop")
    whole = lambda df: df.select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), F.col("rating").cast("float").alias("rating"))
    return model.fit(whole(train)).transform(whole(test)).select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), F.col("prediction").cast("double").alias("prediction"))


def _expand(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``low`` .. ``low`` + ``n`` - 1 of each run, one after the other, and which run each belongs to."""
    run = np.repeat(np.arange(len(n)), n)
    return np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + low[run], run


def _meet(mine: list[np.ndarray], theirs: list[np.ndarray], asked: list[np.ndarray], first: int | None, step: int = 1_000_000) -> list[np.ndarray]:
    """(a, b, via, value of a, value of b) of one pair of blocks, sorted by (a, b, via), the ``first`` of each pair only.

    ``mine`` and ``theirs`` (key, via, value) are the ratings of the two blocks, ``asked`` (a, b) the wanted pairs.
    """
    heads, a_at = np.unique(asked[0], return_inverse=True)
    tails, b_at = np.unique(asked[1], return_inverse=True)
    wanted = np.unique(a_at * len(tails) + b_at)
    slot = lambda pair: (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
    known = np.zeros(1 << 24, bool)  # most pairs that meet are not wanted
    known[slot(wanted)] = True
    ka, va, ra = (c[np.isin(mine[0], heads)] for c in mine)
    kb, vb, rb = (c[np.isin(theirs[0], tails)] for c in theirs)
    order = np.argsort(vb, kind="stable")
    kb, vb, rb = np.searchsorted(tails, kb[order]), vb[order], rb[order]
    ka = np.searchsorted(heads, ka)
    low = np.searchsorted(vb, va)
    n = np.searchsorted(vb, va, "right") - low
    ends = np.cumsum(n)
    found, at = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]], 0
    while at < len(n):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")), at + 1)
        place, run = _expand(low[at:to], n[at:to])
        pair = ka[at:to][run] * len(tails) + kb[place]
        hit = np.flatnonzero(known[slot(pair)])
        hit = hit[wanted[np.minimum(np.searchsorted(wanted, pair[hit]), len(wanted) - 1)] == pair[hit]]
        found.append([pair[hit], va[at:to][run[hit]], ra[at:to][run[hit]], rb[place[hit]]])
        at = to
    pair, via, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((via, pair))
    pair, via, x, y = pair[order], via[order], x[order], y[order]
    if first is not None and len(pair):
        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        rank = np.arange(len(pair)) - np.repeat(start, np.diff(np.r_[start, len(pair)]))
        pair, via, x, y = (c[rank < first] for c in (pair, via, x, y))
    return [heads[pair // len(tails)], tails[pair % len(tails)], via, x, y]


def meetings(ratings: DataFrame, pairs: DataFrame, first: int | None, give: Callable[..., dict], schema: str, block: int | None = None) -> DataFrame:
    """What ``give`` makes of the common ``via`` of wanted pairs (a, b) of keys, by ``ratings`` (key, via, value: long, long, double).

    Keys fall into blocks by hash; a task has the ratings of two blocks and the wanted pairs
    between them, and joins them in memory, so no row moves for a common via. Ratings are
    dealt once for each block, as many blocks of the a at once as COPIES allows; what was
    dealt for them goes before the next. ``first`` bounds the common via of a pair, by via.
    ``give`` takes the arrays of ``_meet`` and returns columns of ``schema`` by name. Rows with nulls take no part.
    """
    spark = ratings.sparkSession
    scratch = Scratch(spark, "meetings")
    lists = ratings.dropna().groupBy(F.col("key").cast("long").alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col("via").cast("long").alias("via"), F.col("value").cast("double").alias("value")))).alias("l"))
    lists = scratch.save(lists.select("key", F.col("l.via").alias("vias"), F.col("l.value").alias("values")))
    asked = scratch.save(pairs.select("a", "b").dropna().groupBy(F.col("a").cast("long").alias("key")).agg(F.sort_array(F.collect_set(F.col("b").cast("long"))).alias("vias")))
    parts = max(1, math.ceil((lists.agg(F.sum(F.size("vias"))).first()[0] or 0) / (block or BLOCK)))
    together = max(1, COPIES * parts // (parts + 1))
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [])

        def made() -> Iterator[pa.RecordBatch]:
            mine, theirs, pairs = ([np.concatenate(c) for c in zip(*h, strict=True)] for h in held) if all(held) else (None,) * 3
            for h in held:
                h.clear()
            if mine:
                out = give(*_meet(mine, theirs, pairs[:2], first))
                yield from pa.Table.from_pydict(out).to_batches(max_chunksize=50_000)

        for batch in batches:
            x, y, kind, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sizes = batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            vias, values = batch.column(4).flatten().to_numpy(zero_copy_only=False), batch.column(5).flatten().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(sizes)]
            v_ends = np.r_[0, np.cumsum(np.where(kind == 2, 0, sizes))]
            cuts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (kind[1:] != kind[:-1])]).tolist() if len(x) else []
            for s, e in zip(cuts, [*cuts[1:], len(x)], strict=True):
                if (int(x[s]), int(y[s])) != at:
                    if at is not None:
                        yield from made()
                    at = int(x[s]), int(y[s])
                held[kind[s]].append((np.repeat(key[s:e], sizes[s:e]), vias[ends[s] : ends[e]].copy(), values[v_ends[s] : v_ends[e]].copy()))
        if at is not None:
            yield from made()

    out = None
    for low in range(0, parts, together):
        here = list(range(low, min(low + together, parts)))
        own = lists.withColumn("own", deal("key"))
        mine = own.where(F.col("own").isin(here)).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(F.col("own").alias("x"), "y", F.lit(0).alias("kind"), "key", "vias", "values")
        theirs = own.withColumn("x", F.explode(F.array(*map(F.lit, here)))).select("x", F.col("own").alias("y"), F.lit(1).alias("kind"), "key", "vias", "values")
        wanted = asked.withColumn("x", deal("key")).where(F.col("x").isin(here)).select("key", "x", F.explode("vias").alias("b")).groupBy("key", "x", deal("b").alias("y")).agg(F.collect_list("b").alias("vias"))
        cells = mine.unionByName(theirs).unionByName(wanted.select("x", "y", F.lit(2).alias("kind"), "key", "vias", F.array().cast("array<double>").alias("values")))
        cells = cells.repartition(max(parts * len(here), 1) * 2, "x", "y").sortWithinPartitions("x", "y", "kind")
        part = scratch.save(cells.select("x", "y", "kind", "key", "vias", "values").mapInArrow(run, schema))
        if parts > together:
            spark._jvm.System.gc()  # frees what was dealt
        out = part if out is None else out.unionByName(part)
    return out


def user_based(train: DataFrame, test: DataFrame) -> DataFrame:
    """(user, item, prediction) from all users who rated the item, weighted by their similarity.

    Similarity is the centred cosine (means over all of a user's ratings) over all common
    items but the predicted one; 0 without common items.
    """
    mean = train.groupBy("user").agg(F.avg("rating").alias("mean"))
    centred = train.join(mean, "user").select("user", "item", (F.col("rating") - F.col("mean")).alias("d"))
    asked = test.select("user", "item").distinct()
    pairs = asked.join(centred.select(F.col("user").alias("v"), "item", F.col("d").alias("dv_item")), "item")
    # For two users once, whatever items are asked for: each leaves its own out.

    def lists(u: np.ndarray, v: np.ndarray, i: np.ndarray, du: np.ndarray, dv: np.ndarray) -> dict:
        start = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.zeros(0, np.int64)
        shared = pa.StructArray.from_arrays([pa.array(i), pa.array(du), pa.array(dv)], ["i", "du", "dv"])
        return {"user": u[start], "v": v[start], "shared": pa.ListArray.from_arrays(pa.array(np.r_[start, len(u)], pa.int32()), shared)}

    wanted = pairs.select(F.col("user").alias("a"), F.col("v").alias("b"))
    shared = meetings(centred.select(F.col("user").alias("key"), F.col("item").alias("via"), F.col("d").alias("value")), wanted, None, lists, "user long, v long, shared array<struct<i: long, du: double, dv: double>>")
    used = F.filter("shared", lambda x: x["i"] != F.col("item"))
    total = lambda f: F.aggregate("used", F.lit(0.0), lambda s, x: s + f(x))
    num, den = total(lambda x: x["du"] * x["dv"]), F.sqrt(total(lambda x: x["du"] * x["du"]) * total(lambda x: x["dv"] * x["dv"]))
    both = pairs.join(shared, ["user", "v"], "left").withColumn("used", used).withColumns({"num": num, "den": den})
    sims = both.select("user", "item", "dv_item", F.when((F.col("num") != 0) & (F.col("den") != 0), F.try_divide("num", "den")).otherwise(0.0).alias("sim"))
    sums = sims.groupBy("user", "item").agg(F.sum(F.col("dv_item") * F.col("sim")).alias("num"), F.sum(F.abs("sim")).alias("den"))
    out = asked.join(sums, ["user", "item"], "left").join(mean, "user", "left")
    return out.select("user", "item", F.when(F.col("den") > 0, F.col("mean") + F.try_divide("num", "den")).otherwise(0.0).alias("prediction"))


def item_cosines(train: DataFrame, pairs: DataFrame, co_raters: int | None = None) -> DataFrame:
    """(a, b, sim): the raw cosine of the ratings of items ``a`` and ``b`` by all users who rated both, or the first ``co_raters`` by id."""

    def sums(a: np.ndarray, b: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        total = lambda c: np.add.reduceat(c, start) if len(start) else np.zeros(0)
        return {"a": a[start], "b": b[start], "num": total(x * y), "den": np.sqrt(total(x * x) * total(y * y))}

    both = meetings(train.select(F.col("item").alias("key"), F.col("user").alias("via"), F.col("rating").alias("value")), pairs, co_raters, sums, "a long, b long, num double, den double")
    return both.select("a", "b", F.try_divide("num", "den").alias("sim")).where("sim is not null")


def item_pairs(train: DataFrame, test: DataFrame) -> DataFrame:
    """(user, a, b, rating): each test row's item ``a`` with every item ``b`` that the user rated."""
    asked = test.select("user", F.col("item").alias("a")).distinct()
    return asked.join(train.select("user", F.col("item").alias("b"), "rating"), "user").where("a <> b")


def item_based(train: DataFrame, test: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """(user, item, prediction): the user's ratings weighted by their items' similarity.

    With ``similar`` (a, b), an item that has similar items is predicted from those of the
    user's items only; an item that has none from all.
    """
    pairs = item_pairs(train, test)
    if similar is not None:
        both = similar.select("a", "b").unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        narrowed = pairs.join(both, ["a", "b"], "left_semi")
        pairs = narrowed.unionByName(pairs.join(both.select("a").distinct(), "a", "left_anti").select(*narrowed.columns))
    cosines = item_cosines(train, pairs)
    if similar is None:  # few of the pairs have raters in common: from those to the users who ask for them
        weighted = cosines.join(test.select("user", F.col("item").alias("a")).distinct(), "a").join(train.select("user", F.col("item").alias("b"), "rating"), ["user", "b"])
    else:
        weighted = pairs.join(cosines, ["a", "b"])
    sums = weighted.groupBy("user", "a").agg(F.sum(F.col("rating") * F.col("sim")).alias("num"), F.sum(F.abs("sim")).alias("den"))
    out = test.select("user", "item").distinct().join(sums.withColumnRenamed("a", "item"), ["user", "item"], "left")
    return out.select("user", "item", F.when(F.col("den") > 0, F.try_divide("num", "den")).otherwise(0.0).alias("prediction"))


def rmse(predictions: DataFrame, test: DataFrame) -> DataFrame:
    """(rmse, n) over the rows that both have."""
    joined = predictions.join(test.select("user", "item", "rating"), ["user", "item"])
    gap = F.col("prediction") - F.col("rating")
    return joined.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count("*").alias("n"))


def recommend(train: DataFrame, test: DataFrame, method: str, similar: DataFrame | None = None) -> DataFrame:
    """Dispatch by name: als, user, item, or lsh (item-based, narrowed to ``similar``)."""
    methods = {"als": als, "user": user_based, "item": item_based, "lsh": lambda a, b: item_based(a, b, similar)}
    if method not in methods:
        raise ValueError(f"method is one of {', '.join(methods)}")
    return methods[method](train, test)
