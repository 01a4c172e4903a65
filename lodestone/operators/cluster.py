"""BFR clustering with mergeable summaries over points (id, features).

The discard set (DS) holds the k clusters, compression sets (CS) hold groups near no
cluster, the retained set (RS) single points. Cluster summaries are small (k rows, or a row
for each compression set) and are sent as column literals; points stay in Spark.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import centroid, deviation, summaries
from ..scratch import Scratch

Summary = dict  # label -> (n, sum, sumsq)


def kmeans(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``points`` with ``cluster``, by k-means (rows, as blocks of few points overrun their buffers)."""
    vectors = points.withColumn("_v", array_to_vector("features"))
    model = KMeans(k=max(2, k), seed=seed, featuresCol="_v", predictionCol="cluster", solver="row").fit(vectors)
    return model.transform(vectors).drop("_v")


def collect_summaries(points: DataFrame, key: str) -> Summary:
    """Summaries by label: a row for each cluster."""
    return {r[key]: (r["n"], list(r["sum"]), list(r["sumsq"])) for r in summaries(points, key).collect()}


def stats(s: tuple) -> tuple[list[float], list[float]]:
    n, total, squares = s
    return [x / n for x in total], [math.sqrt(max(q / n - (x / n) ** 2, 0.0)) for x, q in zip(total, squares, strict=True)]


def merge(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)], [x + y for x, y in zip(a[2], b[2], strict=True)]


def distance(features: Column, c: list[float], sd: list[float]) -> Column:
    """Diagonal Mahalanobis distance; in a dimension without spread equal values count 0, others are infinitely far."""
    parts = F.zip_with(features, F.zip_with(F.array(*map(F.lit, c)), F.array(*map(F.lit, sd)), lambda m, s: F.struct(m.alias("m"), s.alias("s"))), lambda x, p: F.when(p["s"] > 0, F.pow((x - p["m"]) / p["s"], F.lit(2.0))).when(x == p["m"], 0.0).otherwise(float("inf")))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def assign(points: DataFrame, clusters: Summary, factor: float = 2.0) -> DataFrame:
    """``points`` with ``cluster`` and ``distance`` of the nearest cluster, -1 and null if none is nearer than factor * sqrt(d)."""
    if not clusters:
        return points.withColumn("cluster", F.lit(-1).cast("int")).withColumn("distance", F.lit(None).cast("double"))
    near = F.array_min(F.array(*(F.struct(distance(F.col("features"), *stats(s)).alias("d"), F.lit(int(k)).alias("k")) for k, s in sorted(clusters.items()))))
    found = points.withColumn("_near", near)
    within = F.col("_near.d") < factor * F.sqrt(F.size("features"))
    return found.withColumn("cluster", F.when(within, F.col("_near.k")).otherwise(-1)).withColumn("distance", F.when(within, F.col("_near.d"))).drop("_near")


def apart(a: tuple, b: tuple) -> float:
    """The smaller of the distances from one centroid to the other cluster."""

    def one(c: list[float], s: tuple) -> float:
        m, sd = stats(s)
        return math.sqrt(sum(((x - y) / d) ** 2 if d > 0 else 0.0 if x == y else math.inf for x, y, d in zip(c, m, sd, strict=True)))

    return min(one(stats(a)[0], b), one(stats(b)[0], a))


#: Clusters whose summaries are broadcast.
FEW = 10_000


def merge_candidates(clusters: DataFrame) -> DataFrame:
    """(a, b, distance) of pairs of summaries (label, n, sum, sumsq) nearer than 2 sqrt(d).

    Up to FEW clusters one side is broadcast; more are dealt into blocks, and each pair of
    blocks meets in a join of its own.
    """
    rows = clusters.select("label", centroid().alias("c"), deviation().alias("sd"))
    x, y = rows.select(F.col("label").alias("a"), F.col("c").alias("ca"), F.col("sd").alias("sa")), rows.select(F.col("label").alias("b"), F.col("c").alias("cb"), F.col("sd").alias("sb"))
    square = lambda sd: F.sqrt(F.aggregate(F.zip_with(F.zip_with("ca", "cb", lambda p, q: p - q), sd, lambda d, s: F.when(s > 0, F.pow(d / s, F.lit(2.0))).when(d == 0, 0.0).otherwise(float("inf"))), F.lit(0.0), lambda a, v: a + v))
    n = clusters.count()
    if n <= FEW:
        pairs = x.join(F.broadcast(y), F.col("a") < F.col("b"))
    else:
        blocks = -(-n // FEW)
        dealt = lambda rows, key, own, other: rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
        pairs = dealt(x, "a", "i", "j").join(dealt(y, "b", "j", "i"), ["i", "j"]).where("a < b")
    return pairs.select("a", "b", F.least(square("sa"), square("sb")).alias("distance"), F.size("ca").alias("dims")).where("distance < 2 * sqrt(dims)").select("a", "b", "distance")


def bfr(points: DataFrame, k: int, scratch: Scratch, rounds: int = 5, seed: int = 0) -> tuple[list[tuple[int, int, int, int, int]], DataFrame]:
    """Rounds (round, points in DS, compression sets, points in CS, points in RS) and (id, cluster), -1 outside DS.

    Each round takes the points of one hash bucket, so every point is seen once; the last
    round merges compression sets into clusters. Points with equal features are told apart
    by their id.
    """
    dealt = scratch.save(points.select("id", "features", F.pmod(F.xxhash64("id"), F.lit(rounds)).alias("round")))
    first = dealt.where("round = 0").drop("round")
    total = first.count()
    rough = scratch.save(kmeans(first, min(10 * k, max(2, total - 1)), seed))
    crowd = rough.groupBy("cluster").count().where("count > 1").select("cluster")
    dense = rough.join(crowd, "cluster", "left_semi").drop("cluster")
    retained = scratch.save(rough.join(crowd, "cluster", "left_anti").select("id", "features"))
    placed = scratch.save(kmeans(dense, k, seed).select("id", "features", "cluster"))
    ds = collect_summaries(placed, "cluster")
    in_ds, cs, in_cs = [placed.select("id", "cluster")], {}, []
    report = []
    made = 0  # labels of compression sets are never used twice

    def gather(rs: DataFrame) -> DataFrame:
        """Groups of the retained set become compression sets; single points stay."""
        n = rs.count()
        if n < 4:
            return rs
        grouped = scratch.save(kmeans(rs, n // 2 + 1, seed).select("id", "features", "cluster"))
        many = grouped.groupBy("cluster").count().where("count > 1").select("cluster")
        nonlocal made
        kept = scratch.save(grouped.join(many, "cluster", "left_semi").withColumn("cluster", F.col("cluster") + made))
        made += n // 2 + 1
        cs.update(collect_summaries(kept, "cluster"))
        in_cs.append(kept.select("id", "cluster"))
        return scratch.save(grouped.join(many, "cluster", "left_anti").select("id", "features"))

    retained = gather(retained)
    merged_into: dict[int, int] = {}

    def home(c: int) -> int:
        while c in merged_into:
            c = merged_into[c]
        return c

    dims = len(next(iter(ds.values()))[1])
    final: dict[int, int] = {}
    for step in range(rounds):
        if step:
            new = scratch.save(assign(dealt.where(F.col("round") == step).drop("round"), ds).drop("distance"))
            near = new.where("cluster >= 0")
            for label, s in collect_summaries(near, "cluster").items():
                ds[label] = merge(ds[label], s)
            in_ds.append(near.select("id", "cluster"))
            rest = scratch.save(assign(new.where("cluster < 0").drop("cluster"), cs).drop("distance"))
            grouped = rest.where("cluster >= 0")
            for label, s in collect_summaries(grouped, "cluster").items():
                cs[label] = merge(cs[label], s)
            in_cs.append(grouped.select("id", "cluster"))
            retained = gather(scratch.save(retained.unionByName(rest.where("cluster < 0").select("id", "features"))))
        while len(cs) > 1:  # merge the closest compression sets while they are close enough
            d, a, b = min((apart(cs[a], cs[b]), a, b) for a in cs for b in cs if a < b)
            if d >= 2 * math.sqrt(dims):
                break
            cs[a] = merge(cs[a], cs.pop(b))
            merged_into[b] = a
        if step == rounds - 1:
            for label in sorted(cs):
                d, target = min((apart(cs[label], s), t) for t, s in ds.items())
                if d < 2 * math.sqrt(dims):
                    ds[target] = merge(ds[target], cs[label])
                    final[label] = target
            for label in final:
                cs.pop(label)
        n_ds, n_cs = sum(s[0] for s in ds.values()), sum(s[0] for s in cs.values())
        report.append((step + 1, n_ds, len(cs), n_cs, retained.count()))
    fate = {c: final.get(home(c), -1) for c in {*merged_into, *cs, *final}}
    compressed = reduce(DataFrame.unionByName, in_cs) if in_cs else retained.select("id", F.lit(-1).alias("cluster")).limit(0)
    mapping = F.create_map(*(F.lit(x) for kv in sorted(fate.items()) for x in kv)) if fate else F.create_map(F.lit(-1), F.lit(-1))
    out = reduce(DataFrame.unionByName, in_ds).unionByName(compressed.select("id", F.coalesce(F.try_element_at(mapping, F.col("cluster")), F.lit(-1)).alias("cluster"))).unionByName(retained.select("id", F.lit(-1).alias("cluster")))
    return report, out
