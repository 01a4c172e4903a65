"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


#: Share of all rows that makes a node a hub: there are fewer than 2,000 of them, whatever the graph.
HUB = 1 / 1000
#: Distinct edges that the driver joins up: 4 MB of ids, whatever the graph. More go in rounds.
FEW = 1 << 18


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (u, v) with ``m``, the smallest v of each u.

    Hubs, nodes with more than ``HUB`` of the ``n`` edges, get theirs by a broadcast of at
    most 2 / HUB rows, so that no task has all rows of one node.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    hubs = least.where(F.col("k") > max(1.0, n * HUB)).select("u", F.col("m").alias("h"))
    marked = rows.join(F.broadcast(hubs), "u", "left")
    others = marked.where("h is null").select("u", "v").join(least.select("u", "m"), "u")
    return marked.where("h is not null").select("u", "v", F.col("h").alias("m")).unionByName(others)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down, n)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v")))


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v) but the smallest of each component, and the smallest that each reaches."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # of roots that an edge joins, the larger goes to the smallest
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task to at most one for each of its nodes, that join up the same nodes."""
    give = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
    held, n, tree = [], 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(2)])
        n += len(batch)
        if n > 2_000_000:
            tree, held, n = least_reached(*(np.concatenate(c) for c in zip(tree, *held, strict=True))), [], 0
            if len(tree[0]) > 4_000_000:
                yield give(*tree)
                tree = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    yield give(*least_reached(*(np.concatenate(c) for c in zip(tree, *held, strict=True))))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (u, v: long) to (u, root): the smallest node that each node reaches, for every node but the roots.

    Up to ``FEW`` edges are joined up in the driver. Of more each task keeps a forest, and
    what is left goes to the driver or takes rounds, whose number grows
    with the logarithm of a component's size. Each round's table
    is written to the shared folder; minima are combined map-side, and the joins back to
    them are plain equi-joins but for hubs.
    """
    state = scratch.save(edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    if (n := state.count()) > FEW:
        whole, state = state, scratch.save(state.mapInArrow(_forests, "u long, v long").distinct())
        scratch.drop(whole)
        n = state.count()
    if n <= FEW:
        found = state.select(F.col("u").cast("long"), F.col("v").cast("long")).toArrow()
        pairs = least_reached(*(found.column(i).to_numpy() for i in range(2)))
        return scratch.save(state.sparkSession.createDataFrame(pa.table([pa.array(x) for x in pairs], ["u", "root"]), "u long, root long").coalesce(1))
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(state)
    while before[0]:
        large = scratch.save(_large_star(state, before[0]).distinct())
        after = scratch.save(_small_star(large, before[0]).where("u <> v").distinct())
        scratch.drop(state, large)
        state, mark = after, sign(after)
        if mark == before:
            break
        before = mark
    return state.select("u", F.col("v").alias("root"))


def component_labels(vertices: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of all ``vertices`` (id), isolated ones too."""
    found = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), scratch)
    return vertices.join(found, F.col("id") == F.col("u"), "left").select("id", F.coalesce("root", "id").alias("component"))
