"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node, held by their smallest id. Nodes are dealt over shards of about
``SHARD`` by a hash, those of each vector length for themselves, so that a shard's vectors
and graph fit a task whatever the size of the table. A shard's graph starts from random
hyperplane trees. Each round then joins, in Spark, the neighbours of every node with each
other (forward and reverse, ``SAMPLED`` of each, those that are new first): neighbours of
neighbours, as pairs of ids. A shard's pairs are scored together and each node keeps its
``NEIGHBOURS`` nearest. Rounds end when few entries change.

Each query is searched in all shards of its length: a task reads a shard's graph once and
then streams the queries through it. From a fixed set of entries the search goes to the
neighbours of the best nodes not yet expanded, and ends when the ``BEAM`` best are all
expanded. A crowd of nearly equal vectors would fill the beam, so the search sees one
leader of a crowd; a query that has the leader in its beam is scored against the whole
crowd. What shards find is merged and scored in double precision, component by component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import hash128

SHARD = 8192
NEIGHBOURS = 24
SAMPLED = 10
TREES = 4
LEAF = 96
#: Rounds end when fewer than this share of entries is new, or after so many.
STILL, ROUNDS = 0.02, 8
BEAM, EXPAND, ENTRIES = 512, 16, 32
#: Cosine to its leader of a member of a crowd, and least size of one.
CLOSE, CROWD = 0.95, 8
#: Queries that are searched together.
BLOCK = 256

_GRAPH = "shard long, id long, vec array<double>, near array<long>, sims array<float>, fresh array<boolean>, moved int"


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, vec, a, b): vectors that take part, with a hash of each.

    Null vectors and ids, vectors with null or non-finite components and zero vectors do not.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(fine & F.exists("vec", lambda x: x != 0))
    a, b = hash128(F.col("vec"))
    return rows.select("vec_id", "vec", a.alias("a"), b.alias("b"))


def _best(src: np.ndarray, dst: np.ndarray, sims: np.ndarray, old: np.ndarray, n: int, k: int) -> list[np.ndarray]:
    """For each of ``n`` sources the places of its k best entries; an entry that is there twice counts once, the old one."""
    order = np.lexsort((~old, dst, src))
    s, d = src[order], dst[order]
    order = order[np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])]] if len(order) else order
    order = order[np.lexsort((dst[order], -sims[order], src[order]))]
    cuts = np.searchsorted(src[order], np.arange(n + 1))
    return [order[i : min(j, i + k)] for i, j in zip(cuts, cuts[1:], strict=False)]


def _rows(shard: int, ids: np.ndarray, vecs: list, best: list[np.ndarray], dst: np.ndarray, sims: np.ndarray, fresh: np.ndarray, added: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({
        "shard": np.int64(shard), "id": ids, "vec": vecs, "near": [ids[dst[o]] for o in best], "sims": [sims[o] for o in best],
        "fresh": [fresh[o] for o in best], "moved": np.array([added[o].sum() for o in best], np.int32),
    })


def _start(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's first graph: nearest nodes in the leaves of random hyperplane trees."""
    frame = frame.sort_values("id").reset_index(drop=True)
    v = np.stack(frame["vec"].to_numpy()).astype(np.float32)
    n, rng = len(v), np.random.default_rng(17)
    parts = []
    for _ in range(TREES):
        todo = [np.arange(n)]
        while todo:
            leaf = todo.pop()
            if len(leaf) > LEAF:
                o = np.argsort(v[leaf] @ rng.normal(size=v.shape[1]).astype(np.float32), kind="stable")
                todo += [leaf[o[: len(o) // 2]], leaf[o[len(o) // 2 :]]]
                continue
            s = v[leaf] @ v[leaf].T
            np.fill_diagonal(s, -np.inf)
            k = min(NEIGHBOURS, len(leaf) - 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(leaf), 0), np.int64)
            parts.append((np.repeat(leaf, k), leaf[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
    src, dst, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
    best = _best(src, dst, sims, np.zeros(len(src), bool), n, NEIGHBOURS)
    new = np.ones(len(src), bool)
    return _rows(frame["shard"].iloc[0], frame["id"].to_numpy(), list(frame["vec"]), best, dst, sims, new, new)


def _improve(pairs: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's graph after the pairs of one round."""
    if not len(frame):
        return pd.DataFrame({c.split()[0]: [] for c in _GRAPH.split(", ")})
    frame = frame.sort_values("id").reset_index(drop=True)
    ids = frame["id"].to_numpy()
    n = len(ids)
    v = np.stack(frame["vec"].to_numpy()).astype(np.float32)
    have = np.repeat(np.arange(n), frame["near"].str.len().to_numpy())
    near = np.searchsorted(ids, np.concatenate(frame["near"].to_numpy()))
    key = np.unique(np.searchsorted(ids, pairs["x"].to_numpy()) * n + np.searchsorted(ids, pairs["y"].to_numpy())) if len(pairs) else np.zeros(0, np.int64)
    a, b = key // n, key % n
    sims = np.concatenate([np.einsum("nd,nd->n", v[a[i : i + 65536]], v[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0, np.float32)])
    worst = np.array([s[-1] if len(s) == NEIGHBOURS else -np.inf for s in frame["sims"]])
    to_a, to_b = sims > worst[a], sims > worst[b]
    src, dst = np.concatenate([have, a[to_a], b[to_b]]), np.concatenate([near, b[to_a], a[to_b]])
    scores = np.concatenate([np.concatenate(frame["sims"].to_numpy()), sims[to_a], sims[to_b]]).astype(np.float32)
    old = np.arange(len(src)) < len(have)
    fresh = np.concatenate([np.concatenate(frame["fresh"].to_numpy()).astype(bool), np.ones(len(src) - len(have), bool)])
    return _rows(frame["shard"].iloc[0], ids, list(frame["vec"]), _best(src, dst, scores, old, n, NEIGHBOURS), dst, scores, fresh, ~old)


def graph(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The graph of ``nodes`` (shard, id, vec): a row for each, with its neighbours."""
    state = scratch.save(nodes.groupBy("shard").applyInPandas(_start, _GRAPH))
    total = state.count()
    for step in range(ROUNDS):
        ranked = F.expr(f"slice(array_sort(zip_with(near, fresh, (v, f) -> struct(not f as late, xxhash64(v, id, {step}) as h, v as v))), 1, {SAMPLED})")
        state = state.withColumn("taken", ranked)
        forward = state.select("shard", F.col("id").alias("pivot"), F.explode("taken").alias("t")).select("shard", "pivot", F.col("t.v").alias("m"), "t.late", "t.h")
        last = Window.partitionBy("pivot").orderBy("late", "h", "m")
        reverse = forward.select("shard", F.col("m").alias("pivot"), F.col("pivot").alias("m"), "late", "h").withColumn("r", F.row_number().over(last)).where(F.col("r") <= SAMPLED)
        # A node meets its reverse neighbours as a member of its own list.
        own = state.select("shard", F.col("id").alias("pivot"), F.col("id").alias("m"), F.lit(True).alias("late"))
        members = scratch.save(forward.select("shard", "pivot", "m", "late").unionByName(reverse.select("shard", "pivot", "m", "late")).unionByName(own).groupBy("shard", "pivot", "m").agg(F.min("late").alias("late")))
        x, y = members.alias("x"), members.alias("y")
        pairs = x.join(y, F.col("x.pivot") == F.col("y.pivot")).where((F.col("x.m") < F.col("y.m")) & ~(F.col("x.late") & F.col("y.late"))).select("x.shard", F.col("x.m").alias("x"), F.col("y.m").alias("y"))
        used = F.expr("zip_with(near, fresh, (v, f) -> f and not exists(taken, t -> t.v = v))")
        after = scratch.save(pairs.groupBy("shard").cogroup(state.withColumn("fresh", used).drop("taken").groupBy("shard")).applyInPandas(_improve, _GRAPH))
        scratch.drop(members)
        state = after
        if (state.agg(F.sum("moved")).first()[0] or 0) < STILL * NEIGHBOURS * total:
            break
    return state


def leaders(v: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The leader of each node: itself, or for a node in a crowd the first member that is close enough.

    Crowds are sought in the components of the graph's edges between close nodes.
    """
    n = len(v)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    src, dst = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    close = np.concatenate([np.einsum("nd,nd->n", unit[src[i : i + 65536]], unit[dst[i : i + 65536]]) >= CLOSE for i in range(0, len(src), 65536)])
    src, dst = src[close], dst[close]
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, src, label[dst])
        np.minimum.at(new, dst, label[src])
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.arange(n)
    order = np.argsort(label, kind="stable")
    for rest in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        while len(rest) >= CROWD:
            member = unit[rest] @ unit[rest[0]] >= CLOSE
            member[0] = True
            out[rest[member]] = rest[0]
            rest = rest[~member]
    return out


def thinned(v: np.ndarray, near: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The graph among leaders: edges of a crowd are its leader's, those to it too, and the nearest stay."""
    n = len(v)
    src, dst = lead[np.repeat(np.arange(n), near.shape[1])], lead[near.ravel()]
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    src, dst = src[src != dst], dst[src != dst]
    sims = np.concatenate([np.einsum("nd,nd->n", v[src[i : i + 65536]], v[dst[i : i + 65536]]) for i in range(0, len(src), 65536)] or [np.zeros(0)])
    out = np.repeat(np.arange(n)[:, None], near.shape[1], axis=1)
    for row, o in zip(out, _best(src, dst, sims, np.ones(len(src), bool), n, near.shape[1]), strict=True):
        row[: len(o)] = dst[o]
    return out


def greedy(v: np.ndarray, near: np.ndarray, among: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam of each query at its end: places (-1: none) and similarities.

    ``near`` holds each node's neighbours, padded with the node itself; entries are of ``among``.
    """
    n, m, beam = len(v), len(q), max(BEAM, k)
    rows = np.arange(m)[:, None]
    entry = np.random.default_rng(5).choice(among, min(ENTRIES, len(among)), False)
    seen = np.zeros((m, n), bool)
    seen[:, entry] = True
    pad = max(0, beam - len(entry))
    ids = np.concatenate([np.tile(entry, (m, 1)), np.full((m, pad), -1)], axis=1)
    sims = np.concatenate([q @ v[entry].T, np.full((m, pad), -np.inf, np.float32)], axis=1)
    done = ids < 0
    while True:
        open_sims = np.where(done, -np.inf, sims)
        top = np.argpartition(-open_sims, min(EXPAND, ids.shape[1] - 1), axis=1)[:, :EXPAND]
        live = np.take_along_axis(open_sims, top, 1) > -np.inf
        if not live.any():
            break
        np.put_along_axis(done, top, True, 1)
        found = np.sort(np.where(live[:, :, None], near[np.take_along_axis(ids, top, 1)], n).reshape(m, -1), axis=1)
        new = found < n
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        new &= ~seen[rows, np.minimum(found, n - 1)]
        r, c = np.nonzero(new)
        seen[r, found[r, c]] = True
        scores = np.full(found.shape, -np.inf, np.float32)
        scores[r, c] = np.einsum("nd,nd->n", q[r], v[found[r, c]])
        ids, sims, done = np.concatenate([ids, np.where(new, found, -1)], axis=1), np.concatenate([sims, scores], axis=1), np.concatenate([done, ~new], axis=1)
        best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        ids, sims, done = (np.take_along_axis(x, best, 1) for x in (ids, sims, done))
    return ids, sims


def expanded(v: np.ndarray, crowds: dict[int, np.ndarray], q: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) places of the ``k`` best of each beam and of the crowds whose leaders are in it."""
    r, c = np.nonzero(ids >= 0)
    rows, nodes, scores = [r], [ids[r, c]], [sims[r, c]]
    for leader, members in crowds.items():
        asking = np.flatnonzero((ids == leader).any(axis=1))
        s = q[asking] @ v[members].T  # at most a block of queries by a shard
        top = np.argpartition(-s, min(k, len(members)) - 1, axis=1)[:, :k]
        rows.append(np.repeat(asking, top.shape[1]))
        nodes.append(members[top].ravel())
        scores.append(np.take_along_axis(s, top, 1).ravel())
    src, dst = np.concatenate(rows), np.concatenate(nodes)
    best = np.concatenate(_best(src, dst, np.concatenate(scores), np.ones(len(src), bool), len(q), k))
    return src[best], dst[best]


class _Index:
    """A shard's graph, ready for searches."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.ids = rows["id"].to_numpy()  # sorted
        self.exact = rows["vec"].combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1)
        self.v = self.exact.astype(np.float32)
        near = np.repeat(np.arange(len(self.ids))[:, None], NEIGHBOURS, axis=1)
        for row, x in zip(near, rows["near"].to_pylist(), strict=True):
            row[: len(x)] = np.searchsorted(self.ids, x)
        lead = leaders(self.v, near)
        self.near = thinned(self.v, near, lead)
        self.crowds = {int(x): np.flatnonzero(lead == x) for x in np.unique(lead[lead != np.arange(len(lead))])}
        self.among = np.flatnonzero(lead == np.arange(len(lead)))

    def search(self, ids: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
        """(query, node, score): the ``k`` nearest found; scores are sums from the first component to the last."""
        short = q.astype(np.float32)
        r, node = expanded(self.v, self.crowds, short, *greedy(self.v, self.near, self.among, short, k), k)
        return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(self.ids[node]), pa.array(np.cumsum(q[r] * self.exact[node], axis=1)[:, -1])], ["query", "node", "score"])


def _searched(state: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, node, score) of queries (shard, id, vec) in the graphs of their shards."""
    rows = state.select("shard", F.lit(0).alias("kind"), "id", "vec", "near").unionByName(asked.select("shard", F.lit(1).alias("kind"), "id", "vec", F.lit(None).cast("array<long>").alias("near")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, index = None, [], None
        for b in batches:
            shards, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            ends = np.flatnonzero(np.r_[(shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1]), True]) + 1
            for s, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if s == e:
                    continue
                if shards[s] != shard:
                    shard, parts, index = shards[s], [], None
                if kinds[s] == 0:
                    parts.append(b.slice(s, e - s))
                    continue
                if index is None:
                    index, parts = _Index(parts), []
                for at in range(s, e, BLOCK):
                    part = b.slice(at, min(BLOCK, e - at))
                    yield index.search(part.column(2).to_numpy(), part.column(3).flatten().to_numpy().reshape(len(part), -1), k)

    return rows.repartition("shard").sortWithinPartitions("shard", "kind", "id").mapInArrow(run, "query long, node long, score double")


def nearest(table: DataFrame, *, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``.

    Ties go to the smaller vec_id. Defined results: rows that ``usable`` leaves out are
    neither queries nor candidates; a query's candidates are the vectors of its length, as
    with others it has no inner product; equal vectors are all candidates of each other,
    with the same score; rows that share a vec_id and vector count once; with k candidates
    or fewer all that are found are given; an empty table gives no rows; other columns are
    not read.
    """
    scratch = Scratch(table.sparkSession, "neighbours")
    rows = usable(table).dropDuplicates(["vec_id", "a", "b"])
    # Of a vector's copies no query needs more than the k + 1 smallest ids.
    order = Window.partitionBy("a", "b").orderBy("vec_id")
    kept = scratch.save(rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1))
    heads = kept.where("r = 1").select(F.col("vec_id").alias("id"), "vec", "a", "b", F.size("vec").alias("dim"))
    sizes = heads.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).alias("shards"))  # a row for each length that vectors have
    place = F.col("dim").cast("long") * (1 << 32)
    nodes = scratch.save(heads.join(F.broadcast(sizes), "dim").withColumn("shard", place + F.pmod(F.xxhash64("a", "b", "id"), F.col("shards"))))
    state = graph(nodes.select("shard", "id", "vec"), scratch)

    head = nodes.select("id", "a", "b")
    asked = scratch.save(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "a", "b").join(head, ["a", "b"]).select("query_id", F.col("id").alias("query")))
    queries = nodes.join(asked.select(F.col("query").alias("id")).distinct(), "id", "left_semi")
    found = _searched(state, queries.select("id", "vec", place.alias("place"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("i")).select("id", "vec", (F.col("place") + F.col("i")).alias("shard")), k + 1)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    members = kept.select("a", "b", F.col("vec_id").alias("member")).join(head, ["a", "b"]).select(F.col("id").alias("node"), "member")
    # Among the copies of k + 1 nodes the k best rows are ranked once for each query vector, then joined to its queries.
    ranked = found.join(members, "node").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "member"))).where(F.col("r") <= k + 1)
    out = asked.join(scratch.save(ranked.drop("r", "node")), "query").where("member <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "member"))
    return out.select("query_id", rank.alias("rank"), F.col("member").alias("vec_id"), "score").where(F.col("rank") <= k)
