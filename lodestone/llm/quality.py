"""A quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks. In a chunk every byte is embedded,
learned filters slide over the bytes, each filter's largest response is kept, and a small
head turns these into the chunk's logit. The text's probability combines the mean, largest
and smallest logit of all its chunks. Only bytes are inputs.

The network learns from a bounded sample of labelled rows (``SAMPLE`` of each class). All
chunks of their whole texts take part: the filters learn on the driver from ``CHUNKS`` chunks
of each class, drawn by hash from all of them, and the last step, from a text's chunks to one
probability, from all chunks of the texts, whose logits are summed up in tasks. Every row is
then scored in its own task, with the model of some 25 kB in the closure. No shuffle but for
the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import small_batches

#: Bytes of a chunk, bytes from one chunk's start to the next, bytes of a filter, from one place of it to the next.
CHUNK, STEP, WIDTH, STRIDE = 512, 448, 8, 2
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: Labelled rows of each class that the network learns from, and chunks of each class that reach the driver.
SAMPLE, CHUNKS = 1500, 9000
STEPS, BATCH, RATE = 700, 96, 4e-3
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows that the network never learns from: crc32 of the id as text is 2 modulo 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def starts_of(n: int) -> list[int]:
    """Where chunks begin: STEP apart, the last one ends with the text."""
    return [0] if n <= CHUNK else [*range(0, n - CHUNK, STEP), n - CHUNK]


def chunks_of(data: bytes, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The chunks, padded with zero bytes, and how full each is."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((len(starts), CHUNK), np.uint8)
    for row, s in zip(out, starts, strict=True):
        part = raw[s : s + CHUNK]
        row[: len(part)] = part
    return out, np.full(len(starts), min(len(raw), CHUNK) / CHUNK, np.float32)


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    combine: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        e = self.embed[chunks]
        w = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1)[:, ::STRIDE]
        return w.reshape(len(chunks), -1, EMBED * WIDTH)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        w = self.windows(chunks)
        return (w.reshape(-1, EMBED * WIDTH) @ self.filters).reshape(len(chunks), -1, FILTERS).max(axis=1) + self.bias

    def head(self, pooled: np.ndarray, full: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.maximum(pooled, 0), full[:, None]], axis=1)
        return np.tanh(x @ self.hidden + self.hidden_bias) @ self.out + self.out_bias[0]

    def logits(self, chunks: np.ndarray, full: np.ndarray, block: int = 64) -> np.ndarray:
        return np.concatenate([self.head(self.pooled(chunks[i : i + block]), full[i : i + block]) for i in range(0, len(chunks), block)])

    def probability(self, logits: np.ndarray) -> float:
        x = (_summary(logits) - self.centre) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.combine[:-1] + self.combine[-1], -30, 30))))


def _summary(logits: np.ndarray) -> np.ndarray:
    return np.array([logits.mean(), logits.max(), logits.min(), np.log(len(logits))])


def fit(parts: list[bytes], labels: list[int], seed: int = 7) -> Network | None:
    """Train the filters and the head on chunks and the labels of their texts. None without both classes; classes count alike."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    made = [chunks_of(c, [0]) for c in parts]
    chunks, full = np.concatenate([c for c, _ in made]), np.concatenate([f for _, f in made])
    y = np.array(labels, np.float32)
    r = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    net = Network(rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), r(EMBED * WIDTH, FILTERS), np.zeros(FILTERS, np.float32), r(FILTERS + 1, HIDDEN), np.zeros(HIDDEN, np.float32), r(HIDDEN), np.zeros(1, np.float32), np.zeros(5), np.zeros(4), np.ones(4))
    names = ["embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias"]
    m, v = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    by_class = [np.flatnonzero(y == c) for c in (0, 1)]
    taps = np.arange(WIDTH)
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(rows, BATCH // 2) for rows in by_class])
        x, f, t = chunks[pick], full[pick], y[pick]
        short = np.where(rng.random(len(x)) < 0.25, rng.integers(24, CHUNK, len(x)), CHUNK)  # as texts that end early
        x[np.arange(CHUNK) >= short[:, None]] = 0
        f = np.minimum(f, short / CHUNK).astype(np.float32)
        w = net.windows(x)
        conv = (w.reshape(-1, EMBED * WIDTH) @ net.filters).reshape(len(x), -1, FILTERS)
        at = conv.argmax(axis=1)
        pre = np.take_along_axis(conv, at[:, None], 1)[:, 0] + net.bias
        inner = np.concatenate([np.maximum(pre, 0), f[:, None]], axis=1)
        hid = np.tanh(inner @ net.hidden + net.hidden_bias)
        p = 1 / (1 + np.exp(-(hid @ net.out + net.out_bias[0])))
        g = ((p - t) / len(x)).astype(np.float32)
        g_hid = np.outer(g, net.out) * (1 - hid**2)
        g_pre = (g_hid @ net.hidden.T)[:, :FILTERS] * (pre > 0)
        best = w[np.arange(len(x))[:, None], at]  # chunk, filter, window
        g_win = (g_pre[:, :, None] * net.filters.T[None]).reshape(len(x), FILTERS, EMBED, WIDTH)
        g_embed = np.zeros_like(net.embed)
        bytes_at = x[np.arange(len(x))[:, None, None], at[:, :, None] * STRIDE + taps]
        np.add.at(g_embed, bytes_at, g_win.transpose(0, 1, 3, 2))
        grads = {"embed": g_embed, "filters": np.einsum("nf,nfk->kf", g_pre, best), "bias": g_pre.sum(0), "hidden": inner.T @ g_hid, "hidden_bias": g_hid.sum(0), "out": hid.T @ g, "out_bias": g.sum(keepdims=True)}
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for k, grad in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            getattr(net, k)[...] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def combine(net: Network, summaries: np.ndarray, labels: list[int], odds: float = 1.0) -> Network:
    """Learn how the summaries of texts' logits give a probability; classes count alike, ``odds`` of label 1 then shift it."""
    net.centre, net.scale = summaries.mean(0), summaries.std(0) + 1e-3
    z = np.c_[(summaries - net.centre) / net.scale, np.ones(len(summaries))]
    t = np.array(labels, float)
    weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
    for _ in range(30):  # Newton steps of a logistic regression, slightly shrunk
        p = 1 / (1 + np.exp(-np.clip(z @ net.combine, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.05 * len(z) * np.diag([0.01, 0.01, 0.01, 0.01, 0.0]) + 1e-6 * np.eye(5)
        net.combine -= np.linalg.solve(h, z.T @ (weight * (p - t)) + 0.05 * len(z) * np.r_[0.01 * net.combine[:4], 0])
    net.combine[-1] += np.log(odds)
    return net


def sample(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """(id, quality, text): at most ``n`` labelled rows of each class that are not held out.

    Rows are taken by the hash of their id. Of labels that contradict each other the lowest
    holds; of rows that share an id the one of the least text hash.
    """
    usable = labels.where(~held_out(F.col("doc_id"))).where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("_quality"))
    one = lambda c: usable.where(f"_quality = {c}").orderBy(F.xxhash64("_id"), "_id").limit(n)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text")).join(F.broadcast(one(0).unionByName(one(1))), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_id", "_quality").agg(F.min_by("_text", F.xxhash64("_text")).alias("text")).select(F.col("_id").cast("long").alias("id"), F.col("_quality").alias("quality"), "text")


def _chunks(rows: DataFrame) -> DataFrame:
    """(quality, part) of all chunks of the rows' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for quality, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode()
                parts = [data[s : s + CHUNK] for s in starts_of(len(data))]
                yield pa.RecordBatch.from_arrays([pa.array([quality] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["quality", "part"])

    return rows.select("quality", "text").mapInArrow(run, "quality int, part binary")


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network from the labelled rows of ``docs``; None if a class has no rows.

    The driver gets at most 2 x CHUNKS chunks and then four numbers for each sampled row.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    there = {int(r.quality): r.n for r in labels.where(~held_out(F.col("doc_id"))).where("quality in (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rows = scratch.save(sample(docs, labels))
    chunks = _chunks(rows)
    order = [F.xxhash64("part"), F.col("part")]
    taken = chunks.where("quality = 0").orderBy(*order).limit(CHUNKS).unionByName(chunks.where("quality = 1").orderBy(*order).limit(CHUNKS)).collect()
    net = fit([bytes(r.part) for r in taken], [r.quality for r in taken])
    if net is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [_summary(_logits(net, text.encode())) for text in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tolist() for x in sums], pa.list_(pa.float64()))], ["id", "quality", "sums"])

    found = sorted(tuple(r) for r in rows.mapInArrow(run, "id long, quality int, sums array<double>").collect())
    return combine(net, np.array([x for *_, x in found]), [q for _, q, _ in found], there[1] / there[0])


def _logits(net: Network, data: bytes, block: int = 4096) -> np.ndarray:
    """Logits of all chunks of a text, a block of them at a time."""
    starts = starts_of(len(data))
    return np.concatenate([net.logits(*chunks_of(data, starts[i : i + block])) for i in range(0, len(starts), block)])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with ``_score``, the probability of label 1, over each whole text.

    Defined results: a null or empty text is one chunk of zero bytes and gets a score like
    any other; without a network (no labelled rows of both classes) every score is 1.0, so
    that nothing is rejected; repeated rows score alike; other columns pass through.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores: list[float] = []
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def settle() -> None:
                logits = net.logits(np.concatenate([c for c, _ in held]), np.concatenate([f for _, f in held]))
                cuts = np.r_[0, np.cumsum([len(c) for c, _ in held])]
                scores.extend(net.probability(logits[s:e]) for s, e in zip(cuts, cuts[1:], strict=False))
                held.clear()

            for text in b.column(at).to_pylist():
                if net is None:
                    scores.append(1.0)
                    continue
                data = (text or "").encode()
                if len(data) > 4096 * STEP:  # a very long text by itself, in blocks
                    if held:
                        settle()
                    scores.append(net.probability(_logits(net, data)))
                    continue
                held.append(chunks_of(data, starts_of(len(data))))
                if sum(len(c) for c, _ in held) >= 256:
                    settle()
            if held:
                settle()
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(scores, pa.float64())], [*(f"c{i}" for i in range(at)), "_score"])

    given = docs.toDF(*(f"c{i}" for i in range(at)))
    schema = ", ".join([*(f"`c{i}` {t}" for i, (_, t) in enumerate(docs.dtypes)), "`_score` double"])
    text = given[f"c{names.index('text')}"].cast("string")
    return given.withColumn("_whole", text).mapInArrow(run, schema).toDF(*names, "_score")
