"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprints have 64 bits; two are linked if at most ``tau`` bits differ. Bits that go
together over the corpus are grouped into partitions. A partition with threshold t takes
part if the sum of (t + 1) over partitions is tau + 1: any linked pair then differs in at
most t bits of one of them. Thresholds are unequal, chosen by dynamic programming on the
candidates that each choice would give, estimated from the partition's key counts over all
fingerprints.

Probing puts a fingerprint as a resident in the cells within floor(t / 2) bits of its own key
and as a visitor in those within ceil(t / 2), so that pairs up to t bits apart meet half way,
one of them a resident: thresholds are any from none and 0 up to ``MOST``. A cell's bits are ``mask``. A cell
of more than ``cell_size`` fingerprints is not paired: its other bits are partitioned again in
tau + 1 parts, and so on until cells are small (as a cell's free bits run out). Small cells are verified by popcount inside their task, which gives out a
minimum spanning forest of the links, no more edges than the cell has members: enough for
components, however many copies there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import HUB, components
from ..scratch import Scratch
from .common import small_batches, words_of

BITS = 64
#: Of the shingles' hash; near copies are sought with both, each misses others.
SEED, SECOND_SEED = 42, 1042
#: Cost of a shuffled row against a popcount of a pair, for the choice of thresholds.
ROW_COST = 300.0
#: Thresholds are chosen as for so many fingerprints at least, so that small corpora are searched as large ones are.
LEAST_SCALE = 1_000_000
#: Most fingerprints in a cell that is paired; None: as many as ``cell_size`` says.
CELL = None
#: Largest threshold of a partition.
MOST = 4
#: Buckets of shingle hashes whose counts order the shingles of a set.
CROWDS = 1 << 16
#: Documents that share a shingle and are compared with each other; of more each turn draws.
CROWD = 64
#: Shingles of crowds for which a document draws a partner in a turn.
DRAWS = 8
#: Turns go on while one links at least one in so many of the documents; then all pairs of crowds are compared.
WORTH = 100
#: Documents of a crowd that are compared in one task, with as many others.
BLOCK = 1024


def cell_size(tau: int) -> int:
    """Where dealing a cell's rows over tau + 1 finer cells costs what pairing it does."""
    return CELL or int(2 * (tau + 1) * ROW_COST)


def fingerprint(text: str | None, width: int, seeds: tuple[int, ...] = (SEED,), block: int = 1 << 16) -> list[int]:
    """SimHashes of the text's word shingles, one for each seed, as unsigned integers; zero without words."""
    words = words_of(text or "")
    if not words:
        return [0] * len(seeds)
    n = max(1, len(words) - width + 1)
    counts = np.zeros((len(seeds), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, block):
        part = words[at : min(n, at + block) + width - 1]
        shingles = list(map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))) if len(words) >= width else [b" ".join(words)]
        for row, seed in zip(counts, seeds, strict=True):
            hashes = np.array([digest(s, seed) for s in shingles], ">u8")
            row += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * row > n).tobytes(), "big") for row in counts]


def fingerprints(docs: DataFrame, width: int, seeds: tuple[int, ...] = (SEED,), keyed: bool = False) -> DataFrame:
    """(doc_id, fp0, ..): one row for each row of ``docs``, a fingerprint for each seed as a signed long; ``key``: a 128-bit hash of the words."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *(f"fp{i}" for i in range(len(seeds)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = np.array([fingerprint(t, width, seeds) for t in texts], np.uint64).reshape(-1, len(seeds)).view(np.int64)
            keys = [pa.array([xxhash.xxh3_128_digest(b" ".join(words_of(t or ""))) for t in texts], pa.binary())] if keyed else []
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(len(seeds))), *keys], [*names, "key"] if keyed else names)

    schema = ", ".join(f"{c} long" for c in names) + ", key binary" * keyed
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits how many have both: 4,096 sums over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        n = 0
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(">i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            both += bits.T @ bits
            n += len(fps)
        flat = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "n"])

    rows = nodes.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for k, n in rows:
        flat[k] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of the bits: each grows from the bit with most correlation by the bits that correlate most with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            nxt = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        groups.append(group)
    return groups


def mask_of(bits: list[int]) -> int:
    """Bit 0 is the most significant, as in the fingerprint's hexadecimal form."""
    return sum(1 << (BITS - 1 - b) for b in bits)


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def probes(bits: list[int], threshold: int) -> list[tuple[int, bool]]:
    """What a key is xored with, all sets of at most ceil(threshold / 2) of the bits, and whether it is a resident there."""
    return [(signed(mask_of(list(c))), r <= threshold // 2) for r in range(threshold - threshold // 2 + 1) for c in combinations(bits, r)]


def ball(width: int, radius: int) -> int:
    """Keys within ``radius`` bits of one."""
    return sum(math.comb(width, r) for r in range(radius + 1))


def cost(width: int, equal: float, threshold: int, n: int) -> float:
    """Rows of the probes and estimated candidates: ``equal`` (pairs of equal keys) times residents times all who come."""
    come = ball(width, threshold - threshold // 2)
    return ROW_COST * n * come + equal * come * ball(width, threshold // 2)


def allocate(widths: list[int], pairs: list[float], n: int, tau: int) -> list[int]:
    """Thresholds for the partitions (-1: not used), by dynamic programming over tau + 1 units; threshold t brings t + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, equal in zip(widths, pairs, strict=True):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for units, (spent, chosen) in best.items():
            for t in range(-1, MOST + 1):
                u, c = min(tau + 1, units + t + 1), spent + (cost(width, equal, t, n) if t >= 0 else 0.0)
                if u not in nxt or c < nxt[u][0]:
                    nxt[u] = (c, [*chosen, t])
        best = nxt
    return best.get(tau + 1, (0.0, []))[1]


def plan(nodes: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds. The number of partitions is the one of least cost were keys even."""
    n, both = bit_counts(nodes)
    scale = max(n, LEAST_SCALE)
    even = {}
    for parts in range(max(2, -(-(tau + 1) // (MOST + 1))), tau + 2):
        widths = [len(g) for g in np.array_split(np.arange(BITS), parts)]
        pairs = [scale * scale / 2 / 2**w for w in widths]
        if chosen := allocate(widths, pairs, scale, tau):
            even[parts] = sum(cost(w, p, t, scale) for w, p, t in zip(widths, pairs, chosen, strict=True) if t >= 0)
    groups = group_bits(n, both, min(even, key=even.get))
    masks = F.array(*(F.lit(signed(mask_of(g))) for g in groups))
    keys = nodes.select(F.posexplode(masks).alias("i", "mask"), "fp").select("i", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    counted = keys.groupBy("i", "key").count().groupBy("i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()
    grown = (scale / max(n, 1)) ** 2
    pairs = {i: p * grown for i, p in counted}
    return [(g, t) for g, t in zip(groups, allocate([len(g) for g in groups], [pairs.get(i, 0.0) for i in range(len(groups))], scale, tau), strict=True) if t >= 0]


def forest(fps: np.ndarray, own: np.ndarray, tau: int) -> list[tuple[int, int, int]]:
    """Minimum spanning forest of the links of a cell, by Prim's algorithm: places (lower, higher, bits).

    Links have a resident (``own``) at one end or both.

    Links are ordered by (bits, lower, higher) and so never tie; places follow ids, so that
    every cell orders the links that it shares with another cell alike.
    """
    some, linked = np.flatnonzero(own), np.zeros(len(fps), bool)
    for i in range(0, len(some), 256):
        near = np.bitwise_count(fps[some[i : i + 256], None] ^ fps) <= tau
        near[np.arange(len(near)), some[i : i + 256]] = False
        linked |= near.any(axis=0)
        linked[some[i : i + 256]] |= near.any(axis=1)
    ids = np.flatnonzero(linked)  # none in most cells
    n, fps, own = len(ids), fps[ids], own[ids]
    if not n:
        return []
    none = np.iinfo(np.int64).max
    out, at, m = [], 0, n - 1
    place, rest, has = np.arange(1, n), fps[1:].copy(), own[1:].copy()  # what is left are the first m
    least, near = np.full(m, none), np.zeros(m, np.int64)
    while m:
        bits = np.bitwise_count(rest[:m] ^ fps[at])
        new = np.flatnonzero(bits <= tau if own[at] else (bits <= tau) & has[:m])
        weight = (bits[new].astype(np.int64) * n + np.minimum(place[new], at)) * n + np.maximum(place[new], at)
        closer = weight < least[new]
        least[new[closer]], near[new[closer]] = weight[closer], at
        i = int(np.argmin(least[:m]))  # where all are out of reach, any starts anew
        at, m = int(place[i]), m - 1
        if least[i] < none:
            out.append((int(ids[min(at, near[i])]), int(ids[max(at, near[i])]), int(least[i]) // (n * n)))
        for x in (place, rest, has, least, near):
            x[i] = x[m]
    return out


def finer(mask: int, tau: int) -> list[int]:
    """Masks of the cells that a large cell of ``mask`` is dealt over: its other bits in tau + 1 parts."""
    rest = [b for b in range(BITS) if not (mask >> (BITS - 1 - b)) & 1]
    return [mask | mask_of([int(b) for b in g]) for g in np.array_split(rest, min(len(rest), tau + 1)) if len(g)]


def owns(mask: int, value: int, x: int, y: int, chosen: list[tuple[int, int]], tau: int) -> bool:
    """Whether the cell is the one of all cells where x and y meet that gives out their link.

    That is the first partition where they meet, there the cell half way between them, and
    in a large cell the first part that they agree on. A link of the minimum spanning
    forest of all links is in the forest of any cell that holds both its ends, so giving
    it out once is enough.
    """
    for at, threshold in chosen:
        diff = (x ^ y) & at
        if diff.bit_count() <= threshold:
            v = min(x & at, y & at)
            for _ in range(diff.bit_count() // 2):
                v ^= diff & -diff
                diff &= diff - 1
            break
    else:
        return False
    while (at, v) != (mask, value):
        if at & ~mask or at == mask:
            return False
        for m in finer(at, tau):
            if not (x ^ y) & m & ~at:
                at, v = m, v | (x & m & ~at)
                break
        else:
            return False
    return True


def _verified(cells: DataFrame, chosen: list[tuple[int, int]], tau: int) -> DataFrame:
    """(u, v, bits) of small cells; a cell's rows stand together and are never more than ``cell_size``."""
    together = cells.repartition("mask", "value").sortWithinPartitions("mask", "value", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def links(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            mask, value, fp, ids, own = parts
            ends = np.flatnonzero(np.r_[(mask[1:] != mask[:-1]) | (value[1:] != value[:-1]), True]) + 1
            starts = np.r_[0, ends[:-1]]
            fp, mask, value = fp.view(np.uint64), mask.view(np.uint64), value.view(np.uint64)  # a popcount of signed numbers counts their absolute values
            pair = starts[ends - starts == 2]  # most cells of more than one: no need for a loop
            bits = np.bitwise_count(fp[pair] ^ fp[pair + 1])
            near = (bits <= tau) & (own[pair] | own[pair + 1])
            found = list(zip(pair[near].tolist(), (pair[near] + 1).tolist(), bits[near].tolist(), strict=True))
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                found += ((s + i, s + j, d) for i, j, d in forest(fp[s:e], own[s:e], tau))
            rows = [(int(ids[j]), int(ids[i]), d) for i, j, d in found if owns(int(mask[i]), int(value[i]), int(fp[i]), int(fp[j]), chosen, tau)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["u", "v", "bits"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(new[0]):
                continue
            if held:
                new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = (new[0] == new[0][-1]) & (new[1] == new[1][-1])
            cut = int(np.argmax(last))
            held = [x[cut:] for x in new]
            if cut:
                yield from links([x[:cut] for x in new])
        if held:
            yield from links(held)

    return together.select("mask", "value", "fp", "id", "own").mapInArrow(run, "u long, v long, bits long")


def links(nodes: DataFrame, tau: int, scratch: Scratch) -> DataFrame:
    """(u, v, bits) that connect all fingerprints of ``nodes`` (fp, id: each once) at most ``tau`` bits apart."""
    chosen = plan(nodes, tau)
    roots = [(mask_of(g), t) for g, t in chosen]
    keys = F.array(*(F.struct(F.lit(signed(mask_of(g))).alias("mask"), F.lit(x).alias("flip"), F.lit(own).alias("own")) for g, t in chosen for x, own in probes(g, t)))
    cells = nodes.select(F.explode(keys).alias("k"), "fp", "id").select("k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip")).alias("value"), "fp", "id", "k.own")
    found = None
    while True:
        large = scratch.save(cells.groupBy("mask", "value").count().where(f"count > {cell_size(tau)}").drop("count"))
        masks = [r.mask for r in large.select("mask").distinct().collect()]  # one for each partition of each level
        small = _verified(cells.join(large, ["mask", "value"], "left_anti") if masks else cells, roots, tau)
        found = small if found is None else found.unionByName(small)
        if not masks:
            return found
        cells = cells.join(large, ["mask", "value"], "left_semi")
        parts = []
        for mask in masks:
            under = [signed(m) for m in finer(mask % (1 << BITS), tau)]
            parts.append(F.when(F.col("mask") == mask, F.array(*map(F.lit, under))))
        # The value a cell was visited under is kept in the bits of its mask, whatever the fingerprint has there.
        cells = cells.select(F.col("mask").alias("old"), F.col("value").alias("kept"), F.explode(F.coalesce(*parts)).alias("mask"), "fp", "id", "own")
        new_bits = F.col("fp").bitwiseAND(F.col("mask").bitwiseAND(F.bitwise_not("old")))
        cells = scratch.save(cells.select("mask", F.col("kept").bitwiseOR(new_bits).alias("value"), "fp", "id", "own").groupBy("mask", "value", "fp", "id").agg(F.max("own").alias("own")))  # one cell may come from two


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, grams): the distinct shingle hashes of a text, sorted, as bytes; no words: none."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                words = words_of(text or "")
                shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)] * bool(words)
                out.append(np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "grams"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, grams binary")


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (u, v) whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    both = edges.join(sets.select(F.col("doc_id").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("grams").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - same
                keep.append(not total or same / total >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def crowds(sets: DataFrame) -> np.ndarray:
    """How many sets hold the shingles of each of CROWDS buckets of hashes: that many sums over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CROWDS, np.int64)
        for b in batches:
            for grams in b.column(0).to_pylist():
                counts += np.bincount((np.frombuffer(grams, np.uint64) % CROWDS).astype(np.int64), minlength=CROWDS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["k", "n"])

    out = np.zeros(CROWDS, np.int64)
    found = sets.select("grams").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # one job, not one for each partition
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def prefixes(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(gram, doc, n, at): the first shingles of each set (doc_id, grams), n in all, of which two sets of ``similarity`` share one.

    Shingles are ordered by how many sets hold their bucket, rare ones first. Of two sets
    that similar, a shingle is in the first 1 - ``similarity`` of both.
    """
    counts = crowds(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, grams in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(grams, np.uint64)
                n = len(x)
                first = x[np.lexsort((x, counts[(x % CROWDS).astype(np.int64)]))[: n - math.ceil(similarity * n - 1e-9) + 1]]
                m = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), *(pa.array(np.full(m, v, np.int64)) for v in (doc, n)), pa.array(np.arange(m))], ["gram", "doc", "n", "at"])

    return scratch.save(sets.select("doc_id", "grams").where("length(grams) > 0").mapInArrow(run, "gram long, doc long, n long, at long"))


def met(rows: DataFrame, member: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(u, v) of different parts that can have ``similarity``, by the shingles of ``rows`` that both have.

    The first turn has all pairs of the holders of shingles that at most ``CROWD`` documents
    hold. Of crowds each turn draws DRAWS shingles of each document and for each of them one
    holder, by hashes that differ from turn to turn. So there are never more than CROWD / 2
    pairs for a row, however many documents share a shingle; what no turn draws is left to ``crowded``.
    """
    now = rows.join(member.select(F.col("doc_id").alias("doc"), "part"), "doc")
    drawn = now.groupBy("gram").agg(F.min(F.struct(F.xxhash64("gram", "doc", F.lit(turn)).alias("h"), "doc", "part", "n", "at")).alias("r"), F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("k")).where("low < high")
    crowd = drawn.where(F.col("k") > CROWD)
    hubs = crowd.where(F.col("k") > HUB * rows.count()).select("gram", F.col("r").alias("c"))  # fewer than 1 / HUB
    drawing = now.join(crowd.select("gram"), "gram", "left_semi").withColumn("d", F.row_number().over(Window.partitionBy("doc").orderBy(F.xxhash64("gram", "doc", F.lit(-1 - turn)), "gram")))  # of one document
    marked = drawing.where(F.col("d") <= DRAWS).drop("d").join(F.broadcast(hubs), "gram", "left")
    both = marked.where("c is not null").withColumnRenamed("c", "r").unionByName(marked.where("c is null").drop("c").join(crowd.select("gram", "r"), "gram"))
    if not turn:
        few = now.join(drawn.where(F.col("k") <= CROWD).select("gram"), "gram", "left_semi")
        other = few.select("gram", F.struct(F.lit(0).cast("long").alias("h"), "doc", "part", "n", "at").alias("r"))
        both = both.unionByName(few.join(other, "gram").where("doc < r.doc"))
    need = f"least(n - at, r.n - r.at) >= (n + r.n) * {similarity / (1 + similarity)!r} - 1e-6"
    return both.where("part <> r.part").where(need).select(F.least("doc", "r.doc").alias("u"), F.greatest("doc", "r.doc").alias("v")).distinct()


def sketches(sets: DataFrame) -> DataFrame:
    """(doc, bits): the parities of a set's counts in buckets of its hashes, a power of two of them, some 4 for each shingle, 256 to 16,384."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for grams in b.column(1).to_pylist():
                x = np.frombuffer(grams, np.uint64)
                size = min(max(256, 1 << (4 * len(x) - 1).bit_length()), 1 << 14) if len(x) else 256
                odd = np.bincount((x % np.uint64(size)).astype(np.int64), minlength=size) & 1
                out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc", "bits"])

    return sets.select("doc_id", "grams").mapInArrow(run, "doc long, bits binary")


def near_in_crowd(doc: list, part: list, n: list, at: list, side: list, bits: list, across: bool, similarity: float) -> list[tuple[int, int]]:
    """Pairs of different parts (and sides, if ``across``) whose sketches allow ``similarity``.

    Two sets differ in at least as many members as their parities do; a sketch folds to half
    its size by exclusive or. Of similar sets the larger has at most twice the buckets.
    """
    size = np.array([len(x) for x in bits])
    order = np.lexsort((np.array(doc), np.array(n), size))
    doc, part, n, at, side, size = (np.array(x)[order] for x in (doc, part, n, at, side, size))
    bits = [bits[i] for i in order.tolist()]
    share, out = similarity / (1 + similarity), []
    for width in np.unique(size).tolist():
        low, mid = np.searchsorted(size, [width, width + 1]).tolist()
        high = int(np.searchsorted(size, 2 * width + 1)) if similarity > 0.5 else len(size)
        table = np.array([np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, width // 8), axis=0) for x in bits[low:high]])
        left = n - at
        for i in range(low, mid):
            js = np.arange(i + 1, high)
            js = js[(part[js] != part[i]) & (np.minimum(n[js], n[i]) >= similarity * np.maximum(n[js], n[i]) - 1e-6) & (np.minimum(left[js], left[i]) >= share * (n[js] + n[i]) - 1e-6)]
            if across:
                js = js[side[js] != side[i]]
            if len(js):
                differ = np.bitwise_count(table[js - low] ^ table[i - low]).sum(axis=1, dtype=np.int64)
                js = js[(n[js] + n[i] - differ) / 2 >= share * (n[js] + n[i]) - 1e-6]
                out += ((min(int(doc[i]), j), max(int(doc[i]), j)) for j in doc[js].tolist())
    return out


def crowded(rows: DataFrame, member: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of different parts that can have ``similarity``, by the shingles of ``rows`` that more than ``CROWD`` documents hold.

    All pairs of a crowd are compared inside tasks, by sketches of bounded size; a crowd of more than
    BLOCK documents is dealt over the pairs of its blocks. Only pairs whose sketches allow
    the similarity leave a task.
    """
    now = rows.join(member.select(F.col("doc_id").alias("doc"), "part"), "doc")
    many = now.groupBy("gram").agg(F.count("*").alias("k"), F.min("part").alias("low"), F.max("part").alias("high")).where(f"k > {CROWD} and low < high").select("gram", F.ceil(F.col("k") / BLOCK).alias("blocks"))
    held = now.join(many, "gram").withColumn("side", F.pmod(F.xxhash64("doc"), "blocks"))
    cells = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")}).join(sketches(sets.join(rows.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")), "doc")
    together = cells.repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            if found := near_in_crowd(*zip(*held, strict=True), key[1] != key[2], similarity):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])

        for batch in batches:
            for gram, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (gram, x, y) != key:
                    if held:
                        yield from pairs()
                    key, held = (gram, x, y), []
                held.append(row)
        if held:
            yield from pairs()

    return together.select("gram", "x", "y", "doc", "part", "n", "at", "side", "bits").mapInArrow(run, "u long, v long").distinct()


def similar_links(docs: DataFrame, edges: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(u, v) that connect what links of ``similarity`` connect, for documents that ``edges`` (u, v) connect on whatever way.

    Edges that hold form parts. The edges are a forest, so where one fails, pairs that it
    stands for may hold still: documents of parts with a failed edge to another part meet
    those of other parts that share a rare shingle, turn after turn until a turn links fewer than one in
    WORTH of them. Then all pairs of crowds that are still of different parts are compared, so that none is left out.
    """
    edges = scratch.save(edges.select("u", "v").where("u <> v").distinct())
    n = 2 * edges.count()  # documents at most
    ends = edges.select("u").union(edges.select("v")).distinct().select(F.col("u").alias("doc_id"))
    sets = scratch.save(shingle_sets(docs.select("doc_id", "text").join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"]), width), n)
    hold = components(verified(edges, sets, similarity), scratch)
    member = scratch.save(sets.select("doc_id").join(hold.withColumnRenamed("u", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("part")), n)
    ends_of = edges.join(member.select(F.col("doc_id").alias("u"), F.col("part").alias("p")), "u").join(member.select(F.col("doc_id").alias("v"), F.col("part").alias("q")), "v")
    failed = ends_of.where("p <> q").select(F.explode(F.array("p", "q")).alias("part")).distinct()
    left = scratch.save(member.join(failed, "part", "left_semi").select("doc_id", "part"), n)
    rows = prefixes(left.join(sets, "doc_id"), similarity, scratch)
    shared = rows.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("gram")
    rows = scratch.save(rows.join(shared, "gram", "left_semi"))
    out, turn, n = hold.select("u", F.col("root").alias("v")), 0, left.count()
    while True:
        asked = scratch.save(met(rows, left, similarity, turn))
        new = scratch.save(verified(asked, sets, similarity))
        scratch.drop(asked)
        some = new.count()
        if some:
            out, turn = out.unionByName(new), turn + 1
            part = lambda c: left.select(F.col("doc_id").alias(c), F.col("part").alias(f"p{c}"))
            joined = components(new.join(part("u"), "u").join(part("v"), "v").select(F.col("pu").alias("u"), F.col("pv").alias("v")), scratch)
            left = scratch.save(left.join(joined.withColumnRenamed("u", "part"), "part", "left").select("doc_id", F.coalesce("root", "part").alias("part")), n)
        if some * WORTH <= n:
            return out.unionByName(scratch.save(verified(scratch.save(crowded(rows, left, sets, similarity)), sets, similarity)))


def near_duplicates(docs: DataFrame, *, width: int = 5, tau: int = 11, similarity: float | None = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``: the smallest doc_id that its links reach, itself included.

    Without ``similarity`` links are fingerprints at most ``tau`` bits apart. With it, links
    are those of two fingerprints of different seeds whose shingle sets have that Jaccard
    similarity, whether or not a spanning forest has them: equal texts are one node, and
    where edges of the forests fail, what they connect meets by rare shingles. Shingles as
    similar as 0.8 have fingerprints some 10 bits apart, 0.9 some 7, hence the default of
    11; a pair is missed if it is further apart in both.

    Defined results: a null or empty text has no words and the fingerprint zero, which links
    like any other; fewer words than ``width`` are one shingle; equal fingerprints are one
    node, however many rows have them; a row whose doc_id is null links nothing and gets the
    component of its fingerprint without ``similarity``, else none; an empty table gives no
    rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    seeds = (SEED,) if similarity is None else (SEED, SECOND_SEED)
    prints = scratch.save(fingerprints(docs, width, seeds, similarity is not None))
    if similarity is None:
        nodes = scratch.save(prints.where("doc_id is not null").groupBy(F.col("fp0").alias("fp")).agg(F.min("doc_id").alias("id")))
        roots = components(links(nodes, tau, scratch).select("u", "v"), scratch).select(F.col("u").alias("id"), "root")
        member = nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
        return prints.withColumnRenamed("fp0", "fp").join(member, "fp", "left").select("doc_id", "fp", "component_id")
    n = prints.count()
    texts = scratch.save(prints.where("doc_id is not null").groupBy("key", "fp0", "fp1").agg(F.min("doc_id").alias("id")), n)
    edges = None
    for i in range(len(seeds)):
        nodes = scratch.save(texts.groupBy(F.col(f"fp{i}").alias("fp")).agg(F.min("id").alias("id")), n)
        same = texts.select(F.col("id").alias("u"), F.col(f"fp{i}").alias("fp")).join(nodes.withColumnRenamed("id", "v"), "fp").select("u", "v")
        found = links(nodes, tau, scratch).select("u", "v").unionByName(same)
        edges = found if edges is None else edges.unionByName(found)
    equal = prints.where("doc_id is not null").join(texts.select("key", "id"), "key").where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    near = similar_links(docs, edges, width, similarity, scratch)
    roots = components(near.unionByName(equal), scratch).select(F.col("u").alias("_id"), "root")
    return prints.join(roots, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.col("fp0").alias("fp"), F.coalesce("root", "doc_id").alias("component_id"))
