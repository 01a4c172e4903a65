"""Packing of documents into training sequences by Karmarkar-Karp multiway differencing.

Every document becomes its token ids followed by an end id. Cuts at multiples of the
capacity give full sequences at once. What is left of documents gathers in groups of about
``windows`` sequences inside a task and is cut before it is dealt: what is longer than half
the capacity in equal parts, and one part in every two sequences' worth of tokens into
halves, quarters and so on down to ``FINEST`` tokens. A group is dealt by largest
differencing: the two partial partitions of largest imbalance merge, largest window against
smallest, until one is left. The fine parts let windows come out equal to a few tokens, so
the least possible number of windows nearly holds them; where one window exceeds the
capacity the window count rises by one and the group is dealt again. Without ``cut``
documents' ends stay whole and are dealt in the same way.

There is no shuffle: a group never leaves its task, and a task holds the ids of one group
only. Sequence ids are (partition id, counter in the partition), so a task that runs again
after an executor is lost makes the same rows.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CAPACITY = 2048
#: Sequences that one group fills, about.
WINDOWS = 512
#: Tokens of the finest parts that even windows out, at least.
FINEST = 4
END_ID = 1


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal ``sizes`` into ``k`` windows by largest differencing.

    Returns the window of each size and the windows' sums. Ties go by the order of
    creation, so the result is a function of the input.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(k, np.int64)
    left, right = np.full(2 * n * 8, -1, np.int64), np.full(2 * n * 8, -1, np.int64)
    made = n
    order = np.argsort(-sizes, kind="stable")
    heap = [(-int(sizes[i]) if k > 1 else 0, r, (sizes[i : i + 1].astype(np.int64), np.array([i]))) for r, i in enumerate(order)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, (a, ia) = heapq.heappop(heap)
        _, _, (b, ib) = heapq.heappop(heap)
        p, q = len(a), len(b)
        over = p + q - k
        if over <= 0:
            sums, ids = np.concatenate([a, b]), np.concatenate([ia, ib])
        else:  # the over smallest windows of a meet the over smallest of b, crosswise
            x, y = a[p - over :], b[q - over :][::-1]
            if made + over > len(left):
                left, right = (np.concatenate([v, np.full(len(v) + over, -1, np.int64)]) for v in (left, right))
            new = np.arange(made, made + over)
            left[new], right[new] = ia[p - over :], ib[q - over :][::-1]
            made += over
            sums, ids = np.concatenate([a[: p - over], x + y, b[: q - over]]), np.concatenate([ia[: p - over], new, ib[: q - over]])
        o = np.argsort(-sums, kind="stable")
        sums, ids = sums[o], ids[o]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), tick, (sums, ids)))
        tick += 1
    _, _, (sums, ids) = heap[0]
    window = np.full(made, -1, np.int64)
    window[ids] = np.arange(len(ids))
    for node in range(made - 1, n - 1, -1):  # children are older than their parent
        window[left[node]] = window[right[node]] = window[node]
    return window[:n], np.concatenate([sums, np.zeros(k - len(sums), np.int64)])


def deal(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows for ``sizes``, none over ``capacity``; the count starts at the least possible and rises."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        window, sums = differencing(sizes, k)
        if sums.max(initial=0) <= capacity:
            return window
        k += 1


def _encoder(ranks_path: str, json_path: str):
    """Text to ids: exactly the ids of the tokenizer file ``json_path`` without special tokens added.

    The ranks file holds the same vocabulary and is several times faster; a text that
    spells the one special token goes through the tokenizer file itself.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = []

    def encode(text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(json_path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(fast.encode_ordinary(text), "<u4")

    return encode


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


class _Piece:
    """A run of a document's ids: ids[start : start + length] of its ``total``."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, total: int):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def split(self, at: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc_id, self.start, self.ids[:at], self.total), _Piece(self.doc_id, self.start + at, self.ids[at:], self.total)


def parts(pieces: list[_Piece], capacity: int) -> list[_Piece]:
    """The pieces, cut so that windows can come out equal."""
    out: list[_Piece] = []
    seen = 0
    for p in pieces:
        seen += len(p.ids)
        n = -(-2 * len(p.ids) // capacity)
        for i in range(n, 1, -1):
            head, p = p.split(-(-len(p.ids) // i))
            out.append(head)
        if seen >= 2 * capacity and len(p.ids) >= 2 * FINEST:
            seen = 0
            while len(p.ids) >= 2 * FINEST:
                head, p = p.split(-(-len(p.ids) // 2))
                out.append(head)
        out.append(p)
    return out


def fill(pieces: list[_Piece], capacity: int, cut: bool) -> list[list[_Piece]]:
    """Windows for all of the pieces, none over the capacity."""
    if cut:
        pieces = parts(pieces, capacity)
    places = deal(np.array([len(p.ids) for p in pieces], np.int64), capacity)
    windows: list[list[_Piece]] = [[] for _ in range(int(places.max()) + 1)]
    for p, w in zip(pieces, places.tolist(), strict=True):
        windows[w].append(p)
    return [w for w in windows if w]


def pack_documents(docs: DataFrame, paths: tuple[str, str] | None = None, *, capacity: int = CAPACITY, windows: int = WINDOWS, cut: bool = True, keep_ids: bool = False) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``keep_ids`` also ``ids``, the piece's token ids. Defined results: a null text is
    empty and gives the end id alone; a null doc_id is kept as null; rows that share a
    doc_id are packed each on its own; an empty table gives no rows; other columns of
    ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    ranks_path, json_path = paths or tokenizer_paths()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 7
    if keep_ids:
        names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int32())]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_path, json_path)
        first = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        pending: list[_Piece] = []
        held, count = 0, 0

        def put(window: list[_Piece]) -> None:
            nonlocal count
            offset = 0
            for p in window:
                rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, first + count, offset, *([p.ids.tolist()] if keep_ids else [])))
                offset += len(p.ids)
            count += 1

        def taken() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    put([_Piece(doc_id, start, ids[start : start + capacity], len(ids))])
                if whole < len(ids):
                    pending.append(_Piece(doc_id, whole, ids[whole:].copy(), len(ids)))  # not the whole text stays
                    held += len(ids) - whole
                if held >= windows * capacity:
                    for w in fill(pending, capacity, cut):
                        put(w)
                    pending, held = [], 0
                if len(rows) >= (256 if keep_ids else 4096):
                    yield taken()
        if pending:
            for w in fill(pending, capacity, cut):
                put(w)
        yield taken()

    spark_types = {"ids": "array<int>"}
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"`{c}` {spark_types.get(c, 'long')}" for c in names))
