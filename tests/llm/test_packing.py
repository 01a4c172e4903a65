import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing


def test_differencing_is_near_equal_and_complete():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 400, 1000)
    window, sums = packing.differencing(sizes, 100)
    assert np.array_equal(np.bincount(window, sizes, 100).astype(int), sums)
    assert sums.max() - sums.min() < 60
    two, parts = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)  # the known result of the method: a difference of 2
    assert sorted(parts) == [14, 16] and len(two) == 5
    assert packing.differencing(np.zeros(0, int), 3)[1].tolist() == [0, 0, 0]
    assert packing.differencing(np.array([5]), 1)[0].tolist() == [0]


def test_windows_rise_when_capacity_is_exceeded():
    sizes = np.array([6, 6, 6])
    window = packing.deal(sizes, 10)  # 18 tokens would be two windows, but no two pieces fit
    assert len(set(window.tolist())) == 3


def plain_differencing(sizes, k):
    """The same method over tuples: partial partitions with all their windows, merged two by two."""
    parts = [([n] + [0] * (k - 1), r) for r, n in enumerate(sorted(sizes, reverse=True))]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[1]))
        (a, _), (b, _) = parts[:2]
        parts = [*parts[2:], (sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True), made)]
        made += 1
    return parts[0][0]


@pytest.mark.parametrize("seed", range(30))
def test_differencing_against_a_plain_form(seed):
    rng = np.random.default_rng(seed)
    sizes, k = rng.integers(1, 60, rng.integers(1, 14)), int(rng.integers(1, 6))
    assert sorted(packing.differencing(sizes, k)[1], reverse=True) == plain_differencing(sizes.tolist(), k)


@pytest.mark.parametrize("seed", range(20))
def test_dealing_against_all_partitions(seed):
    """No dealing is possible with fewer windows than the least; differencing needs at most one more."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 10, 7)
    window = packing.deal(sizes, 12)
    used = [int(sizes[window == w].sum()) for w in set(window.tolist())]
    assert max(used) <= 12 and sum(used) == sizes.sum()
    least = next(k for k in range(1, 8) if any(all(sum(s for s, w in zip(sizes.tolist(), at, strict=True) if w == j) <= 12 for j in range(k)) for at in itertools.product(range(k), repeat=7)))
    assert least <= len(used) <= least + 1


def test_dealing_in_turn_is_worse(monkeypatch):
    rng = np.random.default_rng(3)
    pieces = [packing._Piece(i, 0, np.ones(n, "<u4"), int(n)) for i, n in enumerate(rng.integers(1, 2047, 800))]
    total = sum(len(p.ids) for p in pieces)
    least = -(-total // 2048)
    windows = packing.fill(pieces, 2048, True)
    assert len(windows) <= least + 4
    assert sorted((p.doc_id, p.start + i) for w in windows for p in w for i in range(len(p.ids))) == [(p.doc_id, i) for p in pieces for i in range(len(p.ids))]

    def in_turn(sizes, k):
        at = np.arange(len(sizes)) % k
        return at, np.bincount(at, sizes, k)

    monkeypatch.setattr(packing, "differencing", in_turn)
    assert len(packing.fill(pieces, 2048, True)) > 1.1 * least


TEXTS = ["", None, "a", "Hello world. " * 900, "the <|endoftext|> is text", "Zürich ß 東京 \n\n\t x" * 50, "a", "b" * 30000]


@pytest.mark.parametrize(("rows", "cut", "windows"), [(TEXTS, True, 256), (TEXTS * 3, False, 2), (TEXTS * 3, True, 2), ([], True, 2)])
def test_round_trip(spark, rows, cut, windows):
    docs = spark.createDataFrame([(i if i != 2 else None, t, "en", 7) for i, t in enumerate(rows)], "doc_id long, text string, sequence_id string, length int")
    out = packing.pack_documents(docs, keep_ids=True, cut=cut, windows=windows).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        whole = got.setdefault(r.doc_id, [])
        assert r.start == len(whole) and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole += r.ids
    assert got == {(i if i != 2 else None): tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(rows)}
    assert all(r.doc_tokens == len(got[r.doc_id]) for r in out)
    sequences = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 for n in sequences.values())


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (1, "other")], "doc_id long, text string")
    assert packing.pack_documents(docs).count() == 3


def test_little_padding(spark, sf):
    out = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    used, sequences = out.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert used >= 0.985 * 2048 * sequences  # 200 documents: a few sequences
    whole = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), cut=False)
    used, sequences, pieces, cuts = whole.selectExpr("sum(length)", "count(distinct sequence_id)", "count(*)", "count_if(start % 2048 > 0)").first()
    assert used >= 0.9 * 2048 * sequences and cuts == 0
