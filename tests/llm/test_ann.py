import numpy as np
import pytest

from lodestone.llm import ann


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "c") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    out = {}
    for r in sorted(ann.nearest(df, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def brute(rows, every, k):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    out = {}
    for i, x in rows:
        if i % every == 0:
            s = np.array([float(np.dot(x, y)) for y in v])
            order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
            out[i] = [(int(j), -a) for a, j in order]
    return out


def test_recall(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 32))
    rows = [(i, x / np.linalg.norm(x)) for i, x in enumerate(v)]
    got, want = run(spark, rows), brute(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(hits) / 20 >= 0.9
    exact = {i: np.array(x) for i, x in rows}
    assert all(abs(s - float(exact[q] @ exact[i])) < 1e-12 for q in got for i, s in got[q])


def test_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 200)
    monkeypatch.setattr(ann, "BLOCK", 10)
    rng = np.random.default_rng(1)
    rows = [(i, x) for i, x in enumerate(rng.normal(size=(700, 12)))]
    got, want = run(spark, rows, k=5), brute(rows, 20, 5)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]) / 5 >= 0.9


def test_copies_tie_to_smaller_ids_and_crowds_do_not_hide_others(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, x) for i, x in enumerate(base)]
    rows += [(1000 + i, base[7]) for i in range(100)]
    crowd = base[3] + 0.01 * rng.normal(size=(300, 16))
    rows += [(2000 + i, x) for i, x in enumerate(crowd)]
    got, want = run(spark, rows), brute(rows, 20, 20)
    assert [i for i, _ in got[1020]] == [7, *range(1000, 1019)]
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]) / 20 >= 0.95


def test_odd_rows(spark):
    rows = [(0, [1, 0]), (20, [0, 1]), (1, [2, 0]), (2, None), (40, [0, 0]), (60, [float("nan"), 1]), (80, [None, 1]), (100, [float("inf"), 0]), (120, [1, 2, 3]), (3, [1, 0]), (3, [1, 0])]
    assert run(spark, rows) == {0: [(1, 2.0), (3, 1.0), (20, 0.0)], 20: [(0, 0.0), (1, 0.0), (3, 0.0)]}
    assert run(spark, []) == {} and run(spark, [(20, [1.0, 0.0])]) == {}


@pytest.mark.parametrize("n", [1, 2, 30])
def test_small_tables_are_exact(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, x) for i, x in enumerate(rng.normal(size=(n, 8)))]
    got, want = run(spark, rows), {q: x for q, x in brute(rows, 20, 20).items() if x}
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_vectors_of_each_length_are_searched_among_themselves(spark):
    rng = np.random.default_rng(9)
    short, long = ([(i, x) for i, x in enumerate(rng.normal(size=(60, d)), start)] for d, start in ((8, 0), (12, 100)))
    got = run(spark, short + long, k=5)
    for rows in (short, long):
        want = brute(rows, 20, 5)
        assert {q: [i for i, _ in got[q]] for q in want} == {q: [i for i, _ in x] for q, x in want.items()}
