import itertools
import random
from collections import deque
from pathlib import Path

import pandas as pd
import pytest

from lodestone.operators import graph
from lodestone.operators.components import components


def frame(spark, edges):
    return spark.createDataFrame([(min(e), max(e)) for e in edges], "src long, dst long")


TRIANGLES = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]


def distances(edges):
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    out = {}
    for s in links:
        seen, q = {s: 0}, deque([s])
        while q:
            v = q.popleft()
            for w in links[v]:
                if w not in seen:
                    seen[w] = seen[v] + 1
                    q.append(w)
        out[s] = seen
    return out


@pytest.mark.parametrize("small", [100, -1])
def test_betweenness(spark, scratch, small):
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(frame(spark, [(1, 2), (2, 3)]), scratch, small).collect()}
    assert got == {(1, 2): 2.0, (2, 3): 2.0}
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(22)}
    got = graph.edge_betweenness(frame(spark, edges), scratch, small).collect()
    assert len(got) == len(edges)
    d = distances(edges)
    assert sum(r.betweenness for r in got) == pytest.approx(sum(x for s in d for t, x in d[s].items() if s < t))


def test_modularity_and_girvan_newman(spark, scratch):
    edges = frame(spark, TRIANGLES)
    labels = spark.createDataFrame([(v, 1 if v < 4 else 4) for v in range(1, 7)], "id long, label long")
    assert graph.modularity(edges, labels).first()[0] == pytest.approx(5 / 14)
    for small in (100, -1):
        found, q = graph.girvan_newman(edges, scratch, 2, small)
        assert q == pytest.approx(5 / 14)
        assert {r.id: r.label for r in found.collect()} == {v: 1 if v < 4 else 4 for v in range(1, 7)}


def test_girvan_newman_without_singletons(spark, scratch):
    edges = frame(spark, [*TRIANGLES, (6, 7)])
    for small in (100, -1):
        found, q = graph.girvan_newman(edges, scratch, 8, small, keep_singletons=False)
        assert q > 0 and all(sum(r.label == s.label for s in found.collect()) > 1 for r in found.collect())
    whole, _ = graph.girvan_newman(edges, scratch, 0)
    assert {r.label for r in whole.collect()} == {1}


def test_components_of_a_long_path_and_copies(spark, scratch):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long"), scratch).collect())
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components(spark.createDataFrame([], "u long, v long"), scratch).count() == 0


def test_components_of_few_edges_take_no_rounds(spark, scratch, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1 << 62, -5), (-5, 7)]
    frame = spark.createDataFrame(edges, "u long, v long")
    before = scratch.n
    got = dict(components(frame, scratch).collect())
    assert scratch.n - before == 2  # the edges and the roots
    monkeypatch.setattr("lodestone.operators.components.FEW", -1)
    assert got == dict(components(frame, scratch).collect())
    assert scratch.n - before > 4 and got[1 << 62] == -5


def test_label_propagation_ties_go_to_the_smaller(spark, scratch):
    got = dict(graph.label_propagation(frame(spark, [(1, 2)]), scratch, 1).collect())
    assert got == {1: 2, 2: 1}
    got = {r.label: (r.size, list(r.members)) for r in graph.communities(graph.label_propagation(frame(spark, TRIANGLES[:3]), scratch, 5)).collect()}
    assert sum(n for n, _ in got.values()) == 3


def test_co_occurrence_against_brute_force(spark):
    rng = random.Random(4)
    groups = {u: set(rng.sample(range(20), rng.randint(2, 12))) for u in range(25)}
    rows = spark.createDataFrame([(u, g) for u, s in groups.items() for g in s] * 2 + [(None, 1), (1, None)], "u long, g long")
    got = {(r.src, r.dst): r.n for r in graph.co_occurrence(rows, "u", "g", 5).collect()}
    assert got == {(a, b): len(groups[a] & groups[b]) for a, b in itertools.combinations(sorted(groups), 2) if len(groups[a] & groups[b]) >= 5}


def test_co_occurrence_compares_copies_once(spark, scratch):
    rng = random.Random(6)
    kinds = [set(rng.sample(range(20), rng.randint(8, 12))) for _ in range(6)]
    groups = {u: kinds[u % 6] for u in range(120)}
    rows = spark.createDataFrame([(u, g) for u, s in groups.items() for g in s], "u long, g long")
    got = {(r.src, r.dst): r.n for r in graph.co_occurrence(rows, "u", "g", 5, scratch).collect()}
    assert got == {(a, b): len(groups[a] & groups[b]) for a, b in itertools.combinations(range(120), 2) if len(groups[a] & groups[b]) >= 5}
    assert max(spark.read.parquet(scratch.base + f"/{i + 1}").count() for i in range(scratch.n)) <= 120 < len(got)


def test_betweenness_of_twins(spark):
    """Classes of linked and of unlinked twins against all shortest paths."""
    rng = random.Random(8)
    for trial in range(6):
        n, kinds = 7, [rng.random() < 0.5 for _ in range(7)]
        copies = [(k, i) for k in range(n) for i in range(rng.randint(1, 4))]
        base = {(a, b) for a in range(n) for b in range(a) if rng.random() < 0.4}
        pairs = [(u, v) for u, v in itertools.combinations(range(len(copies)), 2) if (kinds[copies[u][0]] if copies[u][0] == copies[v][0] else tuple(sorted((copies[u][0], copies[v][0]), reverse=True)) in base)]
        near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(len(copies))}
        expected = dict.fromkeys(pairs, 0.0)
        for s, t in itertools.combinations(range(len(copies)), 2):
            front, seen = [[s]], {s}
            while front and not any(p[-1] == t for p in front):
                front = [[*p, w] for p in front for w in near[p[-1]] if w not in seen]
                seen |= {p[-1] for p in front}
            ways = [p for p in front if p[-1] == t]
            for p in ways:
                for e in itertools.pairwise(p):
                    expected[tuple(sorted(e))] += 1 / len(ways)
        if not pairs:
            continue
        ids, src, dst = graph._ranks(pd.DataFrame(pairs, columns=["src", "dst"]))
        label, linked = graph._twins(src, dst, len(ids))
        value = graph._class_betweenness(spark, src, dst, label, linked)
        assert dict(zip(zip(ids[src].tolist(), ids[dst].tolist()), value.tolist())) == pytest.approx(expected)


def test_joined_betweenness_of_twins_goes_by_classes(spark, scratch):
    rng = random.Random(11)
    kinds = [rng.random() < 0.5 for _ in range(6)]
    copies = [(k, i) for k in range(6) for i in range(rng.randint(5, 9))]
    base = {(1, 0), (2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (5, 0)}
    pairs = [(u, v) for u, v in itertools.combinations(range(len(copies)), 2) if (kinds[copies[u][0]] if copies[u][0] == copies[v][0] else tuple(sorted((copies[u][0], copies[v][0]), reverse=True)) in base)]
    pairs += [(100, 101), (100, 102), (101, 102), (200, 201)]
    expected = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(frame(spark, pairs), scratch).collect()}
    before = scratch.n
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(frame(spark, pairs), scratch, -1).collect()}
    assert got == pytest.approx(expected) and len(got) == len(pairs)
    kept = [p for i in range(before, scratch.n) if (p := Path(scratch.base.removeprefix("file:"), str(i + 1))).exists()]
    assert max(spark.read.parquet(str(p)).count() for p in kept) <= len(pairs)  # before: a row for each root and vertex


@pytest.mark.parametrize("groups", [30, 4000])  # counted by matrices; by lists of groups
def test_blocks_of_classes_meet_in_tasks(spark, scratch, groups):
    rng = random.Random(groups)
    kinds = [set(rng.sample(range(k := rng.randrange(groups - 20), k + 20), rng.randint(8, 12))) for _ in range(60)]
    sets = {u: kinds[u % 60] if u < 80 else set(rng.sample(sorted(kinds[u % 60]), 7)) | {groups + u} for u in range(140)}
    heads = {}
    for u in sorted(sets):
        heads.setdefault(frozenset(sets[u]), []).append(u)
    frame = spark.createDataFrame([(v[0], len(v), sorted(s)) for s, v in heads.items()], "c long, m long, groups array<long>")
    expected = sorted((a[0], b[0], len(s & t), len(a), len(b)) for (s, a), (t, b) in itertools.product(heads.items(), repeat=2) if a[0] < b[0] and len(s & t) >= 5)
    for rows, tile in ((1000, 1000), (17, 5)):
        found = graph._linked(frame, 5, scratch, rows, tile)
        assert sorted(map(tuple, found.collect())) == expected
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # no candidate is shuffled
    rows = spark.createDataFrame([(u, g) for u, s in sets.items() for g in s], "u long, g long")
    found, edges = graph.class_graph(rows, "u", "g", 5, scratch), graph.co_occurrence(rows, "u", "g", 5, scratch).collect()
    assert {(r.src, r.dst): r.n for r in edges} == {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 5}
    assert sorted(r.id for r in graph.class_vertices(found).collect()) == sorted({v for r in edges for v in (r.src, r.dst)})
    assert sorted(graph.class_components(found, scratch).collect()) == sorted(graph.connected_components(frame_of(spark, edges), scratch).collect())


def frame_of(spark, edges):
    return spark.createDataFrame([(r.src, r.dst) for r in edges], "src long, dst long")


def test_components_of_many_edges_are_forests_first(spark, scratch, monkeypatch):
    rng = random.Random(12)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(3000)], "u long, v long").repartition(3)
    monkeypatch.setattr("lodestone.operators.components.FEW", 200)
    before = scratch.n
    got = dict(components(edges, scratch).collect())
    assert got == dict.fromkeys(range(1, 40), 0) and scratch.n - before == 3  # the edges, the forests, the roots


@pytest.mark.parametrize("copies", [1, 4])
def test_labels_and_modularity_of_classes(spark, scratch, copies):
    """Classes give the labels and the modularity of the edges between their members, in every round."""
    rng = random.Random(copies)
    kinds = [set(rng.sample(range(20), rng.randint(6, 10))) for _ in range(12)]
    sets = {rng.randrange(10**6): kinds[rng.randrange(12)] if copies > 1 else set(rng.sample(range(20), 8)) for _ in range(12 * copies)}
    rows = spark.createDataFrame([(u, g) for u, s in sets.items() for g in s], "u long, g long")
    found = graph.class_graph(rows, "u", "g", 5, scratch)
    edges = scratch.save(graph.class_edges(found))
    for rounds in (0, 1, 2, 5):
        labels = graph.class_label_propagation(found, scratch, rounds)
        expected = graph.label_propagation(edges, scratch, rounds)
        assert sorted(labels.select("id", "label").collect()) == sorted(expected.collect())
        assert graph.class_modularity(found, labels).first()[0] == pytest.approx(graph.modularity(edges, expected).first()[0])


@pytest.mark.parametrize("copies", [1, 3])
def test_betweenness_and_cuts_of_classes(spark, scratch, copies):
    """Links between classes give the betweenness and the cuts of the edges between members."""
    rng = random.Random(20 + copies)
    kinds = [set(rng.sample(range(14), rng.randint(6, 8))) for _ in range(9)]
    sets = {rng.randrange(10**6): kinds[i % 9] for i in range(9 * copies)}
    rows = spark.createDataFrame([(u, g) for u, s in sets.items() for g in s], "u long, g long")
    found = graph.class_graph(rows, "u", "g", 5, scratch)
    edges = scratch.save(graph.class_edges(found))
    expected = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(edges, scratch).collect()}
    for small in (100, -1) if copies > 1 else (100,):
        got = graph.class_edge_betweenness(found, scratch, small).collect()
        assert {(r.src, r.dst): r.betweenness for r in got} == pytest.approx(expected) and len(got) == len(expected)
    for removals in (0, 1, 12):
        labels, q = graph.girvan_newman(edges, scratch, removals)
        own, own_q = graph.class_girvan_newman(found, scratch, removals)
        assert sorted(own.collect()) == sorted(labels.collect()) and own_q == pytest.approx(q)
