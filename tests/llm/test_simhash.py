import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash
from lodestone.scratch import Scratch


def plain_fingerprint(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "one two", "A b C d", "x y z " * 500, "É é straße\xa0ſ K 東 京", "a\x0bb\x0cc\rd\x1fe"])
@pytest.mark.parametrize("width", [3, 5])
def test_fingerprint(text, width):
    assert simhash.fingerprint(text, width) == [plain_fingerprint(text, width)]
    assert simhash.fingerprint(text, width, (42, 7)) == simhash.fingerprint(text, width, (42, 7), block=2)


def reachable(ids, fps, tau):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in zip(ids, fps, strict=True):
        for j, y in zip(ids, fps, strict=True):
            if (x ^ y).bit_count() <= tau:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def assert_connected(spark, tau):
    rng = random.Random(tau)
    fps = [rng.getrandbits(64) for _ in range(120)] + [0, 1, (1 << 64) - 1, 1 << 63]
    for base in fps[:6]:  # crowds around a few, some in long chains
        at = base
        for _ in range(40):
            at = (at if rng.random() < 0.5 else base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, tau)))
            fps.append(at)
    fps = sorted(set(fps))
    rng.shuffle(fps)
    nodes = spark.createDataFrame([(simhash.signed(x), i) for i, x in enumerate(fps)], "fp long, id long")
    edges = [tuple(r)[:2] for r in simhash.links(nodes, tau, Scratch(spark, "t")).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= tau for a, b in edges)
    expected = reachable(range(len(fps)), fps, tau)
    root = {i: i for i in range(len(fps))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {i: find(i) for i in root} == expected


@pytest.mark.parametrize(("tau", "cell"), [(2, None), (2, 8), (5, 16), (11, 64), (11, None)])
def test_links_connect_all_that_is_near(spark, monkeypatch, tau, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    assert_connected(spark, tau)


def test_thresholds_are_enough():
    for widths in ([22, 21, 21], [16] * 4, [8] * 8):
        for tau in (2, 5, 11):
            chosen = simhash.allocate(widths, [1000.0] * len(widths), 10000, tau)
            assert not chosen or sum(t + 1 for t in chosen) >= tau + 1
    assert simhash.allocate([32, 32], [1e12, 10.0], 1000, 2) == [-1, 2]  # unequal: only the partition with few candidates


@pytest.mark.parametrize("seed", range(20))
def test_thresholds_against_all_choices(seed):
    rng = random.Random(seed)
    k, tau, n = rng.randint(2, 4), rng.randint(1, 9), 10 ** rng.randint(2, 6)
    widths, pairs = [rng.randint(4, 30) for _ in range(k)], [10.0 ** rng.randint(0, 14) for _ in range(k)]
    price = lambda c: sum(simhash.cost(w, p, t, n) for w, p, t in zip(widths, pairs, c, strict=True) if t >= 0)
    every = [c for c in itertools.product(range(-1, simhash.MOST + 1), repeat=k) if sum(t + 1 for t in c) >= tau + 1]
    chosen = simhash.allocate(widths, pairs, n, tau)
    assert bool(chosen) == bool(every) and (not every or price(chosen) <= min(map(price, every)) * (1 + 1e-9))


@pytest.mark.parametrize(("tau", "chosen"), [(2, [0, 1]), (2, [-1, 2]), (5, [1, 3]), (6, [1, 0, 3]), (3, [3, -1])])
def test_any_thresholds_connect_all_that_is_near(spark, monkeypatch, tau, chosen):
    groups = [g.tolist() for g in np.array_split(np.arange(64), len(chosen))]
    monkeypatch.setattr(simhash, "plan", lambda *_: [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    assert_connected(spark, tau)


def test_bits_that_go_together_share_a_partition():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 10] = bits[:, 40]
    both = bits.T @ bits
    groups = simhash.group_bits(500, both, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({10, 40} <= set(g) for g in groups)


TEXT = " ".join(f"word{i}" for i in range(200))


def test_near_duplicates(spark):
    edited = TEXT.replace("word100 ", "changed ")
    rows = [(5, TEXT, 1), (3, TEXT.upper(), 1), (9, edited, 1), (4, " ".join(f"other{i}" for i in range(200)), 1), (7, None, 1), (8, "", 1), (6, " \n", 1), (None, TEXT, 1), (5, TEXT, 1), (11, "a b", 1), (10, "A  b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs)
    assert got.count() == len(rows)
    found = {r.doc_id: r.component_id for r in got.collect()}
    assert found == {5: 3, 3: 3, 9: 3, 4: 4, 7: 6, 8: 6, 6: 6, None: None, 11: 10, 10: 10}
    exact = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, width=3, tau=2, similarity=None).collect()}
    assert exact[5] == exact[None] == 3 and exact[6] == exact[7] == exact[8] == 6


def test_copies_among_pages_of_one_template_are_found(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    template = [word() for _ in range(240)]
    texts = []
    for _ in range(150):
        page = template + [word() for _ in range(64)]
        copy = list(page)
        for at in range(20, 300, 70):  # of 300 shingles 20 change: a similarity of 0.875
            copy[at] = word()
        texts += [page, copy]
    order = list(range(len(texts)))
    rng.shuffle(order)
    shingles = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in zip(order, texts, strict=True)}
    fps = {i: simhash.fingerprint(" ".join(t), 5, (simhash.SEED, simhash.SECOND_SEED)) for i, t in zip(order, texts, strict=True)}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in zip(order, texts, strict=True)], "doc_id long, text string")).collect()}
    true = [(a, b) for a in shingles for b in shingles if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    near = [(a, b) for a, b in true if any((x ^ y).bit_count() <= 11 for x, y in zip(fps[a], fps[b], strict=True))]
    assert len(near) > 140 and all(got[a] == got[b] for a, b in near)
    assert all((min(a, b), max(a, b)) in set(true) for a, b in got.items() if a != b)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.near_duplicates(docs, similarity=None).count() == 0


def test_links_in_crowds_that_no_turn_draws(spark, scratch, monkeypatch):
    """Every shingle has a crowd of holders; pairs of texts that share nearly all lines stand behind failed edges."""
    monkeypatch.setattr(simhash, "CROWD", 4)
    monkeypatch.setattr(simhash, "BLOCK", 16, raising=False)
    rng = random.Random(5)
    pool = [[f"w{i}x{j}" for j in range(30)] for i in range(16)]
    texts = []
    for _ in range(60):
        lines = sorted(rng.sample(range(16), 8))
        texts += [lines, lines[:-1] + [rng.randrange(16)]]
    rows = [(i, " ".join(w for at in lines for w in pool[at])) for i, lines in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = rng.sample(range(len(rows)), len(rows))
    edges = spark.createDataFrame([(max(p), min(p)) for p in zip(order, order[1:], strict=False)], "u long, v long")
    grams = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    expected = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                low, high = sorted((expected[a], expected[b]))
                expected = [low if e == high else e for e in expected]
    found = simhash.similar_links(docs, edges, 5, 0.8, scratch)
    roots = dict(simhash.components(found, scratch).collect())
    assert len(set(expected)) < len(rows)
    assert [roots.get(i, i) for i in range(len(rows))] == expected


def test_turns_end_when_they_link_little(spark, scratch, monkeypatch):
    """Every shingle of 300 texts has a crowd, 30 pairs are similar; a turn finds a few of them."""
    monkeypatch.setattr(simhash, "DRAWS", 4)
    monkeypatch.setattr(simhash, "CROWD", 4)
    monkeypatch.setattr(simhash, "WORTH", 10, raising=False)
    turns, met = [], simhash.met
    monkeypatch.setattr(simhash, "met", lambda *a: turns.append(a[-1]) or met(*a))
    rng = random.Random(2)
    pool = [[f"w{i}x{j}" for j in range(12)] for i in range(12)]
    picked = rng.sample(list(itertools.combinations(range(12), 5)), 300)
    texts = [" ".join(w for i in lines for w in pool[i]) for lines in picked]
    for i in range(30):
        texts[2 * i + 1] = texts[2 * i] + f" end{i}"  # 1 of 57 shingles more
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = rng.sample(range(300), 300)
    edges = spark.createDataFrame([(max(p), min(p)) for p in zip(order, order[1:], strict=False)], "u long, v long")
    grams = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for t in texts for w in [t.split()]]
    expected = list(range(300))
    for a, b in itertools.combinations(range(300), 2):
        if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
            low, high = sorted((expected[a], expected[b]))
            expected = [low if e == high else e for e in expected]
    roots = dict(simhash.components(simhash.similar_links(docs, edges, 5, 0.8, scratch), scratch).collect())
    assert [roots.get(i, i) for i in range(300)] == expected and len(set(expected)) <= 270
    assert len(turns) <= 2


@pytest.mark.parametrize("share", [0.1, 0.6, 1.0])
def test_forest_is_the_least_of_all(share):
    rng = np.random.default_rng(3)
    for groups, noise, tau in ((1, 3, 5), (40, 4, 11), (300, 1, 2)):
        fps = rng.integers(0, 1 << 63, groups).astype(np.uint64)[rng.integers(0, groups, 300)]
        for _ in range(noise):
            fps ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
        own = rng.random(300) < share
        root, want = list(range(300)), set()
        for d, i, j in sorted((int(fps[i] ^ fps[j]).bit_count(), i, j) for i, j in itertools.combinations(range(300), 2) if own[i] or own[j]):
            if d <= tau and root[i] != root[j]:
                want.add((i, j, d))
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
        assert set(simhash.forest(fps, own, tau)) == want


def test_crowds_are_counted_in_one_go(spark, scratch):
    sets = scratch.save(simhash.shingle_sets(spark.createDataFrame([(i, f"a b c d e {i}") for i in range(40)], "doc_id long, text string"), 5))
    context, key = spark.sparkContext, "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    context.setJobGroup("crowds", "crowds")
    try:
        assert simhash.crowds(sets).sum() == 80
        assert len(context.statusTracker().getJobIdsForGroup("crowds")) <= 2  # not one for each partition
    finally:
        spark.conf.unset(key)
        context.setJobGroup("rest", "rest")
