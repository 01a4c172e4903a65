import math
import random

import pytest

from lodestone.operators import recommend

TRAIN = [(1, 10, 5.0), (1, 11, 3.0), (2, 10, 4.0), (2, 11, 2.0), (2, 12, 5.0), (3, 10, 1.0), (3, 12, 2.0), (3, 11, 4.0)]


@pytest.fixture
def train(spark):
    return spark.createDataFrame(TRAIN, "user long, item long, rating double")


def test_of(spark, *rows):
    return spark.createDataFrame(list(rows), "user long, item long, rating double")


test_of.__test__ = False


def test_unseen_is_zero(spark, train):
    test = test_of(spark, (1, 99, 3.0), (9, 10, 3.0))
    for method in ("user", "item"):
        assert {r.prediction for r in recommend.recommend(train, test, method).collect()} == {0.0}
    assert recommend.als(train, test).count() == 0


def test_item_based_by_hand(spark, train):
    by = {}
    for u, i, r in TRAIN:
        by.setdefault(i, {})[u] = r

    def cos(a, b):
        both = by[a].keys() & by[b].keys()
        return sum(by[a][u] * by[b][u] for u in both) / math.sqrt(sum(by[a][u] ** 2 for u in both) * sum(by[b][u] ** 2 for u in both))

    expected = (5 * cos(12, 10) + 3 * cos(12, 11)) / (cos(12, 10) + cos(12, 11))
    assert recommend.item_based(train, test_of(spark, (1, 12, 0.0))).first().prediction == pytest.approx(expected)


def test_user_based_by_hand(spark, train):
    mean = {1: 4.0, 2: 11 / 3, 3: 7 / 3}
    r = {(u, i): x for u, i, x in TRAIN}

    def sim(v):
        d = [(r[1, i] - mean[1], r[v, i] - mean[v]) for i in (10, 11)]
        return sum(a * b for a, b in d) / math.sqrt(sum(a * a for a, _ in d) * sum(b * b for _, b in d))

    sims = {v: sim(v) for v in (2, 3)}
    expected = 4.0 + sum((r[v, 12] - mean[v]) * s for v, s in sims.items()) / sum(map(abs, sims.values()))
    assert recommend.user_based(train, test_of(spark, (1, 12, 0.0))).first().prediction == pytest.approx(expected)


def test_lsh_narrows_only_items_that_have_similar_ones(spark, train):
    test = test_of(spark, (1, 12, 0.0))
    none = spark.createDataFrame([], "a long, b long")
    similar = spark.createDataFrame([(10, 12)], "a long, b long")
    assert recommend.item_based(train, test, none).first() == recommend.item_based(train, test).first()
    assert recommend.item_based(train, test, similar).first().prediction == pytest.approx(5.0)


def test_rmse(spark):
    a, b = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 2, 0.0)], "user long, item long, prediction double"), test_of(spark, (1, 1, 1.0), (1, 2, 4.0))
    out = recommend.rmse(a, b).first()
    assert out.rmse == pytest.approx(math.sqrt(0.5)) and out.n == 2


def test_dispatch(train):
    with pytest.raises(ValueError):
        recommend.recommend(train, train, "other")


@pytest.mark.parametrize("bound", [None, 1, 2, 4000])
def test_first_co_raters_count(spark, train, bound):
    pairs = spark.createDataFrame([(10, 11), (11, 12), (10, 12)], "a long, b long")
    got = {(r.a, r.b): r.sim for r in recommend.item_cosines(train, pairs, bound).collect()}
    rated = {(u, i): r for u, i, r in TRAIN}
    for a, b in got:
        users = sorted(u for u in (1, 2, 3) if (u, a) in rated and (u, b) in rated)[:bound]
        x, y = [rated[u, a] for u in users], [rated[u, b] for u in users]
        assert got[a, b] == pytest.approx(sum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)))
    assert len(got) == 3


@pytest.mark.parametrize("first", [None, 2])
def test_blocks_compare_all_pairs_without_moving_common_rows(spark, monkeypatch, first):
    monkeypatch.setattr(recommend, "BLOCK", 40)
    rng = random.Random(7)
    rates = {(u, i): float(rng.randint(1, 5)) for u in range(20) for i in range(12) if rng.random() < 0.6}
    train = spark.createDataFrame([(u, i, r) for (u, i), r in rates.items()], "user long, item long, rating double")
    asked = [(a, b) for a in range(13) for b in range(13) if a != b and rng.random() < 0.5]
    expected = {}
    for a, b in asked:
        both = [(rates[u, a], rates[u, b]) for u in range(20) if (u, a) in rates and (u, b) in rates][:first]
        if both:
            expected[a, b] = sum(x * y for x, y in both) / math.sqrt(sum(x * x for x, _ in both) * sum(y * y for _, y in both))
    got = {(r.a, r.b): r.sim for r in recommend.item_cosines(train, spark.createDataFrame(asked, "a long, b long"), first).collect()}
    assert got == pytest.approx(expected)


def test_all_co_raters_count_by_default(spark):
    """4,000 users rate both items 5 and 5, 100 more 1 and 5."""
    rows = spark.range(4100).selectExpr("id as user", "explode(array(10L, 11L)) as item").selectExpr("user", "item", "double(if(user >= 4000 and item = 10, 1, 5)) as rating")
    sim = recommend.item_cosines(rows, spark.createDataFrame([(10, 11)], "a long, b long")).first().sim
    assert sim == pytest.approx((4000 * 25 + 100 * 5) / math.sqrt((4000 * 25 + 100) * (4100 * 25)))


def test_all_common_items_and_all_raters_count(spark):
    rng = random.Random(9)
    rates = {(u, i): float(rng.randint(1, 5)) for u in range(30) for i in range(25) if (u, i) != (0, 0)}
    train = spark.createDataFrame([(u, i, r) for (u, i), r in rates.items()], "user long, item long, rating double")
    own = {u: [i for i in range(25) if (u, i) in rates] for u in range(30)}
    mean = {u: sum(rates[u, i] for i in s) / len(s) for u, s in own.items()}
    num = den = 0.0
    for v in range(1, 30):
        d = [(rates[0, i] - mean[0], rates[v, i] - mean[v]) for i in range(1, 25)]
        sim = sum(x * y for x, y in d) / math.sqrt(sum(x * x for x, _ in d) * sum(y * y for _, y in d))
        num, den = num + sim * (rates[v, 0] - mean[v]), den + abs(sim)
    assert recommend.user_based(train, test_of(spark, (0, 0, 0.0))).first().prediction == pytest.approx(mean[0] + num / den)
