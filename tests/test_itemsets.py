import itertools
import random

from lodestone.operators import itemsets
from lodestone.sources import sinks


def brute(baskets, support):
    out = {}
    items = sorted({i for b in baskets.values() for i in b})
    for size in range(1, len(items) + 1):
        for s in itertools.combinations(items, size):
            n = sum(set(s) <= b for b in baskets.values())
            if n >= support:
                out[s] = n
    return out


def rows_of(spark, baskets):
    return spark.createDataFrame([(k, i) for k, b in baskets.items() for i in b], "basket long, item long")


def as_dict(df):
    return {tuple(r["items"]): r.n for r in df.collect()}


def test_full_sized_set_is_found(spark, scratch):
    rows = rows_of(spark, {0: {1, 2, 5}, 1: {1, 2, 3, 5}, 2: {1, 2}})
    expected = {(1,): 3, (2,): 3, (5,): 2, (1, 2): 3, (1, 5): 2, (2, 5): 2, (1, 2, 5): 2}
    assert as_dict(itemsets.apriori(rows, 2, scratch)) == expected
    assert as_dict(itemsets.son(rows, 2, 2, scratch)) == expected
    assert as_dict(itemsets.fpgrowth(rows, 2)) == expected


def test_random_against_brute_force(spark, scratch):
    rng = random.Random(3)
    baskets = {k: set(rng.sample(range(7), rng.randint(1, 5))) for k in range(30)}
    expected = brute(baskets, 6)
    rows = rows_of(spark, baskets)
    assert as_dict(itemsets.apriori(rows, 6, scratch)) == expected
    assert as_dict(itemsets.son(rows, 6, 3, scratch)) == expected
    assert as_dict(itemsets.fpgrowth(rows, 6)) == expected


def test_empty_and_null(spark, scratch):
    empty = rows_of(spark, {}) if False else spark.createDataFrame([], "basket long, item long")
    assert as_dict(itemsets.apriori(empty, 1, scratch)) == {}
    assert as_dict(itemsets.son(empty, 1, 2, scratch)) == {}
    assert as_dict(itemsets.fpgrowth(empty, 1)) == {}
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (1, None)], "u long, b string")
    assert [tuple(r) for r in itemsets.baskets(pairs, "u", "b").collect()] == [(1, "a")]


def test_larger_than_is_strict(spark):
    rows = rows_of(spark, {0: {1, 2}, 1: {1, 2, 3}})
    assert {r.basket for r in itemsets.larger_than(rows, 2).collect()} == {1}


def test_report():
    text = sinks.itemset_report([("a",), ("b",), ("a", "b")], [("b",), ("a",)])
    assert text == "Candidates:\n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets:\n('a'),('b')\n"
