import random

import pytest

from lodestone.llm import line_dedup

LOW = {i: i + 32 for i in range(65, 91)}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute(rows):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(key(x)) < 10 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, words string, _n int, n_dropped int")
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "_kept", "_n_lines", "_n_dropped"]
    return sorted(((r.doc_id, r._n_lines, r._n_dropped, r._kept) for r in out.collect()), key=str)


CASES = {
    "empty table": [],
    "nulls and empty": [(1, None), (2, ""), (3, "\n\n"), (None, "a line that repeats"), (4, "a line that repeats"), (5, "A line that repeats  ")],
    "repeated rows": [(1, "same text of one line\nother line here"), (1, "same text of one line\nother line here"), (2, "same text of one line"), (1, "same text of one line\nthird")],
    "repeats inside the first": [(3, "repeated line\nrepeated line"), (7, "REPEATED LINE\nx\nrepeated line\n")],
    "lengths": [(1, "123456789\n1234567890"), (2, "123456789\n1234567890"), (3, "éééééééééé\nÉéééééééééé")],
    "strips": [(1, "\x0b\x0cabcdefghij\r"), (2, "\tabcdefghij "), (3, "\xa0abcdefghij"), (4, "\x1fabcdefghij")],
    "long": [(i, "\n".join(f"line number {j % 70}" for j in range(i * 40))) for i in range(1, 6)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, name):
    assert run(spark, CASES[name]) == brute(CASES[name])


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_random_with_hot_lines_over_any_number_of_ranges(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.randint(0, 60), "\n".join(f"a line of kind {int(rng.paretovariate(1)) % 30}" for _ in range(rng.randint(0, 90)))) for _ in range(80)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_keep_bitmaps_hold_the_runs_that_stay(spark):
    again = "a line that repeats"
    rows = [(1, again), (2, "\n".join([*(f"fresh text number {i}" for i in range(40)), again])), (3, "\n".join([again, again, "another fresh line", again, "end of the fresh"])), (4, "nothing repeats here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r._doc: ([tuple(k) for k in r.keep], r.n_dropped) for r in line_dedup.line_bitmaps(docs).collect()}
    assert got == {2: ([(0, 40), (41, None)], 1), 3: ([(0, 0), (2, 3), (4, None)], 3)}


def test_a_long_document_has_a_short_bitmap(spark):
    rows = [(1, "a line that repeats"), (2, "\n".join([str(i) for i in range(300_000)] + ["a line that repeats"]))]
    r = line_dedup.line_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(r) == 1 and [tuple(k) for k in r[0].keep] == [(0, 300_000), (300_001, None)]
