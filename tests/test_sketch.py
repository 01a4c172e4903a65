import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.operators import sketch
from lodestone.streaming import streams

START = datetime(2024, 1, 1)


def events_of(spark, rows):
    return spark.createDataFrame([(i, START + timedelta(hours=i), u, "t", t) for i, (u, t) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, tag long")


def test_hashes(spark):
    df = spark.createDataFrame([("San Francisco Bay",), ("Zürich",), ("",)], "s string")
    assert [r[0] for r in df.select(hashing.bytes_modulo(F.col("s"), 450)).collect()] == [int.from_bytes(s.encode(), "big") % 450 for s in ("San Francisco Bay", "Zürich", "")]
    zeros = spark.createDataFrame([(448,), (0,), (1,), (6,)], "x long").select(hashing.trailing_zeros(F.col("x")))
    assert [r[0] for r in zeros.collect()] == [6, 1, 0, 1]


def test_bloom_against_the_sequential_filter(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 60), 0) for _ in range(300)]
    bits, seen, fp, tn, expected = set(), set(), 0, 0, {}
    for i, (u, _) in enumerate(rows):
        if u not in seen:
            x = int.from_bytes(str(u).encode(), "big")
            at = {(a * x + b) % sketch.BLOOM_BITS for a, b in sketch.BLOOM_HASHES}
            fp, tn = fp + (at <= bits), tn + (not at <= bits)
            bits |= at
            seen.add(u)
            expected[(START + timedelta(hours=i)).strftime("%Y-%m-%d")] = (fp, tn)
    got = {r.batch: (r.fp, r.tn) for r in sketch.bloom(sketch.first_sights(events_of(spark, rows), "user_id", F.date_format("ts", "yyyy-MM-dd"))).collect()}
    assert got == expected


def test_bloom_of_nothing(spark):
    assert sketch.bloom(sketch.first_sights(events_of(spark, [(1, 1)]).limit(0), "user_id", F.lit("x"))).count() == 0


def test_fm_is_within_a_factor(spark):
    rows = [(i % 40, 0) for i in range(24)]
    r = sketch.fm_windows(events_of(spark, rows), "user_id", "1 day", "1 day").first()
    assert 24 / 8 <= r.estimate <= 24 * 8


@pytest.mark.parametrize("n", [50, 1000])
def test_reservoir_size(spark, n):
    got = sketch.reservoir(events_of(spark, [(1, i % 7) for i in range(n)] + [(1, None)]))
    assert got.count() == min(100, n) and got.where("tag is null").count() == 0


def test_reservoir_is_even(spark):
    events = events_of(spark, [(1, 0) for _ in range(300)])
    hits = {}
    for s in range(12):
        for r in sketch.reservoir(events, 100, f"seed{s}").collect():
            hits[r.event_id] = hits.get(r.event_id, 0) + 1
    halves = [sum(n for i, n in hits.items() if i % 2 == h) for h in (0, 1)]
    assert abs(halves[0] - halves[1]) < 150


def test_tiers_keep_ties(spark):
    sample = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate([1, 1, 1, 2, 2, 3, 3, 4, 5, 6])], "event_id long, tag long, priority string")
    assert [(r.tier, r.tag) for r in sketch.tag_tiers(sample, 2).collect()] == [(1, 1), (2, 2), (2, 3)]


def test_streams_equal_batches(spark, scratch, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    path = str(tmp_path / "events.parquet")
    table.repartition(5).write.parquet(path)
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(path)
    batch = streams.events_of(table)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(streams.fm_windows(stream(), "user_id", "3 days", "1 day", scratch), sketch.fm_windows(batch, "user_id", "3 days", "1 day"))
    assert same(streams.distinct_windows(stream(), "user_id", "3 days", "1 day", scratch), sketch.distinct_windows(batch, "user_id", "3 days", "1 day"))
    assert same(streams.reservoir(stream(), scratch), sketch.reservoir(batch))
    day = F.date_format("ts", "yyyy-MM-dd")
    assert same(streams.bloom(stream(), "user_id", day, scratch), sketch.bloom(sketch.first_sights(batch, "user_id", day)))


def test_late_tolerant_counts(spark, sf, scratch):
    table = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf}/events.parquet*")
    out, check = scratch.path(), scratch.path()
    from lodestone.sources.sinks import append_stream

    append_stream(streams.late_tolerant_counts(stream, "1 day", "1 hour"), out, check).awaitTermination()
    closed = {(r.window_start, r.event_type): r.n for r in spark.read.parquet(out).collect()}
    whole = {(r.window_start, r.event_type): r.n for r in sketch.tumbling_counts(streams.events_of(table), "1 day").collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())


def _lines(path):
    import csv

    return [tuple(r) for f in sorted(path.glob("part-*.csv"), key=lambda f: f.stat().st_mtime_ns) for r in list(csv.reader(f.open()))[1:]]


def test_report_lines_of_streams(spark, scratch, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    stream = lambda: spark.readStream.schema(table.schema).parquet(f"{sf}/events.parquet*")
    day = F.date_format("ts", "yyyy-MM-dd")
    streams.report_bloom(stream(), "user_id", day, str(tmp_path / "bloom"), scratch.path()).awaitTermination()
    last = sketch.bloom(sketch.first_sights(streams.events_of(table), "user_id", day)).orderBy(F.desc("batch")).first()
    assert [(t, round(float(v), 9)) for t, v in _lines(tmp_path / "bloom")][-1] == (last.batch, round(last.fpr, 9))
    streams.report_fm(stream(), "user_id", "3 days", "1 day", str(tmp_path / "fm"), scratch.path()).awaitTermination()
    batch = streams.events_of(table)
    truth = {r.window_start: r.n_distinct for r in sketch.distinct_windows(batch, "user_id", "3 days", "1 day").collect()}
    estimate = {r.window_start: r.estimate for r in sketch.fm_windows(batch, "user_id", "3 days", "1 day").collect()}
    got = {datetime.strptime(t, "%Y-%m-%d %H:%M:%S"): (int(a), int(b)) for t, a, b in _lines(tmp_path / "fm")}
    assert got and all((truth[t], estimate[t]) == v for t, v in got.items())


def test_processing_time_trigger(spark, scratch, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    seen = []
    query = streams.follow(streams.events_of(spark.readStream.schema(table.schema).parquet(f"{sf}/events.parquet*")), scratch.path(), "append", lambda df, i: seen.append((i, df.count())), processingTime="1 second")
    query.processAllAvailable()
    assert query.isActive and seen == [(0, table.count())]
    query.stop()


def test_tiers_after_each_batch_survive_a_restart(spark, scratch, tmp_path):
    rows = [(f"{i}-0", START + timedelta(hours=i), f"t{i * i % 7}") for i in range(400)]
    path, folder, check, tiers = str(tmp_path / "tags"), scratch.path(), scratch.path(), []
    each = lambda df, i: tiers.append((i, [tuple(r) for r in df.collect()]))
    for start in (0, 200):  # the second run goes on from the first one's checkpoint, with nothing in memory
        tags = spark.createDataFrame(rows[start : start + 200], "event_id string, ts timestamp, tag string")
        tags.repartition(2).write.mode("append").parquet(path)
        stream = spark.readStream.schema(tags.schema).option("maxFilesPerTrigger", 1).parquet(path)
        streams.tag_tiers(stream, folder, check, each).awaitTermination()
    assert [i for i, _ in tiers] == [0, 1, 2, 3]
    whole = sketch.tag_tiers(sketch.reservoir(spark.createDataFrame(rows, "event_id string, ts timestamp, tag string")))
    assert tiers[-1][1] == [tuple(r) for r in whole.collect()]
