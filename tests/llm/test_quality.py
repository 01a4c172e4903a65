import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        starts = quality.starts_of(n)
        seen = {i for s in starts for i in range(s, min(n, s + quality.CHUNK))}
        assert seen == set(range(n)) and all(b - a <= quality.STEP for a, b in zip(starts, starts[1:], strict=False))


def test_held_out(spark):
    ids = [*range(50), None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()
    assert {r.doc_id: r.h for r in rows} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


@pytest.fixture(scope="module")
def net(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return quality.train(docs, labels)


def test_held_out_accuracy(spark, net):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs.select("doc_id", "text"), net).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    good, bad = ([r._score for r in rows if r.quality == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad) > 0.95
    assert sum((r._score >= quality.THRESHOLD) == (r.quality == 1) for r in rows) / len(rows) > 0.93


def test_odd_rows(spark, net):
    text = "The thing that was there is of the and to be with this. " * 3000
    docs = spark.createDataFrame([(1, None, 2), (1, "", 2), (None, text, 2), (2, text, 2), (2, text, 2)], "doc_id long, text string, c0 int")
    out = quality.score(docs, net)
    assert out.columns == ["doc_id", "text", "c0", "_score"]
    rows = out.collect()
    assert len(rows) == 5 and all(0 <= r._score <= 1 for r in rows)
    assert rows[0]._score == rows[1]._score and rows[2]._score == rows[3]._score == rows[4]._score
    assert quality.score(docs.limit(0), net).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    assert net is None and {r._score for r in quality.score(docs, net).collect()} == {1.0}
    assert quality.train(docs, labels.limit(0)) is None


def test_sample_takes_one_text_and_one_label_for_each_id(spark):
    docs = spark.createDataFrame([(4, f"text {i}") for i in range(20)] + [(1, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (4, 0), (4, 1), (1, 1), (3, 1), (3, 5)], "doc_id long, quality int")
    rows = {r.id: r for r in quality.sample(docs, labels, 2).collect()}
    assert {i: r.quality for i, r in rows.items()} == {i: 0 if i == 4 else 1 for i in (4, 1, 3) if zlib.crc32(str(i).encode()) % 4 != 2}
    again = quality.sample(docs.repartition(3), labels.repartition(2), 2).collect()
    assert {r.id: r.text for r in again} == {i: r.text for i, r in rows.items()}


def test_very_long_text_scores_like_its_blocks(spark, net, monkeypatch):
    data = b"The thing that was there is of the and to be with this. " * 50_000
    whole = net.logits(*quality.chunks_of(data, quality.starts_of(len(data))))
    assert abs(whole - quality._logits(net, data, block=100)).max() < 1e-4
    row = quality.score(spark.createDataFrame([(1, data.decode())], "doc_id long, text string"), net).first()
    assert abs(row._score - net.probability(whole)) < 1e-6
