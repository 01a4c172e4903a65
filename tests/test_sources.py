import json
import socket
import threading
import time

from lodestone.operators import explore
from lodestone.sources import readers, sinks


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id": "u1", "business_id": "b1", "stars": 4, "date": "2018-01-02", "x": 1}\n{"user_id": "u2", "business_id": "b1", "stars": 2.5, "date": "2017-01-02"}\nnot json\n')
    (tmp_path / "b.json").write_text('{"business_id": "b1", "city": "Zürich"}\n')
    (tmp_path / "t.csv").write_text("user_id,business_id,stars\nu1,b1,5.0\n")
    (tmp_path / "p.csv").write_text("7,3,1.5,-2\n8,1,0,4\n")
    reviews = readers.read_json(spark, str(tmp_path / "r.json"))
    assert explore.count_in_year(reviews, 2018, "n").first().n == 1
    business = readers.read_json(spark, str(tmp_path / "b.json"), readers.BUSINESS)
    assert [tuple(r) for r in explore.average_by(reviews, business, "business_id", "city", "stars").collect()] == [("Zürich", 3.25)]
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("u1", "b1", 5.0)]
    assert readers.read_text(spark, str(tmp_path / "t.csv")).count() == 2
    assert [(r.id, list(r.features)) for r in readers.read_points(spark, str(tmp_path / "p.csv")).collect()] == [(7, [1.5, -2.0]), (8, [0.0, 4.0])]


def test_sinks(spark, tmp_path):
    sinks.write_json_object(str(tmp_path / "o.json"), {"n": 1, "top": [["o'b(", 2]]})
    assert json.loads((tmp_path / "o.json").read_text()) == {"n": 1, "top": [["o'b(", 2]]}
    read = lambda p: "".join(f.read_text() for f in sorted((tmp_path / p).glob("part-*")))
    edges = spark.createDataFrame([(2, 3, 1.0), (1, 2, 2.5)], "src long, dst long, betweenness double")
    sinks.write_betweenness(edges.coalesce(1), str(tmp_path / "bet"))
    assert read("bet") == "('1', '2'), 2.5\n('2', '3'), 1.0\n"
    sinks.write_communities(spark.createDataFrame([(2, ["b", "c"]), (1, ["a"])], "size long, members array<string>"), str(tmp_path / "com"))
    assert read("com") == "'a'\n'b', 'c'\n"
    sinks.write_assignments(spark.createDataFrame([("10", 1), ("9", -1)], "id string, cluster int"), str(tmp_path / "cl"))
    assert read("cl") == "id,cluster\n9,-1\n10,1\n"
    sinks.write_csv(spark.createDataFrame([("a", 1.0)], "city string, stars double").coalesce(1), str(tmp_path / "csv"))
    assert read("csv") == "city,stars\na,1.0\n"
    sinks.write_json_lines(spark.createDataFrame([("a", 1.0)], "city string, stars double"), str(tmp_path / "js"))
    assert json.loads(read("js")) == {"city": "a", "stars": 1.0}
    assert sinks.cluster_report([(1, 5, 2, 3, 1)]) == "Round 1: 5,2,3,1"


def test_explore(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("c", 3), ("b", 4)], "k string, n int")
    assert [tuple(r) for r in explore.top(df, "k", 2).collect()] == [("a", 2), ("b", 2)]
    assert explore.count_distinct(df, "k", "n").first().n == 3
    parts = explore.items_per_partition(explore.repartitioned(df, 4, "k")).collect()
    assert sum(r.n_items for r in parts) == 5
    assert {r.partition: r.n_items for r in explore.items_by_key_modulo(df, "n", 2).collect()} == {0: 2, 1: 3}


def test_timings(spark):
    took = explore.collect_against_take(spark.range(100))
    assert set(took) == {"m1", "m2"} and min(took.values()) > 0


def test_socket(spark, scratch):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = server.accept()
        c.sendall(b'{"city": "Rome"}\n{"city": "Oslo"}\n')
        time.sleep(8)
        c.close()

    threading.Thread(target=serve, daemon=True).start()
    stream = readers.socket_json(spark, "127.0.0.1", server.getsockname()[1])
    query = stream.writeStream.format("memory").queryName("cities").outputMode("append").option("checkpointLocation", scratch.path()).start()
    until = time.time() + 30
    while time.time() < until and spark.table("cities").count() < 2:
        time.sleep(0.3)
    query.stop()
    assert {r.city for r in spark.table("cities").collect()} == {"Rome", "Oslo"}


def test_tweets(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"id": 1, "entities": {"hashtags": [{"text": "a"}, {"text": null}, {"text": "b"}]}}\n{"id": 2, "entities": {"hashtags": []}}\n{"id": 3}\n')
    tags = readers.tweet_tags(readers.read_json(spark, str(tmp_path / "t.json"), readers.TWEET))
    assert sorted((r.event_id, r.tag) for r in tags.collect()) == [("1-0", "a"), ("1-2", "b")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("u1", "b1", "2018-01-01"), ("u1", "b2", "2017-05-05"), ("u2", "b1", "2018-03-03")], "user string, business string, date string")
    report = explore.exploration_report(df, 2018)
    assert report == {"n_review": 3, "n_review_2018": 2, "n_user": 2, "top10_user": [["u1", 2], ["u2", 1]], "n_business": 2, "top10_business": [["b1", 2], ["b2", 1]]}
    sinks.write_json_object(str(tmp_path / "r.json"), report)
    assert json.loads((tmp_path / "r.json").read_text()) == report
    parts = explore.partition_report(df.repartition(3), "business", 5, lambda x: explore.top(x, "business").collect())
    assert parts["default"]["n_partition"] == 3 and parts["customized"]["n_partition"] == 5
    assert len(parts["customized"]["n_items"]) == 5 and sum(parts["customized"]["n_items"]) == 3 and 0 in parts["customized"]["n_items"]
    assert all(p["exe_time"] > 0 for p in parts.values())
    timing = explore.timing_report(df)
    assert {"m1", "m2", "explanation"} == set(timing)
