"""Queries over the star schema: one for each operator of the engine, as functions of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import cluster, explore, graph, itemsets, recommend, similarity, sketch
from ..scratch import Scratch
from ..sources.readers import TWEET, Relations, file_json, file_parquet, tweet_tags
from ..streaming import streams

YEAR = 1998
PARTITIONS = 8
BASKET_SIZE = 4
#: Support as a share of the baskets (lines below a thousandth of a basket count do not occur).
SUPPORT, TRIPLE_SUPPORT = 0.02, 0.004
CHUNKS = 4
SIMILAR = 0.5
SHARED = 35
#: Co-raters of the query that shows the bound.
FEW = 2
DAY = "1 day"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _joined(items: str = "items") -> F.Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",").alias("items")


# Exploration


def review_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.count_rows(Relations(spark, sf_dir).reviews(), "n_review")


def reviews_in_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.count_in_year(Relations(spark, sf_dir).reviews(), YEAR, "n_review")


def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.count_distinct(Relations(spark, sf_dir).reviews(), "user", "n_user")


def distinct_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.count_distinct(Relations(spark, sf_dir).reviews(), "business", "n_business")


def top10_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top(Relations(spark, sf_dir).reviews(), "user")


def top10_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top(Relations(spark, sf_dir).reviews(), "business")


def partition_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.items_by_key_modulo(Relations(spark, sf_dir).reviews(), "business", PARTITIONS)


def hash_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = Relations(spark, sf_dir).reviews().select("business")
    return explore.items_per_partition(explore.repartitioned(reviews, PARTITIONS, "business"))


def avg_stars_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Relations(spark, sf_dir)
    return explore.ranked(_rounded(explore.average_by(r.supplier_reviews(), r.cities(), "business", "city", "stars"), "stars"), "stars", "city")


def top10_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avg_stars_by_city(spark, sf_dir).limit(10)


# Itemsets


def baskets_case1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.baskets(Relations(spark, sf_dir).baskets(), "basket", "item")


def baskets_case2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.baskets(Relations(spark, sf_dir).baskets(), "item", "basket")


def baskets_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.larger_than(baskets_case1(spark, sf_dir), BASKET_SIZE)


def _level(spark: SparkSession, sf_dir: str, size: int, share: float) -> DataFrame:
    scratch = Scratch(spark, "itemsets")
    rows = scratch.save(Relations(spark, sf_dir).baskets())
    found = itemsets.apriori(rows, share * rows.select("basket").distinct().count(), scratch, size)
    return found.where(F.size("items") == size).select(_joined(), "n")


def frequent_singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level(spark, sf_dir, 1, SUPPORT)


def frequent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level(spark, sf_dir, 2, SUPPORT)


def frequent_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level(spark, sf_dir, 3, TRIPLE_SUPPORT)


def son_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "son")
    rows = scratch.save(Relations(spark, sf_dir).baskets())
    return itemsets.son_candidates(rows, SUPPORT * rows.select("basket").distinct().count(), CHUNKS, scratch).select(_joined())


def son_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "son")
    rows = scratch.save(Relations(spark, sf_dir).baskets())
    return itemsets.son(rows, SUPPORT * rows.select("basket").distinct().count(), CHUNKS, scratch).select(_joined(), "n")


def frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-priori over all sizes."""
    scratch = Scratch(spark, "itemsets")
    rows = scratch.save(Relations(spark, sf_dir).baskets())
    return itemsets.apriori(rows, TRIPLE_SUPPORT * rows.select("basket").distinct().count(), scratch).select(_joined(), "n")


def fpgrowth_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Scratch(spark, "fpgrowth").save(Relations(spark, sf_dir).baskets())
    support = -(-int(1000 * TRIPLE_SUPPORT) * rows.select("basket").distinct().count() // 1000)
    return itemsets.fpgrowth(rows, support).select(_joined(), "n")


# Similarity


def _lsh(spark: SparkSession, sf_dir: str) -> similarity.Lsh:
    scratch = Scratch(spark, "lsh")
    return similarity.Lsh(scratch.save(Relations(spark, sf_dir).document_words()), scratch)


def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lsh(spark, sf_dir).signatures()


def lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lsh(spark, sf_dir).bands()


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lsh(spark, sf_dir).candidates()


def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lsh(spark, sf_dir).members


def jaccard_lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, those that share no band too, and each class's members with its head."""
    lsh = _lsh(spark, sf_dir)
    return _rounded(lsh.with_copies(lsh.whole_pairs(SIMILAR)), "similarity").orderBy("a", "b")


def jaccard_exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of classes, and each class's members with its head."""
    lsh = _lsh(spark, sf_dir)
    return _rounded(lsh.with_copies(lsh.exact_pairs(SIMILAR)), "similarity").orderBy("a", "b")


def lsh_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    lsh = _lsh(spark, sf_dir)
    return _rounded(similarity.precision_recall(lsh.scratch.save(lsh.pairs(SIMILAR)), lsh.scratch.save(lsh.exact_pairs(SIMILAR))), "precision", "recall")


# Recommenders


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Scratch]:
    scratch = Scratch(spark, "ratings")
    train, test = Relations(spark, sf_dir).train_test()
    return scratch.save(train), scratch.save(test), scratch


def user_avg_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommend.averages(Relations(spark, sf_dir).train_test()[0], "user"), "avg_rating")


def item_avg_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommend.averages(Relations(spark, sf_dir).train_test()[0], "item"), "avg_rating")


def item_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = _split(spark, sf_dir)
    return _rounded(recommend.item_cosines(train, recommend.item_pairs(train, test)), "sim")


def item_cosine_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With so few co-raters that the bound cuts some."""
    train, test, _ = _split(spark, sf_dir)
    return _rounded(recommend.item_cosines(train, recommend.item_pairs(train, test), FEW), "sim")


def user_cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = _split(spark, sf_dir)
    return _rounded(recommend.user_based(train, test), "prediction")


def item_cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = _split(spark, sf_dir)
    return _rounded(recommend.item_based(train, test), "prediction")


def lsh_item_cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, scratch = _split(spark, sf_dir)
    lsh = similarity.Lsh(train.select("item", F.col("user").alias("token")), scratch)
    return _rounded(recommend.item_based(train, test, scratch.save(lsh.pairs(SIMILAR))), "prediction")


def cf_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = _split(spark, sf_dir)
    rows = [recommend.rmse(predicted, test).select(F.lit(name).alias("method"), "rmse", "n") for name, predicted in (("item", recommend.item_based(train, test)), ("user", recommend.user_based(train, test)))]
    return _rounded(rows[0].unionByName(rows[1]), "rmse")


def als_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = _split(spark, sf_dir)
    return recommend.als(train, test)


# Graphs


def _classes(spark: SparkSession, sf_dir: str) -> tuple[graph.Classes, Scratch]:
    scratch = Scratch(spark, "graph")
    return graph.class_graph(Relations(spark, sf_dir).user_props(), "user", "business", SHARED, scratch), scratch


def co_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.class_edges(_classes(spark, sf_dir)[0])


def co_graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.class_vertices(_classes(spark, sf_dir)[0])


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(graph.class_edges(_classes(spark, sf_dir)[0]))


def lpa_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.class_label_propagation(*_classes(spark, sf_dir)).select("id", "label")


def lpa_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(lpa_labels(spark, sf_dir)).select("label", "size", F.array_join("members", ",").alias("members"))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.class_components(*_classes(spark, sf_dir))


def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.class_edge_betweenness(*_classes(spark, sf_dir)), "betweenness")


def edge_betweenness_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, scratch = _classes(spark, sf_dir)
    return _rounded(graph.class_edge_betweenness(found, scratch, small=-1), "betweenness")


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, scratch = _classes(spark, sf_dir)
    return _rounded(graph.class_modularity(found, graph.class_label_propagation(found, scratch)), "modularity")


def girvan_newman(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, scratch = _classes(spark, sf_dir)
    return graph.class_girvan_newman(found, scratch, 50)[0]


# Clusters


def cluster_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.summaries(Relations(spark, sf_dir).points(), "label")
    wide = rows.select("label", "n", F.posexplode(F.arrays_zip(F.col("sum"), vectors.centroid().alias("centroid"), vectors.deviation().alias("std"))).alias("dim", "d"))
    return wide.select("label", "n", "dim", *(F.round(F.col(f"d.{c}"), 6).alias(c) for c in ("sum", "centroid", "std")))


def mahalanobis_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = Relations(spark, sf_dir).points()
    return _rounded(cluster.assign(points, cluster.collect_summaries(points, "label")).select("id", "cluster", "distance"), "distance")


def cluster_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cluster.merge_candidates(vectors.summaries(Relations(spark, sf_dir).points(), "label")), "distance")


def bfr_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = cluster.bfr(Relations(spark, sf_dir).points(), 10, Scratch(spark, "bfr"))
    return spark.createDataFrame(report, "round int, ds_points long, cs_sets int, cs_points long, rs_points long")


def bfr_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.bfr(Relations(spark, sf_dir).points(), 10, Scratch(spark, "bfr"))[1]


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.kmeans(Relations(spark, sf_dir).points(), 10).select("id", "cluster")


# Sketches


def _days(col: str = "ts") -> F.Column:
    return F.date_format(col, "yyyy-MM-dd")


def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sketch.bloom(sketch.first_sights(Relations(spark, sf_dir).events(), "user_id", _days())), "fpr")


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", _days("window_start"))


def fm_estimate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(sketch.fm_windows(Relations(spark, sf_dir).events(), "user_id", "3 days", DAY))


def exact_distinct_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(sketch.distinct_windows(Relations(spark, sf_dir).events(), "user_id", "3 days", DAY))


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(sketch.tumbling_counts(Relations(spark, sf_dir).events(), DAY))


def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.reservoir(Relations(spark, sf_dir).events())


def top_tags_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.tag_tiers(reservoir_sample(spark, sf_dir))


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Scratch]:
    return file_parquet(spark, f"{sf_dir}/events.parquet"), Scratch(spark, "stream")


def stream_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, scratch = _stream(spark, sf_dir)
    return _dated(streams.fm_windows(stream, "user_id", "3 days", DAY, scratch))


def stream_window_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, scratch = _stream(spark, sf_dir)
    return _dated(streams.distinct_windows(stream, "user_id", "3 days", DAY, scratch))


def stream_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, scratch = _stream(spark, sf_dir)
    return _rounded(streams.bloom(stream, "user_id", _days(), scratch), "fpr")


def hashtag_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.tag_tiers(sketch.reservoir(tweet_tags(Relations(spark, sf_dir).tweets())))


def stream_hashtag_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tweets are written as the files that their feed is read from, and read as a stream."""
    scratch = Scratch(spark, "tweets")
    path = scratch.path()
    Relations(spark, sf_dir).tweets().repartition(4).write.json(path)
    return streams.last_tiers(tweet_tags(file_json(spark, path, TWEET, 1)), scratch)


def stream_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.reservoir(*_stream(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        review_count, reviews_in_year, distinct_users, distinct_businesses, top10_users, top10_businesses, partition_item_counts, hash_partition_counts,
        avg_stars_by_city, top10_cities, baskets_case1, baskets_case2, baskets_min_size, frequent_singles, frequent_pairs, frequent_triples, son_candidates,
        son_frequent, frequent_itemsets, fpgrowth_itemsets, minhash_signatures, lsh_bands, lsh_candidates, document_classes, jaccard_lsh_pairs, jaccard_exact_pairs,
        lsh_precision_recall, user_avg_ratings, item_avg_ratings, item_cosine, item_cosine_first, user_cf, item_cf, lsh_item_cf, cf_rmse, als_predictions, co_graph_edges,
        co_graph_vertices, adjacency, lpa_labels, lpa_communities, connected_components, edge_betweenness, edge_betweenness_joins, modularity, girvan_newman,
        cluster_summaries, mahalanobis_assign, cluster_merge_candidates, bfr_rounds, bfr_assignments, kmeans_assign, bloom_fpr, fm_estimate_windows,
        exact_distinct_windows, tumbling_counts, reservoir_sample, top_tags_tiers, stream_fm, stream_window_distinct, stream_bloom, stream_reservoir,
        hashtag_tiers, stream_hashtag_tiers,
    )
}
