"""Sources: review-site records in text, JSON lines, CSV and parquet, streams, and the relations over the star schema.

``relations`` maps the mining operators' inputs onto the tables region .. events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType()), T.StructField("stars", T.DoubleType()), T.StructField("date", T.StringType())])
BUSINESS = T.StructType([T.StructField("business_id", T.StringType()), T.StructField("city", T.StringType())])
RATING = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType()), T.StructField("stars", T.DoubleType())])
PAIR = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType())])
CITY = T.StructType([T.StructField("city", T.StringType())])

TWEET = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("entities", T.StructType([T.StructField("hashtags", T.ArrayType(T.StructType([T.StructField("text", T.StringType())])))])),
])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType = REVIEW) -> DataFrame:
    """JSON lines with a schema; fields that a line lacks are null, lines that are no JSON give nulls."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RATING, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(id, features) from CSV without header: id, a label that is ignored, then the features."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(parts[0].cast("long").alias("id"), F.transform(F.slice(parts, 3, F.size(parts) - 2), lambda x: x.cast("double")).alias("features"))


def read_points_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def local_rows(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def socket_json(spark: SparkSession, host: str, port: int, schema: T.StructType = CITY) -> DataFrame:
    """A stream of JSON lines from a socket, with its arrival time."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()
    return lines.select(F.col("timestamp").alias("ts"), F.from_json("value", schema).alias("r")).select("ts", "r.*")


def file_json(spark: SparkSession, path: str, schema: T.StructType = CITY, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def file_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a parquet table's files; the schema is that of the table as it is now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def tweet_tags(tweets: DataFrame) -> DataFrame:
    """(event_id, ts, tag), batch or stream: a row for each hashtag of a tweet; null tags and tweets without any give none."""
    tags = tweets.select("id", F.col("created_at").alias("ts"), F.posexplode("entities.hashtags.text").alias("at", "tag")).where("tag is not null")
    return tags.select(F.concat_ws("-", F.col("id").cast("string"), F.col("at").cast("string")).alias("event_id"), "ts", "tag")


class Relations:
    """The operators' inputs over the tables in ``sf_dir``; each is lazy and reads only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def reviews(self) -> DataFrame:
        """(user, business, stars, date): a line item is a review of a part by the order's customer."""
        orders, items = self.table("orders"), self.table("lineitem")
        joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
        return joined.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("business"), F.expr("1 + cast(l_quantity as bigint) % 5").cast("double").alias("stars"), F.col("o_orderdate").alias("date"))

    def supplier_reviews(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("business"), F.expr("1 + cast(l_quantity as bigint) % 5").cast("double").alias("stars"))

    def cities(self) -> DataFrame:
        """(business, city): a supplier's nation."""
        s, n = self.table("supplier"), self.table("nation")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("business"), F.col("n_name").alias("city"))

    def baskets(self) -> DataFrame:
        """(basket, item): the brands of an order's parts, each once."""
        items, parts = self.table("lineitem"), self.table("part")
        return items.join(parts, items.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()

    def ratings(self) -> DataFrame:
        """(user, item, rating): a customer's mean stars for a part."""
        return self.reviews().groupBy("user", F.col("business").alias("item")).agg(F.avg("stars").alias("rating"))

    def train_test(self) -> tuple[DataFrame, DataFrame]:
        rows = self.ratings()
        held = F.expr("(user * 31 + item) % 10 = 0")
        return rows.where(~held), rows.where(held)

    def document_words(self) -> DataFrame:
        """(item, token): each document's distinct lower-cased words; documents without words have no rows."""
        words = F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+")))
        return self.table("documents").select(F.col("doc_id").alias("item"), words.alias("token")).where("token <> ''")

    def user_props(self) -> DataFrame:
        """(user, business): the distinct property numbers of a user's events."""
        return self.events().select(F.col("user_id").alias("user"), F.col("tag").alias("business")).distinct()

    def events(self) -> DataFrame:
        """events with ``ts`` as a timestamp and ``tag``, the number in props."""
        return self.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("tag"))

    def tweets(self) -> DataFrame:
        """Tweets as their feed has them: an event is a tweet whose hashtags are its number and its type; an event without a number has the type and a null."""
        tag = lambda c: F.struct(c.cast("string").alias("text"))
        return self.events().select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.struct(F.array(tag(F.col("tag")), tag(F.col("event_type"))).alias("hashtags")).alias("entities"))

    def points(self) -> DataFrame:
        """(id, label, features)."""
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))
