"""The corpus pipeline: stages that each work on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, line_dedup, packing, quality, simhash
from lodestone.llm.common import aside, read
from lodestone.scratch import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, does not reject.

    Null and empty texts are scored like any other; without labels of both classes all
    stay; repeated rows go or stay together; columns of any names pass through.
    """
    safe = aside(docs)
    scored = quality.score(safe, quality.train(safe, read(spark, sf_dir, "labels")))
    return scored.where(F.col("_score") >= quality.THRESHOLD).select(*safe.columns).toDF(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows the text.

    A null text stays null; a document that loses all its lines stays, with an empty text;
    rows that share an id count as one document; a row with a null id stays as it is;
    columns of any names pass through.
    """
    safe = aside(docs)
    out = line_dedup.drop_repeated_lines(safe)
    text = F.when(F.col("text").isNotNull(), F.col("_kept"))
    made = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return out.select(*(made.get(c, F.col(s)).alias(s) for c, s in zip(docs.columns, safe.columns, strict=True))).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8).

    Texts without words are copies of each other; of rows that share an id and a text one
    stays, with different texts all do; rows with a null id stay; columns of any names pass
    through.
    """
    safe = aside(docs)
    found = simhash.near_duplicates(safe)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = safe.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    if again.limit(1).count():
        once = kept.join(again, F.col("doc_id") == F.col("_again"), "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, F.col("doc_id") == F.col("_again"), "left_anti").unionByName(once)
    return kept.toDF(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; rows that share an id go together; rows with a null id
    stay; columns of any names pass through.
    """
    safe = aside(docs)
    held = decontam.contaminated(safe, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_gone")).distinct()
    return safe.join(held, F.col("doc_id") == F.col("_gone"), "left_anti").toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of what is left: pieces of documents, as ``packing.pack_documents`` gives them.

    A null or empty text is its end id alone; each of repeated rows is packed; null ids stay null.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("line dedup", drop_lines),
    ("near-dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
