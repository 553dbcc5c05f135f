"""From documents to packed training sequences: four stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import langid, ngram_join, packing, quality
from marginalia.llm.common import cut, cuts, drop_since, keep_rows, table, without_ids


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in one of the corpus's languages, all columns as they were.

    Profiles are learned from the stage's own rows that name a language, and with them how near a text of so many
    distinct trigrams has to be, by what texts and the same texts with scrambled letters reach. Null
    and empty texts, texts without a letter and those under the limit go, so do all where no row names a language.
    Rows with a null id, repeated rows and ids are judged by their text each; equal texts fare alike. An empty table
    stays empty.
    """
    profiles = langid.learn(docs)
    shared = spark.sparkContext.broadcast((langid.matrix(profiles), langid.limits(docs, profiles)))

    def verdict():
        return lambda texts: langid.accepted(texts, *shared.value)

    return keep_rows(docs, "language", verdict)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose quality score is one half or more, all columns as they were.

    The model is learned from the labelled rows of this stage; without any, all scores are one half and all rows
    stay. Null and empty texts have the score of the model's bias. Rows with a null id, repeated rows and ids are
    judged by their text each; equal texts fare alike. An empty table stays empty.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    shared = spark.sparkContext.broadcast(model)

    def verdict():
        return lambda texts: [shared.value.score(t) >= 0.5 for t in texts]

    return keep_rows(docs, "quality", verdict)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, all columns as they were.

    Documents link at a similarity of 0.75 of their five-word shingles. Null, empty and blank texts and rows with a
    null id are in no group and stay. Rows that repeat an id stay or go together. An empty table stays empty.
    """
    found = cut(ngram_join.near_duplicates(docs, percent=75))
    return without_ids(docs, found.where("doc_id <> component_id").select("doc_id").distinct())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens, as marginalia.llm.packing.pack gives them.

    Null and empty texts are one end token; rows that repeat an id, or have none, are packed each by itself; texts
    of any length are cut into pieces of a sequence. An empty table gives no rows.
    """
    return packing.pack(docs, capacity=1024)


STAGES = [("language", language), ("quality", good), ("near_duplicates", one_of_each), ("packing", packed)]

#: Learned models and tokenization aren't SQL; the tests hold the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again; what a stage wrote on its way is deleted after it, and so is the input of the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = cuts(spark)
        last, docs = docs, cut(stage(spark, docs, sf_dir))
        drop_since(spark, [p for p in before if p != getattr(last, "cut_path", None)], docs)
    return docs
