"""Scans and sinks of the study library: JSON lines, JSON documents, tab-separated cards and Parquet indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.study import latest

CHUNK = "chunk_id string, book_name string, chapter_number int, section_number string, section_title string, page_start int, page_end int, chunk_index int, total_chunks int, word_count int, text string"
PAGE = "id string, book_id string, pdf_page_number int, text string, word_count int"
CARD = "card_id string, book_name string, tags array<string>, prompt string, answer string, card_type string, due_date date, interval_days int, ease_factor double, reps int, lapses int, last_reviewed date"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that read_lines leaves out."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path).cache().where("_corrupt_record is not null").select("_corrupt_record")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_latest(spark: SparkSession, path: str, schema: str, key: str, order: list[Column]) -> DataFrame:
    """JSON lines of which the last of each key counts."""
    return latest(read_lines(spark, path, schema), [key], order)


def stream_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Postings, lengths, vectors and the like as Parquet folders under one path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_cards_tsv(cards: DataFrame, path: str) -> None:
    """front, back and tags without a header, quoted only where needed."""
    cards.select("front", "back", "tags").write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def page_text(html: Column) -> Column:
    """The text of an HTML page: without comments, scripts, styles and tags, five entities decoded, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->|(?i)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
