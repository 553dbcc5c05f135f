"""Chapters, sections, outlines and windows over pages and chunks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def outline(chunks: DataFrame) -> DataFrame:
    """Two levels of outline rows from chunks: sections with their page span, and chapters over their sections."""
    paged = chunks.where("page_start <> 0 or page_end <> 0")
    sections = paged.groupBy("book", "chapter", "section").agg(F.min("page_start").alias("lo"), F.max("page_end").alias("hi"))
    chapter_id = F.concat(F.lit("ch_"), F.col("chapter").cast("string"))
    chapters = sections.groupBy("book", "chapter").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(
        "book", chapter_id.alias("id"), F.concat(F.lit("Chapter "), F.col("chapter").cast("string")).alias("title"), F.lit(1).alias("level"), "lo", "hi", F.lit(None).cast("string").alias("parent_id")
    )
    named = sections.where("section <> ''").select(
        "book", F.concat(chapter_id, F.lit("_sec_"), F.replace("section", F.lit("."), F.lit("_"))).alias("id"),
        F.concat(F.lit("Section "), F.col("chapter").cast("string"), F.lit("."), F.col("section")).alias("title"), F.lit(2).alias("level"), "lo", "hi", chapter_id.alias("parent_id"),
    )
    return chapters.union(named)


def outline_digest(items: DataFrame) -> DataFrame:
    """A digest of each book's outline that doesn't depend on the order of its rows."""
    item = F.concat_ws("|", "id", "title", F.col("lo").cast("string"), F.col("hi").cast("string"))
    return items.groupBy("book").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), ";"), 256), 1, 16).alias("outline_id"))


def page_buckets(chunks: DataFrame, pages: int = 20) -> DataFrame:
    """An outline by every so many pages, for books without chapters."""
    span = chunks.groupBy("book").agg(F.least(F.min("page_start"), F.min("page_end")).alias("low"), F.greatest(F.max("page_start"), F.max("page_end")).alias("high"))
    return span.select("book", "high", F.explode(F.sequence("low", "high", F.lit(pages).cast("bigint"))).alias("start")).select("book", "start", F.least(F.col("start") + pages - 1, F.col("high")).alias("end"))


def word_windows(docs: DataFrame, id_col: str, s: Column, most: int = 1000, overlap: int = 100, all_words: bool = True) -> DataFrame:
    """(id, chunk_index, total_chunks, words): a text of over `most` words as windows of that many, each starting `overlap` before the last one's end.

    There are as many windows as it takes to reach the last word. Without all_words there are ceil(words / most), as the
    reference has it, so that the last words of a long text are in none.
    """
    after_first = F.ceil((F.size("w") - most) / (most - overlap)) if all_words else F.ceil(F.size("w") / most) - 1
    held = docs.select(F.col(id_col).alias("id"), T.words(s).alias("w")).withColumn("total_chunks", (F.greatest(after_first, F.lit(0)) + 1).cast("int"))
    one = held.select("id", "w", "total_chunks", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)).alias("chunk_index"))
    return one.select("id", "chunk_index", "total_chunks", F.slice("w", F.col("chunk_index") * (most - overlap) + 1, F.when(F.col("total_chunks") == 1, F.greatest(F.size("w"), F.lit(1))).otherwise(most)).alias("words"))


def section_spans(starts: DataFrame, by: list[str], start: str, last_page: DataFrame) -> DataFrame:
    """Sections with the page before the next section as their end; a book's last section ends on its last page."""
    w = Window.partitionBy(*by).orderBy(start, "section_number")
    return starts.withColumn("next", F.lead(start).over(w)).join(last_page, by).withColumn("page_end", F.coalesce(F.greatest(F.col("next") - 1, F.col(start)), F.col("last_page"))).drop("next", "last_page")


def greedy_pack(docs: DataFrame, id_col: str, sizes: Column, flush: int = 220, most: int = 650) -> DataFrame:
    """(id, packs): paragraph sizes gathered in order into packs; one is closed when the next would pass `most`, or once it has `flush`. A fold of each row's own array."""
    start = F.expr("named_struct('packs', cast(array() as array<int>), 'open', 0)")

    def step(a, n):
        closes = (a["open"] > 0) & (a["open"] + n > most)
        packs = F.when(closes, F.array_append(a["packs"], a["open"])).otherwise(a["packs"])
        now = F.when(closes, n).otherwise(a["open"] + n)
        return F.struct(F.when(now >= flush, F.array_append(packs, now)).otherwise(packs).alias("packs"), F.when(now >= flush, 0).otherwise(now).alias("open"))

    folded = docs.select(F.col(id_col).alias("id"), F.aggregate(sizes, start, step).alias("s"))
    return folded.select("id", F.when(F.col("s.open") > 0, F.array_append("s.packs", F.col("s.open"))).otherwise(F.col("s.packs")).alias("packs"))


def paragraph_pieces(text: str, target: int = 450, most: int = 650) -> list[str]:
    """The paragraphs of a text; one of over `most` words as its sentences, else its lines, else slices of `target` words."""
    solid = lambda parts: [p for p in map(str.strip, parts) if p]
    pieces = []
    for p in solid(re.split(r"\n\s*\n", text)):
        w = p.split()
        if len(w) <= most:
            pieces.append(p)
        elif len(sentences := solid(re.split(r"(?<=[.!?])\s+(?=[A-Z])", p))) > 1:
            pieces += sentences
        elif "\n" in p:
            pieces += [x for x in p.split("\n") if x.strip()]
        else:
            pieces += [" ".join(w[k : k + target]) for k in range(0, len(w), target)]
    return pieces


def pack_pieces(pieces: list[str], flush: int = 220, most: int = 650) -> list[tuple[str, int]]:
    """(text, words) of each pack of pieces as in greedy_pack; a tail of under flush / 2 words joins the pack before."""
    packs, parts, n = [], [], 0
    for p in pieces:
        k = len(p.split())
        if n + k > most:
            if parts:
                packs.append((parts, n))
            parts, n = [p], k
            continue
        parts, n = [*parts, p], n + k
        if n >= flush:
            packs.append((parts, n))
            parts, n = [], 0
    if parts and packs and n < flush // 2:
        packs[-1] = (packs[-1][0] + parts, packs[-1][1] + n)
    elif parts:
        packs.append((parts, n))
    return [("\n\n".join(p), k) for p, k in packs]


def subchunks(docs: DataFrame, id_col: str, s: Column, flush: int = 220, target: int = 450, most: int = 650) -> DataFrame:
    """(id, pos, text, n_words): the sub-chunks of each text in order. As in the reference, one sentence or line of over `most` words stays one pack.

    In Python, as a fold of arrays of texts in SQL copies them at each step.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                rows = [(i, pos, t, n) for i, text in zip(ids, texts) for pos, (t, n) in enumerate(pack_pieces(paragraph_pieces(text or "", target, most), flush, most))]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "pos", "text", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias("id"), s.alias("text")).mapInArrow(run, "id long, pos int, text string, n_words int")
