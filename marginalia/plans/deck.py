"""Queries of concepts against cards, cards from chunks, identifiers, the library's tables and plans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prose as P
from ..functions import study as U
from ..functions import text as T
from ..operators.joins import as_of_join, top_per_group
from ..operators.structure import outline
from ..sources import tables
from .structure import OUTLINE
from .study import AS_OF, CARDS, MASTERY, REVIEWS, _mastery
from .text import CHUNKS

FEW = 100_000  # names that are sent to every executor; more are joined without a broadcast


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


# Concepts and cards


def concepts(spark, d) -> DataFrame:
    """(name): the words of parts' names and types."""
    p = tables.table(spark, d, "part")
    return p.select(F.explode(F.concat(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type")))).alias("name")).where("name <> ''").distinct()


def covering(spark, d) -> DataFrame:
    """Cards of each concept: its name is the tag, part of it, holds it, or is part of the prompt. Concepts are few names."""
    c = tables.cards(spark, d).withColumn("mastery", _mastery())
    low = F.lower("tag")
    meets = F.contains(low, F.col("name")) | F.contains(F.col("name"), low) | F.contains(F.lower("prompt"), F.col("name"))
    return c.join(few(concepts(spark, d)), meets)


def cards_for_concept(spark, d):
    return covering(spark, d).groupBy("name").agg(F.count("*").alias("n_cards"), F.min("card_id").alias("first"))


def concept_mastery_from_cards(spark, d):
    return concepts(spark, d).join(covering(spark, d).groupBy("name").agg(F.avg("mastery").alias("m")), "name", "left").select("name", F.round(F.coalesce("m", F.lit(0.0)) + 1e-9, 6).alias("mastery"))


def guess_target_concept(spark, d):
    """The concept of each card: its tag if that is one, else the first word of four letters or more of its prompt that is."""
    names = concepts(spark, d)
    c = tables.cards(spark, d)
    words = F.filter(F.regexp_extract_all(F.lower("prompt"), F.lit("[a-z]{4,}"), 0), lambda w: F.length(w) > 0)
    asked = c.select("card_id", F.posexplode(F.concat(F.array(F.lower("tag")), words)).alias("pos", "name")).where("length(name) > 3")
    return asked.join(few(names), "name").groupBy("card_id").agg(F.min_by("name", "pos").alias("concept"))


def compute_concept_difficulty(spark, d):
    """Of each concept: cards, share that lapsed, lapses, share of sessions that asked for it, days to a week's interval, and a score of them; days count from the start of 2024."""
    sessions = tables.reviews(spark, d).select("user_id", F.to_date("ts").alias("day"), "card_id", "quality")
    total = sessions.select("user_id", "day").distinct().agg(F.count("*").alias("total"))
    cards = covering(spark, d)
    used = sessions.where("quality < 3").join(cards.select("name", "card_id"), "card_id").select("name", "user_id", "day").distinct().groupBy("name").agg(F.count("*").alias("used"))
    days = F.when((F.col("interval_days") >= 7) & F.col("last_reviewed").isNotNull(), F.datediff("last_reviewed", F.lit("2024-01-01").cast("date")))
    g = cards.groupBy("name").agg(F.count("*").alias("n_cards"), F.avg((F.col("lapses") > 0).cast("double")).alias("failed"), F.avg("lapses").alias("lapses"), F.coalesce(F.avg(F.when(days >= 0, days)), F.lit(-1.0)).alias("days"))
    pace = F.when(F.col("days") > 0, F.least(F.lit(1.0), F.col("days") / 30)).when(F.col("days") < 0, 0.5).otherwise(0.0)
    score = 0.4 * F.col("failed") + 0.3 * F.least(F.lit(1.0), F.col("lapses") / 5) + 0.3 * pace
    r = lambda c, n=3: F.round(c + 1e-9, n)
    joined = g.join(used, "name", "left").crossJoin(F.broadcast(total))
    return joined.select("name", "n_cards", r(F.col("failed")).alias("failure_rate"), r(F.col("lapses")).alias("avg_lapses"), r(F.coalesce("used", F.lit(0)) / F.col("total")).alias("trigger_rate"), r(F.col("days"), 1).alias("days_to_mastery"), r(score).alias("difficulty"))


def hardest_concepts(spark, d):
    return compute_concept_difficulty(spark, d).orderBy(F.desc("difficulty"), "name").limit(5).select("name", "difficulty")


def compute_remediation_effectiveness(spark, d):
    """Sessions with and without a repeated card: how many, their mean quality, the share of the former above the overall mean, and the difference."""
    s = tables.reviews(spark, d).withColumn("day", F.to_date("ts")).groupBy("user_id", "day").agg(F.avg("quality").alias("q"), (F.count_if(F.col("quality") < 3) > 1).alias("helped"))
    mean = s.agg(F.avg("q").alias("overall"))
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)) + 1e-9, 3)
    w, o = F.avg(F.when(F.col("helped"), F.col("q"))), F.avg(F.when(~F.col("helped"), F.col("q")))
    return s.crossJoin(F.broadcast(mean)).agg(F.count("*").alias("sessions"), F.count_if("helped").alias("helped"), r(w).alias("quality_with"), r(o).alias("quality_without"), r(F.avg(F.when(F.col("helped"), (F.col("q") > F.col("overall")).cast("double")))).alias("uplift"), r(w - o).alias("delta"))


def compute_book_quality(spark, d):
    """By book: questions, mean terminality, share of contradictions and mean confidence; events are the questions, their cards' brands the books."""
    level = F.expr("CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'odd' END")
    q = tables.reviews(spark, d).join(tables.cards(spark, d).select("card_id", "book"), "card_id")
    rows = q.select("book", U.terminality(level, (F.col("event_id") % 11) / 10, F.col("event_id") % 3 == 0).alias("t"), (F.col("event_id") % 3 == 0).alias("c"), F.coalesce(U.literal_map(U.CONFIDENCE)[level], F.lit(0.3)).alias("w"))
    r = lambda c: F.round(c + 1e-9, 3)
    return rows.groupBy("book").agg(F.count("*").alias("questions"), r(F.avg("t")).alias("terminality"), r(F.avg(F.col("c").cast("double"))).alias("contradictions"), r(F.avg("w")).alias("confidence"))


def add_concept(spark, d):
    """Concepts merged: occurrences summed, books and sections united."""
    p = tables.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name"), "p_brand", "p_type")
    return p.groupBy("name").agg(F.count("*").alias("occurrences"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("books"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("sections"))


def link_concept_cooccurrence(spark, d):
    """Both directions of each pair of words that meet in a part's name, with how often."""
    p = tables.table(spark, d, "part").select(F.array_distinct(F.split("p_name", " ")).alias("w"))
    pairs = p.select(F.explode("w").alias("a"), "w").select("a", F.explode("w").alias("b")).where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def log_session(spark, d):
    """One row a learner and day: reviews, correct and incorrect ones, mean quality to two places, a histogram of grades, the books met and the five weakest tags."""
    r = tables.reviews(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).join(tables.cards(spark, d).select("card_id", "book", "tag"), "card_id", "left")
    tags = r.where("tag is not null").groupBy("user_id", "day", "tag").agg(F.avg("quality").alias("q"))
    weakest = top_per_group(tags, ["user_id", "day"], [F.col("q"), F.col("tag")], 5).groupBy("user_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]), ",").alias("weakest_tags"))
    g = r.groupBy("user_id", "day").agg(
        F.count("*").alias("cards_reviewed"), F.count_if(F.col("quality") >= 3).alias("correct"), F.count_if(F.col("quality") < 3).alias("incorrect"), F.round(F.avg("quality") + 1e-9, 2).alias("avg_quality"),
        F.array_join(F.array_sort(F.collect_set("book")), ",").alias("books_touched"), *(F.count_if(F.col("quality") == q).alias(f"q{q}") for q in range(6)),
    )
    return g.join(weakest, ["user_id", "day"], "left").withColumn("weakest_tags", F.coalesce("weakest_tags", F.lit("")))


def make_quiz(spark, d):
    """Five cards of each topic word: those whose tag or prompt has it, in an order drawn from their ids."""
    c = covering(spark, d).withColumn("draw", F.md5(F.concat_ws("|", "name", F.col("card_id").cast("string"))))
    return top_per_group(c, ["name"], [F.col("draw"), F.col("card_id")], 5).select("name", "rank", "card_id")


def plan_blocks(spark, d):
    """A plan of 30 minutes for each book: how many cards due, weak ones and questions fit, at least one each, and the minutes they take."""
    c = tables.cards(spark, d).withColumn("due", F.col("due_date") <= F.lit(AS_OF).cast("date"))
    g = c.groupBy("book").agg(F.count_if("due").alias("due"), F.count_if(~F.col("due")).alias("rest"))
    part = lambda share, each: max(1, int(30 * 60 * share) // each)
    review, boost, quiz = F.least("due", F.lit(part(0.55, 35))), F.least("rest", F.lit(part(0.20, 35))), part(0.15, 60)
    minutes = lambda n, each: F.round(n * each / 60.0 + 1e-9, 1)
    return g.select("book", review.alias("review"), minutes(review, 35).alias("review_minutes"), boost.alias("boost"), minutes(boost, 35).alias("boost_minutes"), F.lit(quiz).alias("questions"), F.lit(float(quiz)).alias("question_minutes"))


def select_gap_cards(spark, d):
    """One card of each of the twenty concepts of widest gap, due ones first, then the least mastered; a concept takes its best card that no wider gap has as its best."""
    gap = covering(spark, d).groupBy("name").agg(F.round(1 - F.avg("mastery") + 1e-9, 6).alias("gap"))
    widest = gap.withColumn("place", F.row_number().over(Window.orderBy(F.desc("gap"), "name"))).where("place <= 20")  # a row a concept
    c = covering(spark, d).join(few(widest), "name").withColumn("due", F.col("due_date") <= F.lit(AS_OF).cast("date")).withColumn("m", F.round(F.col("mastery") + 1e-9, 6))
    best = top_per_group(c, ["name"], [F.desc("due"), F.col("m"), F.col("card_id")], 1, "k")
    return top_per_group(best, ["card_id"], [F.col("place")], 1, "k2").select("place", "name", "card_id")


def seed_gap_cards(spark, d):
    """Up to three concepts without a card: names that stand in no tag or prompt, from a list of wished ones."""
    wished = spark.createDataFrame([(k, n) for k, n in enumerate(["sorting", "widget", "graph theory", "bolt", "hashing", "economy", "recursion"])], "k int, name string")
    return wished.join(covering(spark, d).select("name").distinct(), "name", "left_anti").orderBy("k").limit(3).select("name", F.concat(F.lit("What is "), "name", F.lit("?")).alias("prompt"))


# Cards from chunks


_DEFINED = [r"\b([a-zA-Z][a-zA-Z0-9\s\-_]{2,40})\s+is\s+defined\s+as\s+(.+?)(?:\.|$)", r"\b([a-zA-Z][a-zA-Z0-9\s\-_]{2,40})\s+refers\s+to\s+(.+?)(?:\.|$)", r"\b([a-zA-Z][a-zA-Z0-9\s\-_]{2,40})\s+means\s+(.+?)(?:\.|$)"]


def extract_definitions_from_chunk(spark, d):
    """The first term and definition of each page and form of definition, wherever they stand in it."""
    def of(k, p):
        term, meaning = F.trim(F.regexp_extract("s", f"(?is){p}", 1)), F.substring(F.regexp_extract(F.trim(F.regexp_extract("s", f"(?is){p}", 2)), r"^[^\n]*", 0), 1, 300)
        return F.when((F.length(term).between(2, 50)) & (F.length(meaning) >= 5), F.struct(F.lit(k).alias("form"), term.alias("term"), meaning.alias("definition")))

    found = F.array_compact(F.array(*[of(k, p) for k, p in enumerate(_DEFINED)]))
    return tables.probe_pages(spark, d).select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def extract_text_lists(spark, d):
    """Bullets or numbered items of a page, whichever are more, if three or more: how many, and the first."""
    items = lambda p: F.filter(F.transform(F.regexp_extract_all("s", F.lit(p), 1), F.trim), lambda x: F.length(x) >= 2)
    dots, numbers = items(r"(?m)^[\s]*[-•*]\s+(.+)$"), items(r"(?m)^[\s]*(?:\d+[.)]\s+|[a-z][.)]\s+)(.+)$")
    found = tables.probe_pages(spark, d).select("doc_id", dots.alias("b"), numbers.alias("n")).select("doc_id", F.when(F.size("b") >= F.size("n"), F.col("b")).otherwise(F.col("n")).alias("i"))
    return found.where(F.size("i") >= 3).select("doc_id", F.size("i").alias("n_items"), F.element_at("i", 1).alias("first"))


def extract_declarative_sentence(spark, d):
    """The first statement of 40 to 200 characters of a page that keeps its full stop, which only the last piece does."""
    s = F.filter(F.transform(F.split("s", r"[.!?]\s+"), P.trimmed), lambda x: F.length(x).between(40, 200) & x.rlike("[.!?]$") & ~x.rlike("^(What|How|Why|When|Where|Which)"))
    return tables.probe_pages(spark, d).select("doc_id", F.try_element_at(s, F.lit(1)).alias("sentence")).where("sentence is not null")


def infer_chunk_topic(spark, d):
    """What a page is about: a heading in its first five lines, else its first word of four letters, else content."""
    lines = F.filter(F.transform(F.slice(F.split(P.trimmed(F.col("s")), "\n"), 1, 5), P.trimmed), lambda x: x.rlike(r"^#+\s+.+$|^[A-Z][^.!?]*$") & F.length(F.regexp_replace(x, r"^#+\s+", "")).between(3, 80))
    heading = F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"^#+\s+", "")
    return tables.probe_pages(spark, d).select("doc_id", F.coalesce(heading, F.nullif(F.lower(F.regexp_extract("s", "[a-zA-Z]{4,}", 0)), F.lit("")), F.lit("content")).alias("topic"))


def generate_question_answer(spark, d):
    """A card of each chunk from its most frequent long word, else a summary."""
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0), lambda x: ~x.isin("have been being will would could should might must shall need dare with from into through during before after above below were".split()))
    each = tables.chunks(spark, d).select("chunk_id", F.posexplode(w).alias("pos", "w")).groupBy("chunk_id", "w").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    best = each.groupBy("chunk_id").agg(F.max_by("w", F.struct("n", -F.col("pos"))).alias("w"))
    answer = F.concat(F.substring(F.trim("text"), 1, 400), F.when(F.length(F.trim("text")) > 400, "...").otherwise(""))
    rows = tables.chunks(spark, d).join(best, "chunk_id", "left")
    return rows.select("chunk_id", F.coalesce(F.concat(F.lit("Define key term: "), F.initcap("w")), F.lit("Summarize this chunk.")).alias("question"), F.md5(answer).alias("answer"))


def generate_cards_for_book(spark, d):
    """Cards of each book's first twenty chunks that have none yet; chunks whose id is that of a third card have one."""
    have = tables.cards(spark, d).where("card_id % 3 = 0").select(F.col("card_id").alias("chunk_id"))
    return top_per_group(tables.chunks(spark, d).join(have, "chunk_id", "left_anti").select("book", "chunk_id"), ["book"], [F.col("chunk_id")], 20)


def get_existing_chunk_ids(spark, d):
    return tables.cards(spark, d).select(F.col("card_id").alias("chunk_id")).distinct()


def extract_concept_terms(spark, d):
    """The distinct concept terms of each line in order: code tokens as they are, capitalised phrases, compounds and words of five letters or more in lower case."""
    s = F.col("s")
    code = F.regexp_extract_all(s, F.lit(r"\b(std::\w+|\w+<\w+>|\w+::\w+)"), 1)
    capital = F.regexp_extract_all(s, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[A-Z][a-z]{3,})\b"), 1)
    compound = F.filter(F.regexp_extract_all(s, F.lit(r"\b([a-zA-Z]+(?:[-_][a-zA-Z]+)+)\b"), 1), lambda x: F.length(x) >= 5)
    long = F.regexp_extract_all(s, F.lit(r"\b([a-zA-Z]{5,})\b"), 1)
    stop = T.CONTENT_STOPWORDS + ["which", "there", "these", "those", "where", "while", "their", "about"]
    named = lambda xs: F.filter(F.transform(xs, F.lower), lambda x: ~x.isin(stop))
    ascii_only = tables.probe_lines(spark, d).where(~s.rlike(r"[^\x00-\x7F]"))
    return ascii_only.select("doc_id", "pos", F.array_join(F.array_distinct(F.concat(code, named(capital), F.transform(compound, F.lower), named(long))), ",").alias("value"))


# Identifiers


def _uuid5(namespace: str, name: Column) -> Column:
    """The name-based identifier of RFC 9562, version 5: a SHA-1 digest with the version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: The fixed namespace of all identifiers and the salt that names the project's own.
NAMESPACE = uuid.uuid5(uuid.UUID("12345678-1234-5678-1234-567812345678"), "pdf_processor_v1").hex


def page_id(spark, d):
    c = tables.chunks(spark, d)
    name = F.concat(F.lit("page|book:"), T.squeeze(F.lower("book")), F.lit("|number:"), F.col("page_start").cast("string"))
    return c.select("chunk_id", _uuid5(NAMESPACE, name).alias("value"))


def make_question_id(spark, d):
    c = tables.table(spark, d, "conversations")
    return c.groupBy("conv_id", "turn").agg(F.min(F.substring(F.sha2(F.lower(F.trim("text")), 256), 1, 16)).alias("value"))


def make_structure_card_id(spark, d):
    c = tables.cards(spark, d)
    return c.select("card_id", F.substring(F.sha2(F.concat_ws("|", F.lit("definition"), F.lower(F.trim("prompt")), F.col("card_id").cast("string"), F.lower(F.trim("tag"))), 256), 1, 16).alias("value"))


def family_key(spark, d):
    """Files of one family: names in lower case without extension, spaces as one."""
    p = tables.table(spark, d, "part").select("p_partkey", F.concat(F.initcap("p_name"), F.lit("  v.pdf")).alias("file"))
    return p.select("p_partkey", T.squeeze(F.regexp_replace(F.lower("file"), r"\.[^.]*$", "")).alias("value"))


def normalize_chunk_id(spark, d):
    """A chunk's own id, or one made of its book, chapter, section and index where it has none."""
    c = tables.chunks(spark, d)
    made = F.concat("book", F.lit("|ch"), F.col("chapter").cast("string"), F.lit("|sec"), "section", F.lit("|i0"))
    return c.select("chunk_id", F.when(F.col("chunk_id") % 2 == 0, F.col("chunk_id").cast("string")).otherwise(made).alias("value"))


def section_keys(spark, d):
    """Book and section of a card, without what is missing."""
    return tables.cards(spark, d).select("card_id", F.concat_ws(", ", "book", F.when(F.col("card_id") % 3 != 0, F.concat(F.lit("§"), "tag"))).alias("value"))


def embed(spark, d):
    """A unit vector of eight numbers for each line, drawn from digests of its text; the stand-in for a model."""
    h = F.unhex(F.sha2(F.encode("s", "UTF-8"), 256))

    def part(k):
        raw = F.unhex(F.md5(F.concat(h, F.unhex(F.lit(k.to_bytes(4, "little").hex())))))
        unsigned = F.conv(F.concat(*[F.hex(F.substring(raw, n, 1)) for n in (4, 3, 2, 1)]), 16, 10).cast("long")
        return F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned) / float(2**31)

    rows = tables.probe_lines(spark, d).select("doc_id", "pos", F.array(*map(part, range(8))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("doc_id", "pos", F.array_join(F.transform("v", lambda x: F.round(x / norm * 1e6).cast("long").cast("string")), ",").alias("value"))


# The library


def filter_by_topic(spark, d):
    return tables.cards(spark, d).where(F.array_contains(F.split("prompt", " "), "widget")).select("card_id")


def filter_by_source(spark, d):
    return tables.cards(spark, d).where("book = 'Brand#5'").select("card_id")


def validate_pack(spark, d):
    """What is wrong with each pack: fields that are empty, a licence that isn't allowed, a size out of range."""
    p = tables.table(spark, d, "part")
    licence = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'CC-BY-4.0' WHEN 1 THEN 'MIT' WHEN 2 THEN '' ELSE 'proprietary' END")
    rules = [F.when(F.trim("p_name") == "", "name"), F.when(licence == "", "no licence"), F.when((licence != "") & ~licence.isin("CC-BY-4.0", "MIT", "CC0-1.0"), "licence"), F.when(F.col("p_size") > 40, "size")]
    return p.select("p_partkey", F.array_join(F.array_compact(F.array(*rules)), ",").alias("issues"))


def verify_library(spark, d):
    """Books of the library without chunks, and chunks' books that it doesn't list."""
    books = tables.table(spark, d, "documents").select(F.col("source").alias("book")).distinct().withColumn("listed", F.regexp_extract("book", r"\d+", 0).cast("int") % 5 != 0)
    lib = books.where("listed").select("book").union(spark.createDataFrame([("gone",)], "book string"))
    have = tables.chunks(spark, d).groupBy("book").agg(F.count("*").alias("n"))
    both = lib.withColumn("known", F.lit(True)).join(have, "book", "full_outer")
    return both.select("book", F.when(F.col("n").isNull(), "no chunks").when(F.col("known").isNull(), "not listed").otherwise("ok").alias("status"))


def get_status_from_library(spark, d):
    c = tables.chunks(spark, d).groupBy("book").agg(F.count("*").alias("n"))
    ready = F.regexp_extract("book", r"\d+", 0).cast("int") % 3 != 0
    return c.agg(F.count_if(ready).alias("ready"), F.count_if(~ready).alias("waiting"), F.sum(F.when(ready, F.col("n")).otherwise(0)).alias("chunks"))


def select_candidate_books(spark, d):
    """The books whose name holds any word of a question, all of them where none does."""
    q = tables.table(spark, d, "nation").select("n_nationkey", F.concat(F.lower("n_name"), F.lit(" src"), (F.col("n_nationkey") % 4).cast("string"), F.lit(" x?")).alias("question"))
    asked = q.select("n_nationkey", F.filter(F.regexp_extract_all(F.when(F.col("n_nationkey") % 2 == 0, F.col("question")).otherwise(F.lit("zzz")), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) > 1).alias("w"))
    books = tables.chunks(spark, d).select(F.col("book")).distinct()
    pairs = books.join(few(asked), F.exists("w", lambda x: F.contains(F.lower("book"), x)))
    some = pairs.select("n_nationkey", "book")
    rest = asked.join(some.select("n_nationkey").distinct(), "n_nationkey", "left_anti").crossJoin(few(books)).select("n_nationkey", "book")
    return some.union(rest).groupBy("n_nationkey").agg(F.count("*").alias("n"), F.min("book").alias("first"))


def get_user_books(spark, d):
    """Each book with its cards and those that are due."""
    books = tables.table(spark, d, "part").select(F.col("p_brand").alias("book")).distinct()
    c = tables.cards(spark, d).where("card_id % 7 <> 0").groupBy("book").agg(F.count("*").alias("cards"), F.count_if(F.col("due_date") <= F.lit(AS_OF).cast("date")).alias("due"))
    return books.join(c, "book", "left").na.fill(0, ["cards", "due"])


def get_book_metadata_map(spark, d):
    """Chunks with their book's title and number of chunks."""
    c = tables.chunks(spark, d)
    meta = c.groupBy("book").agg(F.count("*").alias("n"), F.initcap(F.first("book")).alias("title"))
    return c.join(few(meta), "book").select("chunk_id", "title", "n")


def resolve_scope_to_page_ranges(spark, d):
    """The page ranges of chosen chapters, in order of pages."""
    chosen = outline(tables.chunks(spark, d)).where("id in ('ch_2', 'ch_5', 'ch_9')")
    return chosen.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda r: F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string"))), ",").alias("ranges"))


def build_scope_label(spark, d):
    """The first three chosen chapters' titles, and how many more there are."""
    items = outline(tables.chunks(spark, d)).where("level = 1 and cast(substring(id, 4) as int) % 2 = 1")
    g = items.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("lo", "title"))), lambda x: x["title"]).alias("t"))
    return g.select("book", F.concat(F.array_join(F.slice("t", 1, 3), ", "), F.when(F.size("t") > 3, F.concat(F.lit(" (+"), (F.size("t") - 3).cast("string"), F.lit(" more)"))).otherwise("")).alias("label"))


def extract_section_text(spark, d):
    """The pages of each section of a book joined by blank lines: how many there are, and a digest. A section's pages are those of one language."""
    c = tables.chunks(spark, d)
    joined = c.groupBy("book", "chapter", "section").agg(F.array_sort(F.collect_list(F.struct("page_start", "chunk_id", "text"))).alias("p"))
    return joined.select("book", "chapter", "section", F.size("p").alias("pages"), F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).alias("digest"))


def autofill_chapters(spark, d):
    """Records with the chapter that begins last on or before their page."""
    c = tables.chunks(spark, d)
    starts = c.groupBy("book", "chapter").agg(F.min("page_start").alias("at"))
    return as_of_join(c.select("book", "chunk_id", F.col("page_end").alias("page")), starts, ["book"], "page", "at", "chapter").select("chunk_id", "chapter")


def ingest_incremental(spark, d):
    """Documents whose text no earlier document of their source has, and the last of each source's family."""
    docs = tables.table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("source", "digest").agg(F.min("doc_id").alias("first"))
    new = docs.join(first, ["source", "digest"]).where("doc_id = first")
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    return new.withColumn("superseded_by", F.lead("doc_id").over(w)).select("doc_id", "superseded_by")


def suggested_distribution(spark, d):
    """For totals of 1 to 40 questions a mix with few reasons: raw shares, scaled down to the total if they pass it."""
    t = F.col("total")
    at_least = lambda n, k: F.greatest(F.lit(n), F.floor(t / k).cast("int"))
    raw = {"definition": at_least(6, 3), "fib": at_least(3, 5), "tf": at_least(3, 5), "short": at_least(1, 10), "list": at_least(4, 4)}
    total = sum(raw.values(), F.lit(0))
    scaled = {k: F.when(total > t, F.greatest(F.lit(1), F.floor(v * (t / total)).cast("int"))).otherwise(v) for k, v in raw.items()}
    scaled["definition"] = scaled["definition"] + F.when(total > t, t - sum(scaled.values(), F.lit(0))).otherwise(0)
    return spark.range(1, 41).select(F.col("id").cast("int").alias("total")).select("total", *[v.cast("int").alias(k) for k, v in scaled.items()])


def generate_plan_from_features(spark, d):
    """Each source's ten most frequent first words as modules, in order."""
    w = F.lower(F.regexp_extract("text", "[A-Za-z]{3,}", 0))
    n = tables.table(spark, d, "documents").select("source", w.alias("topic")).where("topic <> ''").groupBy("source", "topic").agg(F.count("*").alias("n"))
    return top_per_group(n, ["source"], [F.desc("n"), F.col("topic")], 10, "order").select("source", "order", "topic", F.concat(F.lit("mod-"), (F.col("order") - 1).cast("string")).alias("id"))


def match_questionbank(spark, d):
    """The banked question nearest to each user turn by shared words, if they share three tenths: turns of other conversations are the bank of the first turns."""
    c = tables.table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).withColumn("w", F.filter(T.simple_tokens(F.col("text")), lambda x: F.length(x) > 2))
    asked, bank = c.where("conv_id % 10 = 0"), c.where("conv_id % 10 <> 0")
    terms = lambda df, name: df.select(F.col("conv_id").alias(name), F.size("w").alias(f"n_{name}"), F.explode("w").alias("term"))
    met = terms(asked, "q").join(terms(bank, "b"), "term").groupBy("q", "b", "n_q", "n_b").agg(F.count("*").alias("n"))
    score = F.round(F.col("n") / F.sqrt(F.col("n_q").cast("double") * F.col("n_b")) + 1e-9, 6)
    return top_per_group(met.withColumn("score", score).where("score >= 0.3"), ["q"], [F.desc("score"), F.col("b")], 1).select("q", "b", "score")


QUERIES = {f.__name__: f for f in (
    cards_for_concept, concept_mastery_from_cards, guess_target_concept, compute_concept_difficulty, hardest_concepts, compute_remediation_effectiveness, compute_book_quality, add_concept, link_concept_cooccurrence, log_session,
    make_quiz, plan_blocks, select_gap_cards, seed_gap_cards, extract_definitions_from_chunk, extract_text_lists, extract_declarative_sentence, infer_chunk_topic, generate_question_answer, generate_cards_for_book,
    get_existing_chunk_ids, extract_concept_terms, page_id, make_question_id, make_structure_card_id, family_key, normalize_chunk_id, section_keys, embed, filter_by_topic, filter_by_source, validate_pack, verify_library,
    get_status_from_library, select_candidate_books, get_user_books, get_book_metadata_map, resolve_scope_to_page_ranges, build_scope_label, extract_section_text, autofill_chapters, ingest_incremental,
    suggested_distribution, generate_plan_from_features, match_questionbank,
)}

from .pages import ALL_PAGES  # noqa: E402
from .prose import LINES as PROBED, strip  # noqa: E402

COVER = f"""{CARDS}, names AS (SELECT DISTINCT unnest(list_concat(string_split(lower(p_name), ' '), [lower(p_type)])) AS name FROM part), cv AS (SELECT c.*, name, {MASTERY} AS mastery FROM c JOIN names ON name <> '' AND (contains(lower(tag), name) OR contains(name, lower(tag)) OR contains(lower(prompt), name)))"""
HARD = f"""{COVER}, rv AS ({REVIEWS.removeprefix('WITH r AS (')[:-1]}), se AS (SELECT user_id, ts::DATE AS day, card_id, quality FROM rv), us AS (SELECT name, count(DISTINCT (user_id, day)) AS used FROM se JOIN cv USING (card_id) WHERE quality < 3 GROUP BY name),
 g AS (SELECT name, count(*) AS n_cards, avg((lapses > 0)::INT) AS failed, avg(lapses) AS lapses, coalesce(avg(date_diff('day', DATE '2024-01-01', last_reviewed)) FILTER (interval_days >= 7 AND last_reviewed IS NOT NULL), -1.0) AS days FROM cv GROUP BY name),
 cd AS (SELECT name, n_cards, round(failed + 1e-9, 3) AS failure_rate, round(lapses + 1e-9, 3) AS avg_lapses, round(coalesce(used, 0) / (SELECT count(DISTINCT (user_id, day)) FROM se) + 1e-9, 3) AS trigger_rate, round(days + 1e-9, 1) AS days_to_mastery,
   round(0.4::DOUBLE * failed + 0.3::DOUBLE * least(1.0::DOUBLE, lapses / 5) + 0.3::DOUBLE * CASE WHEN days > 0 THEN least(1.0::DOUBLE, days / 30) WHEN days < 0 THEN 0.5 ELSE 0 END + 1e-9, 3) AS difficulty FROM g LEFT JOIN us USING (name))"""
_h = lambda name: f"sha1(unhex('{NAMESPACE}') || encode({name}))"
_forms = [("is" + chr(92) + "s+defined" + chr(92) + "s+as"), ("refers" + chr(92) + "s+to"), "means"]
_def = lambda f, g: rf"regexp_extract(s, '(?is)\b([a-zA-Z][a-zA-Z0-9\s\-_]{{2,40}})\s+{f}\s+(.+?)(?:\.|$)', {g})"
_outline = OUTLINE
ORACLE_SQL = {
    "cards_for_concept": f"{COVER} SELECT name, count(*) AS n_cards, min(card_id) AS first FROM cv GROUP BY name",
    "concept_mastery_from_cards": f"{COVER} SELECT n.name, round(coalesce(avg(mastery), 0) + 1e-9, 6) AS mastery FROM names n LEFT JOIN cv ON cv.name = n.name WHERE n.name <> '' GROUP BY n.name",
    "guess_target_concept": f"{COVER}, a AS (SELECT card_id, unnest(list_concat([lower(tag)], regexp_extract_all(lower(prompt), '[a-z]{{4,}}'))) AS name, unnest(range(1 + len(regexp_extract_all(lower(prompt), '[a-z]{{4,}}')))) AS pos FROM c) SELECT card_id, arg_min(name, pos) AS concept FROM a WHERE length(name) > 3 AND name IN (SELECT name FROM names) GROUP BY card_id",
    "compute_concept_difficulty": f"{HARD} SELECT * FROM cd",
    "hardest_concepts": f"{HARD} SELECT name, difficulty FROM cd ORDER BY difficulty DESC, name LIMIT 5",
    "compute_remediation_effectiveness": f"{REVIEWS}, s AS (SELECT avg(quality) AS q, count(*) FILTER (quality < 3) > 1 AS helped FROM r GROUP BY user_id, ts::DATE) SELECT count(*) AS sessions, count(*) FILTER (helped) AS helped, round(coalesce(avg(q) FILTER (helped), 0) + 1e-9, 3) AS quality_with, round(coalesce(avg(q) FILTER (NOT helped), 0) + 1e-9, 3) AS quality_without, round(coalesce(avg((q > (SELECT avg(q) FROM s))::INT) FILTER (helped), 0) + 1e-9, 3) AS uplift, round(coalesce(avg(q) FILTER (helped) - avg(q) FILTER (NOT helped), 0) + 1e-9, 3) AS delta FROM s",
    "compute_book_quality": None,
    "add_concept": "WITH p AS (SELECT unnest(string_split(p_name, ' ')) AS name, p_brand, p_type FROM part) SELECT name, count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS books, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS sections FROM p GROUP BY name",
    "link_concept_cooccurrence": "WITH p AS (SELECT list_distinct(string_split(p_name, ' ')) AS w FROM part), x AS (SELECT unnest(w) AS a, w FROM p), y AS (SELECT a, unnest(w) AS b FROM x) SELECT a, b, count(*) AS n FROM y WHERE a <> b GROUP BY ALL",
    "log_session": f"""{REVIEWS}, {CARDS.removeprefix('WITH ')}, x AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, quality, book, tag FROM r LEFT JOIN c USING (card_id)), t AS (SELECT user_id, day, tag, avg(quality) AS q FROM x WHERE tag IS NOT NULL GROUP BY ALL),
        k AS (SELECT user_id, day, string_agg(tag, ',' ORDER BY q, tag) AS weakest_tags FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY q, tag) <= 5) GROUP BY ALL),
        g AS (SELECT user_id, day, count(*) AS cards_reviewed, count(*) FILTER (quality >= 3) AS correct, count(*) FILTER (quality < 3) AS incorrect, round(avg(quality) + 1e-9, 2) AS avg_quality, array_to_string(list_sort(list(DISTINCT book) FILTER (book IS NOT NULL)), ',') AS books_touched, {', '.join(f'count(*) FILTER (quality = {q}) AS q{q}' for q in range(6))} FROM x GROUP BY ALL)
        SELECT g.* REPLACE (coalesce(books_touched, '') AS books_touched), coalesce(weakest_tags, '') AS weakest_tags FROM g LEFT JOIN k USING (user_id, day)""",
    "make_quiz": f"{COVER} SELECT name, row_number() OVER (PARTITION BY name ORDER BY md5(name || '|' || card_id), card_id) AS rank, card_id FROM cv QUALIFY rank <= 5",
    "plan_blocks": f"{CARDS}, g AS (SELECT book, count(*) FILTER (due_date <= DATE '{AS_OF}') AS due, count(*) FILTER (NOT due_date <= DATE '{AS_OF}') AS rest FROM c GROUP BY book) SELECT book, least(due, 28) AS review, round(least(due, 28) * 35 / 60.0 + 1e-9, 1) AS review_minutes, least(rest, 10) AS boost, round(least(rest, 10) * 35 / 60.0 + 1e-9, 1) AS boost_minutes, 4 AS questions, 4.0 AS question_minutes FROM g",
    "select_gap_cards": f"{COVER}, g AS (SELECT name, round(1 - avg(mastery) + 1e-9, 6) AS gap FROM cv GROUP BY name), w AS (SELECT *, row_number() OVER (ORDER BY gap DESC, name) AS place FROM g QUALIFY place <= 20), b AS (SELECT cv.*, place FROM cv JOIN w USING (name) QUALIFY row_number() OVER (PARTITION BY name ORDER BY due_date <= DATE '{AS_OF}' DESC, round(mastery + 1e-9, 6), card_id) = 1) SELECT place, name, card_id FROM b QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY place) = 1",
    "seed_gap_cards": f"{COVER} SELECT name, 'What is ' || name || '?' AS prompt FROM (SELECT unnest(['sorting', 'widget', 'graph theory', 'bolt', 'hashing', 'economy', 'recursion']) AS name, unnest(range(7)) AS k) WHERE name NOT IN (SELECT name FROM cv) ORDER BY k LIMIT 3",
    "extract_definitions_from_chunk": f"{ALL_PAGES}, f AS ({' UNION ALL '.join(f'SELECT doc_id, {k} AS form, trim({_def(f, 1)}) AS term, regexp_extract(trim({_def(f, 2)}), {chr(39)}^[^{chr(92)}n]*{chr(39)})[1:300] AS definition FROM b' for k, f in enumerate(_forms))}) SELECT * FROM f WHERE length(term) BETWEEN 2 AND 50 AND length(definition) >= 5",
    "extract_text_lists": rf"{ALL_PAGES}, i AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(s, '(?m)^[\s]*[-•*]\s+(.+)$', 1), lambda x: trim(x)), lambda x: length(x) >= 2) AS d, list_filter(list_transform(regexp_extract_all(s, '(?m)^[\s]*(?:[0-9]+[.)]\s+|[a-z][.)]\s+)(.+)$', 1), lambda x: trim(x)), lambda x: length(x) >= 2) AS n FROM b), j AS (SELECT doc_id, CASE WHEN len(d) >= len(n) THEN d ELSE n END AS i FROM i) SELECT doc_id, len(i) AS n_items, i[1] AS first FROM j WHERE len(i) >= 3",
    "extract_declarative_sentence": rf"{ALL_PAGES}, f AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(s, '[.!?]\s+'), lambda x: {strip('x')}), lambda x: length(x) BETWEEN 40 AND 200 AND regexp_matches(x, '[.!?]$') AND NOT regexp_matches(x, '^(What|How|Why|When|Where|Which)'))[1] AS sentence FROM b) SELECT * FROM f WHERE sentence IS NOT NULL",
    "infer_chunk_topic": rf"{ALL_PAGES} SELECT doc_id, coalesce(regexp_replace(list_filter(list_transform(string_split({strip('s')}, chr(10))[1:5], lambda x: {strip('x')}), lambda x: regexp_matches(x, '^#+\s+.+$|^[A-Z][^.!?]*$') AND length(regexp_replace(x, '^#+\s+', '')) BETWEEN 3 AND 80)[1], '^#+\s+', ''), nullif(lower(regexp_extract(s, '[a-zA-Z]{{4,}}')), ''), 'content') AS topic FROM b",
    "generate_question_answer": rf"{CHUNKS}, w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(s), '[a-z]{{4,}}'), lambda x: NOT list_contains(string_split('have been being will would could should might must shall need dare with from into through during before after above below were', ' '), x)) AS w FROM l), e AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM w), n AS (SELECT doc_id, w, count(*) AS n, min(pos) AS pos FROM e GROUP BY ALL), k AS (SELECT doc_id, arg_max(w, (n, -pos)) AS w FROM n GROUP BY doc_id) SELECT doc_id AS chunk_id, coalesce('Define key term: ' || upper(w[1]) || w[2:], 'Summarize this chunk.') AS question, md5(trim(s)[1:400] || CASE WHEN length(trim(s)) > 400 THEN '...' ELSE '' END) AS answer FROM l LEFT JOIN k USING (doc_id)",
    "generate_cards_for_book": f"{CHUNKS} SELECT book, doc_id AS chunk_id, row_number() OVER (PARTITION BY book ORDER BY doc_id) AS rank FROM l WHERE doc_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) QUALIFY rank <= 20",
    "get_existing_chunk_ids": "SELECT DISTINCT p_partkey AS chunk_id FROM part",
    "extract_concept_terms": rf"{PROBED}, x AS (SELECT doc_id, pos, list_concat(list_concat(regexp_extract_all(s, '\b(std::\w+|\w+<\w+>|\w+::\w+)', 1), list_filter(list_transform(regexp_extract_all(s, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[A-Z][a-z]{{3,}})\b', 1), lambda y: lower(y)), lambda y: NOT list_contains(st, y))), list_concat(list_transform(list_filter(regexp_extract_all(s, '\b([a-zA-Z]+(?:[-_][a-zA-Z]+)+)\b', 1), lambda y: length(y) >= 5), lambda y: lower(y)), list_filter(list_transform(regexp_extract_all(s, '\b([a-zA-Z]{{5,}})\b', 1), lambda y: lower(y)), lambda y: NOT list_contains(st, y)))) AS v FROM l, (SELECT string_split('{' '.join(T.CONTENT_STOPWORDS)} which there these those where while their about', ' ') AS st) WHERE NOT regexp_matches(s, '[^\x00-\x7F]')) SELECT doc_id, pos, array_to_string(list_filter(v, lambda y, i: list_position(v, y) = i), ',') AS value FROM x",
    "page_id": f"{CHUNKS}, h AS (SELECT doc_id, {_h(chr(39) + 'page|book:' + chr(39) + ' || lower(book) || ' + chr(39) + '|number:' + chr(39) + ' || page_start')} AS h FROM l) SELECT doc_id AS chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || 'ab89'[(('0x' || h[17])::INT + 2) % 4 + 1] || h[18:20] || '-' || h[21:32] AS value FROM h",
    "make_question_id": "SELECT conv_id, turn, min(substr(sha256(lower(trim(text))), 1, 16)) AS value FROM conversations GROUP BY ALL",
    "make_structure_card_id": f"{CARDS} SELECT card_id, substr(sha256('definition|' || lower(trim(prompt)) || '|' || card_id || '|' || lower(trim(tag))), 1, 16) AS value FROM c",
    "family_key": "SELECT p_partkey, lower(p_name) || ' v' AS value FROM part",
    "normalize_chunk_id": f"{CHUNKS} SELECT doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE book || '|ch' || chapter || '|sec' || section || '|i0' END AS value FROM l",
    "section_keys": f"{CARDS} SELECT card_id, book || CASE WHEN card_id % 3 <> 0 THEN ', §' || tag ELSE '' END AS value FROM c",
    "filter_by_topic": f"{CARDS} SELECT card_id FROM c WHERE list_contains(string_split(prompt, ' '), 'widget')",
    "filter_by_source": f"{CARDS} SELECT card_id FROM c WHERE book = 'Brand#5'",
    "validate_pack": "SELECT p_partkey, concat_ws(',', CASE WHEN trim(p_name) = '' THEN 'name' END, CASE WHEN p_partkey % 4 = 2 THEN 'no licence' END, CASE WHEN p_partkey % 4 = 3 THEN 'licence' END, CASE WHEN p_size > 40 THEN 'size' END) AS issues FROM part",
    "verify_library": "WITH b AS (SELECT DISTINCT source AS book FROM documents) SELECT book, CASE WHEN regexp_extract(book, '[0-9]+')::INT % 5 = 0 THEN 'not listed' ELSE 'ok' END AS status FROM b UNION ALL SELECT 'gone', 'no chunks'",
    "get_status_from_library": "WITH b AS (SELECT source, regexp_extract(source, '[0-9]+')::INT % 3 <> 0 AS ready, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) FILTER (ready) AS ready, count(*) FILTER (NOT ready) AS waiting, coalesce(sum(n) FILTER (ready), 0) AS chunks FROM b",
    "select_candidate_books": "WITH q AS (SELECT n_nationkey, list_filter(regexp_extract_all(CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) || ' src' || n_nationkey % 4 || ' x?' ELSE 'zzz' END, '[a-z0-9]+'), lambda w: length(w) > 1) AS w FROM nation), b AS (SELECT DISTINCT source AS book FROM documents), p AS (SELECT n_nationkey, book, len(list_filter(w, lambda x: contains(lower(book), x))) > 0 AS hit FROM q, b), a AS (SELECT *, bool_or(hit) OVER (PARTITION BY n_nationkey) AS any_hit FROM p) SELECT n_nationkey, count(*) AS n, min(book) AS first FROM a WHERE hit OR NOT any_hit GROUP BY n_nationkey",
    "get_user_books": f"{CARDS} SELECT book, count(*) FILTER (card_id % 7 <> 0) AS cards, count(*) FILTER (card_id % 7 <> 0 AND due_date <= DATE '{AS_OF}') AS due FROM c GROUP BY book",
    "get_book_metadata_map": f"{CHUNKS} SELECT doc_id AS chunk_id, upper(book[1]) || book[2:] AS title, count(*) OVER (PARTITION BY book) AS n FROM l",
    "resolve_scope_to_page_ranges": f"{_outline} SELECT book, string_agg(lo || '-' || hi, ',' ORDER BY lo, hi) AS ranges FROM o WHERE id IN ('ch_2', 'ch_5', 'ch_9') GROUP BY book",
    "build_scope_label": f"{_outline}, t AS (SELECT book, list(title ORDER BY lo, title) AS t FROM o WHERE level = 1 AND id[4:]::INT % 2 = 1 GROUP BY book) SELECT book, array_to_string(t[1:3], ', ') || CASE WHEN len(t) > 3 THEN ' (+' || len(t) - 3 || ' more)' ELSE '' END AS label FROM t",
    "extract_section_text": f"{CHUNKS} SELECT book, chapter, section, count(*) AS pages, md5(string_agg(s, chr(10) || chr(10) ORDER BY page_start, doc_id)) AS digest FROM l GROUP BY ALL",
    "autofill_chapters": f"{CHUNKS}, s AS (SELECT book, chapter, min(page_start) AS first FROM l GROUP BY ALL), o AS (SELECT book, first, max(chapter) AS chapter FROM s GROUP BY ALL) SELECT l.doc_id AS chunk_id, o.chapter FROM l ASOF LEFT JOIN o ON l.book = o.book AND l.page_end >= o.first",
    "ingest_incremental": "WITH n AS (SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1) SELECT doc_id, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS superseded_by FROM n",
    "generate_plan_from_features": "WITH n AS (SELECT source, lower(regexp_extract(text, '[A-Za-z]{3,}')) AS topic, count(*) AS n FROM documents GROUP BY ALL) SELECT source, row_number() OVER (PARTITION BY source ORDER BY n DESC, topic) AS \"order\", topic, 'mod-' || (row_number() OVER (PARTITION BY source ORDER BY n DESC, topic) - 1) AS id FROM n WHERE topic <> '' QUALIFY \"order\" <= 10",
    "match_questionbank": "WITH c AS (SELECT conv_id, list_filter(list_distinct(regexp_extract_all(lower(arg_min(text, turn)), '[a-z0-9_]+')), lambda x: length(x) > 2) AS w FROM conversations WHERE role = 'user' GROUP BY conv_id), p AS (SELECT a.conv_id AS q, b.conv_id AS b, round(len(list_intersect(a.w, b.w)) / sqrt(len(a.w)::DOUBLE * len(b.w)) + 1e-9, 6) AS score FROM c a, c b WHERE a.conv_id % 10 = 0 AND b.conv_id % 10 <> 0) SELECT * FROM p WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, b) = 1",
    "suggested_distribution": "WITH t AS (SELECT x::INT AS total, greatest(6, x // 3) AS d, greatest(3, x // 5) AS f, greatest(1, x // 10) AS s, greatest(4, x // 4) AS l FROM range(1, 41) r(x)), u AS (SELECT *, d + 2 * f + s + l AS raw FROM t), v AS (SELECT total, raw, raw > total AS over, CASE WHEN raw > total THEN greatest(1, floor(d * (total / raw))) ELSE d END AS d, CASE WHEN raw > total THEN greatest(1, floor(f * (total / raw))) ELSE f END AS f, CASE WHEN raw > total THEN greatest(1, floor(s * (total / raw))) ELSE s END AS s, CASE WHEN raw > total THEN greatest(1, floor(l * (total / raw))) ELSE l END AS l FROM u) SELECT total, (d + CASE WHEN over THEN total - (d + 2 * f + s + l) ELSE 0 END)::INT AS definition, f::INT AS fib, f::INT AS tf, s::INT AS short, l::INT AS list FROM v",
}
_term = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, w * (1 + 0.3::DOUBLE * red) * CASE WHEN con THEN 0.5::DOUBLE ELSE 1.0 END))"
ORACLE_SQL["compute_book_quality"] = f"{REVIEWS}, {CARDS.removeprefix('WITH ')}, q AS (SELECT book, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.3 END::DOUBLE AS w, (event_id % 11) / 10 AS red, event_id % 3 = 0 AS con FROM r JOIN c USING (card_id)) SELECT book, count(*) AS questions, round(avg({_term}) + 1e-9, 3) AS terminality, round(avg(con::INT) + 1e-9, 3) AS contradictions, round(avg(w) + 1e-9, 3) AS confidence FROM q GROUP BY book"
