"""What a page line announces: chapters, sections, exercises and other special pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that announce a chapter, a section, exercises, and special pages in order of precedence.
CHAPTER = [
    r"^Chapter\s+(\d+)\s*[:\-–—]\s*(.+?)$",
    r"^Chapter\s+(\d+)\s*$",
    r"^Chapter\s+(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve)\s*[:\-–—]\s*(.+?)$",
    r"^Ch\.?\s+(\d+)\s*[:\-–—]\s*(.+?)$",
]
SECTION = [
    r"^((?:\d+\.)+\d+)\s+(.+?)$",
    r"^((?:\d+\.)+\d+)\.\s+(.+?)$",
    r"^Section\s+((?:\d+\.)+\d+)\s*[:\-–—]\s*(.+?)$",
    r"^§\s*((?:\d+\.)+\d+)\s+(.+?)$",
    r"^([A-Z])\.\s+([A-Z][^.]{5,})$",
]
EXERCISES = [
    r"Chapter\s+\d+\s+Practice\s+(Exercises|Problems|Questions)",
    r"Practice\s+(Exercises|Problems|Questions)",
    r"^(Exercises|Problems|Questions)\s*$",
    r"End\s+of\s+Chapter\s+(Exercises|Problems|Questions)",
    r"Review\s+(Questions|Problems|Exercises)",
    r"Self[- ]Test\s+(Questions|Problems|Exercises)",
    r"Homework\s+(Problems|Questions|Exercises)",
]
SPECIAL = {
    "practice": [r"Chapter\s+\d+\s+Practice\s+Exercises?", r"Practice\s+Problems?", r"Chapter\s+Exercises?", r"Exercises?\s*$", r"Problems?\s*$"],
    "solutions": [r"Chapter\s+\d+\s+Exercise\s+Solutions?", r"Solutions?\s+to\s+Exercises?", r"Answer\s+Key"],
    "summary": [r"Chapter\s+\d+\s+Summary", r"Chapter\s+Review"],
    "review": [r"Chapter\s+\d+\s+Review", r"Review\s+Questions?"],
}

ANSWERS = [
    r"Chapter\s+\d+\s+(Exercise\s+)?Solutions",
    r"^(Solutions|Answers)\s*$",
    r"Solutions?\s+to\s+(Exercises|Problems|Questions)",
    r"Answer\s+Key",
    r"Selected\s+(Answers|Solutions)",
]
CONTENTS_LINE = [r"Chapter\s+(\d+)[:\-\s]*([^.]*?)\.+\s*(\d+)", r"^(\d+)[.\s]+([A-Z][^.]*?)\.+\s*(\d+)", r"^(\d+)\s+([A-Z][^0-9]*?)\s+(\d+)$"]
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
PRACTICE_PHRASES = [
    "practice exercises", "practice problems", "practice questions", "review questions", "review problems", "review exercises",
    "self-test questions", "self-test problems", "homework problems", "homework questions", "homework exercises", "end of chapter exercises",
    "chapter exercises", "suggested exercises", "study questions", "discussion questions", "comprehension questions", "conceptual questions",
    "worked examples", "exercises", "problems",
]
FRONT_PHRASES = [
    "preface", "acknowledgments", "acknowledgements", "copyright", "isbn", "all rights reserved", "published by", "foreword",
    "about the author", "about the authors", "dedication",
]
DOT_LEADER = r"(?:\.\s*){3,}.*\b\d+\s*$"


def either(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def announces(s: Column, patterns: list[str]) -> Column:
    return F.coalesce(s, F.lit("")).rlike(either(patterns))


def special_page(s: Column) -> Column:
    """struct(type, title) of the first kind of special page that a page's first twenty lines announce, and what they hold of it; null if none."""
    head = F.array_join(F.slice(F.split(F.coalesce(s, F.lit("")), "\n"), 1, 20), "\n")
    each = [F.when(head.rlike(f"(?im){p}"), F.struct(F.lit(kind).alias("type"), F.regexp_extract(head, f"(?im){p}", 0).alias("title"))) for kind, patterns in SPECIAL.items() for p in patterns]
    return F.coalesce(*each)


def _first_line(s: Column, found) -> Column:
    """found(line, next line, its place) of a page's first fifteen lines, where it first isn't null."""
    lines = F.transform(F.slice(F.split(F.coalesce(s, F.lit("")), "\n"), 1, 15), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.element_at(
        F.transform(F.array(lines), lambda held: F.try_element_at(F.filter(F.transform(held, lambda x, i: found(x, F.coalesce(F.try_element_at(held, i + 2), F.lit("")))), lambda x: x.isNotNull()), F.lit(1))), 1
    )


def chapter_start(s: Column) -> Column:
    """struct(number, title) of the first line that is a chapter heading as a whole; the title is the next line, unless it numbers a section."""
    heading = r"(?i)^Chapter\s+(\d+)(?:[.:]\s+.+)?$"
    return _first_line(
        s,
        lambda x, after: F.when(x.rlike(heading), F.struct(F.regexp_extract(x, heading, 1).try_cast("int").alias("number"), F.when((after != "") & ~after.rlike(r"^\d+\.\d+"), after).alias("title"))),
    )


def section_start(s: Column, levels: int = 2) -> Column:
    """struct(number, title, depth) of the first line that numbers a section; its title stands after it or on the next line.

    A heading whose title is only a number, Chapter or Page is passed over.
    """
    heading = r"^(\d+\.\d+(?:\.\d+)?)(?:\s+(.+))?$" if levels == 2 else r"^(\d+\.\d+)(?:\s+(.+))?$"

    def found(x, after):
        own = F.nullif(F.regexp_extract(x, heading, 2), F.lit(""))
        title = F.coalesce(own, F.when((F.length(after) >= 3) & ~after.rlike(r"^\d+\."), after))
        number = F.regexp_extract(x, heading, 1)
        kept = x.rlike(heading) & ~F.coalesce(title.rlike(r"(?i)^(Chapter|Page|\d+)$"), F.lit(False))
        return F.when(kept, F.struct(number.alias("number"), F.regexp_replace(title, r"^\.+|\.+$", "").alias("title"), F.regexp_count(number, F.lit("[.]")).alias("depth")))

    return _first_line(s, found)


def contents_line(s: Column) -> Column:
    """struct(chapter, title, page) of a line of a table of contents; null of other lines."""
    t = F.regexp_replace(F.coalesce(s, F.lit("")), r"^\s+|\s+$", "")

    def of(p):
        p = f"(?i){p}"
        title = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, p, 2), r"\s+", " "), r"^[. \-:]+|[. \-:]+$", "")
        return F.when(t.rlike(p), F.struct(F.regexp_extract(t, p, 1).try_cast("int").alias("chapter"), title.alias("title"), F.regexp_extract(t, p, 3).alias("page")))

    return F.coalesce(*map(of, CONTENTS_LINE))


def chapter_mention(s: Column) -> Column:
    """struct(number, title) of a line that mentions a chapter or starts like one; the title only of the first kind."""
    t = F.regexp_replace(F.coalesce(s, F.lit("")), r"^\s+|\s+$", "")
    forms = [r"(?i)Chapter\s+(\d+)", r"(?i)^(\d+)\.\s+[A-Z][a-z]+", r"(?i)^(\d+)\s+[A-Z][A-Z\s]+$"]
    number = F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 1).try_cast("int")) for p in forms])
    titled = r"(?i)Chapter\s+\d+[\s\-:]*(.+?)$"
    return F.when(number.isNotNull(), F.struct(number.alias("number"), F.when(t.rlike(titled), F.regexp_replace(F.regexp_extract(t, titled, 1), r"^\s+|\s+$", "")).alias("title")))


def chapter_heading(s: Column) -> Column:
    """struct(number, title) of a line that is a chapter heading, in digits or words."""
    t = F.regexp_replace(F.coalesce(s, F.lit("")), r"^\s+|\s+$", "")
    words = F.array(*map(F.lit, NUMBER_WORDS))

    def of(p):
        p = f"(?i){p}"
        said = F.regexp_extract(t, p, 1)
        number = F.coalesce(said.try_cast("int"), F.nullif(F.array_position(words, F.lower(said)), F.lit(0)).cast("int"))
        title = F.regexp_replace(F.regexp_extract(t, p, 2), r"^\s+|\s+$", "") if p.count("(.+?)") else F.lit("")
        return F.when(t.rlike(p), F.struct(number.alias("number"), title.alias("title")))

    return F.coalesce(*map(of, CHAPTER))


def section_heading(s: Column) -> Column:
    """struct(number, title, level) of a line that is a section heading; the level is one more than the number's dots."""
    t = F.regexp_replace(F.coalesce(s, F.lit("")), r"^\s+|\s+$", "")

    def of(p):
        number = F.regexp_extract(t, p, 1)
        title = F.regexp_replace(F.regexp_extract(t, p, 2), r"^\s+|\s+$", "")
        return F.when(t.rlike(p), F.struct(number.alias("number"), title.alias("title"), (F.regexp_count(number, F.lit("[.]")) + 1).alias("level")))

    return F.coalesce(*map(of, SECTION))


def detected_numbers(s: Column) -> Column:
    """struct(sections, chapters): the sorted distinct numbers a text holds."""
    t = F.coalesce(s, F.lit(""))
    sections = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(\d+(?:\.\d+){1,3})\b"), 1)))
    chapters = F.transform(F.regexp_extract_all(t, F.lit(r"(?i)Chapter\s+(\d+)"), 1), lambda x: x.try_cast("int"))
    return F.struct(sections.alias("sections"), F.array_sort(F.array_distinct(chapters)).alias("chapters"))


def signals(s: Column) -> Column:
    """struct of what a page's text shows: words of contents, index, exercises and front matter, counts of telling lines, sizes and densities."""
    t = F.coalesce(s, F.lit(""))
    low, lines = F.lower(t), F.split(t, "\n")
    solid = F.filter(lines, lambda x: x.rlike(r"\S"))
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    short = lambda x: F.length(F.trim(x)) < 80
    practice = F.exists(lines, lambda x: short(x) & F.lower(x).rlike("|".join(PRACTICE_PHRASES)))
    mean = F.when(F.size(solid) > 0, F.aggregate(solid, F.lit(0), lambda a, x: a + F.length(x)) / F.size(solid)).otherwise(F.lit(0.0))
    return F.struct(
        low.contains("contents").alias("toc_word"), n(DOT_LEADER).alias("dot_leaders"), n(r"^\s*\d+(\.\d+){1,3}\s*$").alias("bare_numbers"), n(r"\S\s+\d{1,4}\s*$").alias("page_ends"),
        F.lower(F.array_join(F.slice(solid, 1, 5), "\n")).contains("index").alias("index_word"), F.regexp_count(t, F.lit(r"\b\d{1,4}(?:\s*[,–—-]\s*\d{1,4})+")).alias("page_lists"),
        practice.alias("practice_word"), n(r"^\s*\d+\.\s").alias("questions"), n(r"^\s*\(?[A-E]\)?[.)]\s").alias("options"), low.rlike("|".join(FRONT_PHRASES)).alias("front_word"),
        F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).alias("words"), F.length(F.regexp_replace(t, r"^\s+|\s+$", "")).alias("chars"), F.regexp_count(t, F.lit(r"[a-zA-Z]{2}[.!?]\s")).alias("sentences"),
        F.round(mean, 1).alias("line_length"), F.round(F.regexp_count(t, F.lit("[.!?;:]")) / F.greatest(F.length(t), F.lit(1)), 4).alias("stops"),
    )


def page_class(g: Column, page: Column) -> Column:
    """struct(type, confidence) from a page's signals and its number: the first of blankish, contents, index, front matter, exercises, content that fits."""
    part = lambda hit, points: F.when(hit, F.lit(points)).otherwise(F.lit(0.0))
    kind = lambda name, c: F.struct(F.lit(name).alias("type"), F.round(F.least(c, F.lit(1.0)), 3).alias("confidence"))
    toc = part(g["toc_word"], 0.5) + part(g["dot_leaders"] >= 5, 0.4) + part(g["bare_numbers"] >= 6, 0.2) + part(g["page_ends"] >= 5, 0.15)
    index = part(g["index_word"], 0.4) + part(g["page_lists"] >= 5, 0.4) + part(g["dot_leaders"] >= 5, 0.2) + part((g["stops"] < 0.01) & (g["words"] > 100), 0.1)
    practice = part(g["practice_word"], 0.45) + part(g["questions"] >= 3, 0.35) + part(g["options"] >= 4, 0.25)
    return (
        F.when((g["words"] < 40) | (g["chars"] < 200), kind("blankish", F.lit(0.95))).when(F.round(toc, 6) >= 0.5, kind("toc", toc)).when(F.round(index, 6) >= 0.5, kind("index", index))
        .when(g["front_word"] & (page <= 10), kind("front_matter", F.lit(0.8))).when(F.round(practice, 6) >= 0.45, kind("practice", practice))
        .when((g["sentences"] >= 3) & (g["line_length"] >= 40), kind("content", F.lit(0.85))).when((g["words"] > 100) & (g["sentences"] >= 2), kind("content", F.lit(0.6)))
        .otherwise(kind("unknown", F.lit(0.3)))
    )


def accepted_chapters(found: Column, gap: int = 5, low: int = 1, high: int = 50) -> Column:
    """Of a book's chapter headings, an array of struct(page, number, title) by page, those that count.

    A number in range, not yet taken, at least `gap` pages after the last one taken. A fold of the array, which holds a row a heading.
    """
    start = F.struct(F.array().cast("array<struct<page:bigint,number:int,title:string>>").alias("taken"), F.lit(-1).cast("bigint").alias("last"))

    def step(a, x):
        fits = x["number"].between(low, high) & ~F.exists(a["taken"], lambda y: y["number"] == x["number"]) & ((a["last"] <= 0) | (x["page"] - a["last"] >= gap))
        return F.struct(F.when(fits, F.array_append(a["taken"], x)).otherwise(a["taken"]).alias("taken"), F.when(fits, x["page"]).otherwise(a["last"]).alias("last"))

    return F.aggregate(found, start, step, lambda a: a["taken"])
