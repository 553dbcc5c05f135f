"""Text predicates and normalisers as Column expressions; everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and phrases that decide results.
CONTENT_STOPWORDS = (
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would "
    "could should may might must can shall this that these those it its"
).split()
TERM_STOPWORDS = CONTENT_STOPWORDS + (
    "using consider given thus hence therefore however thing stuff part element type form way method process result"
).split()
STRUCTURAL_PREFIXES = ["chapter", "section", "figure", "table", "appendix", "contents", "references", "bibliography", "index"]
EXERCISE_PHRASES = ["true or false", "fill in the blank", "choose", "prove that", "derive", "exercise", "problem", "solution", "multiple choice"]
REFERENCE_PATTERNS = [r"technical report", r"university", r"journal", r"proceedings", r"\(\d{4}\)", r"pp\.\s*\d", r"vol\.\s*\d", r"no\.\s*\d"]
DEFINITION_CUES = ["is defined as", "refers to", "means", "is called", "consists of"]
SUMMARY_PHRASES = [
    "summary", "summarize", "overview", "main ideas", "key points", "explain the chapter", "chapter summary", "brief summary",
    "give me a summary", "10-bullet", "bullet summary",
]
CODE_SYMBOLS = r"(::|<<|>>|[*&<>{}\[\]()+\-=])"

#: White space as the SQL's expressions have it: without the vertical tab that Java's own class holds.
SPACE = r"[\t\n\f\r ]"

any_of = "|".join


def once(value: Column, use) -> Column:
    """use(value) with value computed one time only."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_or_empty(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def squeeze(s: Column) -> Column:
    """Runs of white space as one space, none at the ends, nor wider spaces there; null as empty."""
    return F.regexp_replace(F.regexp_replace(text_or_empty(s), f"{SPACE}+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")


def words(s: Column) -> Column:
    """The white-space separated words of a text."""
    return F.filter(F.split(text_or_empty(s), f"{SPACE}+"), lambda w: w != "")


def word_count(s: Column) -> Column:
    return F.size(words(s))


def matches(s: Column, pattern: str) -> Column:
    return text_or_empty(s).rlike(pattern)


def hits(s: Column, pattern: str) -> Column:
    return F.regexp_count(text_or_empty(s), F.lit(pattern))


def lowered(s: Column) -> Column:
    return F.lower(F.trim(text_or_empty(s)))


def structural_noise(s: Column) -> Column:
    """Headings, labels of figures and the like, and all under ten characters."""
    return (F.length(F.trim(text_or_empty(s))) < 10) | lowered(s).rlike(rf"^({any_of(STRUCTURAL_PREFIXES)})[ :]|\b(chapter|section|figure|table)\s+\d+")


def exercise_prompt(s: Column) -> Column:
    return (text_or_empty(s) == "") | lowered(s).rlike(any_of(EXERCISE_PHRASES))


def reference_line(s: Column) -> Column:
    """A bibliography line by its phrases, its many commas in few words, or its years."""
    long = F.length(F.trim(text_or_empty(s))) >= 15
    listed = (hits(s, ",") >= 4) & (word_count(s) < 15)
    years = matches(s, r"\d{4}\s*[,.]") & (hits(s, r"\d{4}") >= 2)
    return long & (lowered(s).rlike(any_of(REFERENCE_PATTERNS)) | listed | years)


def content_ratio(s: Column) -> Column:
    """The share of alphabetic tokens that aren't stop words or single letters; 0 without tokens."""
    tokens = F.regexp_extract_all(F.lower(text_or_empty(s)), F.lit("[a-z]+"), 0)
    content = F.filter(tokens, lambda t: ~t.isin(CONTENT_STOPWORDS) & (F.length(t) > 1))
    return F.when(F.size(tokens) > 0, F.size(content) / F.size(tokens)).otherwise(F.lit(0.0))


def numeric_overload(s: Column) -> Column:
    """Over 12 % digits among what isn't a space."""
    solid = F.length(F.regexp_replace(text_or_empty(s), "[ \n]", ""))
    return F.when(solid > 0, hits(s, "[0-9]") / solid > 0.12).otherwise(F.lit(False))


def defines(s: Column) -> Column:
    return F.lower(text_or_empty(s)).rlike(any_of(DEFINITION_CUES))


def too_short(s: Column, least: int = 8) -> Column:
    return (word_count(s) < least) & ~defines(s)


def passes_quality(s: Column) -> Column:
    """All quality filters at once; the text is squeezed a single time, and the cheap tests come first."""
    tests = lambda x: (F.length(x) >= 20) & ~numeric_overload(x) & ~structural_noise(x) & ~exercise_prompt(x) & ~too_short(x) & ~reference_line(x) & (content_ratio(x) > 0.6)
    return once(squeeze(s), tests)


def summary_question(s: Column) -> Column:
    return lowered(s).rlike(any_of(SUMMARY_PHRASES))


def definition_question(s: Column) -> Column:
    return F.trim(text_or_empty(s)).rlike(r"(?i)^(?:what\s+is|what\s+are|define|explain|describe)\b")


def comparison_question(s: Column) -> Column:
    return matches(s, r"(?i)\b(?:compare|comparing|comparison|difference|differences|differ|vs\.?|versus|distinguish|contrast)\b")


def simple_tokens(s: Column) -> Column:
    """The sorted distinct lower-case word tokens."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(s)), F.lit("[a-z0-9_]+"), 0)))


def index_tokens(s: Column) -> Column:
    """Word tokens with repeats, then code symbols: what the index counts."""
    return F.concat(F.regexp_extract_all(F.lower(text_or_empty(s)), F.lit("[a-z0-9_]+"), 0), F.regexp_extract_all(text_or_empty(s), F.lit(CODE_SYMBOLS), 1))


def term_ngrams(s: Column) -> Column:
    """Runs of one to three alphabetic tokens without stop words, of three characters or more: all single ones, then all pairs, then all triples."""

    def runs(kept):  # tokens, null for stop words: what a null is part of is null
        pairs = F.transform(kept, lambda x, i: F.concat(x, F.lit(" "), F.get(kept, i + 1)))
        triples = F.transform(kept, lambda x, i: F.concat(x, F.lit(" "), F.get(kept, i + 1), F.lit(" "), F.get(kept, i + 2)))
        return F.filter(F.concat(kept, pairs, triples), lambda g: F.length(g) >= 3)

    tokens = F.regexp_extract_all(F.lower(text_or_empty(s)), F.lit("[a-z]+"), 0)
    return once(F.transform(tokens, lambda x: F.when(~x.isin(TERM_STOPWORDS), x)), runs)


def clean_title(s: Column) -> Column:
    """A section title without dot padding and what follows; as it was if nothing is left."""
    cut = F.regexp_replace(F.trim(F.regexp_replace(text_or_empty(s), r"(?s)(?:\.\s*){4,}.*$", "")), r"[. ]+$", "")
    return F.when(cut != "", cut).otherwise(s)


def page_number(s: Column) -> Column:
    """A non-negative whole number, else 0."""
    return F.greatest(F.coalesce(s.try_cast("int"), F.lit(0)), F.lit(0))


def first_words(s: Column, n: int = 28) -> Column:
    return F.array_join(F.slice(words(s), 1, n), " ")


def digest_id(s: Column) -> Column:
    """The first 16 hex digits of the text's SHA-256, lower-cased and trimmed first."""
    return F.substring(F.sha2(lowered(s), 256), 1, 16)


def chunk_id(book, chapter, section, page_start, page_end, index, sub) -> Column:
    """book|ch|sec|pages|index|sub with X or 0 for what is missing."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    return F.concat_ws(
        "|", book, F.concat(F.lit("ch"), F.coalesce(chapter.cast("string"), F.lit("X"))), F.concat(F.lit("sec"), F.coalesce(F.nullif(section, F.lit("")), F.lit("X"))),
        F.concat(F.lit("p"), number(page_start), F.lit("-"), number(page_end)), F.concat(F.lit("i"), number(index)), F.concat(F.lit("s"), number(sub)),
    )


def section_key(s: Column) -> Column:
    """10.1.2 as [10, 1, 2], for comparison in order; parts that aren't numbers are 999."""
    return F.transform(F.split(F.trim(F.replace(text_or_empty(s), F.lit("§"), F.lit(""))), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)))


def paragraphs(s: Column) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(s), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def long_sentences(s: Column) -> Column:
    """Sentences and lines of over 30 characters."""
    lines = F.flatten(F.transform(F.split(text_or_empty(s), r"(?<=[.!?])\s+(?=[A-Z])"), lambda x: F.split(x, "\n")))
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.length(x) > 30)


def solid_lines(s: Column) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(s), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def looks_like_contents(s: Column) -> Column:
    """Five dot-leader lines, five numbered lines that end in a page, or eight bare section numbers."""
    lines = solid_lines(s)
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    return (n(r"(?:\.\s*){3,}.*\b\d+\s*$|(?:\.\s*){4,}\s*$") >= 5) | (n(r"^\d+(?:\.\d+)+\s+.*\b\d+\s*$") >= 5) | (n(r"^\d+(?:\.\d+)+\s*$") >= 8)


def structural_chunk(s: Column, strict: bool = False) -> Column:
    """Contents, indexes and the like: two of four signs; strict also asks for two sentences and ten words each."""
    t = F.trim(text_or_empty(s))
    lines = solid_lines(t)
    dotted = hits(t, r"\.{4,}|\.\s+\.\s+\.") > 3
    paged = F.size(F.filter(lines, lambda x: x.rlike(r".\s*\d+$|\s\d{1,4}$"))) / F.size(lines) > 0.30
    digits = hits(t, "[0-9]") / F.greatest(F.length(F.regexp_replace(t, "[ \n]", "")), F.lit(1)) > 0.12
    sentences = F.filter(F.transform(F.split(t, "[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")
    total = F.aggregate(sentences, F.lit(0), lambda a, x: a + word_count(x))
    mean = total / F.size(sentences)
    short = F.size(F.filter(lines, lambda x: word_count(x) < 6))
    thin = (mean < 8) & (short >= F.greatest(F.lit(2.0), F.size(lines) * 0.4))
    signs = sum((F.coalesce(x, F.lit(False)).cast("int") for x in (dotted, paged, digits, thin)), F.lit(0))
    out = (t == "") | (signs >= 2)
    return out | F.coalesce((F.size(sentences) < 2) | (mean < 10), F.lit(False)) if strict else out
