"""Hand cases of the sentence and page rules, apart from their SQL."""

import unicodedata

import pytest
from pyspark.sql import functions as F
from test_queries import SF

from marginalia import catalog
from marginalia.functions import pages as G
from marginalia.functions import prose as P
from marginalia.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    def of(column, *texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i long, s string").select("i", column(F.col("s")).alias("v")).collect()
        return [r.v for r in sorted(rows)]

    return of


@pytest.mark.parametrize(
    "rule,yes,no",
    [
        (P.math_heavy, ["x = y + z - 1 <= 4", "where (2.1) a = b", "α β γ words"], ["a plain sentence about nothing", "see it for many more words"]),
        (P.noisy_sentence, ["Figure 3 shows it well", r"use \alpha as the rate", "see chapter 4 for all of it", "1 2 3 4 is a run of numbers", "short"], ["A plain sentence that says one thing and ends."]),
        (lambda s: P.noisy_sentence(s, True), ["Why is the sky blue at noon?", "Prove that the sum is even"], ["A plain sentence that says one thing and ends."]),
        (P.bullet_eligible, ["one two three four five six seven eight nine ten"], ["too short", "one two three four five six seven eight nine ten?", "the next chapter four five six seven eight nine ten eleven"]),
        (P.heading_like, ["Binary Search Trees", "The Stack And The Queue"], ["It Is A Verb Line", "word", "all lower case words here"]),
        (P.valid_term, ["gradient descent", "binary search tree", "curve model"], ["s-curve model", "the rate", "learning", "what it is", "trees used", "chapter overview", "is it", "a b"]),
        (P.valid_stem, ["What is gradient descent?", "Name two kinds of trees"], ["Is it the one?", "What is chapter four about?", "Say: what now then", "one two three"]),
        (P.valid_why_stem, ["Why is gradient descent slow?"], ["Why is the rate low?", "What is gradient descent?", "Why is gradient descent slow"]),
        (P.code_line, ["    x", "\tx", "{};", "()()"], ["x = 1", "word {}"]),
        (P.questionable_clause, ["it moves", "it moves toward the minimum slowly", "see figure in the text here", "has 1 2 3 digits in it"], ["deep networks overfit the data often"]),
    ],
)
def test_rules(value, rule, yes, no):
    assert value(rule, *yes, *no) == [True] * len(yes) + [False] * len(no)


def test_definitions(value):
    long = "Entropy means the mean surprise that is carried by a source"
    got = value(P.definition_pair, long, "Too short is it", "A heap is called a tree that was built in order of keys (Knuth, 1973)", "No definition stands in this one at all")
    assert [tuple(x) if x else None for x in got] == [("Entropy", "the mean surprise that is carried by a source"), None, ("A heap", "a tree that was built in order of keys"), None]
    assert value(P.without_citations, "a rule (x) (see Chapter 2), (1999)", "kept (here)") == ["a rule (x)", "kept (here)"]
    assert value(P.because_answer, "- steps are small", "since it is so", "x") == ["Because steps are small", "since it is so", None]
    assert value(P.without_prep_phrase, "In practice, it works", "In a phrase that goes on and on for over forty characters, it works", "Now, it works") == ["it works", "In a phrase that goes on and on for over forty characters, it works", "Now, it works"]
    assert value(P.score_hint, "x refers to y because z", "figure 1234", "plain") == [3, -4, 0]


def test_strong_normalisation(value):
    cases = ["ﬁne ﬂow", "di↵erent", "a → b�c", "½ ² Å", "af- terposition", "Title- Case", "verylongleftpart- verylongrightpart", "x1- ab cd- ef", "dots .... and ,, ;; more"]
    got = value(P.strong, *cases)
    assert got[:3] == ["fine flow", "diferent", "a bc"] and got[4:6] == ["afterposition", "Title- Case"] and got[6] == cases[6] and got[7] == "x1- ab cdef" and got[8] == "dots and , , more"
    odd = "".join(chr(c) for c in range(0xA0, 0x3000) if chr(c).isprintable())
    assert value(lambda s: P.nfkc(s), odd) == [unicodedata.normalize("NFKC", odd)]


def test_sentences(value):
    (got,) = value(P.sentences, "This is a sentence of more than six words. Short one. This is another — a dash splits it into two parts here!\n" + "long words " * 30)
    assert got[0] == "This is a sentence of more than six words" and all(30 <= len(x) <= 240 and len(x.split()) >= 6 for x in got) and len(got) == 4
    assert value(P.trimmed_bullet, "And but the point holds.", "x " * 120) == ["the point holds", ("x " * 90).strip()]


def test_opposed_sentences(value):
    flags = lambda s: P.flips(P.flip_tokens(s))
    pair = lambda s: P.opposed(flags(F.split(s, "\\|")[0]), flags(F.split(s, "\\|")[1]))
    assert value(pair, "it is true|it is not true", "values increase|values decrease", "always so|never so", "it grows|it rises", "a|b") == [True, True, True, False, False]


def test_chapter_and_section_starts(value):
    got = value(G.chapter_start, "Chapter 3\nTrees", "x\nChapter 4: Graphs\n4.1 Paths", "Chapter 3 begins here with prose", "\n" * 15 + "Chapter 9", None)
    assert [tuple(x) if x else None for x in got] == [(3, "Trees"), (4, None), None, None, None]
    got = value(G.section_start, "1.2.3 Depth", "1.2\nNext line title", "1.2 Page\n1.3 Real", "1.2.3.4 too deep", "no")
    assert [tuple(x) if x else None for x in got] == [("1.2.3", "Depth", 2), ("1.2", "Next line title", 1), ("1.3", "Real", 1), None, None]
    got = value(G.special_page, "x\nReview Questions\ny", "a\n" * 20 + "Answer Key", "Exercises")
    assert [tuple(x) if x else None for x in got] == [("review", "Review Questions"), None, ("practice", "Exercises")]


def test_page_classes(value):
    page = lambda s: G.page_class(G.signals(s), F.lit(50))
    prose = "This is a sentence of some length that says a thing. " * 12
    toc = "Contents\n" + "\n".join(f"{k}.1 Part ...... {k}" for k in range(1, 30)) + "\nword" * 30
    index = "Index\n" + "\n".join(f"term {k}, {k + 3}, {k + 9}" for k in range(60))
    practice = "Exercises\n" + "\n".join(f"{k}. What is the value of item {k} here in the list" for k in range(1, 9)) + " word" * 20
    assert [tuple(x) for x in value(page, "few words", toc, index, practice, prose, "word " * 60)] == [("blankish", 0.95), ("toc", 1.0), ("index", 0.9), ("practice", 0.8), ("content", 0.85), ("unknown", 0.3)]


def test_chapters_need_a_gap(spark):
    found = [(1, 1), (3, 2), (6, 3), (9, 3), (10, 1), (20, 60), (30, 4)]
    df = spark.createDataFrame([([(p, n, None) for p, n in found],)], "f array<struct<page:bigint,number:int,title:string>>")
    assert [(x.page, x.number) for x in df.select(G.accepted_chapters(F.col("f")).alias("a")).first().a] == [(1, 1), (6, 3), (30, 4)]


def test_corpus_is_what_the_filters_leave(spark):
    chunks = {r.chunk_id: r.reason for r in catalog.QUERIES["check_filters"](spark, SF).collect()}
    rows = catalog.QUERIES["build_corpus"](spark, SF).collect()
    assert sum(r.input for r in rows) == len(chunks) and sum(r.filtered for r in rows) == sum(x is not None for x in chunks.values()) > 0
    assert T.looks_like_contents is not None and all(r.output >= 1 for r in rows if r.input > r.filtered)
