"""Spaced-repetition and grading rules as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Synonyms of the grader.
SYNONYMS = {
    "fast": ["quick", "rapid", "speedy"],
    "quick": ["fast", "rapid", "speedy"],
    "big": ["large", "huge", "enormous"],
    "large": ["big", "huge", "enormous"],
    "small": ["tiny", "little", "compact"],
    "function": ["method", "procedure", "routine"],
    "method": ["function", "procedure", "routine"],
    "array": ["list", "vector"],
    "list": ["array", "vector"],
    "error": ["bug", "fault", "defect"],
    "bug": ["error", "fault", "defect"],
    "increase": ["grow", "rise", "expand"],
    "decrease": ["shrink", "reduce", "decline"],
    "optimal": ["best", "ideal"],
    "best": ["optimal", "ideal"],
}
CONFIDENCE = {"high": 1.0, "medium": 0.6, "low": 0.3}
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}


def literal_map(items: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(items.items())])


def next_review(quality: Column, reps: Column, ease: Column, interval: Column, lapses: Column) -> Column:
    """The review state after a grade of 0 to 5, as a struct; a failed review starts over, whole days round half to even."""
    failed, miss = quality < 3, F.lit(5) - quality
    days = F.when(failed | (reps == 0), F.lit(1)).when(reps == 1, F.lit(6)).otherwise(F.bround(interval * ease).cast("int"))
    change = F.when(failed, F.lit(-0.20)).otherwise(F.lit(0.1) - miss * (F.lit(0.08) + miss * F.lit(0.02)))
    return F.struct(
        days.cast("int").alias("interval_days"), F.round(F.greatest(F.lit(1.3), ease + change), 4).alias("ease"),
        F.when(failed, F.lit(0)).otherwise(reps + 1).cast("int").alias("reps"), (lapses + failed.cast("int")).cast("int").alias("lapses"),
    )


def next_review_by_book(grade: Column, reviews: Column, ease: Column, interval: Column) -> Column:
    """The variant of per-book decks: fractions of days, a milder change of ease, and a failed card is due at once."""
    failed, miss = grade < 3, F.lit(5) - grade
    days = F.when(failed, F.lit(0.0)).when(reviews == 0, F.lit(1.0)).when(reviews == 1, F.lit(6.0)).otherwise(F.round(interval * ease, 1))
    return F.struct(days.alias("interval_days"), F.round(F.greatest(F.lit(1.3), ease + (F.lit(0.1) - miss * F.lit(0.02))), 2).alias("ease"))


def card_mastery(interval: Column, ease: Column, lapses: Column, last_reviewed: Column, as_of: Column) -> Column:
    """0 to 1: the interval against a month, less for lapses, more for ease over 2.5, fading from 30 to 60 days without review; half if never reviewed."""
    base = F.least(F.lit(1.0), interval / F.lit(30.0)) - lapses * 0.05 + F.greatest(F.lit(0.0), ease - 2.5) * 0.5
    days = F.datediff(as_of, last_reviewed)
    fade = F.when(days > 60, F.lit(0.7)).when(days > 30, F.greatest(F.lit(0.7), 1.0 - 0.3 * ((days - 30) / F.lit(30.0)))).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * F.when(last_reviewed.isNull(), F.lit(0.5)).otherwise(fade)))


def grade(answer: Column, expected: Column, card_type: Column) -> Column:
    """0 to 5 by the share of the expected tokens that the answer's tokens or their synonyms cover; a cloze answer that holds the expected text is 5."""
    tokens = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("[a-z0-9_]+"), 0))
    known = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, v))) for k, v in SYNONYMS.items()))
    given, want = tokens(answer), tokens(expected)
    wide = F.array_union(given, F.flatten(F.transform(given, lambda t: F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>")))))
    share = F.size(F.array_intersect(wide, want)) / F.size(want)
    steps = F.when(share >= 0.70, 5).when(share >= 0.50, 4).when(share >= 0.30, 3).when(share >= 0.15, 2).when(share >= 0.05, 1).otherwise(0)
    cloze = (card_type == "cloze") & F.contains(F.lower(F.trim(answer)), F.lower(F.trim(expected)))
    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", 0).when(cloze, 5).when(F.size(want) == 0, 3).otherwise(steps)


def terminality(level: Column, redundancy: Column, contradiction: Column) -> Column:
    """How settled an answer is, 0 to 1."""
    weight = F.coalesce(F.try_element_at(literal_map(CONFIDENCE), level), F.lit(0.3))
    value = weight * (1.0 + F.coalesce(redundancy, F.lit(0.0)) * 0.3) * F.when(F.coalesce(contradiction, F.lit(False)), 0.5).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def concept_coverage(expected: Column, found: Column) -> Column:
    """The share of expected concepts that contain a found one or are contained in one, without regard to case; 1 if none is expected."""
    low = F.transform(found, lambda f: F.lower(f))
    hit = F.filter(expected, lambda e: F.exists(low, lambda f: F.contains(f, F.lower(e)) | F.contains(F.lower(e), f)))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.size(hit) / F.size(expected))


def cited(must: Column, books: Column) -> Column:
    return (F.size(must) == 0) | F.arrays_overlap(must, books)


def confident_enough(level: Column, least: Column) -> Column:
    rank = literal_map(CONFIDENCE_RANK)
    value = lambda c: F.coalesce(F.try_element_at(rank, c), F.lit(0))
    return value(level) >= value(least)


def gap(mastery: Column, mean_terminality: Column, n_books: Column) -> Column:
    """How much of a concept is missing; more if its questions are unsettled or several books hold it."""
    unsettled = F.coalesce((1.0 - mean_terminality) * 0.2, F.lit(0.0))
    books = F.when((n_books >= 2) & (mastery < 0.5), F.least(F.lit(0.3), (n_books - 1) * 0.1)).otherwise(F.lit(0.0))
    return 1.0 - mastery + unsettled + books
