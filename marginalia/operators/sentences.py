"""Sentences of whole pages in Python, many times as fast as the same rules of functions/prose.py and functions/text.py as nested Column expressions.

Patterns are ASCII, as the SQL reads them; what printable() removes leaves only common spaces, tabs and newlines.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..functions import text as T

_SPACE = " \t\n\f\r"
_ODD = regex.compile(r"[[\p{C}\p{Z}]--[ \n\t]]", regex.V1).sub
#: (sign without which a pattern can't match, pattern, what it becomes), in order.
_STEPS = [
    (re.compile(sign).search, re.compile(p, re.A if k > 5 else 0).sub, by)
    for k, (sign, p, by) in enumerate((
        (r"-[ \t\n]*\n", r"(\w)-[ \t\n]*\n[ \t\n]*(\w)", r"\1\2"), (r"\n\n\n", r"\n{3,}", "\n\n"), (r"\.\.\.\.", r"\.{4,}", " "), (r"\.[ \t\n]+\.", r"\.[ \t\n]+\.[ \t\n]+\.([ \t\n]+\.)*", " "), (r"  |\t", r"[ \t]+", " "), (r"\n ", r"\n ", "\n"),
        (r"—|–", r"[—–]", "\n"), ("•", r"\s+•\s+", "\n"), (r"[eErR][ \n]+[0-9]|[nN][ \n]+[0-9]", r"(?i:example|chapter|section|figure|table)\s+\d+(?:\.\d+)*[.:]\s*", "\n"), (":", r":\s+(?=[A-Z])", ".\n"), (r"\.\.\.", r"\.{3,}\s*", "\n"),
    ))
]
_ENDS, _HALVES, _CLAUSES = (re.compile(p, re.A).split for p in (r"[.!?]+\s*|\n+", r"[;:]\s+", r"[;,:]\s+"))


def _kept(parts: list[str]) -> list[str]:
    return [y for x in parts if (y := x.strip(_SPACE))]


def _packed(s: str, most: int) -> list[str]:
    """packed_words of functions/prose.py."""
    runs, start = [], ""
    for w in s.split():
        if start and len(start) + len(w) + 2 > most:
            runs.append(start)
            start = w
        else:
            start = f"{start} {w}" if start else w
    return [*runs, start]


def split(text: str | None, most: int = 240, least: int = 30) -> list[str]:
    """The sentences of a text in order, as sentences() of functions/prose.py gives them."""
    t = text or ""
    if not t.replace("\n", " ").replace("\t", " ").isprintable():
        t = _ODD("", t)
    for k, (sign, sub, by) in enumerate(_STEPS):
        if k == 6:
            t = t.strip(_SPACE)
        if sign(t):
            t = sub(by, t)
    out: list[str] = []
    for x in _kept(_ENDS(t)):
        for y in _kept(_HALVES(x)) if len(x) > 220 else (x,):
            for z in [y] if len(y) <= most else [r for p in _kept(_CLAUSES(y)) for r in (_packed(p, most) if len(p) > most else [p])]:
                if least <= len(z) <= most and len(z.split()) >= 6:
                    out.append(z)
    return out


_STOP = frozenset(T.CONTENT_STOPWORDS)
_BEGINS = tuple(p + end for p in T.STRUCTURAL_PREFIXES for end in " :")
_PHRASES = [p for p in T.EXERCISE_PHRASES + T.REFERENCE_PATTERNS if p.isascii() and p.replace(" ", "").isalpha()]
#: What else filters look for has a digit.
_NUMBERED = re.compile("|".join([r"\b(?:chapter|section|figure|table)\s+\d", *(p for p in T.REFERENCE_PATTERNS if p not in _PHRASES)]), re.A).search
_DIGIT, _YEAR, _DATED, _TOKENS = re.compile("[0-9]").findall, re.compile("[0-9]{4}").findall, re.compile(r"[0-9]{4}\s*[,.]", re.A).search, re.compile("[a-z]+").findall


def held(low: str, some: Iterable[str]) -> bool:
    """Whether one of these is in the text; half the time of any()."""
    for w in some:
        if w in low:
            return True
    return False


def passes(s: str) -> bool:
    """Whether a squeezed sentence passes all quality filters, as passes_quality() of functions/text.py has them."""
    if len(s) < 20:
        return False
    n, low = s.count(" ") + 1, s.lower()
    tokens = _TOKENS(low)
    if not tokens or not len([t for t in tokens if t not in _STOP and len(t) > 1]) / len(tokens) > 0.6:
        return False
    if n < 8 and not held(low, T.DEFINITION_CUES) or s.count(",") >= 4 and n < 15:
        return False
    digits = len(_DIGIT(s))
    if digits and (digits / (len(s) - s.count(" ")) > 0.12 or _DATED(s) and len(_YEAR(s)) >= 2 or _NUMBERED(low)):
        return False
    return not low.startswith(_BEGINS) and not held(low, _PHRASES)


def marked(s: str) -> bool:
    """Whether a squeezed text of 15 characters or more is structural noise, an exercise or a reference, as functions/text.py has them."""
    low = s.lower()
    listed = s.count(",") >= 4 and s.count(" ") + 1 < 15
    return listed or low.startswith(_BEGINS) or held(low, _PHRASES) or bool(_NUMBERED(low)) or bool(_DATED(s)) and len(_YEAR(s)) >= 2


_NO_LETTERS = re.compile("[^a-z]+").sub


def may_hold(text: str | None, holding: tuple[str, ...]) -> bool:
    """Whether a sentence of the text may hold one of these (letters a to z and spaces): what becomes a sentence loses other signs, or letters where it ends, so that the letters of what it holds follow each other in the text."""
    letters = _NO_LETTERS("", (text or "").lower())
    return any(_NO_LETTERS("", h) in letters for h in holding)


def of_pages(pages: DataFrame, good: bool = False, holding: tuple[str, ...] = ()) -> DataFrame:
    """pages (doc_id, s) -> (doc_id, pos, s) of all sentences; good: squeezed, and only those that pass the quality filters; holding: only those with one of these in lower case."""

    def run(batches):
        for batch in batches:
            ids, places, texts = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if holding and not may_hold(text, holding):
                    continue
                for pos, s in enumerate(split(text)):
                    s = " ".join(s.split()) if good else s
                    if holding and not any(map(s.lower().__contains__, holding)):
                        continue
                    if not good or passes(s):
                        ids.append(i)
                        places.append(pos)
                        texts.append(s)
                if len(ids) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "pos", "s"])
                    ids, places, texts = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "pos", "s"])

    return pages.select("doc_id", "s").mapInArrow(run, "doc_id long, pos int, s string")
