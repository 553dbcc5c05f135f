"""Exams from a scope's sentences: the pool, five kinds of questions and how many of each.

Everything is decided in Python where a scope's sentences meet: each kind gives its questions one by one, best first, so
that no more are made than an exam takes. The rules are those of functions/prose.py and functions/text.py.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import regex
from pyspark.sql import DataFrame

from ..functions import prose as P
from ..functions import text as T
from . import notes as N
from . import sentences as S

WANTED = {"definition": 5, "fib": 4, "tf": 4, "short": 4, "list": 3}  # questions of each kind, in the exam's order
REFILL = ("definition", "tf", "short", "fib", "list")  # the order in which kinds fill what others leave
CAUSES = ("because", "due to", "since", "therefore", "thus")
ENUMERATIONS = ("types of", "components include", "three main", "steps are", "factors are", "elements include")
NEVER_BLANK = frozenset(
    "this that the a an it is are was were have has had do does the method way any some each then thus however therefore because if but so also "
    "they we you he she i them us his her their its function value thing stuff part element type form".split()
)
BLANK, TO_FILL, TO_JUDGE, TO_LIST = "______", "Fill in the blank: ", "True or False: ", "List the following:"


class Candidate(NamedTuple):
    s: str
    low: str
    n: int  # words
    hint: int
    central: float
    top: str | None


class Question(NamedTuple):
    kind: str
    prompt: str
    answer: str
    stem: str | None  # what of the prompt must be a fit stem, if anything


# Rules


_STOP, _BE, _STRUCTURE = frozenset(P.STEM_STOPWORDS), frozenset(P.BE_FORMS), frozenset(P.STRUCTURE_WORDS)
_NO_TERM = frozenset(P.DETERMINERS + P.DISCOURSE + P.PRONOUNS + P.STEM_STOPWORDS)
_LETTERS, _DIGITS, _CITATIONS = (re.compile(p).findall for p in ("[a-zA-Z]+", "[0-9]", r"\[[0-9]+\]|\([0-9]{4}\)"))
_BAD, _META, _YEAR = (re.compile(p, re.A).search for p in (P.BAD_STEM, P.META_TEXT, r"\d{4}"))
_STRUCTURAL = re.compile("chapter|figure|table|page").search
_DIGIT, _FIRST = re.compile("[0-9]").search, re.compile("[a-zA-Z]+").search
_WORD = r"[\p{L}\p{M}\p{N}_]"
_VERB = regex.compile(rf"(?<!{_WORD})(?:has|have|can|will|may|do|are|were)(?!{_WORD})|{_WORD}(?:ed|ing|s)(?!{_WORD})").search
_COMMON, _WORDS = frozenset("has have can will may do are were".split()), re.compile(r"\w+").findall
_JOINING = re.compile(r"[^\w\x00-\x7f]").search  # a sign that may be a mark and so part of a word


def has_verb(low: str) -> bool:
    """Whether a word is a common verb or ends in s, ed or ing; most often one that a space follows."""
    for end in ("s ", "ed ", "ing "):
        if (at := low.find(end)) > 0 and low[at - 1].isalnum():
            return True
    if _JOINING(low):
        return _VERB(low) is not None
    for w in _WORDS(low):
        if w in _COMMON or w.endswith(("s", "ed", "ing")) and w not in ("s", "ed", "ing"):
            return True
    return False


_re2 = lambda p, flags="i": re.compile(P.re2(p, flags).replace(r"\z", r"\Z"), re.A)
_FORMS = [_re2(rf"^(.+?){p}(.+)$", "is").match for p in [*P.DEFINITION_PATTERNS, P.WEAK_DEFINITION]]
_DEFINES_BY, _CITES = _re2(P.HAS_VERB).search, _re2(r"\d{4}|\bchapter\b|\bfig\.?\s*\d").search
_LEADING = re.compile(r"^[\s,;\-–—]+")


def _count(found, s: str, *signs: str) -> int:
    return len(found(s)) if S.held(s, signs) else 0


def hint(s: str, low: str, defines: bool | None = None) -> int:
    """score_hint of functions/prose.py."""
    defines = S.held(low, T.DEFINITION_CUES) if defines is None else defines
    return 2 * defines + S.held(low, P.CAUSAL_HINTS) - 2 * S.held(low, ("figure", "table", "chapter")) - 2 * (_DIGIT(s) is not None and len(_DIGITS(s)) > 2)


@lru_cache(4096)
def fit_stem(s: str) -> bool:
    """valid_stem of functions/prose.py; what is bad holds one of a few signs or a digit."""
    s = s.strip()
    first = _FIRST(s)
    if not first or first[0].lower() in _STOP or S.held(s, ("..", ";", ":", "  ")) or S.held(s.lower(), ("page", "table", "figure", "chapter")):
        return False
    words = _LETTERS(s)
    return len(words) >= 4 and words[-1].lower() not in _STOP and not (_DIGIT(s) and _BAD(s))


def fit_term(s: str) -> bool:
    """valid_term of functions/prose.py."""
    s = s.strip()
    low, words = s.lower(), [w.lower() for w in _LETTERS(s)]
    if len(s) < 4 or not 2 <= len(words) <= 6 or max(map(len, words)) < 3 or words[0] in _NO_TERM or words[-1] in _STOP or len(words[0]) < 2:
        return False
    return not (_BAD(s) or _STRUCTURAL(low) or not _STRUCTURE.isdisjoint(words) or not _BE.isdisjoint(words) or len(s) < 12 and s.endswith(("ed", "ing")))


def without_citations(s: str) -> str:
    """A definition without the parentheses at its end that hold a year, a chapter or a figure."""
    s = s.strip()
    while s.endswith(")") and (at := s.rfind("(")) >= 0 and _CITES(s[at + 1 : -1]):
        s = s[:at].rstrip(",; ")
    return s


def definition_pair(s: str) -> tuple[str, str] | None:
    """(term, definition) as definition_pair of functions/prose.py has them, but for definitions that end in three citations or more."""
    for form in _FORMS if len(s) >= 20 else ():
        if found := form(s):
            definition = without_citations(found[2])
            if 6 <= len(definition.split()) <= 35 and _DEFINES_BY(definition):
                term = found[1].strip().rstrip(".,;:")
                return (term, definition) if len(term) >= 4 and len(definition) >= 15 else None
    return None


def _questionable(clause: str, least: int, most: int) -> bool:
    words = clause.lower().split()
    return not least <= len(words) <= most or not _STRUCTURE.isdisjoint(words) or any(c in clause for c in "↵…�") or len(_DIGITS(clause)) > 2


def _fit_why(q: str) -> bool:
    """valid_why_stem of functions/prose.py."""
    words, low = q.split(), q.lower()
    subject = " ".join(q[4:-1].lower().split()[1:2])
    return len(words) <= 18 and not (_BAD(q) or _YEAR(q) or _STRUCTURAL(low) or "section" in low) and subject[:1].isalpha() and subject not in P.SUBJECT_REJECT


def why(s: str) -> tuple[str, str] | None:
    """(question, answer) of a sentence that gives a reason that can be asked for, as why_questions() of operators/notes.py has them."""
    plain = N.without_numbering(s)
    parts = N.causal_split(plain) if len(plain) >= 20 else None
    if not parts:
        return None
    what, _, reason = parts
    if what.split()[0].lower() in P.PREPOSITIONS and 0 <= (comma := what.find(",")) <= 40:
        what = " ".join(what[comma + 1 :].split())
    tokens = S._TOKENS(what.lower())
    if _questionable(what, 6, 22) or what.split()[0].lower() in P.CLAUSE_REJECT or _META(what) or _questionable(reason, 4, 30):
        return None
    if not tokens or len([t for t in tokens if t not in S._STOP and len(t) > 1]) / len(tokens) < 0.55:
        return None
    built = N.auxiliary(what.rstrip("."))
    question = f"Why {built[0]} {built[1]}?" if built and built[1] else None
    reason = " ".join(_LEADING.sub("", reason).split()[:30])
    if not question or not _fit_why(question) or not fit_stem(question) or len(reason) < 3:
        return None
    given = reason.lower().startswith(("because", "due to", "since", "as a result", "therefore", "thus"))
    return question, reason if given else f"Because {reason[0].lower()}{reason[1:]}"


# What squeezed sentences share, as strong() and dedupe_key() of functions/prose.py have it


_ARROWS, _ARROW = re.compile("[←→⇔⇐⇒↵↱↲↳↴�]").sub, re.compile("[←→⇔⇐⇒↵↱↲↳↴�]").search
_DOTS, _COMMAS, _MARKS = (re.compile(p, re.A).sub for p in (r"\.{3,}", r"[,;]\s*[,;]+", "[^a-z0-9_ ']"))
_ODD_MARKS = re.compile(r"[^\w ']").sub
_mark = lambda m: m[0] if unicodedata.category(m[0])[0] == "M" else " "
_squeeze = lambda s: " ".join(s.split())


def strong(s: str) -> str:
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
        if _ARROW(s):
            s = _ARROWS("", re.sub("([A-Za-z])↵([A-Za-z])", r"\1f\2", s.replace("�", "")))
        s = _squeeze(s)
    if "-" in s:
        s = P._HYPHEN.sub(P._joined, P._HYPHEN.sub(P._joined, s))
    if "..." in s:
        s = _DOTS(" ", s)
    if "," in s or ";" in s:
        s = _COMMAS(",", s)
    s = _squeeze(s)
    return "" if s == "•" else s


def keyed(s: str) -> tuple[str, str, str]:
    """(sentence, dedupe key, strong form in lower case)."""
    low = strong(s).lower()
    return s, _squeeze(_MARKS(" ", low) if low.isascii() else _ODD_MARKS(_mark, low)), low


# The pool and the kinds


def diverse(pool: Iterable[Candidate]) -> Iterator[Candidate]:
    """The first candidate of each top term, then the others."""
    seen: set[str] = set()
    others = []
    for c in pool:
        if c.top and c.top not in seen:
            seen.add(c.top)
            yield c
        else:
            others.append(c)
    yield from others


def definitions(pool: list[Candidate], score) -> Iterator[Question]:
    """Of each term the best definition: terms by their own score, their definition's centrality and name, all falling."""
    best: dict[str, tuple] = {}
    for c in pool:
        pair = definition_pair(c.s) if c.hint >= 2 else None
        if not pair or S.marked(pair[1]) or not fit_term(pair[0]):
            continue
        term, text = pair
        n = len(text.split())
        noise = len(_CITATIONS(text)) * 2.0 + len(_DIGITS(text)) / max(len(text), 1) * 5.0
        rank = (not 6 <= n <= 28, -c.central, n, noise)
        key = term.lower().strip()
        if key not in best or rank < best[key][0]:
            best[key] = (rank, term, text)
    for key in sorted(best, key=lambda k: (score(k), -best[k][0][1], k), reverse=True):
        _, term, text = best[key]
        stem, answer = f"What is {term}?", " ".join(text.split()[:28])
        if fit_stem(stem) and 5 <= len(answer.split()) <= 30:
            yield Question("definition", stem, answer, stem)


def phrases(pool: list[Candidate]) -> Counter:
    """How often phrases of one to three words stand in hinted sentences of 12 to 28 words, in order of the first."""
    count: Counter = Counter()
    for c in pool:
        words = [w.lower() for w in _LETTERS(c.s)] if c.hint >= 1 else []
        if not 12 <= len(words) <= 28:
            continue
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                some = words[i : i + n]
                beside = {some[-1], words[i - 1] if i else "", words[i + n] if i + n < len(words) else ""}
                if NEVER_BLANK.isdisjoint(some) and _BE.isdisjoint(beside) and 3 <= len(phrase := " ".join(some)) <= 25:
                    count[phrase] += 1
    return count


_FIXED = re.compile(r"[;:]|\.\.|\d\s*$", re.A).search  # what no blank takes away
_LOOSE = re.compile(r"chapter|figure|table|page|pp\.\s*\d", re.A).search


def _mended(low: str, count: Counter) -> list[str]:
    """The phrases whose first place in an unfit sentence meets what makes it unfit: no other blank makes it a fit stem."""
    tokens = list(re.finditer("[a-z]+", low))
    if len(tokens) < 4:
        a, b = 0, len(low)
    elif tokens[0][0] in _STOP:
        a, b = tokens[0].span()
    elif tokens[-1][0] in _STOP:
        a, b = tokens[-1].span()
    else:
        found = _LOOSE(low)
        a, b = found.span() if found else (0, len(low))
    parts = {low[i:j] for i in range(max(0, a - 24), b) for j in range(max(i + 3, a + 1), min(len(low), i + 25) + 1)}
    return [p for p in parts if p in count]


def blanks(pool: list[Candidate], supporting: set[str], labels: bool = False) -> Iterator[Question]:
    """Phrases left out of hinted sentences: frequent ones and those that bundles hold first, each from one sentence after another."""
    count = phrases(pool)
    label = TO_FILL if labels else ""
    high = [c for c in diverse(c for c in pool if c.hint >= 1 and 12 <= c.n <= 28) if not _FIXED(label + c.s)] if count else []
    open_, mended = [], {}
    for k, c in enumerate(high):
        if fit_stem(label + c.s) or len(c.low) != len(c.s):
            open_.append(k)
        else:
            for p in _mended(c.low, count):
                mended.setdefault(p, []).append(k)
    value = lambda p: count[p] * 10 + 50 * (count[p] >= 2) + 80 * (p in supporting) + 20 * any(len(w) >= 5 for w in p.split())
    used: set[str] = set()
    for phrase in sorted(count, key=value, reverse=True) if open_ or mended else ():
        places = [k for k in open_ if phrase in high[k].low]
        for k in mended.get(phrase, ()):
            insort(places, k)
        for k in places:
            s = re.sub(phrase, BLANK, high[k].s, count=1, flags=re.I)
            left, _, right = s.partition(BLANK)
            before, after = _LETTERS(left)[-1:], _LETTERS(right)[:1]
            if s in used or BLANK not in s or before and after and before[0].lower() in _BE and after[0].lower() in _BE:
                continue
            words = s.split()
            if words[0] != BLANK and words[-1] != BLANK and fit_stem(label + s):
                used.add(s)
                yield Question("fib", TO_FILL + s, phrase, label + s)


def statements(pool: list[Candidate], labels: bool = False) -> Iterator[Question]:
    """Sentences of 40 to 200 characters with a verb and few citations. Splitting took their stops, so none is asked for unless labels are."""
    fit = (c for c in pool if 40 <= len(c.s) <= 200 and c.hint >= -1 and _count(_CITATIONS, c.s, "[", "(") / max(c.n, 1) < 0.05 and has_verb(c.low))
    seen: set[str] = set()
    label = TO_JUDGE if labels else ""
    for c in diverse(fit):
        if c.low not in seen and fit_stem(label + c.s) and (not labels or c.s.endswith((".", "!"))):
            seen.add(c.low)
            yield Question("tf", TO_JUDGE + c.s, "True", label + c.s)


def reasons(pool: list[Candidate]) -> Iterator[Question]:
    seen: set[str] = set()
    for c in diverse(c for c in pool if c.hint >= 0 and S.held(c.low, CAUSES)):
        asked = why(c.s)
        if asked and asked[0].lower() not in seen:
            seen.add(asked[0].lower())
            yield Question("short", *asked, asked[0])


def list_items(s: str, low: str) -> list[str] | None:
    """Three to seven items of up to six words each of a sentence that enumerates."""
    if not S.held(low, ENUMERATIONS):
        return None
    items = [p for x in re.split(r"[,;]\s*|\s+and\s+", s) if len(p := x.strip()) >= 2 and len(p.split()) <= 6]
    return items if 3 <= len(items) <= 7 else None


def lists(pool: list[Candidate], bundles: list[tuple], labels: bool = False) -> Iterator[Question]:
    """The terms that a bundle's label meets, then what sentences enumerate."""
    seen: set[tuple[str, str]] = set()
    dashed = lambda some: "\n".join(f"- {t}" for t in some)
    named = [Question("list", stem := f"List the key aspects of {label.title()}.", dashed(terms), stem) for label, _, terms, _ in bundles if len(terms) >= 2]
    counted = (Question("list", TO_LIST, dashed(some), TO_LIST if labels else None) for c in pool if (some := list_items(c.s, c.low)))
    for q in (q for some in (named, counted) for q in some):
        key = q.prompt.lower(), q.answer.lower()
        if key not in seen and (q.stem is None or fit_stem(q.stem)):
            seen.add(key)
            yield q


# The exam


def sane(q: Question) -> bool:
    """The last check: a fit stem, an answer on one line of five to 30 words, of one to five for a blank."""
    if q.stem is not None and not fit_stem(q.stem):
        return False
    if q.kind in ("list", "tf"):
        return q.answer == "True" if q.kind == "tf" else bool(q.answer)
    least, most = (1, 5) if q.kind == "fib" else (5, 30)
    return "\n" not in q.answer and least <= len(q.answer.split()) <= most


def shares(wanted: dict[str, int], total: int) -> dict[str, int]:
    """How many of each kind: as wanted, scaled down to the total if they are more, what rounding leaves to definitions."""
    target = {k: min(n, total) for k, n in wanted.items()}
    if (most := sum(target.values())) > total:
        target = {k: max(1, int(n * (total / most))) for k, n in target.items()}
        target["definition"] = target.get("definition", 0) + total - sum(target.values())
    return target


def drawn(kinds: dict[str, Iterator[Question]], wanted: dict[str, int] | None = None, total: int = 20) -> list[Question]:
    """Of each kind its share; then kinds with more to ask fill what others leave, in a fixed order; last, what isn't sane goes."""
    target = shares(WANTED if wanted is None else wanted, total)
    out = [q for kind, some in kinds.items() for q in islice(some, max(0, target.get(kind, 0)))]
    seen = {q.prompt for q in out}
    for kind in REFILL:
        for q in islice(kinds[kind], max(0, total - len(out))):
            if q.prompt not in seen and sane(q):
                seen.add(q.prompt)
                out.append(q)
    return [q for q in out[:total] if sane(q)]


def pooled(key: tuple, sentences: list[str]) -> tuple[list[Candidate], list[tuple], N.Scope]:
    """The candidates of a scope's good sentences in order, near duplicates gone, by centrality, hint and text; its bundles and its terms."""
    rows = list(map(keyed, dict.fromkeys(sentences)))
    kept = [rows[k][0] for k in N.distinct_sentences(rows)]
    lows = [s.lower() for s in kept]
    counts = [s.count(" ") + 1 for s in kept]
    columns = [list(range(len(kept))), kept, counts, [S.held(low, T.DEFINITION_CUES) for low in lows], [False] * len(kept)]
    scope, central = N._central(key, columns)
    pool = [Candidate(s, low, n, hint(s, low, defines), c, top) for s, low, n, defines, (c, _, top) in zip(kept, lows, *columns[2:4], central)]
    return sorted(pool, key=lambda c: (-c.central, -c.hint, c.s)), N.bundled(key, columns, scope, central, n_sentences=0), scope


def exam(key: tuple, sentences: list[str], wanted: dict[str, int] | None = None, total: int = 20, labels: bool = False) -> list[Question]:
    """The questions of one scope. labels: stems are validated with their labels, whose colons let no blank, statement or enumeration pass, as in the reference."""
    pool, bundles, scope = pooled(key, sentences)
    kinds = {
        "definition": definitions(pool, lambda k: 0.0 if None in key else scope.score(k)), "fib": blanks(pool, {t for _, _, terms, _ in bundles for t in terms}, labels),
        "tf": statements(pool, labels), "short": reasons(pool), "list": lists(pool, bundles, labels),
    }
    return drawn(kinds, wanted, total)


def exams(good: DataFrame, by: list[str]) -> DataFrame:
    """good (by, pos, s): squeezed sentences that pass the quality filters -> (by, place, kind, prompt, answer)."""

    def fold(key, columns):
        return [(k + 1, q.kind, q.prompt, q.answer) for k, q in enumerate(exam(key, *columns))]

    rows = good.select(*by, "pos", "s").repartition(*by).sortWithinPartitions(*by, "pos", "s").select(*by, "s")
    return N.folded(rows, by, fold, "place int, kind string, prompt string, answer string")
