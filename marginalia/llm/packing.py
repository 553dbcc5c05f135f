"""Best-fit packing by bin completion over a histogram of piece lengths.

Lengths are whole numbers of at most one sequence, so that any number of pieces is a table of at most `capacity`
counts: the search runs on that table and its size doesn't depend on the corpus. It fills a bin around the largest
length left with an undominated set of others, the least waste first; best-fit decreasing gives the first incumbent,
and branches whose waste can't beat the incumbent are cut. While the incumbent is over the lower bound, its wasteful
bins are taken apart and completed again. The plan, a list of fillings with multiplicities, is then dealt out to the
pieces by their rank within their length.
"""

from __future__ import annotations

import bisect
import logging
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, vocabulary
from .common import cut, shuffle_partitions, text_pieces, task

log = logging.getLogger(__name__)

Plan = list[tuple[tuple[int, ...], int]]


# The search


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by total length, and by the pieces over half a bin with what fits beside none of them."""
    total = sum(s * c for s, c in counts.items())
    best = -(-total // capacity)
    for k in {0, *(s for s in counts if 2 * s <= capacity)}:
        alone = sum(c for s, c in counts.items() if s > capacity - k)
        large = sum(c for s, c in counts.items() if capacity - k >= s > capacity // 2)
        room = large * capacity - sum(s * c for s, c in counts.items() if capacity - k >= s > capacity // 2)
        small = sum(s * c for s, c in counts.items() if k <= s <= capacity // 2)
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts: bins alike are one entry."""
    left: dict[int, dict[tuple[int, ...], int]] = {}  # room -> fillings
    rooms: list[int] = []  # sorted
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                fit = capacity // size
                whole, rest = divmod(n, fit)
                for filling, times in (((size,) * fit, whole), ((size,) * rest, 1)):
                    if filling and times:
                        _put(left, rooms, capacity - size * len(filling), filling, times)
                break
            room = rooms[at]
            filling, times = left[room].popitem()
            if not left[room]:
                del left[room], rooms[at]
            fit = min(room // size, n)
            use = min(times, n // fit)
            if use < times:
                _put(left, rooms, room, filling, times - use)
            _put(left, rooms, room - fit * size, filling + (size,) * fit, use)
            n -= use * fit
    return [(filling, times) for by in left.values() for filling, times in by.items()]


def _put(left, rooms, room, filling, times):
    if room not in left:
        left[room] = {}
        bisect.insort(rooms, room)
    left[room][filling] = left[room].get(filling, 0) + times


class Left:
    """Pieces left by length, and which sums those of the first k lengths reach; a step costs what it changes of these, not all anew."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity = dict(counts), capacity
        self.sizes = sorted(counts)
        self.reach = [1]  # reach[k]: the sums of pieces of the first k sizes, as bits; as far as known
        self.whole = (1 << capacity + 1) - 1

    def _change(self, size: int, by: int) -> None:
        before = self.counts.get(size, 0)
        self.counts[size] = after = before + by
        fit = self.capacity // size
        if min(before, fit) != min(after, fit):
            k = bisect.bisect_left(self.sizes, size)
            if not before:
                self.sizes.insert(k, size)
            elif not after:
                del self.sizes[k]
            del self.reach[k + 1 :]

    def take(self, filling: tuple[int, ...], times: int = 1) -> None:
        for s in filling:
            self._change(s, -times)

    def put(self, filling: tuple[int, ...], times: int = 1) -> None:
        for s in filling:
            self._change(s, times)

    def largest(self) -> int:
        """The largest length left, 0 if there is none."""
        return self.sizes[-1] if self.sizes else 0

    def times(self, filling: tuple[int, ...]) -> int:
        """How often the pieces left make a filling."""
        return min(self.counts[s] // filling.count(s) for s in set(filling))

    def _know(self, k: int) -> None:
        """Work reach out up to the first k sizes."""
        for s in self.sizes[len(self.reach) - 1 : k]:
            sums, n = self.reach[-1], min(self.counts[s], self.capacity // s)
            step = 1
            while n > 0:  # n copies as one, two, four ... and the rest
                use = min(step, n)
                sums |= sums << s * use & self.whole
                n, step = n - use, 2 * step
            self.reach.append(sums)

    def fillings(self, gap: int, waste: int) -> Iterator[tuple[int, ...]]:
        """Every undominated filling of a gap of at most so much waste, the least waste first, of equal waste those of the largest members first.

        A filling is dominated if another piece still fits, a member can give way to a longer piece that is left
        over, or two members can give way to one piece as long as both. Fillings are made when asked for; sums that
        no pieces reach are never tried. Between two of them pieces may be taken if they are put back.
        """
        sizes, counts, reach = self.sizes, self.counts, self.reach
        most = bisect.bisect_right(sizes, gap)

        def made(k, target, chosen, waste):
            """The undominated ways to end a filling with a sum of the first k sizes. What dominates a member is longer, so that the longer ones chosen decide."""
            left = lambda s: counts.get(s, 0) - chosen.count(s) > 0
            if not target:
                if not any(map(left, sizes[: bisect.bisect_right(sizes, waste)])):
                    yield chosen
                return
            for i in range(bisect.bisect_right(sizes, target, 0, k) - 1, -1, -1):
                if not reach[i + 1] >> target & 1:
                    return
                s = sizes[i]
                if any(left(x + s) for x in chosen) or waste and any(map(left, sizes[i + 1 : bisect.bisect_right(sizes, s + waste)])):
                    continue
                for n in range(min(counts[s], target // s, 1 if left(2 * s) else target), 0, -1):
                    if reach[i] >> target - n * s & 1:
                        yield from made(i, target - n * s, chosen + (s,) * n, waste)

        target = gap
        while target >= gap - waste:
            self._know(most)
            target = (reach[most] & (1 << target + 1) - 1).bit_length() - 1  # the next sum that is reached
            if target < gap - waste:
                return
            for chosen in made(most, target, (), gap - target):
                yield chosen
                self._know(most)
            target -= 1

    def around_largest(self, waste: int | None = None) -> Iterator[tuple[int, ...]]:
        """The undominated bins around the largest piece left, those of at most so much waste."""
        first = (self.largest(),)
        gap = self.capacity - first[0]
        options = self.fillings(gap, gap if waste is None else min(gap, waste))
        while True:
            self.take(first)
            filling = next(options, None)
            self.put(first)
            if filling is None:
                return
            yield first + filling


def fillings(sizes: list[int], counts: dict[int, int], gap: int) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of a gap with pieces of these sizes."""
    return Left({s: counts[s] for s in sizes}, gap).fillings(gap, gap)


def dive(counts: dict[int, int], capacity: int) -> Plan:
    """The packing of the first filling of each bin, used as often as the counts allow."""
    plan: Plan = []
    left = Left(counts, capacity)
    while left.largest():
        filling = next(left.around_largest())
        times = left.times(filling)
        plan.append((filling, times))
        left.take(filling, times)
    return plan


def branch_and_bound(counts: dict[int, int], capacity: int, fewest: int, nodes: int) -> tuple[Plan | None, bool, int]:
    """(a packing in under `fewest` bins or None, whether the search ended by itself, nodes visited).

    Depth first over the undominated fillings around the largest piece left, each as often as the counts allow and
    once, so that a path is as long as there are fillings, not pieces; a branch ends when its waste leaves no room
    for a better packing. Ended by itself, None proves that there is none.
    """
    total, spent = sum(s * c for s, c in counts.items()), 0
    most = (fewest - 1) * capacity - total  # waste that a better packing may have
    if most < 0:
        return None, True, 0
    path: Plan = []
    left = Left(counts, capacity)
    states = [(0, _repeated(left, most))]
    while states:
        waste, options = states[-1]
        filling, times = next(options, (None, 0))
        if filling is None:
            states.pop()
            if path:
                left.put(*path.pop())
            continue
        spent += 1
        lost = times * (capacity - sum(filling))
        if waste + lost <= most:
            path.append((filling, times))
            left.take(filling, times)
            if not left.largest():
                return path, True, spent
            states.append((waste + lost, _repeated(left, most - waste - lost)))
        if spent >= nodes:
            return None, False, spent
    return None, True, spent


def _repeated(left: Left, waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """The bins around the largest piece left that waste no more, each as often as the counts allow and once."""
    for filling in left.around_largest(waste):
        times = left.times(filling)
        yield filling, times
        if times > 1:
            yield filling, 1


def _merged(bins) -> Plan:
    plan: dict[tuple[int, ...], int] = {}
    for filling, times in bins:
        key = tuple(sorted(filling, reverse=True))
        plan[key] = plan.get(key, 0) + times
    return [(f, t) for f, t in plan.items() if t]


class Packed(NamedTuple):
    plan: Plan
    bins: int
    bound: int
    proved: bool  # that no packing has fewer bins


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 320_000) -> Packed:
    """A packing in few bins, the bound, and whether it is known to be the best.

    The better of best-fit decreasing and the first dive of bin completion is the incumbent. If it is over the bound
    a search over all pieces, however many, tries to better it or to prove it; then bins of the incumbent, the wasteful ones and
    some others, are taken apart and packed again by the same search, so that waste gathers in ever fewer bins until
    one is left over. The problem is NP-hard: `nodes` bounds the work, what is not settled by then is reported as
    not proved. Every packing on the way holds all pieces.
    """
    counts = {s: c for s, c in counts.items() if c > 0}
    if not counts:
        return Packed([], 0, 0, True)
    size = lambda plan: sum(t for _, t in plan)
    plan = min((_merged(best_fit(counts, capacity)), _merged(dive(counts, capacity))), key=size)
    least = lower_bound(counts, capacity)
    if size(plan) > least:
        bins, ended, spent = branch_and_bound(counts, capacity, size(plan), nodes // 16)
        nodes -= spent
        while bins:
            plan = _merged(bins)
            bins, ended, spent = branch_and_bound(counts, capacity, size(plan), nodes // 16) if size(plan) > least else (None, True, 0)
            nodes -= spent
        if ended:
            return Packed(plan, size(plan), least, True)
    bins = _Bins(plan, capacity)
    while bins.n > least and nodes > 0:
        nodes -= bins.repack()
    plan = bins.plan()
    return Packed(plan, size(plan), least, size(plan) == least)


class _Bins:
    """A plan whose bins are taken apart and packed again some at a time; a step costs what it changes, whatever the plan's length."""

    def __init__(self, plan: Plan, capacity: int):
        self.capacity, self.rng = capacity, np.random.default_rng(0)
        self.times = dict(plan)
        self.n = sum(self.times.values())
        self.known = list(self.times)  # every filling met, also those gone
        self.place = {f: k for k, f in enumerate(self.known)}
        self.weights = np.array([self._weight(f) for f in self.known], float)  # of wasteful ones, by which they are drawn

    def _weight(self, filling: tuple[int, ...]) -> int:
        waste = self.capacity - sum(filling)
        return waste + 1 if waste else 0

    def plan(self) -> Plan:
        return [(f, t) for f, t in self.times.items() if t]

    def _add(self, filling: tuple[int, ...], by: int) -> None:
        if filling not in self.place:
            self.place[filling] = len(self.known)
            self.known.append(filling)
            if len(self.known) > len(self.weights):
                self.weights = np.concatenate([self.weights, np.zeros(len(self.weights) + 1)])
        t = self.times[filling] = self.times.get(filling, 0) + by
        self.weights[self.place[filling]] = self._weight(filling) if t else 0
        self.n += by

    def _drawn(self) -> list[tuple[int, ...]]:
        """Up to six wasteful fillings, the likelier the more they waste, and some others of several pieces."""
        rng, taken = self.rng, {}
        sums = np.cumsum(self.weights)
        for x in rng.random(int(rng.integers(2, 7))):
            taken[self.known[min(int(np.searchsorted(sums, x * sums[-1], side="right")), len(self.known) - 1)]] = None
        for k in rng.integers(0, len(self.known), int(rng.integers(2, 12))).tolist():
            if len(self.known[k]) > 1:
                taken[self.known[k]] = None
        return [f for f in taken if self.times[f]]

    def repack(self) -> int:
        """Pack some bins again if that gathers their waste: the fullest k - 1 of k bins hold more than before. Gives the fillings looked at."""
        taken = self._drawn()
        counts: dict[int, int] = {}
        for f in taken:
            for s in f:
                counts[s] = counts.get(s, 0) + 1
        again, spent, waste, before = [], 1, 0, sorted((self.capacity - sum(f) for f in taken), reverse=True)
        left = Left(counts, self.capacity)
        while left.largest():  # a dive that now and then leaves the first filling
            options = left.around_largest()
            filling = next(options)
            for _ in range(int(self.rng.integers(0, 3))):
                other = next(options, None)
                spent += 1
                if other is None or waste + self.capacity - sum(other) >= sum(before):
                    break
                if sum(other) == sum(filling):
                    filling = other
            spent += 1
            again.append(filling)
            waste += self.capacity - sum(filling)
            left.take(filling)
        after = sorted((self.capacity - sum(f) for f in again), reverse=True)
        if len(again) < len(taken) or len(again) == len(taken) and after >= before and sum(w * w for w in after) >= sum(w * w for w in before):
            for f in taken:
                self._add(f, -1)
            for f in again:
                self._add(tuple(sorted(f, reverse=True)), 1)
        return spent


# Pieces


#: White space in a row from which a text goes to the library's own splitter: the pattern's look-ahead backtracks over the whole
#: run, which the compiled one gives up on at several hundred thousand.
LONG_SPACE = regex.compile(r"\s{20000}").search


@lru_cache(4)
def _library(path: str):
    """text -> ids by the library of the vocabulary's file; made only where a text needs it, as it takes some hundred MB."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(4)
def _encoding(path: str):
    """A function text -> ids (uint32) with a compiled library; both give the same ids where merged tokens are numbered by rank."""
    v = vocabulary(path)
    made = [m[2] for m in v.merges]
    if made != sorted(made) or len(v.ids) + len(v.special) != len(v.labels) or max(v.bytes) >= min(made):
        return _library(path)
    import tiktoken

    e = tiktoken.Encoding("packing", pat_str=_pattern(), mergeable_ranks=v.ids, special_tokens=v.special)
    return lambda text: _library(path)(text) if len(text) >= 20_000 and LONG_SPACE(text) else e.encode_to_numpy(text, allowed_special="all")


def _pattern() -> str:
    return r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _pieces(path, capacity, end):
    @task("packing")
    def run(batches):
        encode = _encoding(path)
        for batch in batches:
            for piece, texts in text_pieces(batch):
                rows = []
                for doc_id, text in zip(piece.column(0).to_pylist(), texts):
                    ids = np.append(encode(text) if text else np.empty(0, np.uint32), np.uint32(end)).astype("<u4")
                    stop = len(ids) % capacity or capacity
                    start = k = 0
                    while start < len(ids):
                        rows.append((doc_id, k, start, stop - start, zlib.crc32(ids[start:stop])))
                        start, stop, k = stop, stop + capacity, k + 1
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return run


def slots(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, first bin, times in a bin, offset of the first) in order of length and rank: where a piece of a length goes by its rank."""
    rows, ranks, first_bin = [], {}, 0
    for filling, times in plan:
        at = 0
        ordered = sorted(filling, reverse=True)
        for size in dict.fromkeys(ordered):
            n = ordered.count(size)
            rows.append((size, ranks.get(size, 0), first_bin, n, at))
            ranks[size] = ranks.get(size, 0) + n * times
            at += n * size
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(table):
    def run(batches):
        s = table.value
        keys = s[:, 0] << 48 | s[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = s[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A document is its ids and then `end`; a null or empty text is `end` alone. One longer than `capacity` is cut
    into pieces of that length, of which the first may be shorter. Sequences hold their pieces without gaps from
    offset 0. Rows that repeat an id, or have none, are packed like all others, each by itself. An empty table
    gives no rows. A text of any length is encoded whole, runs of millions of one character too. The number of
    sequences, the bound and whether the packing is proved best go to the log.
    """
    path = path or default_vocabulary()
    spark = docs.sparkSession
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(docs.mapInArrow(_pieces(path, capacity, end), kinds))
    # Ranks within a length: in buckets, so that no length meets in one task.
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * shuffle_partitions(spark))))
    per_bucket = cut(bucketed.groupBy("length", "bucket").count())  # at most capacity x buckets rows
    histogram = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    found = complete_bins(histogram, capacity)
    log.info("%d sequences, at least %d are needed; %s", found.bins, found.bound, "proved best" if found.proved else "not proved best")
    table = spark.sparkContext.broadcast(slots(found.plan))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.withColumn("k", F.row_number().over(within)).join(offsets, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(table), f"{kinds}, sequence_id long, offset long")
