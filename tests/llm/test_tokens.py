import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from marginalia.llm import bpe, packing, token_counts

PATH = bpe.default_vocabulary()
PIECES = ["a", " ", "  ", "\n", "the", "ing", "'s", "'", "é", "ß", "<|endoftext|>", "<|", "12", "!!", "...", "漢", "🙂", "́", "aaaaaaa", "\t", "xyz", " a", " ", " "]
LONG = ["a" * 30_000, "ab" * 9_000, " " * 5_000, "word " * 6_000]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(30))) for _ in range(1500)] + LONG + ["", None]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def frame(spark, texts):
    return spark.createDataFrame([(i // 2 if i > 20 else i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, piece long").repartition(3)


def test_automaton_gives_the_librarys_ids_and_decodes_them(library, texts):
    e = bpe.Encoder(PATH)
    for t in texts:
        want = ids(library, t)
        assert e.encode(t or "").tolist() == want
        assert e.decode(want) == library.decode(want, skip_special_tokens=False) == (t or "")


def test_automaton_accepts_only_what_the_merges_give():
    a = bpe.automaton(PATH)
    r = random.Random(2)
    labels = [label for label in a.arcs if len(label) <= 4]
    for _ in range(3000):
        u, v = r.choice(labels), r.choice(labels)
        first, second = a.arcs[u], a.arcs[v]
        assert a.reads(a.to[first], second) == (a.encode(u + v) == [first, second])


def test_merging_counts_as_the_library(library, texts):
    assert token_counts.Counter(PATH).counts(texts) == [len(ids(library, t)) for t in texts]


def test_merging_overlapping_pairs():
    v = bpe.vocabulary(PATH)
    pairs = token_counts.PairRanks(v.merges)
    a = bpe.automaton(PATH)
    words = [b"a" * n for n in range(40)] + [b"aab" * n for n in range(9)]
    assert token_counts.merge_counts(words, v.bytes, pairs).tolist() == [len(a.encode(w)) for w in words]


def test_counts_and_round_trips_of_rows(spark, library, texts):
    some = texts[:60] + texts[-6:]
    rows = token_counts.token_counts(frame(spark, some)).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((len((t or "").encode()), len(ids(library, t)), len(ids(library, t)) > 512) for t in some)
    trips = bpe.round_trips(frame(spark, some)).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in trips) == sorted((len(ids(library, t)), digest(",".join(map(str, ids(library, t)))), digest(t or "")) for t in some)
    back = bpe.decode_ids(bpe.encode_texts(frame(spark, some))).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for t in some)


def test_packing_encodes_as_the_library(library, texts):
    encode = packing._encoding(PATH)
    assert all(encode(t or "").tolist() == ids(library, t) for t in texts)


def check_packing(rows, docs, library, capacity):
    """docs: list of texts; rows carry all their pieces."""
    want = {}
    for t in docs:
        a = np.array(ids(library, t) + [2], "<u4")
        first = len(a) % capacity or capacity
        cuts = [0, *range(first, len(a) + 1, capacity)]
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            key = (k, x, y - x, zlib.crc32(a[x:y].tobytes()))
            want[key] = want.get(key, 0) + 1
    got, bins = {}, {}
    for r in rows:
        key = (r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_rows(spark, library, texts):
    some = texts[:200] + texts[-6:]
    rows = packing.pack(frame(spark, some), capacity=64).collect()
    used = check_packing(rows, some, library, 64)
    total = sum(len(ids(library, t)) + 1 for t in some)
    assert used <= -(-total // 64) + 3


def test_packing_of_a_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.collect()]
    used = check_packing(packing.pack(docs).collect(), texts, library, 1024)
    assert used <= -(-sum(len(ids(library, t)) + 1 for t in texts) // 1024) + 2


def smallest(sizes, capacity):
    """The least number of bins, by search over all assignments."""
    best = [len(sizes)]

    def go(k, room):
        if len(room) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(room)
            return
        for i in range(len(room)):
            if room[i] >= sizes[k] and room[i] not in room[:i]:
                go(k + 1, [*room[:i], room[i] - sizes[k], *room[i + 1 :]])
        go(k + 1, [*room, capacity - sizes[k]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    r = random.Random(1)
    for _ in range(60):
        sizes = sorted((r.randint(5, 60) for _ in range(r.randint(1, 11))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        found = packing.complete_bins(counts, 100)
        got = {}
        for filling, times in found.plan:
            assert sum(filling) <= 100
            for s in filling:
                got[s] = got.get(s, 0) + times
        assert got == counts
        assert found.bins == sum(t for _, t in found.plan) and found.proved
        assert packing.lower_bound(counts, 100) == found.bound <= found.bins == smallest(sizes, 100)


def test_fillings_are_all_undominated_ones():
    r = random.Random(3)
    for _ in range(150):
        counts = {}
        for _ in range(r.randint(1, 9)):
            s = r.randint(2, 30)
            counts[s] = counts.get(s, 0) + 1
        gap, sizes = r.randint(1, 60), sorted(counts)
        every = {()}
        for s in sizes:
            every = {f + (s,) * n for f in every for n in range(counts[s] + 1) if sum(f) + s * n <= gap}
        left = lambda f, s: counts.get(s, 0) > f.count(s)
        want = set()
        for f in every:
            slack = gap - sum(f)
            longer = any(left(f, y) for x in {*f, 0} for y in range(x + 1, x + slack + 1))
            two = any(left(f, x + y) for k, x in enumerate(f) for y in f[k + 1 :])
            if not longer and not two:
                want.add(f)
        got = [tuple(sorted(f)) for f in packing.fillings(sizes, counts, gap)]
        assert len(got) == len(set(got)) and set(got) == want
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_bin_completion_betters_best_fit_where_it_wastes():
    r = random.Random(7)
    better = 0
    for _ in range(8):
        sizes = [x for _ in range(40) for a in [r.randint(200, 500)] for b in [r.randint(100, 400)] for x in (a, b, 1024 - a - b)]  # forty full bins
        counts = {s: sizes.count(s) for s in sizes}
        found = packing.complete_bins(counts, 1024, nodes=30_000)
        assert sum(found.plan and [t * sum(f) for f, t in found.plan]) == sum(sizes)
        assert 40 <= found.bins <= sum(t for _, t in packing.best_fit(counts, 1024))
        better += found.bins < sum(t for _, t in packing.best_fit(counts, 1024))
    assert better  # triples that fill bins exactly are the hardest: never worse, and better now and then


def test_the_packing_of_documents_is_proved_best(library):
    import pyarrow.parquet as pq

    encode, counts = packing._encoding(PATH), {}
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        n = len(encode(t or "")) + 1
        for k, times in ((n % 1024, 1), (1024, n // 1024)):
            if k and times:
                counts[k] = counts.get(k, 0) + times
    found = packing.complete_bins(counts, 1024)
    assert found.proved and found.bins == found.bound < sum(t for _, t in packing.best_fit(counts, 1024))


RUNS = [" " * 2_000_000, "\n" * 2_000_000, "a" * 300_000, "!" * 300_000, "a" + " " * 1_500_000 + "b", "\t" * 900_000 + "x"]


def test_very_long_runs(spark, library):
    """Packing, counts and round trips of runs that a pattern's look-ahead has to walk."""
    want = [ids(library, t) for t in RUNS]
    encode = packing._encoding(PATH)
    assert [encode(t).tolist() for t in RUNS] == want
    df = spark.createDataFrame(list(enumerate(RUNS)), "doc_id long, text string")
    assert packing.pack(df).groupBy("doc_id").sum("length").count() == len(RUNS)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()} == {k: len(x) for k, x in enumerate(want)}
    digest = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in bpe.round_trips(df).collect()} == {k: digest(x) for k, x in enumerate(want)}


def test_ids_of_null_keys_and_of_no_token(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (1, ""), (1, "a b")], "doc_id long, text string")
    rows = bpe.encode_texts(df).collect()
    assert sorted((r.id or 0, len(r.ids)) for r in rows) == [(0, 0), (0, 2), (1, 0), (1, 2)]
    ids = spark.createDataFrame([(None, [64, 10_000_000, -1]), (1, None), (2, []), (2, [64, None, 64])], "id long, ids array<int>")
    assert sorted((r.id or 0, str(r.text)) for r in bpe.decode_ids(ids).collect()) == [(0, "a"), (1, "None"), (2, ""), (2, "aa")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, rank long")
    for out in (token_counts.token_counts(none), bpe.round_trips(none), packing.pack(none), bpe.encode_texts(none)):
        assert out.count() == 0


def test_search_over_all_pieces_whatever_their_number():
    """Over 400 pieces of two lengths, above the bound: proved, as fillings are taken as often as they fit."""
    counts = {350: 1001, 341: 7}
    found = packing.complete_bins(counts, 1024)
    held = {}
    for filling, times in found.plan:
        assert sum(filling) <= 1024
        for s in filling:
            held[s] = held.get(s, 0) + times
    assert held == counts and found.bins == 503 and found.proved


def test_a_step_of_the_search_costs_what_it_changes():
    """40,000 pieces of nearly all lengths that fill 16,000 bins to the last token: many steps in a plan of thousands of fillings."""
    r, counts = random.Random(11), {}
    for _ in range(16_000):
        a = r.randint(520, 1000)
        b = 1024 - a
        for s in (a, b) if b < 100 or r.random() < 0.5 else (a, b - 50, 50):
            counts[s] = counts.get(s, 0) + 1
    bins = packing._Bins(packing.best_fit(counts, 1024), 1024)
    before, start = bins.n, time.process_time()
    for _ in range(3_000):
        bins.repack()
    assert time.process_time() - start < 20
    held = {}
    for filling, times in bins.plan():
        assert sum(filling) <= 1024 and times > 0
        for s in filling:
            held[s] = held.get(s, 0) + times
    assert held == counts and bins.n == sum(t for _, t in bins.plan()) < before
