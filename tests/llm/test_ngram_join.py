import random

import numpy as np

from marginalia.llm import ngram_join as nj
from marginalia.llm.components import components


def brute(rows, percent=75):
    """doc_id -> (n_shingles, component) by all pairs."""

    def shingles(text):
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def texts(seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [r.choice(words) for _ in range(70)]
    out = []
    for k in range(60):
        base = [r.choice(words) for _ in range(r.choice((3, 5, 8, 30, 120, 400)))]
        if k % 4 == 0:
            base = base + passage
        out.append(base)
        for _ in range(r.choice((0, 0, 1, 3))):
            c = list(base)
            for _ in range(max(1, len(c) // 60)):
                c[r.randrange(len(c))] = r.choice(words)
            out.append(c)
    rows = [(i * 3 % 1009, " ".join(t)) for i, t in enumerate(out)]
    near = [r.choice(words) for _ in range(200)]
    for k in range(150):  # a large group of near copies, all of different text
        c = list(near)
        c[r.randrange(200)] = f"x{k}"
        rows.append((2000 + k, " ".join(c)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "One"), (5004, "one"), (5005, "Élan one"), (5006, "élan one"), (5007, "a b")]
    rows += [(6000 + k, rows[0][1].upper()) for k in range(30)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = nj.near_duplicates(df, **kw).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}, len(out)


def test_against_all_pairs(spark, monkeypatch):
    rows = texts()
    got, n = run(spark, rows)
    assert n == len(rows)
    assert got == brute(rows)


def test_against_all_pairs_with_small_tiles_and_lists(spark, monkeypatch):
    rows = texts(5)
    monkeypatch.setattr(nj, "TILE", 16)
    got, _ = run(spark, rows, percent=60)
    assert got == brute(rows, 60)


def test_documents_of_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got, _ = run(spark, rows)
    assert got == brute(rows)


def test_empty_table_extra_columns_null_and_repeated_ids(spark):
    assert run(spark, [])[1] == 0
    df = spark.createDataFrame([(1, "a b c d e f", 7, 1), (1, "a b c d e f", 8, 1), (None, "a b c d e f", 9, 1)], "doc_id long, text string, component_id int, n long")
    out = sorted(map(tuple, nj.near_duplicates(df).collect()), key=str)
    assert out == [(1, 2, 1), (1, 2, 1), (None, None, None)]


def test_tree_join_finds_all_that_the_bounds_allow():
    rng = np.random.default_rng(0)
    for n in (1, 2, 17, 300):
        points = rng.poisson(rng.choice([2, 3, 5], (n, 1)), (n, 16)).astype(np.int64)
        sizes, labels = points.sum(axis=1), rng.integers(0, max(1, n // 3), n)
        want = {
            (i, j) for i in range(n) for j in range(i + 1, n)
            if labels[i] != labels[j] and 100 * min(sizes[i], sizes[j]) >= 75 * max(sizes[i], sizes[j]) and np.minimum(points[i], points[j]).sum() >= nj.need(sizes[i], sizes[j], 75)
        }
        assert {tuple(p) for p in nj.CountTree(points, sizes, labels).pairs(75).tolist()} == want


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(500), r.randrange(500)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(3000, 3001 + i) for i in range(50)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
