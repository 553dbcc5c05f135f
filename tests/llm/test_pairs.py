import hashlib
import random
import re
import time
from datetime import datetime, timedelta

import numpy as np

from marginalia.llm import embed_dedup, fingerprint, license_scan, url_filter
from marginalia.llm.common import shingles
from marginalia.llm.components import union_find

# Embeddings


def brute_vectors(rows, least=0.9):
    """The result for rows (id, vector) of one length, by all pairs."""
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    d = max(len(v) for v, k in zip((r[1] for r in rows), ok) if k)
    x = np.array([v if k else [0.0] * d for (_, v), k in zip(rows, ok)])
    n = np.linalg.norm(x, axis=1)
    c = x @ x.T / np.outer(np.where(n == 0, 1, n), np.where(n == 0, 1, n))
    link = (c >= least) & ~np.eye(len(rows), dtype=bool)
    ids = np.array([r[0] for r in rows])
    order = np.argsort(ids)
    back = np.empty(len(ids), int)
    back[order] = np.arange(len(ids))
    i, j = np.nonzero(link)
    root = union_find(back[i], back[j], len(ids))
    component = ids[order][root[back]]
    return {int(a): (int(m), int(c)) for a, m, c in zip(ids, link.sum(axis=1), component)}


def vectors(seed=0, n=700, d=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    v = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.3, 0.6], (n, 1))
    v[100:160] = v[100]  # a large group of equal vectors
    v[200:210] = v[200] * np.arange(1, 11)[:, None]
    rows = [(int(i), [float(np.float32(x)) for x in row]) for i, row in zip(rng.permutation(5 * n)[:n], v)]
    return rows + [(90001, None), (90002, [0.0] * d), (90003, [float("nan")] * d), (90004, [None] + [1.0] * (d - 1)), (90005, [float("inf")] + [0.0] * (d - 1)), (90006, [])]


def run_vectors(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, n_links long").repartition(4)
    out = embed_dedup.near_vectors(df, **kw).collect()
    assert len(out) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in out)
    return {r.vec_id: (r.n_links, r.component_id) for r in out}


def test_vectors_against_all_pairs(spark):
    rows = vectors()
    assert run_vectors(spark, rows) == brute_vectors(rows)


def test_vectors_against_all_pairs_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 24)
    rows = vectors(3)
    assert run_vectors(spark, rows, least=0.8) == brute_vectors(rows, 0.8)


def test_products_stop_early_but_miss_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 40)) * np.linspace(3, 0.1, 40)
    x /= np.linalg.norm(x, axis=1)[:, None]
    for least in (0.3, 0.9, 0.99):
        i, j = embed_dedup.close_pairs(x, x, least)
        assert set(zip(*np.nonzero(x @ x.T >= least))) <= set(zip(i, j))
        assert ((x[i] * x[j]).sum(axis=1) >= least - 1e-6).all()


def test_vectors_of_different_lengths_repeated_ids_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embed_dedup.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 0, 2, True), (3, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False), (None, 0, None, True)], key=str)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


# Fingerprints


def test_edits_against_a_plain_version(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randrange(200))) for _ in range(60)] + [None, "", "é", "x" * 40_000, texts_end := "one two three four five six seven"]
    rows = [(r.randrange(10**6) - 500_000, t) for t in texts]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, slice string").repartition(5)
    got = {x.doc_id: x for x in fingerprint.fingerprints_with_edits(df).collect()}
    rows.sort()
    of = lambda t: shingles(fingerprint.spaced(t))
    assert len(got) == len(rows) and texts_end
    for k, (i, t) in enumerate(rows):
        a, b = t or "", rows[(k + 1) % len(rows)][1] or ""
        c = len(a) // 4
        e = a[: len(a) - c] + b[:c]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        assert x.fingerprint == fingerprint.to_text(of(a)[: fingerprint.K]) and x.edited_fingerprint == fingerprint.to_text(of(e)[: fingerprint.K])
        for other, near in ((e, x.near_edited), (b, x.near_next)):
            s, t2 = set(of(a).tolist()), set(of(other).tolist())
            true = len(s & t2) / len(s | t2) if s | t2 else 1.0
            assert abs(true - near) <= (0 if len(s | t2) <= fingerprint.K else 0.2)


def test_edits_of_repeated_null_and_single_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "abcdefgh"), (2, "c")], "doc_id long, text string").repartition(3)
    assert fingerprint.fingerprints_with_edits(df).count() == 4
    alone = fingerprint.fingerprints_with_edits(df.where("doc_id = 2")).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(2, 1.0)]
    assert fingerprint.fingerprints_with_edits(df.limit(0)).count() == 0


def test_sketches_merge_and_estimate(spark):
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 2**63, 9000).astype(np.uint64) * np.uint64(2)) for _ in range(2))
    b = np.union1d(b[:3000], a[:3000:1])
    k = fingerprint.K
    sa, sb = a[:k], b[:k]
    assert (fingerprint.merge(sa, sb) == np.union1d(a, b)[:k]).all()
    assert abs(fingerprint.distinct(sa) / len(a) - 1) < 0.3
    parts = spark.createDataFrame([(i % 3, fingerprint.to_text(np.sort(a[i::30])[:k])) for i in range(30)], "part int, fingerprint string").repartition(4)
    for r in fingerprint.merged(parts, "part").collect():
        assert r.fingerprint == fingerprint.to_text(np.unique(np.concatenate([a[i::30] for i in range(r.part, 30, 3)]))[:k])
    assert fingerprint.resemblance(sa, sa) == 1.0 and fingerprint.containment(np.empty(0, np.uint64), sb) == 1.0


def test_texts_without_spaces_have_shingles_of_characters(spark):
    r = random.Random(1)
    chinese = "".join(chr(r.randrange(0x4E00, 0x5E00)) for _ in range(560))
    other = "".join(chr(r.randrange(0x5E00, 0x6E00)) for _ in range(560))
    got = {x.doc_id: x for x in fingerprint.fingerprints_with_edits(spark.createDataFrame([(1, chinese), (2, other), (3, chinese)], "doc_id long, text string")).collect()}
    assert 0.4 < got[1].near_edited < 0.8 and got[1].near_next < 0.1 and got[1].fingerprint == got[3].fingerprint
    assert fingerprint.spaced("short words stay " + "x" * 32) == "short words stay " + "x" * 32


def test_fingerprints_of_rows_with_null_keys_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "k"), (1, "a b c d e f", "k"), (None, "a b c d e f", None), (2, None, None), (3, "", "k"), (4, "w " * 300_000, "k")], "doc_id long, text string, fingerprint string")
    rows = fingerprint.fingerprints(df).collect()
    assert sorted((r.doc_id or 0, r.n_distinct) for r in rows) == [(0, 2.0), (1, 2.0), (1, 2.0), (2, 0.0), (3, 0.0), (4, 1.0)]
    assert len({r.fingerprint for r in rows if r.doc_id in (1, None)}) == 1
    parts = fingerprint.fingerprints(df).union(spark.createDataFrame([(None, None, 0.0)], "doc_id long, fingerprint string, n_distinct double"))
    whole = {r.doc_id: fingerprint.from_text(r.fingerprint) for r in fingerprint.merged(parts, "doc_id").collect()}
    assert {k: len(v) for k, v in whole.items()} == {1: 2, None: 2, 2: 0, 3: 0, 4: 1}
    assert fingerprint.merged(parts.limit(0), "doc_id").count() == 0 and fingerprint.fingerprints(df.limit(0)).count() == 0


# Licences


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_alignment_rises_and_is_no_longer_than_the_longest_common_subsequence():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.choice("abcdefghijklmnop") for _ in range(r.randrange(25))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
    assert len(license_scan.rising([(0, 3), (1, 1), (2, 2), (3, 9), (4, 4)])) == 3


def test_alignment_of_distinct_words_is_the_longest_there_is():
    r = random.Random(6)
    for _ in range(200):
        a, b = (r.sample(range(40), r.randrange(30)) for _ in range(2))
        assert len(license_scan.align(a, b)) == lcs(a, b)


def plain_align(a, b):
    """Patience alignment as it is defined, by recursion and a search over all rising subsets of few anchors."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a2, b2 = a[head : len(a) - tail], b[head : len(b) - tail]
    anchors = [(i, b2.index(w)) for i, w in enumerate(a2) if a2.count(w) == 1 and b2.count(w) == 1]
    best = [[]]
    for p in anchors:
        best += [x + [p] for x in best if not x or x[-1][1] < p[1]]
    most = max(map(len, best))
    if not most:
        return {head + tail}
    sizes = set()
    for chain in (x for x in best if len(x) == most):
        totals = {head + tail + most}
        i = k = 0
        for x, y in [*chain, (len(a2), len(b2))]:
            inner = plain_align(a2[i:x], b2[k:y])
            totals = {t + n for t in totals for n in inner}
            i, k = x + 1, y + 1
        sizes |= totals
    return sizes


def test_alignment_against_its_definition():
    r = random.Random(9)
    for _ in range(300):
        a, b = ([r.choice("abcdefghijkl") for _ in range(r.randrange(11))] for _ in range(2))
        assert len(license_scan.align(a, b)) in plain_align(a, b)


def test_every_template_is_found_with_changes_and_repeats():
    templates = license_scan._templates(tuple(sorted(license_scan.TEMPLATES.items())), 75)
    r = random.Random(4)
    for t in templates:
        w = list(t.words)
        for at in r.sample(range(len(w)), (len(w) - t.need) // 2):
            w[at] = f"new{at}"
        noise = [f"n{k}" for k in range(500)]
        for text, least in ((w, len(w) - (len(w) - t.need) // 2), (noise + w + noise, 0), (w + w + w, 0), ((noise + w) * 3, 0)):
            places = {}
            for k, x in enumerate(text):
                places.setdefault(x, []).append(k)
            found = t.best(text, places)
            assert found and found[0] >= max(t.need, least), (t.name, found, t.need)
            assert 0 <= found[1] < found[2] <= len(text)


def test_a_long_text_of_marks_takes_little_time():
    templates = license_scan._templates(tuple(sorted(license_scan.TEMPLATES.items())), 75)
    r = random.Random(4)
    marks = sorted(set().union(*(t.marks for t in templates)))
    begun = time.process_time()
    assert license_scan.scan_text(" ".join(r.choice(marks) for _ in range(200_000)), templates) is not None
    assert time.process_time() - begun < 30


def test_planted_licences_are_found(spark):
    r = random.Random(5)
    noise = [f"w{k}" for k in range(300)]
    rows, want = [], {}
    for k, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        w = text.split()
        for at in range(0, len(w), 25):
            w[at] = w[at] if len(w) < 30 else "changed"
        before, after = (" ".join(r.choice(noise) for _ in range(400)) for _ in range(2))
        rows.append((k, f"{before} {' '.join(w)} {after}"))
        want[k] = name
    rows += [(100, None), (101, ""), (102, " ".join(noise)), (103, "license " * 20000), (104, license_scan.TEMPLATES["MIT"] + " " + license_scan.TEMPLATES["MIT"])]
    df = spark.createDataFrame([(i, t, "l") for i, t in rows], "doc_id long, text string, license string")
    got = {x.doc_id: x for x in license_scan.scan(df).collect()}
    for k, name in want.items():
        assert name in got[k].licenses.split(",")
        assert got[k].coverage >= 0.75 and got[k].first_word >= 390
    assert [got[i].license for i in (100, 101, 102, 103)] == [None] * 4 and got[104].license == "MIT"
    assert license_scan.scan(df.limit(0)).count() == 0


# URL lists


def test_entries_at_the_time_of_the_fetch(spark, monkeypatch):
    day = lambda n: datetime(2024, 1, n)
    entries = [("ads", "Bad.example.com", day(2), True), ("ads", "bad.example.com", day(5), False), ("ads", "bad.example.com", day(5), False), ("ads", "bad.example.com", day(8), True), ("ads", "bad.example.com", day(9), True),
               ("path", "ok.example.com/en", day(3), True), ("never", "x.org", day(4), False), (None, "x.org", day(1), True)]
    e = spark.createDataFrame(entries, "list string, pattern string, at timestamp, added boolean")
    rows = [(1, "http://a.bad.example.com/x", day(1)), (2, "http://a.bad.example.com/x", day(2)), (3, "https://u@BAD.example.com:80/x", day(4)), (4, "http://bad.example.com", day(5)), (5, "http://bad.example.com", day(20)), (6, "http://ok.example.com/en/1", day(9)),
            (7, "http://ok.example.com/de/1", day(9)), (8, None, day(9)), (9, "no url", day(9)), (10, "http://bad.example.com", None), (2, "http://a.bad.example.com/x", day(2)), (11, "http://x.org/", day(9))]
    c = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, fetched_at timestamp, lists string")
    want = [(1, False), (2, True), (2, True), (3, True), (4, False), (5, True), (6, True), (7, False), (8, False), (9, False), (10, False), (11, False)]
    for most in (200_000, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_PIECES", most)
        got = url_filter.evaluate(c, e).collect()
        assert sorted((r.id, r.blocked) for r in got) == want
        assert {r.lists for r in got if r.blocked} == {"ads", "path"}
    monkeypatch.undo()
    assert url_filter.evaluate(c.limit(0), e).count() == 0 and not any(r.blocked for r in url_filter.evaluate(c, e.limit(0)).collect())


def plain_blocks(captures, entries):
    """(id, lists, n_entries, listed_since) of each capture, by a walk over all events."""
    spans = {}
    events = {}
    for name, pattern, at, added in entries:
        if None in (name, pattern, at, added):
            continue
        host, slash, path = pattern.strip().partition("/")
        key = (name, host.lower().rstrip(".") + (slash + path).rstrip("/"))
        events.setdefault(key, {}).setdefault(at, set()).add(added)
    for key, by_time in events.items():
        on = None
        for at in sorted(by_time):
            if True in by_time[at] and on is None:
                on = at
            elif True not in by_time[at] and on is not None:
                spans.setdefault(key, []).append((on, at))
                on = None
        if on is not None:
            spans.setdefault(key, []).append((on, None))
    out = []
    for i, url, at in captures:
        found = []
        if url and at and "://" in url:
            rest = url.strip().split("://", 1)[1]
            place = re.split("[/?#]", rest)[0].rpartition("@")[2]
            host = (place[: place.index("]") + 1] if place.startswith("[") else place.split(":")[0]).lower().rstrip(".")
            labels = host.split(".")
            address = place.startswith("[") or len(labels) == 4 and all(x.isdigit() for x in labels)
            keys = {host} | (set() if address else {".".join(labels[k:]) for k in range(len(labels) - 1)})
            tail = re.match("[^/?#]+/([^/?#]+)", rest)
            keys |= {f"{host}/{tail[1]}"} if tail else set()
            found = [(name, since) for (name, p), all_of in spans.items() if p in keys for since, until in all_of if since <= at and (until is None or at < until)]
        out.append((i, ",".join(sorted({n for n, _ in found})), len(found), min((s for _, s in found), default=None)))
    return sorted(out, key=str)


def test_blocks_against_a_walk_over_all_events(spark, monkeypatch):
    r = random.Random(8)
    hosts = ["h.org", "H.org", "a.h.org", "A.B.h.org", "1.2.3.4", "3.4", "[::1]", "localhost", "x.co.uk", "h.org."]
    paths = ["", "/", "/Foo", "/foo", "/foo/bar", "/Foo?x=1", "?q=/z", "#f"]
    moment = lambda: datetime(2024, 1, 1) + timedelta(hours=r.randrange(24 * 200))
    moments = [moment() for _ in range(40)]  # few, so that events and fetches meet at one time
    entries = [(r.choice(["p", "q", "s", None]), r.choice(hosts) + r.choice(["", "", "/Foo", "/foo", "/foo/"]), r.choice(moments), r.random() < 0.6) for _ in range(300)] + [("p", None, moments[0], True), ("p", "h.org", None, True), ("p", "h.org", moments[0], None)]
    rows = [(k % 350, f"{r.choice(['http', 'HTTPS'])}://{r.choice(['', 'u:p@'])}{r.choice(hosts)}{r.choice(['', ':80'])}{r.choice(paths)}", r.choice([*moments, moment()])) for k in range(400)]
    rows += [(900, "http://h.org/" + "x" * 300_000, moments[0]), (901, " ", moments[0]), (902, "h.org/Foo", moments[0])]
    c = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp")
    e = spark.createDataFrame(entries, "list string, pattern string, at timestamp, added boolean")
    want = plain_blocks(rows, entries)
    assert sum(n > 0 for _, _, n, _ in want) > 50
    for most in (200_000, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_PIECES", most)
        assert sorted(((x.id, x.lists, x.n_entries, x.listed_since) for x in url_filter.evaluate(c, e).collect()), key=str) == want


def test_the_cases_that_lists_and_urls_differ_in(spark):
    day = lambda n: datetime(2024, 1, n)
    entries = [("l", "h.org/Foo", day(1), True), ("l", "Bad.org", day(1), True), ("l", "bad.org", day(3), False), ("l", "3.4", day(1), True)]
    rows = [(1, "http://H.ORG/Foo/x", day(5)), (2, "http://h.org/foo", day(5)), (3, "http://bad.org/", day(5)), (4, "http://bad.org/", day(2)), (5, "http://1.2.3.4/x", day(5))]
    got = url_filter.evaluate(spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp"), spark.createDataFrame(entries, "list string, pattern string, at timestamp, added boolean"))
    assert {r.id: r.blocked for r in got.collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
