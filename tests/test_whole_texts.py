"""Queries read whole texts: none of a document is left out."""

import hashlib
import re

from pyspark.sql import functions as F
from test_queries import SF

from marginalia import catalog
from marginalia.operators.structure import subchunks, word_windows
from marginalia.sources import tables


def test_all_documents_keep_their_texts(spark):
    docs = {r.doc_id: r.text for r in tables.table(spark, SF, "documents").collect()}
    chunks = {r.chunk_id: r.text for r in tables.chunks(spark, SF).collect()}
    lines = {}
    for r in sorted(tables.lines(spark, SF).collect()):
        lines.setdefault(r.doc_id, []).append(r.s)
    assert all(chunks[k].endswith(t) and "\n".join(lines[k]).endswith(t) for k, t in docs.items())


def test_hybrid_search_counts_shared_symbols(spark, tmp_path):
    docs = [(1, "alpha :: beta", "en"), (2, "alpha (beta)", "en"), (3, "alpha beta", "en"), (4, "gamma", "de")]
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("documents", docs, "doc_id long, text string, lang string")
    put("benchmark", [(1, "alpha :: (beta)"), (2, "alpha beta")], "item_id long, text string")
    put("embeddings", [(k, [1.0, 0.0]) for k in (1, 2, 3)], "vec_id long, embedding array<float>")
    got = {(r.q_id, r.doc): r.score for r in catalog.QUERIES["hybrid_search"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): 0.933333, (1, 2): 0.966667, (1, 3): 0.9, (2, 1): 0.9, (2, 2): 0.9, (2, 3): 0.9}


def test_windows_reach_the_last_word(spark):
    sizes = [0, 1, 999, 1000, 1001, 1900, 1901, 2000, 2800, 2801, 5184, 20000]
    docs = spark.createDataFrame([(n, " ".join(map(str, range(n)))) for n in sizes], "id long, text string")
    found = {}
    for r in word_windows(docs, "id", F.col("text")).orderBy("id", "chunk_index").collect():
        assert len(r.words) <= 1000 and r.words[:1] == [str(r.chunk_index * 900)][: r.id]
        found.setdefault(r.id, []).append(r)
    for n in sizes:
        assert {w for r in found[n] for w in r.words} == set(map(str, range(n)))
        assert [r.chunk_index for r in found[n]] == list(range(found[n][0].total_chunks))
        assert len(found[n]) == 1 or len(found[n][-1].words) > 100
    parity = word_windows(docs, "id", F.col("text"), all_words=False).where("id = 20000").collect()
    assert len(parity) == 20 and max(int(w) for r in parity for w in r.words) == 18099


def plain_subchunks(text):
    pieces = []
    for p in (x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()):
        sentences = [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", p) if x.strip()]
        w, lines = p.split(), p.split("\n")
        slices = [" ".join(w[k : k + 450]) for k in range(0, len(w), 450)]
        pieces += [p] if len(w) <= 650 else sentences if len(sentences) > 1 else [x for x in lines if x.strip()] if len(lines) > 1 else slices
    packs, now, n = [], [], 0
    for p in pieces:
        k = len(p.split())
        if n + k > 650:
            packs += [now] if now else []
            now, n = [p], k
        else:
            now, n = now + [p], n + k
            if n >= 220:
                packs, now, n = packs + [now], [], 0
    if now and packs and n < 110:
        packs[-1] = packs[-1] + now
    elif now:
        packs.append(now)
    return ["\n\n".join(p) for p in packs]


def test_subchunks_are_those_of_a_plain_loop(spark):
    run = lambda n, w="w": " ".join(f"{w}{i}" for i in range(n))
    texts = [None, "", " \n \n", "one", run(3000), run(650), run(651), "\n".join([run(400), " ", run(700)]).replace(" \n", "\n"), f"{run(300)}\n{run(400)}\n{run(50)}"]
    texts += [" ".join(f"A{i} {run(90)}." for i in range(9)), "\n\n".join([run(100), run(100), run(50), run(30)]), "\n \n".join([run(200), run(500), run(2000), run(109)]), f"{run(230)}\n\n{run(110)}", f"B {run(700)}. C {run(20)}.\n\n{run(640)}\n\n{run(15)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").union(tables.chunks(spark, SF).select(F.col("chunk_id") + 1000, "text"))
    want = {r.id: plain_subchunks(r.text or "") for r in docs.collect()}
    found = subchunks(docs, "id", F.col("text")).collect()
    assert {(r.id, r.pos): r.text for r in found} == {(k, i): t for k, v in want.items() for i, t in enumerate(v)}
    assert all(r.n_words == len(r.text.split()) for r in found)
    got = {(r.id, r.pos): r.digest for r in catalog.QUERIES["subchunk_text"](spark, SF).collect()}
    assert got == {(k - 1000, i): hashlib.md5(t.encode()).hexdigest() for k, v in want.items() if k >= 1000 for i, t in enumerate(v)}
