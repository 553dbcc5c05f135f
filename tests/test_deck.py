"""Identifiers and stand-in vectors against Python's own, and a greedy choice by hand."""

import hashlib
import math
import uuid

from test_queries import SF

from marginalia import catalog
from marginalia.sources import tables


def test_page_ids_are_name_based_uuids(spark):
    space = uuid.uuid5(uuid.UUID("12345678-1234-5678-1234-567812345678"), "pdf_processor_v1")
    want = {r.chunk_id: str(uuid.uuid5(space, f"page|book:{r.book.lower()}|number:{r.page_start}")) for r in tables.chunks(spark, SF).collect()}
    assert {r.chunk_id: r.value for r in catalog.QUERIES["page_id"](spark, SF).collect()} == want


def test_stand_in_vectors(spark):
    def plain(text):
        h = hashlib.sha256(text.encode()).digest()
        raw = [int.from_bytes(hashlib.md5(h + k.to_bytes(4, "little")).digest()[:4], "little", signed=True) / 2**31 for k in range(8)]
        norm = math.sqrt(sum(x * x for x in raw))
        return [x / norm * 1e6 for x in raw]

    lines = {(r.doc_id, r.pos): r.s for r in tables.probe_lines(spark, SF).collect()}
    got = catalog.QUERIES["embed"](spark, SF).collect()
    assert len(got) == len(lines)
    for r in got:
        assert all(abs(float(a) - b) <= 0.5001 for a, b in zip(r.value.split(","), plain(lines[r.doc_id, r.pos])))


def test_no_card_closes_two_gaps(spark):
    rows = catalog.QUERIES["select_gap_cards"](spark, SF).collect()
    assert len({r.card_id for r in rows}) == len(rows) == len({r.name for r in rows}) > 1
