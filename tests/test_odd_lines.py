"""Queries against their SQL on lines with letters, spaces and line ends that regular expressions read in different ways."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from marginalia import catalog

LINES = [
    "The heap iſ moved by rules of loss and minimum keys", "Input heap is été élevéed übering toward éis naïving áed moves", "A long term\x0bhere is a rule that moved\x0bby some loss of keys\x0b",
    "The step size is a rule that moved toward a minimum (1999) (2000) (2001)", "The step size means a rule that moved toward a minimum (2001)\u0085", " The step size refers to a rule that moved toward a minimum ",
    "The step size is a rule that moved toward a minimum (see Chapter 3).", "İnput term İS a rule that moved toward a minimum of loss", "", None,
]


def rows(spark, name, folder, lines):
    """A query's rows and those of its SQL, over these lines as documents."""
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    pq.write_table(pa.Table.from_pylist([{"doc_id": k, "text": s, "lang": "en", "source": "src1", "n_chars": len(s or "")} for k, s in enumerate(lines)], pa.schema(kinds)), f"{folder}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    r = duck.execute(catalog.ORACLE_SQL[name])
    columns = [x[0] for x in r.description]
    return sorted(repr(tuple(x[k] for k in columns)) for x in catalog.QUERIES[name](spark, str(folder)).collect()), sorted(map(repr, r.fetchall()))


def test_definition_pairs_as_in_sql(spark, tmp_path):
    for name in ("extract_definition_pair", "strip_trailing_citations", "normalize_ws"):
        got, want = rows(spark, name, tmp_path, LINES)
        assert got == want
