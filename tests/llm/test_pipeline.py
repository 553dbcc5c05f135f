import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from marginalia.llm import common, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = kept
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
        gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in kept.collect()}
        if name == "language":
            assert not gone
        if name == "quality":
            junk = {i for i, q in quality.items() if q == 0}  # of few labels here, so that some forms of junk are hardly learned
            assert not [i for i in gone if quality.get(i) == 1] and len(junk - gone) <= len(junk) / 4
        if name == "near_duplicates":
            assert gone
    assert kept.count() == kept.select("doc_id").distinct().count()
    pieces = corpus_pipeline.packed(spark, kept, SF)
    assert pieces.select("doc_id").distinct().count() == kept.count()


def test_run_is_the_stages_one_after_another(spark):
    assert corpus_pipeline.run(spark, SF).select("sequence_id").distinct().count() > 10


def test_edge_rows_pass_through(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "123 456", "de", "s", 7), (None, "The cat and the dog sat on the mat.", "en", "s", 30)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    full = docs.union(spark.read.parquet(f"{SF}/documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.language(spark, full, SF).collect() if r.doc_id in (1, 2, 3)} <= set(range(200))
    assert corpus_pipeline.one_of_each(spark, docs, SF).count() == 4
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), SF).count() == 0


FOREIGN = [
    "Съешь же ещё этих мягких французских булок, да выпей чаю. Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 3,
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Qgb2YgYmFzZTY0IGVuY29kaW5nIHdoaWNoIGlzIGxvbmcgZW5vdWdoIHRvIGhhdmUgbWFueSB0cmlncmFtcyBpbnNpZGUgaXQ=" * 3,
    "".join(chr(97 + (k * k * 7 + k // 3) % 26) + " " * (k % 5 == 0) for k in range(4000)),
]


def test_language_rejects_what_is_in_no_learned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [(-1 - k, t, None, "x", len(t)) for k, t in enumerate(FOREIGN)] + [(-100, "", "en", "x", 0), (-101, None, "en", "x", 0), (-102, "12 !? 34", "en", "x", 8)]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF).select("doc_id").collect()}
    assert not [i for i in kept if i < 0]
    assert docs.count() - len(kept) <= 2  # texts of the corpus's languages stay


def edge_rows(spark):
    """Rows with nulls, empty and long texts, ties, repeats, and the columns of documents in any state."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    some = [tuple(r) for r in documents.limit(60).collect()]
    rows = [(None, None, None, None, None), (None, some[0][1], "en", None, None), (7001, None, "en", "s", 0), (7002, "", None, None, 0), (7003, " \n\t", "en", "s", 3), (7004, " " * 1_200_000, "en", "s", 0),
            (7005, some[1][1] * 400, "en", "s", 0), (7006, "word " * 200_000, "en", "s", 0), (7007, some[2][1], "en", "s", 0), (7007, some[2][1], "en", "s", 0), (7007, some[3][1], "fr", "s", 0), (7008, "x" * 300_000, "en", "s", 0)]
    return documents, spark.createDataFrame(some + rows, documents.schema)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_each_stage_takes_edge_rows(spark, name, stage):
    documents, rows = edge_rows(spark)
    out = stage(spark, rows, SF)
    got = out.collect()
    given = [r.doc_id for r in rows.collect()]
    if name == "packing":
        assert sorted({r.doc_id for r in got if r.doc_id}) == sorted({i for i in given if i}) and all(r.offset + r.length <= 1024 for r in got)
        assert sum(r.piece == 0 for r in got) == len(given)
    else:
        assert out.columns == documents.columns and len(got) <= len(given)
        ids = [r.doc_id for r in got]
        if name == "language":
            assert not {7001, 7002, 7003, 7004} & set(ids) and ids.count(7007) == 3
        if name == "near_duplicates":
            assert {7001, 7002, 7003, 7004, 7006} <= set(ids) and ids.count(None) == 2 and not {7005, 7007} & set(ids)  # 7005 repeats one text
    empty = stage(spark, rows.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:3])
def test_stages_keep_columns_that_clash_with_their_own(spark, name, stage):
    documents, rows = edge_rows(spark)
    extra = rows
    for c in ("_word", "_bits", "_hit", "_dropped", "label", "score", "component_id", "n"):
        extra = extra.withColumn(c, F.lit(1))
    out = stage(spark, extra, SF)
    assert out.columns == extra.columns and sorted(map(str, out.select("doc_id").collect())) == sorted(map(str, stage(spark, rows, SF).select("doc_id").collect()))


def test_run_leaves_only_its_result_behind(spark):
    before = common.cuts(spark)
    out = corpus_pipeline.run(spark, SF)
    assert common.cuts(spark) == [*before, out.cut_path] and out.count()


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_queries_are_registered(spark):
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES}


def test_sql_gives_the_same_rows(spark):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        r = c.execute(sql)
        columns = [x[0] for x in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(str, r.fetchall())) == sorted(str(tuple(row[k] for k in columns)) for row in df.collect()), name
