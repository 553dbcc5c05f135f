from pyspark.sql import functions as F

from marginalia.operators.study import fold_reviews
from marginalia.sources import files, tables
from marginalia.streaming.reviews import stream_reviews

SF = "/root/testdata/sf0.001"


def test_lines_and_rejects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x", "word_count": 1}\nnot json\n{"id": "1", "text": "y", "word_count": 2}\n')
    path = str(tmp_path / "a.jsonl")
    assert files.read_lines(spark, path, files.PAGE).count() == 2
    assert files.read_rejects(spark, path, files.PAGE).first()[0] == "not json"
    assert [r.text for r in files.read_latest(spark, path, files.PAGE, "id", [F.col("word_count")]).collect()] == ["y"]


def test_sinks(spark, tmp_path):
    cards = spark.createDataFrame([("a b", "c", "t")], "front string, back string, tags string")
    files.write_cards_tsv(cards, str(tmp_path / "tsv"))
    assert spark.read.text(str(tmp_path / "tsv")).first()[0] == "a b\tc\tt"
    files.write_lines(cards, str(tmp_path / "log"), append=True)
    files.write_lines(cards, str(tmp_path / "log"), append=True)
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    files.write_index({"cards": cards}, str(tmp_path / "index"))
    assert files.read_index(spark, str(tmp_path / "index"), ["cards"])["cards"].collect() == cards.collect()
    assert files.file_digests(spark, str(tmp_path / "tsv")).count() >= 1


def test_page_text(spark):
    html = "<html><!-- no --><script>var x = '<p>';</script><style>p{}</style><p>A &amp; B</p>\n<li>c</li>"
    assert spark.range(1).select(files.page_text(F.lit(html)).alias("t")).first()["t"] == "A & B c"


def test_stream_gives_the_states_of_the_batch_fold(spark, tmp_path):
    reviews = tables.reviews(spark, SF)
    reviews.repartition(1).sortWithinPartitions("ts").write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reviews.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # Files come in order of their names and so of time.
    q = stream_reviews(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("select user_id, card_id, max_by(struct(interval_days, ease, reps, lapses, n_reviews), n_reviews) s from states group by 1, 2").select("user_id", "card_id", "s.*")
    want = fold_reviews(reviews, ["user_id", "card_id"])
    columns = ["user_id", "card_id", "n_reviews", "lapses"]
    assert sorted(map(tuple, last.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
