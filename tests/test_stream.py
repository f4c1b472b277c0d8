import datetime

from tracefold.streaming import detect_stream


def test_stream_finds_each_text_once(spark, tmp_path):
    rows = [(i, "mail a@b.example", datetime.datetime(2025, 1, 1, i)) for i in range(2)] + [(9, "SSN 755-98-4598", datetime.datetime(2025, 1, 1, 5))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string, ingested_at timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("doc_id long, text string, ingested_at timestamp").parquet(src)
    detect_stream.write(detect_stream.hits(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["category"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["email", "ssn"]
