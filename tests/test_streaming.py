from __future__ import annotations

from boxfield.streaming import log


def test_log_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(40).selectExpr("timestamp_seconds(id * 60) ts", "id % 7 box_id", "CASE WHEN id % 2 = 0 THEN 'confirm' ELSE 'ground' END kind", "CAST(id AS DOUBLE) / 40 confidence")
    log.append(rows, path)
    q = log.stream(spark, path).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == log.read(spark, path).count() == 40
    assert log.counts(log.read(spark, path)).agg({"n": "sum"}).first()[0] == 40


def test_repeated_records_count_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(1, 31).selectExpr("timestamp_seconds(id * 60) ts", "id % 7 box_id", "'ground' kind", "0.5D confidence")
    log.append(rows.union(rows), path)
    q = log.once(log.stream(spark, path)).writeStream.format("memory").queryName("seen_once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen_once").count() == log.once(log.read(spark, path)).count() == 30
    assert log.read(spark, path).count() == 60
