"""The adjudication log: appended as JSON lines, read in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "ts timestamp, box_id bigint, kind string, prompt string, answer string, choice string, confidence double, detail string, image string, quality string"


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


class Recorder:
    """Where decisions are logged; without a path nothing is."""

    def __init__(self, path: str | None = None) -> None:
        self.path = path

    def set(self, path: str | None) -> None:
        self.path = path

    def record(self, records: DataFrame) -> bool:
        """Appends the records; columns that they lack are null."""
        if self.path is None:
            return False
        lacking = [f.split()[0] for f in RECORD.split(", ") if f.split()[0] not in records.columns]
        append(records.select("*", *(F.lit(None).cast("string").alias(c) for c in lacking)), self.path)
        return True


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Records as they are appended: every record of ``read``, whatever its time; the file source takes each file once."""
    return spark.readStream.schema(RECORD).json(path)


def once(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (box, kind, ts) once.

    A stream keeps what it has seen for ``late`` and leaves out records that come
    later than that (and those at the epoch, where its watermark starts); a table
    has no late records.
    """
    key = ["box_id", "kind", "ts"]
    if records.isStreaming:
        return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    return records.dropDuplicates(key)


def counts(records: DataFrame, window: str = "1 hour") -> DataFrame:
    """Records and mean confidence by window and kind; works on both forms."""
    return records.groupBy(F.window("ts", window), "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
