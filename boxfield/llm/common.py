"""Helpers that every text operator shares: column access, Arrow UDFs and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: Rows of a batch that a text function gets in one call.
ROWS_AT_ONCE = 512


def quoted(name: str) -> str:
    """The column name with back quotes, so that dots and odd characters are taken as they are."""
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str):
    return F.col(quoted(name))


def text_bytes(values: pa.Array) -> list[bytes | None]:
    """UTF-8 of each text; null stays None."""
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


def struct_type(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def text_udf(make: Callable[[], Callable[[list[bytes | None]], dict[str, Any]]], ddl: str):
    """An Arrow UDF text -> struct<ddl>.

    ``make()`` runs once in each task and returns a function from the UTF-8 of a
    batch of texts to its columns (lists, numpy or Arrow arrays).  Marked
    non-deterministic only so that the optimiser does not evaluate it twice.
    """
    schema = struct_type(ddl)
    types = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for values in batches:
            parts = []
            for at in range(0, max(1, len(values)), ROWS_AT_ONCE):  # Python objects of a few rows at a time
                out = work(text_bytes(values.slice(at, ROWS_AT_ONCE)))
                arrays = [a.cast(t) if isinstance(a := out[n], pa.Array) else pa.array(a, type=t) for n, t in types]
                parts.append(pa.StructArray.from_arrays(arrays, names=[n for n, _ in types]))
            yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    return run.asNondeterministic()


def with_text_columns(df: DataFrame, text: str, make, ddl: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of df and the columns that the UDF makes of its text."""
    run = text_udf(make, ddl)
    return df.select(*(column(df, c).alias(c) for c in keep), run(column(df, text).cast("string")).alias("__r")).select(*(F.col(quoted(c)) for c in keep), "__r.*")


class Scratch:
    """Tables written in the shared folder that the cluster names in spark.checkpoint.dir.

    Written tables cut the lineage and survive lost executors; their file sizes
    give the optimiser true statistics.  Only where the setting is missing
    (tests on one machine) a temporary folder is used.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="boxfield-")
        self.base = f"{base.rstrip('/')}/boxfield-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n:04d}"

    def write(self, df: DataFrame) -> DataFrame:
        at = self.path()
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        jvm = self.spark._jvm
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f.startswith("file:") or "://" in f:
                at = jvm.org.apache.hadoop.fs.Path(f)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: Words of 64 bits in the largest filter that is broadcast.
FILTER_WORDS = 1 << 20


def filtered(rows: DataFrame, keys: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of ``keys``, rows that surely have none), so that only the first need a join by shuffle.

    ``key`` makes a 64-bit hash from a table's columns by the same names in both.
    A bit for each hash, about 32 for each key and at most ``FILTER_WORDS`` words, is
    set and broadcast; beyond that bound more rows may have a key, and no result changes.
    """
    n = keys.count()
    words = max(1, min(FILTER_WORDS, 1 << max(0, (n // 2).bit_length())))
    word, bit = F.pmod(F.shiftrightunsigned(F.col("__h"), 6), F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("__h"), F.lit(64)).cast("int"))
    bits = keys.select(key.alias("__h")).select(word.alias("__w"), bit.alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__bits"))
    marked = rows.withColumn("__h", key).withColumn("__w", word).withColumn("__b", bit).join(F.broadcast(bits), "__w", "left")  # at most ``words`` rows
    may = F.coalesce(F.col("__bits").bitwiseAND(F.col("__b")) != 0, F.lit(False))
    return marked.where(may).select(*(quoted(c) for c in rows.columns)), marked.where(~may).select(*(quoted(c) for c in rows.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(doc_id, mod: int):
    """crc32(doc_id as text) mod ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod
