"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.session import scratch_path

TOKENIZER_DIR = os.environ.get("CREASE_TOKENIZERS", "/opt/tokenizers")
LONG_BITS = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_freed(df: DataFrame, name: str) -> DataFrame:
    """``stored``, with the shuffle files of the write removed as it ends; for a plan that isn't run again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def stored_in_turn(parts: Iterable[DataFrame], name: str) -> tuple[DataFrame, str]:
    """The rows of all parts, written to one folder one part after the other, and the folder; a part's shuffle files
    go before the next one starts, so that only one part's are on disk."""
    path, last = None, None
    for df in parts:
        spark, last = df.sparkSession, df
        path = path or scratch_path(spark, name)
        conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key)
        conf.set(key, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            conf.set(key, before)
    return last.sparkSession.read.schema(last.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table of ``stored_in_turn`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes; null counts as no bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with working names."""
    return df.select(*[F.col(f"`{n}`") for n in names])
