"""Incremental ingest of newly landed match files (Structured Streaming).

The reference refreshes by re-running the whole ETL.  The same operators can
run incrementally: a file source picks up new ``*.json`` files below a landing
folder, and each micro-batch is classified and flattened exactly like the
batch job (``sources.documents`` + ``operators.flatten``), appending ball rows
and quarantine rows under one folder per micro-batch.  Dimensions depend on every match
seen so far (canonical names, first city) and are rebuilt by the batch job.

Exactly-once: the stream's checkpoint lives below the session's
``spark.checkpoint.dir``; each micro-batch overwrites its own batch-id folder,
so a batch replayed after a failure rewrites the same folder instead of
duplicating rows.  Readers see the batches as the ``batch_id`` partition column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crease.operators import flatten
from crease.session import checkpoint_root, scratch_path
from crease.sources import documents


def landing_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (path, text) of new JSON files, one row per file."""
    reader = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(landing_dir).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _write_batch(target_dir: str):
    root = target_dir.rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        staged = scratch_path(batch.sparkSession, "classified")  # files are read and parsed once for both tables
        documents.classify_documents(batch).write.parquet(staged)
        classified = batch.sparkSession.read.parquet(staged)
        accepted = classified.where(F.col("reason").isNull()).select("path", "match_id", "order_key", "doc")
        quarantine = classified.where(F.col("reason").isNotNull()).select("path", "match_id", "status", "reason")
        facts = flatten.build_fact_ball(accepted)
        facts.write.mode("overwrite").parquet(f"{root}/fact_ball/batch_id={batch_id}")
        quarantine.write.mode("overwrite").parquet(f"{root}/quarantine/batch_id={batch_id}")

    return run


def start_ingest(spark: SparkSession, landing_dir: str, target_dir: str, name: str = "match-ingest",
                 available_now: bool = True) -> StreamingQuery:
    """Start the incremental ingest; ``available_now`` processes what is there and stops."""
    ckpt = f"{checkpoint_root(spark).rstrip('/')}/streams/{name}"
    w = landing_stream(spark, landing_dir).writeStream.foreachBatch(_write_batch(target_dir)).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.queryName(name).start()
