"""Change events of watched folders, as streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a change can be, as bits.
DELETE, WRITE, EXTEND, ATTRIBUTES, LINK, RENAME, REVOKE = 1, 2, 4, 8, 16, 32, 64


def watch(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the rows of files as they come into a folder; a batch is what is told at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def routed(events: DataFrame, subscriptions: DataFrame, key: str) -> DataFrame:
    """Events of live subscriptions only: a join of the stream with a static table."""
    return events.join(subscriptions.select(key).distinct(), key, "left_semi")


def closes(flags: str = "flags") -> F.Column:
    """Whether a change takes its target away."""
    return F.col(flags).bitwiseAND(DELETE | REVOKE) != 0


def coalesced(events: DataFrame, key: str, flags: str) -> DataFrame:
    """One row for each target: all of a batch's changes together."""
    return events.groupBy(key).agg(F.bit_or(flags).alias(flags), F.count("*").alias("n"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none: beside its warehouse, or a temporary folder if all runs on this machine."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given and spark.sparkContext.master.startswith("local["):
        given = f"{tempfile.gettempdir()}/checkpoints"
    return (given or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def kept(folder: str, make):
    """For run_to_end(): write make(batch) under the batch's number, so that a batch done again takes its own place."""
    return lambda batch, number: make(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def run_to_end(stream: DataFrame, each, checkpoint: str) -> None:
    """Hand all that is there to each(batch, number), a batch at a time, and stop. A batch that a restart interrupted is done again, under the same number."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
