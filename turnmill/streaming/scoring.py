"""Incremental scoring: a stream of task lines is scored and appended once per task.

The ids of the tasks seen are the stream's state, kept in RocksDB by hash of the
id, so that a batch looks up its own ids only and reads nothing of what is
stored.  Each batch writes its own folder, named by its number: a batch that
runs again, after a failure, finds the state before it and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnmill.types import TASK_LINE

#: A part of the state takes some 4 MB of an executor's disk, however little is in it, until maintenance finds that its
#: run has ended; runs that follow one another soon would pile them up.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def stream_tasks(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(TASK_LINE).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path)


def score_stream(tasks: DataFrame, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Apply score to the trajectories of new tasks and write them under ``out``/batch=n.

    The first line of a task id counts; lines without an id are told apart by
    their results.  The number of the state's parts is the shuffle partitions of
    the first run with this checkpoint.
    """
    spark = tasks.sparkSession
    nameless = F.when(F.col("task_id").isNull(), F.sha2(F.to_json("results"), 256))
    fresh = tasks.withColumn("_nameless", nameless).dropDuplicates(["task_id", "_nameless"])

    def write(batch: DataFrame, number: int) -> None:
        scored = score(batch.select(F.explode("results").alias("r")).select("r.*"))
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    ours = {k: v for k, v in STATE_SETTINGS.items() if spark.conf.get(k, None) is None}
    for k, v in ours.items():
        spark.conf.set(k, v)  # a query takes the settings over when it starts
    try:
        return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k in ours:
            spark.conf.unset(k)
