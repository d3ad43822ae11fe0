"""The telemetry report as a stream: files of JSON lines that are there are read once, sums are kept between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.telemetry import by_command
from tessera.schema import QUERY_LOG
from tessera.storage import scratch


def report(spark: SparkSession, folder: str, checkpoint: str | None = None) -> DataFrame:
    """Calls and empty answers by command over all files of a folder. With a checkpoint of one's own only new files are read."""
    out = scratch(spark, "telemetry-report")
    log = spark.readStream.schema(QUERY_LOG).json(folder)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    run = by_command(log).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint or scratch(spark, "telemetry-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("cmd string, calls long, empties long").parquet(out)
