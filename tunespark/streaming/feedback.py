"""Feedback as an append stream: the batch rules on each micro-batch, every event once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tunespark.operators.interactions import ingest_feedback


def once(source: DataFrame, event_id: str = "row_id", event_time: str = "created_at", delay: str = "1 day") -> DataFrame:
    """The events of a stream without those whose id has come before, in whatever batch.

    Ids are kept as state until the watermark, `delay` behind the latest event, has passed them, so that the state is bounded by the events of that span. A
    repeat that comes later than that is taken for a new event.
    """
    return source.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([event_id])


def _made(spark: SparkSession, sink: str, before: int) -> DataFrame | None:
    """The tracks that earlier batches made."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sink}/tracks").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sink}/tracks")):
        return None
    return spark.read.parquet(f"{sink}/tracks").where(F.col("batch") < before).drop("batch")


def feedback_stream(
    spark: SparkSession, source: DataFrame, tracks: Callable[[], DataFrame], sink: str, checkpoint: str, once_only: bool = True, event_id: str | None = None, delay: str = "1 day"
) -> StreamingQuery:
    """Appends accepted events, rejected events and new tracks of each micro-batch under sink, each in a folder of its own batch.

    A batch that is run again after a failure overwrites its own folder. Given event_id, an event that is delivered again, in the same batch, in a later one or
    after a restart, lands once (see once()). tracks() gives the tracks stored elsewhere; those that earlier
    batches made are read from the sink.
    """

    def write(batch: DataFrame, number: int) -> None:
        stored, made = tracks(), _made(spark, sink, number)
        if made is not None:
            stored = stored.unionByName(made, allowMissingColumns=True)
        accepted, rejected, after = ingest_feedback(batch, stored)
        accepted.write.mode("overwrite").parquet(f"{sink}/accepted/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{sink}/rejected/batch={number}")
        after.join(stored.select("id"), "id", "left_anti").write.mode("overwrite").parquet(f"{sink}/tracks/batch={number}")

    events = source if event_id is None else once(source, event_id, delay=delay)
    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once_only else writer).start()
