"""Where the streams write: one folder per micro-batch, replaced when a batch is run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch_id={batch_id}"


def keep_once(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` if that was not done to its end before."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return df


def start(stream: DataFrame, each: Callable[[DataFrame, int], DataFrame], checkpoint: str, out: str,
          mode: str = "append", once: bool = False) -> StreamingQuery:
    """Write ``each(batch, batch_id)`` of every micro-batch to its own folder under ``out``.

    Overwriting the batch's folder makes a retried batch harmless.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch, batch_id).write.mode("overwrite").parquet(batch_folder(out, batch_id))

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
