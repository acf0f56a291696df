"""Collecting batch results as they arrive: a stream of result files into the evaluations log, each file once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.answers import parsed
from quorate.sources.files import read_message_lines
from quorate.sources.shared import file_system

#: The order of arrival in the log: run of the stream's checkpoint, batch, file, line. Unique to a row.
ARRIVAL = ("began", "batch", "file", "line")


def _began(spark: SparkSession, checkpoint: str) -> str:
    """When this checkpoint was first used, with an id: a new checkpoint sorts after an older one and has other folders."""
    fs, path = file_system(spark, f"{checkpoint}/began")
    if not fs.exists(path):
        stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmssSSS")).first()[0]
        spark.range(1).select(F.lit(f"{stamp}-{uuid.uuid4().hex[:8]}").alias("value")).write.text(f"{checkpoint}/began")
    return spark.read.text(f"{checkpoint}/began").first()[0]


def collect(spark: SparkSession, results: str, log: str, checkpoint: str, version: str) -> int:
    """Appends the results that came since the last call to the log; calling again adds nothing. Gives the batches run.

    The checkpoint knows which files are done. A batch that is tried again writes to its own folder, so it can't count
    twice; another checkpoint writes to other folders, so it overwrites nothing. Of two results for one request the one
    later in ARRIVAL is the last.
    """
    began = _began(spark, checkpoint)

    def append(batch: DataFrame, k: int) -> None:
        lines = batch.select("value", "file", F.monotonically_increasing_id().alias("line"))
        rows = parsed(read_message_lines(lines)).withColumn("version", F.lit(version))
        rows.write.mode("overwrite").parquet(f"{log}/began={began}/batch={k}")

    files = spark.readStream.text(results).select("value", F.col("_metadata.file_path").alias("file"))
    query = files.writeStream.foreachBatch(append).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)
