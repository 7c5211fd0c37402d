"""Repository dumps as a stream of files: the same rows as the batch ingest, file by file as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ingest


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of dumps that land in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("block"))
    return lines


def write_files(lines: DataFrame, path: str, checkpoint: str, strict: bool = True, once: bool = False) -> StreamingQuery:
    """Append the files of each batch, duplicates within it resolved; later batches win over earlier ones by ``batch``.

    Order within a file, which a stream's rows do not carry, is taken when a batch is read.
    """

    def put(batch: DataFrame, n: int) -> None:
        files = ingest.files_of(ingest.parse_lines(batch.withColumn("seq", F.monotonically_increasing_id()), strict))
        ingest.last_writes(files).withColumn("batch", F.lit(n)).write.mode("append").parquet(path)

    out = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (out.trigger(availableNow=True) if once else out).start()
