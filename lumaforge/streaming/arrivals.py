"""Jobs over images as they arrive. Every sink takes its checkpoint location from the caller."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumaforge.functions.derived import suffix
from lumaforge.operators.catalog import IMAGE_SUFFIXES
from lumaforge.session import cut_lineage
from lumaforge.sources.images import (
    IMAGE_SCHEMA, UNIDENTIFIED, decoded, explode_pixels, image_files, image_id, load_images, split_decoded, with_format,
)

#: Waiting files that are read again with one micro-batch.
RETRIED_AT_ONCE = 1000
WAITING_SCHEMA = "path string, tries int"


def watch_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of catalog rows ``(path, format, size_bytes, modified)`` for image files landing in a folder."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    wanted = files.where(F.lower(suffix(F.col("path"))).isin(*IMAGE_SUFFIXES))
    return with_format(wanted).select(
        "path", "format", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")
    )


def watch_images(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of decoded images, in the shape of :func:`lumaforge.sources.images.load_images`."""
    files = (
        spark.readStream.format("image")
        .schema(IMAGE_SCHEMA)
        .option("dropInvalid", "false")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return image_files(decoded(files))


def run_on_arrivals(
    images: DataFrame, transform: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, tries: int = 1
) -> StreamingQuery:
    """Run a batch operator chain on the pixels of arriving images and keep the result as Parquet.

    Each micro-batch writes its own folders and overwrites them when it is replayed, so a restart adds nothing twice. A
    file of which the folder holds no pixel is recorded with its error under ``<output>-rejected``; pixels are counted
    while they are written, and files looked up only if some are missing, so one that is completed meanwhile is
    either written or recorded. A file that cannot be identified may still be in writing: with ``tries`` above one it waits
    under ``<output>-waiting`` and is read again with the next micro-batches, until it has been tried that often. Of
    many waiting files ``RETRIED_AT_ONCE`` are read with a batch, and the others keep their turn.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = batch.withColumn("tries", F.lit(1))
        waiting = _waiting(spark, output, batch_id)
        due = waiting.orderBy(F.desc("tries"), "path").limit(RETRIED_AT_ONCE).collect()
        if due:
            listed = spark.createDataFrame(due, WAITING_SCHEMA)
            waiting = waiting.join(listed, ["path", "tries"], "left_anti")
            found = _existing(spark, [row.path for row in due])
            again = load_images(spark, found) if found else decoded(spark.createDataFrame([], IMAGE_SCHEMA))
            again = listed.withColumn("tries", F.col("tries") + 1).join(again, "path", "left")
            arrived = arrived.unionByName(again.withColumn("width", F.coalesce("width", F.lit(-1))))
        good, bad = split_decoded(arrived)
        errors = good.select("path", "tries", F.lit("no pixels left after the run").alias("error")).unionByName(
            bad.join(arrived.select("path", "tries"), "path")
        )
        files = cut_lineage(errors.withColumn("img_id", image_id(F.col("path"))))
        folder = f"{output}/batch={batch_id}"
        seen = Observation("images")
        first_pixel = (F.col("x") == 0) & (F.col("y") == 0)
        done = transform(explode_pixels(good)).observe(seen, F.count_if(first_pixel).alias("written"))
        done.write.mode("overwrite").parquet(folder)
        lost = files.limit(0)
        if seen.get["written"] < files.count():
            written = spark.read.parquet(folder).where("x = 0 AND y = 0").select("img_id")
            lost = files.join(written, "img_id", "left_anti")
        later = (F.col("error") == UNIDENTIFIED) & (F.col("tries") < tries)
        rejected = lost.where(~later).select("path", "error")
        rejected.write.mode("overwrite").parquet(f"{output}-rejected/batch={batch_id}")
        if tries > 1:
            waiting = waiting.unionByName(lost.where(later).select("path", "tries"))
            waiting.write.mode("overwrite").parquet(f"{output}-waiting/batch={batch_id}")

    return (
        images.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _waiting(spark: SparkSession, output: str, batch_id: int) -> DataFrame:
    """Files that the micro-batch before left for later."""
    folder = f"{output}-waiting/batch={batch_id - 1}"
    if _existing(spark, [folder]):
        return spark.read.schema(WAITING_SCHEMA).parquet(folder)
    return spark.createDataFrame([], WAITING_SCHEMA)


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of a few paths that are there, in a form that readers do not take for a pattern."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = [p for p in paths for j in [spark._jvm.org.apache.hadoop.fs.Path(p)] if j.getFileSystem(conf).exists(j)]
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in found]


def first_arrivals(events: DataFrame, keys: list[str], ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Drop repeats of a key inside a time bound; state older than the bound is released."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def arrival_metrics(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, bytes and failures per tumbling window; ``events(ts, kind, size, failed)``.

    The running sums are exact decimals, so the result does not depend on arrival order.
    """
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, width))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("size").cast("decimal(18,2)")).alias("bytes"),
            F.count(F.when(F.col("failed"), 1)).alias("failures"),
        )
        .select(F.col("window.start").alias("start"), "n", F.col("bytes").cast("double").alias("bytes"), "failures")
    )


def drain_to_table(df: DataFrame, output: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now and leave the rows as Parquet files."""
    q = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
