"""Reading the given tables, and writing intermediate ones where every executor can see them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumaforge.session import ensure_checkpoint_dir

#: Words are runs of anything but these six characters, as a Java and Python character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as columnar files into the shared checkpoint folder and continue from there.

    Lost executors cost nothing then, since the files outlive them, and later reads prune columns, and files by the
    few values of the columns ``by``. The files go when :func:`release` is called, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*(by or [])).parquet(path)
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that :func:`stored` returned and that nothing reads any more."""
    for df in frames:
        system, place = _file_system(df.sparkSession, df._stored_at)
        system.delete(place, True)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, whatever its scheme."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place
