"""Near-duplicates of a folder, from files to groups of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaforge.operators.catalog import scan_recursive
from lumaforge.operators.perceptual import DEFAULT_THRESHOLD, average_hash, duplicate_groups
from lumaforge.operators.ranking import number_within
from lumaforge.operators.skew import join_counted
from lumaforge.session import cut_lineage
from lumaforge.sources.images import explode_pixels, image_id, load_images, scan, split_decoded


def find_duplicates(
    spark: SparkSession, folder: str, threshold: int = DEFAULT_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """``(groups, rejected)``: ``groups(group_id, leader_path, path, distance)`` in path order, and the files that
    could not be read."""
    good, rejected = split_decoded(scan_recursive(load_images(spark, folder)))
    hashes = average_hash(explode_pixels(good))
    # The order of the scan is the order of the paths. Names come from the listing, which reads no content;
    # files that cannot be read have no hash and drop out in the join.
    listed = scan(spark, folder).select("path", image_id(F.col("path")).alias("img_id"))
    names = number_within(listed, [], ["path"], "ord")
    ordered = cut_lineage(hashes.join(names, "img_id").select(F.col("ord").cast("long").alias("img_id"), "path", "h"))
    groups = cut_lineage(duplicate_groups(ordered.select("img_id", "h"), threshold))
    sizes = groups.groupBy("leader_id").agg(F.count(F.lit(1)).alias("_members"))
    paths = ordered.select(F.col("img_id").alias("member_id"), "path")
    lead = ordered.select(F.col("img_id").alias("leader_id"), F.col("path").alias("leader_path"))
    leaders = cut_lineage(sizes.join(lead, "leader_id"))
    named = join_counted(groups, leaders, ["leader_id"], "_members").join(paths, "member_id")
    return named.select("group_id", "leader_path", "path", "distance"), rejected
