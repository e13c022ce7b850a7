"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` picks the data, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from lumaforge.operators.lines import gaussian_blur, median_filter
from lumaforge.session import BUILD_CONF, configure
from lumaforge.workload import QUERIES, load_all

HEADLINE = [
    "near_duplicates", "average_hash", "similar_pairs", "duplicate_groups_dense",
    "resize_bicubic", "resize_lanczos", "gaussian_blur", "median", "contrast", "hue", "rotate_free", "run_step_list",
    "render_names", "render_camera_names", "numbered_names", "template_context",
    "exif_struct", "write_metadata", "copy_all", "export_json", "integer_values", "dry_run", "predicted_sizes",
]


def large_image(spark: SparkSession):
    """One image of 512 x 512 pixels, where the cost of a neighborhood shows."""
    return spark.range(512 * 512).selectExpr(
        "0L AS img_id", "512 AS w", "512 AS h", "cast(id % 512 AS int) AS x", "cast(id div 512 AS int) AS y",
        "cast(id * 7919 % 256 AS int) AS r", "cast(id div 512 % 256 AS int) AS g", "cast(id % 256 AS int) AS b",
    )


LARGE = {
    "blur_512": lambda spark, _: gaussian_blur(large_image(spark), 5.0),
    "blur_wide_512": lambda spark, _: gaussian_blur(large_image(spark), 30.0),
    "median_512": lambda spark, _: median_filter(large_image(spark), 3),
    "median_wide_512": lambda spark, _: median_filter(large_image(spark), 21),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or [*HEADLINE, *LARGE]
    load_all()
    known = QUERIES | LARGE
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lumaforge-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config(map=BUILD_CONF)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in names:
        run(name)  # warm the JVM, the code cache and the file cache
        timings[name] = round(run(name), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
