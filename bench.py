"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON: seconds, median of three warm runs.

The value is the sum over NAMES, as in earlier rounds; MORE are timed besides, blocked rasters next to their pixel forms.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from rasterloom.plans import QUERIES

NAMES = [
    "histogram_threshold", "ycc_to_rgb_clip", "masked_pixels", "mask_union", "mask_boundary", "erode", "gaussian_blur", "sharpen",
    "bilinear", "warp_reflect101", "scale_hat", "reconstruct_masked", "rasterize", "zbuffer_max", "dct_activity", "ahe",
    "contours", "find_rectangles", "pack_rects", "jpeg_inpaint", "quad_contract", "png_roundtrip",
]

MORE = ["erode_tiles", "blur_each", "blur_tiles", "warp_each", "warp_tiles", "leaf_union", "leaf_subtract"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in [*NAMES, *MORE]:
        runs = []
        for k in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took[n] for n in NAMES), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
