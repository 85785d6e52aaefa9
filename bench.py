"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "windows", "codon_frames", "encoded_crops", "window_scores", "contig_summary",
    "window_run_text", "called_contigs", "jointly_decoded_windows", "score_tracks",
    "segmented_regions", "gated_contig_calls", "exact_quantiles", "ranking_quality_large",
    "threshold_sweep", "exact_split_large", "length_batches", "interleaved_classes",
    "shuffled_bases", "open_reading_frames", "terminal_repeats", "nearest_vectors",
    "majority_taxa", "non_redundant",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from contigframe.catalog import REGISTRY

    # The first query would otherwise pay for starting the JVM's threads and the Python workers.
    REGISTRY["windows"].run(spark, os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    windows, reading = 0, 0.0
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        start = time.perf_counter()
        # The noop sink computes every column of every row and keeps nothing.
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr)
    if "encoded_crops" in times:
        with tempfile.TemporaryDirectory(prefix="bench-") as place:
            path = os.path.join(place, "encoded")
            REGISTRY["encoded_crops"].run(spark, folder).write.parquet(path)
            start = time.perf_counter()
            spark.read.parquet(path).write.format("noop").mode("overwrite").save()
            reading = time.perf_counter() - start
            windows = spark.read.parquet(path).count()
    line = {
        "metric": "headline queries, total wall-clock",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if windows:
        line["encoded_windows_per_second"] = round(windows / times["encoded_crops"])
        line["encoded_rows_read_per_second"] = round(windows / reading)
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
