"""Benchmark of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``: one warm-up run, then the median of ``$BENCH_REPEAT``
(default 3) timed runs. A run executes the whole plan and discards the rows
(``noop`` sink), so driver collection does not distort the timing. Prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "script_entropy",
    "c5_disambiguate_types",
    "d14_tag_names",
    "d17_standardize_script",
    "e4_permute_lowest_distance",
    "e7_standardize_names",
    "f4_mean_crossing",
    "g2_char_jaccard",
    "h1_sample_balanced",
    "i1_pivot_names",
    "j7_summary_table",
    "k4_corpus_bleu",
    "b15_dump_names",
    "resource_build",
    "f2_align_characters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    from namekit.session import get_spark
    from namekit.plans.queries import QUERIES
    spark = get_spark("namekit-bench", cpus=cpus)
    times = {}
    for name in names:
        if name not in QUERIES:
            continue
        run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()  # warm-up
        samples = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            run()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
