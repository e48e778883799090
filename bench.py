"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores.
Each query runs once to warm up and is then timed; its whole result is computed
and thrown away. Query names may be given as arguments.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sensorframe.queries import all_queries  # noqa: E402
from sensorframe.session import build_session  # noqa: E402

HEADLINE = (
    "single_plot",
    "two_stream_download",
    "stream_profile",
    "time_select_reference",
    "time_select_ordered",
    "dim_range_select",
    "interp_linear",
    "gap_fill_day",
    "align_merge",
    "merge_coalesce",
    "asof_nearest",
    "raster_mean",
    "raster_color",
    "raster_dense",
    "sliced_rows",
    "flatten_spectra",
    "size_check",
    "request_outcomes",
    "csv_roundtrip",
    "sliced_roundtrip",
    "clean_samples",
    "profile_table",
    "cruise_profile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = list(queries) if sys.argv[1:] == ["all"] else sys.argv[1:] or list(HEADLINE)
    taken = {}
    for name in names:
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - began, 3)
    total = round(sum(taken.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": taken, "sf": sf_dir}))


if __name__ == "__main__":
    main()
