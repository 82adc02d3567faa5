"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from apisurface.plans import catalog  # noqa: E402
from apisurface.session import build_session  # noqa: E402

HEADLINE = [
    "flow_complete_functions",
    "flow_evaluate_signatures",
    "flow_completion_funnel",
    "jn3_match_references",
    "jn4_locate_ranges",
    "jn9_refine_by_checks",
    "jn10_match_keywords",
    "ag6_floor_percentile",
    "ag7_union_types_with_any",
    "ag11_timing_rollup",
    "wn1_last_definition",
    "wn2_ordinal",
    "wn6_section",
    "tx4_normalize_type",
    "tx5_tokenize_format",
    "tx7_value_format_type",
    "tx8_parse_overload",
    "ud2_parse_format_arguments",
    "cv1_diff_catalogs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "apisurface-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__checkpoint__dir=f"file://{tempfile.mkdtemp(prefix='bench-')}",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    timings = {}
    for name in HEADLINE:
        if os.path.isdir(small):
            queries[name](spark, small).write.format("noop").mode("overwrite").save()
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    functions = spark.read.parquet(f"{folder}/orders.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")),
                "functions_completed": functions,
                "functions_per_sec": round(functions / timings["flow_complete_functions"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
