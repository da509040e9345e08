"""Headline-query benchmark: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query is run
to completion through the `noop` sink, so every column is computed and nothing is
collected to the driver. Times include planning and the small index jobs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from icx.plans import catalog  # noqa: E402
from icx.session import local_session  # noqa: E402

HEADLINE = [
    "few_shot_prompt",
    "chat_prompt",
    "instruction_random",
    "select_demos",
    "directionality_prompt",
    "perturb_homogeneous_target",
    "perturb_hetero_II",
    "ptb_word_duplication",
    "ptb_word_order",
    "ptb_ocr",
    "ptb_punctuation_drop",
    "ptb_punctuation_add",
    "ptb_span_noise",
    "perturb_text_lines",
    "pivot_join",
    "pivot_variant_II",
    "pivot_variant_III",
    "predictions",
    "metrics_by_run",
    "grid_all",
    "pair_fan_out",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM start-up outside the timings
    times = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
