"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (no collect, no
driver-side rows).  Every query first runs once, untimed, on the smallest data
set so that JIT compilation and Spark's generated-code cache are warm; the
timed runs then measure steady-state execution at $BENCH_SF_DIR.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textscore.plans import catalog  # noqa: E402
from textscore.session import build_session  # noqa: E402

HEADLINE = [
    "a5_bleu_pairs",
    "a5_bleu_near_smooth_doubled",
    "a5_bleu_multi",
    "a6_bleu_by_lang",
    "a6_sentence_bleu_smooth",
    "a7_macro_bleu_batches",
    "a8_exact_match_by_lang",
    "a9_cross_entropy",
    "j2_clipped_matches_by_order",
    "t2_tokenize_13a",
    "e1_vocabulary",
    "e2_encode",
    "e5_encoded_pairs",
    "e6_decode",
    "e9_batches",
    "w1_sorted_orders",
    "w2_leak_events",
    "w3_running_loss",
    "w4_interval_perplexity",
    "w6_patience",
    "w8_global_steps",
    "e3_truncate_pad",
    "e8_pad_batches",
    "a7_evaluate_batches",
    "a12_run_comparison",
    "a13_merged_partials",
    "u2_batch_prediction",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        app_name="textscore-bench",
        shuffle_partitions=max(8, 2 * int(cpus)),
        extra={
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
            "textscore.input.partitions": str(2 * int(cpus)),  # the tables are files of one row group
        },
    )
    names = sys.argv[1:] or HEADLINE
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in names:  # warm-up: JIT, generated-code cache, Python workers
        catalog.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
