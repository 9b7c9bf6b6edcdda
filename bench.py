"""Wall time per query; prints one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query after one warm-up (default 3, the median counts)
BENCH_QUERIES  space-separated names, or ``all`` (default: the headline queries)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from parley.plans import catalog
from parley.session import build_session


# One or two per operator family.
HEADLINE = """
slice_counts numeric_profile expectations anomaly_report speaker_split combine_inputs unique_names manifest_file_diff
infer_fields parse_tagged_lines token_f1 exact_match wer corpus_bleu chrf glossary_hits group_metrics disparities
config_search validation_table quartile_means leave_one_out turns speaker_summary interval_overlap utterances
emit_on_change active_config normalize_loudness noise_profile trim_silence utterance_stream session_windows gates
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    if names == ["all"]:
        names = list(catalog.QUERIES)
    spark = build_session(
        "parley-bench", f"local[{cpus}]",
        **{
            "spark__sql__shuffle__partitions": cpus,
            "spark__driver__memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark__ui__enabled": "false",
            "spark__ui__showConsoleProgress": "false",
            # tables of a few megabytes: keep all cores busy instead of one task per megabyte
            "spark__sql__adaptive__coalescePartitions__minPartitionSize": "64k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    failed: list[str] = []
    for name in names:
        took = []
        try:
            for i in range(runs + 1):
                start = time.perf_counter()
                catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                if i or runs == 0:
                    took.append(time.perf_counter() - start)
        except Exception as e:  # one broken query must not hide the others
            failed.append(name)
            print(f"{name}: {str(e)[:300]}", file=sys.stderr)
            continue
        times[name] = round(statistics.median(took), 4)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs, "failed": failed,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
