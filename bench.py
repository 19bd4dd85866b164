"""Wall seconds of the headline queries, warm second run; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from quillspark.plans.catalog import all_queries  # noqa: E402
from quillspark.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = """sentence_split_p1 quality_gate_p2 clean_t5 clean_documents_t5 two_tier_route_t7
batch_rewriter_t9 source_dedupe_j3 word_match_j2 full_mix_c10 real_text_pairs_g7
spelling_pairs_g8 exact_group_quota_o5 shuffle_o1 verdict_e8 latency_summary_a4
skewed_percentile_w8 tokenised_pairs_l1 padded_batches_l3 debounce_d1 hold_pairing_j11
state_timeline_w6 review_timeout_j8 history_last_n_w1 stream_sessions_st2
stream_debounce_st3""".split()


def run(spark, fn) -> float:
    t0 = time.perf_counter()
    fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    os.chdir(ROOT)
    spark = local_session("bench", CPUS)
    catalog = all_queries()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run(spark, catalog[name][0])
        times[name] = round(run(spark, catalog[name][0]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    extra = {}
    if "clean_documents_t5" in times:
        n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
        extra["cleaned_documents_per_sec"] = round(n / times["clean_documents_t5"])
    spark.stop()
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")),
                      **extra}))


if __name__ == "__main__":
    main()
