"""Runs the headline queries and prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import sys
import time

from gleaner import catalog
from gleaner.session import local_session, ship_package

HEADLINE = (
    "flagship", "c_match_lines", "d_match_groups", "f_chunk_scores", "f_chunk_scores_code", "g_exact_dups", "h_tfidf_rerank", "i_bm25_topk", "i_tfidf_window_topk",
    "i_dense_topk", "j_churn", "j_cochange_pairs", "j_anchor_lift", "k_pack_hybrid", "p_focus_terms", "r_file_rank", "r_hit_rate", "x_event_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores, "bench")
    ship_package(spark)
    spark.range(1000).selectExpr("sum(id)").collect()
    found = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
