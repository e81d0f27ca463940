"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is forced end to end with the ``noop`` sink (no collect to the
driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans import catalog  # noqa: E402
from quire.session import local_session  # noqa: E402

HEADLINE = [
    "topk_batch", "topk_single", "text_search", "topk_predicates", "topk_time_range",
    "rag_search", "default_answer", "calendar_events", "summary_text", "embedding_text",
    "page_assembly", "last_partial", "upsert_update", "delete_ids", "folder_get_or_create",
    "hash_embed_stats", "record_parse", "ann_topk",
]


def compare_strategies(spark, sf_dir: str) -> dict:
    """
    one SQL-expression top-k per question (the reference's one-search-per-call shape), the blocked
    kernel for all questions at once, and the IVF index (build, search, recall against exact)."""
    from quire.operators import search
    from quire.operators.ivf import IvfIndex
    from quire.plans import derived
    from quire.session import reliable_checkpoint, scratch_path

    k = 5
    store = reliable_checkpoint(derived.vector_store(spark, sf_dir).select("id", "embedding"))
    qs = reliable_checkpoint(derived.label_questions(spark, sf_dir))
    qrows = qs.collect()  # one row per label: bounded
    out = {"questions": len(qrows), "vectors": store.count(), "k": k}

    t0 = time.perf_counter()
    per_q = {}
    for r in qrows:
        per_q[r["query_id"]] = [x["id"] for x in search.nearest_one(store, list(r["embedding"]), k=k).collect()]
    out["exact_sql_per_question_sec"] = round(time.perf_counter() - t0, 3)

    t0 = time.perf_counter()
    exact = search.nearest(store, qs, k=k).select("query_id", "id").collect()
    out["exact_blocked_sec"] = round(time.perf_counter() - t0, 3)
    exact_pairs = {(r["query_id"], r["id"]) for r in exact}
    out["exact_strategies_agree"] = exact_pairs == {(q, i) for q, ids in per_q.items() for i in ids}

    t0 = time.perf_counter()
    idx = IvfIndex(spark, scratch_path(spark, "bench-ivf")).build(store, n_cells=16)
    out["ann_ivf_build_sec"] = round(time.perf_counter() - t0, 3)
    for name, strategy, nprobe in (("ann_ivf_nprobe4_sec", "broadcast", 4), ("ann_ivf_nprobe8_sec", "broadcast", 8),
                                   ("ann_ivf_grouped_nprobe4_sec", "grouped", 4)):
        t0 = time.perf_counter()
        got = idx.search(qs, k=k, nprobe=nprobe, fallback=False, strategy=strategy).select("query_id", "id").collect()
        out[name] = round(time.perf_counter() - t0, 3)
        out[name.replace("_sec", "_recall")] = round(len({(r["query_id"], r["id"]) for r in got} & exact_pairs)
                                                     / max(len(exact_pairs), 1), 4)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="quire-bench")
    # warm-up: JVM, Python workers, parquet footers
    catalog.QUERIES["record_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    strategies = compare_strategies(spark, sf_dir)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None, "search_strategies": strategies}))
    spark.stop()


if __name__ == "__main__":
    main()
