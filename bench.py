"""Bench: times headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names or ``all``; default the headline list).
"""

import json
import os
import sys
import time

from tablequarry.plans import QUERIES
from tablequarry.session import local_session

HEADLINE = [
    "a2_slot_batch", "e2_execution_strict", "e5_clauses", "g4_generalise", "a7_pattern_counts", "g17_examples", "x3_masking", "x4_column_label_ids",
    "x9_header_input", "j4_exact_links", "j7_cell_links", "j8_word_ids", "a10_vocabulary", "x1_piece_counts", "e8_part_matches", "e12_rolled_scores",
    "k6_execution_guided", "j11_join_chain", "a4_group_by", "w2_top_k", "w7_document_number", "s17_cells",
]


def run(query, spark, folder):
    start = time.time()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    run(QUERIES["a4_group_by"], spark, folder)  # starts the executors; not timed
    run(QUERIES["p12_spoken"], spark, folder)
    times = {}
    for name in names:
        try:
            times[name] = round(run(QUERIES[name], spark, folder), 3)
            print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        except Exception as err:  # a failed query is reported, the others still run
            times[name] = None
            print(f"{name}: {type(err).__name__} {str(err)[:300]}", file=sys.stderr, flush=True)
    extra = {}
    n = spark.read.parquet(f"{folder}/orders.parquet").count()
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    for label, name, rows in (
        ("slot_queries_per_sec", "a2_slot_batch", n), ("masked_rows_per_sec", "x3_masking", n), ("linked_questions_per_sec", "j4_exact_links", n),
        ("tokenised_documents_per_sec", "x1_piece_counts", docs),
    ):
        if times.get(name):
            extra[label] = round(rows / times[name], 1)
    total = round(sum(v for v in times.values() if v is not None), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")), "rates": extra}))
    spark.stop()


if __name__ == "__main__":
    main()
