"""Headline queries on $BENCH_SF_DIR over local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from folio.plans import passages, registry, search

QUERIES = {**registry.QUERIES, **search.QUERIES, **passages.QUERIES}
#: The queries that touch every part of the engine; build_lexicon makes the postings that the lexical ones read.
HEADLINE = (
    "build_lexicon", "tokenize_term_freq", "bm25_topk", "exact_phrase_match", "rrf_fusion", "fixed_chunks_short", "chunk_scene_map", "similar_vectors", "context_vectors", "rank_metrics",
    "lexical_ranking", "exact_promotion", "context_uplift", "maxsim", "best_chunk_for_target", "structured_chunks",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        start = time.time()
        if name == "build_lexicon":
            registry.words_of(spark, folder)
        else:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
