"""Training data for rerankers: hard negatives, triples, folds that keep scenes whole."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.narrative import holds_name, query_names
from folio.sources.tables import small, stored


def hard_negatives(results: DataFrame, chunks: DataFrame, positives: DataFrame, matches: DataFrame, queries: DataFrame, per_case: int = 8, split: str = "development") -> DataFrame:
    """item_id, pos, rank, kind, place of the negatives of each item: confusable passages that match none of its targets.

    results: item_id, rank, pos; positives: item_id, pos (best chunk of each target); matches: item_id, pos of all chunks
    that match a target. Half of an item's places (one at least) go to passages of its chapters, half of the rest (one
    at least) to its books' passages with a name of the query, the others to any; what a kind leaves is filled in the
    order any, chapter, names. Never from an acceptance split.
    """
    if split == "acceptance":
        raise ValueError("an acceptance benchmark must not be mined")
    if not 1 <= per_case <= 50:
        raise ValueError("negatives per case must be between 1 and 50")
    # Results and positives are broadcast where they are few, so that no chunk's text is shuffled.
    where = stored(small(positives.select("item_id", "pos")).join(chunks.select("pos", "doc_id", "book"), "pos"), "positives")
    left = results.join(positives, ["item_id", "pos"], "left_anti").join(matches.select("item_id", "pos"), ["item_id", "pos"], "left_anti")
    own = stored(small(left).join(chunks.select("pos", "doc_id", "book", "text"), "pos"), "results")
    own = own.join(where.select("item_id", "doc_id").distinct().withColumn("in_chapter", F.lit(True)), ["item_id", "doc_id"], "left")
    own = own.join(where.select("item_id", "book").distinct().withColumn("in_book", F.lit(True)), ["item_id", "book"], "left")
    own = own.join(queries.select("item_id", query_names(F.col("query")).alias("wanted")), "item_id")
    named = F.col("in_book") & holds_name(F.col("text"), F.col("wanted"))
    own = own.withColumn("kind", F.when(F.col("in_chapter"), "same-chapter").when(named, "same-entity").otherwise("global"))
    chapter = max(1, per_case // 2)
    entity = max(1, (per_case - chapter) // 2)
    nth = F.row_number().over(Window.partitionBy("item_id", "kind").orderBy("rank"))
    own = own.withColumn("nth", nth)
    # The first round takes the quotas in this order, the second what they left.
    turn = F.when((F.col("kind") == "same-chapter") & (F.col("nth") <= chapter), 0).when((F.col("kind") == "same-entity") & (F.col("nth") <= entity), 1)
    turn = turn.when(F.col("kind") == "global", 2).when(F.col("kind") == "same-chapter", 3).otherwise(4)
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(turn, "rank")))
    return own.where(F.col("place") <= per_case).select("item_id", "pos", "rank", "kind", "place")


def triples(positives: DataFrame, negatives: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_id, query, positive, negative: texts of every positive of an item with each of its negatives (at most 50)."""
    text = lambda df, name: df.select("item_id", "pos").join(chunks.select("pos", F.col("text").alias(name)), "pos").select("item_id", name)
    return queries.select("item_id", "query").join(text(positives, "positive"), "item_id").join(text(negatives, "negative"), "item_id")


def scene_folds(cases: list[dict], folds: int = 5, seed: int = 17) -> list[list[dict]]:
    """Cases (id, scene_id, books, query_style, name_usage) dealt into folds, each scene whole, strata spread evenly.

    A benchmark is a small file, so this is plain Python. The order within a stratum is random.Random(f"{seed}:{stratum!r}").
    """
    scenes: dict[str, list[dict]] = defaultdict(list)
    for case in cases:
        scenes[case.get("scene_id") or case["id"]].append(case)
    if folds < 2 or len(scenes) < folds:
        raise ValueError("there must be two folds at least, and no more than scenes")
    strata: dict[tuple, list[list[dict]]] = defaultdict(list)
    for own in scenes.values():
        books = tuple(sorted({b for c in own for b in c["books"]}))
        strata[books, tuple(sorted({c["query_style"] for c in own})), tuple(sorted({c["name_usage"] for c in own}))].append(own)
    out: list[list[dict]] = [[] for _ in range(folds)]
    for stratum in sorted(strata, key=repr):
        order, held = strata[stratum], [0] * folds
        random.Random(f"{seed}:{stratum!r}").shuffle(order)
        for own in order:
            to = min(range(folds), key=lambda f: (held[f], len(out[f]), f))
            out[to] += own
            held[to] += 1
    place = {c["id"]: k for k, c in enumerate(cases)}
    return [sorted(fold, key=lambda c: place[c["id"]]) for fold in out]


def fold_splits(cases: list[dict], folds: list[list[dict]]) -> list[tuple[list[dict], list[dict]]]:
    """(training, validation) cases of each fold."""
    return [([c for c in cases if c["id"] not in {x["id"] for x in fold}], fold) for fold in folds]
