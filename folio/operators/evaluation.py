"""Ranking metrics over graded cases, all in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The normal quantile of the 95 % Wilson interval; cut-offs of hit@k; gate thresholds.
Z = 1.959963984540054
CUTS = (1, 3, 5, 10, 20, 50)
PROCEED_5, PROCEED_10, SUBSET_5, INVESTIGATE_5 = 0.70, 0.80, 0.60, 0.50
#: What cases are grouped by in reports; the categories of the gate's subset besides name-free usage.
GROUPS = ("category", "query_style", "name_usage")
SUBSET = ("name-free", "paraphrased-quotation")


def first_ranks(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """item_id, first: the best rank of a target of the item; null if none is ranked. targets: item_id, doc_id."""
    hits = targets.join(ranked, ["item_id", "doc_id"], "left")
    return hits.groupBy("item_id").agg(F.min("rank").alias("first"))


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 0) without cases."""
    p, z2 = hits / total, Z * Z
    centre, half = p + z2 / (2 * total), Z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total))
    low, high = ((centre + sign * half) / (1 + z2 / total) for sign in (-1, 1))
    return F.when(total <= 0, 0.0).otherwise(F.greatest(low, F.lit(0.0))), F.when(total <= 0, 0.0).otherwise(F.least(high, F.lit(1.0)))


def rank_metrics(firsts: DataFrame, *by: str) -> DataFrame:
    """by, n, mrr_10, mrr_50, and hit_k, low_k, high_k (Wilson bounds) for each cut-off."""
    mrr = [F.avg(F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(0.0)).alias(f"mrr_{k}") for k in (10, 50)]
    hit = [F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in CUTS]
    hits = [F.count(F.when(F.col("first") <= k, 1)).alias(f"__hits_{k}") for k in CUTS]
    out = firsts.groupBy(*by).agg(F.count("*").alias("n"), *mrr, *hit, *hits)
    bounds = [x.alias(f"{name}_{k}") for k in CUTS for name, x in zip(("low", "high"), wilson(F.col(f"__hits_{k}"), F.col("n")), strict=True)]
    return out.select(*by, "n", "mrr_10", "mrr_50", *[f"hit_{k}" for k in CUTS], *bounds)


def subset(cases: DataFrame) -> DataFrame:
    """The name-free and paraphrased cases. cases: first, category, query_style, name_usage."""
    return cases.where((F.col("name_usage") == "name-free") | F.col("category").isin(*SUBSET))


def reports(cases: DataFrame) -> DataFrame:
    """report, value, rank metrics: a row for each value of GROUPS; styles and usages that are unspecified are left out."""
    out = None
    for by in GROUPS:
        own = cases if by == "category" else cases.where(F.col(by) != "unspecified")
        own = rank_metrics(own.withColumns({"report": F.lit(by), "value": F.col(by)}), "report", "value")
        out = own if out is None else out.unionByName(own)
    return out


def target_recall(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """item_id, target_recall_k for each cut-off: the share of the item's targets that are ranked so far up."""
    hits = targets.select("item_id", "doc_id").distinct().join(ranked, ["item_id", "doc_id"], "left")
    return hits.groupBy("item_id").agg(*[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"target_recall_{k}") for k in CUTS])


def _decided(metrics: DataFrame, proceed: Column) -> DataFrame:
    both = (F.col("hit_5") >= PROCEED_5) & (F.col("hit_10") >= PROCEED_10)
    return metrics.withColumn("decision", F.when(both & proceed, "proceed").when(F.col("hit_5") >= INVESTIGATE_5, "investigate-once").otherwise("stop-or-rethink"))


def gate(metrics: DataFrame, special: DataFrame | None = None) -> DataFrame:
    """metrics with decision: proceed, investigate-once or stop-or-rethink.

    special: rank metrics of the subset, one row; where it is missing or has no cases, no decision is to proceed.
    """
    if special is None:
        return _decided(metrics, F.lit(False))
    one = special.agg(F.max("hit_5").alias("__subset"))
    return _decided(metrics.crossJoin(F.broadcast(one)), F.coalesce(F.col("__subset") >= SUBSET_5, F.lit(False))).drop("__subset")


def partial_gate(metrics: DataFrame) -> DataFrame:
    """As gate, without the subset's condition: for benchmarks that don't say which cases belong to it."""
    return _decided(metrics, F.lit(True))


def ndcg(ranked: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """item_id, ndcg: gain 2^grade - 1, discount log2(rank + 1), against the best order of the item's grades."""
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    got = grades.join(ranked.where(F.col("rank") <= k), ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.sum(F.coalesce(gain(F.col("grade")) / F.log2(F.col("rank") + 1), F.lit(0.0))).alias("dcg"), F.slice(F.sort_array(F.collect_list("grade"), False), 1, k).alias("g"))
    best = F.aggregate(F.transform("g", lambda x, i: gain(x) / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    return got.select("item_id", F.when(best > 0, F.col("dcg") / best).otherwise(0.0).alias("ndcg"))


def percentiles(values: DataFrame, value: str, *by: str) -> DataFrame:
    """by, n, average, p50, p95, most: nearest-rank percentiles at index (n - 1) * f, rounded half to even.

    Equal values are counted before they meet, so a group's task holds its distinct values.
    """
    counts = values.groupBy(*by, value).agg(F.count("*").alias("m"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("m").over(upto)).withColumn("n", F.sum("m").over(whole))
    at = [F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * f), F.col(value))).alias(name) for f, name in ((0.5, "p50"), (0.95, "p95"))]
    return placed.groupBy(*by, "n").agg((F.sum(F.col(value) * F.col("m")) / F.first("n")).alias("average"), *at, F.max(value).alias("most"))


def target_ranks(results: DataFrame, targets: DataFrame, strategy: str = "midpoint", least: int = 20) -> DataFrame:
    """item_id, target, grade, rank of each result that matches a target.

    results: item_id, rank, doc_id, word_start, word_end (of the context, where a result shows one); targets: item_id,
    target, doc_id, s, e, grade.
    """
    if strategy not in ("midpoint", "overlap"):
        raise ValueError("passages match by midpoint or overlap")
    both = targets.join(results.select("item_id", "doc_id", "rank", "word_start", "word_end"), ["item_id", "doc_id"])
    middle = F.floor((F.col("s") + F.col("e") - 1) / 2)
    shared = F.greatest(F.least("word_end", "e") - F.greatest("word_start", "s"), F.lit(0))
    hit = (F.col("word_start") <= middle) & (middle < F.col("word_end")) if strategy == "midpoint" else shared >= F.least(F.lit(least), F.col("e") - F.col("s"))
    return both.where(hit).select("item_id", "target", "grade", "rank")


def passage_metrics(results: DataFrame, targets: DataFrame, strategy: str = "midpoint", least: int = 20) -> DataFrame:
    """item_id, first, target_recall_k, ndcg_5, ndcg_10 of every item with targets.

    A target is credited once, at its first rank; a result earns the best grade that it is the first to match.
    """
    firsts = target_ranks(results, targets, strategy, least).groupBy("item_id", "target", "grade").agg(F.min("rank").alias("rank"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    earned = firsts.groupBy("item_id", "rank").agg(F.max("grade").alias("grade"))
    dcg = earned.groupBy("item_id").agg(*[F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}") for k in (5, 10)])
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("grade"), "target"))
    ideal = targets.select("item_id", "target", "grade").withColumn("best", place).where("best <= 10")
    ideal = ideal.groupBy("item_id").agg(*[F.sum(F.when(F.col("best") <= k, gain / F.log2(F.col("best") + 1)).otherwise(0.0)).alias(f"ideal_{k}") for k in (5, 10)])
    found = targets.select("item_id", "target").join(firsts.select("item_id", "target", "rank"), ["item_id", "target"], "left")
    recall = found.groupBy("item_id").agg(F.min("rank").alias("first"), *[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"target_recall_{k}") for k in CUTS])
    out = recall.join(ideal, "item_id").join(dcg, "item_id", "left")
    ndcgs = [F.when(F.col(f"ideal_{k}") > 0, F.coalesce(f"dcg_{k}", F.lit(0.0)) / F.col(f"ideal_{k}")).otherwise(0.0).alias(f"ndcg_{k}") for k in (5, 10)]
    return out.select("item_id", "first", *[f"target_recall_{k}" for k in CUTS], *ndcgs)


def trace(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What flat results (item_id, rank, pos, doc_id) say of stages: chapters (item_id, doc_id, chapter_rank) and candidates (item_id, pos, within_rank)."""
    first = results.groupBy("item_id", "doc_id").agg(F.min("rank").alias("rank"))
    chapters = first.select("item_id", "doc_id", F.row_number().over(Window.partitionBy("item_id").orderBy("rank")).alias("chapter_rank"))
    within = F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy("rank"))
    return chapters, results.select("item_id", "pos", within.alias("within_rank"))


def stages(firsts: DataFrame, targets: DataFrame, matches: DataFrame, chapters: DataFrame, candidates: DataFrame, retained: DataFrame, shortlist: int = 20) -> DataFrame:
    """A row for each item: where it succeeded or failed.

    firsts: item_id, first; targets: item_id, target, doc_id; matches: item_id, target, pos of all chunks that match a
    target. Gives shortlist_rank, covered, kept (bool), candidate_recall, retained_recall, within_rank, passed and
    failure: pass, wrong-chapter, target-absent or target-misranked.
    """
    short = targets.select("item_id", "doc_id").distinct().join(chapters, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("chapter_rank").alias("shortlist_rank"))
    seen = matches.join(candidates, ["item_id", "pos"]).groupBy("item_id", "target").agg(F.min("within_rank").alias("within_rank"))
    held = matches.join(retained.select("item_id", "pos"), ["item_id", "pos"]).select("item_id", "target", F.lit(True).alias("kept")).distinct()
    each = targets.select("item_id", "target").distinct().join(seen, ["item_id", "target"], "left").join(held, ["item_id", "target"], "left")
    out = each.groupBy("item_id").agg(
        F.avg(F.when(F.col("within_rank").isNotNull(), 1.0).otherwise(0.0)).alias("candidate_recall"), F.avg(F.when(F.col("kept"), 1.0).otherwise(0.0)).alias("retained_recall"), F.min("within_rank").alias("within_rank")
    )
    out = firsts.select("item_id", "first").join(out, "item_id", "left").join(short, "item_id", "left").na.fill(0.0, ["candidate_recall", "retained_recall"])
    covered, passed = F.col("candidate_recall") > 0, F.coalesce(F.col("first") <= 5, F.lit(False))
    wrong = F.coalesce(F.col("shortlist_rank") > shortlist, F.lit(True))
    failure = F.when(passed, "pass").when(covered, "target-misranked").when(wrong, "wrong-chapter").otherwise("target-absent")
    return out.withColumns({"covered": covered, "kept": F.col("retained_recall") > 0, "passed": passed, "failure": failure})


def stage_metrics(rows: DataFrame, shortlist: int = 20) -> DataFrame:
    """One row over all items of `stages`: recalls, coverages, oracle hits, recalls among covered items, failures."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    of_covered = lambda c: F.coalesce(F.avg(F.when(F.col("covered"), F.when(c, 1.0).otherwise(0.0))), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("cases"),
        *[share(F.col("shortlist_rank") <= k).alias(f"chapter_recall_{k}") for k in (1, 5, 10, 20)],
        share(F.col("covered")).alias("candidate_coverage"),
        F.avg("candidate_recall").alias("candidate_target_recall"),
        share(F.col("kept")).alias("retained_coverage"),
        F.avg("retained_recall").alias("retained_target_recall"),
        share(F.col("shortlist_rank") <= shortlist).alias("shortlist_oracle_5"),
        of_covered(F.col("first") <= 5).alias("conditional_recall_5"),
        *[of_covered(F.col("within_rank") <= k).alias(f"within_chapter_recall_{k}") for k in (1, 3, 5)],
        *[F.count(F.when(F.col("failure") == kind, 1)).alias(kind.replace("-", "_")) for kind in ("wrong-chapter", "target-absent", "target-misranked")],
    )


def evaluate(results: DataFrame, chunks: DataFrame, targets: DataFrame, cases: DataFrame, chapters: DataFrame | None = None, candidates: DataFrame | None = None, retained: DataFrame | None = None, strategy: str = "midpoint", least: int = 20, shortlist: int = 20) -> dict[str, DataFrame]:
    """All reports of a run (results: item_id, rank, pos and, if shown, context_start, context_end) as frames: cases, overall (with the decision), groups, stages.

    cases: item_id, category, query_style, name_usage. Without chapters, candidates and retained, results speak for them.
    """
    placed = results.join(chunks.select("pos", "doc_id", "word_start", "word_end"), "pos") if "doc_id" not in results.columns else results.join(chunks.select("pos", "word_start", "word_end"), "pos")
    shown = placed if "context_start" not in placed.columns else placed.withColumns({"word_start": F.coalesce("context_start", "word_start"), "word_end": F.coalesce("context_end", "word_end")})
    if chapters is None:
        chapters, candidates = trace(placed)
        retained = candidates
    metrics = passage_metrics(shown, targets, strategy, least)
    every = chunks.select("doc_id", "pos", "word_start", "word_end").join(targets.select("item_id", "doc_id").distinct(), "doc_id")
    matches = target_ranks(every.withColumn("rank", F.col("pos")), targets, strategy, least).select("item_id", "target", F.col("rank").alias("pos"))
    rows = cases.join(metrics, "item_id", "left").join(stages(metrics, targets, matches, chapters, candidates, retained, shortlist).drop("first"), "item_id", "left")
    extra = [F.avg(c).alias(c) for c in (*[f"target_recall_{k}" for k in CUTS], "ndcg_5", "ndcg_10")]
    overall = gate(rank_metrics(rows), rank_metrics(subset(rows))).crossJoin(F.broadcast(rows.agg(*extra)))
    return {"cases": rows, "overall": overall, "groups": reports(rows), "stages": stage_metrics(rows, shortlist)}
