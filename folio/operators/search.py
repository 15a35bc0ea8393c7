"""Semantic, hybrid and hierarchical search over passages, for all queries in one plan.

chunks: pos, doc_id (chapter), ordinal, word_start, word_end, book, pov, text, embedding. queries: item_id, query, q (its
vector). pos orders equal scores. Scores and statistics are of all chunks; filters choose what may be ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import dot
from folio.operators import evidence, fusion, lexical, scan
from folio.operators.models import Reranker
from folio.sources.tables import hint, small, stored

#: Fixed value: what agreement between the semantic and the lexical rank weighs in a passage's final score.
AGREEMENT = 0.10
#: Query vectors that fit a worker; beyond them scores are joined.
MOST_SOURCES = 100_000


def _between(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


@dataclass(frozen=True)
class Options:
    """Defaults and ranges of a search's options."""

    top: int = 10
    semantic_weight: float = 0.5
    evidence_weight: float = 0.0
    event_weight: float = 0.0
    candidate_pool: int = 50
    one_per_chapter: bool = False
    chapter_candidates: int = 20
    passages_per_chapter: int = 8
    passage_pool: int = 200
    chapter_passages: int = 3
    chapter_weight: float = 0.25
    neighbor_weight: float = 0.10
    retention: str = "per-chapter"
    rerank_candidates: int = 20
    rerank_words: int = 0
    rerank_weight: float = 1.0

    def __post_init__(self):
        _between("top", self.top, 1, 100)
        for name in ("semantic_weight", "evidence_weight", "event_weight", "rerank_weight"):
            _between(name, getattr(self, name), 0, 1)
        _between("candidate_pool", self.candidate_pool, 1, 500)
        _between("chapter_candidates", self.chapter_candidates, 1, 100)
        _between("passages_per_chapter", self.passages_per_chapter, 1, 20)
        _between("passage_pool", self.passage_pool, self.chapter_candidates, 2000)
        _between("chapter_passages", self.chapter_passages, 1, 10)
        _between("rerank_candidates", self.rerank_candidates, 1, 100)
        _between("rerank_words", self.rerank_words, 0, 500)
        if min(self.chapter_weight, self.neighbor_weight) < 0:
            raise ValueError("weights must not be negative")
        if self.retention not in ("per-chapter", "global"):
            raise ValueError("retention must be per-chapter or global")


@dataclass(frozen=True)
class Cut:
    """Whole chapters (doc_id, book, pov, text) of which the chunks are the fixed_chunks of a profile: read once instead of the chunks where the queries fit a worker. identity: a chunk's pos by arrays of doc_id and ordinal; embed: vectors of texts in UTF-8."""

    chapters: DataFrame
    identity: Callable[[np.ndarray, np.ndarray], np.ndarray]
    embed: Callable[[list[bytes]], np.ndarray]
    profile: str = "short"


def normalised(queries: DataFrame) -> DataFrame:
    """queries with single blanks; an empty one ends the job with an error."""
    text = F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"(?U)\s+", " "))
    return queries.withColumn("query", F.when(text == "", F.raise_error(F.lit("a query must not be empty"))).otherwise(text))


def eligible(chunks: DataFrame, povs: Collection[str] | str | None = None, book: str | None = None) -> DataFrame:
    """The chunks that may be ranked. Unknown values are errors; povs are compared in upper case, the book in lower case."""
    return chunks.where(_wanted(chunks, povs, book))


def _wanted(chunks: DataFrame, povs: Collection[str] | str | None, book: str | None) -> Column:
    out = F.lit(True)
    if povs is not None:
        wanted = {p.upper() for p in ([povs] if isinstance(povs, str) else povs)}
        if not wanted:
            raise ValueError("the pov filter must hold at least one value")
        out = out & _known(chunks, F.upper("pov"), wanted, "pov")
    if book is not None:
        held = chunks if povs is None else chunks.where(out)
        out = out & _known(held, F.lower("book"), {book.casefold()}, "book")
    return F.coalesce(out, F.lit(False))


def _known(chunks: DataFrame, column: Column, wanted: set[str], what: str) -> Column:
    # A look at the wanted values alone; all values are listed only for the error.
    found = {r[0] for r in chunks.where(column.isin(*wanted)).select(column.alias("x")).distinct().collect()}
    if unknown := wanted - found:
        choices = sorted(r[0] for r in chunks.select(column.alias("x")).where("x is not null").distinct().orderBy("x").limit(50).collect())
        raise ValueError(f"unknown {what} {', '.join(sorted(unknown))}; choose one of: {', '.join(choices)}")
    return column.isin(*wanted)


def semantic_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """item_id, pos, score: dot products of a stated set of query vectors with all chunks."""
    q = small(queries.select("item_id", "q"))
    pairs = chunks.where(F.col("embedding").isNotNull()).select("pos", "embedding").join(q, F.col("q").isNotNull())
    return pairs.select("item_id", "pos", dot(F.col("embedding"), F.col("q")).alias("score"))


def lifted(raw: DataFrame, other: DataFrame, weight: float) -> DataFrame:
    """raw scores, raised by a share of what the other ones (of the context, or of the best scene window) are above them."""
    _between("weight", weight, 0, 1)
    both = raw.join(other.select("item_id", "pos", F.col("score").alias("other")), ["item_id", "pos"], "left")
    return both.select("item_id", "pos", (F.col("score") + weight * F.greatest(F.coalesce(F.col("other") - F.col("score"), F.lit(0.0)), F.lit(0.0))).alias("score"))


def best_related(scores: DataFrame, related: DataFrame) -> DataFrame:
    """item_id, pos, score: of each chunk the best score of its windows or events. related: pos, other; scores: item_id, other, score."""
    return related.join(scores, "other").groupBy("item_id", "pos").agg(F.max("score").alias("score"))


def combined_base(passages: DataFrame, scenes: DataFrame, weight: float) -> DataFrame:
    """item_id, pos, score: BM25 of passages and of their best scene windows, each against its query's best; weight 0 leaves passages as they are."""
    _between("scene weight", weight, 0, 1)
    if not weight:
        return passages

    def shares(df: DataFrame, w: float) -> DataFrame:
        most = df.groupBy("item_id").agg(F.max("score").alias("most"))
        return df.join(most, "item_id").select("item_id", "pos", F.when(F.col("most") > 0, F.col("score") / F.col("most") * w).otherwise(0.0).alias("score"))

    return shares(passages, 1 - weight).unionByName(shares(scenes, weight)).groupBy("item_id", "pos").agg(F.sum("score").alias("score"))


def scene_base(chunks: DataFrame, windows: DataFrame, queries: DataFrame, weight: float, k: int | None = None) -> DataFrame:
    """item_id, pos, score: combined_base of BM25 of the chunks and of their best scene windows, those that share a word with them.

    windows: doc_id, ordinal, word_start, word_end, text. k: rows that can't be among the k best of their query may be missing.
    """
    _between("scene weight", weight, 0, 1)
    one = scan.asked_of(queries) if weight else None
    if one is None:
        own = lexical.bm25(chunks.select(F.col("pos").alias("doc_id"), "text"), queries).withColumnRenamed("doc_id", "pos")
        if not weight:
            return own
        far = lexical.bm25(windows.select(F.struct("doc_id", "ordinal").alias("doc_id"), "text"), queries).withColumnRenamed("doc_id", "other")
        a = chunks.select("doc_id", "pos", F.col("word_start").alias("a"), F.col("word_end").alias("b"))
        near = a.join(windows, "doc_id").where("word_start < b and a < word_end").select("pos", F.struct("doc_id", "ordinal").alias("other"))
        return combined_base(own, best_related(far, near), weight)
    place = (F.col("doc_id").alias("chapter"), F.col("word_start").alias("s"), F.col("word_end").alias("e"))
    both = chunks.select(*place, F.col("pos").alias("id"), F.lit(False).alias("scene"), "text").unionByName(windows.select(*place, F.lit(None).cast(chunks.schema["pos"].dataType).alias("id"), F.lit(True).alias("scene"), "text"))
    return scan.scene_scores(scan.chaptered(scan.encoded(both, one)), one, queries.schema["item_id"].dataType.simpleString(), weight, k)


def chapter_scene_base(docs: DataFrame, queries: DataFrame, weight: float, identity: Callable, k: int | None = None, profile: str = "short") -> DataFrame | None:
    """scene_base of the fixed chunks and scene windows of whole chapters (doc_id, text), which are read once and not shuffled; None where the queries are too many for a worker. identity: a chunk's pos by arrays of doc_id and ordinal."""
    _between("scene weight", weight, 0, 1)
    if not weight or (one := scan.asked_of(queries)) is None:
        return None
    return scan.scene_scores(scan.scene_units(docs, one, profile, identity), one, queries.schema["item_id"].dataType.simpleString(), weight, k)


def lexical_features(chunks: DataFrame, queries: DataFrame, partial: bool = False, words: lexical.Lexicon | None = None, base: DataFrame | None = None) -> DataFrame:
    """item_id, pos, base, exact, coverage, proximity, phrase, evidence, score of every chunk with a term of the query.

    words: the chunks' lexicon, if there is one; base: other base scores (item_id, pos, score) than BM25 of the chunks.
    """
    words = lexical.lexicon(chunks.select(F.col("pos").alias("doc_id"), "text")).stored() if words is None else words
    base = None if base is None else base.withColumnRenamed("pos", "doc_id")
    out = evidence.lexical_scores(words, queries.select("item_id", "query"), strict=not partial, base=base).withColumnRenamed("doc_id", "pos")
    return out.withColumn("evidence", evidence.COVERAGE * F.col("coverage") + evidence.PROXIMITY * F.col("proximity") + evidence.PHRASE * F.col("phrase"))


def ranks(scores: DataFrame, limit: int | None, positive: bool, score: str = "score") -> DataFrame:
    """item_id, pos, rank of the finite scores by (score desc, pos)."""
    w = Window.partitionBy("item_id").orderBy(F.round(score, lexical.TIE).desc(), "pos")
    good = scores.where(~F.isnan(score) & (F.abs(F.col(score)) < float("inf")))
    good = good.where(F.col(score) > 0) if positive else good
    out = good.withColumn("rank", F.row_number().over(w))
    return (out if limit is None else out.where(F.col("rank") <= limit)).select("item_id", "pos", "rank")


def selected(scores: DataFrame, chunks: DataFrame, top: int | None = None, one_per_chapter: bool = False, excluded: DataFrame | None = None) -> DataFrame:
    """item_id, rank, pos, score: by score, no two of a chapter that overlap, or one a chapter. excluded: item_id, pos that are left out."""
    placed = ranks(scores if excluded is None else scores.join(excluded, ["item_id", "pos"], "left_anti"), None, False).join(chunks.select("pos", "doc_id", "word_start", "word_end"), "pos")
    kept = fusion.one_each(placed, "doc_id") if one_per_chapter else fusion.without_overlap(placed)
    w = Window.partitionBy("item_id").orderBy("rank")
    out = kept.select("item_id", F.col("rank").alias("before"), F.row_number().over(w).alias("rank"))
    out = out if top is None else out.where(F.col("rank") <= top)
    back = placed.select("item_id", F.col("rank").alias("before"), "pos")
    return out.join(back, ["item_id", "before"]).join(scores.select("item_id", "pos", "score"), ["item_id", "pos"]).select("item_id", "rank", "pos", "score")


def semantic_search(chunks: DataFrame, queries: DataFrame, options: Options = Options(), povs=None, book=None, scores: DataFrame | None = None) -> DataFrame:
    """item_id, rank, pos, score."""
    if scores is None and (found := _nearest_apart(eligible(chunks, povs, book), queries, options)) is not None:
        return found
    scores = semantic_scores(chunks, queries) if scores is None else scores
    own = scores.join(eligible(chunks, povs, book).select("pos"), "pos", "left_semi")
    return selected(own, chunks, options.top, options.one_per_chapter)


def _nearest_apart(own: DataFrame, queries: DataFrame, options: Options, excluded: DataFrame | None = None) -> DataFrame | None:
    """item_id, rank, pos, score of the nearest of the chunks, chapter by chapter; None where the queries are too many for a worker. excluded: item_id, pos."""
    few = queries.select("item_id", "q").where("q is not null")
    if few.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        return None
    rows = few.orderBy("item_id").collect()  # at most MOST_SOURCES
    items = [r.item_id for r in rows]
    if not items or len(set(items)) < len(items):
        return None
    out = None
    if excluded is not None:
        number = {x: k for k, x in enumerate(items)}
        pairs = sorted((r.pos, number[r.item_id]) for r in excluded.select("item_id", "pos").collect() if r.item_id in number)  # a chunk's neighbours and copies in its chapter
        out = np.array([p for p, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64)
    units = own.groupBy(F.col("doc_id").alias("chapter")).agg(F.collect_list(F.struct(F.col("pos").alias("id"), F.col("word_start").alias("s"), F.col("word_end").alias("e"), "embedding")).alias("units"))
    found = scan.nearest_apart(units, items, queries.schema["item_id"].dataType.simpleString(), np.array([r.q for r in rows], float), options.top, options.one_per_chapter, out)
    w = Window.partitionBy("item_id").orderBy(F.round("score", lexical.TIE).desc(), "pos")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= options.top).select("item_id", "rank", "pos", "score")


def similar_chunks(chunks: DataFrame, sources: DataFrame, options: Options = Options(), povs=None, book=None) -> DataFrame:
    """item_id (the source's pos), rank, pos, score: nearest chunks, without the source and, in its chapter, what overlaps it, adjoins it or has its text."""
    q = sources.select(F.col("pos").alias("item_id"), F.col("embedding").alias("q"))
    s = small(sources.select(F.col("pos").alias("item_id"), "doc_id", F.col("ordinal").alias("o"), F.col("word_start").alias("a"), F.col("word_end").alias("b"), F.md5("text").alias("t")))
    near = ((F.col("word_start") < F.col("b")) & (F.col("a") < F.col("word_end"))) | (F.abs(F.col("ordinal") - F.col("o")) <= 1) | (F.md5("text") == F.col("t"))
    beside = chunks.join(s, "doc_id").where(near | (F.col("pos") == F.col("item_id"))).select("item_id", "pos")
    if (found := _nearest_apart(eligible(chunks, povs, book), q, options, beside)) is not None:
        return found
    own = semantic_scores(chunks, q).join(eligible(chunks, povs, book).select("pos"), "pos", "left_semi")
    return selected(own, chunks, options.top, options.one_per_chapter, beside)


def _scanned(chunks: DataFrame, queries: DataFrame, may: Column, cut: Cut | None = None) -> tuple[scan.Scan, DataFrame] | None:
    """The chunks that may rank, chapter by chapter, with vectors; and where all chunks stand. None where the queries are too many for a worker."""
    asked = queries.select("item_id", "query")
    if cut is None:
        out = scan.of_passages(chunks, asked, F.col("pos"), more={"may": may, "embedding": F.col("embedding")})
    else:
        out = scan.of_chapters(cut.chapters.withColumn("may", may), asked, cut.profile, cut.identity, cut.embed, chunks.schema["pos"].dataType.simpleString())
    if out is None or not out.asked.items:
        return None
    rows = {r.item_id: r.q for r in queries.select("item_id", "q").collect()}  # at most scan.MOST_QUERIES
    size = max((len(v) for v in rows.values() if v is not None), default=1)
    vectors = np.array([[np.nan] * size if rows[i] is None else rows[i] for i in out.asked.items], float)
    # Read from the stored rows, as the chunks may be made of whole texts each time.
    at = out.rows.select(F.col("chapter").alias("doc_id"), F.inline(F.transform("units", lambda u: F.struct(u["id"].alias("pos"), u["ordinal"].alias("ordinal"), u["s"].alias("word_start"), u["e"].alias("word_end"), u["may"].alias("may")))))
    return replace(out.only(lambda u: u["may"]), vectors=vectors), at


def _scanned_signals(found: scan.Scan, options: Options, pool: int | None, events: DataFrame | None):
    """As _signals, of a scan; pool: rows that reach no signal's pool and aren't exact may be missing."""
    by = ("score", "evidence") if options.evidence_weight else ("score",)
    # Computed once: ranks, exact phrases and evidence all read them.
    semantic = stored(found.semantic(pool), "semantic")
    features = stored(found.scores(not options.evidence_weight, pool, by, "pos", exact=True), "features")
    return _weighted(semantic, features, options, events)


def _signals(own: DataFrame, chunks: DataFrame, queries: DataFrame, options: Options, semantic: DataFrame | None, features: DataFrame | None, events: DataFrame | None):
    """Frames (item_id, pos, score) by signal with weight and whether only positive scores rank; and the lexical features."""
    may = own.select("pos")
    semantic = (semantic_scores(chunks, queries) if semantic is None else semantic).join(may, "pos", "left_semi")
    # Computed once: ranks, exact phrases and evidence all read it.
    features = stored(lexical_features(chunks, queries, options.evidence_weight > 0) if features is None else features, "features").join(may, "pos", "left_semi")
    return _weighted(semantic, features, options, None if events is None else events.join(may, "pos", "left_semi"))


def _weighted(semantic: DataFrame, features: DataFrame, options: Options, events: DataFrame | None):
    out = {"semantic": (semantic, options.semantic_weight, False), "lexical": (features, 1 - options.semantic_weight, True)}
    if options.evidence_weight:
        out["evidence"] = (features.select("item_id", "pos", F.col("evidence").alias("score")), options.evidence_weight, True)
    if options.event_weight:
        if events is None:
            raise ValueError("an event weight needs event scores")
        out["event"] = (events, options.event_weight, True)
    return out, features


def _fused(signals: dict, pool: int | None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """item_id, pos, score: the weighted sum of reciprocal ranks; and the ranks by signal."""
    ranked = {name: ranks(df, pool, positive) for name, (df, _, positive) in signals.items()}
    if pool is not None:
        # A pool a query and signal: small, and read several times.
        ranked = {name: stored(df, "ranks") for name, df in ranked.items()}
    return fusion.fuse(*[(ranked[name], w) for name, (_, w, _) in signals.items()], id_col="pos"), ranked


def hybrid_search(chunks: DataFrame, queries: DataFrame, options: Options = Options(), povs=None, book=None, semantic: DataFrame | None = None, features: DataFrame | None = None, events: DataFrame | None = None, cut: Cut | None = None) -> DataFrame:
    """item_id, rank, pos, score, exact, and the ranks by signal within the pools: ranks fused, exact phrases above all others.

    Exact rows outside all pools aren't lifted into the result.
    """
    if options.candidate_pool < options.top:
        raise ValueError("candidate_pool must not be below top")
    queries = normalised(queries)
    # A chapter without words has no chunk, so its values aren't known ones.
    may = _wanted(chunks if cut is None else cut.chapters.where(F.col("text").rlike(r"(?U)\S")), povs, book)
    found = _scanned(chunks, queries, may, cut) if semantic is None and features is None else None
    if found:
        chunks = found[1]
        mine = None if events is None else events.join(chunks.where("may").select("pos"), "pos", "left_semi")
        signals, features = _scanned_signals(found[0], options, options.candidate_pool, mine)
    else:
        signals, features = _signals(chunks.where(may), chunks, queries, options, semantic, features, events)
    scores, ranked = _fused(signals, options.candidate_pool)
    exact = features.where("exact").select("item_id", F.col("pos").alias("doc_id"))
    lifted_scores = evidence.promoted(scores.withColumnRenamed("pos", "doc_id"), exact).withColumnRenamed("doc_id", "pos")
    # Two pools a query at most: joins broadcast them, not the chunks.
    lifted_scores = stored(lifted_scores, "pools")
    few = hint(lifted_scores)
    at = chunks.select("pos", "doc_id", "word_start", "word_end").join(few(lifted_scores.select("pos").distinct()), "pos", "left_semi")
    out = selected(lifted_scores, at, options.top, options.one_per_chapter)
    out = out.join(lifted_scores.select("item_id", "pos", "exact"), ["item_id", "pos"])
    for name, df in ranked.items():
        out = out.join(df.withColumnRenamed("rank", f"{name}_rank"), ["item_id", "pos"], "left")
    return out


@dataclass(frozen=True)
class Run:
    """Results (item_id, rank, pos, score and what they are made of) and, for evaluation, chapters (item_id, doc_id, chapter_rank, chapter_score), candidates (item_id, pos, within_rank) and retained (item_id, pos)."""

    results: DataFrame
    chapters: DataFrame
    candidates: DataFrame
    retained: DataFrame


def hierarchical_search(chunks: DataFrame, queries: DataFrame, options: Options = Options(), povs=None, book=None, reranker: Reranker | None = None, semantic: DataFrame | None = None, features: DataFrame | None = None, events: DataFrame | None = None) -> Run:
    """Chapters by their best passages of all pools, then passages ranked anew within the shortlisted chapters.

    Chapters with an exact phrase come first, then by evidence and doc_id. A passage's final score adds its chapter's
    rank, its best neighbour and the agreement of its ranks; exact phrases come first everywhere.
    """
    queries = normalised(queries)
    may = _wanted(chunks, povs, book)
    own, every = chunks.where(may), chunks
    scanned = _scanned(chunks, queries, may) if semantic is None and features is None else None
    if scanned:
        scanned, every = scanned
        own = every.where("may")
        mine = None if events is None else events.join(own.select("pos"), "pos", "left_semi")
        signals, features = _scanned_signals(scanned, options, options.passage_pool, mine)
    else:
        signals, features = _signals(own, chunks, queries, options, semantic, features, events)
    place = own.select("pos", "doc_id", "ordinal", "word_start", "word_end")
    pooled, _ = _fused(signals, options.passage_pool)
    exact = features.where("exact").select("item_id", "pos", F.lit(True).alias("exact"))
    pooled = stored(pooled, "pools")  # some pools a query
    found = fusion.chapter_evidence(place.join(hint(pooled)(pooled), "pos"), "doc_id", id_col="pos", k=options.chapter_passages).withColumnRenamed("score", "chapter_score")
    exact = stored(exact, "exact")
    marked = found.join(place.join(hint(exact)(exact), "pos").select("item_id", "doc_id").distinct().withColumn("has", F.lit(True)), ["item_id", "doc_id"], "left")
    order = Window.partitionBy("item_id").orderBy(F.col("has").isNull(), F.round("chapter_score", lexical.TIE).desc(), "doc_id")
    chapters = stored(marked.withColumn("chapter_rank", F.row_number().over(order)).select("item_id", "doc_id", "chapter_rank", "chapter_score"), "chapters")
    short = chapters.where(F.col("chapter_rank") <= options.chapter_candidates)
    # One row for each query and shortlisted chapter; their passages come from the chunks, and ranks start anew.
    passages = place.join(hint(queries)(short), "doc_id")
    if scanned:
        # The pools lack the shortlisted chapters' other passages: those chapters are scanned once more, whole.
        passages = stored(passages, "places")
        signals, features = _scanned_signals(scanned.within(short.select(F.col("doc_id").alias("chapter")).distinct()), options, None, None if events is None else mine)
        exact = features.where("exact").select("item_id", "pos", F.lit(True).alias("exact"))
    local = {name: (df.join(passages.select("item_id", "pos"), ["item_id", "pos"], "left_semi"), w, positive) for name, (df, w, positive) in signals.items()}
    scores, ranked = _fused(local, None)
    both = ranked["semantic"].join(ranked["lexical"].withColumnRenamed("rank", "lexical_rank"), ["item_id", "pos"], "left").withColumnRenamed("rank", "semantic_rank")
    agreement = F.when(F.col("lexical_rank").isNull(), 0.0).otherwise(1.0 / (fusion.RRF + F.greatest("semantic_rank", "lexical_rank")))
    parts = passages.join(scores.withColumnRenamed("score", "passage_score"), ["item_id", "pos"]).join(both, ["item_id", "pos"]).withColumn("agreement", agreement)
    parts = fusion.neighbour_max(parts.withColumn("score", F.col("passage_score")), "doc_id").drop("score")
    final = F.col("passage_score") + options.chapter_weight / (fusion.RRF + F.col("chapter_rank")) + options.neighbor_weight * F.col("neighbour") + AGREEMENT * F.col("agreement")
    parts = parts.join(exact, ["item_id", "pos"], "left").withColumn("exact", F.coalesce("exact", F.lit(False))).withColumn("final", final)
    best = (~F.col("exact"), F.round("final", lexical.TIE).desc(), F.col("pos"))
    # The shortlisted chapters' passages; retention, results and the trace read them.
    parts = stored(parts.withColumn("within_rank", F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy(*best))), "passages")
    apart = fusion.without_overlap(parts.withColumnRenamed("within_rank", "rank"))
    if options.retention == "per-chapter":
        apart = apart.withColumn("__n", F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy("rank"))).where(F.col("__n") <= options.passages_per_chapter)
    retained = parts.join(apart.select("item_id", "doc_id", F.col("rank").alias("within_rank")), ["item_id", "doc_id", "within_rank"], "left_semi")
    ordered = retained.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(*best)))
    ordered = ordered.withColumns({"score": F.col("final"), "reranker_score": F.lit(None).cast("double")})
    if reranker is not None:
        ordered = reranked(ordered, chunks, queries, reranker, options)
    last = Window.partitionBy("item_id").orderBy(~F.col("exact"), "place")
    results = ordered.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= options.top)
    # Only shown passages' chapters are looked at for what stands beside them.
    beside = every.select("pos", "doc_id", "ordinal", "word_start", "word_end").join(hint(queries)(short.select("doc_id").distinct()), "doc_id", "left_semi")
    results = results.join(context_spans(beside), "pos").select("item_id", "rank", "pos", "doc_id", "score", "exact", "chapter_rank", "chapter_score", "within_rank", "semantic_rank", "lexical_rank", "passage_score", F.col("neighbour").alias("neighbor_score"), F.col("agreement").alias("agreement_score"), F.col("final").alias("hierarchical_score"), "reranker_score", "context_start", "context_end")
    return Run(results, chapters, parts.select("item_id", "pos", "within_rank"), retained.select("item_id", "pos"))


def context_spans(chunks: DataFrame) -> DataFrame:
    """pos, context_start, context_end: from the start of the chunk before to the end of the chunk after, by ordinal."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    before = F.when(F.lag("ordinal").over(w) == F.col("ordinal") - 1, F.lag("word_start").over(w))
    after = F.when(F.lead("ordinal").over(w) == F.col("ordinal") + 1, F.lead("word_end").over(w))
    return chunks.select("pos", F.least(F.coalesce(before, "word_start"), "word_start").alias("context_start"), F.greatest(F.coalesce(after, "word_end"), "word_end").alias("context_end"))


def chapter_words(chunks: DataFrame) -> DataFrame:
    """doc_id, words: each chapter put together from its overlapping chunks; chunks that disagree or leave gaps are an error."""
    each = chunks.select("doc_id", "word_start", F.posexplode(F.split("text", " ")).alias("k", "word"))
    at = each.groupBy("doc_id", (F.col("word_start") + F.col("k")).alias("at")).agg(F.min("word").alias("low"), F.max("word").alias("high"))
    out = at.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "low"))).alias("w"), F.max("at").alias("last"), F.count(F.when(F.col("low") != F.col("high"), 1)).alias("odd"))
    sound = (F.col("odd") == 0) & (F.size("w") == F.col("last") + 1)
    return out.select("doc_id", F.when(sound, F.transform("w", lambda x: x["low"])).otherwise(F.raise_error(F.concat(F.lit("chunks disagree or leave gaps in chapter "), F.col("doc_id").cast("string")))).alias("words"))


def widened(rows: DataFrame, chunks: DataFrame, n_words: int) -> DataFrame:
    """rows (pos) with passage: the chunk's text, or n_words of its chapter around it, kept within the chapter."""
    own = rows.join(chunks.select("pos", F.col("doc_id").alias("__doc"), F.col("word_start").alias("__s"), F.col("word_end").alias("__e"), F.col("text").alias("passage")), "pos")
    if not n_words:
        return own.drop("__doc", "__s", "__e")
    size = F.greatest(F.lit(n_words), F.col("__e") - F.col("__s"))
    whole = own.join(chapter_words(chunks.join(rows.select("pos").join(chunks.select("pos", "doc_id"), "pos").select("doc_id").distinct(), "doc_id", "left_semi")).withColumnRenamed("doc_id", "__doc"), "__doc")
    start = F.greatest(F.lit(0), F.col("__s") - F.floor((size - (F.col("__e") - F.col("__s"))) / 2)).cast("int")
    end = F.least(F.size("words"), start + size)
    first = F.greatest(F.lit(0), end - size)
    return whole.withColumn("passage", F.array_join(F.slice("words", first + 1, end - first), " ")).drop("__doc", "__s", "__e", "words")


def reranked(ordered: DataFrame, chunks: DataFrame, queries: DataFrame, reranker: Reranker, options: Options) -> DataFrame:
    """ordered (item_id, pos, place, score) with the first rerank_candidates of each query in the reranker's order; the rest stay behind.

    A weight below 1 fuses both orders by reciprocal rank. At most 100 passages of a query meet in a task.
    """
    n, weight = options.rerank_candidates, options.rerank_weight
    head = widened(ordered.where(F.col("place") <= n).select("item_id", "pos", "place"), chunks, options.rerank_words).join(small(queries.select("item_id", "query")), "item_id")

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        found = np.asarray(reranker.score(rows["query"].iloc[0], rows.passage.tolist()), np.float32)
        if found.shape != (len(rows),) or not np.isfinite(found).all():
            raise ValueError("the reranker must return one finite score for each passage")
        by_score = np.lexsort((rows.place, -found))
        new = np.empty(len(rows), np.int64)
        new[by_score] = np.arange(1, len(rows) + 1)
        fused = found.astype(float)
        if weight < 1:
            fused = (1 - weight) / (fusion.RRF + rows.place.to_numpy()) + weight / (fusion.RRF + new)
            new[np.lexsort((rows.place, -fused))] = np.arange(1, len(rows) + 1)
        return pd.DataFrame({"item_id": rows.item_id, "pos": rows.pos, "__place": new, "__score": fused, "__raw": found.astype(float)})

    kinds = {f.name: f.dataType.simpleString() for f in head.schema.fields}
    new = head.groupBy("item_id").applyInPandas(score, f"item_id {kinds['item_id']}, pos {kinds['pos']}, __place long, __score double, __raw double")
    out = ordered.join(new, ["item_id", "pos"], "left")
    return out.withColumns({"place": F.coalesce("__place", "place"), "score": F.coalesce("__score", "score"), "reranker_score": F.col("__raw")}).drop("__place", "__score", "__raw")


def semantic_rerank(chunks: DataFrame, queries: DataFrame, reranker: Reranker, options: Options = Options(), povs=None, book=None) -> DataFrame:
    """item_id, rank, pos, score, semantic_rank, reranked: the semantic pool, its first passages in the reranker's order.

    With one passage a chapter, the pool is filled up by the next chapters' best passages.
    """
    own = semantic_scores(chunks, queries).join(eligible(chunks, povs, book).select("pos"), "pos", "left_semi")
    pool = selected(own, chunks, max(options.top, options.rerank_candidates)).withColumnsRenamed({"rank": "semantic_rank"})
    out = reranked(pool.withColumns({"place": F.col("semantic_rank"), "reranker_score": F.lit(None).cast("double")}), chunks, queries, reranker, options)
    if options.one_per_chapter:
        more = selected(own, chunks, options.top, True).join(pool.select("item_id", "pos"), ["item_id", "pos"], "left_anti")
        more = more.select("item_id", "pos", F.col("rank").alias("semantic_rank"), "score", (F.col("rank") + 1000).alias("place"), F.lit(None).cast("double").alias("reranker_score"))
        out = out.select(*more.columns).unionByName(more).join(chunks.select("pos", "doc_id"), "pos")
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy("place"))).where("__n = 1")
    w = Window.partitionBy("item_id").orderBy("place")
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= options.top)
    return out.select("item_id", "rank", "pos", "score", "semantic_rank", F.col("reranker_score").isNotNull().alias("reranked"))


def late_interaction(sentences: DataFrame, queries: DataFrame) -> DataFrame:
    """item_id, pos, score: the best dot product of a query with a sentence of the passage. sentences: pos, embedding."""
    return semantic_scores(sentences, queries).groupBy("item_id", "pos").agg(F.max("score").alias("score"))


#: Words by which a query asks for speech or for images; weights of the views, and what these queries change.
SPEECH = ("asked", "asks", "called", "phrase", "quote", "repeats", "said", "says", "speaks", "teaches", "tells", "told", "words")
IMAGERY = ("appears", "color", "dream", "glowing", "image", "looks", "vision")
VIEWS = {"raw": 0.30, "context": 0.20, "summary": 0.15, "dialogue": 0.05, "events": 0.20, "entities": 0.10}
SPEECH_VIEWS = {"raw": 0.25, "dialogue": 0.30, "events": 0.15}
IMAGERY_VIEWS = {"raw": 0.25, "summary": 0.25, "events": 0.15}
SENTENCE_VIEW = 0.25


def view_fusion(views: dict[str, DataFrame], queries: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """item_id, pos, score: the ranks of the raw and the narrative views (chunks' pos, embedding each), fused by weights that follow the query."""
    from folio.functions.text import tokens

    t = tokens(F.col("query"))
    speech = F.arrays_overlap(t, F.array(*map(F.lit, SPEECH))) | F.contains("query", F.lit('"'))
    imagery = F.arrays_overlap(t, F.array(*map(F.lit, IMAGERY)))
    kinds = queries.select("item_id", "q", F.when(speech, "speech").when(imagery, "imagery").otherwise("plain").alias("kind"))
    tables = {"plain": VIEWS, "speech": VIEWS | SPEECH_VIEWS, "imagery": VIEWS | IMAGERY_VIEWS}
    parts = []
    for name, df in views.items():
        weight = F.when(F.col("kind") == "speech", tables["speech"][name]).when(F.col("kind") == "imagery", tables["imagery"][name]).otherwise(tables["plain"][name])
        ranked = ranks(semantic_scores(df, kinds), None, False).join(small(kinds.select("item_id", "kind")), "item_id")
        parts.append(ranked.select("item_id", "pos", (weight / (fusion.RRF + F.col("rank"))).alias("part")))
    if sentences is not None:
        ranked = ranks(late_interaction(sentences, kinds), None, False)
        parts.append(ranked.select("item_id", "pos", (F.lit(SENTENCE_VIEW) / (fusion.RRF + F.col("rank"))).alias("part")))
    return reduce(DataFrame.unionByName, parts).groupBy("item_id", "pos").agg(F.sum("part").alias("score"))


def search(chunks: DataFrame, queries: DataFrame, mode: str = "semantic", hierarchical: bool = False, options: Options = Options(), povs=None, book=None, reranker: Reranker | None = None, **signals) -> DataFrame:
    """item_id, rank, pos, score, ... by the mode (semantic, lexical, hybrid); combinations that don't go together are errors."""
    if mode not in ("semantic", "lexical", "hybrid"):
        raise ValueError("mode must be semantic, lexical or hybrid")
    if (options.event_weight or options.evidence_weight or hierarchical) and mode != "hybrid":
        raise ValueError("event and evidence weights and hierarchical search need the hybrid mode")
    if hierarchical and options.one_per_chapter:
        raise ValueError("hierarchical search keeps several passages of a chapter")
    if reranker is not None and mode != "semantic" and not hierarchical:
        raise ValueError("reranking needs the semantic mode or hierarchical search")
    if hierarchical:
        return hierarchical_search(chunks, queries, options, povs, book, reranker, **signals).results
    if mode == "hybrid":
        return hybrid_search(chunks, queries, options, povs, book, **signals)
    if mode == "lexical":
        features = lexical_features(chunks, normalised(queries)).join(eligible(chunks, povs, book).select("pos"), "pos", "left_semi")
        return selected(features.where("score > 0"), chunks, options.top, options.one_per_chapter)
    if reranker is not None:
        return semantic_rerank(chunks, normalised(queries), reranker, options, povs, book)
    return semantic_search(chunks, normalised(queries), options, povs, book)
