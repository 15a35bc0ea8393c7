"""Passages: fixed word windows, scene windows, paragraph offsets, rebuilding chapters, matching targets."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import words

#: Words and overlap of the chunk profiles.
PROFILES = {"short": (180, 45), "medium": (300, 60)}
SCENE_WORDS, SCENE_OVERLAP = 280, 100


def fixed_chunks(docs: DataFrame, profile: str = "short", *keep: str) -> DataFrame:
    """doc_id, ordinal (from 1), word_start, word_end, text, and the document's columns in keep. The window that reaches the end is the last one."""
    size, overlap = PROFILES[profile]
    stride = size - overlap
    split = docs.select("doc_id", *keep, F.explode(F.array(words(F.col("text")))).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    starts = split.select("doc_id", *keep, "w", "n", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("n") - overlap - 1, F.lit(0)), F.lit(stride))).alias("k", "word_start"))
    end = F.least(F.col("word_start") + size, F.col("n"))
    return starts.select("doc_id", (F.col("k") + 1).alias("ordinal"), "word_start", end.alias("word_end"), F.array_join(F.slice("w", F.col("word_start") + 1, size), " ").alias("text"), *keep)


def scene_windows(docs: DataFrame, size: int = SCENE_WORDS, overlap: int = SCENE_OVERLAP) -> DataFrame:
    """doc_id, ordinal, word_start, word_end: stride windows, the last one anchored at the end and never told twice."""
    n = docs.select("doc_id", F.size(words(F.col("text"))).alias("n")).where("n > 0")
    last = F.greatest(F.col("n") - size, F.lit(0))
    starts = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda s: s < last), F.array(last)))
    out = n.select("doc_id", "n", F.posexplode(starts).alias("k", "word_start"))
    return out.select("doc_id", (F.col("k") + 1).alias("ordinal"), "word_start", F.least(F.col("word_start") + size, F.col("n")).alias("word_end"))


def chunk_starts(n: int, profile: str = "short") -> range:
    """Where the fixed_chunks of n words start."""
    size, overlap = PROFILES[profile]
    return range(0, max(n - overlap - 1, 0) + 1, size - overlap) if n else range(0)


def scene_starts(n: int, size: int = SCENE_WORDS, overlap: int = SCENE_OVERLAP) -> list[int]:
    """Where the scene_windows of n words start."""
    last = max(n - size, 0)
    return [*range(0, last, size - overlap), last] if n else []


def overlapping(chunks: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, chunk, window: ordinals of the chunks and windows of a chapter that share a word."""
    w = windows.select("doc_id", F.col("ordinal").alias("window"), F.col("word_start").alias("s"), F.col("word_end").alias("e"))
    return chunks.select("doc_id", F.col("ordinal").alias("chunk"), "word_start", "word_end").join(w, "doc_id").where("s < word_end and word_start < e").select("doc_id", "chunk", "window")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal (of all lines, from 1), word_start, word_end, text of each line with words."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line")).withColumn("n", F.size(words(F.col("line"))))
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    out = lines.withColumn("word_start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int")).where("n > 0")
    return out.select("doc_id", (F.col("k") + 1).alias("ordinal"), "word_start", (F.col("word_start") + F.col("n")).alias("word_end"), F.col("line").alias("text"))


def reconstruction_errors(chunks: DataFrame) -> DataFrame:
    """doc_id, n_words, n_conflicts, n_gaps: whether overlapping chunks agree on every word of a chapter and leave none out."""
    each = chunks.select("doc_id", "word_start", F.posexplode(F.split("text", " ")).alias("k", "word"))
    at = each.groupBy("doc_id", (F.col("word_start") + F.col("k")).alias("at")).agg(F.min("word").alias("low"), F.max("word").alias("high"))
    out = at.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count(F.when(F.col("low") != F.col("high"), 1)).alias("n_conflicts"), F.max("at").alias("last"))
    return out.select("doc_id", "n_words", "n_conflicts", (F.col("last") + 1 - F.col("n_words")).alias("n_gaps"))


def target_matches(chunks: DataFrame, targets: DataFrame, strategy: str = "midpoint", least: int = 20) -> DataFrame:
    """doc_id, target, ordinal, overlap, distance: the chunks that hold the middle word of a target (doc_id, target, s, e), or `least` of its words.

    A target of fewer words must lie in the chunk whole.
    """
    both = chunks.select("doc_id", "ordinal", "word_start", "word_end").join(targets, "doc_id")
    overlap = F.greatest(F.least("word_end", "e") - F.greatest("word_start", "s"), F.lit(0))
    middle = F.floor((F.col("s") + F.col("e") - 1) / 2)
    hit = (F.col("word_start") <= middle) & (middle < F.col("word_end")) if strategy == "midpoint" else overlap >= F.least(F.lit(least), F.col("e") - F.col("s"))
    distance = F.abs((F.col("word_start") + F.col("word_end") - 1) / 2 - (F.col("s") + F.col("e") - 1) / 2)
    return both.where(hit).select("doc_id", "target", "ordinal", overlap.alias("overlap"), distance.alias("distance"))


def best_chunks(matches: DataFrame) -> DataFrame:
    """doc_id, target, ordinal: the chunk that shares most words with the target; then the nearest middle, then the first."""
    return matches.groupBy("doc_id", "target").agg(F.min(F.struct(-F.col("overlap"), "distance", "ordinal"))["ordinal"].alias("ordinal"))


def neighbour_spans(chunks: DataFrame) -> DataFrame:
    """doc_id, ordinal, context_start, context_end: from the start of the chunk before to the end of the chunk after."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return chunks.select("doc_id", "ordinal", F.coalesce(F.lag("word_start").over(w), "word_start").alias("context_start"), F.coalesce(F.lead("word_end").over(w), "word_end").alias("context_end"))


#: Words, overlap and least words of chunks that follow sentences; what ends a sentence.
STRUCTURED = (160, 40, 120)
SENTENCE_END = r"[.!?][\"')\]]*$"
PARAGRAPH_BREAK = r"\n(?U)\s*\n"


def structured_spans(n: int, paragraph_ends: list[int], sentence_ends: list[int], size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Spans of at most `size` words. A span ends at the last paragraph end it can reach with `least` words, else at the last sentence end, else where it is full; the next one starts at the sentence end nearest to the overlap, the later one on ties."""
    ends = sorted({*sentence_ends, *paragraph_ends, n})
    stops = sorted(set(paragraph_ends))
    spans, start = [], 0

    def last(among: list[int], low: int, high: int) -> int | None:
        k = bisect_right(among, high) - 1
        return among[k] if k >= 0 and among[k] >= low else None

    while start < n:
        full = min(start + size, n)
        end = n if full == n else last(stops, start + least, full) or last(ends, start + least, full) or full
        spans.append((start, end))
        if end == n:
            break
        wanted = end - overlap
        k = bisect_right(ends, max(wanted, start))
        near = [e for e in ends[max(0, k - 1) : k + 1] if start < e < end]
        start = min(near, key=lambda e: (abs(e - wanted), -e)) if near else max(start + 1, wanted)
    return spans


def structured_chunks(docs: DataFrame, size: int = STRUCTURED[0], overlap: int = STRUCTURED[1], least: int = STRUCTURED[2]) -> DataFrame:
    """doc_id, ordinal, word_start, word_end, text of chunks that follow paragraphs and sentences. An empty text has none."""
    if not 0 <= overlap < size or not 1 <= least <= size:
        raise ValueError("the overlap must be below the size, and the least size between 1 and it")

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def spans(n: pd.Series, stops: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([[{"s": a, "e": b} for a, b in structured_spans(int(m), list(p), list(s), size, overlap, least)] for m, p, s in zip(n, stops, ends, strict=True)], dtype=object)

    split = docs.select("doc_id", "text", F.explode(F.array(words(F.col("text")))).alias("w")).where(F.size("w") > 0)
    counts = F.transform(F.split("text", PARAGRAPH_BREAK), lambda p: F.size(words(p)))
    stops = F.aggregate(counts, F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x)))
    ends = F.array_compact(F.transform("w", lambda x, k: F.when(F.regexp_like(x, F.lit(SENTENCE_END)), k + 1)))
    each = split.select("doc_id", "w", F.posexplode(spans(F.size("w"), stops, ends)).alias("k", "x"))
    return each.select("doc_id", (F.col("k") + 1).alias("ordinal"), F.col("x.s").alias("word_start"), F.col("x.e").alias("word_end"), F.array_join(F.slice("w", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")), " ").alias("text"))


def uncovered(chunks: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, chunk: chunks that share no word with a window; there should be none."""
    own = chunks.select("doc_id", F.col("ordinal").alias("chunk"))
    return own.join(overlapping(chunks, windows).select("doc_id", "chunk").distinct(), ["doc_id", "chunk"], "left_anti")


def required_chunks(targets: DataFrame, best: DataFrame) -> DataFrame:
    """best (see best_chunks) for every target; a target without a chunk ends the job with an error."""
    out = targets.select("doc_id", "target").join(best, ["doc_id", "target"], "left")
    return out.withColumn("ordinal", F.coalesce("ordinal", F.raise_error(F.concat(F.lit("no chunk holds a target of "), F.col("doc_id").cast("string"))).cast("int")))
