"""Evidence that a text answers a query: term coverage, nearness, shared bigrams; ranking and pages of passages by it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from folio.functions.text import STOPWORDS, tokens
from folio.operators import fusion, lexical, scan
from folio.operators.scan import BASE, COMPACT, COMPACT_PHRASE, COMPACT_PROXIMITY, COVERAGE, EXACT, PHRASE, PROXIMITY, Scan
from folio.sources.tables import hint, stored


def _bigrams(t: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


@F.pandas_udf(IntegerType())
def _width(places: pd.Series) -> pd.Series:
    """Words in the smallest span with a place of each list (sorted places): for each end, back to the earliest last place."""

    def one(lists) -> int:
        ends = np.unique(np.concatenate(lists))
        first = np.full(len(ends), np.iinfo(np.int64).max)
        for x in lists:
            k = np.searchsorted(x, ends, "right") - 1
            first = np.minimum(first, np.where(k >= 0, np.asarray(x, np.int64)[k], -1))
        return int((ends - first + 1)[first >= 0].min())

    return places.map(one).astype("int32")


def evidence(docs: DataFrame | lexical.Lexicon | Scan, queries: DataFrame, strict: bool = False) -> DataFrame:
    """item_id, doc_id, coverage, proximity, phrase, score of every document with a non-stop term of the query.

    Terms that the corpus lacks count for nothing; strict: only documents with all non-stop terms, so a query with a
    term that the corpus lacks has none. Everything comes from the places of the queries' terms; queries are broadcast
    where small.
    """
    if one := lexical.scanned(docs, queries):
        return one.evidence(strict)
    words = lexical._lexicon(docs)
    asked = queries.select("item_id", F.filter(tokens(F.col("query")), lambda x: ~x.isin(*STOPWORDS)).alias("q"))
    terms = asked.select("item_id", F.explode(F.array_distinct("q")).alias("term"))
    # Every frame of the queries has at most a row for each of their tokens.
    few = hint(asked.select(F.explode("q")))
    found = words.of(few(terms.select("term").distinct())).select("term", "doc_id", "places")
    weights = lexical.document_frequencies(found).crossJoin(F.broadcast(words.corpus)).select("term", lexical.idf(F.col("df"), F.col("n")).alias("idf"))
    weighted = terms.join(weights, "term")
    total = weighted.groupBy("item_id").agg(F.sum("idf").alias("total"), F.count("*").alias("known")).join(terms.groupBy("item_id").agg(F.count("*").alias("asked")), "item_id")
    hits = found.join(few(weighted), "term").groupBy("item_id", "doc_id").agg(F.sum("idf").alias("got"), F.count("*").alias("matched"), F.collect_list(F.struct("term", "places")).alias("held"))
    hits = hits.join(few(total), "item_id")
    hits = hits.where("matched = asked") if strict else hits
    # The query's bigrams are of its known terms, those of a document of all its tokens: the second stands right behind the first.
    known = asked.select("item_id", F.posexplode("q").alias("k", "term")).join(weights.select("term"), "term")
    pairs = known.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("q"))
    pairs = pairs.select("item_id", _bigrams(F.col("q")).alias("pairs"))
    out = hits.join(few(pairs), "item_id", "left")
    held = F.map_from_entries("held")
    beside = lambda p: F.arrays_overlap(F.transform(held[p["a"]], lambda x: x + 1), held[p["b"]])
    shared = F.size(F.filter("pairs", lambda p: F.map_contains_key(held, p["a"]) & F.map_contains_key(held, p["b"]) & F.coalesce(beside(p), F.lit(False))))
    coverage = F.col("got") / F.col("total")
    phrase = F.when(F.size("pairs") > 0, shared / F.size("pairs")).otherwise(0.0)
    out = out.select("item_id", "doc_id", coverage.alias("coverage"), "matched", _width(F.transform("held", lambda x: x["places"])).alias("width"), phrase.alias("phrase"))
    out = out.withColumn("proximity", F.when(F.col("matched") >= 2, F.col("coverage") * F.col("matched") / F.col("width")).otherwise(0.0))
    return out.select("item_id", "doc_id", "coverage", "proximity", "phrase", (COVERAGE * F.col("coverage") + PROXIMITY * F.col("proximity") + PHRASE * F.col("phrase")).alias("score"))


def lexical_scores(docs: DataFrame | lexical.Lexicon | Scan, queries: DataFrame, strict: bool = True, base: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """item_id, doc_id, base, exact, coverage, proximity, phrase, score: BM25 against its best, lifted where all terms stand close, replaced where the phrase stands.

    base: other base scores (item_id, doc_id, score) than BM25 of docs, as of narrative views or scenes. k: rows that
    can't be among the k best of their query may be missing.
    """
    if base is None and (one := lexical.scanned(docs, queries)):
        return one.scores(strict, k).drop("evidence")
    words = lexical._lexicon(docs)
    base = (lexical.bm25(words, queries) if base is None else base).withColumnRenamed("score", "base")
    most = base.groupBy("item_id").agg(F.max("base").alias("most"))
    seen = evidence(words, queries, strict).drop("score")
    exact = lexical.exact_phrases(words, queries).withColumn("exact", F.lit(True))
    out = base.join(hint(queries)(most), "item_id").join(seen, ["item_id", "doc_id"], "full_outer").join(exact, ["item_id", "doc_id"], "full_outer").na.fill({"exact": False, "coverage": 0.0, "proximity": 0.0, "phrase": 0.0, "base": 0.0})
    share = F.when(F.col("most") > 0, BASE * F.col("base") / F.col("most")).otherwise(BASE * F.col("base"))
    compact = (F.abs(F.col("coverage") - 1) <= 1e-8 + 1e-5) & (F.col("proximity") > 0)
    lift = F.when(compact, COMPACT + COMPACT_PROXIMITY * F.col("proximity") + COMPACT_PHRASE * F.col("phrase")).otherwise(0.0)
    return out.select("item_id", "doc_id", "base", "exact", "coverage", "proximity", "phrase", F.when(F.col("exact"), EXACT + share).otherwise(share + lift).alias("score"))


def promoted(scores: DataFrame, exact: DataFrame) -> DataFrame:
    """scores (item_id, doc_id, score), those of exact rows raised by the item's spread and one; rows that have no score stay out."""
    spread = scores.groupBy("item_id").agg(F.greatest(F.max("score") - F.min("score") + 1, F.lit(1.0)).alias("lift"))
    marked = scores.join(exact.select("item_id", "doc_id").withColumn("exact", F.lit(True)), ["item_id", "doc_id"], "left").join(spread, "item_id")
    return marked.select("item_id", "doc_id", F.coalesce("exact", F.lit(False)).alias("exact"), (F.col("score") + F.when(F.col("exact"), F.col("lift")).otherwise(0.0)).alias("score"))


def lexical_page(chunks: DataFrame, queries: DataFrame, page: int = 1, size: int = 20, one_per_chapter: bool = False, eligible: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, ordinal, lexical_rank, score, total: a page of the passages that overlap no better one of their document.

    lexical_rank counts before passages that overlap go, rank and total after. Ties go by document, then ordinal.
    eligible: chunks (doc_id, ordinal) that may be ranked; statistics are of all.
    """
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page must be positive, and its size between 1 and 100")
    own = _passages(chunks, queries, eligible)
    if own is None:
        left = lexical_places(chunks, queries, one_per_chapter, eligible)
    else:
        # Up to the page's end all that ranks is there, so ranks are those of all; totals are counted apart.
        rows, counts = own.places(page * size, one_per_chapter)
        best = Window.partitionBy("item_id").orderBy(F.round("score", lexical.TIE).desc(), "doc_id", "ordinal")
        left = rows.withColumn("lexical_rank", F.row_number().over(best)).where("chosen")
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("lexical_rank"))).where(F.col("rank") <= page * size)
        left = left.join(F.broadcast(counts.groupBy("item_id").agg(F.sum("n").alias("total"))), "item_id")
    return left.where(F.col("rank").between((page - 1) * size + 1, page * size)).select("item_id", "rank", "doc_id", "ordinal", "lexical_rank", "score", "total")


def _passages(chunks: DataFrame, queries: DataFrame, eligible: DataFrame | None = None, **more: Column) -> Scan | None:
    if eligible is not None:
        may = eligible.select("doc_id", "ordinal").distinct().withColumn("__may", F.lit(True))
        chunks, more = chunks.join(may, ["doc_id", "ordinal"], "left"), more | {"may": F.coalesce("__may", F.lit(False))}
    own = scan.of_passages(chunks, queries, F.col("ordinal"), ("chapter", "ordinal"), more)
    return own if own is None or eligible is None else own.only(lambda u: u["may"])


def lexical_places(chunks: DataFrame, queries: DataFrame, one_per_chapter: bool = False, eligible: DataFrame | None = None) -> DataFrame:
    """All pages of lexical_page in one frame."""
    place = F.struct("doc_id", "ordinal")
    words = lexical.lexicon(chunks.select(place.alias("doc_id"), "text")).stored()
    scores = lexical_scores(words, queries).select("item_id", F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.ordinal").alias("ordinal"), "score")
    best = Window.partitionBy("item_id").orderBy(F.round("score", lexical.TIE).desc(), "doc_id", "ordinal")
    may = scores.where("score > 0") if eligible is None else scores.where("score > 0").join(eligible.select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_semi")
    placed = may.withColumn("rank", F.row_number().over(best)).join(chunks.select("doc_id", "ordinal", "word_start", "word_end"), ["doc_id", "ordinal"])
    chosen = (fusion.one_each(placed, "doc_id") if one_per_chapter else fusion.without_overlap(placed)).select("item_id", F.col("rank").alias("lexical_rank"))
    left = placed.withColumnRenamed("rank", "lexical_rank").join(chosen, ["item_id", "lexical_rank"], "left_semi")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("lexical_rank"))).withColumn("total", F.count("*").over(Window.partitionBy("item_id")))


def counted_books(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """item_id, book, n: book_counts of all lexical_places, counted chapter by chapter. chunks also have book."""
    own = _passages(chunks, queries, book=F.col("book"))
    if own is None:
        return book_counts(lexical_places(chunks, queries), chunks, chunks)
    n = stored(own.places(None)[1], "counts")  # a row a query and book
    every = n.select("item_id").distinct().join(F.broadcast(own.rows.select(F.explode("units.book").alias("book")).distinct()), F.lit(True))
    return every.join(n, ["item_id", "book"], "left").select("item_id", "book", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def book_counts(places: DataFrame, chunks: DataFrame, books: DataFrame) -> DataFrame:
    """item_id, book, n: how many of a query's results each book has, 0 included. places: lexical_places; chunks: doc_id, ordinal, book; books: book."""
    n = places.join(chunks.select("doc_id", "ordinal", "book"), ["doc_id", "ordinal"]).groupBy("item_id", "book").agg(F.count("*").alias("n"))
    every = places.select("item_id").distinct().join(hint(books)(books.select("book").distinct()), F.lit(True))
    return every.join(n, ["item_id", "book"], "left").select("item_id", "book", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
