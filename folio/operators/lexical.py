"""Inverted index, BM25, phrases and conjunctive search, for all queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import STOPWORDS, tokens
from folio.operators import scan
from folio.operators.scan import K1, TIE, B, Scan  # noqa: F401 TIE: scores that agree in so many decimals tie; the smaller id then ranks first
from folio.sources.tables import hint, small, stored


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, term, tf."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("dl"))


def idf(df, n):
    return F.log1p((n - df + 0.5) / (df + 0.5))


@dataclass(frozen=True)
class Lexicon:
    """An inverted index. postings: term, doc_id, dl (its tokens), tf, places (sorted); corpus: one row n, avgdl."""

    postings: DataFrame
    corpus: DataFrame

    def stored(self) -> Lexicon:
        """The same, computed once and written, clustered by term."""
        return Lexicon(stored(self.postings.repartition("term").sortWithinPartitions("term"), "postings"), stored(self.corpus, "corpus"))

    def of(self, vocabulary: DataFrame) -> DataFrame:
        """Postings of a vocabulary's terms. Where the index is still a plan, Catalyst picks them before anything is shuffled."""
        return self.postings.join(vocabulary, "term", "left_semi")


def lexicon(docs: DataFrame) -> Lexicon:
    """Of docs (doc_id, text). Texts are read once for the postings and once for their lengths."""
    split = docs.select("doc_id", F.explode(F.array(tokens(F.col("text")))).alias("t")).select("doc_id", F.size("t").alias("dl"), F.posexplode("t").alias("at", "term"))
    postings = split.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("places"))
    return Lexicon(postings, lengths(docs).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def _lexicon(docs: DataFrame | Lexicon) -> Lexicon:
    return docs if isinstance(docs, Lexicon) else lexicon(docs)


def scanned(docs: DataFrame | Lexicon | Scan, queries: DataFrame) -> Scan | None:
    """Texts are read batch by batch; postings are joined where a lexicon is given or the queries are too many for a worker."""
    return docs if isinstance(docs, Scan) else None if isinstance(docs, Lexicon) else scan.of_texts(docs, queries)


def bm25(docs: DataFrame | Lexicon | Scan, queries: DataFrame, k: int | None = None) -> DataFrame:
    """item_id, doc_id, score of every document with a query term; statistics are of all docs (doc_id, text) or of their lexicon.

    k: rows that can't be among the k best of their query may be missing.
    """
    if found := scanned(docs, queries):
        return found.bm25(k)
    words = _lexicon(docs)
    asked = term_frequencies(queries, "item_id", "query").withColumnRenamed("tf", "qf")
    few = hint(asked)
    found = words.of(few(asked.select("term").distinct())).select("term", "doc_id", "dl", "tf")
    weights = document_frequencies(found).crossJoin(F.broadcast(words.corpus)).select("term", idf(F.col("df"), F.col("n")).alias("idf"), "avgdl")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # One row a term of the queries, so as small as the queries are.
    weighted = few(asked.join(weights, "term"))
    return found.join(weighted, "term").groupBy("item_id", "doc_id").agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame, k: int, by: str = "item_id", id_col: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each query by (score desc, id), finite and positive scores only, with rank from 1."""
    w = Window.partitionBy(by).orderBy(F.round(score, TIE).desc(), id_col)
    good = scores.where((F.col(score) > 0) & ~F.isnan(score) & (F.col(score) < float("inf")))
    return good.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def contains_all(docs: DataFrame | Lexicon, queries: DataFrame) -> DataFrame:
    """item_id, doc_id of documents with every non-stop term of the query; a query without any matches nothing."""
    asked = queries.select("item_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).where(~F.col("term").isin(*STOPWORDS))
    need = asked.groupBy("item_id").agg(F.count("*").alias("need"))
    asked = small(asked.join(need, "item_id"))
    found = _lexicon(docs).postings.select("term", "doc_id")
    hits = found.join(asked, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("got"), F.first("need").alias("need"))
    return hits.where("got = need").select("item_id", "doc_id")


def exact_phrases(docs: DataFrame | Lexicon | Scan, queries: DataFrame) -> DataFrame:
    """item_id, doc_id of documents that hold all the query's tokens in a row, stop words kept.

    Queries of one token match nothing. Candidates come from the phrase's rarest token, so no document is compared with
    a query that it can't hold; then the tokens' places, each less its offset in the query, must have one in common.
    """
    if one := scanned(docs, queries):
        return one.exact()
    words = _lexicon(docs)
    asked = queries.select("item_id", tokens(F.col("query")).alias("q")).where(F.size("q") >= 2)
    terms = asked.select("item_id", F.size("q").alias("need"), F.posexplode("q").alias("k", "term"))
    few = hint(terms)
    found = words.of(few(terms.select("term").distinct())).select("term", "doc_id", "places")
    rare = document_frequencies(found)
    seed = terms.join(rare, "term", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("s")).where("s.df > 0").select("item_id", F.col("s.term").alias("term"))
    candidates = found.join(few(seed), "term").select("item_id", "doc_id").distinct()
    shifted = found.join(few(terms), "term").join(candidates, ["item_id", "doc_id"], "left_semi").select("item_id", "doc_id", "need", F.transform("places", lambda p: p - F.col("k")).alias("starts"))
    held = shifted.groupBy("item_id", "doc_id", "need").agg(F.collect_list("starts").alias("all")).where(F.size("all") == F.col("need"))
    common = F.aggregate(F.slice("all", 2, F.col("need")), F.col("all")[0], lambda done, x: F.array_intersect(done, x))
    return held.where(F.size(common) > 0).select("item_id", "doc_id")
