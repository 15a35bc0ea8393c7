"""Language ID by nearest centroid: normalised TF-IDF vectors of byte n-grams, several clustered centroids a language.

A text belongs to the language of the centroid with the largest cosine; one that is much farther from it than that
language's own training texts are is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import held_out, read, sample_rows, small_batches

#: Training texts a language at most, and in all: with more languages than TEXTS / SAMPLE, each has fewer, but one at least.
SAMPLE, TEXTS = 300, 30_000
#: Centroids a language, rounds of clustering, hashed dimensions of the 2-grams and 3-grams.
CLUSTERS, ROUNDS, BITS = 4, 8, 13
DIM = 2 << BITS
#: A text is rejected below this share of the smallest cosine of its language's training texts.
REJECT = 0.35
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes other than letters are blanks.
FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
RESULT = "lang_pred string, score double, rejected boolean"


def counts(text: str) -> np.ndarray:
    """Counts of the hashed byte 2-grams and 3-grams of the lower-case text."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    shift, times = np.uint32(32 - BITS), np.uint32(2654435761)
    return np.bincount(np.concatenate([two * times >> shift, (three * times >> shift) + np.uint32(1 << BITS)]), minlength=DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


class Model:
    """langs (sorted), idf, unit centroids, whose language each is, the cosine below which each language rejects."""

    def __init__(self, texts: dict[str, list[str]]):
        texts = {k: [t for t in v if LETTER.search(t)] for k, v in texts.items()}
        self.langs = sorted(k for k, v in texts.items() if v)
        # One language's vectors at a time are held: texts are counted twice instead.
        n, df = sum(map(len, texts.values())), np.zeros(DIM)
        for k in self.langs:
            df += (self._logs(texts[k]) > 0).sum(0)
        self.idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
        own = [self._clusters(_unit(self._logs(texts[k]) * self.idf)) for k in self.langs]
        self.centroids = np.concatenate([c for c, _ in own]) if own else np.zeros((0, DIM), np.float32)
        self.of = np.repeat(np.arange(len(own)), [len(c) for c, _ in own]) if own else np.zeros(0, int)
        self.least = np.array([REJECT * least for _, least in own])

    @staticmethod
    def _logs(texts: list[str]) -> np.ndarray:
        return np.log1p(np.array([counts(t) for t in texts], np.float32))

    @staticmethod
    def _clusters(x: np.ndarray) -> tuple[np.ndarray, float]:
        """Spherical k-means from the text nearest the mean and then the farthest ones; the smallest cosine of a text."""
        first = [int((x @ _unit(x.mean(0))).argmax())]
        while len(first) < min(CLUSTERS, len(x)):
            first.append(int((x @ x[first].T).max(1).argmin()))
        centres = x[first]
        for _ in range(ROUNDS):
            at = (x @ centres.T).argmax(1)
            centres = _unit(np.stack([x[at == k].mean(0) if (at == k).any() else centres[k] for k in range(len(centres))]))
        return centres, float((x @ centres.T).max(1).min())

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not LETTER.search(text) or not len(self.centroids):
            return UNKNOWN, 0.0, True
        v = _unit(np.log1p(counts(text).astype(np.float32)) * self.idf)
        cosines = self.centroids @ v
        best = int(cosines.argmax())
        lang, score = self.of[best], min(1.0, max(0.0, float(cosines[best])))
        return self.langs[lang], score, bool(score < self.least[lang])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` documents a language that aren't held out, TEXTS in all: their text and lang, nothing else.

    Rows without doc_id, text or lang, and texts without a letter, say nothing; a row that repeats an id, a text and a
    lang counts once; where nothing is left, the model knows no language and everything is `und`.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    languages = usable.select("lang").distinct().count()
    texts: dict[str, list[str]] = {}
    for r in sample_rows(usable, max(1, min(sample, TEXTS // max(1, languages))), "lang", by="lang"):
        texts.setdefault(r.lang, []).append(r.text)
    return Model(texts)


def identify(docs: DataFrame, model: Model, into: str = "language") -> DataFrame:
    """docs with a struct column: lang_pred, score (the cosine, 0 to 1), rejected.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is any text where nothing was learned.
    Ties go to the language first by code point. A very long text is one vector of the same size. Repeated rows get the
    same result; an empty table gives an empty one. A column named `into` is replaced.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([held.value.predict(t) for t in batch], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn(into, run(F.col("text")))


def known_language(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their columns; the model is learned from docs themselves.

    Null texts and those without a letter are rejected and go, an empty table stays empty, rows that repeat stay or go
    together, and where no row has a language, all are rejected. A column named __language is kept as it is.
    """
    into = "__language"
    while into in docs.columns:
        into += "_"
    return identify(docs, train(docs), into=into).where(f"not {into}.rejected").select(*docs.columns)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")
