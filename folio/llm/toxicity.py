"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A sentence's score is logistic in the sum of its words' weights; a word's weight is the sum over itself and its
prefixes. A document is toxic unless none of its sentences is: 1 - product of (1 - sentence score). Training sees
documents' labels alone; scoring also says which sentences offend.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import held_out, read, sample_ids, sample_rows, small_batches

#: Labelled documents that training sees at most.
SAMPLE = 6000
#: Hashed features; prefixes of these lengths count besides the whole word.
FEATURES, PREFIXES = 1 << 18, range(3, 9)
#: A document counts as toxic from this score; a sentence is reported from it, too.
THRESHOLD = 0.3
#: Words whose weights a worker remembers.
REMEMBERED = 100_000
STEPS, RATE, L1, BIAS = 120, 0.1, 1e-4, -6.0
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
RESULT = "score double, spans array<struct<start:int,end:int,score:double>>"


def features(word: str) -> list[int]:
    """Hashes of the word and its prefixes."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in (f"{word}$", *(word[:k] for k in PREFIXES if k <= len(word)))]


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """Start, end (characters) and lower-case words of each sentence that has any."""
    out = ((m.start(), m.end(), WORD.findall(m[0].lower())) for m in SENTENCE.finditer(text or ""))
    return [x for x in out if x[2]]


def fit(texts: list[str | None], toxic: list[int]) -> tuple[np.ndarray, float]:
    """Feature weights and the sentences' bias, by Adam with soft thresholds on the noisy-or likelihood."""
    ids: dict[str, int] = {}
    word, sentence, doc = [], [], []
    for d, text in enumerate(texts):
        for _, _, own in sentences(text):
            word += [ids.setdefault(w, len(ids)) for w in own]
            sentence += [len(doc)] * len(own)
            doc.append(d)
    weights, bias = np.zeros(FEATURES), BIAS
    if not doc or len(set(toxic)) < 2:
        return weights.astype(np.float32), bias
    word, sentence, doc, y = np.array(word), np.array(sentence), np.array(doc), np.array(toxic, float)
    lists = [features(w) for w in ids]
    feature, owner = np.concatenate(lists), np.repeat(np.arange(len(ids)), [len(x) for x in lists])
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for step in range(1, STEPS + 1):
        by_word = np.bincount(owner, weights[feature], len(ids))
        z = np.bincount(sentence, by_word[word], len(doc)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, -np.logaddexp(0, z), len(y)))  # no sentence of the document is toxic
        # d loss / dz is p for clean documents and -p * none / (1 - none) for toxic ones.
        g = p * np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)[doc] / len(y)
        gw = np.bincount(feature, np.bincount(word, g[sentence], len(ids))[owner], FEATURES)
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        scale = RATE / (np.sqrt(v / fix2) + 1e-6)
        weights -= scale * m / fix
        weights = np.sign(weights) * np.maximum(np.abs(weights) - scale * L1, 0)
        bias -= RATE * (mb / fix) / (np.sqrt(vb / fix2) + 1e-6)
    return weights.astype(np.float32), float(bias)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def __call__(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of the document; start, end, score of its offending sentences."""
        known, log, spans = self.known, 0.0, []
        for start, end, own in sentences(text):
            z = self.bias
            for w in own:
                x = known.get(w)
                if x is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    x = known[w] = float(self.weights[features(w)].sum())
                z += x
            log -= math.log1p(math.exp(z)) if z < 30 else z
            if z > -0.8473:  # a score of 0.3, THRESHOLD
                spans.append((start, end, 1 / (1 + math.exp(-min(z, 30.0)))))
        return -math.expm1(log), spans


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on at most `sample` labelled documents that aren't held out; nothing else of a row but text and toxic.

    Labels without a doc_id or toxic are left out; a document is toxic if one of its labels says so. Null and empty
    texts say nothing; a row that repeats an id and a text counts once; without labels of both kinds the weights are 0.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = sample_ids(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), sample, "toxic")
    rows = sample_rows(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sample, "toxic")
    return fit([r.text for r in rows], [int(r.toxic > 0) for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], into: str = "toxicity") -> DataFrame:
    """docs with a struct column: score of the text and spans of its offending sentences.

    Texts that are null, empty or without words have no sentences and score 0; a text of one endless sentence is one
    instance. Repeated rows get the same result; an empty table gives an empty one. A column named `into` is replaced.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    cache: list[Scorer] = []

    @F.pandas_udf(RESULT)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not cache:
            cache.append(Scorer(*held.value))
        for batch in texts:
            found = [cache[0](t) for t in batch]
            yield pd.DataFrame({"score": [s for s, _ in found], "spans": [[{"start": a, "end": b, "score": p} for a, b, p in x] for _, x in found]})

    return docs.withColumn(into, run(F.col("text")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, read(spark, sf_dir, "labels")))
    s = F.col("toxicity.score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), F.when(s >= THRESHOLD, 1).otherwise(0).alias("predicted"), F.size("toxicity.spans").alias("n_offending"))
