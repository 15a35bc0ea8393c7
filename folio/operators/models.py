"""Seams for models: encoders that give unit vectors, rerankers that score passages; a deterministic encoder to stand in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that a passage may have at most; how far a vector's norm may be from 1.
MOST_TOKENS, TOLERANCE = 512, 1e-4


class Encoder(Protocol):
    """model_id, revision, max_tokens, query_instruction; all vectors are float32 with norm 1."""

    model_id: str
    revision: str
    max_tokens: int
    query_instruction: str

    def token_count(self, text: str) -> int: ...

    def encode_passages(self, texts: list[str]) -> np.ndarray: ...

    def encode_queries(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    """model_id; one finite score for each passage."""

    model_id: str

    def score(self, query: str, passages: list[str]) -> np.ndarray: ...


class DigestEncoder:
    """16 dimensions from the first bytes of the text's SHA-256: no meaning, but the same everywhere."""

    model_id, revision, max_tokens, query_instruction = "digest-16", "1", MOST_TOKENS, ""

    def token_count(self, text: str) -> int:
        return len(text.split()) + 2

    def encode_passages(self, texts: list[str]) -> np.ndarray:
        raw = np.array([list(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16]) for t in texts], np.float32).reshape(-1, 16) + 1
        return raw / np.linalg.norm(raw, axis=1, keepdims=True)

    def encode_queries(self, texts: list[str]) -> np.ndarray:
        return self.encode_passages([self.query_instruction + t for t in texts])


ENCODERS: dict[str, Callable[[], Encoder]] = {"digest-16": DigestEncoder}
RERANKERS: dict[str, Callable[[], Reranker]] = {}


def _made(kind: str, known: dict, name: str):
    if name not in known:
        raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(sorted(known)) or 'none'}")
    return known[name]()


def encoder(name: str) -> Encoder:
    return _made("encoder", ENCODERS, name)


def reranker(name: str) -> Reranker:
    return _made("reranker", RERANKERS, name)


def safe_name(model_id: str) -> str:
    """The model's last path part, fit for a folder's name."""
    return "".join(c if c.isalnum() or c in "-_." else "-" for c in model_id.rsplit("/", 1)[-1])


def checked(vectors: np.ndarray, rows: int) -> np.ndarray:
    """The vectors, or an error: one row a text, finite, norm 1."""
    vectors = np.asarray(vectors, np.float32)
    if vectors.ndim != 2 or len(vectors) != rows:
        raise ValueError(f"the encoder returned shape {vectors.shape} for {rows} texts")
    if not np.isfinite(vectors).all() or (np.abs(np.linalg.norm(vectors, axis=1) - 1) > TOLERANCE).any():
        raise ValueError("the encoder returned vectors that are not finite or not of norm 1")
    return vectors


def encoded(df: DataFrame, model: Encoder, text_col: str = "text", into: str = "embedding", queries: bool = False) -> DataFrame:
    """df with a vector of each text; null and blank texts have none, so their views are simply absent."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts.map(lambda t: t is not None and bool(t.strip())).to_numpy(bool)
            out = pd.Series([None] * len(texts), dtype=object)
            if known.any():
                own = texts[known].tolist()
                vectors = checked(model.encode_queries(own) if queries else model.encode_passages(own), len(own))
                for at, v in zip(np.flatnonzero(known), vectors, strict=True):
                    out.iloc[at] = v
            yield out

    return df.withColumn(into, run(F.col(text_col)))


def too_long(df: DataFrame, model: Encoder, text_col: str = "text") -> DataFrame:
    """The rows with more tokens than the model takes, or MOST_TOKENS, with n_tokens."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.token_count(t or "")).astype("int32")

    return df.withColumn("n_tokens", count(F.col(text_col))).where(F.col("n_tokens") > min(model.max_tokens, MOST_TOKENS))
