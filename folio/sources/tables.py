"""Parquet tables and the corpus model over them: chapters, paragraphs, queries."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, book, pov, text."""
    return read(spark, folder, "documents").select("doc_id", F.col("source").alias("book"), F.col("lang").alias("pov"), "text")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, query."""
    return read(spark, folder, "benchmark").select("item_id", F.col("text").alias("query"))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, broadcast in joins if it has at most that many rows; otherwise joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hint(df: DataFrame, rows: int = 100_000) -> Callable[[DataFrame], DataFrame]:
    """Marks frames that can't have more rows than df, without running them: broadcast if df has at most that many rows."""
    return F.broadcast if df.limit(rows + 1).count() <= rows else lambda x: x


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the folder that all executors share (spark.checkpoint.dir) and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", shared := tempfile.mkdtemp(prefix="folio-"))
    path = f"{shared.rstrip('/')}/folio-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
