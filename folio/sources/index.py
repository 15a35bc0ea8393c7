"""The index as a folder of Parquet tables and a manifest: chunks with vectors, postings clustered by term, paragraphs, scenes.

Tables are written first and the manifest last, so a folder without one isn't an index. Loading checks what was written.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import norm, words
from folio.operators import chunking, lexical, models, vectors
from folio.sources.tables import stored

VERSION = 1


@dataclass(frozen=True)
class Index:
    path: str
    manifest: dict
    chunks: DataFrame
    lexicon: lexical.Lexicon
    paragraphs: DataFrame


def index_name(model_id: str, profile: str, source_sha256: str, narrative: bool = False) -> str:
    return "-".join([models.safe_name(model_id), profile, *(["narrative"] if narrative else []), source_sha256[:12]])


def chunked(docs: DataFrame, profile: str = "short") -> DataFrame:
    """doc_id, ordinal, word_start, word_end, book, pov, text of all chunks by a profile: short, medium or structured."""
    if profile not in (*chunking.PROFILES, "structured"):
        raise ValueError(f"unknown chunk profile {profile!r}")
    own = chunking.structured_chunks(docs) if profile == "structured" else chunking.fixed_chunks(docs, profile)
    return own.join(docs.select("doc_id", "book", "pov"), "doc_id")


def numbered(df: DataFrame, order: list[str], into: str = "pos") -> DataFrame:
    """df with a number from 0 in the given order: written in sorted ranges, each of which starts where those before it end."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    ranged = stored(ranged, "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    sizes = sizes.select("__part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(sizes), "__part").withColumn(into, F.col("__at") - F.col("first") + F.col("before")).drop("__part", "__at", "first", "before")


def build_index(docs: DataFrame, root: str, model: models.Encoder, profile: str = "short", source_sha256: str = "", overwrite: bool = False) -> str:
    """Chunk, check lengths, encode and write docs (doc_id, book, pov, text); gives the index's path. Chunks that the model can't take are an error."""
    spark = docs.sparkSession
    path = f"{root.rstrip('/')}/{index_name(model.model_id, profile, source_sha256)}"
    mode = "overwrite" if overwrite else "errorifexists"
    numbered(chunked(docs, profile), ["doc_id", "ordinal"]).write.mode(mode).parquet(f"{path}/plain")
    plain = spark.read.parquet(f"{path}/plain")
    if long := models.too_long(plain, model).select("pos", "n_tokens").limit(5).collect():
        raise ValueError(f"chunks have too many tokens: {[(r.pos, r.n_tokens) for r in long]}")
    models.encoded(plain, model).write.mode(mode).parquet(f"{path}/chunks")
    words_of = lexical.lexicon(plain.select(F.col("pos").alias("doc_id"), "text"))
    words_of.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode(mode).parquet(f"{path}/postings")
    words_of.corpus.write.mode(mode).parquet(f"{path}/corpus")
    chunking.paragraphs(docs).write.mode(mode).parquet(f"{path}/paragraphs")
    manifest = {"chunk_count": plain.count(), "chunk_profile": profile, "format_version": VERSION, "model": model.model_id, "model_revision": model.revision, "source_sha256": source_sha256}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")
    return path


def load_index(spark: SparkSession, path: str, model: models.Encoder | None = None, check: bool = True) -> Index:
    """The index in a folder, after its manifest, counts, ids, offsets and vectors were found sound."""
    lines = [r.value for r in spark.read.text(f"{path}/manifest").limit(2).collect()]
    manifest = json.loads(lines[0]) if len(lines) == 1 else {}
    if manifest.get("format_version") != VERSION or not {"chunk_count", "chunk_profile", "model", "model_revision"} <= manifest.keys():
        raise ValueError(f"{path} is not an index of this version")
    if model and (model.model_id, model.revision) != (manifest["model"], manifest["model_revision"]):
        raise ValueError(f"the index was made with {manifest['model']} at {manifest['model_revision']}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("chunks", "postings", "corpus", "paragraphs")}
    if check and (found := [tuple(r) for r in violations(tables, manifest["chunk_count"]).where("n > 0").collect()]):
        raise ValueError(f"the index is not sound: {found}")
    return Index(path, manifest, tables["chunks"], lexical.Lexicon(tables["postings"], tables["corpus"]), tables["paragraphs"])


def violations(tables: dict[str, DataFrame], chunk_count: int) -> DataFrame:
    """problem, n: how many rows are wrong in each way; all should be 0."""
    chunks, paragraphs = tables["chunks"], tables["paragraphs"]
    own = chunks.agg(
        F.abs(F.count("*") - chunk_count).alias("chunks more or fewer than stated"),
        (F.count("*") - F.count_distinct("pos")).alias("positions that repeat"),
        F.count(F.when(F.size(words(F.col("text"))) != F.col("word_end") - F.col("word_start"), 1)).alias("offsets unlike the text"),
        F.count(F.when(F.col("embedding").isNull() | (F.abs(norm(F.col("embedding")) - 1) > models.TOLERANCE) | F.exists("embedding", F.isnan), 1)).alias("vectors not of norm 1"),
        F.coalesce(F.max(F.size("embedding")) - F.min(F.size("embedding")), F.lit(0)).alias("vectors of several sizes"),
    )
    out = own.unpivot([], own.columns, "problem", "n").select("problem", F.col("n").cast("long").alias("n"))
    last = F.lag("word_end").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    gaps = paragraphs.withColumn("gap", F.col("word_start") != F.coalesce(last, F.lit(0))).agg(F.count(F.when(F.col("gap"), 1)).alias("n"))
    return out.unionByName(gaps.select(F.lit("paragraphs with gaps").alias("problem"), "n"))


def context_embeddings(chunks: DataFrame) -> DataFrame:
    """chunks' pos and the pooled vector of a chunk and its neighbours in the chapter."""
    pooled = vectors.context_vectors(chunks.select(F.col("pos").alias("vec_id"), F.col("doc_id").alias("label"), "embedding"))
    return pooled.select(F.col("vec_id").alias("pos"), "embedding")
