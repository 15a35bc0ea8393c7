"""Exact dedup of an incoming batch against an immutable snapshot.

The snapshot's digests are dealt into buckets, each with a static 3-wise binary fuse filter. Incoming digests are
screened by their bucket's filter: what the filter excludes is new for certain, so its duplicates are grouped among the
batch alone; what it may contain joins the snapshot's exact buckets. Every class is checked byte for byte.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import join_by_key, materialise, read, workspace

#: Snapshot digests that a bucket (and its filter) holds on average.
BUCKET = 20_000
#: Repeated digests (32 bytes each) that a broadcast may hold; beyond, all texts are grouped by their bytes.
REPEATED = 200_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; x and the result are uint64."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _cells(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of each key, in three neighbouring segments, and its 8-bit fingerprint."""
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    inner = _mix(keys, seed + 1_000_003)
    at = [(first + i) * length + ((inner >> np.uint64(20 * i)) & np.uint64(length - 1)).astype(np.int64) for i in range(3)]
    return np.stack(at, 1), (h & np.uint64(0xFF)).astype(np.uint8)


def fuse_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """seed, segment length, segments, fingerprints of a static binary fuse filter of the uint64 keys."""
    keys = np.unique(keys)
    n = len(keys)
    if not n:
        return 0, 1, 1, bytes(3)
    length = 1 << max(0, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / length) - 2) + (n < 32) * 2
    for seed in range(1, 200):
        at, prints = _cells(keys, seed, length, segments)
        size = (segments + 2) * length
        count = np.bincount(at.ravel(), minlength=size)
        holds = np.zeros(size, np.int64)
        for i in range(3):
            np.bitwise_xor.at(holds, at[:, i], np.arange(n))
        rounds, left = [], n
        while left:
            cells = np.flatnonzero(count == 1)
            if not len(cells):
                break
            ids, where = np.unique(holds[cells], return_index=True)
            rounds.append((ids, cells[where]))
            left -= len(ids)
            for i in range(3):
                np.subtract.at(count, at[ids, i], 1)
                np.bitwise_xor.at(holds, at[ids, i], ids)
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for ids, cells in reversed(rounds):
            table[cells] = 0
            table[cells] = prints[ids] ^ table[at[ids, 0]] ^ table[at[ids, 1]] ^ table[at[ids, 2]]
        return seed, length, segments, table.tobytes()
    raise ArithmeticError("no seed gives a binary fuse filter")


def may_contain(keys: np.ndarray, seed: int, length: int, segments: int, table: bytes) -> np.ndarray:
    if seed == 0:
        return np.zeros(len(keys), bool)
    at, prints = _cells(keys, seed, length, segments)
    t = np.frombuffer(table, np.uint8)
    return t[at[:, 0]] ^ t[at[:, 1]] ^ t[at[:, 2]] == prints


def _keys(digests: pd.Series) -> np.ndarray:
    """The last 8 bytes of each digest; its first ones choose the bucket."""
    return np.frombuffer(b"".join(bytes(x)[-8:] for x in digests), "<u8")


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    seed, length, segments, table = fuse_filter(_keys(rows.digest))
    return pd.DataFrame({"bucket": [rows.bucket.iloc[0]], "seed": [seed], "length": [length], "segments": [segments], "fingerprints": [table]})


def _screen(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(rows):
        return rows.assign(maybe=False)
    f = filters.iloc[0] if len(filters) else None
    return rows.assign(maybe=may_contain(_keys(rows.digest), int(f.seed), int(f.length), int(f.segments), bytes(f.fingerprints)) if f is not None else False)


def _classes(narrow: DataFrame, buckets: int) -> DataFrame:
    out = narrow.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    return out.withColumn("bucket", (F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long") % buckets).cast("int"))


def write_snapshot(digests: DataFrame, folder: str) -> None:
    """Write an immutable snapshot's classes and their filters, once for all batches that are held against it.

    digests: digest, id of each row. folder/classes: digest, keep, n, bucket; folder/filters: a filter for each bucket.
    """
    spark = digests.sparkSession
    buckets = max(1, digests.count() // BUCKET)
    _classes(digests, buckets).withColumn("buckets", F.lit(buckets)).write.option("compression", "zstd").parquet(f"{folder}/classes")
    own = spark.read.parquet(f"{folder}/classes").select("bucket", "digest")
    filters = own.groupBy("bucket").applyInPandas(_build, "bucket int, seed long, length long, segments long, fingerprints binary")
    filters.write.option("compression", "zstd").parquet(f"{folder}/filters")


def against_snapshot(digests: DataFrame, folder: str) -> DataFrame:
    """digest, keep, n of all classes of a batch (digest, id) and the snapshot in folder.

    What a bucket's filter excludes is new for certain and grouped among the batch alone; only positives join the
    snapshot's buckets.
    """
    spark = digests.sparkSession
    snapshot, filters = spark.read.parquet(f"{folder}/classes"), spark.read.parquet(f"{folder}/filters")
    buckets = (snapshot.select("buckets").first() or [1])[0]
    batch = _classes(digests, buckets)
    screened = materialise(batch.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_screen, "digest binary, keep long, n long, bucket int, maybe boolean"), "screened")
    positive = screened.where("maybe").select("digest", F.col("keep").alias("keep2"), F.col("n").alias("n2"))
    merged = snapshot.join(positive, "digest", "full_outer").select("digest", F.greatest("keep", "keep2").alias("keep"), (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))
    return merged.unionByName(screened.where("not maybe").select("digest", "keep", "n"))


def exact_dedup(docs: DataFrame, in_snapshot, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, keep_id, group_size, kept, text_sha256.

    in_snapshot: a condition on docs; the rows where it holds are the snapshot, all others the incoming batch. The
    result is the same for any. Null texts count as empty. Of equal texts the row with the largest id stays; rows that
    repeat an id and a text stay together; a null id stays only if its class has no other. An empty table gives an
    empty one. Very long texts are compared by digest and then, if theirs is repeated, byte for byte; different texts
    with one SHA-256 would end the job with an error instead of being merged.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    narrow = materialise(docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.coalesce(in_snapshot, F.lit(False)).alias("old")), "digests")
    write_snapshot(narrow.where("old"), folder := workspace(docs.sparkSession, "snapshot"))
    classes = materialise(against_snapshot(narrow.where("not old"), folder), "classes")
    # Byte checks of what is repeated. Copies collapse before the shuffle, so a hot text is one row a task.
    repeated = classes.where("n > 1").select("digest", "n")
    bodies = docs.select(digest.alias("digest"), text.alias("body"))
    if repeated.limit(REPEATED + 1).count() <= REPEATED:
        bodies = bodies.join(F.broadcast(repeated.select("digest")), "digest", "left_semi")
    bodies = bodies.groupBy("digest", "body").agg(F.count("*").alias("m")).groupBy("digest").agg(F.count("*").alias("bodies"), F.sum("m").alias("m"))
    odd = bodies.join(repeated, "digest").where((F.col("bodies") > 1) | (F.col("m") != F.col("n"))).limit(1).count()
    if odd:
        raise ValueError("different texts share a SHA-256")
    out = join_by_key(narrow, classes, "digest", "n", narrow.count())
    kept = F.col("id").eqNullSafe(F.col("keep"))
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot is the older half of the ids, the batch the newer."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    middle = docs.agg(F.avg("doc_id")).first()[0]
    return exact_dedup(docs, F.col("doc_id") <= F.lit(middle))


OP3_SQL = """
with c as (select coalesce(text, '') body, max(doc_id) keep_id, count(*)::bigint group_size from documents group by 1)
select d.doc_id, c.keep_id, c.group_size, d.doc_id is not distinct from c.keep_id kept, sha256(c.body) text_sha256
from documents d join c on coalesce(d.text, '') = c.body
"""
