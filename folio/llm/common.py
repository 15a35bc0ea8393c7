"""What the training-data operators share: reading, writing to the shared folder, joins that survive hot keys."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with at least this share of all rows counts as hot; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 2000

#: A-Z and a-z; the only letters that the word rules fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of an Arrow batch between the JVM and a Python worker, and the setting that says so.
BATCH_BYTES, BATCH_SETTING, BATCH_DEFAULT = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches to BATCH_BYTES for the session, unless its owner has set a bound; by default a batch may hold a whole split."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", found := tempfile.mkdtemp(prefix="folio-"))
    return found.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    path = workspace(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df (a written table), to be broadcast if it has at most that many rows; otherwise joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def join_by_key(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """left joined to right, which has one row for each key and, in `rows`, how many rows of left bear that key.

    total: the rows of left. Keys with HOT_SHARE of them or more are at most 1 / HOT_SHARE many, so those rows of
    right are broadcast and left's hot rows stay where they are; all other keys meet by a shuffle.
    left is read twice; it should be a written table.
    """
    least = max(1000, math.ceil(total * HOT_SHARE))
    hot = right.where(F.col(rows) >= least)
    few = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(few, key, "left_anti").join(right.where(F.col(rows) < least), key))


def _likely(df: DataFrame, n: int, key: Column, by: str | None) -> DataFrame:
    """Of each value of `by` about 4 * n different rows, with __share: a hash of the key between 0 and 1, held against n and the number of keys."""
    df = df.withColumn("__share", F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48)))
    if by is None:
        return df.where(F.col("__share") * F.lit(float(df.agg(F.approx_count_distinct("__share")).first()[0])) <= 4 * n + 50)
    counts = materialise(df.groupBy(by).agg(F.approx_count_distinct("__share").alias("__keys")), "counts")
    return df.join(bounded(counts, 100_000), by).where(F.col("__share") * F.col("__keys") <= 4 * n + 50).drop("__keys")


def sample_ids(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most n rows (doc_id, columns) of df, which has a row for each doc_id, in the order of a hash of the id."""
    own = _likely(df.select("doc_id", *columns), n, F.col("doc_id").cast("string"), None)
    return own.orderBy("__share", "doc_id").limit(n).select("doc_id", *columns)


def sample_rows(df: DataFrame, n: int, *columns: str, by: str | None = None, most_bytes: int = 32 << 20) -> list:
    """At most n rows (doc_id, text, columns) of df, for each value of `by` if given, in the order of a hash of id and text.

    Rows that repeat an id and a text count once. Texts beyond most_bytes (of each value of `by`: its share of them) are
    left out, but for the first. About 4 * n rows a value meet in one task.
    """
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text"))
    few = _likely(df.select("doc_id", "text", *columns), n, key, by).dropDuplicates(["doc_id", "__share", *columns])
    order = Window.partitionBy(*([by] if by else [])).orderBy("__share", "doc_id")
    few = few.withColumn("__rank", F.row_number().over(order)).withColumn("__size", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = max(1, df.select(by).distinct().count()) if by else 1
    few = few.where((F.col("__rank") <= n) & ((F.col("__size") <= most_bytes // parts) | (F.col("__rank") == 1)))
    return few.select("doc_id", "text", *columns).orderBy("doc_id", "text", *columns).collect()
