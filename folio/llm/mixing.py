"""Mixing sources to target weights.

Every document gets a hash-random key; within each source documents are range-sorted by it, a distributed prefix sum
of their sizes is taken, and each source is cut at exactly its budget. A budget beyond the source's size repeats whole
epochs; the rest of the last epoch is a prefix of the same random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import bounded, materialise, read

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash-random keys have 52 bits, so that doubles hold them exactly.
KEY_BITS = 52


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """The first 52 bits of md5(seed:doc_id); a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (one row a source: __source, __has, source_size, __docs) with each source's target.

    Water filling: sources in the order of most * size / weight reach their cap first; the k first are capped, the
    others share what is left by weight, for the smallest k at which nobody exceeds the cap. The windows run over one
    row a source.
    """
    by_code = Window.orderBy(F.col("__has").desc(), F.col("__source"))
    k = len(weights)
    w = F.array(*map(F.lit, weights))[(F.row_number().over(by_code) - 1) % k].cast("double")
    cap = F.col("source_size") * F.lit(float(most))
    fill = Window.orderBy("__ratio", F.col("__has").desc(), F.col("__source"))
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    out = sizes.withColumn("__w", w).withColumn("__cap", cap).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    out = out.withColumn("__all", F.sum("source_size").over(Window.partitionBy()).cast("double") * F.lit(float(share)))
    level = (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    out = out.withColumn("__level", level)
    # The first source in this order that stays under its cap sets the level for itself and all after it.
    out = out.withColumn("__level", F.min(F.when(F.col("__ratio") > F.col("__level"), F.struct("__ratio", "__level"))).over(Window.partitionBy())["__level"])
    return out.withColumn("target", F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__w") * F.col("__level"))))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size, __key, __tie (the text's md5) and the null-safe source (__source, __has)."""
    out = docs.withColumn("size", n_words(F.col("text"))).withColumn("__key", random_key(F.col("doc_id"), seed)).withColumn("__tie", F.md5(F.coalesce("text", F.lit(""))))
    return out.withColumn("__source", F.coalesce("source", F.lit(""))).withColumn("__has", F.col("source").isNotNull())


def _ranged(keyed: DataFrame, plan: DataFrame, docs_per_range: int) -> DataFrame:
    """Equal parts of the key space, more of them for larger sources."""
    at = F.floor(F.col("__key") / F.lit(float(2**KEY_BITS)) * F.ceil(F.col("__docs") / docs_per_range)).cast("long")
    return keyed.join(plan, ["__source", "__has"]).withColumn("__range", at)


def mix(docs: DataFrame, seed: int = 1, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, docs_per_range: int = 2000, broadcast_rows: int = 100_000, texts: bool = True) -> DataFrame:
    """docs with size, source_size (long), target (double) and taken (long: the words the mix takes, repeats counted).

    Null or empty texts have size 0 and are taken 0 times; null sources are a source of their own; sources of size 0
    have target 0. Rows with the same doc_id are ordered by their size, then by their text's md5, and equal rows are
    interchangeable. An empty table gives an empty one. Columns of docs named like the four results are replaced; names
    that begin with two underscores are not for docs.

    texts: whether the result keeps the columns besides doc_id and source; without, texts are read once.

    docs_per_range: documents that one range of the key holds on average, so a hot source is dealt over many tasks.
    broadcast_rows: tables of a row a source, or a row a range, are broadcast up to that size.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    part = ["__source", "__has"]
    narrow = materialise(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), "sizes")
    sizes = narrow.groupBy(*part).agg(F.sum("size").alias("source_size"), F.count("*").alias("__docs"))
    plan = bounded(materialise(targets(sizes, weights, share, most).select(*part, "source_size", "target", "__docs"), "targets"), broadcast_rows)
    # Prefix sums: sums by range, then offsets of the ranges, then sums within a range.
    sums = _ranged(narrow, plan, docs_per_range).groupBy(*part, "__range").agg(F.sum("size").alias("__sum"))
    ranges = Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*part, "__range", F.coalesce(F.sum("__sum").over(ranges), F.lit(0)).alias("__offset"))
    offsets = bounded(materialise(offsets, "offsets"), broadcast_rows)
    rows, kept = (_keyed(docs, seed), docs.columns) if texts else (narrow, ["doc_id", "source"])
    within = Window.partitionBy(*part, "__range").orderBy("__key", "doc_id", "size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    out = _ranged(rows, plan, docs_per_range).repartition(*part, "__range")
    out = out.withColumn("__within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, [*part, "__range"])
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = F.floor("target").cast("long") - epochs * F.col("source_size") - F.col("__offset") - F.col("__within")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.withColumn("taken", taken.cast("long")).select(*kept, "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a document taken twice stands there twice; of one that is cut, a row holds its first words.

    Columns are those of docs, with n_chars of the text that a row holds; documents that are not taken are gone. Null,
    empty and blank texts have no words and are never taken; a null source is a source; repeated rows are each taken by
    themselves; an empty table gives an empty one.
    """
    hidden = {c: f"__own_{c}" for c in ("size", "source_size", "target", "taken") if c in docs.columns}
    planned = mix(docs.withColumnsRenamed(hidden), **options)
    copies = F.expr("concat(array_repeat(true, int(taken div size)), if(taken % size > 0, array(false), cast(array() as array<boolean>)))")
    whole = planned.where("taken > 0").withColumn("__whole", F.explode(copies))
    # Pieces are a word and the white space before it; one document a source is cut.
    first = F.expr(r"array_join(slice(split(text, '(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])'), 1, int(taken % size)), '')")
    text = F.when(F.col("__whole"), F.col("text")).otherwise(first)
    out = whole.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, texts=False).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') s, source is not null h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
         ('0x' || substr(md5('1:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint k, md5(coalesce(text, '')) tie
  from documents),
t as (select s, h, sum(size)::bigint source_size from d group by s, h),
w as (select *, ([5, 2, 1])[((row_number() over (order by h desc, s) - 1) % 3 + 1)::int]::double w, source_size * 2.0::double cap,
             sum(source_size) over ()::double * 1.5::double total from t),
r as (select *, cap / w ratio from w),
l as (select *, (total - coalesce(sum(cap) over (order by ratio, h desc, s rows between unbounded preceding and 1 preceding), 0))
                / sum(w) over (order by ratio, h desc, s rows between current row and unbounded following) lev from r),
m as (select *, (select arg_min(lev, ratio) from l where ratio > lev) level from l),
g as (select s, h, source_size, case when level is null then cap else least(cap, w * level) end target from m),
p as (select d.doc_id, d.size, g.source_size, g.target, floor(g.target)::bigint b,
             coalesce(sum(d.size) over (partition by d.s, d.h order by k, doc_id, size, tie rows between unbounded preceding and 1 preceding), 0)::bigint pre
      from d join g on d.s = g.s and d.h = g.h)
select doc_id, size, source_size, target,
       (case when source_size = 0 then 0 else (b // source_size) * size + greatest(0, least(size, b % source_size - pre)) end)::bigint taken
from p
"""
