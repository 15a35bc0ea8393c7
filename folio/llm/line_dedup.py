"""Line dedup by content-defined chunks of lines; DataFrame functions only.

A rolling hash over the hashes of the last lines chooses where a chunk ends, so inserted or deleted lines shift only
the chunks near them. Chunks of several lines that repeat anywhere in the corpus are removed but for their first place.

Chunks miss most shared passages: two ends have to fall inside one. passage_dedup compares every pair of neighbouring
lines instead, and every long line, so that no passage of two lines or more escapes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import join_by_key, materialise, read

#: Lines that the rolling hash sees; one line in DIVISOR ends a chunk on average.
WINDOW, DIVISOR = 2, 3
#: Multipliers of the rolling hash: line i - j counts with BASE to the power j.
BASE = 31
#: Characters from which a line alone counts as a passage.
LONG_LINE = 100
#: Repeated digests (16 bytes each), and rows and places that go (some 50 bytes each), that a broadcast may hold.
REPEATED, PLACES = 200_000, 300_000
#: Blanks that a line may consist of and still be empty.
_BLANK = " \t\n\r"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a column that a lambda captures would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def _spans(h: Column) -> Column:
    """Chunks of the line hashes h: array of (pos, last), where the rolling hash of the last lines ends one."""

    def ends_at(i: Column) -> Column:
        rolling = sum((F.when(i >= j, h[F.greatest(i - j, F.lit(0))]).otherwise(F.lit(0)) * BASE**j for j in range(WINDOW)), F.lit(0))
        return (i == F.size(h) - 1) | (rolling % DIVISOR == 0)

    ends = F.filter(F.sequence(F.lit(0), F.size(h) - 1), ends_at)
    return _let(ends, lambda e: F.transform(e, lambda last, k: F.struct(F.when(k == 0, 0).otherwise(e[F.greatest(k - 1, F.lit(0))] + 1).alias("pos"), last.alias("last"))))


def _chunks(text: Column) -> Column:
    """Array of (pos, n, body) over all lines of text in order."""

    def of(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
        body = lambda s: F.array_join(F.slice(lines, s["pos"] + 1, s["last"] - s["pos"] + 1), "\n")
        return F.transform(_let(hashes, _spans), lambda s: F.struct(s["pos"].alias("pos"), (s["last"] - s["pos"] + 1).alias("n"), body(s).alias("body")))

    return _let(F.split(F.coalesce(text, F.lit("")), "\n"), of)


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, text (what is left), n_lines, n_chunks, n_removed (lines).

    The first place of a chunk, by (doc_id, the text's md5, position), stays; a null id comes last. Only chunks of two
    lines or more with some text besides white space are removed. Null texts count as empty and are one empty line.
    Rows that repeat an id and a text get the same result; rows that repeat an id alone are different places. Ids may
    have any type that can be ordered. Very long texts are cut in time linear in their lines. An empty table gives an
    empty one.
    """
    docs = docs.select("doc_id", "text")
    row = F.struct("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row.md5").alias("md5"), F.col("k").alias("pos"))
    each = docs.select("doc_id", row.alias("row"), F.posexplode(_chunks(F.col("text"))).alias("k", "c")).where("c.n > 1").withColumn("key", F.unhex(F.md5("c.body")))
    each = each.where(F.trim(F.col("c.body"), F.lit(" \t\n\r")) != "")
    narrow = materialise(each.select("row", place.alias("place"), "key"), "places")
    repeated = materialise(narrow.groupBy("key").agg(F.count("*").alias("places"), F.min("place").alias("first")).where("places > 1"), "repeated")
    # The byte comparison: only bodies with a repeated digest meet; copies collapse before the shuffle.
    bodies = each.select("key", "c.body")
    if repeated.limit(REPEATED + 1).count() <= REPEATED:
        bodies = bodies.join(F.broadcast(repeated.select("key")), "key", "left_semi")
    odd = bodies.groupBy("key", "body").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("bodies")).where("bodies > 1").select("key")
    # A digest of two bodies (never seen) is left alone.
    repeated = materialise(repeated.join(odd, "key", "left_anti"), "repeated")
    gone = join_by_key(narrow, repeated, "key", "places", narrow.count()).where(~F.col("place").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("row.doc_id").alias("__id"), F.col("row.md5").alias("__md5")).agg(F.collect_set("place.pos").alias("gone"))
    gone = materialise(gone, "gone")
    # Where few places go, texts stay where they are; else documents and places meet by a shuffle.
    few = (gone.agg(F.count("*") + F.sum(F.size("gone"))).first()[0] or 0) <= PLACES
    own = docs.withColumn("__md5", F.md5(F.coalesce("text", F.lit(""))))
    side = F.broadcast(gone) if few else gone
    joined = own.join(side, own["doc_id"].eqNullSafe(gone["__id"]) & (own["__md5"] == gone["__md5"]), "left").select("doc_id", "text", "gone")
    cut = joined.select("doc_id", F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("gone"), _chunks(F.col("text")).alias("chunks"))
    left = F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), "gone")
    lost = F.expr("aggregate(gone, 0, (n, k) -> n + chunks[k].n)")
    return cut.select(
        "doc_id",
        F.array_join(F.transform(left, lambda k: F.col("chunks")[k]["body"]), "\n").alias("text"),
        F.expr("aggregate(chunks, 0, (n, c) -> n + c.n)").cast("long").alias("n_lines"),
        F.size("chunks").cast("long").alias("n_chunks"),
        lost.cast("long").alias("n_removed"),
    )


def _passages(text: Column) -> Column:
    """Array of (pos, last, key): every pair of neighbouring lines, blank ones between them passed over, and long lines."""

    def digest(x: Column) -> Column:
        return F.unhex(F.substring(F.sha2(x, 256), 1, 32))

    def of(lines: Column, hashes: Column, full: Column) -> Column:
        pairs = F.transform(F.slice(full, 1, F.greatest(F.size(full) - 1, F.lit(0))), lambda a, k: F.struct(a.alias("pos"), full[k + 1].alias("last"), digest(F.concat(hashes[a], hashes[full[k + 1]])).alias("key")))
        alone = F.transform(F.filter(full, lambda a: F.char_length(lines[a]) >= LONG_LINE), lambda a: F.struct(a.alias("pos"), a.alias("last"), digest(hashes[a]).alias("key")))
        return F.concat(pairs, alone)

    def split(lines: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.trim(lines[i], F.lit(_BLANK)) != "")
        return _let(F.transform(lines, lambda x: F.unhex(F.sha2(x, 256))), lambda h: _let(full, lambda f: of(lines, h, f)))

    return _let(F.split(F.coalesce(text, F.lit("")), "\n"), split)


def passage_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, text (what is left), n_lines, n_removed (lines).

    A pair of neighbouring lines, or a line of LONG_LINE characters, that stands at an earlier place too goes, with the
    blank lines inside the pair; so of a repeated passage every line goes, wherever it begins. Places are ordered by
    (doc_id, text's md5, position), a null id last. The first place of every line stays: a pair that holds it can't
    have an earlier place. Lines count as equal by SHA-256, of which keys are 128 bits. Null texts count as empty and
    are one empty line. Rows that repeat an id and a text get the same result. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("md5"))
    each = docs.select("doc_id", "md5", F.explode(_passages(F.col("text"))).alias("p"))
    narrow = materialise(each.select(F.struct("doc_id", "md5").alias("row"), "p.pos", "p.last", "p.key"), "passages")
    place = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), F.col("row.md5").alias("md5"), F.col("pos").alias("pos"))
    repeated = materialise(narrow.groupBy("key").agg(F.count("*").alias("places"), F.min(place).alias("first")).where("places > 1"), "repeated")
    later = join_by_key(narrow, repeated, "key", "places", narrow.count()).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("row.doc_id").alias("__id"), F.col("row.md5").alias("__md5")).agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", "last")))).alias("gone"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (docs["md5"] == gone["__md5"]), "left")
    cut = joined.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return cut.select(
        "doc_id",
        F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
    )


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passage_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed", F.char_length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = r"""
with d as (select doc_id, md5(coalesce(text, '')) m, string_split(coalesce(text, ''), chr(10)) lines from documents),
e as (select doc_id, m, lines, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint) h from d),
f as (select doc_id, m, lines, list_filter(range(1, len(h) + 1), lambda i: i = len(h) or (h[i] + 31 * (case when i > 1 then h[i - 1] else 0 end)) % 3 = 0) ends from e),
c as (select doc_id, m, lines, ends, unnest(range(1, len(ends) + 1)) k from f),
b as (select doc_id, m, k, case when k = 1 then 0 else ends[k - 1] end pos, ends[k] last, lines from c),
x as (select doc_id, m, pos, last - pos n, array_to_string(lines[pos + 1:last], chr(10)) body from b),
g as (select body, count(*) places, min((doc_id is null, coalesce(doc_id, 0), m, pos)) first from x where n > 1 and trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> '' group by body having count(*) > 1),
y as (select x.*, g.body is not null and (x.doc_id is null, coalesce(x.doc_id, 0), x.m, x.pos) <> g.first gone from x left join g on x.body = g.body and x.n > 1),
z as (select doc_id, sum(n)::bigint n_lines, count(*)::bigint n_chunks, coalesce(sum(case when gone then n end), 0)::bigint n_removed,
             coalesce(string_agg(case when not gone then body end, chr(10) order by pos), '') left_text from y group by doc_id, m)
select doc_id, n_lines, n_chunks, n_removed, length(left_text)::bigint n_chars_left, sha256(left_text) text_sha256 from z
"""
