"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles. One permutation scatters the shingles over a ring, a second one, shifted
by k places, gives signature coordinate k: two permutations make all of them. Documents that agree in a band share a
bucket. Within a bucket each member is compared with one leader only; leaders differ from band to band, so members meet
many partners without any bucket's pairs being listed. What a bucket then still holds in several components is compared
across these components, so no link that banding shows is lost. Every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folio.llm.common import bounded, join_by_key, materialise, read, small_batches

WORDS, NUMERATOR, DENOMINATOR = 4, 80, 100
#: Bands and their rows: at a similarity of 0.8 a pair shares no band in 6 of 100,000 cases.
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Places on the ring that the permutations permute.
RING_BITS = 20
#: Pairs of leader and member whose signatures agree in less than this share wait for the comparison of components.
LEAST = 0.75
#: Shingles of the members that are compared at once.
BLOCK = 1_000_000
#: Files a core that frames of a few numbers a row are written to; the rounds of the components write and read dozens of these frames.
FILES = 4

_rng = np.random.default_rng(20)
BYTES = _rng.integers(0, 2**64, 256, np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACES = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
RING = _rng.permutation(1 << RING_BITS).astype(np.uint32)
SHIFTED = np.lib.stride_tricks.sliding_window_view(np.concatenate([RING, RING[:COORDINATES]]), COORDINATES)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words: runs of anything but ASCII white space, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.concatenate([[False], ~SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    powers = np.cumprod(np.full(int(length.max()), STEP, np.uint64), dtype=np.uint64)
    values = BYTES[raw[inside[1:-1]]] * powers[place]
    return _mix(np.add.reduceat(values, np.cumsum(length) - length) + length.astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words are one shingle, no words none."""
    w = word_hashes(text)
    n = min(words, len(w))
    if not n:
        return w
    total = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        total += w[k : len(w) - n + 1 + k] * PLACES[k]
    return np.unique(_mix(total))


def signature(own: np.ndarray) -> np.ndarray:
    """Coordinate k is the least place of the ring, shifted by k, over the shingles."""
    at = (own * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - RING_BITS)
    out = np.full(COORDINATES, 1 << RING_BITS, np.uint32)
    for i in range(0, len(at), 1024):
        np.minimum(out, SHIFTED[at[i : i + 1024]].min(0), out=out)
    return out


def band_keys(signed: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different from band to band."""
    rows = signed.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((rows * PLACES[:ROWS]).sum(1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * STEP)


def _digest(own: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, words) for t in part.column("text").to_pylist()]
                signed = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([None if s is None else band_keys(s).view(np.int64) for s in signed], pa.list_(pa.int64())),
                        pa.array([None if s is None else s.astype(np.uint8).tobytes() for s in signed], pa.binary()),
                    ],
                    names=["doc_id", "row", "n_shingles", "digest", "bands", "signed"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])

    return run


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of the coordinates in which two signatures agree."""
    x, y = (np.frombuffer(b"".join(map(bytes, s)), np.uint8).reshape(-1, COORDINATES) for s in (a, b))
    return pd.Series((x == y).mean(1))


def _narrow(df: DataFrame, name: str) -> DataFrame:
    """materialise for rows of a few numbers, in at most FILES files a core, however many partitions the session shuffles into."""
    return materialise(df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism), name)


def components(edges: DataFrame) -> DataFrame:
    """c, label: the smallest node that a node of edges (a, b) reaches. Labels spread over edges, then jump."""
    both = _narrow(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = _narrow(both.groupBy(F.col("a").alias("c")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        far = both.join(labels, both["b"] == labels["c"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(far, labels["c"] == far["a"]).select("c", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("c").alias("label"), F.col("label").alias("root"))
        jumped = _narrow(spread.join(root, "label").select("c", "old", F.least("label", "root").alias("label")), "labels")
        if not jumped.where("old != label").limit(1).count():
            return jumped.select("c", "label")
        labels = jumped.select("c", "label")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: the components of the graph whose nodes are the components so far."""
    a, b = (labels.select(F.col("c").alias(k), F.col("label").alias(f"label_{k}")) for k in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    new = components(ends.where("a != b").distinct())
    new = new.select(F.col("c").alias("own"), F.col("label").alias("root"))
    moved = labels.join(new, labels["label"] == new["own"], "left").select("c", F.coalesce("root", "label").alias("label"))
    single = new.select(F.col("own").alias("c"), F.col("root").alias("label")).join(labels.select("c"), "c", "left_anti")
    return _narrow(moved.unionByName(single), "labels")


def _verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    a, b = (sets.select(F.col("c").alias(k), F.col("shingles").alias(f"of_{k}")) for k in "ab")
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.withColumn("common", common).where(denominator * F.col("common") >= numerator * (F.size("of_a") + F.size("of_b") - F.col("common"))).select("a", "b")


def _across(own: pd.DataFrame, others: pd.DataFrame, numerator: int, denominator: int) -> pd.DataFrame:
    """Links from own to others in another component that share a band: one for each of own and component."""
    found = []
    if len(own) and len(others):
        bands, label, c = np.stack(others.bands.to_numpy()), others.label.to_numpy(), others.c.to_numpy()
        size = others.shingles.map(len).to_numpy()
        known, ids = np.unique(np.concatenate(others.shingles.to_numpy()), return_inverse=True)
        starts, held = np.cumsum(size) - size, np.zeros(len(known), np.uint8)
        for own_c, own_label, own_bands, own_set in zip(own.c, own.label, own.bands, own.shingles, strict=True):
            may = (label != own_label) & (bands == own_bands).any(1)
            may &= (denominator * size >= numerator * len(own_set)) & (denominator * len(own_set) >= numerator * size)
            if not may.any():
                continue
            at = np.searchsorted(known, own_set)
            at = at[known[np.minimum(at, len(known) - 1)] == own_set]
            held[at] = 1
            common = np.add.reduceat(held[ids], starts, dtype=np.int64)
            held[at] = 0
            linked = np.flatnonzero(may & (denominator * common >= numerator * (size + len(own_set) - common)))
            _, first = np.unique(label[linked], return_index=True)
            found += [(min(own_c, x), max(own_c, x)) for x in c[linked[first]].tolist()]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _open_links(members: DataFrame, classes: DataFrame, labels: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links between components that share a bucket.

    Buckets that hold several components are gathered into clusters, by their leaders; in a cluster, all but the members
    of its largest component ask, and all members answer. Both sides are dealt into blocks of BLOCK shingles on average,
    so a task holds a block of each.
    """
    known = members.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    mixed = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    lead = labels.select(F.col("c").alias("leader"), F.col("label").alias("lead"))
    mixed = known.join(mixed, "key").join(lead, "leader", "left").select("c", "label", F.coalesce("lead", "leader").alias("lead"))
    mixed = materialise(mixed.distinct(), "open")
    clusters = components(mixed.where("label != lead").select(F.col("label").alias("a"), F.col("lead").alias("b")).distinct())
    full = mixed.select("c", "label").distinct().join(clusters.select(F.col("c").alias("label"), F.col("label").alias("cluster")), "label")
    full = materialise(full.join(sets, "c").join(classes.select("c", "bands"), "c").withColumn("n", F.size("shingles")), "clusters")
    parts = full.groupBy("cluster", "label").agg(F.count("*").alias("m"), F.sum("n").alias("n")).groupBy("cluster")
    parts = parts.agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.sum("n").alias("n"), F.max_by("n", F.struct("m", "label")).alias("most"))
    parts = parts.select("cluster", "largest", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.greatest(F.lit(1), F.col("n") - F.col("most")) / BLOCK).cast("int").alias("asking"))
    full = full.join(_narrow(parts, "parts"), "cluster")
    block = lambda n: F.pmod(F.xxhash64("c"), n).cast("int")
    own = full.where("label != largest").withColumn("i", block(F.col("asking"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = full.withColumn("j", block(F.col("blocks"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)))
    where, columns = ["cluster", "i", "j"], ["c", "label", "bands", "shingles"]
    sides = own.select(*where, F.lit(True).alias("asks"), *columns).unionByName(others.select(*where, F.lit(False).alias("asks"), *columns))
    return sides.groupBy(*where).applyInPandas(lambda x: _across(x[x.asks], x[~x.asks], numerator, denominator), "a long, b long")


def _row_key() -> Column:
    """16 bytes that tell rows apart by doc_id (null is a value of its own) and text."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.length(F.col("doc_id").cast("string")), F.lit(-1)), F.col("doc_id").cast("string"), F.col("text"))))


def _classified(signed: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """One row a class of equal sets, told apart by the sets' 128-bit digests; and what gives frames with digest their class's number c.

    c has 64 bits. Where two digests share one (a few in ten billion), the larger digests get another.
    """
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("rep"), F.count("*").alias("n"), F.any_value("bands").alias("bands"), F.any_value("signed").alias("signed"))
    classes = materialise(classes.select("digest", F.col("rep.doc_id").alias("rep"), "rep.row", "n", "bands", "signed"), "classes")
    clash = classes.groupBy(F.xxhash64("digest").alias("__c")).agg(F.count("*").alias("m"), F.min("digest").alias("__low")).where("m > 1").select("__c", "__low")
    clash = materialise(clash, "clash")
    if not clash.limit(1).count():
        return classes.withColumn("c", F.xxhash64("digest")), lambda df: df.withColumn("c", F.xxhash64("digest"))
    clash = bounded(clash, 100_000)

    def numbered(df: DataFrame) -> DataFrame:
        own = F.xxhash64("digest")
        out = df.withColumn("__c", own).join(clash, "__c", "left")
        return out.withColumn("c", F.when(F.col("__low").isNull() | (F.col("digest") == F.col("__low")), own).otherwise(F.xxhash64("digest", F.lit(1)))).drop("__c", "__low")

    return numbered(classes), numbered


def near_duplicates(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Linked are documents with denominator * common shingles >= numerator * all their shingles. Null, empty and blank
    texts have no shingles, no links and themselves as component; texts with one set always share a component, rows
    that repeat an id included. A null id is never a component's id unless there is no other. A very long text is one
    set, compared whole. An empty table gives an empty one.
    """
    out = _components(docs, words, numerator, denominator).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components(docs: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """doc_id, row (see _row_key), n_shingles, component_id, label (of the component; null without shingles) of each row."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", _row_key().alias("row"))
    signed = materialise(docs.mapInArrow(_sign(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row binary, n_shingles long, digest binary, bands array<long>, signed binary"), "signed")
    classes, numbered = _classified(signed)
    # Buckets of at least two classes, and of each a leader by a hash that differs from band to band.
    places = classes.select("c", F.posexplode("bands").alias("band", "key"))
    chosen = places.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("c", "key").alias("h"), "c")).alias("leader")).where("n > 1")
    chosen = materialise(chosen.select("key", "n", F.col("leader.c").alias("leader")), "buckets")
    members = materialise(join_by_key(places, chosen, "key", "n", max(1, chosen.agg(F.sum("n")).first()[0] or 0)), "members")
    near = classes.select("c", "signed")
    pairs = members.where("c != leader").select(F.least("c", "leader").alias("a"), F.greatest("c", "leader").alias("b")).distinct()
    pairs = pairs.join(near.select(F.col("c").alias("a"), F.col("signed").alias("x")), "a").join(near.select(F.col("c").alias("b"), F.col("signed").alias("y")), "b")
    pairs = materialise(pairs.withColumn("like", agreement("x", "y")).where(F.col("like") >= LEAST).select("a", "b", "like"), "pairs")
    # Full sets of all that share a bucket.
    needed = members.select("c").distinct().join(classes.select("c", "row"), "c").select("row")
    # A class's text is read once, however many rows repeat its id and text.
    texts = docs.join(needed, "row", "left_semi").dropDuplicates(["row"]).select("text")
    sets = numbered(texts.mapInArrow(_sets(words), "digest binary, shingles array<long>")).select("c", "shingles")
    sets = materialise(sets, "sets")
    # First each class's likeliest partner, then what may still join two components.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c"), F.struct("like", "a", "b").alias("p")).groupBy("c").agg(F.max("p").alias("p"))
    best = materialise(ends.select("p.a", "p.b").distinct(), "best")
    links = materialise(_verified(best, sets, numerator, denominator), "links")
    labels = components(links)
    rest = pairs.join(best, ["a", "b"], "left_anti")
    labels = _merged(labels, materialise(_verified(_apart(rest, labels), sets, numerator, denominator), "links"))
    more = materialise(_open_links(members, classes, labels, sets, numerator, denominator), "links")
    labels = _merged(labels, more)
    known = classes.select("c", "rep", "n").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    ids = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = materialise(known.join(ids, "label").select("c", "n", "component_id", "label"), "components")
    narrow = signed.select("doc_id", "row", "n_shingles", "digest")
    total = signed.count()
    out = join_by_key(numbered(narrow.where("n_shingles > 0")), found, "c", "n", total).select("doc_id", "row", "n_shingles", "component_id", "label")
    return out.unionByName(narrow.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label")))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that no component holds both of."""
    a, b = (labels.select(F.col("c").alias(k), F.col("label").alias(f"label_{k}")) for k in "ab")
    out = pairs.join(a, "a", "left").join(b, "b", "left")
    return out.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def distinct_documents(docs: DataFrame, words: int = 5) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id; all columns of docs.

    Of rows that share that id, the one with the smallest md5 of id and text; of rows that repeat an id and a text, any one.
    Null, empty and blank texts are groups of their own, one for each id (a null id counts as one). An empty table gives
    an empty one. Columns of docs named __row are not allowed.
    """
    found = _components(docs, words, NUMERATOR, DENOMINATOR).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    group = ["label", F.col("label").isNull().alias("blank"), F.when(F.col("label").isNull(), F.struct("doc_id", F.col("doc_id").isNull().alias("none"))).alias("own")]
    kept = materialise(found.groupBy(*group).agg(F.min("row").alias("__row"), F.count("*").alias("m")).select("__row", "m"), "kept")
    keyed = docs.withColumn("__row", _row_key())
    # Only where rows share a kept id may a key stand twice.
    once = keyed.join(kept.where("m = 1").select("__row"), "__row", "left_semi")
    if kept.where("m > 1").limit(1).count():
        once = once.unionByName(keyed.join(kept.where("m > 1").select("__row"), "__row", "left_semi").dropDuplicates(["__row"]))
    return once.drop("__row")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP6_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') x from (select doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where {DENOMINATOR} * c >= {NUMERATOR} * (x.n + y.n - c)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) b from r group by a)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, m.b component_id, m.b = w.doc_id kept
from w left join n on n.doc_id = w.doc_id join m on m.a = w.doc_id
"""
