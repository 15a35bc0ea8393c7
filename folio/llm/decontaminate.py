"""Benchmark decontamination: a broadcast set of the test items' word windows is looked up along every document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import LOWER, UPPER, materialise, read, small_batches

#: Item words in a window; an item with fewer is one window.
WIDTH = 10
#: Windows that are broadcast at once (some 16 MB and their vocabulary); a larger benchmark is searched in blocks of so many.
BLOCK = 1_000_000
#: Columns that a search in blocks adds to the documents.
_FOUND = "__found"
#: Words are maximal runs of bytes other than these; A-Z are folded.
_NOT = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in _NOT else b for b in range(256))
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Windows:
    """A set of windows over a vocabulary; lookup by rolling hash, then verified word by word.

    Besides the vocabulary, a window takes 16 bytes: its hash, and where it starts among the items' coded words.
    """

    def __init__(self, items: list[tuple[str | None, str]], width: int = WIDTH):
        """items: (id as text, item text); windows of an item without an id are found, but name no item."""
        self.vocabulary: dict[bytes, int] = {}
        self.names, coded, starts = [], [], {}
        at = 0
        for item, text in items:
            own = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)), np.uint32)
            if len(own):
                n = min(width, len(own))
                starts.setdefault(n, []).append(np.arange(at, at + len(own) - n + 1))
                self.names.append((at, item))
                coded.append(own)
                at += len(own)
        self.coded = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
        self.begins = np.array([a for a, _ in self.names], np.int64)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, parts in starts.items():
            own = np.concatenate(parts)
            rolled = self._rolled(self.coded, own, n)
            order = np.argsort(rolled, kind="stable")
            self.windows[n] = rolled[order], own[order]

    @staticmethod
    def _rolled(coded: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for i in range(n):
            out = out * _BASE + coded[at + i]
        return out

    def find(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit, ids of the items that occur."""
        own = words(text)
        coded = np.fromiter(map(self.vocabulary.get, own, [0] * len(own)), np.uint32, len(own))
        hit, found = np.zeros(len(own), bool), set()
        runs = np.concatenate([[0], np.cumsum(coded > 0)])
        for n, (hashes, starts) in self.windows.items():
            at = np.flatnonzero(runs[n:] - runs[:-n] == n) if len(own) >= n else ()
            if not len(at):
                continue
            rolled = self._rolled(coded, at, n)
            low, high = np.searchsorted(hashes, rolled), np.searchsorted(hashes, rolled, "right")
            for k in np.flatnonzero(high > low):
                here = coded[at[k] : at[k] + n]
                for start in starts[low[k] : high[k]]:
                    if (self.coded[start : start + n] == here).all():
                        hit[at[k] : at[k] + n] = True
                        if (item := self.names[np.searchsorted(self.begins, start, "right") - 1][1]) is not None:
                            found.add(item)
        return len(own), hit, found


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def item_blocks(benchmark: DataFrame, block: int = BLOCK, id_col: str = "item_id") -> Iterator[list[tuple[str | None, str]]]:
    """The items, in blocks of at most `block` windows (or one item), streamed to the driver a partition at a time."""
    out, n = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), "text").toLocalIterator():
        k = len(words(text))
        if not k:
            continue
        if out and n + k > block:
            yield out
            out, n = [], 0
        out.append((item, text))
        n += k
    yield out


def scan(df: DataFrame, items: list[tuple[str | None, str]], width: int = WIDTH, text_col: str = "text", into: str = "found") -> DataFrame:
    """df with a struct column: words, hit words, ids of the items found (sorted), spans of hit words (end-exclusive)."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(Windows(items, width))

    @F.pandas_udf(RESULT)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                n, hit, found = held.value.find(text)
                rows.append((n, int(hit.sum()), sorted(found), [{"start": a, "end": b} for a, b in _spans(hit)]))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return df.withColumn(into, find(F.col(text_col)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """docs' columns, n_words, n_hit (long), items (array of ids as text, sorted), spans (of hit words).

    Null and empty texts have no words and no hits; so do items without words. Items without an id are searched, but not in `items`.
    Repeated rows get the same result; an empty table gives an empty one; an empty benchmark finds nothing. A
    benchmark of more than `block` windows is searched in blocks, one after the other: each is one scan over the
    documents, written before the next, so that one block's windows are held at a time.
    Columns of docs named like the four results are replaced; names that begin with __found are not allowed.
    """
    out = docs.drop("n_words", "n_hit", "items", "spans")
    kept, parts = out.columns, []
    if any(c.lower().startswith(_FOUND) for c in kept):
        raise ValueError(f"columns of docs may not begin with {_FOUND}")
    for k, items in enumerate(item_blocks(benchmark, block)):
        out = scan(materialise(out, "block") if k else out, items, width, into=f"{_FOUND}{k}")
        parts.append(F.col(f"{_FOUND}{k}"))
    if len(parts) == 1:
        return out.select(*kept, parts[0]["n_words"].alias("n_words"), parts[0]["n_hit"].alias("n_hit"), parts[0]["items"].alias("items"), parts[0]["spans"].alias("spans"))
    items = F.array_sort(F.array_distinct(F.concat(*[p["items"] for p in parts])))
    spans = F.array_sort(F.concat(*[p["spans"] for p in parts]))
    joined = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    out = out.select(*kept, parts[0]["n_words"].alias("n_words"), items.alias("items"), joined.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(*kept, "n_words", n_hit.alias("n_hit"), "items", "spans")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit; all their columns.

    Null and empty texts have no words and stay; repeated rows stay or go together; an empty table gives an empty one;
    an empty benchmark hits nothing. Blocks as in decontaminate, which also says what names are not allowed.
    """
    columns = docs.columns
    if any(c.lower().startswith(_FOUND) for c in columns):
        raise ValueError(f"columns of docs may not begin with {_FOUND}")
    for k, items in enumerate(item_blocks(benchmark)):
        docs = scan(materialise(docs, "block") if k else docs, items, into=_FOUND).where(f"{_FOUND}.n_hit = 0").select(*columns)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: sha256 of no items, as in the query.
NONE = hashlib.sha256(b"").hexdigest()

OP7_SQL = rf"""
with fold as (select doc_id, row_number() over () rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
item as (select item_id::varchar item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
win as (select distinct item, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') body
        from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from item where len(w) > 0)),
lens as (select distinct n from win),
place as (select rid, i, n, array_to_string(w[i:i + n - 1], ' ') body from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from fold, lens where len(w) >= n)),
hit as (select p.rid, p.i, p.n, win.item from place p join win on p.n = win.n and p.body = win.body),
word as (select rid, count(distinct k) n_hit from (select rid, unnest(range(i, i + n)) k from hit) group by rid),
its as (select rid, count(*) n_items, sha256(string_agg(item, ',' order by item)) items_sha256 from (select distinct rid, item from hit) group by rid)
select f.doc_id, len(f.w)::bigint n_words, coalesce(word.n_hit, 0)::bigint n_hit, coalesce(its.n_items, 0)::bigint n_items,
       coalesce(its.items_sha256, '{NONE}') items_sha256, coalesce(word.n_hit, 0) > 0 contaminated
from fold f left join word on f.rid = word.rid left join its on f.rid = its.rid
"""
