"""Search requests as a service or a command line would take them: checked, answered by the engine, laid out as plain dicts.

No HTTP server and no rate limits: those belong to whoever hosts this.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import models, preview, search
from folio.operators.search import Options
from folio.sources import index as indexes

#: Limits and defaults of a request.
QUERY, TOP, PAGE, SIZE, BOOK, POV, POVS = 300, 10, 1000, 50, 16, 32, 50
DEFAULT_TOP, DEFAULT_SIZE, CHAPTER_PASSAGES = 5, 20, 8


class BadRequest(ValueError):
    """What the caller asked for can't be answered."""


def _check(ok, problem: str) -> None:
    if not ok:
        raise BadRequest(problem)


@dataclass(frozen=True)
class Request:
    """A search request. Hybrid takes top, lexical page and page_size; pov or povs, not both."""

    query: str
    mode: str = "hybrid"
    top: int | None = None
    page: int | None = None
    page_size: int | None = None
    book: str | None = None
    pov: str | None = None
    povs: tuple[str, ...] | None = None

    def __post_init__(self):
        _check(isinstance(self.query, str) and 1 <= len(self.query) <= QUERY and self.query.strip(), f"a query has 1 to {QUERY} characters and isn't blank")
        _check(self.mode in ("hybrid", "lexical"), "the mode is hybrid or lexical")
        for name, most in (("top", TOP), ("page", PAGE), ("page_size", SIZE)):
            x = getattr(self, name)
            _check(x is None or isinstance(x, int) and not isinstance(x, bool) and 1 <= x <= most, f"{name} is between 1 and {most}")
        _check(self.book is None or len(self.book) <= BOOK and re.fullmatch("[A-Za-z0-9_-]+", self.book), "an odd book")
        _check(self.pov is None or self.povs is None, "pov and povs don't go together")
        _check(self.povs is None or 1 <= len(self.povs) <= POVS, f"povs hold 1 to {POVS} values")
        for p in self.povs or ([self.pov] if self.pov else []):
            _check(len(p) <= POV and re.fullmatch("[A-Za-z -]+", p), "an odd pov")
        if self.mode == "hybrid":
            _check(self.page is None and self.page_size is None, "pages belong to the lexical mode")
        else:
            _check(self.top is None, "top belongs to the hybrid mode")

    def normal(self) -> Request:
        """With single blanks, defaults, the book in lower case and povs in upper case, sorted, once each."""
        povs = tuple(sorted({p.upper() for p in self.povs or ([self.pov] if self.pov else [])})) or None
        out = replace(self, query=" ".join(self.query.split()), book=self.book.casefold() if self.book else None, pov=None, povs=povs)
        return replace(out, top=out.top or DEFAULT_TOP) if out.mode == "hybrid" else replace(out, page=out.page or 1, page_size=out.page_size or DEFAULT_SIZE)


def catalog(chunks: DataFrame) -> DataFrame:
    """book, povs (sorted), n_chapters of an index; books in order."""
    return chunks.groupBy("book").agg(F.array_sort(F.collect_set("pov")).alias("povs"), F.count_distinct("doc_id").alias("n_chapters")).orderBy("book")


def check_filters(books: dict[str, list[str]], request: Request) -> None:
    """A pov must stand in the chosen book, or in any book if none is chosen."""
    own = {b.casefold(): [p.upper() for p in ps] for b, ps in books.items()}
    _check(request.book is None or request.book in own, f"unknown book {request.book!r}; choose one of: {', '.join(sorted(own))}")
    known = {p for b, ps in own.items() if request.book in (None, b) for p in ps}
    unknown = sorted(set(request.povs or ()) - known)
    _check(not unknown, f"unknown POV {', '.join(unknown)}; choose one of: {', '.join(sorted(known))}")


def pagination(total: int, page: int, size: int) -> dict:
    return {"page": page, "page_size": size, "total_results": total, "total_pages": -(-total // size), "has_next": page * size < total}


@dataclass
class Settings:
    """Where the index is and how much is shown, from the environment."""

    index: str = field(default_factory=lambda: os.environ.get("FOLIO_INDEX", ""))
    model: str = field(default_factory=lambda: os.environ.get("FOLIO_MODEL", "digest-16"))
    excerpt_chars: int = field(default_factory=lambda: int(os.environ.get("FOLIO_EXCERPT_CHARS", preview.EXCERPT_CHARS)))


class Service:
    """Loads its index when first asked; ready() says whether that worked, without details."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings, self._index, self._books = spark, settings, None, None

    @property
    def index(self) -> indexes.Index:
        if self._index is None:
            self._index = indexes.load_index(self.spark, self.settings.index, models.encoder(self.settings.model))
        return self._index

    def health(self) -> dict:
        return {"status": "ok", "loaded": self._index is not None}

    def ready(self) -> bool:
        try:
            return self.index is not None
        except Exception:  # noqa: BLE001
            return False

    def catalog(self) -> list[dict]:
        if self._books is None:
            self._books = [r.asDict() for r in catalog(self.index.chunks).collect()]  # one row a book
        return self._books

    def search(self, request: Request) -> dict:
        """results, and for the lexical mode pagination and book_counts."""
        began, request = time.monotonic(), request.normal()
        check_filters({b["book"]: b["povs"] for b in self.catalog()}, request)
        model = models.encoder(self.settings.model)
        queries = self.spark.createDataFrame([(0, request.query, model.encode_queries([request.query])[0].tolist())], "item_id long, query string, q array<float>")
        chunks, out = self.index.chunks, {}
        features = search.lexical_features(chunks, queries, words=self.index.lexicon)
        if request.mode == "hybrid":
            options = Options(top=request.top, passages_per_chapter=CHAPTER_PASSAGES)
            found = search.hierarchical_search(chunks, queries, options, request.povs, request.book, features=features).results
        else:
            may = search.eligible(chunks, request.povs, request.book).select("pos")
            every = search.selected(features.where("score > 0").join(may, "pos", "left_semi"), chunks)
            counts = every.join(chunks.select("pos", "book"), "pos").groupBy("book").agg(F.count("*").alias("n"))
            n = {r.book: r.n for r in counts.collect()}  # one row a book
            out["book_counts"] = [{"book": b["book"], "count": n.get(b["book"], 0)} for b in self.catalog()]
            out["pagination"] = pagination(sum(n.values()), request.page, request.page_size)
            first = (request.page - 1) * request.page_size
            found = every.where(F.col("rank").between(first + 1, first + request.page_size))
        own = chunks.select("pos", F.col("doc_id").alias("chapter"), "ordinal", "book", "pov", "word_start", "word_end", "text")
        shown = preview.with_preview(found.join(own, "pos").withColumn("query", F.lit(request.query)), self.settings.excerpt_chars)
        beside = preview.neighbour_fragments(chunks.join(shown.select("chapter").distinct(), chunks["doc_id"] == F.col("chapter"), "left_semi"))
        rows = shown.join(beside.withColumnRenamed("doc_id", "chapter"), ["chapter", "ordinal"]).orderBy("rank").collect()  # a page at most
        keep = [c for c in shown.columns if c not in ("query", "text", "item_id", "doc_id")]
        out["results"] = [{**{c: r[c] for c in keep if c != "preview"}, "preview": r.preview.asDict() if r.preview else None, "before": r.before, "after": r.after} for r in rows]
        return out | {"duration_ms": round(1000 * (time.monotonic() - began), 1)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Commands: catalog, search, similar. Prints JSON; 2 on errors."""
    parser = argparse.ArgumentParser(prog="folio")
    parser.add_argument("--index", required=True)
    parser.add_argument("--model", default="digest-16")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("catalog")
    asked = commands.add_parser("search")
    asked.add_argument("query")
    asked.add_argument("--mode", choices=("hybrid", "lexical"), default="hybrid")
    for name in ("top", "page", "page-size"):
        asked.add_argument(f"--{name}", type=int)
    asked.add_argument("--book")
    asked.add_argument("--pov", action="append")
    near = commands.add_parser("similar")
    near.add_argument("pos", type=int)
    near.add_argument("--top", type=int, default=10)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    service = Service(spark, Settings(args.index, args.model))
    try:
        if args.command == "catalog":
            said = service.catalog()
        elif args.command == "search":
            said = service.search(Request(args.query, args.mode, args.top, args.page, args.page_size, args.book, povs=tuple(args.pov) if args.pov else None))
        else:
            chunks = service.index.chunks
            source = chunks.where(F.col("pos") == args.pos)
            _check(source.limit(1).count(), f"no chunk {args.pos}")
            said = [r.asDict() for r in search.similar_chunks(chunks, source, Options(top=args.top)).orderBy("rank").collect()]
    except ValueError as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2
    print(json.dumps(said, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
