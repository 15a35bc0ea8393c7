"""Benchmark files: cases and targets, checked; several as one; reports as JSON. A benchmark is a small file, read whole."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What a benchmark may say.
SPLITS, STATUSES, STRATEGIES = ("development", "acceptance"), ("draft", "sealed"), ("midpoint", "overlap")
STYLES = ("descriptive-search", "terse-search", "quotation-or-noisy")
USAGES = ("named", "name-free")
UNSAID = "unspecified"


@dataclass(frozen=True)
class Benchmark:
    cases: tuple[dict, ...]
    sources: tuple[tuple[str, str], ...] = ()
    source_sha256: str | None = None
    name: str | None = None
    split: str = "development"
    status: str = "legacy"
    strategy: str = "midpoint"
    least: int = 20

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """cases (item_id, query, category, query_style, name_usage, scene_id) and targets (item_id, target, doc_id, s, e, grade)."""
        rows = [(c["id"], c["query"], c["category"], c["query_style"], c["name_usage"], c["scene_id"]) for c in self.cases]
        targets = [(c["id"], k, t["chapter_id"], t["word_start"], t["word_end"], t["relevance"]) for c in self.cases for k, t in enumerate(c["targets"])]
        return (
            spark.createDataFrame(rows, "item_id string, query string, category string, query_style string, name_usage string, scene_id string"),
            spark.createDataFrame(targets, "item_id string, target int, doc_id string, s int, e int, grade int"),
        )


def _need(ok, problem: str) -> None:
    if not ok:
        raise ValueError(f"benchmark: {problem}")


def _text(x) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _count(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _hash(x) -> bool:
    return isinstance(x, str) and re.fullmatch("[0-9a-f]{64}", x) is not None


def _target(x, case: str) -> dict:
    _need(isinstance(x, dict) and _text(x.get("chapter_id")), f"a target of {case} names no chapter")
    s, e, grade = x.get("word_start"), x.get("word_end"), x.get("relevance", 3)
    _need(_count(s) and _count(e) and 0 <= s < e, f"a target of {case} has offsets that are none")
    _need(_count(grade) and 1 <= grade <= 3, f"a target of {case} has a relevance outside 1 to 3")
    return {"chapter_id": x["chapter_id"], "word_start": s, "word_end": e, "relevance": grade}


def _case(x, k: int, schema: int, status: str) -> dict:
    _need(isinstance(x, dict), f"case {k} is no object")
    _need(_text(x.get("id")), f"case {k} has no id")
    name = x["id"]
    for key in ("query", "category", "rationale"):
        _need(_text(x.get(key)), f"{name} has no {key}")
    targets = [_target(t, name) for t in x.get("expected_passages") or []]
    chapters = x.get("expected_chapter_ids")
    _need(chapters is None or isinstance(chapters, list) and chapters and all(map(_text, chapters)), f"{name} has chapters that are none")
    _need(chapters or targets, f"{name} expects nothing")
    named = list(dict.fromkeys(t["chapter_id"] for t in targets))
    _need(not (chapters and targets) or set(chapters) == set(named), f"{name} expects chapters other than its passages'")
    style, usage, scene = x.get("query_style", UNSAID), x.get("name_usage", UNSAID), x.get("scene_id")
    _need(style in (UNSAID, *STYLES), f"{name} has an odd query_style")
    _need(usage in (UNSAID, *USAGES), f"{name} has an odd name_usage")
    said = [style != UNSAID, usage != UNSAID, scene is not None]
    _need(all(said) or not any(said), f"{name} must give query_style, name_usage and scene_id together")
    checked = "legacy"
    if schema == 2:
        checked = (x.get("verification") or {}).get("status")
        _need(checked in ("draft", "verified"), f"{name} is neither draft nor verified")
        _need(status != "sealed" or checked == "verified", f"{name} of a sealed benchmark isn't verified")
    return {"id": name, "query": " ".join(x["query"].split()), "category": x["category"], "rationale": x["rationale"], "chapters": chapters or named, "targets": targets, "query_style": style, "name_usage": usage, "scene_id": scene, "verification": checked}


def parsed(payload) -> Benchmark:
    """A list of cases, or an object of version 1 or 2 with corpus and cases."""
    out, schema = Benchmark(()), 1
    if isinstance(payload, dict):
        schema = payload.get("schema_version")
        _need(schema in (1, 2), "schema_version must be 1 or 2")
        if schema == 2:
            _need(_text(payload.get("name")), "no name")
            _need(payload.get("split") in SPLITS and payload.get("status") in STATUSES, "an odd split or status")
            out = replace(out, name=payload["name"], split=payload["split"], status=payload["status"])
        if (how := payload.get("passage_matching")) is not None:
            _need(isinstance(how, dict) and how.get("strategy") in STRATEGIES, "passages match by midpoint or overlap")
            least = how.get("minimum_overlap_words", 20)
            _need(_count(least) and least > 0, "minimum_overlap_words must be positive")
            out = replace(out, strategy=how["strategy"], least=least)
        corpus = payload.get("corpus")
        _need(isinstance(corpus, dict), "no corpus")
        whole, books = corpus.get("source_sha256"), corpus.get("sources")
        _need(whole is not None or books, "the corpus has no hash")
        _need(whole is None or _hash(whole), "a hash is 64 hex characters")
        _need(books is None or isinstance(books, list) and all(isinstance(b, dict) and _text(b.get("book_id")) and _hash(b.get("source_sha256")) for b in books), "an odd source")
        pairs = tuple((b["book_id"], b["source_sha256"]) for b in books or ())
        _need(len({b for b, _ in pairs}) == len(pairs), "a book twice")
        out = replace(out, source_sha256=whole, sources=pairs)
        payload = payload.get("cases")
    _need(isinstance(payload, list) and payload, "no cases")
    cases = tuple(_case(x, k, schema, out.status) for k, x in enumerate(payload, 1))
    _need(len({c["id"] for c in cases}) == len(cases), "an id twice")
    _need(len({bool(c["targets"]) for c in cases}) == 1, "passages for every case or for none")
    return replace(out, cases=cases)


def load(path: str | Path) -> Benchmark:
    return parsed(json.loads(Path(path).read_text(encoding="utf-8")))


def union(parts: Sequence[Benchmark]) -> Benchmark:
    """Several benchmarks as one: no id twice, one hash a book, one way of matching; acceptance and sealed only if all are."""
    _need(parts, "none given")
    cases = tuple(c for p in parts for c in p.cases)
    _need(len({c["id"] for c in cases}) == len(cases), "an id twice")
    _need(len({(p.strategy, p.least) for p in parts}) == 1, "ways of matching differ")
    _need(len({bool(c["targets"]) for c in cases}) == 1, "passages for every case or for none")
    books: dict[str, str] = {}
    for book, digest in (x for p in parts for x in p.sources):
        _need(books.setdefault(book, digest) == digest, f"two hashes of {book}")
    whole = {p.source_sha256 for p in parts if p.source_sha256}
    _need(len(whole) <= 1, "two hashes of the corpus")
    return replace(parts[0], cases=cases, sources=tuple(sorted(books.items())), source_sha256=next(iter(whole), None), name="combined", split="acceptance" if all(p.split == "acceptance" for p in parts) else "development", status="sealed" if all(p.status == "sealed" for p in parts) else "draft")


def subset(whole: Benchmark, cases: Sequence[dict], name: str) -> Benchmark:
    """Some of a benchmark's cases, as a draft for development."""
    return replace(whole, cases=tuple(cases), name=name, split="development", status="draft")


def write_report(report: dict, path: str | Path) -> None:
    """JSON with sorted keys; missing folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True, ensure_ascii=True) + "\n", encoding="utf-8")
