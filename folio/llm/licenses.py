"""License scans: exact phrases, and fuzzy search for short notices.

A notice with at most k errors in it still holds one of its k + 1 parts unharmed (pigeonhole). So the parts' exact
places give all candidates; each is verified in its own window by the regex library's bounded-error matching, which
finds the span. The rest of a window beside a match is searched again, so no notice hides one next to it.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate, groupby

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import read, small_batches
from folio.llm.decontaminate import words

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices, as folded words, and the labels that a match adds. Words in brackets (versions, qualifiers, names)
#: must stand as they are; errors are allowed in the rest alone.
NOTICES = {
    "licensed under the [apache] license version [2 0]": "apache-2.0",
    "this work is licensed under the gnu general public license version [3]": "gpl-3.0",
    "this work is licensed under the gnu general public license version [2]": "gpl-2.0",
    "licensed under [cc by nc 4 0]": "cc-by-nc-4.0",
    "licensed under [cc by sa 4 0]": "cc-by-sa-4.0",
    "creative commons attribution [4 0] international license": "cc-by-4.0",
    "released under the [mit] license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-notice",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "mozilla public license version [2 0]": "mpl-2.0",
    "gnu [lesser] general public license": "lgpl",
    "gnu [affero] general public license": "agpl",
}
#: Characters of a notice, outside brackets, for each error that it may have.
CHARACTERS_PER_ERROR = 10
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<start:int,end:int,label:string,errors:int>>"


def notice_pattern(notice: str) -> tuple[str, int, str]:
    """The notice's words, its errors, and a pattern: each stretch outside brackets with bounded errors, bracketed words as they are."""
    loose = [x.strip() for x in regex.split(r"\[[^\]]*\]", notice)]
    errors = max(1, sum(map(len, loose)) // CHARACTERS_PER_ERROR)
    out = []
    for part in regex.findall(r"\[[^\]]*\]|[^\[]+", notice):
        # A number or name must be whole words; the blank beside it belongs to it.
        exact = regex.escape(part[1:-1], literal_spaces=True)
        out.append(f"(?<![^ ]){exact}(?![^ ])" if part[0] == "[" else f"(?:{regex.escape(part, literal_spaces=True)}){{e<={errors}}}")
    return notice.replace("[", "").replace("]", ""), errors, "(?b)" + "".join(out)


class _Covered:
    """Stretches that don't overlap, for asking whether one is touched in logarithmic time."""

    def __init__(self):
        self.starts, self.ends = [], []

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start

    def add(self, spans: list[tuple[int, int]]) -> None:
        merged: list[list[int]] = []
        for a, b in sorted([*zip(self.starts, self.ends, strict=True), *spans]):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        self.starts, self.ends = [a for a, _ in merged], [b for _, b in merged]


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices, self.parts = [], ahocorasick.Automaton()
        for n, (spelled, label) in enumerate(notices.items()):
            notice, errors, pattern = notice_pattern(spelled)
            self.notices.append((len(notice), label, errors, regex.compile(pattern)))
            cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.parts.add_word(notice[a:b], [*self.parts.get(notice[a:b], []), (n, a, b - a)])
        if notices:
            self.parts.make_automaton()

    def _windows(self, text: str) -> dict[int, set[tuple[int, int]]]:
        """Where each notice may stand: a stretch of text for each of its parts that is found."""
        out: dict[int, set[tuple[int, int]]] = {}
        for last, found in self.parts.iter(text) if self.notices else ():
            for n, at, size in found:
                length, _, errors, _ = self.notices[n]
                start = last + 1 - size - at
                end = text.find(" ", start + length + errors)  # whole words, so that an exact one ends where a word does
                out.setdefault(n, set()).add((max(0, start - errors), len(text) if end < 0 else end))
        return out

    def _matches(self, text: str, n: int, windows: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, errors) of the notice's matches in the windows, those with fewer errors first; none overlap."""
        length, _, errors, pattern = self.notices[n]
        queue, kept, taken = [], [], []

        def push(a: int, b: int) -> None:
            if b - a >= length - errors and (m := pattern.search(text, a, b)) and sum(m.fuzzy_counts) <= errors:
                heapq.heappush(queue, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for window in windows:
            push(*window)
        seen = set(windows)
        while queue:
            found, start, end, a, b = heapq.heappop(queue)
            # Taken spans are apart, so the last one that starts before this match's end is the one that may overlap.
            k = bisect_left(taken, (end,)) - 1
            clash = taken[k] if k >= 0 and taken[k][1] > start else None
            if not clash:
                kept.append((start, end, found))
                insort(taken, (start, end))
            first, after = clash or (start, end)
            for piece in ((a, min(b, first)), (max(a, after), b)):
                if piece not in seen:
                    seen.add(piece)
                    push(*piece)
        return kept

    def __call__(self, text: str | None) -> tuple:
        own = words(text)
        folded = b" " + b" ".join(own) + b" "
        begins = list(accumulate((len(w) + 1 for w in own), initial=0))  # of words, in bytes after the first blank
        places, base = [], set()
        for phrase, label in self.phrases:
            at = folded.find(phrase)
            while at >= 0:
                places.append(bisect_left(begins, at))
                base.add(label)
                at = folded.find(phrase, at + 1)
        spans = []
        plain = folded[1:-1].decode("utf-8", "surrogatepass")
        windows = self._windows(plain)
        starts = list(accumulate((len(w) + 1 for w in plain.split(" ")), initial=0)) if windows else []  # of words, in characters
        for n, stretches in windows.items():
            length, label, _, _ = self.notices[n]
            for start, end, errors in self._matches(plain, n, stretches):
                spans.append({"share": errors / length, "start": bisect_right(starts, start) - 1, "end": bisect_left(starts, end), "label": label, "errors": errors})
        # Of notices that match one stretch, those with the fewest errors stand; one that fell takes no other with it.
        spans.sort(key=lambda x: x["errors"])
        covered, kept = _Covered(), []
        for _, same in groupby(spans, key=lambda x: x["errors"]):
            kept += (new := [x for x in same if not covered.touches(x["start"], x["end"])])
            covered.add([(x["start"], x["end"]) for x in new])
        spans = sorted(kept, key=lambda x: (x["start"], x["end"], x["label"]))
        shares = [x.pop("share") for x in spans]
        score = 1.0 if places else 1 - min(shares, default=1.0)
        labels = sorted(base | {x["label"] for x in spans})
        return len(own), len(places), min(places, default=None), max(places, default=None), sorted(base), labels, score, spans


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, into: str = "license") -> DataFrame:
    """docs with a struct column: see RESULT. Words and spans count from 0, spans end before `end`.

    Null and empty texts have no words, places or labels and score 0; the score is 1 where a phrase stands, else that
    of the best notice: 1 less its errors' share of its characters. A very long text is searched whole, in time that
    grows with its length and its matches. Repeated rows get the same result; an empty table gives an empty one. A column
    named `into` is replaced.
    """
    small_batches(docs.sparkSession)
    held = (PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    cache: list[Scanner] = []

    @F.pandas_udf(RESULT)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not cache:
            cache.append(Scanner(*held))
        for batch in texts:
            out = pd.DataFrame([cache[0](t) for t in batch], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn(into, run(F.col("text")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")
    return out.withColumn("base_labels", F.concat_ws(",", "base_labels")).withColumn("labels", F.concat_ws(",", "labels")).withColumn("n_notices", F.size("spans")).drop("spans")
