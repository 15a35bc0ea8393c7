"""What of a passage is shown: the best span of a query, a preview around it, and fragments of what stands beside it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import FOLDS, STOPWORDS, TOKEN, words

#: Words shown beside a preview; characters of a preview.
CONTEXT_WORDS, EXCERPT_CHARS = 28, 360
_TOKEN = re.compile(TOKEN)
_WORD = re.compile(r"\S+")
PREVIEW = "struct<text:string,word_start:int,word_end:int,before:string,after:string>"


def _folded(text: str) -> tuple[str, list[int]]:
    """Lower-case text, and for each of its characters the place in the original: offsets stay true where folding adds letters."""
    out, at = [], []
    for k, c in enumerate(text):
        for x in FOLDS.get(low := c.lower(), low):
            out.append(x)
            at.append(k)
    return "".join(out), at


def _located(text: str) -> list[tuple[str, int, int]]:
    """Tokens with start and end in the original text; a final 's is part of the span."""
    folded, at = _folded(text)
    return [(m[1], at[m.start()], at[m.end() - 1] + 1) for m in _TOKEN.finditer(folded)]


def best_span(text: str, query: str) -> tuple[int, int] | None:
    """Start and end (characters) of the query's whole phrase, or else of the shortest stretch with all its terms that the text has."""
    asked = [t for t, _, _ in _located(query)]
    own = _located(text)
    names = [t for t, _, _ in own]
    for i in range(len(own) - len(asked) + 1 if asked else 0):
        if names[i] == asked[0] and names[i : i + len(asked)] == asked:
            return own[i][1], own[i + len(asked) - 1][2]
    wanted = set(asked) - set(STOPWORDS)
    hits = [x for x in own if x[0] in wanted]
    found = {x[0] for x in hits}
    last: dict[str, int] = {}
    best = None
    for term, start, end in hits:
        last[term] = start
        if len(last) == len(found):
            first = min(last.values())
            if best is None or end - first < best[1] - best[0]:
                best = first, end
    return best


def preview(text: str | None, query: str | None, word_start: int = 0, chars: int = EXCERPT_CHARS) -> dict | None:
    """Whole words around the best span, or the text's middle, grown towards the side with less room; None without words."""
    spans = [m.span() for m in _WORD.finditer(text or "")]
    if not spans:
        return None
    found = best_span(text, query or "")
    a, b = found or (len(text) // 2, len(text) // 2)

    def nearest(among: range, to: int) -> int:
        return min(among, key=lambda k: abs((spans[k][0] + spans[k][1]) // 2 - to))

    if found:
        low = next(k for k, s in enumerate(spans) if s[1] > a)
        high = 1 + max(k for k, s in enumerate(spans) if s[0] < b)
    if not found or spans[high - 1][1] - spans[low][0] > chars:
        low = nearest(range(low, high), (a + b) // 2) if found else nearest(range(len(spans)), a)
        high = low + 1
    while True:
        left = low > 0 and spans[high - 1][1] - spans[low - 1][0] <= chars
        right = high < len(spans) and spans[high][1] - spans[low][0] <= chars
        if not left and not right:
            break
        # The side that shows less of the text beside the span grows; the left one on ties.
        if left and (not right or max(0, a - spans[low][0]) <= max(0, spans[high - 1][1] - b)):
            low -= 1
        else:
            high += 1
    own = text.split()
    beside = [" ".join(own[max(0, low - CONTEXT_WORDS) : low]) or None, " ".join(own[high : high + CONTEXT_WORDS]) or None]
    return {"text": text[spans[low][0] : spans[high - 1][1]], "word_start": word_start + low, "word_end": word_start + high, "before": beside[0], "after": beside[1]}


def with_preview(results: DataFrame, chars: int = EXCERPT_CHARS, into: str = "preview") -> DataFrame:
    """results (text, query, word_start) with a preview struct; null where the text has no words."""

    @F.pandas_udf(PREVIEW)
    def run(text: pd.Series, query: pd.Series, start: pd.Series) -> pd.DataFrame:
        rows = [preview(t, q, s, chars) for t, q, s in zip(text, query, start, strict=True)]
        out = pd.DataFrame([r or dict.fromkeys(("text", "word_start", "word_end", "before", "after")) for r in rows], columns=["text", "word_start", "word_end", "before", "after"])
        return out.astype({"word_start": "Int32", "word_end": "Int32"})

    made = results.withColumn(into, run("text", "query", F.col("word_start").cast("int")))
    return made.withColumn(into, F.when(F.col(f"{into}.text").isNotNull(), F.col(into)))


def focus_end(text: Column, word_start: Column, chars: int = EXCERPT_CHARS) -> Column:
    """The word at which an excerpt of so many characters from the passage's start ends; one word at least."""
    lengths = F.transform(words(text), F.length)
    fold = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open")),
        lambda s, x: F.when(s["open"] & ((s["n"] == 0) | (s["size"] + x + 1 <= chars)), F.struct((s["n"] + 1).alias("n"), (s["size"] + x + F.when(s["n"] > 0, 1).otherwise(0)).alias("size"), F.lit(True).alias("open"))).otherwise(F.struct(s["n"].alias("n"), s["size"].alias("size"), F.lit(False).alias("open"))),
    )
    return word_start + F.greatest(F.lit(1), fold["n"])


def neighbour_fragments(chunks: DataFrame) -> DataFrame:
    """doc_id, ordinal, before, after: words of the chunks beside it that it doesn't hold itself, CONTEXT_WORDS at most; null without any."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    own = chunks.select("doc_id", "ordinal", "word_start", "word_end", words(F.col("text")).alias("w"))
    side = F.struct("ordinal", "word_start", "word_end", "w")
    both = own.withColumns({"p": F.lag(side).over(w), "n": F.lead(side).over(w)})
    p, n = (F.when(F.col(f"{x}.ordinal") == F.col("ordinal") + step, F.col(x)) for x, step in (("p", -1), ("n", 1)))
    before = F.slice(p["w"], 1, F.greatest(F.lit(0), F.least("word_start", p["word_end"]) - p["word_start"]))
    after = F.slice(n["w"], F.greatest(F.col("word_end"), n["word_start"]) - n["word_start"] + 1, F.greatest(F.lit(0), n["word_end"] - F.greatest("word_end", n["word_start"])))
    last = F.slice(before, F.greatest(F.lit(1), F.size(before) - CONTEXT_WORDS + 1), CONTEXT_WORDS)
    text = lambda x: F.when(F.size(x) > 0, F.array_join(x, " "))
    return both.select("doc_id", "ordinal", text(last).alias("before"), text(F.slice(after, 1, CONTEXT_WORDS)).alias("after"))


def paragraph_fragments(focus: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """focus' columns, ordinal, partial_start, partial_end, fragments (array of region, text) of the paragraphs around the focus.

    focus: doc_id, focus_start, focus_end and what tells rows apart; paragraphs: doc_id, ordinal, word_start, word_end, text.
    Regions are before, focus and after; CONTEXT_WORDS stand on either side.
    """
    own = focus.withColumn("a", F.greatest(F.lit(0), F.col("focus_start") - CONTEXT_WORDS)).withColumn("b", F.col("focus_end") + CONTEXT_WORDS)
    near = own.join(paragraphs, "doc_id").where((F.col("word_start") < F.col("b")) & (F.col("a") < F.col("word_end")))
    start, end = F.greatest("a", "word_start"), F.least("b", "word_end")
    cut = lambda x: F.greatest(start, F.least(end, F.col(x)))
    w = words(F.col("text"))

    def part(region: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(region).alias("region"), F.array_join(F.slice(w, a - F.col("word_start") + 1, F.greatest(F.lit(0), b - a)), " ").alias("text"))

    parts = F.filter(F.array(part("before", start, cut("focus_start")), part("focus", cut("focus_start"), cut("focus_end")), part("after", cut("focus_end"), end)), lambda x: x["text"] != "")
    return near.select(*focus.columns, "ordinal", (start > F.col("word_start")).alias("partial_start"), (end < F.col("word_end")).alias("partial_end"), parts.alias("fragments"))


def located(docs: DataFrame, phrase: str, beside: int = 35) -> DataFrame:
    """doc_id, word_start, context of the first place of a phrase in each text, whatever its case. Offsets count words."""
    at = F.locate(phrase.lower(), F.lower("text"))
    own = docs.select("doc_id", "text", at.alias("at")).where("at > 0")
    before = F.size(words(F.substring(F.col("text"), F.lit(1), F.col("at") - 1)))
    # A phrase that starts within a word belongs to that word.
    inside = F.when((F.col("at") > 1) & ~F.substring(F.col("text"), F.col("at") - 1, F.lit(1)).rlike(r"(?U)\s"), 1).otherwise(0)
    own = own.withColumn("word_start", before - inside).withColumn("w", words(F.col("text")))
    first = F.greatest(F.lit(0), F.col("word_start") - beside)
    return own.select("doc_id", "word_start", F.array_join(F.slice("w", first + 1, F.col("word_start") - first + beside + len(phrase.split())), " ").alias("context"))
