"""Narrative views of passages, scene windows with their entities, and the expansion of queries; dictionaries are parameters."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folio.functions.text import tokens, words
from folio.operators.chunking import SCENE_OVERLAP, SCENE_WORDS, scene_windows

#: Sentences of a view; entities of a view and of a scene window; words in which a window's entities are looked for.
SENTENCES, ENTITIES, WINDOW_ENTITIES, SCOPE = 6, 12, 8, 1200
#: Where a sentence ends, and what speech and names look like.
SENTENCE = r"""(?<=[.!?])(?U)\s+(?-U)(?=[A-Z"'])|(?<=[.!?]["')\]])(?U)\s+(?-U)(?=[A-Z"'])"""
SPEECH = r'"([^"\n]{3,})"'
TITLES = ("Ser", "Lord", "Lady", "King", "Queen")
NAME = re.compile(r"\b(?:(?:Grand\s+)?(?:Maester|Ser|Lord|Lady|King|Queen|Prince|Princess|Septa|Khal)\s+)?[A-Z][a-z]+(?:\s+(?:of|the|[A-Z][a-z]+)){0,3}\b")
#: Capitalised words that are no names.
NO_NAMES = frozenset("A An And As At But For He Her His I If In It My No Not She So That The Then There They This We When With You".split())
#: Words of roles and of events.
ROLES = tuple(
    "assassin bastard boy brother captive child commander daughter dragon dwarf father fool girl guard heir king knight lord maester mother priestess prince princess prisoner queen ranger sailor singer sister smuggler soldier squire ward watchman widow wolf".split()
)
EVENTS = tuple(
    "admitted attacked beat betrayed burned captured confessed died escaped fell fled fought gave killed kissed murdered offered ordered promised pushed refused released rescued returned rode said saw seized sent slew stabbed stole struck told watched wounded".split()
)


def single_spaced(text: Column) -> Column:
    return F.array_join(words(text), " ")


def sentences(text: Column) -> Column:
    """Sentences in order: cut where an end sign is followed by a blank and a capital or quote."""
    return F.filter(F.transform(F.split(single_spaced(text), SENTENCE), F.trim), lambda s: s != "")


def dialogue(text: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPEECH), 1), single_spaced), " Dialogue: ")


def names(text: str | None, most: int = ENTITIES) -> list[str]:
    """Names by first place: those that stand twice, have several words or are a title."""
    seen: dict[str, int] = {}
    for m in NAME.finditer(text or ""):
        value = " ".join(m[0].split())
        if value not in NO_NAMES:
            seen[value] = seen.get(value, 0) + 1
    return [v for v, n in seen.items() if n > 1 or " " in v or v in TITLES][:most]


@F.pandas_udf(ArrayType(StringType()))
def entities(texts: pd.Series) -> pd.Series:
    return texts.map(names)


def event_sentences(found: Column, most: int = 3) -> Column:
    """The sentences that tell most: three for each event word, one for each role and for speech; first places win ties."""
    count = lambda t, known: F.size(F.array_intersect(t, F.array(*map(F.lit, known))))
    scored = F.transform(found, lambda s, k: F.struct((-(3 * count(tokens(s), EVENTS) + count(tokens(s), ROLES) + F.when(F.contains(s, F.lit('"')), 1).otherwise(0))).alias("score"), k.alias("k"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["score"] < 0)), 1, most), lambda x: x["s"])


def narrative_views(chunks: DataFrame, book_title: str = "book", chapter_title: str = "doc_id") -> DataFrame:
    """doc_id, ordinal, context, summary, dialogue, events, entities, sentences of each chunk (pov, text, and the columns that name book and chapter)."""
    t = F.col("text")
    own = chunks.withColumn("__s", sentences(t)).withColumn("__n", entities(t)).withColumn("__e", event_sentences(F.col("__s")))
    roles = F.array_sort(F.array_intersect(F.array_distinct(tokens(t)), F.array(*map(F.lit, ROLES))))
    named = F.when(F.size("__n") > 0, F.concat(F.lit("Named characters and places: "), F.array_join("__n", ", ")))
    parts = F.concat_ws(". ", named, F.when(F.size(roles) > 0, F.concat(F.lit("Narrative roles: "), F.array_join(roles, ", "))))
    about = _about(F.col(book_title), F.col(chapter_title), F.col("pov"))
    context = F.concat(about, F.when(parts != "", F.concat(F.lit(" "), parts, F.lit("."))).otherwise(""), F.lit(" Passage: "), t)
    second = F.slice(F.filter("__e", lambda e: e != F.try_element_at("__s", F.lit(1))), 1, 1)
    return own.select("doc_id", "ordinal", context.alias("context"), F.array_join(F.concat(F.slice("__s", 1, 1), second), " ").alias("summary"), dialogue(t).alias("dialogue"), F.array_join("__e", " ").alias("events"), parts.alias("entities"), F.slice("__s", 1, SENTENCES).alias("sentences"))


def _about(book: Column, chapter: Column, pov: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("Book: "), text(book), F.lit(". Chapter: "), text(chapter), F.lit(". Point of view: "), text(pov), F.lit("."))


def lexical_text() -> Column:
    """All views of a passage in one text."""
    return F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("context", "summary", "dialogue", "events", "entities")])


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text between word boundaries, whatever its case."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower(phrase), F.lit(r"\E(?!\w)"))
    return F.regexp_like(F.lower(text), quoted)


def expanded_by_phrases(queries: DataFrame, expansions: Sequence[tuple[str, str]]) -> DataFrame:
    """queries, each followed by the expansions whose phrase is part of it, in the given order, unless it holds the expansion."""
    own = single_spaced(F.col("query"))
    more = [F.when(F.contains(F.lower(own), F.lit(p.lower())) & ~F.contains(F.lower(own), F.lit(e.lower())), F.lit(e)) for p, e in expansions]
    return queries.withColumn("query", F.concat_ws(" ", own, *more))


def expanded_by_aliases(queries: DataFrame, groups: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """queries, each followed by all names of the groups of which it holds one as words."""
    own, more = single_spaced(F.col("query")), []
    for name, aliases in groups:
        terms = list(dict.fromkeys((name, *aliases)))
        some = F.exists(F.array(*map(F.lit, terms)), lambda x: holds_phrase(own, x))
        more.append(F.when(some & ~F.contains(F.lower(own), F.lit(" ".join(terms).lower())), F.lit(" ".join(terms))))
    return queries.withColumn("query", F.concat_ws(" ", own, *more))


def identities(text: Column, groups: Sequence[tuple[str, Sequence[str]]], most: int = ENTITIES) -> Column:
    """Names of the groups of which the text holds a name or alias, in the groups' order."""
    found = [F.when(F.exists(F.array(*map(F.lit, (name, *aliases))), lambda x: holds_phrase(text, x)), F.lit(name)) for name, aliases in groups]
    return F.slice(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), 1, most)


def scope(start: Column, end: Column, n: Column, size: int = SCOPE) -> tuple[Column, Column]:
    """start and end of `size` words around a window, kept within the chapter's n words."""
    first = F.greatest(F.lit(0), start - F.floor(F.greatest(F.lit(0), size - (end - start)) / 2).cast("int"))
    last = F.least(n, first + size)
    return F.greatest(F.lit(0), last - size), last


def scenes(docs: DataFrame, groups: Sequence[tuple[str, Sequence[str]]] = (), size: int = SCENE_WORDS, overlap: int = SCENE_OVERLAP, around: int = SCOPE) -> DataFrame:
    """scene_windows with book, pov, text, entities and aliases of the words around each, and scene_text, which is embedded and searched."""
    if size < 100 or not 0 <= overlap < size or around < size:
        raise ValueError("a scene window has 100 words or more, overlaps by fewer than it has, and its scope is as wide at least")
    own = scene_windows(docs, size, overlap).join(docs.select("doc_id", "book", "pov", words(F.col("text")).alias("w")), "doc_id")
    a, b = scope(F.col("word_start"), F.col("word_end"), F.size("w"), around)
    own = own.withColumn("near", F.array_join(F.slice("w", a + 1, b - a), " ")).withColumn("text", F.array_join(F.slice("w", F.col("word_start") + 1, F.col("word_end") - F.col("word_start")), " "))
    own = own.withColumn("entities", F.slice(entities(F.col("near")), 1, WINDOW_ENTITIES)).withColumn("aliases", F.slice(identities(F.col("near"), groups), 1, WINDOW_ENTITIES))
    return own.withColumn("scene_text", scene_text()).drop("w", "near")


def scene_texts(docs: DataFrame, size: int = SCENE_WORDS, overlap: int = SCENE_OVERLAP) -> DataFrame:
    """scene_windows with their text alone: doc_id, ordinal, word_start, word_end, text."""
    w = docs.select("doc_id", F.explode(F.array(words(F.col("text")))).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    starts = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda s: s < last), F.array(last)))
    each = w.select("doc_id", "w", F.posexplode(starts).alias("k", "word_start")).withColumn("word_end", F.least(F.col("word_start") + size, F.size("w")))
    return each.select("doc_id", (F.col("k") + 1).alias("ordinal"), "word_start", "word_end", F.array_join(F.slice("w", F.col("word_start") + 1, F.col("word_end") - F.col("word_start")), " ").alias("text"))


def scene_text() -> Column:
    more = [F.when(F.size(c) > 0, F.concat(F.lit(say), F.array_join(c, ", "), F.lit("."))) for c, say in (("entities", "Entities in surrounding scene: "), ("aliases", "Canonical character identities: "))]
    return F.concat(F.concat_ws(" ", _about(F.col("book"), F.col("doc_id"), F.col("pov")), *more), F.lit(" Scene passage: "), F.col("text"))


#: Capitalised words of a query that name nobody.
GENERIC = ("a", "an", "and", "hand", "king", "kingsguard", "lord", "night", "queen", "red", "the", "wall", "watch")


def query_names(query: Column) -> Column:
    """Capitalised words of a query, in lower case, without the generic ones."""
    found = F.transform(F.regexp_extract_all(query, F.lit(r"\b[A-Z][A-Za-z'-]+\b"), 0), F.lower)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*GENERIC)))


def holds_name(text: Column, wanted: Column) -> Column:
    return F.arrays_overlap(F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z'-]+\b"), 0), F.lower), wanted)


def roman(n: Column) -> Column:
    """Roman numerals to 399."""
    digits = [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "C", "CC", "CCC"]]
    of = lambda place: F.array(*map(F.lit, digits[place]))[(F.floor(n / 10**place) % 10).cast("int")]
    return F.concat(of(2), of(1), of(0))


def chapter_ids(chapters: DataFrame) -> DataFrame:
    """chapters (book, sequence, pov) with pov_ordinal, chapter_id and chapter_title."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("book", "pov").orderBy("sequence"))
    out = chapters.withColumn("pov_ordinal", nth)
    slug = F.trim(F.regexp_replace(F.lower("pov"), "[^a-z0-9]+", "-"), F.lit("-"))
    tail = F.when(F.col("pov") == "PROLOGUE", "prologue").otherwise(F.concat(slug, F.lit("-"), F.col("pov_ordinal").cast("string")))
    title = F.when(F.col("pov").isin("PROLOGUE", "EPILOGUE"), F.col("pov")).otherwise(F.concat("pov", F.lit(" "), roman(F.col("pov_ordinal"))))
    return out.withColumns({"chapter_id": F.concat_ws("-", "book", F.lpad(F.col("sequence").cast("string"), 3, "0"), tail), "chapter_title": title})
