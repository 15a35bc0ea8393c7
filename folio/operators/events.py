"""Who did what: event records by rules, and how well they answer a query. The parser is a seam; the one here has no grammar.

It takes an action word, the name before it as subject and the name after it as object, so its records are not those of a
dependency parser; records have the same columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.narrative import ENTITIES, NO_NAMES, sentences

#: Weights of entities, action, direction and assertion; what a recalled event keeps; of words and structure.
ENTITY, ACTION, DIRECTION, ASSERTION, RECALLED = 0.45, 0.35, 0.15, 0.05, 0.85
LEXICAL, STRUCTURE = 0.40, 0.60
#: Events of a window at most.
MOST = 40
#: Words by which a sentence denies, supposes or remembers.
NEGATIONS = frozenset("no not never neither nor".split())
MODALS = frozenset("could may might must shall should would if".split())
RECALLS = frozenset("recalled remembered remembers dreamed dreamt thought told".split())
#: Actions by group; a word of several groups belongs to the last. An input, like all dictionaries.
ACTIONS: dict[str, tuple[str, ...]] = {
    "kill": ("kill", "killed", "murder", "murdered", "slay", "slew", "slain"), "attack": ("attack", "attacked", "fight", "fought", "strike", "struck", "stab", "stabbed"),
    "flee": ("flee", "fled", "escape", "escaped"), "command": ("command", "commanded", "order", "ordered", "warn", "warned"), "capture": ("capture", "captured", "seize", "seized", "take", "took", "taken"),
    "rescue": ("rescue", "rescued", "save", "saved"), "give": ("give", "gave", "offer", "offered", "send", "sent"), "say": ("say", "said", "tell", "told"),
}
RECORD = "array<struct<sentence_index:int,sentence:string,subject:string,action:string,action_lemma:string,object:string,negated:boolean,hypothetical:boolean,recalled:boolean,passive:boolean,confidence:string>>"
_NAME = re.compile(r"[A-Z][a-z]+(?:\s[A-Z][a-z]+)*")
_WORD = re.compile(r"[A-Za-z']+")


def action_groups(groups: Mapping[str, tuple[str, ...]] = ACTIONS) -> dict[str, str]:
    """Word to group, the last group winning."""
    return {w: g for g, own in groups.items() for w in own}


def _names(text: str) -> list[str]:
    return [n.lower() for n in _NAME.findall(text) if n not in NO_NAMES]


def parsed(text: str, groups: dict[str, str]) -> list[dict]:
    """The events of a sentence, one for each action word."""
    terms = {w.lower() for w in _WORD.findall(text)}
    out = []
    for m in _WORD.finditer(text):
        if (action := groups.get(m[0].lower())) is None:
            continue
        before, after = _names(text[: m.start()]), _names(text[m.end() :])
        passive = bool(re.search(r"\b(?:was|were|been|is|are)\s+$", text[: m.start()])) and " by " in text[m.end() :]
        subject, object_ = (before[-1] if before else None), (after[0] if after else None)
        if passive:
            subject, object_ = object_, subject
        confidence = "high" if subject and object_ else "medium" if subject or object_ else "low"
        out.append({"subject": subject, "action": action, "action_lemma": m[0].lower(), "object": object_, "negated": bool(terms & NEGATIONS), "hypothetical": bool(terms & MODALS), "recalled": bool(terms & RECALLS), "passive": passive, "confidence": confidence})
    return out


def event_records(scenes: DataFrame, groups: Mapping[str, tuple[str, ...]] = ACTIONS, parse=parsed) -> DataFrame:
    """doc_id, window (its ordinal), chronology_word, context_entities and the record of each event of the scenes (see narrative.scenes), MOST a window."""
    known = action_groups(groups)

    @F.pandas_udf(RECORD)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda own: [{"sentence_index": k, "sentence": s, **e} for k, s in enumerate(own) for e in parse(s, known)][:MOST])

    context = F.slice(F.array_distinct(F.transform(F.concat("aliases", "entities"), F.lower)), 1, ENTITIES)
    return scenes.select("doc_id", F.col("ordinal").alias("window"), F.col("word_start").alias("chronology_word"), context.alias("context_entities"), F.inline(run(sentences(F.col("text")))))


def uncovered_windows(scenes: DataFrame, events: DataFrame) -> DataFrame:
    """doc_id, window of scenes without an event."""
    return scenes.select("doc_id", F.col("ordinal").alias("window")).join(events.select("doc_id", "window").distinct(), ["doc_id", "window"], "left_anti")


def event_text() -> Column:
    """All that can be searched of a record, in one text."""
    flags = [F.when(F.col(c), F.lit(c)) for c in ("negated", "hypothetical", "recalled", "passive")]
    return F.concat_ws(" ", "subject", "action", "action_lemma", "object", F.array_join("context_entities", " "), *flags, "sentence")


def signatures(queries: DataFrame, groups: Mapping[str, tuple[str, ...]] = ACTIONS, parse=parsed) -> DataFrame:
    """item_id, entities, actions, subject, object, hypothetical, negated of each query."""
    known = action_groups(groups)

    @F.pandas_udf("struct<entities:array<string>,actions:array<string>,subject:string,object:string,hypothetical:boolean,negated:boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found, terms = parse(text or "", known), {w.lower() for w in _WORD.findall(text or "")}
            first = found[0] if found else {}
            rows.append((sorted(set(_names(text or ""))), sorted({e["action"] for e in found}), first.get("subject"), first.get("object"), bool(terms & MODALS), bool(terms & NEGATIONS)))
        return pd.DataFrame(rows, columns=["entities", "actions", "subject", "object", "hypothetical", "negated"])

    return queries.withColumn("__s", run("query")).select("item_id", "__s.*")


def structured_scores(events: DataFrame, asked: DataFrame) -> DataFrame:
    """item_id, event, score of each record (event, context_entities, subject, object, action, flags) for each signature; a stated set against all records.

    Weights of what the query doesn't say are left out and the others made up to one.
    """
    q = asked.select("item_id", *[F.col(c).alias(f"q_{c}") for c in ("entities", "actions", "subject", "object", "hypothetical", "negated")])
    both = events.join(F.broadcast(q) if q.limit(10_001).count() <= 10_000 else q, F.lit(True))
    own = F.array_distinct(F.transform(F.array_compact(F.concat("context_entities", F.array("subject", "object"))), F.lower))
    same = lambda a, b: F.when(F.coalesce(F.lower(a) == F.lower(b), F.lit(False)), 1.0).otherwise(0.0)
    has_e, has_a, has_s, has_o = F.size("q_entities") > 0, F.size("q_actions") > 0, F.col("q_subject").isNotNull(), F.col("q_object").isNotNull()
    entity = F.size(F.array_intersect("q_entities", own)) / F.size("q_entities")
    action = F.when(F.array_contains("q_actions", F.col("action")), 1.0).otherwise(0.0)
    sides = F.when(has_s, 1).otherwise(0) + F.when(has_o, 1).otherwise(0)
    direction = (F.when(has_s, same(F.col("q_subject"), F.col("subject"))).otherwise(0.0) + F.when(has_o, same(F.col("q_object"), F.col("object"))).otherwise(0.0)) / sides
    assertion = F.when((F.col("q_hypothetical") == F.col("hypothetical")) & (F.col("q_negated") == F.col("negated")), 1.0).otherwise(0.0)
    parts = [(has_e, ENTITY, entity), (has_a, ACTION, action), (has_s | has_o, DIRECTION, direction), (F.lit(True), ASSERTION, assertion)]
    total = sum((F.when(has, w).otherwise(0.0) for has, w, _ in parts), F.lit(0.0))
    score = sum((F.when(has, w * x).otherwise(0.0) for has, w, x in parts), F.lit(0.0)) / total
    return both.select("item_id", "event", (score * F.when(F.col("recalled") & ~F.col("q_hypothetical"), RECALLED).otherwise(1.0)).alias("score"))


def event_scores(lexical: DataFrame, structured: DataFrame) -> DataFrame:
    """item_id, event, score: words (BM25 against the query's best) and structure together."""
    most = lexical.groupBy("item_id").agg(F.max("score").alias("most"))
    shares = lexical.join(most, "item_id").select("item_id", "event", F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(0.0).alias("share"))
    out = structured.join(shares, ["item_id", "event"], "left")
    return out.select("item_id", "event", (LEXICAL * F.coalesce("share", F.lit(0.0)) + STRUCTURE * F.col("score")).alias("score"))
