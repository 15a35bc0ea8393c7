"""Search over passages, views, previews, events, evaluation and training data on small tables made by hand."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions.text import tokens
from folio.operators import chunking, evaluation, events, evidence, lexical, models, narrative, preview, search, training
from folio.operators.search import Options

CHUNKS = "pos long, doc_id long, ordinal int, word_start int, word_end int, book string, pov string, text string, embedding array<double>"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def in_order(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("rank").collect()]


def unit(*x):
    n = math.sqrt(sum(v * v for v in x))
    return [v / n for v in x]


@pytest.fixture(scope="module")
def chunks(spark):
    """Two chapters of overlapping passages and one of another book; the query is near (1, 0)."""
    texts = ["the grey ship sailed at dawn", "sailed at dawn past the quiet harbour", "a lamp in the tower", "bread and salt on the table", "the harbour was quiet at noon", "no ship at all", "snow on the tower roof"]
    place = [(1, 1, 0, 10), (1, 2, 8, 18), (1, 3, 18, 28), (2, 1, 0, 10), (2, 2, 10, 20), (3, 1, 0, 10), (3, 2, 10, 20)]
    angle = [0.9, 0.8, 0.1, 0.95, 0.2, 0.5, 0.0]
    data = [(k, d, o, s, e, "one" if d < 3 else "two", "ANA" if d != 2 else "BEN", t, unit(a, 1 - a)) for k, ((d, o, s, e), t, a) in enumerate(zip(place, texts, angle, strict=True))]
    return spark.createDataFrame(data, CHUNKS)


@pytest.fixture(scope="module")
def query(spark):
    return spark.createDataFrame([(7, "quiet  harbour ", [1.0, 0.0])], "item_id long, query string, q array<double>")


def test_folds_and_stop_words(spark):
    df = spark.createDataFrame([(0, "ſee ŉever ǰoin ẖ ẗe ẘ ẙ ẚ THE Queen’s ﬁre")], "doc_id long, text string")
    assert df.select(tokens(F.col("text"))).first()[0] == ["see", "never", "j", "oin", "h", "t", "e", "w", "y", "a", "the", "queen", "fire"]
    docs = spark.createDataFrame([(1, "harbour"), (2, "they before harbour")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "they went before her into harbour"), (2, "or harbour")], "item_id long, query string")
    assert rows(lexical.contains_all(docs, q.where("item_id = 2")), "doc_id") == []
    assert rows(lexical.contains_all(docs, spark.createDataFrame([(1, "they before her harbour")], "item_id long, query string")), "doc_id") == [(1,), (2,)]


def test_stored_lexicon_gives_the_same(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices("abcde", k=9))) for i in range(30)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b c"), (2, "e e d")], "item_id long, query string")
    words = lexical.lexicon(docs).stored()
    for run in (lexical.bm25, lexical.exact_phrases, lexical.contains_all, evidence.evidence):
        rounded = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in run(d, q).collect()) for d in (docs, words)]
        assert rounded[0] == rounded[1] and rounded[0]


def test_semantic_leaves_out_overlap(chunks, query):
    assert in_order(search.search(chunks, query), "pos") == [(3,), (0,), (5,), (4,), (2,), (6,)]
    assert in_order(search.search(chunks, query, options=Options(one_per_chapter=True)), "pos") == [(3,), (0,), (5,)]
    assert in_order(search.search(chunks, query, book="TWO"), "pos") == [(5,), (6,)]
    assert in_order(search.search(chunks, query, povs=["ben"]), "pos") == [(3,), (4,)]


def test_filters_and_modes_are_checked(spark, chunks, query):
    for kind in ({"povs": "zoe"}, {"povs": []}, {"book": "three"}, {"mode": "dense"}, {"hierarchical": True}, {"mode": "lexical", "options": Options(event_weight=0.1)}, {"mode": "hybrid", "hierarchical": True, "options": Options(one_per_chapter=True)}):
        with pytest.raises(ValueError):
            search.search(chunks, query, **kind)
    for wrong in ({"top": 0}, {"top": 101}, {"semantic_weight": 1.1}, {"chapter_candidates": 0}, {"passage_pool": 5}, {"retention": "all"}, {"chapter_weight": -1.0}, {"rerank_words": 501}):
        with pytest.raises(ValueError):
            Options(**wrong)
    with pytest.raises(Exception, match="must not be empty"):
        search.normalised(spark.createDataFrame([(1, " \t")], "item_id long, query string")).collect()


def test_hybrid_lifts_exact_phrases(chunks, query):
    got = search.hybrid_search(chunks, query, Options(top=3)).orderBy("rank").collect()
    assert (got[0].pos, got[0].exact, got[0].semantic_rank, got[0].lexical_rank) == (1, True, 3, 1)
    assert got[0].score > 1 and [r.pos for r in got[1:]] == [4, 3]
    assert got[1].lexical_rank == 2 and got[2].lexical_rank is None


def test_hybrid_adds_weights(chunks, query):
    ranked = {r.pos: r for r in search.hybrid_search(chunks, query, Options(top=10, evidence_weight=0.4)).collect()}
    r = ranked[4]
    assert r.evidence_rank == 2 and r.score == pytest.approx(0.5 / (60 + r.semantic_rank) + 0.5 / (60 + r.lexical_rank) + 0.4 / (60 + r.evidence_rank))


def test_hierarchy(chunks, query):
    run = search.hierarchical_search(chunks, query, Options(chapter_candidates=2, passage_pool=5))
    assert rows(run.chapters, "chapter_rank", "doc_id")[0] == (1, 1)  # the exact phrase's chapter
    got = run.results.orderBy("rank").collect()
    first = got[0]
    assert (first.pos, first.exact, first.chapter_rank, first.within_rank, first.context_start, first.context_end) == (1, True, 1, 1, 0, 28)
    assert {p for (p,) in rows(run.candidates, "pos")} >= {p for (p,) in rows(run.retained, "pos")}
    assert 0 not in {r.pos for r in got}  # overlaps the exact one
    local = {r.pos: r for r in got}
    assert first.agreement_score == pytest.approx(1 / (60 + max(first.semantic_rank, first.lexical_rank)))
    assert first.hierarchical_score == pytest.approx(first.passage_score + 0.25 / 61 + 0.1 * first.neighbor_score + 0.1 * first.agreement_score)
    assert all(r.rank >= 2 for r in local.values() if not r.exact)


def test_retention(chunks, query):
    one = search.hierarchical_search(chunks, query, Options(passages_per_chapter=1))
    both = search.hierarchical_search(chunks, query, Options(passages_per_chapter=1, retention="global"))
    assert len(rows(one.retained, "pos")) == 3 and len(rows(both.retained, "pos")) == 6


@pytest.fixture
def backwards():
    """Scores later passages higher. A class of the function's own goes to the workers whole."""

    class Backwards:
        model_id = "backwards"

        def score(self, query, passages):
            return np.arange(len(passages), dtype=np.float32)

    return Backwards()


def test_rerank_a_prefix(chunks, query, backwards):
    got = search.search(chunks, query, reranker=backwards, options=Options(rerank_candidates=4)).orderBy("rank").collect()
    assert [r.semantic_rank for r in got] == [4, 3, 2, 1, 5, 6] and [r.reranked for r in got] == [True] * 4 + [False] * 2
    one = search.search(chunks, query, reranker=backwards, options=Options(rerank_candidates=4, one_per_chapter=True))
    assert in_order(one, "pos") == [(4,), (5,), (0,)]


def test_rerank_fusion(chunks, query, backwards):
    plain = search.search(chunks, query, "hybrid", True)
    none = search.search(chunks, query, "hybrid", True, Options(rerank_weight=0.0), reranker=backwards)
    assert in_order(plain, "pos") == in_order(none, "pos")
    full = search.search(chunks, query, "hybrid", True, Options(rerank_candidates=3), reranker=backwards)
    assert in_order(full, "pos")[0] == (1,) and in_order(full, "pos") != in_order(plain, "pos")

    class Odd:
        model_id = "odd"

        def score(self, query, passages):
            return np.full(len(passages), np.nan, np.float32)

    with pytest.raises(Exception, match="finite"):
        search.search(chunks, query, reranker=Odd()).collect()


def test_widened_passages(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    parts = [(0, 1, 1, 0, 20), (1, 1, 2, 15, 35), (2, 1, 3, 30, 60)]
    own = spark.createDataFrame([(p, d, o, s, e, " ".join(words[s:e])) for p, d, o, s, e in parts], "pos long, doc_id long, ordinal int, word_start int, word_end int, text string")
    got = {r.pos: r.passage for r in search.widened(own.select("pos"), own, 30).collect()}
    assert got == {0: " ".join(words[:30]), 1: " ".join(words[10:40]), 2: " ".join(words[30:])}
    assert {r.pos: r.passage for r in search.widened(own.select("pos"), own, 0).collect()}[1] == " ".join(words[15:35])
    assert search.chapter_words(own).first().words == words == docs.first().text.split()
    with pytest.raises(Exception, match="disagree or leave gaps"):
        search.chapter_words(own.where("pos <> 1").where("pos <> 0")).collect()


def test_similar_leaves_out_neighbours(spark):
    v = [unit(1, k / 10) for k in range(6)]
    data = [(0, 1, 1, 0, 10, "a"), (1, 1, 2, 8, 18, "b"), (2, 1, 3, 18, 28, "a"), (3, 1, 4, 28, 38, "c"), (4, 2, 1, 0, 10, "a"), (5, 2, 2, 5, 15, "d")]
    own = spark.createDataFrame([(p, d, o, s, e, "x", "Y", t, v[p]) for p, d, o, s, e, t in data], CHUNKS)
    assert in_order(search.similar_chunks(own, own.where("pos = 0")), "pos") == [(3,), (4,)]


def test_uplift_views_and_late_interaction(spark, chunks, query):
    raw = spark.createDataFrame([(7, 0, 0.2), (7, 1, 0.9)], "item_id long, pos long, score double")
    other = spark.createDataFrame([(7, 0, 0.6), (7, 1, 0.1)], "item_id long, pos long, score double")
    assert rows(search.lifted(raw, other, 0.5), "pos", "score") == [(0, pytest.approx(0.4)), (1, 0.9)]
    view = chunks.select("pos", "embedding")
    got = {r.pos: r.score for r in search.view_fusion({"raw": view, "dialogue": view.where("pos = 2")}, query, view.where("pos = 5")).collect()}
    assert got[3] == pytest.approx(0.30 / 61) and got[2] == pytest.approx(0.30 / 66 + 0.05 / 61) and got[5] == pytest.approx(0.30 / 64 + 0.25 / 61)
    said = query.withColumn("query", F.lit("what he said"))
    assert {r.pos: r.score for r in search.view_fusion({"dialogue": view.where("pos = 2")}, said).collect()}[2] == pytest.approx(0.30 / 61)


def test_scene_base(spark):
    own = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0)], "item_id long, pos long, score double")
    far = spark.createDataFrame([(1, 11, 3.0), (1, 12, 1.5)], "item_id long, pos long, score double")
    assert rows(search.combined_base(own, far, 0.25), "pos", "score") == [(10, 0.75), (11, pytest.approx(0.625)), (12, 0.125)]
    assert rows(search.combined_base(own, far, 0.0), "pos", "score") == [(10, 4.0), (11, 2.0)]


def test_models(spark):
    model = models.DigestEncoder()
    v = model.encode_passages(["a", "b"])
    assert v.shape == (2, 16) and np.allclose(np.linalg.norm(v, axis=1), 1)
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "pos long, text string")
    got = {r.pos: r.embedding for r in models.encoded(df, model).collect()}
    assert got[2] is None and got[3] is None and np.allclose(got[1], v[0])
    assert rows(models.too_long(spark.createDataFrame([(1, "w " * 511), (2, "w " * 510)], "pos long, text string"), model), "pos", "n_tokens") == [(1, 513)]
    for wrong in (np.zeros((1, 4)), np.ones((2, 4)), np.full((1, 1), np.nan)):
        with pytest.raises(ValueError):
            models.checked(wrong, 1)
    with pytest.raises(ValueError):
        models.encoder("none")
    assert models.safe_name("org/My Model:2") == "My-Model-2"


def test_structured_chunks(spark):
    paragraphs = [" ".join(f"p{k}w{i}" for i in range(n)) for k, n in enumerate((140, 160))]
    sentence = lambda n, k: " ".join([f"s{k}x{i}" for i in range(n - 1)] + [f"end{k}."])
    text = "\n\n".join(paragraphs)
    by_sentence = " ".join(sentence(20, k) for k in range(15))
    df = spark.createDataFrame([(1, text), (2, by_sentence), (3, ""), (4, "w " * 200), (5, "few words.")], "doc_id long, text string")
    got = {d: [] for d in range(1, 6)}
    for r in chunking.structured_chunks(df).orderBy("doc_id", "ordinal").collect():
        got[r.doc_id].append((r.word_start, r.word_end))
    assert got[1] == [(0, 140), (100, 260), (140, 300)]  # the only sentence end before 260 is the paragraph's
    assert got[2] == [(0, 160), (120, 280), (240, 300)]
    assert got[3] == [] and got[4] == [(0, 160), (120, 200)] and got[5] == [(0, 2)]


def test_coverage_of_windows_and_targets(spark):
    own = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 20, 30)], "doc_id long, ordinal int, word_start int, word_end int")
    assert rows(chunking.uncovered(own, own.where("ordinal = 1")), "chunk") == [(2,)]
    best = spark.createDataFrame([(1, 5, 1)], "doc_id long, target int, ordinal int")
    with pytest.raises(Exception, match="no chunk holds"):
        chunking.required_chunks(spark.createDataFrame([(1, 6)], "doc_id long, target int"), best).collect()


def test_best_span():
    text = "Walk there. Then walk WITH the Straße fox, walk with me"
    assert text[slice(*preview.best_span(text, "walk with me"))] == "walk with me"
    assert text[slice(*preview.best_span(text, "the fox of strasse"))] == "Straße fox"
    assert preview.best_span(text, "nothing here matches it at all zebra") is None
    assert preview.best_span(text, "the") == (text.index("the S"), text.index("the S") + 3)


def test_previews():
    text = " ".join(f"word{i}" for i in range(100))
    got = preview.preview(text, "word50 word51", 1000, 60)
    assert "word50 word51" in got["text"] and len(got["text"]) <= 60
    assert got["word_start"] <= 1050 < got["word_end"] and got["before"].endswith(f"word{got['word_start'] - 1001}")
    middle = preview.preview(text, "zebra", 0, 60)
    assert abs((middle["word_start"] + middle["word_end"]) / 2 - 50) <= 2
    assert preview.preview(" ", "x") is None and preview.preview(None, "x") is None
    assert preview.preview("one two", "two")["text"] == "one two"


def test_preview_column_and_focus(spark):
    df = spark.createDataFrame([("a b c", "b", 5), (None, "b", 0)], "text string, query string, word_start int")
    got = preview.with_preview(df).collect()
    assert got[0].preview.text == "a b c" and got[0].preview.word_start == 5 and got[1].preview is None
    ends = [r[0] for r in spark.createDataFrame([("aaaa bb cc",), ("x",)], "text string").select(preview.focus_end(F.col("text"), F.lit(10), 7)).collect()]
    assert ends == [12, 11]


def test_fragments_beside(spark):
    words = [f"w{i}" for i in range(100)]
    own = spark.createDataFrame([(1, o, s, e, " ".join(words[s:e])) for o, s, e in ((1, 0, 40), (2, 30, 70), (3, 60, 100))], "doc_id long, ordinal int, word_start int, word_end int, text string")
    got = {r.ordinal: (r.before, r.after) for r in preview.neighbour_fragments(own).collect()}
    assert got == {1: (None, " ".join(words[40:68])), 2: (" ".join(words[2:30]), " ".join(words[70:98])), 3: (" ".join(words[32:60]), None)}


def test_paragraph_fragments(spark):
    paragraphs = spark.createDataFrame([(1, 1, 0, 4, "a b c d"), (1, 2, 4, 8, "e f g h"), (1, 3, 60, 61, "far")], "doc_id long, ordinal int, word_start int, word_end int, text string")
    focus = spark.createDataFrame([(1, 2, 6)], "doc_id long, focus_start int, focus_end int")
    got = {r.ordinal: [(x.region, x.text) for x in r.fragments] for r in preview.paragraph_fragments(focus, paragraphs).collect()}
    assert got == {1: [("before", "a b"), ("focus", "c d")], 2: [("focus", "e f"), ("after", "g h")]}
    late = spark.createDataFrame([(1, 31, 32)], "doc_id long, focus_start int, focus_end int")
    assert rows(preview.paragraph_fragments(late, paragraphs), "ordinal", "partial_start", "partial_end") == [(1, True, False), (2, False, False)]


def test_located(spark):
    docs = spark.createDataFrame([(1, "one  two\nThree four five"), (2, "nothing")], "doc_id long, text string")
    assert rows(preview.located(docs, "three FOUR", 1), "doc_id", "word_start", "context") == [(1, 2, "two Three four five")]


def test_narrative(spark):
    text = 'Ser Tom killed the king. "We fled at dawn," he said. Anna saw Tom Reed. Anna  slept. It rained.'
    df = spark.createDataFrame([(1, 1, "one", "ANA", text)], "doc_id long, ordinal int, book string, pov string, text string")
    r = narrative.narrative_views(df).first()
    assert len(r.sentences) == 5 and r.sentences[1].startswith('"We')
    assert r.dialogue == "We fled at dawn," and narrative.names(text) == ["Ser Tom", "Anna", "Tom Reed"]
    assert r.summary == f"{r.sentences[0]} {r.sentences[1]}" and r.events.startswith('"We fled at dawn," he said. Ser Tom killed')
    assert r.entities == "Named characters and places: Ser Tom, Anna, Tom Reed. Narrative roles: king"
    assert r.context.startswith("Book: one. Chapter: 1. Point of view: ANA. Named") and r.context.endswith(f"Passage: {text}")


def test_expansion(spark):
    q = spark.createDataFrame([(1, "who  held the acting hand"), (2, "the queenly one"), (3, "Old queen walks")], "item_id long, query string")
    out = {r.item_id: r.query for r in narrative.expanded_by_phrases(q, [("acting hand", "the chancellor"), ("queen", "ruler")]).collect()}
    assert out == {1: "who held the acting hand the chancellor", 2: "the queenly one ruler", 3: "Old queen walks ruler"}
    again = narrative.expanded_by_phrases(narrative.expanded_by_phrases(q, [("hand", "the seal"), ("seal", "wax")]), [("hand", "the seal"), ("seal", "wax")])
    assert again.where("item_id = 1").first().query.endswith("the seal wax")  # expanding twice may add more
    by_name = {r.item_id: r.query for r in narrative.expanded_by_aliases(q, [("Mara", ("queen", "old queen"))]).collect()}
    assert by_name == {1: "who held the acting hand", 2: "the queenly one", 3: "Old queen walks Mara queen old queen"}


def test_scenes(spark):
    text = " ".join(["Lady Ann"] + ["w"] * 400 + ["the", "Fox"])
    docs = spark.createDataFrame([(1, "one", "ANA", text)], "doc_id long, book string, pov string, text string")
    got = narrative.scenes(docs, [("Reynard", ("fox",))]).orderBy("ordinal").collect()
    assert [(r.word_start, r.word_end) for r in got] == [(0, 280), (124, 404)]
    assert all(list(r.entities) == ["Lady Ann"] and list(r.aliases) == ["Reynard"] for r in got)
    assert got[0].scene_text.startswith("Book: one. Chapter: 1. Point of view: ANA. Entities in surrounding scene: Lady Ann. Canonical character identities: Reynard. Scene passage: Lady Ann")
    with pytest.raises(ValueError):
        narrative.scenes(docs, size=50)


def test_chapter_ids(spark):
    df = spark.createDataFrame([("b", 1, "PROLOGUE"), ("b", 2, "JO ANN"), ("b", 3, "JO ANN")], "book string, sequence int, pov string")
    assert rows(narrative.chapter_ids(df), "chapter_id", "chapter_title") == [("b-001-prologue", "PROLOGUE"), ("b-002-jo-ann-1", "JO ANN I"), ("b-003-jo-ann-2", "JO ANN II")]
    numerals = [r[0] for r in spark.range(1, 60).select(narrative.roman(F.col("id"))).collect()]
    assert (numerals[3], numerals[8], numerals[13], numerals[48]) == ("IV", "IX", "XIV", "XLIX")


def test_events(spark):
    groups = events.action_groups({"protect": ("save",), "rescue": ("save", "saved"), "kill": ("killed",)})
    assert groups["save"] == "rescue"
    got = events.parsed("Tom Reed never killed Anna", groups)[0]
    assert (got["subject"], got["action"], got["object"], got["negated"], got["confidence"]) == ("tom reed", "kill", "anna", True, "high")
    turned = events.parsed("Anna was killed by Tom", groups)[0]
    assert (turned["passive"], turned["subject"], turned["object"]) == (True, "tom", "anna")
    docs = spark.createDataFrame([(1, "b", "P", "Tom killed Anna. Anna slept.")], "doc_id long, book string, pov string, text string")
    found = events.event_records(narrative.scenes(docs))
    assert rows(found, "subject", "action", "object", "sentence_index") == [("tom", "kill", "anna", 0)]
    q = spark.createDataFrame([(1, "Tom killed Anna"), (2, "Anna killed Tom"), (3, "Did Zoe sleep")], "item_id long, query string")
    scored = {r.item_id: r.score for r in events.structured_scores(found.withColumn("event", F.lit(0)), events.signatures(q)).collect()}
    assert scored[1] == pytest.approx(1.0) and scored[2] == pytest.approx(0.45 + 0.35 + 0.05) and scored[3] == pytest.approx(0.05 / 0.5, abs=0.2)
    words = spark.createDataFrame([(1, 0, 2.0), (1, 1, 4.0)], "item_id long, event int, score double")
    structure = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0)], "item_id long, event int, score double")
    assert rows(events.event_scores(words, structure), "event", "score") == [(0, pytest.approx(0.8)), (1, pytest.approx(0.4))]


def test_passage_metrics(spark):
    results = spark.createDataFrame([(1, 1, 5, 0, 100), (1, 2, 5, 50, 150), (1, 3, 6, 0, 100)], "item_id long, rank int, doc_id long, word_start int, word_end int")
    targets = spark.createDataFrame([(1, 0, 5, 60, 80, 3), (1, 1, 6, 500, 520, 2)], "item_id long, target int, doc_id long, s int, e int, grade int")
    r = evaluation.passage_metrics(results, targets).first()
    ideal = 7 / math.log2(2) + 3 / math.log2(3)
    assert (r.first, r.target_recall_1, r.target_recall_50, r.ndcg_5) == (1, 0.5, 0.5, pytest.approx(7 / ideal))


def test_stages(spark):
    firsts = spark.createDataFrame([(1, 2), (2, None), (3, None), (4, 9)], "item_id long, first int")
    targets = spark.createDataFrame([(i, 0, 10 + i) for i in (1, 2, 3, 4)], "item_id long, target int, doc_id long")
    matches = spark.createDataFrame([(i, 0, 100 + i) for i in (1, 2, 3, 4)], "item_id long, target int, pos long")
    chapters = spark.createDataFrame([(1, 11, 1), (2, 12, 30), (3, 13, 2), (4, 14, 1)], "item_id long, doc_id long, chapter_rank int")
    candidates = spark.createDataFrame([(1, 101, 1), (4, 104, 4)], "item_id long, pos long, within_rank int")
    found = evaluation.stages(firsts, targets, matches, chapters, candidates, candidates.where("item_id = 1"))
    assert rows(found, "item_id", "failure") == [(1, "pass"), (2, "wrong-chapter"), (3, "target-absent"), (4, "target-misranked")]
    r = evaluation.stage_metrics(found).first()
    assert (r.cases, r.chapter_recall_1, r.candidate_coverage, r.retained_coverage, r.conditional_recall_5, r.within_chapter_recall_1, r.within_chapter_recall_5) == (4, 0.5, 0.5, 0.25, 0.5, 0.5, 1.0)


def test_evaluate_flat_and_hierarchical(spark, chunks, query):
    cases = spark.createDataFrame([(7, "plot", "unspecified", "unspecified")], "item_id long, category string, query_style string, name_usage string")
    targets = spark.createDataFrame([(7, 0, 1, 9, 12, 3)], "item_id long, target int, doc_id long, s int, e int, grade int")
    flat = evaluation.evaluate(search.search(chunks, query, "hybrid"), chunks, targets, cases)
    run = search.hierarchical_search(chunks, query)
    deep = evaluation.evaluate(run.results, chunks, targets, cases, run.chapters, run.candidates, run.retained)
    for report in (flat, deep):
        assert report["cases"].first().failure == "pass"
        assert report["overall"].first().decision == "investigate-once"  # no name-free or paraphrased case
    assert rows(flat["groups"], "report", "value") == [("category", "plot")]


def test_hard_negatives(spark):
    data = [(p, 1 if p < 4 else 2 if p < 6 else 3, p, 0, 1, "one" if p < 6 else "two", "P", "Anna here" if p in (4, 6) else "other", [1.0]) for p in range(10)]
    own = spark.createDataFrame(data, CHUNKS)
    results = spark.createDataFrame([(1, r, p) for r, p in enumerate(range(10), 1)], "item_id long, rank int, pos long")
    positives = spark.createDataFrame([(1, 0)], "item_id long, pos long")
    matches = spark.createDataFrame([(1, 0), (1, 1)], "item_id long, pos long")
    q = spark.createDataFrame([(1, "Where did Anna go at Night")], "item_id long, query string")
    got = training.hard_negatives(results, own, positives, matches, q, per_case=4).orderBy("place").collect()
    assert [(r.pos, r.kind) for r in got] == [(2, "same-chapter"), (3, "same-chapter"), (4, "same-entity"), (5, "global")]
    assert training.triples(positives, training.hard_negatives(results, own, positives, matches, q, per_case=4), q, own).count() == 4
    with pytest.raises(ValueError):
        training.hard_negatives(results, own, positives, matches, q, split="acceptance")


def test_folds_keep_scenes_whole():
    cases = [{"id": f"c{i}", "scene_id": f"s{i // 2}", "books": ["b"], "query_style": "terse-search" if i % 4 < 2 else "descriptive-search", "name_usage": "named"} for i in range(20)]
    folds = training.scene_folds(cases, 4)
    assert folds == training.scene_folds(cases, 4)
    sizes = [len(f) for f in folds]
    assert sum(sizes) == 20 and max(sizes) - min(sizes) <= 2
    for scene in {c["scene_id"] for c in cases}:
        assert sum(any(c["scene_id"] == scene for c in f) for f in folds) == 1
    for train, check in training.fold_splits(cases, folds):
        assert not {c["id"] for c in train} & {c["id"] for c in check} and len(train) + len(check) == 20
    with pytest.raises(ValueError):
        training.scene_folds(cases, 11)


def test_hard_negatives_shuffle_no_texts(spark, monkeypatch):
    own = spark.createDataFrame([(p, p, 1, 0, 1, "one", "P", "other", [1.0]) for p in range(6)], CHUNKS)
    results = spark.createDataFrame([(1, r, p) for r, p in enumerate(range(6), 1)], "item_id long, rank int, pos long")
    positives = spark.createDataFrame([(1, 0)], "item_id long, pos long")
    q = spark.createDataFrame([(1, "Where")], "item_id long, query string")
    plans = []
    monkeypatch.setattr(training, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert training.hard_negatives(results, own, positives, positives, q, per_case=4).count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    texts = [p for p in plans if "text#" in p]
    assert texts and all(re.search(r"BroadcastHashJoin \[pos#", p) for p in texts)
