import math

import pytest
from pyspark.sql import functions as F

from folio.functions.text import excerpt, tokens
from folio.operators import chunking, evaluation, evidence, fusion, lexical, vectors
from folio.plans import registry


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def text_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tokens(spark):
    df = text_of(spark, "The KING’S crown", "Straße café", None, "")
    assert [r.t for r in df.select(tokens(F.col("text")).alias("t")).collect()] == [["the", "king", "crown"], ["strasse", "caf"], [], []]


@pytest.mark.parametrize(("n", "spans"), [(420, [(0, 180), (135, 315), (270, 420)]), (10, [(0, 10)]), (0, [])])
def test_fixed_chunks(spark, n, spans):
    df = text_of(spark, " ".join(f"w{i}" for i in range(n)))
    assert rows(chunking.fixed_chunks(df), "word_start", "word_end") == spans


def test_scene_windows_end_at_the_end(spark):
    df = text_of(spark, " ".join(["w"] * 500), "a b")
    assert rows(chunking.scene_windows(df), "doc_id", "word_start", "word_end") == [(0, 0, 280), (0, 180, 460), (0, 220, 500), (1, 0, 2)]


def test_paragraph_offsets_keep_gaps(spark):
    df = text_of(spark, "a b\n\nc")
    assert rows(chunking.paragraphs(df), "ordinal", "word_start", "word_end", "text") == [(1, 0, 2, "a b"), (3, 2, 3, "c")]


def test_no_break_space_splits_words(spark):
    df = text_of(spark, "a b")
    assert rows(chunking.fixed_chunks(df), "word_end") == [(2,)]


def test_bm25_by_hand(spark):
    docs = text_of(spark, "red fox", "red red dog", "cat")
    queries = spark.createDataFrame([(7, "red")], "item_id long, query string")
    got = {r.doc_id: r.score for r in lexical.bm25(docs, queries).collect()}
    idf = math.log1p((3 - 2 + 0.5) / 2.5)
    for doc, tf, dl in ((0, 1, 2), (1, 2, 3)):
        assert got[doc] == pytest.approx(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2)))
    assert 2 not in got


def test_phrases_keep_stop_words(spark):
    docs = text_of(spark, "come dance with me", "dance me with", "dance")
    queries = spark.createDataFrame([(1, "dance with me"), (2, "dance"), (3, "unknown words")], "item_id long, query string")
    assert rows(lexical.exact_phrases(docs, queries), "item_id", "doc_id") == [(1, 0)]
    assert rows(lexical.contains_all(docs, queries), "item_id", "doc_id") == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_registered_phrases_are_whole(spark, tmp_path):
    opening = "once upon a time in the old far"
    texts = [f"{opening} north a fox ran", f"{opening} south a dog slept", f"x {opening} north a fox ran home"]
    documents = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, f"{opening} north a fox ran")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(registry.exact_phrase_match(spark, str(tmp_path)), "item_id", "doc_id") == [(1, 0), (1, 2)]


def test_without_overlap_is_greedy(spark):
    df = spark.createDataFrame([(1, 5, 1, 10, 20), (1, 5, 2, 15, 25), (1, 5, 3, 20, 30), (1, 6, 4, 15, 25)], "item_id long, doc_id long, rank int, word_start int, word_end int")
    assert rows(fusion.without_overlap(df), "rank") == [(1,), (3,), (4,)]


def test_fuse(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "item_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 2, 1)], "item_id long, doc_id long, rank int")
    got = {r.doc_id: r.score for r in fusion.fuse((a, 0.5), (b, 1.0)).collect()}
    assert got == {1: pytest.approx(0.5 / 61), 2: pytest.approx(0.5 / 62 + 1 / 61)}


def test_context_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.embedding for r in vectors.context_vectors(df).collect()}
    assert got[0] == got[1] == pytest.approx([2**-0.5] * 2)
    assert got[2] == pytest.approx([1, 0])


def test_metrics_and_gate(spark):
    firsts = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 20)], "item_id long, first int")
    r = evaluation.gate(evaluation.rank_metrics(firsts)).first()
    assert (r.n, r.hit_1, r.hit_5, r.mrr_10, r.decision) == (4, 0.25, 0.5, pytest.approx(1.25 / 4), "investigate-once")
    assert 0 < r.low_10 < 0.5 < r.high_10 < 1


def test_gate_needs_the_subset(spark):
    columns = "item_id long, first int, category string, query_style string, name_usage string"
    cases = spark.createDataFrame([(i, 1, "plot", "question", "named") for i in range(8)] + [(8, 30, "name-free", "unspecified", "unspecified"), (9, 5, "plot", "unspecified", "name-free")], columns)
    metrics = evaluation.rank_metrics(cases)
    special = evaluation.rank_metrics(evaluation.subset(cases))
    good = evaluation.rank_metrics(evaluation.subset(cases.where("item_id <> 8")))
    none = evaluation.rank_metrics(evaluation.subset(cases.where("item_id < 8")))
    decisions = [evaluation.gate(metrics, x).first().decision for x in (None, none, special, good)]
    assert decisions == ["investigate-once"] * 3 + ["proceed"]
    assert evaluation.partial_gate(metrics).first().decision == "proceed"
    r = metrics.first()
    assert (r.hit_20, r.hit_50, r.mrr_50) == (0.9, 1.0, pytest.approx((8 + 1 / 5 + 1 / 30) / 10))
    assert r.low_1 < r.hit_1 < r.high_1
    got = rows(evaluation.reports(cases), "report", "value", "n")
    assert got == [("category", "name-free", 1), ("category", "plot", 9), ("name_usage", "name-free", 1), ("name_usage", "named", 8), ("query_style", "question", 8)]


def test_target_recall(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 4)], "item_id long, doc_id long, rank int")
    targets = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (1, 8), (2, 5)], "item_id long, doc_id long")
    assert rows(evaluation.target_recall(ranked, targets), "item_id", "target_recall_1", "target_recall_5") == [(1, 0.25, 0.5), (2, 0.0, 0.0)]


def test_excerpt(spark):
    df = text_of(spark, "short", "word, " * 100)
    got = [r.e for r in df.select(excerpt(F.col("text"), 20).alias("e")).collect()]
    assert got == ["short", "word, word, word…"]


def test_evidence_against_brute_force(spark):
    texts = ["red fox the red dog", "dog red", "fox", "", None, "cat red cat fox cat dog red", "the of", "dog " * 50 + "red fox"]
    asked = {1: "red fox dog", 2: "the dog", 3: "zebra red", 4: "of the", 5: "red red fox"}
    docs = text_of(spark, *texts)
    queries = spark.createDataFrame(list(asked.items()), "item_id long, query string")
    split = [(t or "").split() for t in texts]
    df = {w: sum(w in t for t in split) for t in split for w in t}
    idf = {w: math.log1p((len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    want, full = {}, set()
    for item, query in asked.items():
        raw = [w for w in query.split() if w not in ("the", "of")]
        q = [w for w in raw if w in df]
        pairs = set(zip(q, q[1:], strict=False))
        for doc, t in enumerate(split):
            if not (hit := set(q) & set(t)):
                continue
            coverage = sum(idf[w] for w in hit) / sum(idf[w] for w in set(q))
            width = min(j - i for i in range(len(t)) for j in range(i + 1, len(t) + 1) if hit <= set(t[i:j]))
            near = coverage * len(hit) / width if len(hit) > 1 else 0
            phrase = len(pairs & set(zip(t, t[1:], strict=False))) / len(pairs) if pairs else 0
            want[item, doc] = pytest.approx((coverage, near, phrase, 0.6 * coverage + 0.3 * near + 0.1 * phrase))
            full |= {(item, doc)} if set(raw) <= set(t) else set()
    assert {(r.item_id, r.doc_id): (r.coverage, r.proximity, r.phrase, r.score) for r in evidence.evidence(docs, queries).collect()} == want
    assert {(r.item_id, r.doc_id) for r in evidence.evidence(docs, queries, strict=True).collect()} == full
    # Close terms lift a share of the base score; one term alone gains nothing.
    got = {(r.item_id, r.doc_id): r for r in evidence.lexical_scores(docs, queries).collect()}
    share = {k: 0.25 * r.base / max(x.base for (i, _), x in got.items() if i == k[0]) for k, r in got.items()}
    assert not any(r.exact for r in got.values())
    assert got[1, 0].score == pytest.approx(share[1, 0] + 1 + 0.5 * 3 / 4 + 0.25 / 2)
    assert got[2, 1].score == pytest.approx(share[2, 1])


def test_pages_hold_no_overlap(spark):
    chunks = spark.createDataFrame([(0, i + 1, 10 * i, 10 * i + 20, t) for i, t in enumerate(["red fox", "red", "cat", "red"])] + [(1, 1, 0, 5, "fox")], "doc_id long, ordinal int, word_start int, word_end int, text string")
    queries = spark.createDataFrame([(1, "red fox")], "item_id long, query string")
    got = [r for page in (1, 2) for r in evidence.lexical_page(chunks, queries, page, 2).orderBy("rank").collect()]
    assert [(r.rank, r.doc_id, r.ordinal, r.lexical_rank, r.total) for r in got] == [(1, 0, 1, 1, 3), (2, 1, 1, 2, 3), (3, 0, 4, 4, 3)]
    assert got[0].score > 3


def test_promotion_needs_a_score(spark):
    scores = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.5)], "item_id long, doc_id long, score double")
    exact = spark.createDataFrame([(1, 1), (1, 3)], "item_id long, doc_id long")
    assert rows(evidence.promoted(scores, exact), "doc_id", "exact", "score") == [(1, True, pytest.approx(1.5)), (2, False, 0.5)]


def test_targets_shorter_than_the_least_overlap(spark):
    chunks = spark.createDataFrame([(0, 1, 0, 100), (0, 2, 90, 200)], "doc_id long, ordinal int, word_start int, word_end int")
    targets = spark.createDataFrame([(0, 1, 85, 95), (0, 2, 80, 130)], "doc_id long, target int, s int, e int")
    assert rows(chunking.target_matches(chunks, targets, "overlap"), "target", "ordinal") == [(1, 1), (2, 1), (2, 2)]
    assert rows(chunking.target_matches(chunks, targets), "target", "ordinal") == [(1, 1), (2, 2)]
    assert rows(chunking.best_chunks(chunking.target_matches(chunks, targets, "overlap")), "target", "ordinal") == [(1, 1), (2, 2)]


def test_percentiles_round_half_to_even(spark):
    df = spark.createDataFrame([(1, x) for x in (4, 1, 3, 2)], "g int, x long")
    r = evaluation.percentiles(df, "x", "g").first()
    assert (r.n, r.average, r.p50, r.p95, r.most) == (4, 2.5, 3, 4, 4)
