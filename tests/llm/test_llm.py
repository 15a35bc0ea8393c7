"""Training-data operators: odd inputs, brute force, round trips and held-out accuracy on small tables."""

import collections
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import common, decontaminate, exact_dedup, html, language, licenses, line_dedup, mixing, near_dedup, queries, tokens, toxicity

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, "one two three four five six", "en", "a", 27),
    (1, "one two three four five six", "en", "a", 27),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "no id\nat all", "en", None, 12),
    (4, " \t\n", "xx", "b", 3),
    (5, LONG, "en", "b", len(LONG)),
    (6, "日本 ~~ \x00 é", "ja", "é", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named as the operators' own."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumn("size", F.lit(1)).withColumn("items", F.lit("x")).withColumn("label", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


BENCHMARK = [(10, "two three four"), (11, None), (None, "one"), (12, "")]


def each(spark):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    return {
        "mix": lambda d: mixing.mix(d),
        "mixed": lambda d: mixing.mixed_documents(d),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "exact": lambda d: exact_dedup.exact_dedup(d, F.col("doc_id") <= 3),
        "lines": lambda d: line_dedup.line_dedup(d),
        "tokens": lambda d: tokens.token_report(d),
        "near": lambda d: near_dedup.near_duplicates(d),
        "distinct": lambda d: near_dedup.distinct_documents(d),
        "benchmark": lambda d: decontaminate.decontaminate(d, benchmark),
        "clean": lambda d: decontaminate.clean_documents(d, benchmark),
        "language": lambda d: language.identify(d, language.train(d)),
        "known": lambda d: language.known_language(d),
        "licenses": lambda d: licenses.scan_licenses(d),
        "html": lambda d: html.extract(d.select("doc_id", F.col("text").alias("html"), F.lit("http://x.org/a").alias("url"))),
    }


FILTERS = {"mixed", "distinct", "clean", "known"}


@pytest.mark.parametrize("name", ["mix", "mixed", "toxicity", "exact", "lines", "tokens", "near", "distinct", "benchmark", "clean", "language", "known", "licenses", "html"])
def test_odd_rows(spark, odd, empty, name):
    run = each(spark)[name]
    got = run(odd).collect()
    assert (len(got) == len(ODD)) or name in FILTERS
    assert run(empty).count() == 0
    if name in FILTERS:
        assert run(odd).columns == odd.columns


@pytest.fixture(scope="module")
def sql():
    found = duckdb.connect()
    for table in os.listdir(DATA):
        found.execute(f"create view {table.removesuffix('.parquet')} as select * from '{DATA}/{table}'")
    return found


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sql, name):
    got, want = queries.QUERIES[name](spark, DATA), sql.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(repr([r[c] for c in order]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_mix_repeats_and_cuts(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 7 + 1)), "en", "ab"[i % 2], 0) for i in range(200)], SCHEMA)
    planned = mixing.mix(docs)
    by = planned.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    for r in by:
        assert 0 <= r.target - r.taken < 1 and r.target <= 2 * r.size
    out = mixing.mixed_documents(docs)
    assert out.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r.taken for r in by)


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 30_000):
        keys = rng.integers(0, 2**64, n, np.uint64)
        f = exact_dedup.fuse_filter(keys)
        assert exact_dedup.may_contain(keys, *f).all()
        others = rng.integers(0, 2**64, 20_000, np.uint64)
        assert exact_dedup.may_contain(others, *f).mean() < 0.02


def test_tokens_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path())
    texts = [r[1] or "" for r in ODD] + ["a  b\n\n c's I'll 12½ x_y", "<|endoftext|> z", "é\x1c", "a b\n", "\n a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens.write_tokens(docs, folder := str(tmp_path / "out"), docs_per_shard=3)
    start = 0
    for r in tokens.read_tokens(spark, folder).orderBy("doc_id").collect():
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)


def test_codes_of_all_lengths():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5], np.uint32)
    n = np.array([3, 0, 6])
    assert (tokens.decode(*tokens.encode(ranks, n), n) == ranks).all()


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for _ in range(12):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 25)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = "changed"
            docs.append((len(docs), " ".join(own)))
    sets = {i: set(near_dedup.shingles(t).tolist()) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if _jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


def test_components_write_few_files(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(600).select((F.col("id") + 1).alias("a"), (F.col("id") + 1 + F.col("id") % 3).alias("b")).where("a != b")
        found = near_dedup.components(edges)
        assert len(found.inputFiles()) <= near_dedup.FILES * spark.sparkContext.defaultParallelism
        own = {r.c: r.label for r in found.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = {}
    for a, b in sorted((r.a, r.b) for r in edges.collect()):
        want[b] = want[a] = want.get(a, a)
    assert own == want


def test_word_hashes_follow_words():
    for text in ("a b", " A\tb\x0b c ", "é É", "x" * 5000 + " y", "", None):
        assert len(near_dedup.word_hashes(text)) == len((text or "").encode().split())
    assert (near_dedup.word_hashes("Ab c") == near_dedup.word_hashes("aB  C")).all()


def test_blocks_of_items_find_the_same(spark):
    docs = common.read(spark, DATA, "documents").where("doc_id < 200")
    benchmark = common.read(spark, DATA, "benchmark")
    whole, parts = (decontaminate.decontaminate(docs, benchmark, block=b).orderBy("doc_id").collect() for b in (10**6, 300))
    assert [(r.n_hit, r["items"], r.spans) for r in whole] == [(r.n_hit, r["items"], r.spans) for r in parts]
    assert any(r.n_hit for r in whole)


def _held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_held_out(spark):
    docs = common.read(spark, DATA, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in queries.QUERIES["op8_language"](spark, DATA).collect() if r.held_out]
    assert all(_held_out(r.doc_id) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.95
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_toxicity_held_out(spark):
    sf = DATA.replace("0.01", "0.1")
    toxic = {r.doc_id: r.toxic for r in common.read(spark, sf, "labels").collect()}
    got = [r for r in queries.QUERIES["op2_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    hit = sum(r.predicted and toxic[r.doc_id] for r in got)
    assert hit / sum(toxic[r.doc_id] for r in got) > 0.9
    assert hit / sum(r.predicted for r in got) > 0.9


def test_offending_sentences():
    weights = np.zeros(toxicity.FEATURES, np.float32)
    weights[toxicity.features("scum")[0]] = 20
    text = "All is well. You scum! Yes."
    score, spans = toxicity.Scorer(weights, -6.0)(text)
    assert score > 0.9 and [text[a:b].strip() for a, b, _ in spans] == ["You scum"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav>x</nav><div id=main><p>A &amp; b<b>c</b>d<p>e  f</div><div class='comment-list'>no</div><form>q<input></form><script>a='<p>'</script>", "A & bcd e f"),
        ("<article><header><h1>T</h1></header><p>x<br>y</p><aside>n</aside><section id='comments'>c</section></article><p>out", "T x y"),
        ('<p title="a>b">hi</p><p onclick="x>hi2</p>', "hi hi2"),
        ("x < y and <b>z<!-- c -->", "x < y and z"),
        (None, ""),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page, set()) == text


def test_style_tree_removes_what_repeats(spark):
    pages = [(i, f"http://h.org/{i}", f"<body><div class=x>Same words</div><div class=y><p>Page {i}</p>{'<p>more</p>' * (i % 3)}</div></body>") for i in range(8)]
    got = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith(f"Page {r.page_id}") for r in got)


def test_license_places_and_errors():
    scan = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    n, base, first, last, base_labels, labels, score, spans = scan("Relased undr the MIT License mit license, mit license")
    assert (n, base, first, last, base_labels, score) == (9, 3, 3, 7, ["mit"], 1.0)
    assert labels == ["mit", "mit-notice"] and spans[0]["errors"] == 2
    assert scan("foo Licensed under the Apache Lisense, Version 2.0.")[5] == ["apache-2.0"]
    assert scan("Licensed under CC BY-NC 4.0.")[5] == ["cc-by", "cc-by-nc-4.0"]
    assert scan("nothing of the kind")[:7] == (4, 0, None, None, [], [], 0.0)


def test_pipeline(spark):
    sf = DATA.replace("0.01", "0.001")
    docs = common.read(spark, sf, "documents")
    columns = docs.columns
    benchmark = decontaminate.Windows([(str(r.item_id), r.text) for r in common.read(spark, sf, "benchmark").collect()])
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = common.materialise(stage(spark, kept, sf), "test")
        assert kept.columns == columns and {r.doc_id for r in kept.select("doc_id").collect()} <= before, name
    rows = kept.collect()
    assert not any(benchmark.find(r.text)[1].any() for r in rows)
    sets = [set(near_dedup.shingles(r.text, 5).tolist()) for r in rows]
    assert all(_jaccard(a, b) < 0.8 for i, a in enumerate(sets) for b in sets[:i] if a and b)
    mixed = common.materialise(corpus_pipeline.mix_sources(spark, kept, sf), "test")
    assert corpus_pipeline.token_output(spark, mixed, sf).count() == mixed.count() == corpus_pipeline.run(spark, sf).count()


def test_planted_passages_go_whole(spark):
    """Passages of 2 to 6 lines, and a long line, planted at odd places: each stays where it stands first."""
    rng = random.Random(5)
    own = lambda: " ".join(f"u{rng.randrange(10**9)}" for _ in range(3))
    planted = [[own() for _ in range(n)] for n in (2, 2, 2, 3, 3, 4, 6)] + [["long " * 30 + own()]]
    docs = []
    for i in range(60):
        lines = [own() for _ in range(rng.randrange(4))]
        for p in rng.sample(planted, 2):
            lines += [*p, *(own() for _ in range(rng.randrange(1, 4)))]
        docs.append((i, lines))
    seen, want = set(), {}
    for i, lines in docs:
        want[i] = "\n".join(x for x in lines if x not in seen)
        seen.update(lines)
    got = line_dedup.passage_dedup(spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_passages_odd_rows(spark, odd, empty):
    got = line_dedup.passage_dedup(odd).collect()
    assert len(got) == len(ODD) and line_dedup.passage_dedup(empty).count() == 0
    assert all(r.n_removed == 0 and r.text == (t or "") for r, (_, t, *_) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(ODD, key=lambda r: (r[0] is None, r[0])), strict=True))
    short = spark.createDataFrame([(1, "Yes.\n\nNo."), (2, "Yes.\nMaybe.\n\nYes."), (None, "x\nYes.\n \nNo.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.passage_dedup(short).collect()} == {1: "Yes.\n\nNo.", 2: "Yes.\nMaybe.\n\nYes.", None: "x"}


def _texts(spark, pages):
    rows = [(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


@pytest.mark.parametrize("n", [49, 50, 1000])
def test_articles_stay_whole_on_hosts_of_any_size(spark, n):
    got = _texts(spark, [f"<article><h2>Summary</h2><h3>{('Pro', 'Con')[i % 2]}</h3><p>Page {i}</p></article>" for i in range(n)])
    assert got == [f"Summary {('Pro', 'Con')[i % 2]} Page {i}" for i in range(n)]


@pytest.mark.parametrize("n", [100, 10_000])
def test_importance_does_not_sink_with_pages(spark, n):
    got = _texts(spark, [f"<div class=x>Same words</div><div class=h>Section {i % 30}</div><div class=y>This is the text of page {i}</div>" for i in range(n)])
    assert got == [f"Section {i % 30} This is the text of page {i}" for i in range(n)]


@pytest.mark.parametrize(("n", "tag"), [(5, "div"), (60, "div"), (60, "article")])
def test_copies_under_other_ads_stay(spark, n, tag):
    got = _texts(spark, [f"<div class=z>Buy {i}</div><{tag} class=y><p>One text that all of the pages share</p></{tag}>" for i in range(n)])
    assert all(t.endswith("One text that all of the pages share") for t in got)


def test_adjoining_notices_all_stand():
    scan = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    found = scan("this wrk is licensd under the gnu general public license version 2 this work is licensed under the gnu general public license version 3")
    assert found[5] == ["gpl", "gpl-2.0", "gpl-3.0"]
    assert [(x["start"], x["end"], x["label"], x["errors"]) for x in found[7]] == [(0, 12, "gpl-2.0", 2), (12, 24, "gpl-3.0", 0)]


def test_adjoining_notices_against_each_alone():
    """Lists of one notice with letters dropped or changed: every one that is found alone is found in the list."""
    rng = random.Random(11)
    for spelled, label in licenses.NOTICES.items():
        scan = licenses.Scanner({}, {spelled: label})
        notice, most, _ = licenses.notice_pattern(spelled)
        exact = [i for w in re.findall(r"\[(.*?)\]", spelled) for i in range(notice.index(w) - 1, notice.index(w) + len(w) + 1)]
        for _ in range(12):
            listed, want, at = [], [], 0
            for _ in range(rng.randrange(2, 7)):
                own = list(notice)
                for k in rng.sample([i for i, c in enumerate(own) if c != " " and 0 < i < len(own) - 1 and " " not in own[i - 1 : i + 2] and i not in exact], rng.randrange(min(3, most + 1))):
                    own[k] = rng.choice(["", "q"])
                alone = scan("".join(own))[7]
                assert len(alone) == 1
                n = "".join(own).count(" ") + 1
                want.append((at, at + n, alone[0]["errors"]))
                at += n
                listed.append("".join(own))
            assert [(x["start"], x["end"], x["errors"]) for x in scan(" ".join(listed))[7]] == want


@pytest.mark.parametrize("block", [10**6, 2])
def test_items_without_an_id_are_searched(spark, block):
    docs = spark.createDataFrame([(1, "so one two three it is"), (2, "clean"), (3, "four five")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "One two three"), (7, "four five")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, benchmark, block=block).collect()}
    assert got == {1: (3, []), 2: (0, []), 3: (2, ["7"])}
    assert [r.doc_id for r in decontaminate.clean_documents(docs, benchmark).collect()] == [2]


def test_rows_that_repeat_an_id_are_places_of_their_own(spark):
    """Whichever text comes first by md5 keeps the shared lines."""
    shared = [f"line {i}" for i in range(30)]
    texts = ["\n".join(shared) + "\nx", "\n".join(shared) + "\ny"]
    for ids, kind in (((5, 5), "long"), ((1, 2), "long"), (("a", "a"), "string")):
        got = line_dedup.line_dedup(spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")).collect()
        assert sorted(r.n_removed > 0 for r in got) == [False, True]


def test_one_row_of_each_group(spark):
    """Rows that repeat an id and a text, an id alone, or nothing."""
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(1, base), (1, base), (1, base + " z"), (2, base), (3, "other words stand here altogether"), (3, "and these are others again yes"), (None, base), (4, None), (5, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    got = sorted((r.doc_id, r.text or "") for r in near_dedup.distinct_documents(df).collect())
    assert [x[0] for x in got] == [1, 3, 3, 4, 5]
    assert {x[1] for x in got if x[0] == 3} == {rows[4][1], rows[5][1]}


def test_null_ids_do_not_multiply(spark):
    base = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, base)] * 40 + [(None, base + " x")] * 40 + [(7, "one two three four five")], "doc_id long, text string")
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == 81 and {r.component_id for r in got if r.doc_id is None} == {None}


def test_versions_and_qualifiers_are_exact():
    scan = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    labels = {
        "Licensed under CC BY-ND 4.0": ["cc-by"],
        "Licensed under CC BY-NC 3.0": ["cc-by"],
        "Mozilla Public License Version 1.1": [],
        "Mozila Public License, Version 2.0": ["mpl-2.0"],
        "Licensed under the Apache License, Version 1.1": ["apache"],
        "This work is licensed under the GNU General Public License version 1": ["gpl"],
        "gnu lesser genral public license": ["lgpl"],
        "gnu leser general public license": [],
        "Licensed under the Apache License, Version 2.07": ["apache"],
    }
    assert {t: scan(t)[5] for t in labels} == labels


def test_notices_against_windows_of_all_places():
    """Brute force: edit distance of the loose words at every place, exact words as they are."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng, notice = random.Random(4), "released under the [mit] license"
    scan = licenses.Scanner({}, {notice: "mit"})
    _, most, _ = licenses.notice_pattern(notice)
    for _ in range(300):
        loose = list("released under the ")
        for _ in range(rng.randrange(4)):
            loose[rng.randrange(1, 15)] = rng.choice("abcxyz")
        word = rng.choice(["mit", "mit", "mit", "bsd", "mitt"])
        text = f"so {''.join(loose)}{word} license it is"
        want = word == "mit" and distance("".join(loose), "released under the ") <= most
        assert bool(scan(text)[7]) == want, text


def test_hits_against_every_place(spark):
    """Windows looked up by hash equal windows compared at every place."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    items = [(str(i), " ".join(rng.choices(words, k=rng.randrange(0, 7)))) for i in range(30)] + [(None, "w1 w2")]
    windows = decontaminate.Windows(items, width=3)
    for _ in range(300):
        own = rng.choices(words, k=rng.randrange(0, 40))
        hit, found = set(), set()
        for item, text in items:
            t = text.split()
            for w in {tuple(t[i : i + 3]) for i in range(max(1, len(t) - 2))} if t else ():
                for at in range(len(own) - len(w) + 1):
                    if tuple(own[at : at + len(w)]) == w:
                        hit.update(range(at, at + len(w)))
                        found |= {item} - {None}
        n, got, names = windows.find(" ".join(own))
        assert (n, set(np.flatnonzero(got).tolist()), names) == (len(own), hit, found)


def test_many_languages_are_learned(spark):
    """No number of languages ends the job; each keeps a text at least."""
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 26) * 4} {chr(97 + i // 26) * 5} wort{i % 700}", f"l{i % 700:03d}", "a", 0) for i in range(1400)], SCHEMA)
    assert len(language.train(docs, sample=3).langs) > 600


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i % 50}", "en", "a", 0) for i in range(3000)], SCHEMA)
    got = common.sample_rows(docs, 20, "lang", by="lang")
    assert len(got) == 20 and len({r.text for r in got}) == 20
    assert len(common.sample_rows(docs, 1000, most_bytes=70)) == 10


def test_cosines_against_plain_vectors():
    """A text's score is the cosine of its TF-IDF vector with the nearest centroid, all computed by dictionaries."""
    model = language.Model({"a": ["the cat sat on the mat", "a dog and a cat"], "b": ["der hund und die katze", "das ist ein haus"]})
    text = "the hund"
    raw = f" {text} ".encode()
    shift, mask = 32 - language.BITS, 2**32 - 1
    tf = collections.Counter()
    for n, base in ((2, 0), (3, 1 << language.BITS)):
        for i in range(len(raw) - n + 1):
            tf[base + ((int.from_bytes(raw[i : i + n], "big") * 2654435761 & mask) >> shift)] += 1
    v = {k: math.log1p(n) * float(model.idf[k]) for k, n in tf.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    cosines = [sum(x * float(c[k]) for k, x in v.items()) / size for c in model.centroids]
    lang, score, _ = model.predict(text)
    assert score == pytest.approx(max(cosines), abs=1e-4) and lang == model.langs[model.of[int(np.argmax(cosines))]]


def test_noisy_or_against_products():
    rng = np.random.default_rng(2)
    weights = rng.normal(0, 1, toxicity.FEATURES).astype(np.float32)
    text = "one two. three four five! six\nseven? eight"
    none = 1.0
    for part in re.split(r"[.!?\n]", text):
        own = part.split()
        if own:
            z = -2.0 + sum(float(weights[toxicity.features(w)].sum()) for w in own)
            none *= 1 - 1 / (1 + math.exp(-z))
    assert toxicity.Scorer(weights, -2.0)(text)[0] == pytest.approx(1 - none, rel=1e-6)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="content has-sidebar"><p>one</p></div>', "one"),
        ('<div id="page" class="no-comments">two</div>', "two"),
        ('<p class="notice-board">three</p>', "three"),
        ("<article><p>teaser</p></article><div class=post>the text itself, and longer</div>", "teaser the text itself, and longer"),
        ("<div class=post>the text</div><div class=site-comments>mine</div>", "the text"),
        ("<div>" * 2000 + "deep", "deep"),
    ],
)
def test_names_are_a_prior(page, text):
    assert html.main_text(page, set()) == text


def test_style_tree_against_brute_force(spark):
    """Entropies and branches' importance of a small site, recounted from its nested lists."""
    site = [("a", ["p", "p"], i) for i in range(4)] + [("a", ["p"], i) for i in range(4, 7)]
    pages = [f"<div class=m>menu</div><div class=t>{''.join(f'<p>page {i} {k}</p>' for k, _ in enumerate(kinds))}</div>" for _, kinds, i in site]
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    got = {r.path: r for r in html.style_tree(df).collect()}
    menu, text = html._child(0, "div.m"), html._child(0, "div.t")
    p = html._child(text, "p")
    look = -(4 / 7 * math.log(4 / 7) + 3 / 7 * math.log(3 / 7)) / math.log(7)
    assert (got[menu].n, got[menu].look, got[menu].content, got[menu].importance) == (7, None, 0.0, 0.0)
    assert (got[p].look, got[p].content, got[p].importance) == (None, pytest.approx(1.0), pytest.approx(1.0))
    assert got[text].look == pytest.approx(look) and got[text].content is None
    assert got[text].importance == pytest.approx((look + html.DECAY) / (1 + html.DECAY))


def test_tree_decides_without_telling_names(spark):
    """Menus and footers in plain divs go because all pages of the host share them, texts under the same tags stay."""
    got = _texts(spark, [f"<div><div class=k1><div>Home</div><div>About us</div></div><div class=k2><div>Text of page {i}</div>{'<div>and more of it</div>' * (i % 4)}</div><div class=k3>All rights reserved</div></div>" for i in range(40)])
    assert got == [" ".join([f"Text of page {i}", *["and more of it"] * (i % 4)]) for i in range(40)]


def test_other_tokenizers_go_through_the_library():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("word_bpe_49k.json")
    own, library = tokens.Encoder(path), Tokenizer.from_file(path)
    text = "Plain words, twice: plain words"
    assert not own.known_steps
    assert np.frombuffer(own([text])[0], own.type).tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_looked_up_once_give_the_librarys_ids():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    own, library = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = ["", None, " ", "\n", " a", "a ", "\na", "a\n", "a b.\nc! d\ne", "x\n\ny", "don't stop, can't", "3 cats, 4.5 (b)", "é è Àb\nç, ÿ.", "  a", "a\tb", "a b a b. b", "<|endoftext|> a", "日本 a", "a" * 50_000, "b, " * 50_000]
    assert own.known_steps
    for _ in range(2):
        got = [np.frombuffer(x, own.type).tolist() for x in own(texts)]
        assert got == [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert own([]) == []


def test_odd_values(spark, odd):
    """What the odd rows give, not just how many they are."""
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    of = {name: sorted(run(odd).collect(), key=key) for name, run in each(spark).items() if name in ("mix", "exact", "near", "benchmark", "language", "toxicity", "licenses", "tokens")}
    assert [r.size for r in of["mix"]] == [6, 6, 0, 0, 0, 60_000, 4, 4]
    assert [r.group_size for r in of["exact"]] == [2, 2, 2, 2, 1, 1, 1, 1]
    assert [r.component_id for r in of["near"]] == [1, 1, 2, 3, 4, 5, 6, None]
    assert [r.n_hit for r in of["benchmark"]] == [4, 4, 0, 0, 0, 0, 0, 0]
    assert [r["items"] for r in of["benchmark"]][:2] == [["10"], ["10"]]
    assert [r.language.lang_pred for r in of["language"]][2:5] == ["und"] * 3
    assert [r.toxicity.score for r in of["toxicity"]][2:5] == [0.0] * 3
    assert all(r.license.labels == [] and r.license.score == 0 for r in of["licenses"])
    assert [r.n_tokens for r in of["tokens"]][2:4] == [1, 1]


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, empty):
        kept, columns = docs, docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = common.materialise(stage(spark, kept, str(tmp_path)), "test")
            assert kept.columns == columns, name
        rows = kept.count()
        assert corpus_pipeline.token_output(spark, kept, str(tmp_path)).count() == rows
