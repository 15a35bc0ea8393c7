"""Books, the index as a folder, benchmark files, requests and commands, on files that the tests write."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folio import service
from folio.operators import models
from folio.sources import benchmarks, books, index
from folio.sources.books import BookSpec

SPEC = BookSpec("iron", "THE IRON SHORE", 1, ("THE IRON SHORE", "A Tale", "by Nobody"), {"PROLOGUE": 1, "ANA": 2, "BEN": 1}, {"BENN": "BEN"}, {"THE EXILE": "ANA"}, "APPENDIX", None, (), r"^\d+ IRON SHORE$")
TEXT = """THE IRON SHORE
A Tale
by Nobody
PROLOGUE
It began
at sea.
Page 3

The storm rose.
CHAPTER 1
ANA
Ana woke early.

12 IRON SHORE
BENN
Ben slept   late.
THE EXILE
She left.
APPENDIX
Nothing of this is kept.
"""


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def text_book(tmp_path):
    (tmp_path / "iron.txt").write_bytes(TEXT.replace("\n", "\r\n").encode())
    return str(tmp_path / "iron.txt")


def test_text_book(spark, text_book):
    corpus = books.read_books(spark, [text_book], [SPEC])
    assert rows(corpus.chapters, "sequence", "chapter_id", "chapter_title", "pov", "text") == [
        (1, "iron-001-prologue", "PROLOGUE", "PROLOGUE", "It began at sea.\n\nThe storm rose."),
        (2, "iron-002-ana-1", "ANA I", "ANA", "Ana woke early."),
        (3, "iron-003-ben-1", "BEN I", "BEN", "Ben slept late."),
        (4, "iron-004-ana-2", "THE EXILE", "ANA", "She left."),
    ]
    assert rows(corpus.paragraphs, "paragraph_id", "word_start", "word_end")[:2] == [("iron-001-prologue-p0001", 0, 4), ("iron-001-prologue-p0002", 4, 7)]
    assert dict(rows(corpus.counts, "name", "n")) == {"page_markers_removed": 1, "chapter_markers_removed": 1, "blank_lines_removed": 2, "ocr_headers_removed": 1, "appendix_sections_removed": 1, "benn_headings_corrected": 1, "title_author_lines_removed": 3}
    assert rows(corpus.sources, "book", "title", "sequence", "format") == [("iron", "THE IRON SHORE", 1, "txt")]
    assert len(books.combined_hash(corpus.sources)) == 64
    assert ("iron", None, 4, 15) in [(r.book, r.pov, r.n_chapters, r.n_words) for r in books.summary(corpus).collect()]


@pytest.mark.parametrize(
    ("change", "problem"),
    [(("A Tale", "A Lie"), "not the expected ones"), (("THE IRON SHORE\n", "OTHER\n"), "unknown book"), (("It began", "It beg\xe4n"), "ASCII"), (("PROLOGUE\n", ""), "prose before"), (("THE EXILE", "Ana"), "not as expected"), (("Ana woke early.\n", ""), "without prose|not as expected")],
)
def test_odd_text_books(spark, tmp_path, change, problem):
    (tmp_path / "x.txt").write_bytes(TEXT.replace(*change, 1).encode("latin-1"))
    with pytest.raises(Exception, match=problem):
        books.read_books(spark, [str(tmp_path / "x.txt")], [SPEC]).chapters.collect()


def epub(chapters, title="The Shore of Iron"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(chapters)))
        refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
        z.writestr("OEBPS/content.opf", f'<package xmlns="urn:o" xmlns:dc="urn:d"><metadata><dc:title>{title}</dc:title></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for k, (heading, prose) in enumerate(chapters):
            z.writestr(f"OEBPS/c{k}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><body><h1>{heading}</h1>{"".join(f"<p>{p}</p>" for p in prose)}</body></html>')
    return out.getvalue()


def test_epub_book(spark, tmp_path):
    spec = BookSpec("epub", "Shore", 2, (), {"ANA": 2}, {}, {"THE EXILE": "ANA"}, None, "shore of iron", ("lone gull",))
    prose = [f"Line {i} with a soft\u00adened word" for i in range(9)] + ["One lone   gull"]
    (tmp_path / "b.epub").write_bytes(epub([("Contents", ["skip"]), ("Ana", prose), ("The Exile", prose)]))
    corpus = books.read_books(spark, [str(tmp_path / "b.epub")], [spec, SPEC])
    assert rows(corpus.chapters, "chapter_id", "chapter_title") == [("epub-001-ana-1", "ANA I"), ("epub-002-ana-2", "THE EXILE")]
    assert corpus.paragraphs.count() == 20 and corpus.paragraphs.where("text = 'Line 0 with a softened word'").count() == 2
    assert dict(rows(corpus.counts, "name", "n")) == {"epub_spine_documents_skipped": 1, "epub_chapter_documents_read": 2, "epub_paragraphs_preserved": 20}
    (tmp_path / "short.epub").write_bytes(epub([("Ana", ["only one"])]))
    with pytest.raises(Exception, match="has 1 paragraphs"):
        books.read_books(spark, [str(tmp_path / "short.epub")], [spec]).chapters.collect()
    for wrong in ([], [str(tmp_path / "b.epub")] * 2):
        with pytest.raises(ValueError):
            books.read_books(spark, wrong, [spec])


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    texts = ["the quiet harbour " + " ".join(f"w{i}" for i in range(300)), " ".join(f"v{i}" for i in range(200)) + " a quiet place", "harbour lights"]
    docs = spark.createDataFrame([(k, "one" if k < 2 else "two", "ANA" if k else "BEN", t) for k, t in enumerate(texts)], "doc_id long, book string, pov string, text string")
    return index.build_index(docs, root, models.DigestEncoder(), source_sha256="ab" * 32)


def test_index_round_trip(spark, built):
    found = index.load_index(spark, built, models.DigestEncoder())
    assert built.endswith("digest-16-short-abababababab") and found.manifest["chunk_count"] == found.chunks.count()
    assert [p for (p,) in rows(found.chunks, "pos")] == list(range(found.chunks.count()))
    order = rows(found.chunks, "pos", "doc_id", "ordinal")
    assert [x[1:] for x in order] == sorted(x[1:] for x in order)
    assert index.context_embeddings(found.chunks).count() == found.chunks.count()
    with pytest.raises(ValueError, match="made with"):
        index.load_index(spark, built, type("Other", (models.DigestEncoder,), {"revision": "2"})())
    odd = {"chunks": found.chunks.withColumn("word_end", F.col("word_end") + 1), "paragraphs": found.paragraphs}
    assert {r.problem: r.n > 0 for r in index.violations(odd, 1).collect()} == {"chunks more or fewer than stated": True, "positions that repeat": False, "offsets unlike the text": True, "vectors not of norm 1": False, "vectors of several sizes": False, "paragraphs with gaps": False}


def test_service(spark, built, capsys):
    own = service.Service(spark, service.Settings(built))
    assert own.health() == {"status": "ok", "loaded": False} and own.ready()
    assert [(b["book"], b["povs"]) for b in own.catalog()] == [("one", ["ANA", "BEN"]), ("two", ["ANA"])]
    said = own.search(service.Request("Quiet  harbour", "lexical", page_size=1))
    assert said["pagination"] == {"page": 1, "page_size": 1, "total_results": 3, "total_pages": 3, "has_next": True}
    assert said["book_counts"] == [{"book": "one", "count": 2}, {"book": "two", "count": 1}]
    assert said["results"][0]["preview"]["text"].startswith("the quiet harbour") and said["results"][0]["after"].startswith("w177")
    hybrid = own.search(service.Request("quiet harbour", book="ONE", pov="ben"))
    assert [r["chapter"] for r in hybrid["results"]] == [0] * len(hybrid["results"]) and hybrid["results"][0]["exact"]
    with pytest.raises(service.BadRequest):
        own.search(service.Request("x", book="two", pov="ben"))
    assert service.main(["--index", built, "similar", "0"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["rank"] == 1
    assert service.main(["--index", built, "similar", "99"], spark) == 2
    assert not service.Service(spark, service.Settings("/nowhere")).ready()


def test_requests():
    assert service.Request("a  b", pov="jo").normal() == service.Request("a b", top=5, povs=("JO",))
    assert service.Request("a", "lexical").normal() == service.Request("a", "lexical", page=1, page_size=20)
    for wrong in ({"query": " "}, {"query": "x" * 301}, {"top": 11}, {"top": 0}, {"page": 1}, {"mode": "lexical", "top": 3}, {"mode": "dense"}, {"pov": "a", "povs": ("b",)}, {"povs": ()}, {"pov": "1"}, {"book": "a b"}, {"top": True}):
        with pytest.raises(service.BadRequest):
            service.Request(**({"query": "q"} | wrong))


CASE = {"id": "a", "query": "who  went", "category": "plot", "rationale": "r", "expected_passages": [{"chapter_id": "c", "word_start": 0, "word_end": 5}]}
WHOLE = {"schema_version": 2, "name": "n", "split": "acceptance", "status": "sealed", "corpus": {"sources": [{"book_id": "b", "source_sha256": "0" * 64}]}, "passage_matching": {"strategy": "overlap"}, "cases": [CASE | {"verification": {"status": "verified"}}]}


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(WHOLE))
    found = benchmarks.load(tmp_path / "b.json")
    assert (found.split, found.status, found.strategy, found.least) == ("acceptance", "sealed", "overlap", 20)
    cases, targets = found.frames(spark)
    assert rows(cases, "item_id", "query", "name_usage") == [("a", "who went", "unspecified")]
    assert rows(targets, "doc_id", "s", "e", "grade") == [("c", 0, 5, 3)]
    plain = benchmarks.parsed([CASE | {"id": "z"}])
    both = benchmarks.union([found, benchmarks.replace(plain, strategy="overlap")])
    assert (both.name, both.split, both.status, len(both.cases)) == ("combined", "development", "draft", 2)
    for parts in ([], [found, found], [found, plain]):
        with pytest.raises(ValueError):
            benchmarks.union(parts)
    assert benchmarks.subset(found, found.cases, "part").status == "draft"
    benchmarks.write_report({"b": 1, "a": "é"}, tmp_path / "deep" / "r.json")
    assert (tmp_path / "deep" / "r.json").read_text() == '{\n  "a": "\\u00e9",\n  "b": 1\n}\n'


@pytest.mark.parametrize(
    "wrong",
    [
        [], {}, WHOLE | {"schema_version": 3}, WHOLE | {"split": "x"}, WHOLE | {"name": ""}, WHOLE | {"corpus": {}}, WHOLE | {"corpus": {"source_sha256": "xy"}}, WHOLE | {"passage_matching": {"strategy": "overlap", "minimum_overlap_words": True}}, WHOLE | {"cases": [CASE]},
        WHOLE | {"cases": [CASE | {"verification": {"status": "draft"}}]}, [CASE, CASE], [CASE | {"query": " "}], [CASE | {"expected_chapter_ids": ["d"]}], [CASE | {"expected_passages": []}], [CASE | {"scene_id": "s"}], [CASE | {"query_style": "odd", "name_usage": "named", "scene_id": "s"}],
        [CASE, CASE | {"id": "b", "expected_passages": None, "expected_chapter_ids": ["c"]}], [CASE | {"expected_passages": [{"chapter_id": "c", "word_start": 5, "word_end": 5}]}], [CASE | {"expected_passages": [{"chapter_id": "c", "word_start": 0, "word_end": 5, "relevance": 4}]}],
    ],
)
def test_odd_benchmarks(wrong):
    with pytest.raises(ValueError):
        benchmarks.parsed(wrong)
