"""Functions against worked-out values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscade.functions import chunking, html, text, urls, vectors

CASES = [
    ("HTTPS://WWW.Example.EDU:443/a/../b/?utm_source=x&b=2&a=1#t", "https://www.example.edu/b/?a=1&b=2", "https://www.example.edu:443/a/../b?utm_source=x&b=2&a=1"),
    ("http://h:8080", "http://h:8080/", "http://h:8080/"),
    ("//h/x", "https://h/x", None),
    ("mailto:x@y", None, None),
    ("http://h/a;p?z=", "http://h/a?z=", "http://h/a;p?z="),
    (None, None, None),
    ("", None, None),
    ("http://h:port/", None, "http://h:port/"),
]


def test_url_forms(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "u string")
    got = df.select(urls.canonical_url_col(F.col("u")), urls.light_url_col(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(c[1], c[2]) for c in CASES]


def test_plain_urls_stay_in_the_jvm_with_the_same_result(spark):
    given = ["https://a.example/x/y.html", "https://a.example/x/../y", "https://A.example/x", "https://a.example", "https://a.example/x//y", "https://a.example/./x/", "http://a.example/x/.."]
    got = spark.createDataFrame([(u,) for u in given], "u string").select(urls.canonical_url_col(F.col("u"))).collect()
    assert [r[0] for r in got] == [urls.canonical_url(u) for u in given]


@pytest.mark.parametrize(("url", "kind"), [("https://h/faculty/x", "faculty"), ("https://h/STAFF/apply", "faculty"), ("https://h/degrees", "programs"), ("https://h/Financial-aid", "scholarships"), ("https://h/apply", "admissions"), ("https://h/", "general")])
def test_page_types(spark, url, kind):
    assert spark.range(1).select(urls.page_type_col(F.lit(url))).first()[0] == kind


def test_slugs_and_segments(spark):
    row = spark.range(1).select(urls.tenant_slug_col(F.lit("https://WWW.a.example:80/x")), urls.tenant_slug_col(F.lit("nothing")), urls.first_segment_col(F.lit("https://h//x/y")), urls.first_segment_col(F.lit("https://h")), urls.skipped_url_col(F.lit("https://h/a.PDF?x")), urls.skipped_url_col(F.lit("ftp://h/a")), urls.skipped_url_col(F.lit("https://h/a"))).first()
    assert tuple(row) == ("a-example", "university", "x", "general", True, True, False)


@pytest.mark.parametrize(("given", "low", "high"), [("", 0, 0), ("word", 1, 1), (" ".join("abcdefghi"), 10, 15), ("w " * 100, 130, 130)])
def test_token_estimates(spark, given, low, high):
    got = spark.range(1).select(text.token_estimate_col(F.lit(given))).first()[0]
    assert low <= got <= high == max(high, html.estimated_tokens(given))


def test_text_functions(spark):
    row = spark.range(1).select(text.tokens_col(F.lit("Ab-c9 É")), text.squeezed_col(F.lit(" a  b\n")), text.first_line_col(F.lit("\n \n `\"A  b\"` \nc")), text.snippet_col(F.lit("abcdef"), 3), text.url_label_col(F.lit("https://h/a/")), text.citations_col(F.lit("x [source 2] [Source 1] [source 2](u)"))).first()
    assert row[0] == ["ab", "c9"] and row[1] == "a b" and row[2] == "A b" and row[3] == "abc..." and row[4] == "h/a" and row[5] == [1, 2]


def test_linked_citations(spark):
    made = F.create_map(F.lit(1), F.lit("http://a/$1"), F.lit(12), F.lit("http://b"))
    got = spark.range(1).select(text.linked_citations_col(F.lit("x [source 1] y [source 12](z) [source 3] [Source 12]"), made)).first()[0]
    assert got == "x [source 1](http://a/$1) y [source 12](z) [source 3] [Source 12](http://b)"


def test_heuristic_rerank(spark):
    score = lambda q, t, h: spark.range(1).select(text.heuristic_rerank_col(F.lit(q), F.lit(t), F.lit(h))).first()[0]
    assert score("a b", "a a x y z w v u", "b") == pytest.approx(min(1, 4 * 2 / 8 + 0.4 / 2))
    assert score("q r", "one two three four five six seven eight nine q", None) == pytest.approx(0.4)
    assert score("", "x", "y") == 0 and score("x", "", "y") == 0


def test_hashed_vectors_have_length_one(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, None)], "id long, t string")
    rows = vectors.hashed_components(df, "id", "t").collect()
    assert {r["id"] for r in rows} == {1} and sum(r["value"] ** 2 for r in rows) == pytest.approx(1)


def test_digest_vectors():
    a, b = vectors.digest_vector("a", 128), vectors.digest_vector("b", 128)
    assert len(a) == 128 and np.linalg.norm(a) == pytest.approx(1, abs=1e-6) and not np.allclose(a, b) and np.array_equal(a, vectors.digest_vector("a", 128))


def test_projection_and_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 4.0, 6.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine_col(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1) and got[1] is None and got[2] is None
    short, long = df.select(vectors.project_udf(2)("a"), vectors.project_udf(5)("a")).first()
    assert len(short) == 2 and math.hypot(*short) == pytest.approx(1) and long == [1, 2, 3, 0, 0]


PAGE = """<html><head><title> A &amp; B </title></head><body><nav><a href="/home">Home</a></nav><main><h1>Top</h1><p>First part.<p>Second <a href='x.html#y'>link</a>.
<h2>Below</h2><ul><li>one<li>two</ul><table><tr><th>GPA</th><td>3.5</td></tr></table><dl><dt>T</dt><dd>d</dd></dl></main><footer>foot</footer></body></html>"""


def test_html_functions():
    assert html.title_of(PAGE) == "A & B" and html.title_of("<h1>x</h1>") == "x" and html.title_of("") == "Untitled"
    assert html.links_of(PAGE, "https://h/a/b") == ["https://h/a/x.html#y", "https://h/home"]
    assert html.sections_of(PAGE) == [("Top", "First part.\nSecond link ."), ("Below", "one\ntwo")]
    assert html.sections_of("") == [] and html.sections_of("<div>x</div>") == [("General", "x")]
    assert "Home" not in html.body_text_of(PAGE)


def test_structural_chunks():
    limits = html.ChunkLimits(1, 40, 60)
    got = html.structural_chunks_of(PAGE, limits)
    assert [c[1] for c in got] == list(range(len(got))) and got[0][2] == ["Top"] and got[1][2] == ["Top", "Below"]
    assert any("GPA | 3.5" in c[0] and "T: d" in c[0] for c in got)
    assert html.structural_chunks_of("", limits) == [] and len(html.structural_chunks_of("<p>x</p>")) == 1
    long = "<h2>a</h2>" + "".join(f"<p>{'word ' * 20}{n}. {'more ' * 20}</p>" for n in range(20))
    many = html.structural_chunks_of(long, limits)
    assert len(many) > 5 and all(c[3] <= 60 + 5 for c in many)
    staff = "".join(f'<div class="staff-profile"><h3>{n}</h3><p>Labs</p></div>' for n in ("Alice", "Bob", "Carol"))
    people = html.structural_chunks_of(staff, page_type="faculty")
    assert [c[2] for c in people] == [["Alice"], ["Bob"], ["Carol"]]


def test_sentence_chunks():
    sentences = [f"Sentence number {n} is here." for n in range(30)]
    chunks = chunking.sentence_chunks(" ".join(sentences), 120, 40)
    assert all(len(c) <= 120 for c in chunks) and chunks[0].startswith(sentences[0]) and chunks[-1].endswith(sentences[-1])
    assert all(a.split(". ")[-1].rstrip(".") in b for a, b in zip(chunks, chunks[1:]))
    assert chunking.sentence_chunks("", 10, 2) == [] and chunking.sentence_chunks(None) == []
    assert all(len(c) <= 10 for c in chunking.sentence_chunks("aaa bbb ccc ddd eee fff", 10, 2))
