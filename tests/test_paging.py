"""Pages as running text, and reports of findings, on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import metrics, paging, reports, search


def test_margins_and_page_numbers_go(spark):
    rows = [("a", p, 0, "header", f"Annual  report {p}") for p in range(1, 5)] + [("a", p, 1, "body", "Annual report 1") for p in range(1, 5)] + [("a", p, 2, "footer", f"Page {p} of 4") for p in range(1, 5)]
    rows += [("a", 1, 3, "footer", "once"), ("b", 1, 0, "header", "alone"), ("b", 1, 1, "footer", "7"), ("c", 1, 0, "header", "both"), ("c", 2, 0, "header", "both"), ("c", 2, 1, "footer", "- 2 -")]
    lines = spark.createDataFrame(rows, "doc string, page int, ord int, zone string, text string")
    assert {tuple(r) for r in paging.boilerplate(lines, "doc").collect()} == {("a", "annual report #"), ("a", "page # of #"), ("c", "both")}
    kept = sorted((r["doc"], r["page"], r["text"]) for r in paging.without_boilerplate(lines, "doc").collect())
    assert kept == [("a", 1, "Annual report 1"), ("a", 1, "once"), *(("a", p, "Annual report 1") for p in (2, 3, 4)), ("b", 1, "7"), ("b", 1, "alone")]


def test_headings_that_repeat_at_the_edge(spark):
    rows = [("d", p, k, kind, text) for p in range(4) for k, (kind, text) in enumerate([("heading", "Chapter 1" if p < 3 else "Chapter one"), ("heading", "Same inside"), ("paragraph", "x")])]
    blocks = spark.createDataFrame(rows, "doc string, page int, ord int, kind string, text string")
    assert [tuple(r) for r in paging.repeated_headings(blocks, "doc").collect()] == [("d", "chapter #")]


def test_levels_follow_the_anchor(spark):
    rows = [("d", float(s)) for s in (40, 37, 36, 33, 30, 20, 18, 17)]
    got = {r["size"]: r["level"] for r in paging.heading_levels(spark.createDataFrame(rows, "doc string, size double"), "doc", "size").collect()}
    assert got == {40: 1, 37: 1, 36: 1, 33: 2, 30: 2, 20: 3, 18: 3, 17: 4}
    many = {r["level"] for r in paging.heading_levels(spark.createDataFrame([("d", 2.0**k) for k in range(9)], "doc string, size double"), "doc", "size").collect()}
    assert many == {1, 2, 3, 4, 5, 6}


def test_lines_of_a_paragraph(spark):
    made = lambda rows: spark.createDataFrame([([(t, 100.0 + 10 * len(t), 20.0, 10.0) for t in rows],)], "l array<struct<text:string,x1:double,height:double,char:double>>").select(paging.joined_lines(F.col("l"), F.lit(500.0)).alias("t")).first()["t"]
    assert made(["a line that reaches the very edge of it", "and goes on here"]) == "a line that reaches the very edge of it and goes on here"
    assert made(["Dear all,", "A new sentence begins here"]) == "Dear all,\nA new sentence begins here"
    assert made(["a line that nearly reaches the edge", "goes on"]) == "a line that nearly reaches the edge goes on" and made(["one"]) == "one"
    assert made([]) == ""


def test_paragraphs_over_pages(spark):
    rows = [("d", 1, 0, "heading", "Title"), ("d", 1, 1, "paragraph", "It begins on a page and is con-"), ("d", 2, 0, "paragraph", "tinued on the next,"), ("d", 3, 0, "paragraph", "Which ends it."), ("d", 4, 0, "paragraph", "A new one."), ("d", 5, 0, "heading", "small heading"), ("d", 6, 0, "paragraph", "all")]
    got = [tuple(r) for r in paging.joined_pages(spark.createDataFrame(rows, "doc string, page int, ord int, kind string, text string"), "doc").orderBy("page", "ord").collect()]
    assert got == [("d", 1, 0, "heading", "Title"), ("d", 1, 1, "paragraph", "It begins on a page and is continued on the next, Which ends it."), ("d", 4, 0, "paragraph", "A new one."), ("d", 5, 0, "heading", "small heading"), ("d", 6, 0, "paragraph", "all")]


def test_lists_and_listings(spark):
    one = spark.createDataFrame([([10.0, 30.0, 31.0, 50.0, 30.0, 9.0, 20.0],)], "x array<double>")
    assert one.select(paging.nested(F.col("x"), 2.0).alias("d")).first()["d"] == [0, 1, 1, 2, 1, 0, 1]
    rows = [(["def f(x):", "    return x + 1", "y = f(2)"], True), (["A sentence stands here.", "Another one follows it."], False), (['{', '  "a": 1,', '  "b": [2]', "}"], True), (["x = 1"], False), ([], False)]
    df = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(rows)], "k int, l array<string>")
    assert [r["c"] for r in df.orderBy("k").select(paging.is_listing(F.col("l")).alias("c")).collect()] == [w for _, w in rows]


FILES = [("a", "ok"), ("b", "ok"), ("c", "error"), ("d", "ok"), ("e", "ok")]
FOUND = [("a", "marking", "de", 3, "GEHEIM", 2, 5.0, 1.0, None), ("a", "mention", "de", 4, "STRENG GEHEIM", 1, 5.0, 1.0, None), ("b", "term", None, None, "x", 1, 0.0, 0.0, "medium"), ("d", "marking", "tlp", 0, "TLP:CLEAR", 1, 0.0, 0.0, None)]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame(FILES, "source string, status string")
    return files, spark.createDataFrame(FOUND, "source string, kind string, scheme string, level int, label string, page int, y0 double, x0 double, severity string")


def test_report_of_files(found):
    files, findings = found
    rows = reports.report_rows(files, findings)
    assert tuple(rows.columns) == reports.REPORT_COLUMNS and len(rows.columns) == 17
    assert sorted((r["source"], r["status"], r["kind"] or "") for r in rows.collect()) == [("a", "ok", "marking"), ("a", "ok", "mention"), ("b", "ok", "term"), ("c", "error", ""), ("d", "ok", "marking"), ("e", "ok", "")]
    of = reports.of_files(files, findings)
    tripped = lambda *g: sorted(r["source"] for r in of.where(reports.trips(*g)).collect())
    assert (tripped("any"), tripped("none"), tripped("grade", 3), tripped("grade", 4), tripped("severity", "medium"), tripped("severity", "high")) == (["a", "b"], [], ["a"], [], ["b"], [])
    assert tuple(reports.summary(of, reports.trips("any")).first()) == (5, 1, 1, 1, 2, 2)
    assert [r["status"] for g in (("any",), ("none",)) for r in reports.exit_status(of, reports.trips(*g)).collect()] == [3, 1]
    assert {tuple(r) for r in reports.tally(findings).collect()} == {("GEHEIM", 1, 1), ("TLP:CLEAR", 1, 1)}
    lines = {r["source"]: json.loads(r["line"]) for r in reports.as_json_lines(files, findings).collect()}
    assert [f["page"] for f in lines["a"]["findings"]] == [1, 2] and lines["c"] == {"source": "c", "status": "error"}
    for bad in (("all",), ("grade", None), ("severity", "huge")):
        with pytest.raises(ValueError):
            reports.trips(*bad)


def test_boxes_are_assigned_once(spark):
    box = "page int, id bigint, x0 double, y0 double, x1 double, y1 double"
    expected = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 20.0, 0.0, 30.0, 10.0), (2, 3, 0.0, 0.0, 1.0, 1.0)], box)
    found = spark.createDataFrame([(1, 7, 1.0, 0.0, 11.0, 10.0), (1, 8, 0.0, 0.0, 9.0, 10.0), (1, 9, 29.0, 0.0, 39.0, 10.0), (3, 4, 0.0, 0.0, 1.0, 1.0)], box)
    assert {tuple(r) for r in metrics.judged_terms(expected, found, ["page"]).collect()} == {(1, 1, 2, 1), (2, 0, 0, 1), (3, 0, 1, 0)}


def test_closest_lines_and_composed_form(spark):
    lines = spark.createDataFrame([(1, "an open licence for all"), (1, "the open license"), (1, "nothing"), (1, "open licens text"), (2, " ")], "doc_id int, text string")
    got = [(r["doc_id"], r["text"]) for r in search.closest_lines(lines, "open license", ["doc_id"], 2).orderBy(F.desc("score")).collect()]
    assert got == [(1, "the open license"), (1, "an open licence for all")]
    df = spark.createDataFrame([("é",), ("plain",), (None,)], "t string")
    assert [r["t"] for r in df.select(search.composed(F.col("t")).alias("t")).collect()] == ["é", "plain", None]
