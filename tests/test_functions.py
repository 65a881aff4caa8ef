"""Scalar functions and small operators on literal values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import geometry, text
from sparkfolio.model import exploded
from sparkfolio.operators import images, language, marks
from sparkfolio.operators.exports import documents_of_texts
from sparkfolio.operators.sequences import joined_text
from sparkfolio.sources.notes import Unreadable
from sparkfolio.sources.package_readers import mathml_tex
from sparkfolio.streaming.watch import windowed


def values(spark, kind, given, made):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(given)], f"k int, v {kind}").orderBy("k").select(made(F.col("v")).alias("x")).collect()
    return [r["x"] for r in rows]


def test_texts(spark):
    assert values(spark, "string", ["12", "x+1", "q", "a?"], text.superscript)[:1] == ["¹²"] and values(spark, "string", ["10", "a?"], text.subscript)[0] == "₁₀"
    assert values(spark, "string", ["a(b)\\c"], text.escape_pdf) == ["a\\(b\\)\\\\c"]
    assert values(spark, "string", ["שלום", "abc", "مرحبا", None], text.is_right_to_left) == [True, False, True, None]
    got = values(spark, "string", ["data:text/plain;charset=utf-8;base64,aGk=", "data:,x", "http://x", None], text.data_uri)
    assert (got[0]["mime"], bytes(got[0]["content"]), got[1:]) == ("text/plain", b"hi", [None, None, None])
    assert values(spark, "string", ["12 %", "-1.234,50 €", "(3)", "12 apples", ""], text.is_figure) == [True, True, True, False, False]
    assert values(spark, "double", [0.0, 0.5, 1.5, 30.0], text.duration) == ["0:00:00", "12:00:00", "36:00:00", "720:00:00"]
    assert values(spark, "bigint", [999, 1500, 61_000], text.duration_text) == ["999 ms", "1.5 s", "1 min 1 s"]
    assert [(r["row"], r["column"]) if r else r for r in values(spark, "string", ["$B$3", "aa10", "3B"], text.cell_place)] == [(2, 1), (9, 26), None]
    assert values(spark, "array<string>", [["a para-", "graph goes", "on"], ["in-", "und aus"], ["CD-", "ROM"], ["soft­", "ware"], []], joined_text) == ["a paragraph goes on", "in- und aus", "CD-ROM", "software", ""]


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 8.0, 25.0, 12.0), (0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 2.0, 2.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    a, b = geometry.box("a"), geometry.box("b")
    assert [tuple(r) for r in df.select(geometry.horizontal_overlap(a, b), geometry.vertical_overlap(a, b)).collect()] == [(0.5, 0.5), (0.0, 0.0)]
    turns = spark.range(5).select(geometry.quarter_turned(F.lit(2.0), F.lit(3.0), F.lit(10.0), F.lit(20.0), F.col("id")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in turns] == [(2, 3), (3, 18), (8, 17), (7, 2), (2, 3)]


def test_documents_as_lines(spark):
    docs = documents_of_texts(spark.createDataFrame([(3, "one\ntwo\n\nthree"), (4, "")], "doc_id bigint, text string"))
    assert [(r["source"], r["block_ord"], r["line_ord"], r["text"]) for r in exploded(docs).orderBy("block_ord", "line_ord").collect()] == [("3", 0, 0, "one"), ("3", 0, 1, "two"), ("3", 1, 0, "three")]


def test_formulas():
    assert mathml_tex("<math><mfrac><mi>a</mi><msup><mi>b</mi><mn>2</mn></msup></mfrac><mo>≤</mo><msqrt><mi>x</mi></msqrt></math>") == r"\frac{a}{b^{2}}\le \sqrt{x}"
    assert mathml_tex("<math><msubsup><mi>x</mi><mn>1</mn><mn>2</mn></msubsup><mroot><mi>y</mi><mn>3</mn></mroot><mtext>and</mtext></math>") == r"x_{1}^{2}\sqrt[3]{y}\text{and}"
    with pytest.raises(Unreadable):
        mathml_tex("<math>")


def test_names_of_languages():
    assert [language.lookup(x) for x in ("de-AT", "Deutsch", "eng", "pt_BR", "FR", "xx")] == ["de", "de", "en", "pt", "fr", None]


def test_ink_and_specks():
    page = np.full((100, 200, 3), 255, np.uint8)
    assert images.coloured_ink(page) is None
    page[20:60, 30:80] = (200, 20, 30)
    mask = images.coloured_ink(page)
    assert mask.sum() == 40 * 50 and mask[20, 30] and not mask[0, 0]
    grey = np.full((100, 100), 255, np.uint8)
    grey[5:95:7, 5:95:7] = 0
    assert images.despeckled(grey).min() == 255
    grey[:] = 255
    grey[50, 50] = 0
    assert images.despeckled(grey).min() == 0  # too few to be noise


def test_windows_of_events(spark):
    rows = [("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 2.0), ("2024-01-01 00:01:10", "b", 4.0)]
    events = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    got = {(str(r["window"]["start"])[11:], r["event_type"], r["n"], r["total"]) for r in windowed(events, "1 minute", "1 minute").collect()}
    assert got == {("00:00:00", "a", 2, 3.0), ("00:01:00", "b", 1, 4.0)}
    assert windowed(events, "1 minute", "2 minutes", "1 minute").count() == 4


def test_characters_and_stamps(spark):
    made = lambda text, at: [(c, float(x), float(x + 8)) for c, x in zip(text, at, strict=True)]
    rows = [(made("ab cd", (0, 10, 20, 30, 40)),), (made("abcd", (0, 10, 40, 50)),), (made("a.b", (0, 40, 80)),), ([],)]
    df = spark.createDataFrame(rows, "c array<struct<ch:string,x0:double,x1:double>>")
    got = df.select(marks.words_of(F.col("c")).alias("w"), marks.restored_spaces(F.col("c")).alias("t")).collect()
    assert [[(w["text"], w["x0"], w["x1"]) for w in r["w"]] for r in got] == [[("ab", 0, 18), ("cd", 30, 48)], [("abcd", 0, 58)], [("a.b", 0, 88)], []]
    assert [r["t"] for r in got] == ["ab cd", "ab cd", "a.b", ""]
    kind = "page int, text string, x0 double, y0 double, x1 double, y1 double"
    stamps = spark.createDataFrame([(1, "RE AD", 0.0, 0.0, 10.0, 10.0), (1, "elsewhere", 0.0, 0.0, 10.0, 10.0), (2, "read", 0.0, 0.0, 10.0, 10.0), (1, "new", 0.0, 0.0, 9.0, 9.0)], kind)
    lines = spark.createDataFrame([(1, "Read", 0.0, 1.0, 10.0, 11.0), (1, "elsewhere", 50.0, 0.0, 60.0, 10.0)], kind)
    assert sorted((r["page"], r["text"]) for r in marks.unread(stamps, lines, "page").collect()) == [(1, "elsewhere"), (1, "new"), (2, "read")]
