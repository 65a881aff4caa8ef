"""Queries against their SQL twins, layout and pixels on literals, the note store, the watched folder."""

import html
import json
import os
import re
import time

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from sparkfolio import queries as core
from sparkfolio.operators import images, terms
from sparkfolio.operators.exports import documents_of_texts, export
from sparkfolio.operators.layout import Box, dehyphenated, lay_out, reading_order
from sparkfolio.operators.store import sync
from sparkfolio.operators.tables import column_bands, gutter, place
from sparkfolio.plans import findings
from sparkfolio.streaming.watch import to_json_lines, watched

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(core.ORACLES[name])
    got = core.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(got.columns)
    rows = lambda columns, data: sorted(repr(tuple(plain(r[columns.index(c)]) for c in order)) for r in data)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_queries_without_sql_are_checked_below():
    assert set(core.QUERIES) - set(core.ORACLES) == {"find_terms", "find_fuzzy", "severity_report", "markings_report", "html_blocks", "html_block_counts", "html_notes", "text_notes"}


@pytest.mark.parametrize("profile", [findings.PROFILE, findings.FUZZY])
def test_pages_that_are_passed_over_hold_no_hit(spark, monkeypatch, profile):
    """Every document is searched twice: with the first look at its letters, and without."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    wanted = terms.parse(profile)
    search = lambda: [terms.find_on_page(*(lambda p: (p[0], wanted, p[1]))(terms.lines_of(t or ""))) for t in texts]
    fast = search()
    monkeypatch.setattr(terms, "candidates", lambda lines, p: list(p.terms))
    assert fast == search() and any(fast)


def test_hits_and_severities(spark):
    hits = core.QUERIES["find_terms"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain_words = {d for d, t in texts.items() if re.search(r"(?i)\blicen[sc]e\b", t or "")}
    assert plain_words and plain_words <= {h["doc_id"] for h in hits if h["term"] == "license"}
    for h in (h for h in hits if h["how"] == ["exact"]):
        assert h["text"].lower() in texts[h["doc_id"]].lower()
    ranks = ["info", "low", "medium", "high", "critical"]
    want = {}
    for h in hits:
        top, n = want.get(h["doc_id"], ("info", 0))
        want[h["doc_id"]] = max(top, h["severity"], key=ranks.index), n + 1
    got = {r["doc_id"]: (r["severity"], r["n_hits"]) for r in core.QUERIES["severity_report"](spark, SF).collect()}
    assert got == {d: v for d, v in want.items() if ranks.index(v[0]) >= 2}
    for r in core.QUERIES["find_fuzzy"](spark, SF).collect():
        assert 0 < r["score"] <= 1 and r["how"] and r["text"].replace("\n", " ").split()[0] in texts[r["doc_id"]]


def test_markings_of_the_tables_and_of_literal_texts(spark):
    got = {(r["doc_id"], r["kind"], r["label"], r["reason"]) for r in core.QUERIES["markings_report"](spark, SF).collect()}
    assert got == {(-1, "marking", "VS-NfD", "standalone"), (-2, "mention", "VS-NfD", "compound word"), (-4, "marking", "NATO RESTRICTED", "standalone"), (-4, "marking", "SECRET", "standalone")}


def test_pages_as_blocks_and_notes(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    blocks = {}
    for r in core.QUERIES["html_blocks"](spark, SF).collect():
        blocks.setdefault(r["page_id"], []).append(r)
    counts = {r["page_id"]: r["n_blocks"] for r in core.QUERIES["html_block_counts"](spark, SF).collect()}
    notes = {r["path"]: r for r in core.QUERIES["html_notes"](spark, SF).collect()}
    letters, roots = lambda t: re.sub(r"\W", "", html.unescape(t)), []
    for page, source in pages.items():
        own = sorted(blocks[page], key=lambda b: b["block_ord"])
        assert counts[page] == len(own)
        heading = next(b for b in own if b["kind"] == "heading")
        assert heading["level"] == 1 and letters(heading["text"]) == letters(re.sub("<[^>]*>", "", re.search("<h1>(.*?)</h1>", source, re.S)[1]))
        note = notes[f"{page}.html"]
        assert note["status"] == "ok" and letters(note["title"]) == letters(re.search("<title>(.*?)</title>", source, re.S)[1])
        article = letters(re.sub("<[^>]*>", " ", re.search("<article>(.*)</article>", source, re.S)[1]))
        inside = [letters(re.sub(r"\]\([^)]*\)|[*`~\\\[\]]", " ", b["text"])) in article for b in own]
        body = letters(re.sub("<[^>]*>", " ", re.sub(r"(?s)^.*<body>|<(nav|script|style)>.*?</\1>", "", source)))
        roots.append(len(article) >= 0.5 * len(body))
        assert all(inside) == roots[-1]  # a smaller article isn't all of the page's content
    assert True in roots and False in roots


def test_documents_as_notes(spark):
    got = {}
    for r in core.QUERIES["text_notes"](spark, SF).collect():
        got.setdefault(r["path"], {})[r["kind"]] = r["n"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(got) == {f"{r['doc_id']}.txt" for r in docs if (r["text"] or "").strip()}
    one = [r for r in docs if r["text"] and len(r["text"].split("\n")) == 1 and re.fullmatch(r"[\w ,]+\.", r["text"])]
    assert one and all(got[f"{r['doc_id']}.txt"] == {"paragraph": 1} for r in one)


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "source", "n_docs", "n_hits"]
    assert set(core.QUERIES) <= set(entry.queries()) and set(core.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def at(text, x, y, w=None, h=30):
    return Box(text, x, y, x + (w or 12 * len(text)), y + h)


def test_columns_are_read_one_after_the_other():
    left = [at(f"left line number {k} of text", 100, 200 + 40 * k, 600) for k in range(6)]
    right = [at(f"right line number {k} of text", 900, 200 + 40 * k, 600) for k in range(6)]
    mixed = [b for pair in zip(right, left, strict=True) for b in pair]
    assert [b.text for b in reading_order(mixed, 1654)] == [b.text for b in left + right]


def test_blocks_of_a_page():
    page = [at("A tall heading", 100, 100, 600, 60), at("First line of a para-", 100, 220, 700), at("graph that goes on.", 100, 255, 640), at("Another paragraph.", 100, 360, 500), at("• an item", 100, 460, 200)]
    assert [(b["kind"], [x.text for x in b["lines"]]) for b in lay_out(page, 1654)] == [
        ("heading", ["A tall heading"]), ("paragraph", ["First line of a paragraph", "that goes on."]), ("paragraph", ["Another paragraph."]), ("list_item", ["• an item"]),
    ]
    assert lay_out([], 1654) == []
    assert [b.text for b in dehyphenated([at("in-", 0, 0), at("und aus", 0, 40)])] == ["in-", "und aus"]
    assert [b.text for b in dehyphenated([at("CD-", 0, 0), at("ROM neu", 0, 40)])] == ["CD-ROM", "neu"]


def test_a_price_list_is_a_table():
    rows = [("Position", "Menge", "Preis"), ("Schraube", "10", "1.50"), ("Mutter", "20", "0.75"), ("Dübel", "30", "2.00")]
    page = [at(t, x, 200 + 45 * k) for k, r in enumerate(rows) for t, x in zip(r, (60, 500, 900), strict=True)]
    blocks = lay_out(page, 1654)
    assert [b["kind"] for b in blocks] == ["table"]
    grid = blocks[0]["table"]
    assert (grid["rows"], grid["columns"]) == (4, 3)
    assert [c["text"] for c in sorted(grid["cells"], key=lambda c: (c["row"], c["column"]))] == [t for r in rows for t in r]
    assert column_bands([(0, 10, ""), (0, 12, ""), (30, 40, ""), (31, 40, "")], 5) == [(0, 10), (31, 40)]
    assert place((28, 50, ""), [(0, 10), (30, 40), (45, 60)]) == (1, 2) and place((14, 16, ""), [(0, 10), (30, 40)]) == (0, 1)
    assert gutter([], 20) == 15.0


def test_pixels():
    page = np.full((400, 600), 255, np.uint8)
    for k in range(8):
        page[40 * k + 20 : 40 * k + 30, 50:550] = 0
    y, x = np.indices(page.shape)
    turned = page[np.clip(np.round(y + x * np.tan(np.radians(3))).astype(int), 0, 399), x]
    assert images.skew(page) == 0.0 and abs(abs(images.skew(turned)) - 3) < 0.3
    assert images.is_dark(255 - page * 0) is False and images.is_dark(page * 0) is True
    assert images.stretched(np.tile(np.arange(100, 150, dtype=np.uint8), (40, 1))).max() == 255
    prob = np.zeros((60, 100), np.float32)
    prob[10:20, 10:60] = 0.9
    prob[40:50, 20:80] = 0.4
    assert [(round(b["score"], 1), b["y0"] < 10 < 20 < b["y1"]) for b in images.text_boxes(prob)] == [(0.9, True)]
    form = np.full((200, 1000), 255, np.uint8)
    for x0, ticked in ((100, False), (300, True)):
        form[50:80, x0 : x0 + 30] = 0
        form[53:77, x0 + 3 : x0 + 27] = 255
        if ticked:
            for k in range(20):
                form[55 + k, x0 + 5 + k : x0 + 8 + k] = form[55 + k, x0 + 22 - k : x0 + 25 - k] = 0
    assert [b["ticked"] for b in images.tick_boxes(form)] == [False, True]
    scores = np.zeros((6, 4))
    for k, c in enumerate((0, 1, 1, 0, 1, 3)):
        scores[k, c] = 0.5 + k / 10
    assert images.decode_classes(scores, ["a", "b", "c"])[0] == "aac"
    parts = images.tiles(9000, 3000)
    assert sum(images.owns(t, {"x0": 4000, "x1": 4010, "y0": 5, "y1": 9}) for t in parts) == 1
    square = np.array([[0, 0], [2, 2], [4, 0], [2, -2], [2, 0]])
    assert len(images.hull(square)) == 4 and np.isclose(np.linalg.norm(np.diff(images.least_rectangle(square), axis=0), axis=1), 8**0.5).all()
    boxes = [{"x0": 0, "y0": 0, "x1": 10, "y1": 10, "score": s} for s in (0.5, 0.9)]
    assert images.deduplicated(boxes) == [boxes[1]]


def test_exports_of_a_document(spark):
    docs = documents_of_texts(spark.createDataFrame([(1, 'a "b", c\nnext\n\nblock <2>')], "doc_id bigint, text string"))
    said = {f: export(docs, f).first()["content"] for f in ("txt", "md", "json", "csv", "hocr", "xml")}
    assert said["txt"] == 'a "b", c\nnext\n\nblock <2>'
    assert said["csv"].split("\n")[1] == '1,0,0,100.0,300.0,196.0,330.0,0.9800,"a ""b"", c"'
    assert "block &lt;2&gt;" in said["hocr"] and said["hocr"].count("ocr_line") == 4 and said["xml"].count("<TextLine ") == 3
    assert len(json.loads(said["json"])["pages"][0]["blocks"]) == 2
    with pytest.raises(ValueError):
        export(docs, "docx")


def test_notes_are_synced(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("one")
    (src / "a.csv").write_text("x,y\n1,2\n")
    (src / "sub" / "b.md").write_text("# B")
    (src / "c.docx").write_text("broken")
    run = lambda **k: {r["key"].rsplit("/", 1)[-1]: r["action"] for r in sync(spark, str(src), str(out), **k).collect()}
    assert set(run().values()) == {"write"}
    assert sorted(p.relative_to(out).as_posix() for p in out.rglob("*.md")) == ["a-txt.md", "a.md", "sub/b.md"]
    again = run()
    assert {k: v for k, v in again.items() if k != "c.docx"} == {"a.txt": "unchanged", "a.csv": "unchanged", "b.md": "unchanged"}
    (out / "sub" / "b.md").write_text("edited by hand")
    (src / "sub" / "b.md").write_text("# B changed")
    (src / "a.txt").unlink()
    third = run(prune=True)
    assert third["b.md"] == "keep" and third["a.txt"] == "prune" and (out / "sub" / "b.md").read_text() == "edited by hand"
    assert not (out / "a-txt.md").exists()


def test_a_folder_is_watched(spark, tmp_path):
    src, out, mark = (tmp_path / x for x in ("in", "out", "mark"))
    src.mkdir()
    (src / "a.txt").write_text("x")
    take = lambda: to_json_lines(watched(spark, str(src)).selectExpr("path", "length"), str(out), str(mark)).awaitTermination()
    take()
    (src / "b.txt").write_text("yy")
    time.sleep(0.1)
    take()
    take()
    assert sorted(r["length"] for r in spark.read.json(str(out)).collect()) == [1, 2]
