"""Readers on files that are built here."""

import io
import zipfile

import numpy as np
import pytest

from sparkfolio.sources import html_reader, notes, package_readers, text_readers
from sparkfolio.sources.files import NOTES, container, files, notes_of, parse_pages, pdf_lines, read_note, retried
from sparkfolio.sources.notes import Unreadable, body_of, plain_of, rendered
from sparkfolio.sources.pdf import pdf_pages
from sparkfolio.sources.writers import Picture, plan_overlay, read_pnm, read_tiff, searchable_pdf, write_tiff

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def rels(**to):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in to.items()) + "</Relationships>"


def test_text_is_decoded_and_parted():
    assert text_readers.decode("äö".encode("utf-16")) == "äö" == text_readers.decode(b"\xef\xbb\xbf" + "äö".encode())
    assert text_readers.decode("häufig".encode("utf-16-le") * 5) == "häufig" * 5
    assert text_readers.decode(b"caf\xe9 \x80 \r\n") == "café € \n"
    text = "Title\n=====\n\nA para-\ngraph of text that is long enough to be wrapped here.\n\n- one\n- two\n  goes on\n\n1. first\n2. second\n\n> said\n\na\tb\nc\td\n\n-----\n"
    assert [(b.kind, b.text) for b in text_readers.txt(text.encode()).blocks] == [
        ("heading", "Title"), ("paragraph", "A paragraph of text that is long enough to be wrapped here."), ("item", "one"), ("item", "two goes on"), ("item", "first"), ("item", "second"), ("quote", "said"), ("table", ""), ("rule", ""),
    ]
    assert read_note(b"", "x.txt").blocks == []


def test_bytes_that_are_no_utf8_are_decoded_in_one_pass():
    import time

    began = time.time()
    assert text_readers.decode(b"a\xe9\r\n" * 300_000) == "a\xe9\n" * 300_000 and time.time() - began < 10
    assert text_readers.decode("é".encode() + b"\xff\x81") == "éÿ\ufffd"
    assert text_readers.decode("né".encode("utf-16")) == "né" and text_readers.decode("abc def".encode("utf-16-be")) == "abc def" and text_readers.decode(b"\xff\xfe\0\0" + "x".encode("utf-32-le")) == "x"


def test_markdown_tables_code_and_subtitles():
    n = read_note(b"---\ntitle: \"T\"\nx: 1\n---\n# H\n\nbody *x*\n", "a.md")
    assert n.meta == {"title": "T", "x": "1"} and n.body == "# H\n\nbody *x*"
    assert read_note(b"# H #\ntext", "a.md").meta["title"] == "H"
    n = text_readers.delimited(b"a;b\n1;\"x;y\"\n\n2;z\n3;w\n", max_rows=2)
    assert n.meta == {"rows": 3} and n.blocks[0].rows == [["a", "b"], ["1", "x;y"], ["2", "z"]] and "1 more rows" in n.blocks[1].text
    assert body_of(read_note(b"n,v\na,1\nb,2.5\n", "x.csv").blocks) == "| n | v |\n| --- | ---: |\n| a | 1 |\n| b | 2.5 |"
    assert body_of(read_note(b"x = '```'\n", "x.py").blocks) == "````python\nx = '```'\n````"
    assert read_note(b'{"a":' + b"1" * 130 + b"}", "x.json").blocks[0].text.count("\n") == 2
    assert [b.text for b in read_note(b"WEBVTT\n\n1\n00:01 --> 00:02\n<i>Hello</i>\nyou\n\n00:03 --> 00:04\nyou\nthere.\n", "a.vtt").blocks] == ["Hello you there."]


def test_html():
    page = """<html lang="de-AT"><head><title>T &amp; x</title><meta name=keywords content="a, b"><meta property="og:title" content=o></head><body><nav>menu</nav><main><h1>Head</h1>
    <p>one <b>two</b> <a href="/x y">link</a><br>three<p hidden>no<ul><li>a<ul><li>b</ul><li>c</ul><ol start=3><li>x</ol><pre><code class=language-py>p = 1</code></pre><blockquote>q</blockquote>
    <table><caption>cap</caption><tr><th>h<th>i<tr><td rowspan=2>1<td>2<tr><td>3</table><table role=presentation><tr><td>laid</table><hr><dl><dt>t<dd>d</dl></main>"""
    n = html_reader.html_note(page, "http://h/")
    assert n.meta == {"title": "T & x", "keywords": ["a", "b"], "language": "de"}
    assert body_of(n.blocks) == "# Head\n\none **two** [link](http://h/x%20y)\\\nthree\n\n- a\n  - b\n- c\n\n3. x\n\n```py\np = 1\n```\n\n> q\n\ncap\n\n| h | i |\n| --- | ---: |\n| 1 | 2 |\n|  | 3 |\n\nlaid\n\n---\n\n**t**\n\nd".replace("- c\n\n3. x", "- c\n3. x")
    assert html_reader.links('<a href="#x">no</a><a href="b">B</a>', "http://h/a/") == [("http://h/a/b", "B")]
    assert html_reader.decode_html(b"<meta charset=latin1>\x80") == "<meta charset=latin1>€"
    assert html_reader.html_note("").blocks == []


def test_word_processing():
    body = """<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>
    <w:p><w:r><w:t xml:space="preserve">plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>no</w:t></w:r><w:hyperlink r:id="l"><w:r><w:t> link</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>
    <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>first</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>second</w:t></w:r></w:p>
    <w:p><m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath></w:p>
    <w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>z</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"""
    data = zipped(**{
        "word__document_dot_xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word___rels__document_dot_xml_dot_rels": rels(l="http://x"),
        "word__styles_dot_xml": f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>', "word__footnotes_dot_xml": f'<w:footnotes {W}><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>',
        "word__numbering_dot_xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        "docProps__core_dot_xml": "<c><title>The title</title><creator>Me</creator></c>",
    })
    n = read_note(data, "a.docx")
    assert n.meta == {"title": "The title", "author": "Me"}
    assert body_of(n.blocks) == "## Head\n\nplain **bold**[ link](http://x)[^1]\n\n1. first\n2. second\n\n$\\frac{a}{b}$\n\n| x | y |\n| --- | --- |\n| z |  |\n\n[^1]: note"


def test_spreadsheet_and_dates():
    data = zipped(**{
        "xl__workbook_dot_xml": f'<workbook {S}><sheets><sheet name="One" r:id="a"/><sheet name="Gone" state="hidden" r:id="b"/></sheets></workbook>', "xl___rels__workbook_dot_xml_dot_rels": rels(a="sheet1.xml", b="sheet2.xml"),
        "xl__sharedStrings_dot_xml": f"<sst {S}><si><t>name</t></si></sst>", "xl__styles_dot_xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="9"/><xf numFmtId="46"/></cellXfs></styleSheet>',
        "xl__sheet1_dot_xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.0</v></c></row><row r="2"><c r="A2" s="1"><v>45000</v></c><c r="B2" s="2"><v>0.25</v></c></row><row r="3" hidden="1"><c r="A3"><v>9</v></c></row><row r="5"><c r="B5" t="b"><v>1</v></c></row></sheetData></worksheet>',
    })
    n = read_note(data, "a.xlsx")
    assert [(b.kind, b.text or b.rows) for b in n.blocks] == [("heading", "One"), ("table", [["name", "2"], ["2023-03-15", "25 %"]]), ("table", [["TRUE"]])]
    assert n.meta == {"sheets": 1, "rows": 3}
    days = {1: "1900-01-01", 59: "1900-02-28", 60: "1900-03-01", 60.5: "1900-03-01 12:00:00", 61: "1900-03-01", 61.99999999: "1900-03-02", 0.5: "12:00:00", 2958465: "9999-12-31", 2958466: "2958466", -5: "-5", 1e300: "1e+300"}
    assert {k: package_readers.excel_date(k) for k in days} == days
    assert (package_readers.excel_date(1, True), package_readers.excel_date(0, True)) == ("1904-01-02", "00:00:00")
    assert [package_readers.number_text(x) for x in ("inf", "nan", "1e3", "x", "-0.50")] == ["inf", "nan", "1000", "x", "-0.5"]
    assert package_readers.cell_place("$AB$10") == (9, 27) and package_readers.number_text("0.1000") == "0.1"


def test_slides_opendocument_epub_and_archives():
    slide = f'<p:sld {P}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:nvSpPr><p:nvPr><p:ph idx="1"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>point</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    data = zipped(**{"ppt__presentation_dot_xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="s"/></p:sldIdLst></p:presentation>', "ppt___rels__presentation_dot_xml_dot_rels": rels(s="slides/s1.xml"), "ppt__slides__s1_dot_xml": slide})
    assert [(b.kind, b.text) for b in read_note(data, "a.pptx").blocks] == [("marker", "slide 1"), ("heading", "Title"), ("item", "point")]
    sheet = f'<office:document-content {O}><office:body><office:spreadsheet><table:table table:name="S"><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"><text:p>b</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>'
    assert [(b.kind, b.text or b.rows) for b in read_note(zipped(content_dot_xml=sheet), "a.ods").blocks] == [("heading", "S"), ("table", [["a", "b", "b"]])]
    odt = f'<office:document-content {O}><office:body><office:text><text:h text:outline-level="2">H</text:h><text:p>p</text:p><text:list><text:list-item><text:p>i</text:p></text:list-item></text:list></office:text></office:body></office:document-content>'
    assert body_of(read_note(zipped(content_dot_xml=odt), "a.odt").blocks) == "## H\n\np\n\n- i"
    opf = '<package><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>B</dc:title></metadata><manifest><item id="c" href="c.html"/></manifest><spine><itemref idref="c"/></spine></package>'
    book = zipped(**{"META-INF__container_dot_xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o__p_dot_opf": opf, "o__c_dot_html": "<p>text</p>"})
    n = read_note(book, "b.epub")
    assert n.meta == {"title": "B"} and [b.text for b in n.blocks] == ["chapter 1", "text"]
    archive = zipped(a_dot_txt="one", **{"A_dot_TXT": "two", "_dot_hidden": "x", "in__b_dot_csv": "x,y\n1,2"})
    assert [k for k, _ in package_readers.members(archive)] == ["a.txt", "A~2.TXT", "in/b.csv"]
    assert [b.text for b in read_note(archive, "z.zip").blocks if b.text] == ["a.txt", "one", "A~2.TXT", "two", "in/b.csv"]
    for bad in ("a.docx", "a.xlsx", "a.zip", "a.pdf", "a.doc", "a.png"):
        with pytest.raises(Unreadable):
            read_note(b"broken", bad)


def test_mail_and_rich_text():
    mail = b"From: a@b.c\r\nTo: d@e.f\r\nSubject: =?utf-8?q?H=C3=A9?=\r\nDate: Mon, 02 Jan 2023 10:00:00 +0100\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Type: text/html\r\n\r\n<p>body</p>\r\n--x\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=n.txt\r\n\r\nattached\r\n--x--\r\n"
    n = read_note(mail, "m.eml")
    assert n.meta["title"] == "Hé" and [b.text for b in n.blocks] == ["body", "n.txt", "attached"]
    assert 'date: 2023-01-02T09:00:00Z' in rendered(n)
    rich = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\stylesheet{\s1 heading 1;}}{\info{\title T}}\pard\s1 Head\par\pard caf\'e9 \b bold\b0  \u8211?x\par\trowd a\cell b\cell\row\pard end\par}"
    n = read_note(rich, "r.rtf")
    assert n.meta == {"title": "T"} and [(b.kind, b.text or b.rows) for b in n.blocks] == [("heading", "Head"), ("paragraph", "café **bold** –x"), ("table", [["a", "b"]]), ("paragraph", "end")]


def test_pdf_and_pictures():
    lines = [{"text": "INVOICE 2026-0042", "x0": 100, "y0": 100, "x1": 500, "y1": 140}, {"text": "Total: (199.90) EUR", "x0": 100, "y0": 200, "x1": 560, "y1": 240}]
    data = searchable_pdf([Picture(np.full((600, 800), 255, np.uint8), lines), Picture(np.zeros((60, 80, 3), np.uint8), [])])
    pages = pdf_pages(data)
    assert [(p["width"], p["height"], [x["text"] for x in p["lines"]]) for p in pages] == [(800, 600, ["INVOICE 2026-0042", "Total: (199.90) EUR"]), (80, 60, [])]
    first = pages[0]["lines"][0]
    assert abs(first["x0"] - 100) < 2 and abs(first["x1"] - 500) < 4 and abs(first["y1"] - 140) < 12
    assert [p["needs_ocr"] for p in plan_overlay(data)] == [False, True] or [p["needs_ocr"] for p in plan_overlay(data)] == [False, False]
    grey, colour = np.arange(48, dtype=np.uint8).reshape(6, 8), np.arange(72, dtype=np.uint8).reshape(4, 6, 3)
    for compression in ("none", "deflate"):
        back = read_tiff(write_tiff([grey, colour], compression))
        assert (back[0] == grey).all() and (back[1] == colour).all()
    assert (read_pnm(b"P5\n# c\n8 6\n255\n" + grey.tobytes()) == grey).all() and read_pnm(b"P2 2 1 255 0 255").tolist() == [[0, 255]]


def test_files_as_tables(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.txt", b"plain"), ("sub/b.html", b"<h1>H</h1>"), ("c.docx", b"broken"), (".hidden.txt", b"x"), ("d.unknown", b"x"), ("e.pdf", searchable_pdf([Picture(np.full((100, 200), 255, np.uint8), [{"text": "layer", "x0": 10, "y0": 10, "x1": 90, "y1": 40}])]))):
        (tmp_path / name).write_bytes(data)
    found = files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1]: r for r in notes_of(found).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a.txt": "ok", "b.html": "ok", "c.docx": "error", "e.pdf": "ok"}
    assert got["b.html"]["markdown"] == '---\ntitle: "H"\n---\n\n# H\n' and got["c.docx"]["error_kind"] == "unreadable" and NOTES.startswith("status")
    lines = pdf_lines(found.where("path like '%.pdf'")).collect()
    assert [(r["page_index"], r["text"]) for r in lines] == [(0, "layer")] and pdf_lines(found.where("path like '%.docx'")).collect()[0]["error"]
    assert pdf_lines(found.where("path like '%.pdf'"), pages=[3]).collect() == []
    assert {r[0] for r in found.select(container()).collect()} == {"other", "pdf"}
    assert parse_pages("1,3-5") == [0, 2, 3, 4]
    with pytest.raises(ValueError):
        parse_pages("0")


def test_notes_as_text():
    n = notes.Note([notes.Block("paragraph", "a **b** [c](d)"), notes.Block("rule")], {"title": 'q"', "rows": 3, "x": 1.5, "none": None, "list": ["a", 2]})
    assert rendered(n) == '---\ntitle: "q\\""\nrows: 3\nlist: ["a", 2]\nx: 1.5\n---\n\na **b** [c](d)\n\n---\n'
    assert plain_of(n.blocks) == "a b c"
    calls = []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise InterruptedError
        return 5

    assert retried(fails, delay=0) == 5
