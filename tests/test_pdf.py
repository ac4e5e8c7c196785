import zlib

import pytest
from pagewise.operators import checks
from pagewise.plans.engines import ImageEngine, NativeEngine, PdfEngine, StubOcr
from pagewise.plans.router import process
from pagewise.schemas import SOURCES
from pagewise.sources import pdf
from pagewise.sources.pdf_layout import page_nodes, with_widths


def make(*pages, compress=False, extra=b"", trailer=b"", fonts=b"/F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"):
    """A file of content streams; objects 1 and 2 are the catalog and the page tree."""
    kids = b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(len(pages)))
    out = [b"%PDF-1.7", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [" + kids + b"] /Count %d /MediaBox [0 0 612 792] >> endobj" % len(pages)]
    for k, body in enumerate(pages):
        out.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << %s >> /XObject << /I 90 0 R /X 91 0 R >> >> >> endobj" % (3 + 2 * k, 4 + 2 * k, fonts))
        data = zlib.compress(body) if compress else body
        out.append(b"%d 0 obj << /Length %d %s>> stream\n%s\nendstream endobj" % (4 + 2 * k, len(data), b"/Filter /FlateDecode " * compress, data))
    out.append(b"90 0 obj << /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 3 >> stream\nabc\nendstream endobj")
    out.append(extra)
    return b"\n".join([*out, b"trailer << /Root 1 0 R " + trailer + b" >>", b"%%EOF"])


TEXT = b"BT /F1 24 Tf 72 700 Td (Big title) Tj ET BT /F1 12 Tf 14 TL 72 660 Td (First line of) Tj T* (a paragraph \\(caf\\351\\).) Tj 0 -40 Td [(Sp) -20 (lit) -600 (words)] TJ ET"
SCAN = b"q 612 0 0 792 0 0 cm /I Do Q"


def texts(data, n=None):
    pages, count, title = pdf.read_pages(data, n)
    return [[(t, level) for t, level, _ in pdf.paragraphs_of(pdf.lines_of(p.items))] for p in pages]


@pytest.mark.parametrize("compress", [False, True])
def test_text_in_order(compress):
    assert texts(make(TEXT, compress=compress)) == [[("Big title", 1), ("First line of a paragraph (café).", None), ("Split words", None)]]


def test_pages_are_chosen_and_titles_read():
    data = make(TEXT, SCAN, b"BT /F1 9 Tf 10 10 Td <4142> Tj ET", extra=b"50 0 obj << /Title (A title) >> endobj", trailer=b"/Info 50 0 R")
    assert texts(data, [3]) == [[("AB", None)]] and pdf.read_pages(data)[1:] == (3, "A title")
    pages = pdf.read_pages(data)[0]
    assert [(p.images, bool(p.items)) for p in pages] == [(0, True), (1, False), (0, True)] and pages[0].width == 612


def test_columns_and_spacing():
    left = b"".join(b"BT /F1 10 Tf 50 %d Td (left %d) Tj ET " % (700 - 12 * k, k) for k in range(3))
    right = b"".join(b"BT /F1 10 Tf 350 %d Td (right %d) Tj ET " % (700 - 12 * k, k) for k in range(3))
    assert sorted(t for t, _ in texts(make(left + right))[0]) == ["left 0 left 1 left 2", "right 0 right 1 right 2"]


def test_fonts_with_maps_and_forms():
    cmap = b"2 beginbfchar <0001> <65E5> <0002> <0066006C> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"
    fonts = b"/F1 << /Type /Font /Subtype /Type0 /ToUnicode 80 0 R >> /F2 << /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /eacute /uni20AC] >> >>"
    extra = b"80 0 obj << /Length %d >> stream\n%s\nendstream endobj 91 0 obj << /Subtype /Form /Length 40 >> stream\nBT /F2 10 Tf 100 100 Td (AB in form) Tj ET\nendstream endobj" % (len(cmap), cmap)
    got = texts(make(b"BT /F1 10 Tf 50 500 Td <000100020011> Tj ET /X Do", fonts=fonts, extra=extra))
    assert [t for t, _ in got[0]] == ["日flB", "é€ in form"]


def test_object_streams():
    inner = b"1 0 2 35 << /Type /Catalog /Pages 2 0 R >>   << /Type /Pages /Kids [3 0 R] >>"
    data = zlib.compress(inner)
    page = b"3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F1 << /Subtype /Type1 >> >> >> >> endobj 4 0 obj << /Length 36 >> stream\nBT /F1 10 Tf 9 9 Td (in stream) Tj ET\nendstream endobj"
    file = b"%%PDF-1.5\n%s 5 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj 6 0 obj << /Type /XRef /Root 1 0 R /Length 0 >> stream\n\nendstream endobj" % (page, len(data), data)
    assert texts(file) == [[("in stream", None)]]


def test_what_can_t_be_read():
    with pytest.raises(pdf.Encrypted):
        pdf.read_pages(make(TEXT, trailer=b"/Encrypt 9 0 R"))
    for bad in (b"", b"%PDF-1.7\ngarbage", b"text", make(TEXT)[:60], b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj"):
        with pytest.raises(pdf.Malformed):
            pdf.read_pages(bad)


def test_odd_content_does_no_harm():
    for body in (b"", b"BT (no font) Tj ET", b"Q Q ]] >> ) ( unterminated", b"BT /F1 Tf 1 Td Tj ET", b"BI /W 1 ID x EI BT /F1 9 Tf 5 5 Td (after) Tj ET", b"[1 2", b"/X Do /None Do", b"%comment only"):
        assert len(pdf.read_pages(make(body))[0]) == 1


def test_a_mixed_file_costs_one_ocr_page(spark):
    files = {"a": make(TEXT, SCAN), "b": b"%PDF-1.7\nbroken", "c": make(TEXT, trailer=b"/Encrypt 9 0 R"), "d": make(SCAN)}
    src = spark.createDataFrame([(i * 64, f"{i}.pdf", None, i * 64, len(c), c) for i, c in files.items()], SOURCES)
    result = process(src, [NativeEngine(), PdfEngine(), ImageEngine()], StubOcr())
    assert sorted((r.document_id[0], r.error_kind) for r in result.failures.collect()) == [("b", "malformed"), ("c", "encrypted")]
    got = {(r.document_id[0], r.number): r for r in result.pages.collect()}
    assert [got[k].blocks[0].provenance.engine for k in (("a", 1), ("a", 2), ("d", 1))] == ["pdf", "ocr-stub", "ocr-stub"]
    assert got["a", 1].blocks[0].level == 1 and got["a", 1].blocks[0].bbox.x == 72 and got["a", 1].width == 612
    assert {(r.document_id[0], tuple(r.pages)) for r in result.runs.where("engine = 'ocr-stub'").collect()} == {("a", (2,)), ("d", (1,))}
    assert checks.page_violations(result.pages).count() == checks.document_violations(result.documents, result.pages).count() == 0
    assert {r.document_id[0]: r.metadata.custom["pdf_type"] for r in result.documents.collect()} == {"a": "mixed", "d": "image_based"}


def show(*rows, size=10):
    """Lines of a content stream: (x, y, text)."""
    return b" ".join(b"BT /F1 %d Tf %d %d Td (%s) Tj ET" % (size, x, y, t.encode("latin-1")) for x, y, t in rows)


def blocks_of(*pages):
    row = {"content": make(*pages), "numbers": None}
    return list(PdfEngine().read(row))


def test_a_table_a_list_and_prose():
    body = show((72, 700, "Some words before the table."), *((x, 660 - 14 * k, f"{c}{k}") for k in range(3) for x, c in ((72, "name "), (250, "qty "), (400, "price "))), (72, 590, "* first point"), (84, 578, "goes on"), (72, 566, "* second point"), (72, 530, "1. one"), (72, 518, "2. two"), (72, 480, "2024. That was a year."))
    page = blocks_of(body)[0]
    top = [(b["type"], b.get("text")) for b in page["blocks"] if b["slot"] == "page"]
    assert top == [("paragraph", "Some words before the table."), ("table", None), ("list", None), ("list", None), ("paragraph", "2024. That was a year.")]
    assert page["reasons"] == ["has_tables"] and len(page["cells"]) == 9
    cells = {(b["row"], b["col"]): b for b in page["blocks"] if b["slot"] == "cell"}
    assert cells[2, 1]["text"] == "qty 2" and cells[2, 1]["bbox"]["x"] == 250
    assert [(b["text"], b["item_idx"]) for b in page["blocks"] if b["slot"] == "item"] == [("first point goes on", 0), ("second point", 1), ("one", 0), ("two", 1)]


def test_columns_are_told_and_read_one_after_the_other():
    left, right = [f"words of the left column, line {k}" for k in range(5)], [f"words of the right column, line {k}" for k in range(5)]
    page = blocks_of(show((72, 740, "A heading line over both of them"), size=18) + b" " + show(*((72, 700 - 12 * k, t) for k, t in enumerate(left)), *((330, 700 - 12 * k, t) for k, t in enumerate(right))))[0]
    assert page["reasons"] == ["multi_column"] and [b["type"] for b in page["blocks"]] == ["heading", "paragraph", "paragraph"]
    assert [b["text"] for b in page["blocks"]][1:] == [" ".join(left), " ".join(right)]


def test_widths_that_the_font_does_not_tell_are_estimated():
    items = [pdf.Item("a", 7.0, 10.2, 0.0, 12.0), pdf.Item("b", 0.0, 10.0, 5.0, 12.0), pdf.Item("ccc", 20.0, 10.0, 0.0, 12.0)]
    got, estimated = with_widths(items)
    assert estimated and {i.text: i.width for i in got} == {"a": 18.0 / 3, "b": 5.0, "ccc": 18.0}
    assert page_nodes(items)[1] == ["estimated_glyph_widths"] and page_nodes([]) == ([], [])
    assert with_widths(items[1:2]) == (items[1:2], False)


def test_other_files_never_reach_the_pdf_reader(spark):
    src = spark.createDataFrame([("a" * 64, "a.pdf", None, "a" * 64, 1, b"text"), ("b" * 64, "b", None, "b" * 64, 1, make(TEXT)), ("c" * 64, "c.pdf", None, "c" * 64, 0, None)], SOURCES)
    seen = PdfEngine().inspect(src)
    assert [r.document_id[0] for r in seen.collect()] == ["b"]
