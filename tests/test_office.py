"""Containers are written here, by hand, and read again."""

import io
import zipfile

import pytest
from pagewise.operators.markdown import flatten, nodes_of
from pagewise.operators.render import markdown_of
from pagewise.plans.engines import NativeEngine
from pagewise.plans.router import process
from pagewise.schemas import SOURCES
from pagewise.sources import office

P = {"engine": "e", "engine_version": "1", "method": "m"}
W = 'xmlns:w="w" xmlns:r="r" xmlns:a="a" xmlns:wp="wp"'


def pack(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), body)
    return out.getvalue()


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


CORE = '<c xmlns:dc="dc"><dc:title>A title</dc:title><dc:creator>Someone</dc:creator></c>'


def docx():
    p = lambda text, style="", num="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}{f"""<w:numPr><w:ilvl w:val="{num[0]}"/><w:numId w:val="{num[1]}"/></w:numPr>""" if num else ""}</w:pPr>{text}</w:p>'
    r = lambda text, style="": f"<w:r><w:rPr>{style}</w:rPr><w:t>{text}</w:t></w:r>"
    cell = lambda text, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(r(text))}</w:tc>"
    table = (
        f'<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr>{cell("h", """<w:gridSpan w:val="2"/>""")}</w:tr>'
        f'<w:tr>{cell("v", """<w:vMerge w:val="restart"/>""")}{cell("1")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("2")}</w:tr></w:tbl>'
    )
    body = (
        p(r("Head"), "H1") + p(r("Some ") + r("bold", "<w:b/>") + r(" off", '<w:b w:val="0"/>') + f'<w:hyperlink r:id="l">{r("link")}</w:hyperlink>') + p("")
        + p(r("one"), num="01") + p(r("deep"), num="11") + p(r("two"), num="01") + p(r("first"), num="02")
        + '<w:p><w:r><w:drawing><wp:docPr descr="pic"/><a:blip r:embed="i"/></w:drawing></w:r></w:p>' + table
    )
    return packed(
        {
            "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
            "word/_rels/document.xml.rels": '<R><x Id="l" Target="http://u" TargetMode="External"/><x Id="i" Target="media/i.png"/></R>',
            "word/media/i.png": b"png",
            "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
            "word/numbering.xml": f'<w:n {W}><w:abstractNum w:abstractNumId="9"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="9"/></w:num></w:n>',
            "word/footnotes.xml": f'<w:f {W}><w:footnote w:type="separator" w:id="0"/><w:footnote w:id="1">{p(r("a note"))}</w:footnote></w:f>',
            "docProps/core.xml": CORE,
        }
    )


def view(read):
    blocks, items, cells = flatten(read.nodes, 1, P)
    return markdown_of(None, [{"number": 1, "kind": "section", "blocks": blocks, "items": items, "cells": cells}])


def test_docx():
    got = office.read_office(docx(), "docx")
    assert got.metadata == {"title": "A title", "author": "Someone", "language": None}
    assert [(a["asset_id"], a["media_type"], a["content"]) for a in got.assets] == [("a0", "image/png", b"png")]
    assert view(got) == "# Head\n\nSome **bold** off[link](http://u)\n\n- one\n  - deep\n- two\n\n1. first\n\n![pic](a0)\n\n| h |  |\n| --- | --- |\n| v | 1 |\n|  | 2 |\n\na note\n"
    blocks, items, cells = flatten(got.nodes, 1, P)
    assert [(c["row"], c["col"], c.get("covered_row"), c.get("row_span")) for c in cells] == [(0, 0, None, 1), (0, 1, 0, None), (1, 0, None, 2), (1, 1, None, 1), (2, 0, 1, None), (2, 1, None, 1)]
    assert blocks[-1]["provenance"]["method"] == "m/footnote:1" and nodes_of(blocks, items, cells)


def test_xlsx():
    sheet = '<w><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>1.5</v></c></row><row><c r="A3" t="inlineStr"><is><t>in</t></is></c><c r="C3" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="B1:C2"/></mergeCells></w>'
    book = packed({"xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="S" r:id="x"/><sheet name="Empty" r:id="y"/></sheets></w>', "xl/_rels/workbook.xml.rels": '<R><x Id="x" Target="worksheets/a.xml"/><x Id="y" Target="worksheets/b.xml"/></R>', "xl/worksheets/a.xml": sheet, "xl/worksheets/b.xml": "<w/>", "xl/sharedStrings.xml": "<s><si><t>sha</t><t>red</t></si></s>"})
    assert view(office.read_office(book, "xlsx")) == "## S\n\n| shared | 1.5 |  |\n| --- | --- | --- |\n|  |  |  |\n| in |  | TRUE |\n"


def test_pptx():
    para = lambda t, pr="": f"<a:p>{pr}<a:r><a:rPr b='1'/><a:t>{t}</a:t></a:r></a:p>"
    slide = f"<p xmlns:a='a' xmlns:r='r'><sp><ph type='title'/><txBody>{para('Head')}</txBody></sp><sp><ph/><txBody>{para('one')}{para('deep', chr(60) + 'a:pPr lvl=' + chr(39) + '1' + chr(39) + '/>')}</txBody></sp><sp><txBody>{para('free')}</txBody></sp></p>"
    show = packed({"ppt/presentation.xml": "<p xmlns:r='r'><sldIdLst><sldId id='256' r:id='s'/></sldIdLst></p>", "ppt/_rels/presentation.xml.rels": "<R><x Id='s' Target='slides/s1.xml'/></R>", "ppt/slides/s1.xml": slide})
    assert view(office.read_office(show, "pptx")) == "# **Head**\n\n- **one**\n  - **deep**\n\n**free**\n"


def test_open_document():
    body = "<t:h t:outline-level='2'>Head</t:h><t:p>a<t:s t:c='2'/>b <t:span t:style-name='B'>bold</t:span></t:p><t:list><t:list-item><t:p>one</t:p><t:list><t:list-item><t:p>in</t:p></t:list-item></t:list></t:list-item></t:list>"
    table = "<x:table><x:table-row><x:table-cell x:number-columns-spanned='2'><t:p>w</t:p></x:table-cell><x:covered-table-cell/></x:table-row><x:table-row><x:table-cell><t:p>1</t:p></x:table-cell><x:table-cell><t:p>2</t:p></x:table-cell><x:table-cell x:number-columns-repeated='1000'/></x:table-row><x:table-row x:number-rows-repeated='1000000'><x:table-cell/></x:table-row></x:table>"
    odt = packed({"content.xml": f"<d xmlns:t='t' xmlns:x='x' xmlns:s='s'><s:style s:name='B'><s:text-properties s:font-weight='bold'/></s:style><body>{body}{table}</body></d>"})
    assert view(office.read_office(odt, "odt")) == "## Head\n\na  b **bold**\n\n- one\n  - in\n\n| w |  |\n| --- | --- |\n| 1 | 2 |\n"


def test_epub():
    page = "<html><body><h1>One</h1><p>Text <b>bold</b>\n more</p>loose <i>words</i><ul><li>a</li><li><p>b</p></li></ul><blockquote><p>q</p></blockquote><pre>x\n  y</pre><hr/><table><tr><th>h</th></tr><tr><td>c</td></tr></table></body></html>"
    book = packed({"META-INF/container.xml": "<c><rootfile full-path='O/p.opf'/></c>", "O/p.opf": "<p><metadata><title>T</title></metadata><manifest><item id='a' href='a%20b.xhtml'/></manifest><spine><itemref idref='a'/></spine></p>", "O/a b.xhtml": page})
    got = office.read_office(book, "epub")
    assert got.metadata["title"] == "T"
    assert view(got) == "# One\n\nText **bold** more\n\nloose *words*\n\n- a\n- b\n\n> q\n\n```\nx\n  y\n```\n\n---\n\n| h |\n| --- |\n| c |\n"


def test_rtf():
    got = office.read_office(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}Hello {\b bold} caf\'e9 \u8212?dash\par\pard second\line line\par}", "rtf")
    assert view(got) == "Hello **bold** café —dash\n\nsecond\nline\n"


@pytest.mark.parametrize("kind", ["docx", "xlsx", "pptx", "odt", "epub"])
def test_broken_containers_are_malformed(kind):
    for content in (b"", b"PK\x03\x04 not a zip", packed({"other": "x"}), docx()[:200]):
        with pytest.raises(office.Malformed):
            office.read_office(content, kind)


def test_through_the_pipeline(spark):
    rows = [(i, n, None, i, 1, c) for i, n, c in (("a", "a.DOCX", docx()), ("b", "b.docx", b"PK broken"), ("c", "c.doc", b"\xd0\xcf"), ("d", "d", rb"{\rtf1 text\par}"))]
    src = spark.createDataFrame(rows, SOURCES)
    result = process(src, [NativeEngine()])
    assert sorted(map(tuple, result.failures.collect())) == [("b", "malformed"), ("c", "unsupported")]
    meta = {r.document_id: r.metadata for r in result.documents.collect()}
    assert meta["a"].title == "A title" and meta["a"].custom == {"source_kind": "word"} and set(meta) == {"a", "d"}
    assert [r.asset_id for r in NativeEngine().assets(src).collect()] == ["a0"]
