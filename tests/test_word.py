"""Word files made by hand: what stays, what goes, and what is refused."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from strataq.sources import loaders, word

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
STYLES = f'<w:styles {NS}><w:style w:styleId="berschrift1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H3"><w:name w:val="Heading 3"/></w:style><w:style w:styleId="T"><w:name w:val="Title"/></w:style></w:styles>'
NUMBERS = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="https://example.org/x" TargetMode="External"/></Relationships>'


def run(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def par(inside, style="", number="", level="0"):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>' if number else "")
    return f"<w:p><w:pPr>{props}</w:pPr>{inside}</w:p>"


def docx(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in ({"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>", "word/styles.xml": STYLES, "word/numbering.xml": NUMBERS, "word/_rels/document.xml.rels": LINKS} | parts).items():
            z.writestr(name, xml)
    return out.getvalue()


def test_what_stays():
    cell = lambda t: f"<w:tc>{par(run(t))}</w:tc>"
    body = (
        par(run("The ") + run("name", "<w:b/>"), "T") + par(run("First"), "berschrift1") + par(run("Some ") + run("bold ", "<w:b/>") + run("and ") + run("plain", '<w:b w:val="0"/>') + run(" &amp; "), "")
        + par(run("one"), number="5") + par(run("below"), number="5", level="1") + par(run("two"), number="5") + par("") + par(run("Third"), "H3")
        + f'<w:tbl><w:tr>{cell("a")}{cell("b|c")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl>'
        + par(f'<w:hyperlink r:id="rId1">{run("link")}</w:hyperlink><w:r><w:br/><w:t>next</w:t><w:tab/></w:r><w:ins>{run("new")}</w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del>')
        + f"<w:sdt><w:sdtContent>{par(run('inside'))}</w:sdtContent></w:sdt>"
        + par(f"<mc:AlternateContent><mc:Choice>{run('box')}</mc:Choice><mc:Fallback>{run('box')}</mc:Fallback></mc:AlternateContent>")
    )
    assert word.markdown_of(docx(body)) == "# The name\n\n# First\n\nSome **bold** and plain &\n\n1. one\n  - below\n2. two\n\n### Third\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n\n[link](https://example.org/x)\nnext\tnew\n\ninside\n\nbox"
    assert word.markdown_of(docx("")) == ""


@pytest.mark.parametrize(("content", "why"), [
    (b"", "not a Word file"), (b"PK\x03\x04 broken", "not a Word file"), (docx("", **{"word/document.xml": "<w:document"}), "not a Word file"),
    (docx("", **{"word/document.xml": f"<w:document {NS}/>"}), "no document"), (docx("<w:p/>" * 50_000), "too large"),
    (docx("", **{"word/document.xml": f'<!DOCTYPE x [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;">]><w:document {NS}><w:body><w:p><w:r><w:t>&b;</w:t></w:r></w:p></w:body></w:document>'}), "document type"),
])
def test_what_is_refused(content, why):
    with pytest.raises(word.BadWord, match=why):
        word.markdown_of(content, 100_000)


def test_a_bomb_is_not_inflated():
    bomb = docx("", **{"word/document.xml": b"<a>" + b" " * 200_000_000})
    assert len(bomb) < 1_000_000
    with pytest.raises(word.BadWord, match="too large"):
        word.markdown_of(bomb)


def test_files_and_pages(spark, tmp_path):
    files = {"my_report.docx": docx(par(run("Report of May"), "berschrift1") + par(run("Text."))), "broken.docx": b"no zip", "a.txt": "caf\xe9 au lait".encode("latin-1"), "b.md": b"# Bee\n\nx"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.filename: r for r in loaders.read_texts(spark, str(tmp_path)).collect()}
    assert got["my_report.docx"].text == "# Report of May\n\nText." and got["my_report.docx"].title == "Report of May"
    assert got["broken.docx"].text is None and got["a.txt"].text == "caf� au lait" and got["b.md"].title == "Bee"
    pages = spark.createDataFrame([("http://h/x.docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", bytearray(files["my_report.docx"])), ("http://h/y", "text/plain", bytearray(b"\xff ok"))], "url string, content_type string, content binary")
    got = {r.url: r for r in loaders.by_content_type(pages).collect()}
    assert (got["http://h/x.docx"].format, got["http://h/x.docx"].text) == ("docx", "# Report of May\n\nText.") and got["http://h/y"].text == "� ok"
    errors = spark.createDataFrame([(bytearray(b"x"),), (None,)], "content binary").select(word.word(F.col("content")).alias("w")).select("w.*").collect()
    assert errors[0].text is None and "not a Word file" in errors[0].error and tuple(errors[1]) == (None, None)
