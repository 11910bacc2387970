"""PDF text: filters, pages, fonts and damaged files."""

from __future__ import annotations

import base64
import sys
import zlib
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from quarry.functions.pdf import MOST_STREAM, pdf_text
from quarry.operators import extraction
from quarry.sources import files

CMAP = b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <01> <00E9> <02> <D83DDE00> endbfchar 2 beginbfrange <41> <43> <0061> <44> <45> [<0058> <0059>] endbfrange"


def pdf(*contents: bytes, head: bytes = b"", font: bytes = b"<< /Type /Font /Subtype /Type1 >>", more: bytes = b"", trailer: bytes = b"/Root 1 0 R") -> bytes:
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    out = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Kids [" + kids + b"] >> endobj\n3 0 obj " + font + b" endobj\n" + more
    for i, c in enumerate(contents):
        out += b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n%d 0 obj << /Length %d %s >>\nstream\n%s\nendstream endobj\n" % (10 + 2 * i, 11 + 2 * i, 11 + 2 * i, len(c), head, c)
    return out + b"trailer << " + trailer + b" >>\n%%EOF"


def stream(number: int, body: bytes, head: bytes = b"") -> bytes:
    return b"%d 0 obj << %s >>\nstream\n%s\nendstream endobj\n" % (number, head, body)


def test_operators_and_escapes():
    said = rb"BT /F1 9 Tf (Plain \(nested (text)\) \101\102) Tj 0 -12 Td [(spl) -20 (it) -300 (word)] TJ T* <48 69> Tj (next) ' ET"
    assert pdf_text(pdf(said)) == "Plain (nested (text)) AB split word Hi next"
    assert pdf_text(pdf(b"q BI /W 1 /H 1 ID \x00(no) Tj\xff EI Q BT (caf\xe9 \x80) Tj ET")) == "café €"


def test_filters():
    said = b"BT (packed words) Tj ET"
    assert pdf_text(pdf(zlib.compress(said), head=b"/Filter /FlateDecode")) == "packed words"
    assert pdf_text(pdf(base64.a85encode(zlib.compress(said)) + b"~>", head=b"/Filter [/ASCII85Decode /FlateDecode]")) == "packed words"
    assert pdf_text(pdf(said.hex().encode() + b">", head=b"/Filter /ASCIIHexDecode")) == "packed words"
    assert pdf_text(pdf(said, head=b"/Filter /DCTDecode")) is None
    assert pdf_text(pdf(zlib.compress(b" " * (MOST_STREAM + 1)), head=b"/Filter /FlateDecode")) is None


def test_character_maps():
    font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>"
    assert pdf_text(pdf(b"BT /F1 9 Tf <4142430102444599> Tj ET", font=font, more=stream(4, CMAP))) == "abcé😀XY�"
    assert pdf_text(pdf(b"BT /F1 9 Tf <4142> Tj ET", font=b"<< /Type /Font /Subtype /Type0 >>")) is None


def test_first_pages_in_order_and_inner_nodes():
    many = [b"BT (p%d) Tj ET" % i for i in range(11)]
    assert pdf_text(pdf(*many)) == " ".join(f"p{i}" for i in range(8))
    assert pdf_text(pdf(*many), None) == " ".join(f"p{i}" for i in range(11))
    nested = pdf(b"BT (one) Tj ET", b"BT (two) Tj ET", more=b"").replace(b"/Kids [10 0 R 12 0 R]", b"/Kids [5 0 R 2 0 R 12 0 R]") + b"\n5 0 obj << /Type /Pages /Kids [10 0 R] >> endobj"
    assert pdf_text(nested) == "one two"  # a node within itself is left out


def test_objects_in_streams_and_saved_changes():
    inner = b"3 0 9 24 << /Type /Font >>        << /Type /Any >>"
    packed = stream(6, zlib.compress(inner), b"/Type /ObjStm /N 2 /First 9 /Filter /FlateDecode")
    assert pdf_text(pdf(b"BT (kept) Tj ET", more=packed)) == "kept"
    changed = pdf(b"BT (old) Tj ET") + b"\n" + stream(11, b"BT (new) Tj ET")
    assert pdf_text(changed) == "new"


def test_what_cannot_be_read_is_none():
    whole = pdf(b"BT (words) Tj ET")
    assert pdf_text(None) is pdf_text(b"") is pdf_text(b"<html>") is pdf_text(b"%PDF-1.4") is None
    assert pdf_text(pdf(b"BT (x) Tj ET", trailer=b"/Root 1 0 R /Encrypt 9 0 R")) is None
    assert pdf_text(pdf(b"BT (does not end Tj ET")) is None
    for n in range(len(whole)):
        assert pdf_text(whole[:n]) in (None, "", "words")
    assert pdf_text(pdf(b"0 0 m 9 9 l S")) == ""


def test_folder_and_plan(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(pdf(b"BT (" + b"report " * 60 + b") Tj ET"))
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    (tmp_path / "other.txt").write_bytes(b"text")
    rows = {r.file: (r.ok, r.error) for r in files.read_pdf(spark, str(tmp_path)).collect()}
    assert rows == {"good.pdf": (True, None), "bad.pdf": (False, "PDF_UNREADABLE")}
    pages = files.pdf_pages(spark, str(tmp_path)).selectExpr("concat('https://x.example.org/', substring_index(url, '/', -1)) AS url", "html", "pdf")
    pages = pages.unionByName(spark.createDataFrame([("https://x.example.org/page", "<p>" + "html " * 90, None)], pages.schema))
    items = spark.createDataFrame(
        [(n, i, 1, "crossref", "academic", f"https://x.example.org/{n}", f"Title of {n}", None, None, "short", None) for i, n in enumerate(["good.pdf", "bad.pdf", "page", "none.pdf"])],
        "id string, ord long, group_id long, source string, source_type string, url string, title string, author string, publish_date timestamp, text string, summary string",
    )
    got = {r.item_id: (r.status, r.method, r.text.split()[0]) for r in extraction.documents(items, pages).collect()}
    assert got["good.pdf"] == ("section_text", "pdf_text", "report") and got["page"] == ("section_text", "readable_html", "html")
    assert got["bad.pdf"] == got["none.pdf"] == ("snippet", "source_snippet", "Title")
