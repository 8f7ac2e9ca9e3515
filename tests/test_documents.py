"""Text of PDF and word-processor files that the tests make themselves."""

import io
import random
import zipfile
import zlib

from loam.sources import files, pdf


def made_pdf(pages, packed=True, in_streams=False, fonts=b""):
    """A PDF of content streams; objects in object streams where asked, without a cross-reference table."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages))) + b"] /Count %d /Resources << /Font << /F1 4 0 R /F2 5 0 R >> >> >>" % len(pages)}
    objects[4] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    objects[5] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"
    streams = {6: fonts}
    for k, content in enumerate(pages):
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        streams[11 + 2 * k] = content
    out = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
    if in_streams:
        heads, body = [], b""
        for number, text in objects.items():
            heads.append(b"%d %d" % (number, len(body)))
            body += text + b" "
        head = b" ".join(heads) + b"\n"
        data = zlib.compress(head + body)
        out += b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(objects), len(head), len(data)) + data + b"\nendstream\nendobj\n"
    else:
        for number, text in objects.items():
            out += b"%d 0 obj\n" % number + text + b"\nendobj\n"
    for number, text in streams.items():
        data = zlib.compress(text) if packed else text
        out += b"%d 0 obj\n<< /Length %d%s >>\nstream\r\n" % (number, len(data), b" /Filter [/FlateDecode]" if packed else b"") + data + b"\nendstream\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


CMAP = b"""/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <65E5> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <00790079>] endbfrange endcmap"""
PAGES = [
    b"BT /F1 12 Tf 72 700 Td (First line, \\(quoted\\) \\251 caf\\351) Tj 0 -14 Td [(Sec) 20 (ond) -250 (line)] TJ T* (third (nested) one) ' ET\n% (a comment) Tj\n q 1 0 0 1 0 0 cm Q",
    b"BT /F2 10 Tf 1 0 0 1 72 700 Tm <00010002> Tj <001000110012> Tj 1 0 0 1 172 700 Tm <0020> Tj 1 0 0 1 72 600 Tm <0021 0099> Tj ET",
    b"",
    b"BT /F1 9 Tf 50 50 Td (a) Tj 10 0 Td (b) Tj ET BI /W 1 ID (zz) Tj EI BT (c) Tj ET",
]
TEXTS = ["First line, (quoted) \u00a9 caf\u00e9\nSecond line\nthird (nested) one", "\u65e5\U0001f600ABCx\nyy\ufffd", "", "ab\nc"]


def test_pdf_pages():
    for packed in (True, False):
        for in_streams in (True, False):
            assert pdf.page_texts(made_pdf(PAGES, packed, in_streams, CMAP)) == TEXTS
    assert pdf.page_texts(b"no pdf") is None and pdf.page_texts(made_pdf(PAGES) + b" /Encrypt 7 0 R") is None
    assert pdf.page_texts(b"%PDF-1.4") == [] and pdf.page_texts(made_pdf([b"BT (x"])) is not None


def test_damaged_pdf():
    """Cut and altered files give some text or none, never an endless loop or an error."""
    rng, whole = random.Random(1), made_pdf(PAGES, False, False, CMAP)
    for _ in range(400):
        data = bytearray(whole[: rng.randint(10, len(whole))])
        for _ in range(rng.randint(0, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        assert pdf.page_texts(bytes(data)) is None or True


def test_documents(spark, tmp_path):
    paragraphs = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("one", "", "three é"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')
    made = {"a.pdf": made_pdf(PAGES, fonts=CMAP), "b.docx": packed.getvalue(), "c.txt": "é\nline\n".encode(), "d.txt": b"caf\xe9", "e.bin": b"\0", "f.PDF": b"broken", "g.docx": b"broken"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    got = {r["uri"].rsplit("/", 1)[1]: (r["text"], r["is_utf8"], r["starts"]) for r in files.documents(spark, str(tmp_path)).collect()}
    whole = "\n".join(TEXTS)
    starts = [sum(len(t) + 1 for t in TEXTS[:k]) for k in range(len(TEXTS))]
    assert got == {
        "a.pdf": (whole, True, starts), "b.docx": ("one\n\nthree é", True, [0, 4, 5]), "c.txt": ("é\nline\n", True, [0, 2, 7]), "d.txt": ("café", False, [0]),
        "e.bin": (None, False, None), "f.PDF": (None, False, None), "g.docx": (None, False, None),
    }
    assert all(whole[s : s + len(t)] == t for s, t in zip(starts, TEXTS))
