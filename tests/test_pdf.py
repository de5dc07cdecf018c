"""PDF files written here, read back as spans and blocks."""

import zlib

from candela.sources import pdf, tables


def written(pages, flate):
    """A PDF of pages; a page is a list of (x, y, size, bold, lines), each a block with a leading of 1.2 sizes."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /BaseFont /Times-Roman >>", 4: b"<< /Type /Font /BaseFont /Times-Bold >>"}
    kids = []
    for i, blocks in enumerate(pages):
        content = b""
        for x, y, size, bold, lines in blocks:
            shown = b" T* ".join(b"(" + t.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for t in lines)
            content += b"BT /F%d %g Tf %g TL 1 0 0 1 %g %g Tm %s ET\n" % (2 if bold else 1, size, 1.2 * size, x, y, shown)
        head = b""
        if flate:
            content, head = zlib.compress(content), b"/Filter /FlateDecode "
        page, stream = 10 + 2 * i, 11 + 2 * i
        kids.append(b"%d 0 R" % page)
        objects[page] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % stream
        objects[stream] = b"<< %s/Length %d >>\nstream\n%s\nendstream" % (head, len(content), content)
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 600 800] >>" % (b" ".join(kids), len(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in objects.items()) + b"%%EOF"


PAGES = [[(50, 780, 9, False, [f"Manual, page {k}"]), (50, 700, 18, False, [["Pumps (all)", "Valves", "Seals"][k - 1]]), (50, 650, 11, False, [f"The first column of page {k} has an exam-", "ple of a cut word \\ and a café."]), (350, 650, 11, False, [f"The second column of page {k} follows."]), (50, 600, 11, True, [["Care", "Risk", "Use"][k - 1]]), (50, 570, 11, False, ["Too short"])] for k in (1, 2, 3)]


def test_spans_keep_place_and_font():
    for flate in (False, True):
        got = pdf.spans("x.pdf", written(PAGES, flate))
        assert [(s["page"], s["size"], s["bold"]) for s in got[:2]] == [(1, 9.0, False), (1, 18.0, False)]
        assert got[1]["text"] == "Pumps (all)" and got[2]["block"] == got[3]["block"] and (got[2]["line"], got[3]["line"]) == (0, 1)
        assert got[3]["text"].endswith("\\ and a café.") and abs(got[3]["y0"] - 163.2) < 1e-9 and [s["text"] for s in got if s["bold"]] == ["Care", "Risk", "Use"]


def test_texts_in_arrays_and_hex():
    content = b"BT /F1 10 Tf 0 -12 Td [(one)-300(two) 20 (x)] TJ <414243> Tj ET"
    assert [(t, y) for _, y, _, _, t in pdf._shown(content, {})] == [("one twox", -12.0), ("ABC", -12.0)]


def test_blocks_of_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(written(PAGES, True))
    (tmp_path / "bad.pdf").write_bytes(b"no such thing")
    (tmp_path / "c.txt").write_text("not read")
    rows = pdf.pdf_blocks(tables.scan_folder(spark, str(tmp_path))).orderBy("source", "ord").collect()
    assert [(r["source"], r["error"]) for r in rows if r["error"]] == [("bad.pdf", "ValueError: no catalog: not a PDF, or one that is encrypted")]
    first = [(r["kind"], r["level"], r["text"]) for r in rows if r["source"] == "a.pdf" and r["page"] == 1]
    # The head recurs and goes, the short paragraph goes, the left column comes first, bold headings of the body's size come last.
    assert first == [("heading", 1, "Pumps (all)"), ("paragraph", 0, "The first column of page 1 has an example of a cut word \\ and a café."), ("heading", 2, "Care"), ("paragraph", 0, "The second column of page 1 follows.")]
    assert len(rows) == 13
