import io
import zipfile

from quillstone.sources import files


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_elements(spark, tmp_path):
    docx = _zip({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Risks</w:t></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:t>Next</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>'})
    xlsx = _zip({"xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>2024</v></c><c><v>12345</v></c></row></sheetData></worksheet>', "xl/sharedStrings.xml": f"<sst {S}><si><t>Revenue</t></si></sst>"})
    for name, content in {
        "a.md": b"# Title\n\nSome words here.\nUnder\n=====\n| x | 1 |\n|---|---|\n\fSecond page", "b.md": b"# Title\n\nSome words here.\nUnder\n=====\n| x | 1 |\n|---|---|\n\fSecond page",
        "c.docx": docx, "d.xlsx": xlsx, "e.txt": b"short", "f.docx": b"not a zip", "g.csv": b"a,b", "h.txt": "caf\xe9 au lait, twenty characters".encode("latin-1"),
    }.items():
        (tmp_path / name).write_bytes(content)
    found = {}
    for r in files.elements(spark, str(tmp_path)).orderBy("path", "place").collect():
        found.setdefault(r.path.rsplit('/', 1)[-1], []).append(r.error or (r.page, r.kind, r.level, r.text))
    assert found["a.md"] == [(1, "heading", 1, "Title"), (1, "text", 0, "Some words here."), (1, "heading", 1, "Under"), (1, "row", 0, "x | 1"), (2, "text", 0, "Second page")]
    assert found["c.docx"] == [(1, "heading", 2, "Risks"), (2, "text", 0, "Next"), (2, "row", 0, "a | ")]
    assert found["d.xlsx"] == [(1, "row", 0, "Revenue | 2024 | 12,345")]
    assert (found["e.txt"], found["f.docx"], found["g.csv"]) == (["empty"], ["content does not match the extension"], ["unsupported_format"])
    assert "b.md" not in found and found["h.txt"] == [(1, "text", 0, "café au lait, twenty characters")]


def test_replace_document(spark, tmp_path):
    path = str(tmp_path / "facts")
    files.replace_document(spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, v int"), path)
    files.replace_document(spark.createDataFrame([("b", 3)], "document_id string, v int"), path)
    assert sorted((r.document_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
