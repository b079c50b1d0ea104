import zipfile

import pytest

from folio.sources import files


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.TXT").write_text("First line\nSecond line")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe broken")
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:document>')
    with zipfile.ZipFile(tmp_path / "f.epub", "w") as z:
        z.writestr("ch1.xhtml", "<html><script>no</script><p>Chapter one</p><p>Text &amp; more</p></html>")
        z.writestr("ch2.html", "<p>Chapter two</p>")
    return str(tmp_path)


def test_documents_by_extension(spark, folder):
    rows = {(r["name"], r["page_num"]): r for r in files.read_documents(spark, folder).collect()}
    assert rows["a.TXT", 1]["text"] == "First line\nSecond line"
    assert rows["e.docx", 1]["text"] == "One two\nThree"
    assert rows["f.epub", 1]["text"].split("\n") == ["Chapter one", "Text & more"]
    assert rows["f.epub", 2]["text"] == "Chapter two"
    assert "UnicodeDecodeError" in rows["b.md", None]["error"]
    assert "unsupported" in rows["c.xyz", None]["error"]
    assert "PDF" in rows["d.pdf", None]["error"]


def test_a_pdf_decoder_can_be_given(spark, folder):
    rows = files.read_documents(spark, folder, pdf=lambda raw: [raw.decode(), "page 2"]).where("extension = '.pdf'").collect()
    assert [(r["page_num"], r["text"]) for r in rows] == [(1, "%PDF"), (2, "page 2")]


def test_structured_segments_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(None, " Hi ", None), ("John", "", ["x"]), ("Mary", "Yes", ["y"])], files.SEGMENT)
    files.write_structured(rows, str(tmp_path / "out"))
    back = files.read_structured(spark, str(tmp_path / "out"))
    assert sorted((r["speaker"], r["text"]) for r in back.collect()) == [("Mary", "Yes"), ("narrator", "Hi")]


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "job int, status string, at int")
    new = spark.createDataFrame([(1, "c", 2), (2, "d", 3), (3, "e", 1)], old.schema)
    assert sorted(map(tuple, files.upsert(old, new, "job", "at").collect())) == [(1, "c", 2), (2, "b", 5), (3, "e", 1)]


def test_typed_rows_have_ids(spark):
    rows = files.typed_rows(spark, [{"text_content": "x", "metadata": {"a": "1"}, "timestamp": "2024-01-01T00:00:00"}]).first()
    assert len(rows["job_id"]) == 36 and rows["metadata"] == '{"a":"1"}'
