import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.functions import models
from corvane.sources import exposition, files, parsers


def test_object_keys():
    assert files.object_path("/r", "a/b") == "/r/a/b"
    for bad in ("../x", "/etc", "a/../../b", ""):
        with pytest.raises(ValueError):
            files.object_path("/r", bad)
    with pytest.raises(ValueError):
        files.object_root("tape", "/x")


def test_read_write_objects(spark, tmp_path):
    root = f"file://{tmp_path}"
    files.put_object(spark, root, "a/one.txt", b"abc")
    files.put_object(spark, root, "two.bin", b"x" * 10)
    got = {r.original_object_key: r.content for r in files.read_objects(spark, root, most_bytes=5).collect()}
    assert got == {"a/one.txt": bytearray(b"abc"), "two.bin": None}
    assert files.delete_object(spark, root, "two.bin")


def test_uploads(spark):
    rows = [("a.txt", b"hello", None), ("a.pdf", b"%PDF-1.4", None), ("a.pdf", b"hello", "contents_differ"), ("a.exe", b"MZ", "unsupported_type"), ("a.txt", b"\x89PNG\r\n\x1a\n", "contents_differ"), ("a.md", b"a\x00b", "binary_contents"), ("noext", b"x", "unsupported_type"), ("a.txt", b"", "empty")]
    frame = spark.createDataFrame([(i, n, bytearray(c)) for i, (n, c, _) in enumerate(rows)], "position int, filename string, content binary")
    got = [r.detail for r in files.submit_batch(frame).orderBy("position").collect()]
    assert got == [d for _, _, d in rows]
    assert files.submit_batch(frame, most=2).where("detail = 'too_many_files'").count() == 6


def test_markdown_and_html():
    assert parsers.parse_markdown(b"intro\n# A #\nbody\n  # B\nmore\n#tag\n") == [parsers.section("intro"), parsers.section("body", "A #"), parsers.section("more", "# B")]
    got = parsers.parse_html(b"lost<h1>T</h1><p>a</p><script>x</script><p>b &amp; c</p><h2>U</h2><div><p>d</p></div>")
    assert got == [parsers.section("a\nb & c", "T"), parsers.section("d", "U")]
    assert parsers.parse_html(b"<h1>only</h1>") == []
    assert parsers.parse_html(b"<p>x</p><p>y</p>") == [parsers.section("x\ny")]


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_office(spark):
    w = 'xmlns:w="w"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert parsers.parse_docx(archive({"word/document.xml": doc})) == [parsers.section("text", "Head"), parsers.section("| a |\n| --- |\n| b |", "Head", kind="table")]
    sheet = '<s xmlns="x"><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row><row><c/></row></sheetData></s>'
    book = archive({"xl/workbook.xml": '<w xmlns="x"><sheets><sheet name="S"/></sheets></w>', "xl/sharedStrings.xml": '<s xmlns="x"><si><t>k</t></si></s>', "xl/worksheets/sheet1.xml": sheet})
    assert parsers.parse_xlsx(book) == [parsers.section("k | 2", "S", kind="table")]
    slide = '<p xmlns:a="a"><sp><ph type="title"/><a:p><a:t>T</a:t></a:p></sp><sp><a:p><a:t>x</a:t></a:p></sp></p>'
    assert parsers.parse_pptx(archive({"ppt/slides/slide1.xml": slide})) == [parsers.section("x", "T", 1)]
    bomb = archive({"word/document.xml": b"0" * 3_000_000})
    assert "unpacks" in parsers.parse("a.docx", bomb)["error"]
    assert parsers.parse("a.docx", b"PK nothing")["error"] == "corrupt archive"
    assert parsers.parse("a.txt", b"")["error"] == "empty file"


def test_exposition_round_trip(spark):
    samples = spark.createDataFrame([("m", {"b": "2", "a": "1"}, 3.0), ("n", {}, 1.5)], "metric string, labels map<string,string>, value double")
    text = exposition.exposition(samples, {"m": "help m", "n": "help n"}).first().text
    assert text == '# HELP m help m\n# TYPE m gauge\nm{a="1",b="2"} 3.0\n# HELP n help n\n# TYPE n gauge\nn 1.5\n'
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "value string")
    assert {(r.metric, tuple(sorted(r.labels.items())), r.sample) for r in exposition.read_exposition(lines).collect()} == {("m", (("a", "1"), ("b", "2")), 3.0), ("n", (), 1.5)}


def test_syslog(spark):
    rows = spark.sql("select '1' as id, 's' as actor_sub, 'u' as actor_username, 'query.denied' as action, null as target_id, 'a\nb' as detail, timestamp '2024-01-01' as created_at")
    line = rows.select(exposition.syslog_line("search", "h", 7)).first()[0]
    assert line.startswith("<108>1 2024-01-01T00:00:00.000000Z h corvane-search 7 query.denied - {") and "\n" not in line


def test_vocabulary():
    assert exposition.parse_vocabulary("A:0, B:1") == [("A", 0), ("B", 1)]
    for bad in ("A:0,A:1", "A:0,B:0", ""):
        with pytest.raises(ValueError):
            exposition.parse_vocabulary(bad)


def test_replies(spark):
    frame = spark.createDataFrame([('{"classification": "secret", "doc_type": " ", "confidence": 3}',), ("nonsense",)], "r string")
    a, b = frame.select(models.parse_suggestion(F.col("r"), ["CUI", "SECRET"]).alias("s")).collect()
    assert (a.s.suggested_classification, a.s.suggested_doc_type, a.s.confidence) == ("SECRET", None, 1.0) and b.s.suggested_classification is None
    said = spark.createDataFrame([('{"verdicts": [{"index": 0, "likely_false_positive": true}, {"index": 0, "likely_false_positive": false}, {"index": 9, "likely_false_positive": true}]}',)], "r string")
    assert {k: v.likely_false_positive for k, v in said.select(models.parse_verdicts(F.col("r"), F.lit(2))).first()[0].items()} == {0: True}
    vectors = frame.select(models.dense_embedder(models.hashed_vectors)("r").alias("v")).collect()
    assert all(len(r.v) == 64 for r in vectors)
