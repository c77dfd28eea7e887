import zipfile

from paperloom.sources import files, office
from paperloom.streaming import progress
from pyspark.sql import functions as F

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def build(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_office_source(spark, tmp_path):
    build(tmp_path / "a.docx", {"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>secret</w:t></w:r></w:p>'
          '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>', "word/vbaProject.bin": "m"})  # fmt: skip
    build(tmp_path / "b.xlsx", {"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/><sheet name="Off" state="hidden" r:id="r2"/></sheets></workbook>',
          "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
          "xl/sharedStrings.xml": f"<sst {S}><si><t>label</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>HYPERLINK("x")</f><v>5</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
          "xl/worksheets/sheet2.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>'})
    build(tmp_path / "c.pptx", {"ppt/slides/slide1.xml": f'<p:sld {A}><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Slide</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'})
    (tmp_path / "d.docx").write_text("no zip")
    office.register(spark)
    rows = [(r.kind, r.type, r.text, r.ref, r.hidden) for r in spark.read.format("office").load(str(tmp_path)).collect()]
    for want in [("docx", "heading", "Title", None, False), ("docx", "paragraph", "secret", None, True), ("docx", "cell", "y", "B1", False), ("docx", "active", "word/vbaProject.bin", None, False), ("xlsx", "cell", "label", "A1", False),
                 ("xlsx", "active", 'HYPERLINK("x")', "B1", False), ("xlsx", "cell", "7", "A1", True), ("xlsx", "merge", "", "A1:B1", False), ("pptx", "heading", "Slide", None, False), ("docx", "error", "BadZipFile", None, False)]:
        assert want in rows, want
    same = [(r.kind, r.type, r.text, r.ref, r.hidden) for r in office.packages(spark, str(tmp_path)).collect()]
    assert sorted(map(str, same)) == sorted(map(str, rows))


def test_references_and_serial_days():
    assert office.split_ref("B7") == (7, 2) and office.split_ref("AA10") == (10, 27) and office.split_ref("7B") is None
    assert office.make_ref(10, 27) == "AA10" and office.range_bounds("C3:A1") == (1, 1, 3, 3)
    assert office.serial_date(45658) == "2025-01-01" and office.serial_date(1) == "1900-01-01" and office.serial_date(0, True) == "1904-01-01"


def test_html_grid():
    grid, heads = files.html_grid("<table><tr><th colspan=2>H<tr><td rowspan=2>a<td>b</td></tr><tr><td>c</table>")
    assert grid == [["H", ""], ["a", "b"], ["", "c"]] and heads == 1
    wide, _ = files.html_grid("<table><tr><td colspan=150>a<td>b" + "<tr>" + "<td>c" * 151 + "</table>")
    assert len(wide[0]) == 151 and wide[0][150] == "b" and files.html_grid("<table><tr><td colspan=99999999 rowspan=99999999>a</table>")[0] == [["a", ""]]
    assert files.html_grid("<table></table><table></table>") is None and files.html_grid(None) is None


def test_sinks_and_logs(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("=1+1", 2), ("ok", -3)], "a string, b int"), f"{tmp_path}/csv")
    assert sorted(r.a for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()) == ["'=1+1", "ok"]
    (tmp_path / "log.jsonl").write_text('{"k": "a", "n": 1}\n{bad\n{"k": "a", "n": 3}\n{"k": "b", "n": 2}\n')
    got = files.latest(files.read_log(spark, f"{tmp_path}/log.jsonl", "k string, n int"), "k", "n").orderBy("k").collect()
    assert [(r.k, r.n) for r in got] == [("a", 3), ("b", 2)]


def test_names_and_magic(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.7"), "pdf", "../x\\y\x01.pdf"), (bytearray(b"PK\x03\x04"), "pdf", "a")], "c binary, e string, n string")
    got = df.select(files.magic_matches(F.col("c"), F.col("e")).alias("m"), files.file_name(F.col("n")).alias("n")).collect()
    assert [(r.m, r.n) for r in got] == [(True, "y.pdf"), (False, "a")]


def test_stream_ignores_late_and_repeated_events(spark, tmp_path):
    import json

    source = tmp_path / "in"
    source.mkdir()
    batches = [[(1, "running"), (2, "completed")], [(1, "running"), (2, "completed"), (3, "warning")]]
    query = None
    for k, events in enumerate(batches):
        lines = [json.dumps({"doc_id": "d", "stage": "parse", "state": s, "seq": n, "ts": f"2026-01-01T00:00:0{n}"}) for n, s in events]
        (source / f"{k}.json").write_text("\n".join(lines))
    stream = spark.readStream.schema("doc_id string, stage string, state string, seq long, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    query = progress.stage_states(stream).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    last = spark.sql("select * from states order by applied desc, dropped desc").head()
    assert (last.state, last.seq, last.applied + last.dropped) == ("warning", 3, 5)
