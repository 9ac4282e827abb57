"""Documents and workbooks against the standard library's XML reader, cut files and files of other writers."""

import zipfile
from pathlib import Path
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from shelfloom.sources import exchange as xc
from shelfloom.sources import workbook as wb

ODD = ["plain", "a & b", "<tag> \"q\" 'p'", "]]>", "x ]]> y ]]>", "&amp;", "two\nlines", "é 日本 😀", "bad\x01char", "", None, "&lt;Record&gt;"]


def test_document_is_well_formed_and_comes_back(spark, tmp_path):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ODD * 30)], "id int, v string").repartition(4)
    record = xc.group("Record", xc.element("Id", F.col("id")), xc.element("Text", F.col("v")), xc.verbatim("Raw", F.col("v")), xc.listed("List", "Entry", F.array("v", F.lit("<z>"))))
    path = f"{tmp_path}/doc"
    xc.write_document(df, path, "Records", record, "id", doctype='PUBLIC "-//x//DTD//EN" "x.dtd"')
    parts = sorted(Path(path).glob("*/part-*"), key=lambda p: (p.parent.name, p.name))
    root = ET.fromstring("".join(p.read_text() for p in parts))
    clean = [None if v is None else v.replace("\x01", "") for v in ODD * 30]
    assert [(int(e.find("Id").text), e.find("Text").text or None, e.find("Raw").text or None) for e in root] == [(i, v or None, v or None) for i, v in enumerate(clean)]
    r = F.col("record")
    for most in ("128m", "1k"):  # the file in one piece, or cut anywhere
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            got = xc.read_records(spark, path, "Record").select(xc.content(r, "Id").cast("int").alias("id"), xc.content(r, "None", "Text").alias("a"), xc.content(r, "Raw").alias("b"), xc.contents(r, "List", "Entry").alias("c")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted((x.id, x.a, x.b) for x in got) == [(i, v or None, v or None) for i, v in enumerate(clean)]
        assert all(x.c[-1] == "<z>" for x in got)
    xc.write_document(df.limit(0), f"{tmp_path}/none", "Records", record, "id")
    assert xc.read_records(spark, f"{tmp_path}/none", "Record").count() == 0


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def book(path, rows, shared=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="B" sheetId="4" r:id="rId9"/><sheet name="A" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/none.xml"/><Relationship Id="rId9" Target="/xl/worksheets/sheet7.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet7.xml", SHEET.format(rows))
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{"".join(f"<si>{s}</si>" for s in shared)}</sst>')


def test_workbooks_of_other_writers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    book(tmp_path / "a.xlsx", '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"/><row r="4"><c r="A4"><v>1.5</v></c><c r="C4" t="s"><v>2</v></c></row><row r="5"><c r="AB5" t="b"><v>1</v></c><c r="C5" t="e"><v>#N/A</v></c></row><row r="6"><c r="C6" t="str"><f>1</f><v>made</v></c></row>', ["<t>Code </t>", "<t>Name</t>", "<r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh>"])
    book(tmp_path / "sub" / "b.xlsx", '<row><c t="inlineStr"><is><t>Name</t></is></c></row><row><c t="inlineStr"><is><t>in &amp; line</t></is></c></row>')
    book(tmp_path / "c.xlsx", "")
    (tmp_path / "d.txt").write_text("no workbook")
    df = wb.read_workbooks(spark, str(tmp_path), ["Code", "Name"])
    assert df.rdd.getNumPartitions() == 3
    assert [(r.Code, r.Name) for r in df.orderBy("__row").collect()] == [("1.5", "two runs"), (None, None), (None, "made"), (None, "in & line")]
    assert wb.read_workbooks(spark, f"file://{tmp_path}/sub/b.xlsx", ["Name"]).select("Name").collect()[0][0] == "in & line"
    with pytest.raises(Exception, match="columns to read"):
        spark.read.format("workbook").load(str(tmp_path))


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, v, i / 4) for i, v in enumerate(ODD * 50)], "id int, v string, x double").repartition(3)
    done = wb.write_workbooks(df, f"file://{tmp_path}/out", most=70)
    assert done.agg(F.sum("rows"), F.max("rows")).first()[:] == (600, 70) and len(list((tmp_path / "out").glob("*.xlsx"))) == done.count()
    got = {int(r.id): (r.v, float(r.x)) for r in wb.read_workbooks(spark, f"file://{tmp_path}/out", ["id", "v", "x"]).collect()}
    assert got == {i: ((None if v is None else v.replace("\x01", "")), i / 4) for i, v in enumerate(ODD * 50)} or {k: (v or None, x) for k, (v, x) in got.items()} == {i: ((v or "").replace("\x01", "") or None, i / 4) for i, v in enumerate(ODD * 50)}
    assert wb.write_workbooks(df.limit(0), f"file://{tmp_path}/none").count() == 0
