"""Readers and writers, the catalogue of files, kept stores."""

import hashlib
import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gregale.sources import batches


def export(path, *rows):
    path.write_text(json.dumps({"amendements": list(rows)}), encoding="utf-8")
    return str(path)


def test_malformed_exports_are_errors(spark, tmp_path):
    good = export(tmp_path / "a.json", {"num": 1})
    (tmp_path / "b.json").write_text('{"amendements": [{"num": 1}, {"nu')
    assert batches.read_exports(spark, [good]).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        batches.read_exports(spark, [good, str(tmp_path / "b.json")]).collect()


def test_rows_follow_the_given_order(spark, tmp_path):
    one, two = export(tmp_path / "z.json", {"num": 7}, {"num": 8}), export(tmp_path / "a.json", {"num": 1, "more": "x"})
    got = batches.read_exports(spark, [one, two]).orderBy("amdt_idx").collect()
    assert [(r.amdt_idx, r["Num amdt"], r.more) for r in got] == [(0, 7, None), (1, 8, None), (2, 1, "x")]


def test_open_exports(spark, tmp_path):
    """Numbers as text, fields that no one named, values of several types, places with spaces, one file twice."""
    one = export(tmp_path / "a b+%41.json", {"num": "1", "score": 1.5, "flag": True, "tags": ["x", {"y": 1}], "computed_batch": [1, 2]}, {"num": "12 rect.", "legislature": 17, "chambre": "AN", "score": 2, "mixed": 1, "tags": None})
    two = export(tmp_path / "c.json", {"num": 3, "mixed": "é", "odd \"name\"": "z"})
    df = batches.read_exports(spark, [one, two, one])
    rows = df.orderBy("amdt_idx").collect()
    assert [r["Num amdt"] for r in rows] == ["1", "12 rect.", "3", "1", "12 rect."] and [r.amdt_idx for r in rows] == list(range(5))
    assert [(r.score, r.mixed) for r in rows[:3]] == [(1.5, None), (2.0, "1"), (None, "é")]
    assert rows[0].flag is True and rows[0].tags == '["x",{"y":1}]' and rows[0]["Allotissement"] == "1,2" and rows[2]['odd "name"'] == "z" and rows[1].Lecture == "AN 17"
    assert rows[0].file_hash == rows[4].file_hash == hashlib.sha256((tmp_path / "a b+%41.json").read_bytes()).hexdigest() != rows[2].file_hash
    assert dict(df.dtypes)["Num amdt"] == "string" and dict(batches.read_exports(spark, [export(tmp_path / "d.json", {"num": 4})]).dtypes)["Num amdt"] == "bigint"


def test_exports_without_an_array_of_rows_are_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"other": [{"num": 1}]}')
    with pytest.raises(Exception, match="no array"):
        batches.read_exports(spark, [str(tmp_path / "a.json")]).collect()
    assert batches.read_exports(spark, [export(tmp_path / "b.json")]).count() == 0


def test_sheets_are_found_by_their_relationships(tmp_path):
    """A workbook whose parts are in another order than its sheets."""
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda v: f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Second" sheetId="2" r:id="r2"/><sheet name="First" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="t" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet("one"))
        z.writestr("xl/worksheets/sheet2.xml", sheet("two"))
    found = batches.sheets((tmp_path / "w.xlsx").read_bytes())
    assert {k: v.name.tolist() for k, v in found.items()} == {"First": ["one"], "Second": ["two"]}


def test_first_modification(spark, tmp_path):
    a = export(tmp_path / "a.json", {"date_derniere_modif": ""}, {"date_derniere_modif": "soon"}, {"date_derniere_modif": "2025-01-30 14:55:20.366848"}, {"date_derniere_modif": "2020-01-01 00:00:00"})
    b = export(tmp_path / "b.json", {"num": 1})
    assert {r.file[-6:]: r.seconds for r in batches.first_modification(spark, [a, b]).collect()} == {"a.json": 1738248920, "b.json": None}


def test_workbooks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "é<&>", None, 1), (1, " x ", "y", 2), (2, None, "z", 3)], "amdt_idx long, `Num amdt` string, Organe string, other int")
    books = batches.workbooks(df, ["Num amdt", "Organe", "nowhere"], rows=2).orderBy("part").collect()
    assert len(books) == 2
    for b in books:
        (tmp_path / f"{b.part}.xlsx").write_bytes(bytes(b.content))
    assert list(batches.sheets(bytes(books[0].content))["Sheet1"].columns) == ["amdt_idx", "Num amdt", "Organe"]
    with zipfile.ZipFile(io.BytesIO(bytes(books[0].content))) as z:
        assert z.testzip() is None
    paths = [str(tmp_path / f"{i}.xlsx") for i in (0, 1)]
    back = batches.HANDLERS[".xlsx"](spark, paths, sheet="Sheet1", project="P", default_time=5).orderBy("amdt_idx").collect()
    assert [(r.amdt_idx, r["Num amdt"], r.Organe, r["timestamp"], r.origin_project) for r in back] == [(0, "é<&>", None, 5, "P"), (1, " x ", "y", 5, "P"), (2, None, "z", 5, "P")]


def test_export_names_in_workbooks(spark, tmp_path):
    (tmp_path / "n.xlsx").write_bytes(batches.workbook(pd.DataFrame({"num": ["1"], "chambre": ["AN"], "legislature": ["17"]}), "Amendements"))
    r = batches.load(spark, [str(tmp_path / "n.xlsx")]).first()
    assert (r["Num amdt"], r.Lecture) == ("1", "AN 17")


def test_load_by_extension(spark, tmp_path):
    (tmp_path / "x.txt").write_text("?")
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    df.write.parquet(str(tmp_path / "p.parquet"))
    paths = [str(tmp_path / "p.parquet"), str(tmp_path / "x.txt")]
    assert batches.load(spark, paths).count() == 1 and batches.load(spark, paths[1:]) is None
    with pytest.raises(ValueError, match="no reader"):
        batches.load(spark, paths, strict=True)


def test_csv_begins_with_a_mark(spark, tmp_path):
    batches.write_csv(spark.createDataFrame([(1, " é ")], "id long, t string").coalesce(1), str(tmp_path / "o.csv"))
    part = next((tmp_path / "o.csv").glob("part-*")).read_bytes()
    assert part.startswith("﻿id;t\n".encode()) and part.decode("utf-8-sig").splitlines()[1] == "1; é "


def test_store_table_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "A"), (2, None, "B")], "id long, l array<long>, origin_project string")
    batches.write_store(df, str(tmp_path / "s"), "origin_project")
    assert {(r.id, r.l) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(1, "[1,2]"), (2, None)}
    (tmp_path / "pool").mkdir()
    for name in ("ab1.json", "ab2.json", "cd.json"):
        (tmp_path / "pool" / name).write_text(name)
    found = {r.name: r.length for r in batches.files(spark, str(tmp_path / "pool"), "ab").collect()}
    assert found == {"ab1.json": 8, "ab2.json": 8}
    assert batches.exists(spark, str(tmp_path / "pool/cd.json")) and batches.delete(spark, str(tmp_path / "pool/cd.json"))
    assert not batches.exists(spark, str(tmp_path / "pool/cd.json")) and not batches.delete(spark, str(tmp_path / "pool/cd.json"))


def test_kept_stores(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "s.parquet"))
    stores = batches.Stores(spark)
    one = stores.get(" Base.parquet", str(tmp_path / "s.parquet"))
    assert stores.get("base", "nowhere") is one and stores.info() == {"base": {"rows": 3, "columns": ["id"]}}
    assert stores.remove("BASE") and not stores.remove("base")
    stores.get("x", str(tmp_path / "s.parquet"))
    stores.clear()
    assert stores.info() == {}


def test_catalogue_of_files(spark, tmp_path):
    export(tmp_path / "a.json", {"num": 1}, {"num": 2})
    export(tmp_path / "b.json", {"num": 3})
    entry = lambda p, o: {"path": p, "default_processing_timestamp": {"year": 2020, "month": 7, "day": 1}, "origin_project": o}
    config = {"projects": {"X": {"json_configs": [entry("a.json", "X 2020")], "excel_configs": []}, "Y": {"json_configs": [entry("b.json", "Y 2020")], "excel_configs": []}}}
    assert batches.catalogue(config, ["X"]) == [{"path": "a.json", "project": "X 2020", "default_time": 1593561600}]
    got = batches.load_catalogue(spark, config, root=f"{tmp_path}/").orderBy("amdt_idx").collect()
    assert [(r.amdt_idx, r["Num amdt"], r.origin_project, r["timestamp"]) for r in got] == [(0, 1, "X 2020", 1593561600), (1, 2, "X 2020", 1593561600), (2, 3, "Y 2020", 1593561600)]
    for bad in ({}, {"projects": {"X": {"json_configs": []}}}, {"projects": {"X": {"json_configs": [{"path": "a"}], "excel_configs": []}}}):
        with pytest.raises(ValueError):
            batches.catalogue(bad)
    with pytest.raises(ValueError, match="unknown project"):
        batches.catalogue(config, ["Z"])


def test_preview_and_known_columns(spark):
    df = spark.range(20).withColumn("t", F.when(F.col("id") > 0, "x"))
    assert batches.preview(df).count() == 10 and batches.preview(df).orderBy("id").first().t == ""
    assert batches.select_known(df, ["t", "nowhere"]).columns == ["t"]
