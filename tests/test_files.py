"""Excel scans, and single files as published."""

from __future__ import annotations

import datetime
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.sources import files
from metricloom.sources.sheets import scan_excel

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(i: int) -> str:
    return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def workbook(path, sheets, strings=(), styles=(), late=False, absolute=False):
    """A workbook of sheets {name: XML of rows}; styles are number formats, by number or by code."""
    own = [s for s in styles if isinstance(s, str)]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><workbookPr date1904="{int(late)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if absolute else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}><numFmts>" + "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{c}"/>' for i, c in enumerate(own)) + "</numFmts><cellXfs>" + "".join(f'<xf numFmtId="{164 + own.index(s) if isinstance(s, str) else s}"/>' for s in styles) + "</cellXfs></styleSheet>")
        for i, rows in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f"<worksheet {MAIN}><sheetData>".encode())
                for r in [rows] if isinstance(rows, str) else rows:
                    f.write(r.encode())
                f.write(b"</sheetData></worksheet>")


def test_excel_cells_of_every_kind(spark, tmp_path):
    strings = ["<t>SMILES</t>", "<t>Eox</t>", "<r><t>two </t></r><r><t>runs &amp; more</t></r><rPh><t>no</t></rPh>", "<t>when</t>", "<t>flag</t>", "<t>n/a</t>"]
    rows = (
        '<row r="3"><c r="B3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c><c r="D3" t="s"><v>3</v></c><c r="AA3" t="s"><v>4</v></c><c r="AB3" t="s"><v>1</v></c></row>'
        '<row r="4"><c r="B4" t="s"><v>2</v></c><c r="C4"><v>1.25</v></c><c r="D4" s="1"><v>45292.5</v></c><c r="AA4" t="b"><v>1</v></c><c r="AB4"><v>99</v></c></row>'
        '<row r="5"/>'
        '<row r="7"><c r="B7" t="inlineStr"><is><t>CC</t></is></c><c r="C7" t="s"><v>5</v></c><c r="D7" s="2"><v>1</v></c><c r="AA7" t="e"><v>#N/A</v></c></row>'
        '<row r="8"><c r="B8"><v>12</v></c><c r="C8" t="str"><v>1e-3</v></c><c r="D8" t="d"><v>2024-05-06</v></c><c r="AA8" t="str"><v>FALSE</v></c></row>'
        '<row r="9"><c r="C9"><v>0.1</v></c><c r="D9" s="3"><v>3.5</v></c></row>'
    )
    workbook(tmp_path / "a.xlsx", {"other": "", "raw": rows}, strings, [0, 14, "yyyy&quot;m&quot;", '0.0&quot;day&quot;'])
    for sheet in ("raw", 1):
        df = scan_excel(spark, str(tmp_path / "a.xlsx"), "SMILES string, Eox double, when timestamp_ntz, flag boolean", sheet, row_index="at")
        assert [tuple(r) for r in df.collect()] == [
            (0, "two runs & more", 1.25, datetime.datetime(2024, 1, 1, 12), True),
            (3, "CC", None, datetime.datetime(1899, 12, 31), None),
            (4, "12", 0.001, datetime.datetime(2024, 5, 6), False),
            (5, None, 0.1, None, None),
        ]
    # only what is asked for, as whole numbers where they fit
    assert [r.Eox for r in scan_excel(spark, str(tmp_path / "a.xlsx"), "Eox int", "raw").collect()] == [None, None, None, None]
    assert scan_excel(spark, str(tmp_path / "a.xlsx"), "x string", "other").count() == 0
    for schema, sheet, says in (("gone string, SMILES string", "raw", "missing columns: gone"), ("SMILES string", "nope", "no sheet 'nope'")):
        with pytest.raises(Exception, match=says):
            scan_excel(spark, str(tmp_path / "a.xlsx"), schema, sheet).collect()


def test_excel_equals_its_csv_twin_over_many_files(spark, tmp_path):
    twin = []
    for k in range(3):
        rows = [(f"k{k}-{i}", i / 8, None if i % 7 == 0 else i) for i in range(500)]
        xml = ['<row><c t="inlineStr"><is><t>key</t></is></c><c t="inlineStr"><is><t>v</t></is></c><c t="inlineStr"><is><t>n</t></is></c></row>']
        xml += ["<row>" + f'<c t="inlineStr"><is><t>{a}</t></is></c><c><v>{b}</v></c>' + (f"<c><v>{c}</v></c>" if c is not None else "") + "</row>" for a, b, c in rows]
        workbook(tmp_path / f"{k}.xlsx", {"s": xml}, late=k == 1, absolute=k == 2)
        twin += rows
    assert sorted(map(tuple, scan_excel(spark, str(tmp_path / "*.xlsx"), "key string, v double, n long").collect())) == sorted(twin)


def test_a_sheet_of_a_million_rows(spark, tmp_path):
    """As large as a sheet can be; the worker's memory stays far below the sheet's 60 MB of XML as a tree."""
    rows = (f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}"><v>{i / 4}</v></c></row>' for i in range(2, 1_048_577))
    head = '<row r="1"><c r="A1" t="inlineStr"><is><t>i</t></is></c><c r="B1" t="inlineStr"><is><t>x</t></is></c></row>'
    workbook(tmp_path / "big.xlsx", {"s": (x for part in ([head], rows) for x in part)})
    got = scan_excel(spark, str(tmp_path / "big.xlsx"), "i long, x double").agg(F.count("i"), F.sum("i"), F.sum("x")).first()
    n = 1_048_575
    assert tuple(got) == (n, sum(range(2, n + 2)), sum(range(2, n + 2)) / 4)


def table_of(spark, n=200):
    rows = [(i * 37 % n, f'a "{i}", b' if i % 3 == 0 else f"é{i}", None if i % 5 == 0 else i / 7, i % 2 == 0, [i / 3, float("nan")] if i % 4 else None) for i in range(n)]
    return spark.createDataFrame(rows, "k int, s string, v double, b boolean, xs array<double>").repartition(5)


def test_one_csv_file_byte_for_byte(spark, tmp_path):
    df = table_of(spark).drop("xs").withColumn("tiny", F.col("v") * 1e-9).withColumn("line", F.concat(F.lit("x\n"), "s"))
    for bom in (True, False):
        files.write_csv_file(df, f"{tmp_path}/out.csv", "k", bom=bom)
        want = df.toPandas().sort_values("k").to_csv(index=False, lineterminator="\n").encode("utf-8-sig" if bom else "utf-8")
        assert (tmp_path / "out.csv").read_bytes() == want
    files.write_csv_file(df.limit(0), f"{tmp_path}/empty.csv", "k", newline="\r\n")
    assert (tmp_path / "empty.csv").read_bytes() == "﻿k,s,v,b,tiny,line\r\n".encode()
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["empty.csv", "out.csv"]


def test_one_json_array_as_published(spark, tmp_path):
    df = spark.createDataFrame([(2, "a/b", 1.0, [1 / 3, 2e-11], {"500": 0.0246415883, "1000": None}), (1, 'q"é', float("nan"), None, {}), (3, None, -0.0, [], None)], "k int, s string, v double, xs array<double>, m map<string,double>").repartition(3)
    files.write_json_array(df, f"{tmp_path}/out.json", "k")
    rows = [{"k": r.k, "s": r.s, "v": r.v, "xs": r.xs, "m": r.m} for r in df.orderBy("k").collect()]
    want = pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in rows[0]}).to_json(orient="records", indent=2)
    assert json.loads((tmp_path / "out.json").read_text()) == json.loads(want)
    files.write_json_array(df.where("k <> 3 AND size(m) > 0"), f"{tmp_path}/out.json", "k")
    full = [r for r in rows if r["k"] == 2]
    assert (tmp_path / "out.json").read_text() == pd.DataFrame({k: pd.Series([r[k] for r in full], dtype=object) for k in full[0]}).to_json(orient="records", indent=2)
    files.write_json_array(df.limit(0), f"{tmp_path}/empty.json")
    assert (tmp_path / "empty.json").read_text() == "[]"


def test_eighty_files_named_by_their_keys(spark, tmp_path):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "random").otherwise("scaffold").alias("split"), (11 * (1 + F.col("id") % 5)).alias("seed"), (500 * (1 + F.col("id") % 8)).alias("size"), "id").repartition(6)
    files.write_csv_files(df, str(tmp_path), F.format_string("%s_seed%d_train%d_indices.csv", "split", "seed", "size"), F.desc("id"))
    frame = df.toPandas()
    found = sorted(p for p in tmp_path.iterdir() if p.suffix == ".csv")
    assert len(found) == frame.groupby(["split", "seed", "size"]).ngroups == 40
    for (split, seed, size), part in frame.groupby(["split", "seed", "size"]):
        want = part.sort_values("id", ascending=False).to_csv(index=False, lineterminator="\n").encode("utf-8-sig")
        assert (tmp_path / f"{split}_seed{seed}_train{size}_indices.csv").read_bytes() == want


def test_a_failing_write_leaves_the_old_file(spark, tmp_path):
    df = table_of(spark).select("k", "s")
    files.write_csv_file(df, f"{tmp_path}/out.csv", "k")
    before = (tmp_path / "out.csv").read_bytes()
    bad = df.withColumn("s", F.when(F.col("k") == 150, F.raise_error(F.lit("lost"))).otherwise(F.col("s")))
    with pytest.raises(Exception, match="lost"):
        files.write_csv_file(bad, f"{tmp_path}/out.csv", "k")
    assert (tmp_path / "out.csv").read_bytes() == before
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["out.csv"]
