import io
import sqlite3
import struct
import zipfile

import pytest

from hubloom.sources import formats as X
from hubloom.sources import readers as R


def test_workbook_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(1, "x & <y>", 2.5, True), (2, None, float("nan"), False), (3, " קו ", 1e300, None)], "id long, name string, v double, flag boolean")
    b = spark.createDataFrame([], "only string")
    at = str(tmp_path / "w.xlsx")
    X.write_workbook({"first": a, "a/b": b}, at)
    got = {(r.sheet, r.row_no): r.cells for r in R.table_by_suffix(spark, at).collect()}
    assert got == {("first", 1): {"id": "1", "name": "x & <y>", "v": "2.5", "flag": "True"}, ("first", 2): {"id": "2", "flag": "False"}, ("first", 3): {"id": "3", "name": " קו ", "v": "1e+300"}}
    assert b'width="9"' in zipfile.ZipFile(at).read("xl/worksheets/sheet1.xml")


def shared_strings():
    out = io.BytesIO()
    ns = X._MAIN[1:-1]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{X._REL[1:-1]}"><sheets><sheet name="National" r:id="a"/><sheet name="broken" r:id="b"/><sheet name="gone" r:id="c"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><r Id="a" Target="worksheets/s.xml"/><r Id="b" Target="/xl/worksheets/t.xml"/><r Id="c" Target="worksheets/none.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Node</t></si><si><r><t>Board</t></r><r><t>ings</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2"/><c r="C2"><v>9</v></c><c r="AB2"><v>1.5</v></c></row><row/></sheetData></worksheet>')
        z.writestr("xl/worksheets/t.xml", "<worksheet><row>")
    return out.getvalue()


def test_shared_strings_and_broken_sheets(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(shared_strings())
    (tmp_path / "v.xlsx").write_bytes(b"no zip")
    rows = R.demand_workbook(spark, [str(tmp_path / "w.xlsx"), str(tmp_path / "v.xlsx")]).collect()
    assert [(r.model, r.row_no, r.body) for r in rows if r.error is None] == [("Rail", 1, '{"Node":"7","C":"9","Boardings":"1.5"}')]
    assert sorted(str(r.sheet) for r in rows if r.error) == ["None", "broken", "gone"]


def polygon(*rings):
    points = [p for r in rings for p in r]
    starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    return struct.pack(f"<i4d2i{len(rings)}i", 5, 0, 0, 0, 0, len(rings), len(points), *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def test_shapefile(spark, tmp_path):
    shell, hole, other = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)], [(20, 0), (20, 1), (21, 1), (20, 0)]
    records = [struct.pack("<i2d", 1, 3.5, 4), polygon(shell, hole), polygon(other, shell, hole), struct.pack("<i", 0)]
    body = b"".join(struct.pack(">2i", k, len(r) // 2) + r for k, r in enumerate(records, 1))
    (tmp_path / "z.shp").write_bytes(bytes(100) + body)
    names = ["תחנה", "b", "", "d"]
    rows = b"".join(b" " + n.encode("windows-1255").ljust(6) + str(k).rjust(3).encode() for k, n in enumerate(names))
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([w]) + bytes(15) for n, w in (("NAME", 6), ("K", 3)))
    (tmp_path / "z.dbf").write_bytes(struct.pack("<4xIHH20x", 4, 32 + 64 + 1, 10) + fields + b"\r" + rows)
    got = R.table_by_suffix(spark, str(tmp_path / "z.shp"), "windows-1255").collect()
    assert [r.geometry for r in got] == [
        "POINT (3.5 4.0)", "POLYGON ((0.0 0.0, 0.0 9.0, 9.0 9.0, 9.0 0.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 1.0))",
        "MULTIPOLYGON (((20.0 0.0, 20.0 1.0, 21.0 1.0, 20.0 0.0)), ((0.0 0.0, 0.0 9.0, 9.0 9.0, 9.0 0.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 1.0)))", None,
    ]
    assert [r.properties for r in got] == [{"NAME": "תחנה", "K": "0"}, {"NAME": "b", "K": "1"}, {"K": "2"}, {"NAME": "d", "K": "3"}]
    (tmp_path / "z.dbf").unlink()
    assert [r.properties for r in X.vector_layer(spark, str(tmp_path / "z.shp")).collect()] == [{}] * 4


def test_geopackage(spark, tmp_path):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('hubs', 'geom')")
    con.execute("CREATE TABLE hubs (id INTEGER, geom BLOB, name TEXT)")
    head = b"GP\0\1" + struct.pack("<i", 2039)
    enveloped = b"GP\0\3" + struct.pack("<i4d", 2039, 0, 0, 1, 1)
    point = struct.pack("<BI2d", 1, 1, 5, 6)
    ring = struct.pack("<BII3d3d3d3d", 1, 1003, 1, *[0.0] * 12)[:9] + struct.pack("<I12d", 4, 0, 0, 7, 0, 1, 7, 1, 1, 7, 0, 0, 7)
    many = struct.pack(">BII", 0, 4, 2) + struct.pack(">BI2d", 0, 1, 1, 2) + point
    for k, g in enumerate((head + point, enveloped + ring, head + many, None)):
        con.execute("INSERT INTO hubs VALUES (?, ?, ?)", (k, g, "n" if k else None))
    (tmp_path / "h.gpkg").write_bytes(con.serialize())
    got = R.table_by_suffix(spark, str(tmp_path / "h.gpkg")).collect()
    assert [r.geometry for r in got] == ["POINT (5.0 6.0)", "POLYGON ((0.0 0.0, 0.0 1.0, 1.0 1.0, 0.0 0.0))", "MULTIPOINT ((1.0 2.0), (5.0 6.0))", None]
    assert got[0].properties == {"id": "0"} and got[1].properties == {"id": "1", "name": "n"} and got[0].layer == "hubs"


def test_no_reader(spark):
    with pytest.raises(ValueError):
        X.vector_layer(spark, "x.kml")
