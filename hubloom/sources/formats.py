"""Workbooks, shapefiles and geopackages, read from their bytes: files are tasks, nothing is unpacked to a disk."""

from __future__ import annotations

import io
import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterable, Iterator, Mapping
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of a sheet, its head among them, and characters of a cell.
SHEET_ROWS, CELL_CHARS = 1_048_576, 32_767


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


# workbooks ----------------------------------------------------------------------------------------------


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def _texts(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))


def sheets(content: bytes) -> Iterator[tuple[str, int, dict[str, str] | None, str | None]]:
    """sheet, row from 1, cells by the first row's names, error: the rows of every sheet; of one that can't be read one row with the error.

    Empty rows and cells are left out; a column without a name is named by its letters.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_texts(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            name, target = s.get("name"), targets[s.get(f"{_REL}id")]
            try:
                yield from ((name, *row, None) for row in _rows(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}", shared))
            except (KeyError, ET.ParseError, ValueError, zipfile.BadZipFile) as e:
                yield name, 0, None, f"{type(e).__name__}: {e}"


def _rows(z: zipfile.ZipFile, at: str, shared: list[str]) -> Iterator[tuple[int, dict[str, str]]]:
    head: dict[int, str] | None = None
    with z.open(at) as f:
        n = 0
        for _, row in ET.iterparse(f):
            if row.tag != f"{_MAIN}row":
                continue
            cells = {}
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                value = _texts(c) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                if value not in (None, ""):
                    cells[_column(c.get("r")) if c.get("r") else k] = value
            row.clear()
            if head is None:
                head = {k: v.strip() for k, v in cells.items()}
                continue
            n += 1
            if cells:
                yield n, {head.get(k) or _letters(k): v for k, v in cells.items()}


def workbook(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, sheet, row_no, cells, error: every row of every sheet of the workbooks. A workbook is one task's."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(name, *r) for r in sheets(content)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    rows = [(name, None, 0, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells", "error"])

    return _files(spark, path).mapInPandas(read, "path string, sheet string, row_no bigint, cells map<string,string>, error string")


def _sheet_xml(columns: list[str], rows: Iterable) -> tuple[str, list[str]]:
    widths = [len(c) for c in columns]
    body = []

    def cell(k: int, n: int, v: object) -> str:
        if v is None or v != v:
            return ""
        widths[k] = max(widths[k], len(str(v)))
        at = f"{_letters(k)}{n}"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            text = escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))
            if len(text) > CELL_CHARS:
                raise ValueError(f"a cell holds at most {CELL_CHARS} characters")
            return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'
        return f'<c r="{at}"><v>{v!r}</v></c>'

    for n, row in enumerate((columns, *rows), 1):
        if n > SHEET_ROWS:
            raise ValueError(f"a sheet holds at most {SHEET_ROWS} rows")
        body.append(f'<row r="{n}">{"".join(cell(k, n, v) for k, v in enumerate(row))}</row>')
    cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{min(w + 2, 80)}" customWidth="1"/>' for k, w in enumerate(widths))
    return f'<worksheet xmlns="{_MAIN[1:-1]}">' + (f"<cols>{cols}</cols>" if cols else "") + "<sheetData>", body


def workbook_bytes(tables: Mapping[str, tuple[list[str], Iterable]]) -> bytes:
    """A workbook of sheets, each with its columns' names and rows; columns are as wide as what they hold."""
    out = io.BytesIO()
    names = [re.sub(r"[\[\]:*?/\\]", "_", t)[:31] for t in tables]
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, t in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{listed}</sheets></workbook>')
        linked = "".join(f'<Relationship Id="r{k}" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{linked}</Relationships>')
        for k, (columns, rows) in enumerate(tables.values(), 1):
            head, body = _sheet_xml(columns, rows)
            z.writestr(f"xl/worksheets/sheet{k}.xml", head + "".join(body) + "</sheetData></worksheet>")
    return out.getvalue()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file on any file system that Spark can reach."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    f = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        f.write(content)
    finally:
        f.close()


def write_workbook(tables: Mapping[str, DataFrame], path: str) -> None:
    """Report tables as one workbook, a sheet each. A sheet's rows pass the driver: more than a sheet can hold raise before any is fetched."""
    some = next(iter(tables.values()))
    for name, df in tables.items():
        if df.limit(SHEET_ROWS).count() >= SHEET_ROWS:
            raise ValueError(f"{name} has more rows than a sheet holds")
    write_bytes(some.sparkSession, path, workbook_bytes({name: (df.columns, df.toLocalIterator()) for name, df in tables.items()}))


# geometries ---------------------------------------------------------------------------------------------


def _points(ps: Iterable[tuple[float, float]]) -> str:
    return "(" + ", ".join(f"{x!r} {y!r}" for x, y in ps) + ")"


def _wkb(b: bytes, at: int = 0) -> tuple[str, str, int]:
    """The kind and body of a WKB geometry, and where it ends; heights and measures are left out."""
    order = "<" if b[at] else ">"
    (kind,) = struct.unpack_from(f"{order}I", b, at + 1)
    dims = 2 + (kind & 0x80000000 > 0 or kind // 1000 % 10 in (1, 3)) + (kind & 0x40000000 > 0 or kind // 1000 % 10 in (2, 3))
    at += 9 if kind & 0x20000000 else 5
    kind = (kind & 0xFFFF) % 1000

    def several(at: int) -> tuple[list[tuple[float, float]], int]:
        (n,) = struct.unpack_from(f"{order}I", b, at)
        flat = struct.unpack_from(f"{order}{n * dims}d", b, at + 4)
        return list(zip(flat[::dims], flat[1::dims])), at + 4 + 8 * n * dims

    if kind == 1:
        p = struct.unpack_from(f"{order}{dims}d", b, at)
        return "POINT", "EMPTY" if p[0] != p[0] else _points([p[:2]]), at + 8 * dims
    if kind == 2:
        ps, at = several(at)
        return "LINESTRING", _points(ps), at
    (n,) = struct.unpack_from(f"{order}I", b, at)
    at += 4
    parts = []
    for _ in range(n):
        if kind == 3:
            ps, at = several(at)
            parts.append(_points(ps))
        else:
            name, body, at = _wkb(b, at)
            parts.append(f"{name} {body}" if kind == 7 else body)
    name = {3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}[kind]
    return name, f"({', '.join(parts)})" if parts else "EMPTY", at


def wkb_text(b: bytes) -> str:
    name, body, _ = _wkb(b)
    return f"{name} {body}"


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:])) / 2


def _holds(ring: list[tuple[float, float]], p: tuple[float, float]) -> bool:
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def _shape(b: bytes) -> str | None:
    """A shapefile's record as WKT. A ring that turns left is a hole of the smallest shell around it."""
    (kind,) = struct.unpack_from("<i", b, 0)
    kind %= 10
    if kind == 1:
        return f"POINT {_points([struct.unpack_from('<2d', b, 4)])}"
    if kind == 8:
        (n,) = struct.unpack_from("<i", b, 36)
        flat = struct.unpack_from(f"<{2 * n}d", b, 40)
        return f"MULTIPOINT ({', '.join(_points([p]) for p in zip(flat[::2], flat[1::2]))})"
    if kind not in (3, 5):
        return None
    n, m = struct.unpack_from("<2i", b, 36)
    starts = [*struct.unpack_from(f"<{n}i", b, 44), m]
    flat = struct.unpack_from(f"<{2 * m}d", b, 44 + 4 * n)
    points = list(zip(flat[::2], flat[1::2]))
    rings = [points[a:z] for a, z in zip(starts, starts[1:])]
    if kind == 3:
        return f"LINESTRING {_points(rings[0])}" if n == 1 else f"MULTILINESTRING ({', '.join(map(_points, rings))})"
    shells = [[r] for r in rings if _area(r) <= 0] or [[r] for r in rings]
    for r in rings:
        around = [s for s in shells if _area(r) > 0 and s[0] is not r and _holds(s[0], r[0])]
        if around:
            min(around, key=lambda s: abs(_area(s[0]))).append(r)
    bodies = [f"({', '.join(map(_points, s))})" for s in shells]
    return f"POLYGON {bodies[0]}" if len(bodies) == 1 else f"MULTIPOLYGON ({', '.join(bodies)})"


def _dbf(b: bytes, encoding: str) -> Iterator[dict[str, str]]:
    n, head, size = struct.unpack_from("<IHH", b, 4)
    fields, at = [], 32
    while b[at] != 0x0D:
        fields.append((b[at : at + 11].split(b"\0")[0].decode(encoding), b[at + 16]))
        at += 32
    for k in range(n):
        at, row = head + k * size + 1, {}
        for name, width in fields:
            value = b[at : at + width].decode(encoding, "replace").strip(" \0")
            at += width
            if value:
                row[name] = value
        yield row


def shapes(shp: bytes, dbf: bytes | None, encoding: str = "utf-8") -> Iterator[tuple[int, dict[str, str], str | None]]:
    """record, properties, WKT of a shapefile's records."""
    rows = _dbf(dbf, encoding) if dbf else iter(())
    at = 100
    while at + 8 <= len(shp):
        number, words = struct.unpack_from(">2i", shp, at)
        yield number, next(rows, {}), _shape(shp[at + 8 : at + 8 + 2 * words])
        at += 8 + 2 * words


def packaged(content: bytes) -> Iterator[tuple[str, int, dict[str, str], str | None]]:
    """layer, record, properties, WKT of a geopackage's features."""
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    for layer, column in con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY 1").fetchall():
        rows = con.execute(f"SELECT * FROM {quoted(layer)}")
        names = [d[0] for d in rows.description]
        for n, row in enumerate(rows, 1):
            of = dict(zip(names, row))
            g = of.pop(column)
            skip = 8 + (0, 32, 48, 48, 64)[g[3] >> 1 & 7] if g else 0
            yield layer, n, {k: str(v) for k, v in of.items() if v is not None and not isinstance(v, bytes)}, wkb_text(g[skip:]) if g else None
    con.close()


LAYER = "layer string, record bigint, properties map<string,string>, geometry string"


def vector_layer(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """layer, record, properties, geometry (WKT) of a .shp, with its .dbf beside it, or a .gpkg. A file is one task's."""
    stem, _, suffix = path.rpartition(".")
    kind = suffix.lower()
    if kind not in ("shp", "gpkg"):
        raise ValueError(f"no reader for {path}")
    files = _files(spark, path)
    if kind == "shp":
        beside = stem + (".DBF" if suffix.isupper() else ".dbf")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            files = files.crossJoin(F.broadcast(_files(spark, beside).select(F.col("content").alias("dbf"))))  # one row and one row
    layer = stem.rpartition("/")[2]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, content in enumerate(batch["content"]):
                rows = packaged(content) if kind == "gpkg" else ((layer, *r) for r in shapes(content, batch["dbf"].iloc[k] if "dbf" in batch else None, encoding))
                yield pd.DataFrame(list(rows), columns=["layer", "record", "properties", "geometry"])

    return files.mapInPandas(read, LAYER)
