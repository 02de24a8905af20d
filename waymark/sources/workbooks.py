"""Workbooks (Office Open XML) by the standard library alone: for final exports and small inputs at the driver's edge."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
MOST_ROWS = 1_048_576


def _column(k: int) -> str:
    """A, B, .., Z, AA, .. for 0, 1, .."""
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def _cell(value: object, place: str) -> str:
    if value is None:
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) < 1e15:
        return f'<c r="{place}"><v>{value!r}</v></c>'
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(value)))}</t></is></c>'


def write(path: str, sheets: Mapping[str, tuple[Sequence[str], Iterable[Sequence[object]]]]) -> None:
    """Each sheet's header and rows, row by row. A sheet of more rows than the format has is an error. The file comes into
    place when it is whole."""
    names = list(sheets)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
    listed = "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
    links = "".join(f'<Relationship Id="rId{k}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
    }
    with zipfile.ZipFile(f"{path}.part", "w", zipfile.ZIP_DEFLATED) as out:
        for name, text in parts.items():
            out.writestr(name, _HEAD + text)
        for k, (header, rows) in enumerate(sheets.values(), 1):
            with out.open(f"xl/worksheets/sheet{k}.xml", "w") as sheet:
                sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                sheet.write(_row(1, header))
                for r, row in enumerate(rows, 2):
                    if r > MOST_ROWS:
                        raise ValueError(f"a sheet holds {MOST_ROWS} rows")
                    sheet.write(_row(r, row))
                sheet.write(b"</sheetData></worksheet>")
    os.replace(f"{path}.part", path)


def _row(r: int, row: Sequence[object]) -> bytes:
    return f'<row r="{r}">{"".join(_cell(v, f"{_column(k)}{r}") for k, v in enumerate(row))}</row>'.encode()


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as held:
        return [s.get("name") for s in ElementTree.fromstring(held.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")]


def rows(path: str, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet, by name or number, as text; gaps are nulls."""
    with zipfile.ZipFile(path) as held:
        listed = list(ElementTree.fromstring(held.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet"))
        one = listed[sheet] if isinstance(sheet, int) else next(s for s in listed if s.get("name") == sheet)
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(held.read("xl/_rels/workbook.xml.rels"))}
        target = links[one.get(f"{{{_LINKS}}}id")].lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in held.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_MAIN}}}t")) for s in ElementTree.fromstring(held.read("xl/sharedStrings.xml"))]
        with held.open(target if target.startswith("xl/") else f"xl/{target}") as source:
            for _, row in ElementTree.iterparse(source):
                if row.tag == f"{{{_MAIN}}}row":
                    yield _values(row, shared)
                    row.clear()


def _values(row: ElementTree.Element, shared: list[str]) -> list[str | None]:
    out: list[str | None] = []
    for cell in row:
        place = re.match("[A-Z]+", cell.get("r") or "")
        k = len(out)
        if place:
            k = -1
            for c in place[0]:
                k = (k + 1) * 26 + ord(c) - 65
        out += [None] * (k - len(out))
        value = cell.find(f"{{{_MAIN}}}v")
        if cell.get("t") == "inlineStr":
            out.append("".join(t.text or "" for t in cell.iter(f"{{{_MAIN}}}t")))
        elif value is None:
            out.append(None)
        else:
            out.append(shared[int(value.text)] if cell.get("t") == "s" else value.text)
    return out


def read(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet as text columns named by its first row. A workbook is read on the driver: prefer CSV or Parquet."""
    found = rows(path, sheet)
    header = [h or f"_c{k}" for k, h in enumerate(next(found, []))]
    schema = ", ".join(f"`{h}` string" for h in header)
    return spark.createDataFrame([tuple((r + [None] * len(header))[: len(header)]) for r in found], schema)


def save(tables: Mapping[str, DataFrame], path: str, append: bool = False) -> None:
    """Each table as a sheet, streamed through the driver. With ``append`` rows are added below those that a sheet of that
    name holds already, and other sheets stay."""
    sheets: dict[str, tuple[Sequence[str], Iterable[Sequence[object]]]] = {}
    if append and os.path.exists(path):
        for name in sheet_names(path):
            header, *held = list(rows(path, name))
            sheets[name] = header, held
    for name, df in tables.items():
        held = list(sheets.get(name, ((), []))[1])
        if held and list(sheets[name][0]) != df.columns:
            raise ValueError(f"sheet {name} has other columns")
        sheets[name] = df.columns, _chained(held, df)
    write(path, sheets)


def _chained(held: list, df: DataFrame) -> Iterator[Sequence[object]]:
    yield from held
    yield from df.toLocalIterator()
