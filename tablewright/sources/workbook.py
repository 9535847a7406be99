"""Rows of one .xlsx workbook (a zip of XML parts), read or written inside a task, a row at a time."""

from __future__ import annotations

import io
import math
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from datetime import date, datetime
from decimal import Decimal
from itertools import chain, islice
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BATCH_ROWS = 10_000
#: Rows of a sheet that the format allows, header included (fixed by it).
SHEET_ROWS = 1_048_576
#: Characters XML cannot hold are written as _xHHHH_ (fixed by the format), and what looks like that is written with _x005F_.
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNFIT = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def column_number(reference: str) -> int:
    """0 for "A1", 27 for "AB7"."""
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def sheet_names(book: zipfile.ZipFile) -> list[str]:
    return [entry.get("name") for entry in ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")]


def _sheet_part(book: zipfile.ZipFile, sheet: str | None, path: str) -> str:
    links = {
        link.get("Id"): link.get("Target")
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")
    for entry in sheets:
        if not sheet or entry.get("name") == sheet:
            target = links[entry.get(f"{LINKS}id")]
            return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    raise ValueError(f"workbook {path} has no sheet {sheet!r}")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_unescaped("".join(t.text or "" for t in item.iter(f"{MAIN}t"))) for item in root]


def _cell_text(cell, strings: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _unescaped("".join(t.text or "" for t in cell.iter(f"{MAIN}t")))
    value = cell.find(f"{MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return strings[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    return value.text


def _rows(book: zipfile.ZipFile, part: str, strings: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    """``(row index, {column index: text})``, streamed so that a sheet is never held whole."""
    index = -1
    with book.open(part) as stream:
        for _, element in ElementTree.iterparse(stream):
            if element.tag != f"{MAIN}row":
                continue
            index = int(element.get("r")) - 1 if element.get("r") else index + 1
            cells: dict[int, str] = {}
            for position, cell in enumerate(element.findall(f"{MAIN}c")):
                at = column_number(cell.get("r")) if cell.get("r") else position
                text = _cell_text(cell, strings)
                if text is not None:
                    cells[at] = text
            yield index, cells
            element.clear()


def header(content: bytes | IO[bytes], sheet: str | None, row: int, path: str) -> list[str]:
    """Column names of a sheet, in order."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        for index, cells in _rows(book, _sheet_part(book, sheet, path), _shared_strings(book)):
            if index >= row:
                return [text.strip() for _, text in sorted(cells.items())]
    return []


def batches(
    content: bytes | IO[bytes], sheet: str | None, header_row: int, skip_rows: int, names: list[str], path: str
) -> Iterator[list[list[str | None]]]:
    """Lists of rows below the header, holding the named columns in order."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        strings = _shared_strings(book)
        header_at = skip_rows + header_row
        places: list[int] | None = None
        held: list[list[str | None]] = []
        for index, cells in _rows(book, _sheet_part(book, sheet, path), strings):
            if index < header_at:
                continue
            if places is None:
                found = {text.strip(): at for at, text in cells.items()}
                lacking = [n for n in names if n not in found]
                if lacking:
                    raise ValueError(f"workbook {path} has no columns {lacking}")
                places = [found[n] for n in names]
                continue
            held.append([cells.get(at) for at in places])
            if len(held) >= BATCH_ROWS:
                yield held
                held = []
        if held:
            yield held


def _cell(value: object) -> str:
    """One cell; null is an empty one. Days and times are ISO text."""
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, Decimal)) or (isinstance(value, float) and math.isfinite(value)):
        return f"<c><v>{value}</v></c>"
    text = value.isoformat(" ") if isinstance(value, datetime) else value.isoformat() if isinstance(value, date) else str(value)
    text = escape(_UNFIT.sub(lambda m: f"_x{ord(m[0]):04X}_", text))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _part_links(kind: str, targets: Iterable[str]) -> str:
    base = LINKS.strip("{}")
    links = "".join(f'<Relationship Id="r{i}" Type="{base}/{kind}" Target="{t}"/>' for i, t in enumerate(targets, 1))
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'


def write(file: IO[bytes], names: Sequence[str], rows: Iterable[Sequence], sheet_rows: int = SHEET_ROWS) -> None:
    """A workbook with a header and the rows, as many sheets as they need."""
    start, end = f'<worksheet xmlns="{MAIN.strip("{}")}"><sheetData>', "</sheetData></worksheet>"
    rows, sheets = iter(rows), 0
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
        following = next(rows, None)
        while following is not None or not sheets:
            sheets += 1
            with book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as sheet:
                first = [] if following is None else [following]
                sheet.write(start.encode())
                for row in chain([names], first, islice(rows, sheet_rows - 1 - len(first))):
                    sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                sheet.write(end.encode())
            following = next(rows, None)
        numbers = range(1, sheets + 1)
        listed = "".join(f'<sheet name="rows{i}" sheetId="{i}" r:id="r{i}"/>' for i in numbers)
        space = f'xmlns="{MAIN.strip("{}")}" xmlns:r="{LINKS.strip("{}")}"'
        book.writestr("xl/workbook.xml", f"<workbook {space}><sheets>{listed}</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", _part_links("worksheet", (f"worksheets/sheet{i}.xml" for i in numbers)))
        book.writestr("_rels/.rels", _part_links("officeDocument", ["xl/workbook.xml"]))
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
        book.writestr(
            "[Content_Types].xml",
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>',
        )
