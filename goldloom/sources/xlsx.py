"""Workbooks with the standard library alone."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _tag(name: str) -> str:
    return f"{{{_NS['m']}}}{name}"


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == _tag("si"):
                out.append("".join(t.text or "" for t in e.iter(_tag("t"))))
                e.clear()
    return out


def _rows(book: str | bytes) -> Iterator[list[str | None]]:
    """Cells of each row that isn't blank, one row in memory at a time."""
    with zipfile.ZipFile(BytesIO(book) if isinstance(book, bytes) else book) as z:
        shared = _shared(z)
        sheets = [n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        with z.open(min(sheets, key=lambda n: int(re.search(r"\d+", n)[0]))) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != _tag("row"):
                    continue
                cells: list[str | None] = []
                for k, c in enumerate(row.findall("m:c", _NS)):
                    at = _column(c.get("r")) if c.get("r") else k
                    cells += [None] * (at + 1 - len(cells))
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(_tag("t")))
                    elif (v := c.find("m:v", _NS)) is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                row.clear()
                if any((x or "").strip() for x in cells):
                    yield cells


def header(book: str | bytes) -> list[tuple[int, str]]:
    """Places and names of the columns of a workbook, given by its path or its bytes."""
    first = next(_rows(book), None)
    if first is None:
        raise ValueError("empty sheet")
    return [(k, x.strip()) for k, x in enumerate(first) if (x or "").strip()]


def records(book: str | bytes) -> Iterator[tuple]:
    columns, rows = [k for k, _ in header(book)], _rows(book)
    next(rows)
    for cells in rows:
        yield tuple(cells[k] if k < len(cells) else None for k in columns)
