"""Files to pages: (path, page_idx, page, label, text, supported, note).

Plain text, csv, docx and xlsx are read with the standard library; pdf and xls
need libraries that may be absent, in which case the file is unsupported with a
reason. A file that can't be read gives one row with a note, never a failed job.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Page = tuple[int | None, str | None, str]  # number, label, text
PAGES = "path string, page_idx int, page int, label string, text string, supported boolean, note string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Unsupported(Exception):
    """The file's type can't be read here."""


class Capped(Exception):
    """Pages were read, with rows left out."""

    def __init__(self, pages: list[Page], note: str):
        super().__init__(note)
        self.pages, self.note = pages, note


def _lines(rows: Iterator[list], most: int) -> tuple[str, int]:
    """Non-blank cells joined by bars, for the first ``most`` non-blank rows; and how many were left out."""
    out, dropped = [], 0
    for row in rows:
        cells = [str(c).strip() for c in row if c is not None and str(c).strip()]
        if cells:
            if len(out) < most:
                out.append(" | ".join(cells))
            else:
                dropped += 1
    return "\n".join(out), dropped


def _cap_note(sheet: str, dropped: int, most: int) -> list[str]:
    return [f"sheet {sheet}: {dropped} row(s) dropped beyond {most}"] if dropped else []


def _text(content: bytes, most: int) -> list[Page]:
    return [(None, None, content.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"))]


def _csv(content: bytes, most: int) -> list[Page]:
    body, dropped = _lines(csv.reader(io.StringIO(content.decode("utf-8-sig", "ignore"), newline="")), most)
    pages: list[Page] = [(None, None, body)]
    if dropped:
        raise Capped(pages, f"{dropped} row(s) dropped beyond {most}")
    return pages


def _docx(content: bytes, most: int) -> list[Page]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    body = root.find(f"{_WORD}body")

    def said(node) -> str:
        return "".join((t.text or "") if t.tag == f"{_WORD}t" else "\t" if t.tag == f"{_WORD}tab" else "\n" if t.tag == f"{_WORD}br" else "" for t in node.iter())

    lines = [said(p) for p in body.findall(f"{_WORD}p")]
    for grid in body.findall(f"{_WORD}tbl"):
        for row in grid.findall(f"{_WORD}tr"):
            lines.append(" | ".join("\n".join(said(p) for p in cell.findall(f"{_WORD}p")) for cell in row.findall(f"{_WORD}tc")))
    return [(None, None, "\n".join(lines))]


def _xlsx(content: bytes, most: int) -> list[Page]:
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}

    def cells(row) -> list:
        out = []
        for c in row.findall(f"{_SHEET}c"):
            value, kind = c.find(f"{_SHEET}v"), c.get("t")
            if kind == "inlineStr":
                out.append("".join(t.text or "" for t in c.iter(f"{_SHEET}t")))
            elif value is not None and value.text is not None:
                out.append(shared[int(value.text)] if kind == "s" else value.text)
        return out

    pages: list[Page] = []
    notes: list[str] = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        target = targets[sheet.get(f"{_REL}id")].lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        body, dropped = _lines((cells(r) for r in ElementTree.fromstring(book.read(target)).iter(f"{_SHEET}row")), most)
        notes += _cap_note(sheet.get("name"), dropped, most)
        if body:
            pages.append((None, sheet.get("name"), body))
    if notes:
        raise Capped(pages, "; ".join(notes))
    return pages


def _pdf(content: bytes, most: int) -> list[Page]:
    try:
        import pypdf
    except ImportError as e:
        raise Unsupported("no PDF library is installed") from e
    return [(i + 1, None, page.extract_text() or "") for i, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages)]


def _xls(content: bytes, most: int) -> list[Page]:
    try:
        import xlrd
    except ImportError as e:
        raise Unsupported("no library for old spreadsheets is installed") from e
    pages: list[Page] = []
    notes: list[str] = []
    for sheet in xlrd.open_workbook(file_contents=content).sheets():
        body, dropped = _lines((sheet.row_values(i) for i in range(sheet.nrows)), most)
        notes += _cap_note(sheet.name, dropped, most)
        if body:
            pages.append((None, sheet.name, body))
    if notes:
        raise Capped(pages, "; ".join(notes))
    return pages


READERS: dict[str, Callable[[bytes, int], list[Page]]] = {".txt": _text, ".md": _text, ".csv": _csv, ".docx": _docx, ".xlsx": _xlsx, ".xlsm": _xlsx, ".pdf": _pdf, ".xls": _xls}


def read(name: str, content: bytes, most: int) -> tuple[list[Page], bool, str | None]:
    """Pages, whether the type is supported, and a note. A capped sheet keeps its pages and says so."""
    kind = (re.search(r".(\.[^./]+)$", name.rsplit("/", 1)[-1]) or [None, ""])[1].lower()
    reader = READERS.get(kind)
    if reader is None:
        return [], False, f"no reader for {kind or 'files without a type'}"
    try:
        return reader(content, most), True, None
    except Capped as e:
        return e.pages, True, e.note
    except Unsupported as e:
        return [], False, str(e)
    except Exception as e:  # any fault of a file is that file's note
        return [], True, f"error: {type(e).__name__}: {e}"


def extract_pages(files: DataFrame, rows_per_sheet: int = 5000) -> DataFrame:
    """files (path, content) to PAGES; files without pages give one row without page_idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                pages, supported, note = read(path, content or b"", rows_per_sheet)
                rows = [(path, i, n, label, body, supported, note) for i, (n, label, body) in enumerate(pages)] or [(path, None, None, None, None, supported, note)]
                types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "page_idx", "page", "label", "text", "supported", "note"])

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, PAGES)
