"""Marksheets: delimited text, spreadsheets, documents and archives of them."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CELLS = "path string, sheet string, row int, cells array<string>"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_OPEN = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header, every column a string."""
    return spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).csv(path)


def _csv_rows(data: bytes) -> Iterator[list[str]]:
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    yield from csv.reader(io.StringIO(text))


def _xlsx_rows(data: bytes) -> Iterator[tuple[str, list[str]]]:
    """Rows of all sheets by the sheets' names, blank rows left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles: dict[str, str] = {}
        if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
            targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
                target = targets.get(s.get(f"{_RELATION}id"), "")
                titles["xl/" + target.removeprefix("/xl/").removeprefix("xl/")] = s.get("name", "")
        for name in sorted(n for n in names if n.startswith("xl/worksheets/sheet")):
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_SHEET}row"):
                cells: list[str] = []
                for c in row.iter(f"{_SHEET}c"):
                    letters = "".join(ch for ch in c.get("r", "") if ch.isalpha())
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (max(at, 1) - 1 - len(cells))
                    value = c.find(f"{_SHEET}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                    cells.append(inline if value is None else shared[int(value.text or 0)] if c.get("t") == "s" else value.text or "")
                if any(x.strip() for x in cells):
                    yield titles.get(name) or name.rpartition("/")[2].removesuffix(".xml"), cells


def _docx_rows(data: bytes) -> Iterator[list[str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    inside = {id(p) for t in body.iter(f"{_WORD}tbl") for p in t.iter(f"{_WORD}p")}
    for e in body.iter():
        if e.tag == f"{_WORD}p" and id(e) not in inside and said(e).strip():
            yield [said(e)]
        elif e.tag == f"{_WORD}tr":
            yield [said(c) for c in e.iter(f"{_WORD}tc")]


def _odt_lines(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("content.xml"))
    return [said for e in body.iter() if e.tag in (f"{_OPEN}p", f"{_OPEN}h") and (said := "".join(e.itertext())).strip()]


def _rtf_text(data: bytes) -> str:
    """The plain text of RTF: groups of settings and control words dropped, paragraphs as lines."""
    said = data.decode("latin-1")
    said = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", said)
    said = re.sub(r"\\(?:par|line)\b ?", "\n", said).replace("\\tab", "\t")
    said = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), said)
    said = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), said)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?|\\[^a-zA-Z]", "", said)).strip()


class _Page(HTMLParser):
    """A page's tables as cells, and its text with their rows as cells between bars."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.said: list[str] = []
        self.cell: list[str] | None = None
        self.row: list[str] | None = None
        self.silent = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ("script", "style", "head"):
            self.silent += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr":
            self._end_row()
            self.row = []
        elif tag in ("td", "th"):
            self._end_cell()
            self.cell = []
        elif tag in ("br", "p", "div", "li"):
            self.said.append("\n")

    def _end_cell(self) -> None:
        if self.cell is not None:
            if self.row is None:
                self.row = []
            self.row.append(" ".join("".join(self.cell).split()))
        self.cell = None

    def _end_row(self) -> None:
        self._end_cell()
        if self.row and any(self.row):
            if not self.tables:
                self.tables.append([])
            self.tables[-1].append(self.row)
            self.said.append("\n" + " | ".join(self.row) + "\n")
        self.row = None

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style", "head"):
            self.silent = max(0, self.silent - 1)
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "table"):
            self._end_row()
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.said.append("\n")

    def handle_data(self, data) -> None:
        if self.silent:
            return
        (self.said if self.cell is None else self.cell).append(data)

    def text(self) -> str:
        self._end_row()
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r" *\n *", "\n", "".join(self.said)))).strip()


def _page(data: bytes) -> _Page:
    out = _Page()
    out.feed(data.decode("utf-8", "replace"))
    out._end_row()
    return out


#: How far the text of a kind of file is trusted.
CONFIDENCE = {"docx": 0.85, "odt": 0.80, "rtf": 0.65, "txt": 0.75, "html": 0.85, "csv": 0.90, "xlsx": 0.90, "unknown": 0.40}


def kind_of(path: str, data: bytes) -> str:
    """The kind of a file by its first bytes and, for archives, its members; by its name where these say nothing."""
    name = path.lower().rpartition(".")[2]
    if data[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = set(z.namelist())
        except zipfile.BadZipFile:
            return "unknown"
        members = {"word/document.xml": "docx", "content.xml": "odt"}
        found = next((k for m, k in members.items() if m in names), None)
        return found or ("xlsx" if any(n.startswith("xl/") for n in names) else "zip")
    if data[:5] == b"{\\rtf":
        return "rtf"
    if data[:4] == b"%PDF" or data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return "unknown"  # PDF and old binary office files need libraries that aren't there
    if re.match(rb"\s*<(?:!doctype html|html|table|body|head|div|p)\b", data[:200], re.IGNORECASE):
        return "html"
    if name in ("csv", "tsv"):
        return "csv"
    if name in ("html", "htm"):
        return "html"
    return "txt" if name in ("txt", "text", "md", "log", "eml") else "unknown"


def _members(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    if kind_of(path, data) != "zip":
        yield path, data
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            base = name.rpartition("/")[2]
            if base and not base.startswith((".", "__")) and not name.startswith("__"):
                yield f"{path}!{name}", z.read(name)


def _rows(path: str, data: bytes) -> Iterator[tuple[str, list[str]]]:
    kind = kind_of(path, data)
    if kind == "csv":
        yield from (("", r) for r in _csv_rows(data) if any(x.strip() for x in r))
    elif kind == "xlsx":
        yield from _xlsx_rows(data)
    elif kind == "docx":
        yield from (("", r) for r in _docx_rows(data))
    elif kind == "html":
        yield from ((f"table {k}", r) for k, t in enumerate(_page(data).tables) for r in t)


def _text(path: str, data: bytes) -> tuple[str, str]:
    """The kind and the text of a file; tables' rows are lines with cells between bars or tabs."""
    kind = kind_of(path, data)
    if kind == "html":
        return kind, _page(data).text()
    if kind == "odt":
        return kind, "\n".join(_odt_lines(data))
    if kind == "rtf":
        return kind, _rtf_text(data)
    if kind in ("docx", "xlsx", "csv"):
        return kind, "\n".join("\t".join(r) for _, r in _rows(path, data))
    if data[:4] == b"%PDF" or b"\0" in data[:1000]:
        return "unknown", ""
    try:
        return kind, data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return kind, data.decode("latin-1")


_ERRORS = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file under ``path`` and each archive's member: path, kind, text, confidence, error.

    Kinds are told by content. What can't be read gives no text, confidence 0 and what was wrong.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[str, str, str, float, str | None]] = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    members = list(_members(path, bytes(data)))
                except _ERRORS as e:
                    members = []
                    out.append((path, "unknown", "", 0.0, type(e).__name__))
                for name, member in members:
                    try:
                        kind, said = _text(name, member)
                        out.append((name, kind, said, CONFIDENCE.get(kind, 0.4) if said else 0.0, None))
                    except _ERRORS as e:
                        out.append((name, "unknown", "", 0.0, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "confidence", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, kind string, text string, confidence double, error string")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Rows of cells of all readable files under ``path``, members of archives included; unreadable ones give none.

    Files are read by Spark's binary source and parsed where they are; a file is the unit of work.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[str, str, int, list[str]]] = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    for name, member in _members(path, bytes(data)):
                        out.extend((name, sheet, k, cells) for k, (sheet, cells) in enumerate(_rows(name, member)))
                except _ERRORS:
                    continue
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(parse, CELLS)
