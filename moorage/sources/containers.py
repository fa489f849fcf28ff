"""What lies inside container files, as plain Python for Arrow batches (S11, S12, S16, S20, S22-S26). Errors become warnings of the row."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

# Fixed values.
ENTRIES, DEPTH, SHEET_ROWS, PDF_PAGES = 40, 2, 500, 80
SKIPPED = re.compile(r"(^|/)(__MACOSX|\.DS_Store|Thumbs\.db)")
ENCODINGS, LOSSY = ("cp949", "euc-kr", "utf-16le"), 0.005


def decode_text(content: bytes) -> tuple[str, str]:
    """Text and encoding: UTF-8 unless more than one character in 200 is lost, else the first encoding that loses less."""
    text = content.decode("utf-8", "replace").removeprefix("﻿")
    lost = text.count("�") / max(1, len(text))
    if lost < LOSSY:
        return text, "utf-8"
    for encoding in ENCODINGS:
        other = content.decode(encoding, "replace")
        if other.count("�") / max(1, len(other)) < lost:
            return other, encoding
    return text, "utf-8 (lossy)"


def zip_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.namelist()


def zip_entry(content: bytes, name: str) -> str | None:
    """An entry as text; null on any error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.read(name).decode("utf-8", "replace")
    except (KeyError, zipfile.BadZipFile, zlib.error, RuntimeError, OSError):
        return None


def inner_files(content: bytes) -> Iterator[tuple[int, str, bytes]]:
    """Number, name and bytes of an archive's first files."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        n = 0
        for info in z.infolist():
            if info.is_dir() or SKIPPED.search(info.filename):
                continue
            n += 1
            if n > ENTRIES:
                return
            yield n, info.filename, z.read(info)


def more_files(content: bytes) -> bool:
    """Whether an archive has more files than are read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return sum(not i.is_dir() and not SKIPPED.search(i.filename) for i in z.infolist()) > ENTRIES


def _number(name: str) -> int:
    return int(re.search(r"([0-9]+)", name.rsplit("/", 1)[-1])[1])


def docx_parts(content: bytes) -> list[str]:
    xml = zip_entry(content, "word/document.xml")
    return [xml] if xml else []


def pptx_parts(content: bytes) -> list[tuple[str, str]]:
    """XML of each slide, in natural order, and of its notes."""
    slides = sorted((n for n in zip_names(content) if re.fullmatch(r"ppt/slides/slide[0-9]+\.xml", n)), key=_number)
    return [(zip_entry(content, n) or "", zip_entry(content, f"ppt/notesSlides/notesSlide{i}.xml") or "") for i, n in enumerate(slides, 1)]


def hwpx_parts(content: bytes) -> list[str]:
    return [zip_entry(content, n) or "" for n in sorted(zip_names(content)) if re.search(r"Contents/section[0-9]+\.xml$", n)]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """Names and rows of the sheets; formulas count by their stored values."""
    strings: list[str] = []
    if shared := zip_entry(content, "xl/sharedStrings.xml"):
        strings = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in ElementTree.fromstring(shared)]
    book = zip_entry(content, "xl/workbook.xml")
    titles = [s.get("name", "") for s in ElementTree.fromstring(book).iter() if _local(s.tag) == "sheet"] if book else []
    names = sorted((n for n in zip_names(content) if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)), key=_number)
    out = []
    for i, name in enumerate(names):
        rows = []
        for row in ElementTree.fromstring(zip_entry(content, name) or "<x/>").iter():
            if _local(row.tag) != "row":
                continue
            cells: dict[int, str] = {}
            for k, cell in enumerate(c for c in row if _local(c.tag) == "c"):
                letters = re.match(r"[A-Z]+", cell.get("r", ""))
                at = sum((ord(c) - 64) * 26**p for p, c in enumerate(reversed(letters[0]))) - 1 if letters else k
                value = "".join(v.text or "" for v in cell.iter() if _local(v.tag) in ("v", "t"))
                cells[at] = strings[int(value)] if cell.get("t") == "s" and value.isdigit() else value
            if any(cells.values()):
                rows.append([cells.get(c, "").strip() for c in range(max(cells) + 1)])
        out.append((titles[i] if i < len(titles) else f"Sheet{i + 1}", rows))
    return out


def sheet_text(name: str, rows: list[list[str]]) -> str:
    more = f"\n… (총 {len(rows)}행)" if len(rows) > SHEET_ROWS else ""
    return f"[시트: {name}]\n" + "\n".join(" | ".join(r) for r in rows[:SHEET_ROWS]) + more


def pdf_pages(content: bytes) -> list[str]:
    """The text that a PDF draws with literal strings, stream by stream; fonts of their own encoding give nothing and go to recognition."""
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"BT" not in data:
            continue
        lines = []
        for block in re.findall(rb"BT(.*?)ET", data, re.S):
            shown = re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[(.*?)\]\s*TJ", block, re.S)
            words = [a or b"".join(re.findall(rb"\(((?:\\.|[^\\()])*)\)", b)) for a, b in shown]
            lines.append(re.sub(rb"\\([()\\])", rb"\1", b"".join(words)).decode("latin-1"))
        pages.append("\n".join(lines))
    return pages[:PDF_PAGES]


class _Page(HTMLParser):
    HIDDEN = ("script", "style", "noscript", "svg")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[list[str]] = []
        self.hidden, self.open = 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.hidden += tag in self.HIDDEN
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append([dict(attrs)["href"] or "", ""])
            self.open = True

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in self.HIDDEN))
        self.open = self.open and tag != "a"

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.open:
                self.links[-1][1] += data


def html_document(raw: str, most_links: int = 60) -> str:
    """The text of a page by its elements, with a list of its first links."""
    page = _Page()
    page.feed(raw)
    body = re.sub(r"\n{3,}", "\n\n", "".join(page.text)).strip()
    links = [f"{label.strip()} → {href}" for href, label in page.links[:most_links] if label.strip()]
    return f"{body}\n\n[링크]\n" + "\n".join(links) if links else body
