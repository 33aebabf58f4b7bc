"""Office files: archives of XML members, read as streams of events, one page for each slide, sheet or run of paragraphs between page breaks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

_SPACE = " \t\r\n"


class Events:
    """A stream of XML as calls of start, end and data, by local names; an attribute of relationships begins with r:.

    Nothing of the stream is kept but what a reader keeps.  Entity declarations
    are refused, so a small member cannot grow.
    """

    def start(self, tag: str, attrs: dict[str, str]) -> None: ...

    def end(self, tag: str) -> None: ...

    def data(self, text: str) -> None: ...

    def read(self, stream) -> Events:
        def local(name: str) -> str:
            space, _, tag = name.rpartition(" ")
            return f"r:{tag}" if space.endswith("/relationships") else tag

        parser = expat.ParserCreate(namespace_separator=" ")
        parser.buffer_text = True
        parser.StartElementHandler = lambda tag, attrs: self.start(tag.rpartition(" ")[2], {local(k): v for k, v in attrs.items()})
        parser.EndElementHandler = lambda tag: self.end(tag.rpartition(" ")[2])
        parser.CharacterDataHandler = self.data
        parser.EntityDeclHandler = self._refused
        parser.ParseFile(stream)
        return self

    @staticmethod
    def _refused(*_) -> None:
        raise ValueError("the member declares entities")


def _line(text: str) -> str:
    return re.sub(f"[{_SPACE}]+", " ", text).strip(" ")


def table_lines(rows: list[list[str]]) -> str:
    """Rows as a table in markdown; the first is its head."""
    width = max(map(len, rows))
    shown = ["| " + " | ".join(_line(c).replace("|", "\\|") for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([shown[0], "| " + " | ".join(["---"] * width) + " |", *shown[1:]])


class Prose(Events):
    """Paragraphs and tables of a text or a slide; levels gives the heading level of paragraph styles."""

    def __init__(self, levels: dict[str, int] | None = None):
        self.levels = levels or {}
        self.pages: list[list[str]] = [[]]
        self.text: list[str] = []
        self.reading, self.skipped, self.level, self.item, self.title = False, 0, 0, False, False
        self.tables: list[list[list[str]]] = []
        self.cells: list[list[str]] = []

    def start(self, tag, attrs):
        if tag in ("Fallback", "del", "moveFrom"):
            self.skipped += 1
        elif tag == "p":
            self.text, self.level, self.item = [], 0, False
        elif tag == "t":
            self.reading = not self.skipped
        elif tag == "pStyle":
            self.level = self.levels.get(attrs.get("val", ""), self.level)
        elif tag == "outlineLvl" and attrs.get("val", "").isdigit():
            self.level = min(6, int(attrs["val"]) + 1) if int(attrs["val"]) < 9 else 0
        elif tag == "numPr":
            self.item = True
        elif tag == "sp":
            self.title = False
        elif tag == "ph":
            self.title = attrs.get("type") in ("title", "ctrTitle")
        elif tag == "tab" and not self.skipped and "val" not in attrs and "pos" not in attrs:
            self.text.append("\t")
        elif tag in ("br", "lastRenderedPageBreak") and not self.skipped:
            if tag == "br" and attrs.get("type") != "page":
                self.text.append(" ")
            elif not self.cells:
                self.paragraph()
                self.pages.append([])
        elif tag == "tbl":
            self.tables.append([])
        elif tag == "tr":
            self.tables[-1].append([])
        elif tag == "tc":
            self.cells.append([])

    def data(self, text):
        if self.reading:
            self.text.append(text)

    def end(self, tag):
        if tag in ("Fallback", "del", "moveFrom"):
            self.skipped -= 1
        elif tag == "t":
            self.reading = False
        elif tag == "p":
            self.paragraph()
        elif tag == "tc":
            self.tables[-1][-1].append(" ".join(self.cells.pop()))
        elif tag == "tbl" and (rows := [r for r in self.tables.pop() if r]):
            if self.cells:  # a table within a cell is part of its text
                self.cells[-1].extend(" ".join(r) for r in rows)
            else:
                self.pages[-1].append(table_lines(rows))

    def paragraph(self) -> None:
        line, self.text = "".join(self.text).strip(_SPACE), []
        if line and self.cells:
            self.cells[-1].append(line)
        elif line:
            level = 1 if self.title else self.level
            self.pages[-1].append(("#" * level + " " if level else "- " if self.item else "") + line)


class Styles(Events):
    """Heading levels by paragraph style: of its name, which is English in every language, or its outline."""

    def __init__(self):
        self.levels: dict[str, int] = {}
        self.style = ""

    def start(self, tag, attrs):
        value = attrs.get("val", "")
        if tag == "style":
            self.style = attrs.get("styleId", "")
        elif tag == "name" and (value.lower() == "title" or value.lower().startswith("heading ")):
            rest = value.lower().removeprefix("heading ")
            self.levels.setdefault(self.style, 1 if value.lower() == "title" else min(6, int(rest)) if rest.isdigit() else 1)
        elif tag == "outlineLvl" and self.style and value.isdigit() and int(value) < 9:
            self.levels.setdefault(self.style, min(6, int(value) + 1))


class Listed(Events):
    """Attributes of all elements of one name."""

    def __init__(self, tag: str):
        self.tag, self.found = tag, []

    def start(self, tag, attrs):
        if tag == self.tag:
            self.found.append(attrs)


class SharedStrings(Events):
    def __init__(self):
        self.strings: list[str] = []
        self.reading, self.phonetic = False, False

    def start(self, tag, attrs):
        if tag == "si":
            self.strings.append("")
        elif tag == "rPh":
            self.phonetic = True
        self.reading = tag == "t" and not self.phonetic

    def data(self, text):
        if self.reading:
            self.strings[-1] += text

    def end(self, tag):
        self.reading = False
        self.phonetic = self.phonetic and tag != "rPh"


class Sheet(Events):
    """Rows of a sheet that hold anything; cells stand in their columns."""

    def __init__(self, strings: list[str]):
        self.strings, self.rows, self.row, self.reading = strings, [], [], False

    def start(self, tag, attrs):
        if tag == "row":
            self.row = []
        elif tag == "c":
            self.kind, self.value, letters = attrs.get("t", "n"), [], attrs.get("r", "").rstrip("0123456789")
            at = 0
            for letter in letters:
                at = 26 * at + ord(letter.upper()) - 64
            self.row.extend([""] * (at - 1 - len(self.row)))
        self.reading = tag in ("v", "t")

    def data(self, text):
        if self.reading:
            self.value.append(text)

    def end(self, tag):
        self.reading = False
        if tag == "c":
            value = "".join(self.value)
            if self.kind == "s":
                value = self.strings[int(value)] if value.isdigit() and int(value) < len(self.strings) else ""
            elif self.kind == "b":
                value = "TRUE" if value == "1" else "FALSE"
            self.row.append(value)
        elif tag == "row" and any(self.row):
            self.rows.append(self.row)


def _part(z: zipfile.ZipFile, name: str, reader: Events) -> Events:
    """reader, after the member called name, if there is one."""
    if name in z.NameToInfo:
        with z.open(name) as stream:
            reader.read(stream)
    return reader


def _targets(z: zipfile.ZipFile, main: str, tag: str) -> list[tuple[dict, str]]:
    """Elements of main called tag with the members that they refer to, in order."""
    folder, base = posixpath.split(main)
    relations = {r.get("Id"): r.get("Target", "") for r in _part(z, f"{folder}/_rels/{base}.rels", Listed("Relationship")).found}
    out = []
    for attrs in _part(z, main, Listed(tag)).found:
        target = relations.get(attrs.get("r:id"), "")
        out.append((attrs, target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))))
    return out


#: what a file that is no office file, or is broken, fails with
BROKEN = (zipfile.BadZipFile, expat.ExpatError, ValueError, KeyError, NotImplementedError, OSError)


def office_pages(content: bytes, fmt: str) -> Iterator[str]:
    """The markdown of each page: of a text between its page breaks, of each slide, of each sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if fmt == "docx":
            levels = _part(z, "word/styles.xml", Styles()).levels
            for lines in _part(z, "word/document.xml", Prose(levels)).pages:
                yield "\n\n".join(lines)
        elif fmt == "pptx":
            for _, member in _targets(z, "ppt/presentation.xml", "sldId"):
                yield "\n\n".join(x for lines in _part(z, member, Prose()).pages for x in lines)
        else:
            strings = _part(z, "xl/sharedStrings.xml", SharedStrings()).strings
            for attrs, member in _targets(z, "xl/workbook.xml", "sheet"):
                rows = _part(z, member, Sheet(strings)).rows
                yield f"## {attrs.get('name', '')}\n\n{table_lines(rows)}" if rows else ""
