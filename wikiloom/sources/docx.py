"""Text of word-processor files: a zip archive whose main part is XML with paragraphs and tables."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

#: Bytes that a part may have when it is inflated.
LARGEST_PART = 64 << 20
# Fixed names.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CHOICE = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
OFFICE_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
BREAKS = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n", f"{WORD}noBreakHyphen": "-"}
SKIPPED = (f"{WORD}del", f"{WORD}moveFrom", f"{WORD}instrText", f"{WORD}pPr", f"{WORD}rPr")


def part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    """A part's tree. One that inflates beyond LARGEST_PART, whatever its header says, or declares entities, is refused."""
    with archive.open(name) as f:
        data = f.read(LARGEST_PART + 1)
    if len(data) > LARGEST_PART:
        raise ValueError(f"{name} has more than {LARGEST_PART} bytes")
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError(f"{name} declares a document type")
    return ElementTree.fromstring(data)


def main_part(archive: zipfile.ZipFile) -> str:
    """The name of the part with the text: that of the package's relations, or else the usual one."""
    if "_rels/.rels" in archive.namelist():
        for r in part(archive, "_rels/.rels").iter(f"{PACKAGE}Relationship"):
            if r.get("Type") == OFFICE_DOCUMENT:
                return r.get("Target", "").lstrip("/")
    return "word/document.xml"


def paragraphs(root: ElementTree.Element) -> list[str]:
    """The paragraphs in order, those of table cells and text boxes too. Deleted text and field codes don't count; of
    alternative contents the fallback does, as it is what every reader can show."""
    out: list[str] = []
    # (element, whether it is left): a stack, as documents may nest deeper than calls.
    stack: list[tuple[ElementTree.Element, bool]] = [(root, False)]
    open_: list[list[str]] = []
    while stack:
        element, done = stack.pop()
        if done:
            text = "".join(open_.pop()).strip("\n")
            if text.strip():
                out.append(text)
            continue
        if element.tag in SKIPPED:
            continue
        if element.tag == f"{WORD}p":
            open_.append([])
            stack.append((element, True))
        elif open_ and element.tag == f"{WORD}t":
            open_[-1].append(element.text or "")
        elif open_ and element.tag in BREAKS:
            open_[-1].append(BREAKS[element.tag])
        children = list(element)
        if element.tag == f"{CHOICE}AlternateContent":
            children = [c for c in children if c.tag == f"{CHOICE}Fallback"] or children[:1]
        stack += [(c, False) for c in reversed(children)]
    return out


def docx_text(data: bytes) -> str:
    """The paragraphs' text, an empty line between them. What isn't such a file is an error."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return "\n\n".join(paragraphs(part(archive, main_part(archive)))).strip()
