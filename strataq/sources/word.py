"""Word files as Markdown: a small reader of zipped XML that never inflates more than it was told.

Headings, list items with their levels, tables (a line for each row), line breaks, tabs, emphasis and links stay; deleted text, field codes and the
second copies of text boxes go. A file that is broken, too large when inflated, or has a document type (which real ones
never have, and entity bombs do) gives an error and no text.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inflated bytes of one part of a file.
MOST_BYTES = 32 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SKIPPED = {f"{_W}del", f"{_W}moveFrom", f"{_W}instrText", "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"}


class BadWord(ValueError):
    """A file that isn't read."""


def part(archive: zipfile.ZipFile, name: str, most: int) -> ElementTree.Element | None:
    """A part of the file as XML, None if it isn't there; its size is counted while it is inflated."""
    if name not in archive.namelist():
        return None
    with archive.open(name) as f:
        raw = f.read(most + 1)
    if len(raw) > most:
        raise BadWord(f"{name} is too large")
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise BadWord(f"{name} has a document type")
    return ElementTree.fromstring(raw)


def _value(element: ElementTree.Element | None, path: str) -> str | None:
    found = None if element is None else element.find(path)
    return None if found is None else found.get(f"{_W}val")


@dataclass
class Styles:
    """What paragraphs refer to: heading levels by style, kinds of lists by number and level, targets of links."""

    headings: dict[str, int] = field(default_factory=dict)
    ordered: dict[tuple[str, str], bool] = field(default_factory=dict)
    links: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, archive: zipfile.ZipFile, most: int) -> Styles:
        out = cls()
        styles, numbers, relations = (part(archive, f"word/{n}", most) for n in ("styles.xml", "numbering.xml", "_rels/document.xml.rels"))
        for style in styles.iter(f"{_W}style") if styles is not None else ():
            name = (_value(style, f"{_W}name") or "").lower()
            if name == "title" or name.startswith("heading ") and name[8:].isdigit():
                out.headings[style.get(f"{_W}styleId", "")] = 1 if name == "title" else min(int(name[8:]), 6)
        if numbers is not None:
            kinds = {(a.get(f"{_W}abstractNumId"), level.get(f"{_W}ilvl")): _value(level, f"{_W}numFmt") != "bullet" for a in numbers.iter(f"{_W}abstractNum") for level in a.iter(f"{_W}lvl")}
            for number in numbers.iter(f"{_W}num"):
                of = _value(number, f"{_W}abstractNumId")
                out.ordered |= {(number.get(f"{_W}numId", ""), level or "0"): kind for (a, level), kind in kinds.items() if a == of}
        for link in relations if relations is not None else ():
            if link.get("TargetMode") == "External":
                out.links[link.get("Id", "")] = link.get("Target", "")
        return out


def inline(element: ElementTree.Element, styles: Styles) -> str:
    """The text of a paragraph."""
    out = []
    for child in element:
        if child.tag in _SKIPPED:
            continue
        if child.tag == f"{_W}t":
            out.append(child.text or "")
        elif child.tag == f"{_W}tab":
            out.append("\t")
        elif child.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
        elif child.tag == f"{_W}r":
            text = inline(child, styles)
            on = lambda mark, run=child: run.find(f"{_W}rPr/{_W}{mark}") is not None and _value(run, f"{_W}rPr/{_W}{mark}") not in ("0", "false")
            for mark, sign in (("b", "**"), ("i", "_")):
                if on(mark) and text.strip():
                    text = text[: len(text) - len(text.lstrip())] + sign + text.strip() + sign + text[len(text.rstrip()) :]
            out.append(text)
        elif child.tag == f"{_W}hyperlink" and (to := styles.links.get(child.get(f"{_R}id", ""))):
            out.append(f"[{inline(child, styles)}]({to})")
        elif child.tag not in (f"{_W}pPr", f"{_W}rPr"):
            out.append(inline(child, styles))
    return "".join(out)


def blocks(body: ElementTree.Element, styles: Styles) -> Iterator[tuple[str, str]]:
    """(kind, Markdown) of each paragraph and table, in order."""
    numbers: dict[tuple[str, str], int] = {}
    for child in body:
        if child.tag == f"{_W}p":
            text = inline(child, styles).strip()
            level = styles.headings.get(_value(child, f"{_W}pPr/{_W}pStyle") or "")
            number = _value(child, f"{_W}pPr/{_W}numPr/{_W}numId")
            if not text:
                continue
            if level:
                yield "heading", f"{'#' * level} {text.replace('**', '')}"
            elif number and number != "0":
                at = _value(child, f"{_W}pPr/{_W}numPr/{_W}ilvl") or "0"
                numbers[number, at] = numbers.get((number, at), 0) + 1
                for deeper in [k for k in numbers if k[0] == number and int(k[1]) > int(at)]:
                    del numbers[deeper]
                sign = f"{numbers[number, at]}." if styles.ordered.get((number, at)) else "-"
                yield "item", "  " * int(at) + f"{sign} {text}"
            else:
                yield "text", text
        elif child.tag == f"{_W}tbl":
            rows = [[" ".join(t for _, t in blocks(cell, styles)).replace("\n", " ").replace("|", "\\|") for cell in row.iter(f"{_W}tc")] for row in child.findall(f"{_W}tr")]
            if rows:
                lines = [f"| {' | '.join(row)} |" for row in rows]
                yield "table", "\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]])
        elif child.tag not in _SKIPPED:
            yield from blocks(child, styles)  # content controls and the like


def markdown_of(content: bytes, most: int = MOST_BYTES) -> str:
    """The Markdown of a Word file's bytes."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            document = part(archive, "word/document.xml", most)
            body = None if document is None else document.find(f"{_W}body")
            if body is None:
                raise BadWord("no document in it")
            out, before = [], ""
            for kind, text in blocks(body, Styles.of(archive, most)):
                out.append(("" if not out else "\n" if kind == before == "item" else "\n\n") + text)
                before = kind
            return "".join(out)
    except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, NotImplementedError, EOFError, RuntimeError, RecursionError) as e:
        raise BadWord(f"not a Word file: {e}") from e


def word(content: Column, most: int = MOST_BYTES) -> Column:
    """A struct of ``text`` and ``error`` of Word files' bytes; null bytes have neither."""

    @F.pandas_udf("text string, error string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(value: bytes | None) -> tuple[str | None, str | None]:
            try:
                return (None, None) if value is None else (markdown_of(bytes(value), most), None)
            except BadWord as e:
                return None, str(e)[:500]

        for batch in batches:
            yield pd.DataFrame([one(v) for v in batch], columns=["text", "error"], dtype=object)

    return read(content)
