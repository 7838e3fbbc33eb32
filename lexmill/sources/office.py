"""Office containers and word lists from their bytes: DOCX, XLSX, JSON, TBX, XLIFF; a file that cannot be read is a row with its error.

The readers are pure functions of bytes; ``read_words`` and ``read_tables`` apply
them to files that Spark reads, one row a file, so that any store will do.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .parsers import HEADERS, decode

#: Limits of a container: bytes of a member and of all, columns of a sheet, cells of all sheets.
MEMBER_BYTES, TOTAL_BYTES, COLUMNS, CELLS = 64 << 20, 256 << 20, 512, 2_000_000
WORD = "role string, wrong string, correct string, word string, category string, confidence double"
_FOUND = pa.schema([*((n, pa.string()) for n in ("name", "error", "role", "wrong", "correct", "word", "category")), ("confidence", pa.float64())])
#: Names of groups in JSON word lists and the role of their entries, and fields beyond HEADERS.
GROUPS = {"error_pairs": "pairs", "pairs": "pairs", "terms": "terms", "words": "protect", "protect": "protect"}
ALIASES = ("aliases", "alias", "异名", "别名")


class Container:
    """The members of a zip file, within the limits."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        sizes = [i.file_size for i in self.zip.infolist()]
        if max(sizes, default=0) > MEMBER_BYTES or sum(sizes) > TOTAL_BYTES:
            raise ValueError("container beyond its limits")

    def xml(self, name: str) -> ElementTree.Element | None:
        if name not in self.zip.namelist():
            return None
        raw = self.zip.read(name)
        if b"<!DOCTYPE" in raw[:1024] or b"<!ENTITY" in raw:
            raise ValueError(f"{name} has a document type")
        return ElementTree.fromstring(raw)


def local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def attribute(e: ElementTree.Element | None, name: str) -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def children(e: ElementTree.Element | None):
    return () if e is None else e


def child(e: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for p in path:
        e = None if e is None else next((x for x in e if local(x) == p), None)
    return e


# ---------------------------------------------------------------- DOCX


def _levels(styles: ElementTree.Element | None) -> dict[str, int]:
    """Heading level of each paragraph style, by its outline level, its name or the style it is based on."""
    own, based = {}, {}
    for s in styles if styles is not None else ():
        if local(s) != "style":
            continue
        key, outline = attribute(s, "styleId"), attribute(child(s, "pPr", "outlineLvl"), "val")
        name = re.fullmatch(r"(?i)(?:heading|标题)\s*(\d)", attribute(child(s, "name"), "val") or "")
        based[key] = attribute(child(s, "basedOn"), "val")
        if outline is not None and int(outline) < 9:
            own[key] = int(outline) + 1
        elif name:
            own[key] = int(name[1])
    out = {}
    for key in based:
        k, seen = key, set()
        while k and k not in own and k not in seen:
            seen.add(k)
            k = based.get(k)
        if k in own:
            out[key] = own[k]
    return out


def _text(e: ElementTree.Element) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join(x.text or "" if local(x) == "t" else marks.get(local(x), "") for x in e.iter())


def docx_blocks(data: bytes) -> list[tuple[str, int, str, list[list[str]]]]:
    """(type, level, text, rows) of a document's headings, paragraphs, list items and tables, in order."""
    box = Container(data)
    body = child(box.xml("word/document.xml"), "body")
    if body is None:
        raise ValueError("no document body")
    levels, out = _levels(box.xml("word/styles.xml")), []
    for e in body:
        if local(e) == "p":
            text = _text(e).strip()
            if not text:
                continue
            pr = child(e, "pPr")
            outline = attribute(child(pr, "outlineLvl"), "val")
            level = int(outline) + 1 if outline is not None and int(outline) < 9 else levels.get(attribute(child(pr, "pStyle"), "val"), 0)
            kind = "heading" if level else "list" if child(pr, "numPr") is not None else "paragraph"
            out.append((kind, level, text, []))
        elif local(e) == "tbl":
            rows = [["\n".join(_text(p) for p in c.iter() if local(p) == "p").strip() for c in r if local(c) == "tc"] for r in e if local(r) == "tr"]
            out.append(("table", 0, "\n".join("\t".join(r) for r in rows), rows))
    return out


# ---------------------------------------------------------------- XLSX


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of texts) of a workbook's sheets, in order."""
    box = Container(data)
    shared = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in children(box.xml("xl/sharedStrings.xml"))]
    targets = {attribute(r, "Id"): attribute(r, "Target") for r in children(box.xml("xl/_rels/workbook.xml.rels"))}
    out, cells = [], 0
    for sheet in children(child(box.xml("xl/workbook.xml"), "sheets")):
        target = targets.get(attribute(sheet, "id")) or ""
        root = box.xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        rows: list[list[str]] = []
        for r in children(child(root, "sheetData")):
            row: list[str] = []
            for c in r:
                at = _column(c.attrib["r"]) if "r" in c.attrib else len(row)
                cells += 1
                if at >= COLUMNS or cells > CELLS:
                    raise ValueError("workbook beyond its limits")
                kind, value = c.attrib.get("t"), child(c, "v")
                text = "".join(t.text or "" for t in c.iter() if local(t) == "t") if kind == "inlineStr" else "" if value is None else value.text or ""
                row += [""] * (at + 1 - len(row))
                row[at] = shared[int(text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text
            rows.append(row)
        out.append((sheet.attrib.get("name", ""), rows))
    return out


# ---------------------------------------------------------------- word lists


def _entry(role: str, *, wrong="", correct="", word="", category="", confidence=None) -> dict:
    try:
        score = None if confidence in (None, "") else min(1.0, max(0.0, float(confidence)))
    except ValueError:
        score = None
    return {"role": role, "wrong": wrong or None, "correct": correct or None, "word": word or None, "category": category or None, "confidence": score}


def table_words(rows: list[list[str]]) -> Iterator[dict]:
    """Entries of a table whose first row has header words; others of its columns are left out."""
    head = [str(x).strip().lstrip("﻿").lower() for x in (rows[0] if rows else ())]
    at = {k: next((i for i, h in enumerate(head) if h in names), None) for k, names in HEADERS.items()}
    for r in rows[1:]:
        v = {k: str(r[i]).strip() if i is not None and i < len(r) else "" for k, i in at.items()}
        if v["wrong"] and v["correct"] and v["wrong"] != v["correct"]:
            yield _entry("pairs", wrong=v["wrong"], correct=v["correct"], category=v["category"], confidence=v["confidence"])
        elif v["word"]:
            yield _entry("protect", word=v["word"], category=v["category"])


def json_words(text: str) -> Iterator[dict]:
    """Entries of a list, of an object of groups, or of one entry; a term's aliases each make a pair."""
    data = json.loads(text)
    groups = [("pairs", data)] if isinstance(data, list) else [(GROUPS[k], v) for k, v in data.items() if k in GROUPS and isinstance(v, list)] if isinstance(data, dict) else []
    for role, items in groups or [("pairs", [data])]:
        for x in items:
            if not isinstance(x, dict):
                continue
            v = {k: str(next((x[n] for n in names if n in x), "") or "").strip() for k, names in HEADERS.items()}
            known = next((x[n] for n in ALIASES if n in x), None)
            known = re.split("[,，]", known) if isinstance(known, str) else known or ([v["wrong"]] if v["wrong"] else [])
            if v["correct"]:
                for a in dict.fromkeys(str(y).strip() for y in known):
                    if a and a != v["correct"]:
                        yield _entry("terms" if role == "terms" else "pairs", wrong=a, correct=v["correct"], category=v["category"], confidence=v["confidence"])
            elif v["word"]:
                yield _entry("protect", word=v["word"], category=v["category"])


_HAN = re.compile("[一-鿿]")


def xml_words(text: str) -> Iterator[dict]:
    """Terms of TBX (the first term of an entry is the standard one) and XLIFF (the target is); both sides must have Han characters."""
    if "<!ENTITY" in text:
        raise ValueError("the file declares entities")
    root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>|<!DOCTYPE[^>]*>", "", text))

    def inner(e, name):
        return [t for x in e.iter() if local(x) == name and (t := "".join(x.itertext()).strip())]

    for e in root.iter():
        if local(e) in ("termEntry", "conceptEntry"):
            standard, *others = inner(e, "term") or [""]
        elif local(e) in ("trans-unit", "segment"):
            standard, others = (inner(e, "target") or [""])[0], inner(e, "source")
        else:
            continue
        for x in dict.fromkeys(others):
            if x != standard and _HAN.search(x) and _HAN.search(standard):
                yield _entry("terms", wrong=x, correct=standard)


def words_of(name: str, data: bytes) -> list[dict]:
    kind = name.rpartition(".")[2].lower()
    if kind == "docx":
        return [x for *_, rows in docx_blocks(data) if rows for x in table_words(rows)]
    if kind == "xlsx":
        return [x for _, rows in xlsx_sheets(data) for x in table_words(rows)]
    if kind == "json":
        return [*json_words(decode(data))]
    if kind in ("tbx", "xlf", "xliff", "xml"):
        return [*xml_words(decode(data))]
    raise ValueError(f"no word list in .{kind}")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(name, error, role, wrong, correct, word, category, confidence) of all word lists below path; a file without entries or that cannot be read is one row."""

    def run(frames):
        for b in frames:
            rows = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = p.rpartition("/")[2]
                try:
                    rows += [{"name": name, "error": None, **x} for x in words_of(name, data)] or [{"name": name, "error": "no entries"}]
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append({"name": name, "error": str(e) or type(e).__name__})
            columns = [[r.get(f.name) for r in rows] for f in _FOUND]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "name string, error string, " + WORD)
