"""Sinks: guarded CSV by Spark's writer, workbooks, rule lists, reports and hand-over packages."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a workbook takes; more go to write_csv.
WORKBOOK_ROWS = 100_000
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def guarded(c: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe, numbers excepted."""
    text = c.cast("string")
    return F.when(text.rlike(r"^\s*[=+\-@\t\r]") & text.try_cast("double").isNull(), F.concat(F.lit("'"), text)).otherwise(text)


def write_csv(df: DataFrame, path: str) -> None:
    """df as CSV with a header, every text cell guarded, by Spark's writer (a file for each partition)."""
    df.select(*[guarded(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def _letters(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(sheets: list[tuple[str, list[str], list[list]]]) -> bytes:
    """An XLSX file of (name, header, rows); numbers stay numbers, all else is text."""

    def cell(r: int, c: int, v) -> str:
        ref = f"{_letters(c)}{r}"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return "" if v is None else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {_MAIN} xmlns:r="{_OFFICE}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        for i, (_, header, rows) in enumerate(sheets, 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate([header, *rows], 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet {_MAIN}><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def workbook_of(frames: dict[str, DataFrame]) -> bytes:
    """A workbook with a sheet for each table; a table of more than WORKBOOK_ROWS rows is refused, not cut."""
    sheets = []
    for name, df in frames.items():
        rows = df.limit(WORKBOOK_ROWS + 1).collect()
        if len(rows) > WORKBOOK_ROWS:
            raise ValueError(f"{name} has more than {WORKBOOK_ROWS} rows: write it as CSV")
        sheets.append((name, df.columns, [[*r] for r in rows]))
    return workbook(sheets)


def write_rules(pairs: DataFrame, path: str) -> None:
    """The enabled pairs (wrong, correct, category, confidence, enabled) as a word list that read_word_list reads."""
    write_csv(pairs.where("enabled").select("wrong", "correct", "category", "confidence"), path)


def write_package(docs: DataFrame, path: str) -> DataFrame:
    """A hand-over package below path: documents (id, title, content) as Parquet and a manifest (id, bytes, sha256); returns the manifest as read back."""
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    back = docs.sparkSession.read.parquet(f"{path}/documents")
    back.select("id", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256")).write.mode("overwrite").parquet(f"{path}/manifest")
    return docs.sparkSession.read.parquet(f"{path}/manifest")
