"""Blocks and paragraphs: derivation, normalization, alignment, budgets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ORDINALS = [(1, re.compile(r"^[一二三四五六七八九十百]+、")), (2, re.compile(r"^[（(][一二三四五六七八九十百]+[)）]")), (3, re.compile(r"^\d+[.．、]")), (4, re.compile(r"^[（(]\d+[)）]"))]
_END = tuple("。！？；：!?;:.”）)")


def heading_level(line: str) -> int:
    """1 to 4 by the ordinal that a line of up to 60 characters begins with, else 0."""
    return next((n for n, rx in _ORDINALS if len(line) <= 60 and rx.match(line)), 0)


def normalize(text: str) -> list[tuple[str, int, str]]:
    """(kind, level, text): markdown marks stripped, headings by ordinal, hard-wrapped lines joined; normalizing again changes nothing."""
    out: list[tuple[str, int, str]] = []
    for raw in (text or "").splitlines():
        line = re.sub(r"^#{1,6}\s+|[*_`]{1,3}(?=\S)|(?<=\S)[*_`]{1,3}", "", raw.strip()).strip()
        if not line:
            out.append(("break", 0, ""))
            continue
        level = heading_level(line)
        if level:
            out.append(("heading", level, line))
        elif out and out[-1][0] == "paragraph" and not out[-1][2].endswith(_END):
            out[-1] = ("paragraph", 0, out[-1][2] + line)
        else:
            out.append(("paragraph", 0, line))
    return [x for x in out if x[0] != "break"]


def heading_chain(levels: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """(position, problem) of headings (level, number): level jumps, repeated, skipped and falling numbers; a higher level restarts the lower."""
    last: dict[int, int] = {}
    out, before = [], 0
    for i, (level, n) in enumerate(levels):
        if level > before + 1:
            out.append((i, "level jump"))
        for k in [k for k in last if k > level]:
            del last[k]
        old = last.get(level)
        if old is not None and n != 1:
            if n == old:
                out.append((i, "repeated"))
            elif n > old + 1:
                out.append((i, "skipped"))
            elif n < old:
                out.append((i, "falling"))
        last[level], before = n, level
    return out


def locate(content: str, blocks: list[str]) -> list[int]:
    """The place of each block after the one before, -1 where it is absent; content[at:at + len] is the block."""
    at, out = 0, []
    for b in blocks:
        k = content.find(b, at) if b else -1
        out.append(k)
        at = k + len(b) if k >= 0 else at
    return out


def normalized_blocks(docs: DataFrame) -> DataFrame:
    """(id, ordinal, kind, level, text, char_offset) of the normalized blocks of (id, content)."""

    def run(frames):
        for pdf in frames:
            rows = []
            for i, t in zip(pdf["id"], pdf["content"], strict=True):
                blocks = normalize(t)
                rows += [(i, k, *b, at) for k, (b, at) in enumerate(zip(blocks, locate(t or "", [b[2] for b in blocks]), strict=True))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "kind", "level", "text", "char_offset"])

    return docs.select("id", "content").mapInPandas(run, "id long, ordinal int, kind string, level int, text string, char_offset int")


def within_budget(rows: DataFrame, group: str, size: str, limit: int) -> DataFrame:
    """rows (group, id, size) with included: in order of id while the sum fits; one that does not is passed over and later smaller ones may fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, total, ok = pdf.sort_values("id"), 0, []
        for n in pdf[size]:
            ok.append(total + n <= limit)
            total += n if ok[-1] else 0
        return pdf.assign(included=ok)[[group, "id", size, "included"]]

    return rows.select(group, "id", size).groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, id long, {size} long, included boolean")


def align(reference: DataFrame, draft: DataFrame) -> DataFrame:
    """(role, nth, relation, reference_id, draft_id) of paragraphs (id, role, level): by role and occurrence; missing, extra, level_mismatch, matched."""
    w = Window.partitionBy("role").orderBy("id")
    r = reference.select("role", F.row_number().over(w).alias("nth"), F.col("id").alias("reference_id"), F.col("level").alias("l1"))
    d = draft.select("role", F.row_number().over(w).alias("nth"), F.col("id").alias("draft_id"), F.col("level").alias("l2"))
    relation = F.when(F.col("draft_id").isNull(), "missing").when(F.col("reference_id").isNull(), "extra").when(F.col("l1") != F.col("l2"), "level_mismatch").otherwise("matched")
    return r.join(d, ["role", "nth"], "full_outer").select("role", "nth", relation.alias("relation"), "reference_id", "draft_id")


def clean(text: Column) -> Column:
    """struct(text, changes): vertical tabs and form feeds as line ends, control characters out, blank lines squeezed, indents out."""
    a = F.regexp_replace(text, "[\x0b\x0c]", "\n")
    b = F.regexp_replace(a, "[\x00-\x08\x0e-\x1f]", "")
    c = F.regexp_replace(b, "\n{3,}", "\n\n")
    d = F.regexp_replace(c, "(?m)^[ \t　]+", "")
    n = F.regexp_count(text, F.lit("[\x0b\x0c]")) + F.regexp_count(a, F.lit("[\x00-\x08\x0e-\x1f]")) + F.regexp_count(b, F.lit("\n{3,}")) + F.regexp_count(c, F.lit("(?m)^[ \t　]+"))
    return F.struct(d.alias("text"), n.alias("changes"))


def plain_text(title: Column, blocks: Column) -> Column:
    """Title and blocks, one a line; a first block equal to the title is dropped."""
    texts = F.transform(blocks, lambda b: b["text"])
    rest = F.when(F.try_element_at(texts, F.lit(1)) == title, F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0)))).otherwise(texts)
    return F.array_join(F.concat(F.array(title), rest), "\n")


def anchor(content: Column, text: Column, offset: Column) -> Column:
    """The offset if text still stands there, else where it stands once, else -1."""
    n = F.length(text)
    here = F.substring(content, offset + 1, n) == text
    first = F.call_function("instr", content, text)
    again = F.call_function("locate", text, content, first + 1)
    return F.when(here, offset).when((first > 0) & (again == 0), first - 1).otherwise(F.lit(-1))
