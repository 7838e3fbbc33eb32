"""Consistency of writings within a document: numbers, dates, punctuation, sequences."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerals import cn_to_number

FINDING = "kind string, label string, first string, variant string, positions array<int>"
MOST = 20
_NUM = "零〇一二两三四五六七八九十百千"
_QUANTITY = re.compile(rf"(?<![第\d.%—\-~～至])(?P<n>\d+(?:\.\d+)?|[{_NUM}]+)(?P<scale>[万亿]?)(?P<unit>个工作日|个月|工作日|人次|公里|平方米|元|人|天|日内|年内|次|项|名|家|吨|米)(?![—\-~～至])")
_DATES = [
    ("iso", re.compile(r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)")),
    ("dot", re.compile(r"(?<!\d)(\d{4})\.(\d{1,2})\.(\d{1,2})(?!\d)")),
    ("slash", re.compile(r"(?<!\d)(\d{4})/(\d{1,2})/(\d{1,2})(?!\d)")),
    ("zh", re.compile(r"(?<!\d)(\d{4})年(\d{1,2})月(\d{1,2})日")),
    ("cn", re.compile(rf"([{_NUM}]{{4}})年([{_NUM}]{{1,3}})月([{_NUM}]{{1,3}})日")),
]
#: A month or day of a year, which may be left out, and what joins the two ends of a range.
_MENTION = re.compile(r"(?:(?P<year>\d{4})年)?(?P<month>\d{1,2})月(?:(?P<day>\d{1,2})日)?")
_JOINS = {"至", "到", "—", "——", "-", "~", "～"}


def numbers(text: str) -> list[tuple]:
    """One quantity written in digits and in numerals; ranges and ordinals are left out."""
    by = defaultdict(lambda: defaultdict(list))
    for m in _QUANTITY.finditer(text):
        arabic = m["n"][0].isdigit()
        v = float(m["n"]) if arabic else cn_to_number(m["n"])
        if v is not None:
            by[m["unit"], v * {"": 1, "万": 10**4, "亿": 10**8}[m["scale"]]][arabic].append((m.start(), m.group()))
    out = []
    for styles in by.values():
        if len(styles) == 2:
            every = sorted(styles[True] + styles[False])
            first = every[0]
            other = next(x for x in every if x[1][0].isdigit() != first[1][0].isdigit())
            out.append(("number", "数字写法不一致", first[1], other[1], [p for p, _ in every][:50]))
    return out[:MOST]


def dates(text: str) -> list[tuple]:
    """One date in two styles."""
    by = defaultdict(list)
    for style, rx in _DATES:
        for m in rx.finditer(text):
            y, mo, d = (int(x) if x.isdigit() and x.isascii() else int(cn_to_number(x) or 0) for x in m.groups())
            try:
                by[date(y, mo, d)].append((m.start(), style, m.group()))
            except ValueError:
                continue
    out = []
    for found in by.values():
        found.sort()
        other = next((x for x in found if x[1] != found[0][1]), None)
        if other:
            out.append(("date", "日期写法不一致", found[0][2], other[2], [p for p, *_ in found][:50]))
    return out[:MOST]


def date_order(text: str) -> list[tuple]:
    """Ranges that end before they begin; an end without a year is in the year of its beginning."""
    out, found = [], [*_MENTION.finditer(text)]
    for a, b in itertools.pairwise(found):
        if not a["year"] or text[a.end() : b.start()].strip() not in _JOINS:
            continue
        begin = int(a["year"]), int(a["month"]), int(a["day"] or 1)
        end = int(b["year"] or a["year"]), int(b["month"]), int(b["day"] or 31)
        if end < begin:
            out.append(("date_order", "起止日期颠倒", text[a.start() : b.end()], "", [a.start()]))
    return out[:MOST]


def sequence(text: str) -> list[tuple]:
    """Gaps in a run of three or more （一）（二）… markers; a lower number restarts."""
    marks = [(m.start(), int(cn_to_number(m[1]) or 0), m.group()) for m in re.finditer(rf"(?m)^\s*[（(]([{_NUM}]+)[)）]", text)]
    if len(marks) < 3:
        return []
    return [("sequence", "序号跳号", a[2].strip(), b[2].strip(), [b[0]]) for a, b in zip(marks, marks[1:], strict=False) if b[1] > a[1] + 1][:MOST]


CHECKS = (numbers, dates, date_order, sequence)


def check(docs: DataFrame) -> DataFrame:
    """(id, kind, label, first, variant, positions) of all checks, by first position."""

    def run(frames):
        for pdf in frames:
            rows = []
            for i, t in zip(pdf["id"], pdf["content"], strict=True):
                found = []
                for f in CHECKS:
                    found += f(t or "")
                rows += [(i, *x) for x in sorted(found, key=lambda x: (x[4][0], x[0]))]
            yield pd.DataFrame(rows, columns=["id", "kind", "label", "first", "variant", "positions"])

    return docs.select("id", "content").mapInPandas(run, "id long, " + FINDING)


def punctuation_mix(text: Column) -> Column:
    """struct(ascii, full) counts of marks between CJK characters."""
    return F.struct(F.regexp_count(text, F.lit(r"(?<=\p{IsHan})[,;:()](?=\p{IsHan})")).alias("ascii"), F.regexp_count(text, F.lit("(?<=\\p{IsHan})[，；：（）]")).alias("full"))


def char_runs(text: Column) -> Column:
    """Maximal runs of two or more of one CJK character."""
    return F.regexp_extract_all(text, F.lit(r"((\p{IsHan})\2+)"), F.lit(1))


def org_names(docs: DataFrame, renamed: DataFrame) -> DataFrame:
    """(id, old, new) where an old and a new name stand together, the old one not only inside the new one."""
    j = docs.select("id", "content").join(F.broadcast(renamed), F.expr("contains(content, old) and contains(content, new)"))
    return j.where("contains(replace(content, new, ''), old)").select("id", "old", "new")
