"""Rule-based error detection: lexicon, regex rules and repeats, span resolution, severity, plan and apply.

A hit is a struct of half-open code-point spans.  Texts are searched in Arrow
batches with rules compiled once for each worker; rules and lexicon are bounded
parameters, given as lists.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIT = "start int, end int, wrong string, suggestion string, category string, confidence double"
ADVISORY = ("advice", "style")
#: Confidence below which a hit is a warning, and errors that a sentence shows.
LOW, SENTENCE_ERRORS = 0.60, 2


@dataclass(frozen=True)
class Pair:
    wrong: str
    correct: str
    category: str = "lexicon"
    confidence: float = 0.9


@dataclass(frozen=True)
class Rule:
    pattern: str
    replacement: str
    category: str
    confidence: float


@dataclass
class Rules:
    """Lexicon pairs, ordered regex rules and words that may repeat."""

    pairs: list[Pair] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    repeats: bool = True
    ignore: frozenset[str] = frozenset()


def load_pairs(df: DataFrame) -> DataFrame:
    """One correction for each wrong form: enabled, not equal to it and not containing it, the surest first, then the smaller."""
    ok = (F.col("enabled") == 1) & (F.col("confidence") > 0) & (F.col("wrong") != "") & (F.col("wrong") != F.col("correct")) & ~F.col("correct").contains(F.col("wrong"))
    w = Window.partitionBy("wrong").orderBy(F.desc("confidence"), "correct")
    return df.where(ok).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("wrong", "correct", "category", "confidence")


def lexicon_hits(text: str, by_first: dict[str, list[Pair]]) -> list[tuple]:
    """The longest pair at each place, going on one character after."""
    out = []
    for i, c in enumerate(text):
        for p in by_first.get(c, ()):
            if text.startswith(p.wrong, i):
                out.append((i, i + len(p.wrong), p.wrong, p.correct, p.category, p.confidence))
                break
    return out


def resolve(hits: list[tuple]) -> list[tuple]:
    """Drops hits inside a longer lexicon hit, then keeps the surest and longest that do not overlap, in order of place."""
    lex = sorted((h[0], h[1]) for h in hits if h[4] == "lexicon")
    starts = [a for a, _ in lex]
    reach, top = [], -1
    for _, b in lex:
        top = max(top, b)
        reach.append(top)

    def inside(h):
        k = bisect.bisect_right(starts, h[0])
        return h[4] != "lexicon" and k and reach[k - 1] >= h[1] and any(a <= h[0] and h[1] <= b and b - a > h[1] - h[0] for a, b in lex[:k])

    kept: list[tuple] = []
    spans: list[tuple[int, int]] = []
    for h in sorted((h for h in hits if not inside(h)), key=lambda h: (-h[5], h[0] - h[1])):
        k = bisect.bisect_left(spans, (h[0], h[1]))
        if (k and spans[k - 1][1] > h[0]) or (k < len(spans) and spans[k][0] < h[1]):
            continue
        spans.insert(k, (h[0], h[1]))
        kept.append(h)
    return sorted(kept)


class Checker:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.by_first: dict[str, list[Pair]] = {}
        for p in sorted(rules.pairs, key=lambda p: -len(p.wrong)):
            if p.wrong and p.wrong not in rules.ignore:
                self.by_first.setdefault(p.wrong[0], []).append(p)
        self.compiled = [(re.compile(r.pattern), r) for r in rules.rules]
        self.again = re.compile(r"\b(\w+)(\s+\1\b)+", re.IGNORECASE)

    def check(self, text: str | None) -> list[tuple]:
        text = text or ""
        hits = lexicon_hits(text, self.by_first)
        for rx, r in self.compiled:
            hits += [(m.start(), m.end(), m.group(), m.expand(r.replacement), r.category, r.confidence) for m in rx.finditer(text) if m.end() > m.start()]
        if self.rules.repeats:
            hits += [(m.start(), m.end(), m.group(), m.group(1), "repeat", 0.85 if len(m.group(1)) > 1 else 0.5) for m in self.again.finditer(text)]
        return resolve(hits)


def check_documents(docs: DataFrame, rules: Rules) -> DataFrame:
    """(id, start, end, wrong, suggestion, category, confidence): one row for each hit left after resolution."""

    def run(frames):
        checker = Checker(rules)
        for pdf in frames:
            rows = [(i, *h) for i, t in zip(pdf["id"], pdf["content"], strict=True) for h in checker.check(t)]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "wrong", "suggestion", "category", "confidence"])

    return docs.select("id", "content").mapInPandas(run, "id long, " + HIT)


def severity(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits with severity: advice is suggest, unsure is warning, more than two in a sentence are warnings, else error."""
    before = F.substring("content", F.lit(1), F.col("start"))
    j = hits.join(docs.select("id", "content"), "id").withColumn("sentence", F.regexp_count(before, F.lit("[.!?;。！？；\n]")).cast("int")).drop("content")
    able = ~F.col("category").isin(*ADVISORY) & (F.col("confidence") >= LOW)
    n = F.count(F.when(able, 1)).over(Window.partitionBy("id", "sentence").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    level = F.when(F.col("category").isin(*ADVISORY), "suggest").when(F.col("confidence") < LOW, "warning").when(n > SENTENCE_ERRORS, "warning").otherwise("error")
    return j.withColumn("severity", level)


def apply_hits(text: str, hits: list[tuple[int, int, str, str, str]]) -> tuple[str, int, int]:
    """Applies (start, end, wrong, suggestion, before) from right to left; a moved hit is found again by its context if that is unique."""
    out, done, skipped, taken = text, 0, 0, []
    placed = []
    for a, b, wrong, good, before in hits:
        if text[a:b] != wrong:
            places = [m.start() + len(before) for m in re.finditer(f"(?={re.escape(before + wrong)})", text)]
            if len(places) != 1:
                skipped += 1
                continue
            a, b = places[0], places[0] + len(wrong)
        if any(a < y and x < b for x, y in taken):
            skipped += 1
            continue
        taken.append((a, b))
        placed.append((a, b, good))
    for a, b, good in sorted(placed, reverse=True):
        out = out[:a] + good + out[b:]
        done += 1
    return out, done, skipped


def plan(hits: DataFrame, docs: DataFrame, least: float = 0.8, categories: list[str] | None = None) -> DataFrame:
    """Hits worth applying with 14 characters before them and the hash of the text they are of."""
    out = hits.where((F.col("confidence") >= least) & ~F.col("category").isin(*ADVISORY))
    if categories:
        out = out.where(F.col("category").isin(*categories))
    at = F.greatest(F.col("start") - 14, F.lit(0))
    return out.join(docs.select("id", "content"), "id").select("id", "start", "end", "wrong", "suggestion", F.substring("content", at + 1, F.col("start") - at).alias("before"))


def apply_plan(plan_: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, content, applied, skipped) of the documents in the plan, by their present text."""
    hits = plan_.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "wrong", "suggestion", "before"))).alias("hits"))

    def run(frames):
        for pdf in frames:
            rows = [(i, *apply_hits(t or "", [(h["start"], h["end"], h["wrong"], h["suggestion"], h["before"]) for h in hs])) for i, t, hs in zip(pdf["id"], pdf["content"], pdf["hits"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "content", "applied", "skipped"])

    return docs.select("id", "content").join(hits, "id").mapInPandas(run, "id long, content string, applied int, skipped int")


#: Spans that corrections leave alone: links, addresses, titles, quotations, code, quantities with units.
PROTECTED = r"""https?://[^\s<>"”》]+|[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|《[^《》\n]*》|“[^“”\n]*”|"[^"\n]*"|`[^`\n]*`|[0-9]+(?:\.[0-9]+)?(?:%|km|kg|元|年|月|日)"""


def protected_spans(text: Column) -> Column:
    """The protected spans of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))


def marked_html(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, html) of the documents (id, content) that have hits (id, start, end, suggestion, category): escaped text, each hit in a mark."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    own = hits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "category", "suggestion"))).alias("hits"))
    j = docs.select("id", "content").join(own, "id")
    cut = lambda a, b: F.substring(F.col("content"), a + 1, b - a)

    def step(state, h):
        mark = F.concat(F.lit('<mark class="'), h["category"], F.lit('" title="'), escape(h["suggestion"]), F.lit('">'), escape(cut(h["start"], h["end"])), F.lit("</mark>"))
        return F.struct(F.concat(state["html"], escape(cut(state["at"], h["start"])), mark).alias("html"), h["end"].alias("at"))

    start = F.struct(F.lit("").alias("html"), F.lit(0).alias("at"))
    html = F.aggregate("hits", start, step, lambda s: F.concat(s["html"], escape(cut(s["at"], F.length("content")))))
    return j.select("id", html.alias("html"))
