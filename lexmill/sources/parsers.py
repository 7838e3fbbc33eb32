"""Parsers of text, Markdown and HTML into blocks; a file that cannot be read is a row with an error, never a failure."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = T.StructType([T.StructField("type", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])
PARSED = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("title", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("error", T.StringType())])
_HEADING = re.compile(r"^(第[一二三四五六七八九十百]+[章节条]|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\d+[.、])")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f]")


def decode(raw: bytes) -> str:
    """By byte-order mark, else the first of utf-8, gb18030 and big5 that fits, else with replacements."""
    for mark, enc in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(enc, "replace")
    for enc in ("utf-8", "gb18030", "big5"):
        try:
            return raw.decode(enc)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


def parse_text(text: str) -> tuple[str, list[tuple]]:
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return (lines[0] if lines else ""), [("heading", 2, x) if len(x) <= 40 and _HEADING.match(x) else ("paragraph", 0, x) for x in lines]


def _plain(s: str) -> str:
    s = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)
    return re.sub(r"[*_`~]{1,3}(\S(?:.*?\S)?)[*_`~]{1,3}", r"\1", s).strip()


def parse_markdown(text: str) -> tuple[str, list[tuple]]:
    out, fence = [], False
    for line in text.splitlines():
        if line.lstrip().startswith("```"):
            fence = not fence
        elif fence:
            out.append(("paragraph", 0, line))
        elif m := re.match(r"^(#{1,6})\s+(.*)$", line):
            out.append(("heading", min(4, len(m[1])), _plain(m[2])))
        elif m := re.match(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$", line):
            out.append(("list_item", 0, _plain(m[1])))
        elif line.strip():
            out.append(("paragraph", 0, _plain(line)))
    return next((t for k, _, t in out if k == "heading"), out[0][2] if out else ""), out


class _Html(HTMLParser):
    KINDS = {"p": "paragraph", "li": "list_item", "blockquote": "paragraph", **{f"h{i}": "heading" for i in range(1, 7)}}

    def __init__(self):
        super().__init__()
        self.out, self.all, self.open, self.skip, self.title, self.in_title = [], [], None, 0, "", False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in self.KINDS:
            self.close_block()
            self.open = [tag, []]

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif self.open and tag == self.open[0]:
            self.close_block()

    def close_block(self):
        if self.open and (t := " ".join("".join(self.open[1]).split())):
            tag = self.open[0]
            self.out.append((self.KINDS[tag], min(4, int(tag[1])) if tag[0] == "h" and tag[1:].isdigit() else 0, t))
        self.open = None

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.all.append(data)
            if self.open:
                self.open[1].append(data)


def parse_html(text: str) -> tuple[str, list[tuple]]:
    p = _Html()
    p.feed(text)
    p.close()
    p.close_block()
    body = " ".join("".join(p.all).split())
    blocks = p.out or ([("paragraph", 0, body)] if body else [])
    return " ".join(p.title.split()) or next((t for k, _, t in blocks if k == "heading"), body[:50]), blocks


PARSERS = {"txt": parse_text, "md": parse_markdown, "html": parse_html, "htm": parse_html}


def parse_any(name: str, raw: bytes | str | None) -> dict:
    kind = name.rpartition(".")[2].lower()
    try:
        if raw is None:
            raise ValueError("no content")
        if kind not in PARSERS and kind != "docx":
            raise ValueError(f"no parser for .{kind}")
        if kind == "docx":
            from .office import docx_blocks

            blocks = [(k, n, t) for k, n, t, _ in docx_blocks(raw)]
            title = next((t for k, _, t in blocks if k == "heading"), blocks[0][2][:50] if blocks else "")
        else:
            title, blocks = PARSERS[kind](_CONTROL.sub("", decode(raw) if isinstance(raw, bytes) else raw))
        if not blocks:
            raise ValueError("empty")
        return {"ok": True, "title": title, "blocks": [{"type": k, "level": n, "text": t} for k, n, t in blocks], "error": None}
    except Exception as e:  # one file's failure is its row's
        return {"ok": False, "title": None, "blocks": [], "error": str(e)}


@F.pandas_udf(PARSED)
def parsed(name: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_any(n, c) for n, c in zip(name, content, strict=True)], columns=["ok", "title", "blocks", "error"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, ok, title, blocks, error) of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").select("name", parsed("name", "content").alias("p")).select("name", "p.*")


def sniff_delimiter(lines: list[str]) -> str:
    """Of , tab ; | the one with the most even and then the most columns."""
    def rank(d):
        n = [x.count(d) for x in lines if x.strip() and not x.startswith("#")]
        return (sum(k == max(set(n), key=n.count) and k > 0 for k in n) / len(n), max(set(n), key=n.count)) if n else (0, 0)

    return max([",", "\t", ";", "|"], key=rank)


#: Header words of word lists.
HEADERS = {"wrong": ("wrong", "error", "错误", "误"), "correct": ("correct", "right", "正确", "正"), "word": ("word", "term", "词", "词语"), "category": ("category", "type", "类别"), "confidence": ("confidence", "score", "置信度")}


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """A delimited word list (wrong, correct, word, category, confidence): the delimiter is sniffed on its first lines, # lines are comments, headers may be aliases."""
    head = [r[0] for r in spark.read.text(path).limit(20).collect()]
    df = spark.read.option("sep", sniff_delimiter(head)).option("comment", "#").option("header", "true").csv(path)
    at = {k: next((c for c in df.columns if c.strip().lstrip("﻿").lower() in names), None) for k, names in HEADERS.items()}
    null = F.lit(None).cast("string")
    cols = [F.trim(F.col(f"`{at[k]}`")).alias(k) if at[k] else null.alias(k) for k in ("wrong", "correct", "word", "category")]
    score = F.col(f"`{at['confidence']}`").try_cast("double") if at["confidence"] else F.lit(None).cast("double")
    return df.select(*cols, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"))


def web_text(html: Column) -> Column:
    """Text of a page by patterns alone: no scripts and styles, block ends as line ends, tags dropped, common entities resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title)\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def page_title(html: Column) -> Column:
    """og:title, else h1, else title, without a site suffix."""
    og = F.regexp_extract(html, r'(?is)<meta[^>]+og:title[^>]+content="([^"]*)"', 1)
    h1 = F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"(?s)<[^>]*>", "")
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    best = F.coalesce(F.nullif(F.trim(og), F.lit("")), F.nullif(F.trim(h1), F.lit("")), F.trim(title))
    return F.trim(F.regexp_replace(best, r"\s*[|_]\s*[^|_]*$", ""))


def robots_rules(lines: DataFrame) -> DataFrame:
    """(agent, allow, path) of robots.txt lines (no, line): consecutive agent lines share the rules after them."""
    from pyspark.sql import Window

    key = F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1)))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"^[^:]*:(.*)$", 1), r"#.*$", ""))
    x = lines.select("no", key.alias("key"), value.alias("value")).where("key in ('user-agent', 'allow', 'disallow')")
    w = Window.orderBy("no")
    x = x.withColumn("new", ((F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")).cast("int")).withColumn("grp", F.sum("new").over(w))
    agents = x.where("key = 'user-agent'").select("grp", F.lower("value").alias("agent"))
    rules = x.where("key <> 'user-agent' and value <> ''").select("grp", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(rules, "grp").select("agent", "allow", "path")


def robots_allow(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, allowed) by the longest rule that the path starts with; allow wins a tie; no rule allows."""
    j = paths.join(F.broadcast(rules.withColumnRenamed("path", "rule")), F.expr("startswith(path, rule)"), "left")
    return j.groupBy("path").agg(F.coalesce(F.max_by("allow", F.struct(F.length("rule"), "allow")), F.lit(True)).alias("allowed"))
