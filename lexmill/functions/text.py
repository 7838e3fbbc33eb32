"""Scalar text functions as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def text_hash(text: Column) -> Column:
    """sha256 of the text without any white space: the identity of a document's content."""
    return F.sha2(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]", ""), 256)


#: Han and kana, which are written without spaces.
_UNSPACED = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; a run of Han or kana is segmented into every two neighbouring characters (one stays alone)."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    parts = F.regexp_extract_all(F.lower(text), F.lit(rf"{_UNSPACED}+|(?:(?!{_UNSPACED})[\p{{L}}\p{{N}}])+"), F.lit(0))

    def pairs(t):
        return F.when(t.rlike(f"^{_UNSPACED}{{3,}}$"), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array(t))

    return F.when(text.rlike(_UNSPACED), F.flatten(F.transform(parts, pairs))).otherwise(plain)


def sentences(text: Column, ends: str = "。！？；!?;\n.") -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(text, f"[{ends}]"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def paragraph_no(text: Column, position: Column) -> Column:
    """1 + line ends before a 0-based position."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), position), "[^\n]", "")) + 1


_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"


def to_half_width(text: Column) -> Column:
    return F.translate(text, _FULL, _HALF)


def to_full_width(text: Column) -> Column:
    return F.translate(text, _HALF, _FULL)


def normalize_date(text: Column) -> Column:
    """ISO date of 2026年8月5日, 2026.8.5, 2026/8/5 or 2026-8-5 if the calendar has it; a year alone is its first day; else ''."""
    rx = r"(\d{4})\s*[年./\-]\s*(\d{1,2})\s*[月./\-]\s*(\d{1,2})\s*日?"
    day = F.concat_ws("-", F.regexp_extract(text, rx, 1), F.lpad(F.regexp_extract(text, rx, 2), 2, "0"), F.lpad(F.regexp_extract(text, rx, 3), 2, "0"))
    iso = F.date_format(day.try_cast("date"), "yyyy-MM-dd")
    year = F.regexp_extract(F.trim(text), r"^(\d{4})年?$", 1)
    return F.when(text.rlike(rx), F.coalesce(iso, F.lit(""))).when(year != "", F.concat(year, F.lit("-01-01"))).otherwise("")


_DOC_NO = r"^(.*?)[〔\[［（(](\d{4})[〕\]］）)]\s*(\d{1,9})\s*号"


def parse_doc_no(doc_no: Column) -> Column:
    """struct(prefix, year, serial) of a document number, whatever its brackets; ('', '', 0) if it is none."""
    serial = F.regexp_extract(doc_no, _DOC_NO, 3)
    return F.struct(F.trim(F.regexp_extract(doc_no, _DOC_NO, 1)).alias("prefix"), F.regexp_extract(doc_no, _DOC_NO, 2).alias("year"), F.coalesce(serial.try_cast("int"), F.lit(0)).alias("serial"))


def format_doc_no(prefix: Column, year: Column, serial: Column) -> Column:
    return F.concat(prefix, F.lit("〔"), year.cast("string"), F.lit("〕"), serial.cast("string"), F.lit("号"))


def csv_safe(value: Column) -> Column:
    """A leading ' before what a spreadsheet would run: starts with = + - @ and is no number."""
    risky = F.substring(value, 1, 1).isin("=", "+", "-", "@") & value.try_cast("double").isNull()
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def safe_name(name: Column) -> Column:
    """A file name: illegal characters become _, no trailing dots or spaces, device names are prefixed, 80 characters at most."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_"), r"[. ]+$", "")
    clean = F.when(F.upper(F.substring_index(clean, ".", 1)).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.substring(F.when(F.trim(clean) == "", F.lit("_")).otherwise(clean), 1, 80)


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024**2, F.format_string("%.1f KB", F.bround(n / 1024.0, 1))).when(n < 1024**3, F.format_string("%.1f MB", F.bround(n / 1024.0**2, 1))).otherwise(F.format_string("%.1f GB", F.bround(n / 1024.0**3, 1)))


#: Kinds of personal data and their patterns.
PII = {
    "id_card": r"(?<![0-9])[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx](?![0-9])",
    "mobile": r"(?<![0-9])1[3-9]\d{9}(?![0-9])",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "bank_card": r"(?<![0-9])(?:\d{16}|\d{19})(?![0-9])",
    "landline": r"(?<![0-9])0\d{2,3}-\d{7,8}(?![0-9])",
}


def mask(value: Column) -> Column:
    """The first two and the last two characters, stars between."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), n - 4), F.substring(value, -2, 2)))


def personal_data(text: Column) -> Column:
    """array<struct<kind,value,masked>> of everything that looks like personal data."""

    def of(kind: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(PII[kind]), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), mask(v).alias("masked")))

    return F.flatten(F.array(*map(of, PII)))


def days_left(due: Column, today: Column, closed: Column) -> Column:
    """Days to the due date (negative: overdue); null if closed, blank or no date."""
    return F.when(closed | (due == ""), F.lit(None)).otherwise(F.datediff(due.try_cast("date"), today.try_cast("date")))


def set_tags(tags: Column, add: Column, remove: Column) -> Column:
    """An ordered tag list in which both commas are read and ， is written."""
    own = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), "[,，]"), lambda t: F.trim(t)), lambda t: t != "")
    return F.array_join(F.array_except(F.array_distinct(F.concat(own, add)), remove), "，")


def looks_binary(text: Column) -> Column:
    """Whether the first 4 KB have a NUL or more than a tenth of unreadable characters."""
    head = F.substring(text, 1, 4096)
    odd = F.length(F.regexp_replace(head, "[^\\x00-\\x08\\x0E-\\x1F\\uFFFD]", ""))
    return head.contains("\0") | (odd * 10 > F.length(head))


def by_dictionary(text: Column, pairs: dict[str, str]) -> Column:
    """text with single characters replaced by a dictionary; others stay."""
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def material(raw: Column) -> Column:
    """struct(title, tags, body) of a material file: ``# title``, then ``@TAGS a|b`` if it has tags, then the body; no title, no tags."""
    lines = F.split(raw, "\n")
    first, second = F.get(lines, 0), F.coalesce(F.get(lines, 1), F.lit(""))
    title = F.when(first.startswith("# "), F.trim(F.substring(first, F.lit(3), F.length(first)))).otherwise("")
    tagged = (title != "") & second.startswith("@TAGS ")
    tags = F.when(tagged, F.transform(F.split(F.substring(second, F.lit(7), F.length(second)), "\\|"), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    skipped = F.when(tagged, 2).when(title != "", 1).otherwise(0)
    return F.struct(title.alias("title"), tags.alias("tags"), F.array_join(F.slice(lines, skipped + 1, F.greatest(F.size(lines) - skipped, F.lit(0))), "\n").alias("body"))
