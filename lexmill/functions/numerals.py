"""Chinese numerals and amounts."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits, units and capital forms.
DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
UNITS = {"十": 10, "百": 100, "千": 1000}
MYRIADS = {"万": 10**4, "亿": 10**8}
CAPITALS, PLACES, GROUPS = "零壹贰叁肆伍陆柒捌玖", ("", "拾", "佰", "仟"), ("", "万", "亿", "万亿")


def cn_to_number(s: str | None) -> float | None:
    """The value of a Chinese numeral (十二, 三百零五, 一万二千, 二〇二六, 三点五); None if it is none."""
    if not s:
        return None
    whole, _, part = s.partition("点")
    if part:
        frac = [DIGITS.get(c) for c in part]
        base = cn_to_number(whole) if whole else 0.0
        return None if base is None or None in frac else base + float("0." + "".join(map(str, frac)))
    if all(c in DIGITS for c in whole):
        return float("".join(str(DIGITS[c]) for c in whole))
    total = section = digit = 0
    for c in whole:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in UNITS:
            section += (digit or 1) * UNITS[c]
            digit = 0
        elif c in MYRIADS:
            total = (total + section + digit) * MYRIADS[c] if c == "亿" else total + (section + digit) * MYRIADS[c]
            section = digit = 0
        else:
            return None
    return float(total + section + digit)


def amount_cn(value: str | None) -> str | None:
    """An amount of money in capital numerals; more than two decimals or what is no number gives None."""
    try:
        x = abs(Decimal(value))
    except (InvalidOperation, TypeError, ValueError):
        return None
    if not x.is_finite() or x != x.quantize(Decimal("0.01")) or x >= 10**16:
        return None
    cents = int(x * 100)
    yuan, jiao, fen = cents // 100, cents // 10 % 10, cents % 10
    out, gap = "", False
    digits = str(yuan)
    for i, c in enumerate(digits):
        at = len(digits) - 1 - i
        if c == "0":
            gap = True
        else:
            out += ("零" if gap and out else "") + CAPITALS[int(c)] + PLACES[at % 4]
            gap = False
        if at % 4 == 0 and at and int(digits[max(0, i - 3) : i + 1]):
            out += GROUPS[at // 4]
    text = (out + "元") if yuan else ""
    if jiao:
        text += CAPITALS[jiao] + "角"
    elif fen and yuan:
        text += "零"
    text += CAPITALS[fen] + "分" if fen else "整"
    if not cents:
        return "零元整"
    return "人民币" + text


@F.pandas_udf(T.DoubleType())
def cn_number(s: pd.Series) -> pd.Series:
    return s.map(cn_to_number).astype("float64")


@F.pandas_udf(T.StringType())
def amount_in_words(s: pd.Series) -> pd.Series:
    return s.map(amount_cn)


def date_cn(iso):
    """An ISO date with Chinese digits for the year and numerals for month and day."""
    num = lambda c: F.when(c < 10, F.translate(c.cast("string"), "0123456789", "〇一二三四五六七八九")).when(c == 10, F.lit("十")).otherwise(F.concat(F.when(c >= 20, F.translate(F.floor(c / 10).cast("string"), "0123456789", "〇一二三四五六七八九")).otherwise(""), F.lit("十"), F.when(c % 10 > 0, F.translate((c % 10).cast("string"), "0123456789", "〇一二三四五六七八九")).otherwise("")))
    d = iso.try_cast("date")
    return F.concat(F.translate(F.year(d).cast("string"), "0123456789", "〇一二三四五六七八九"), F.lit("年"), num(F.month(d)), F.lit("月"), num(F.day(d)), F.lit("日"))
