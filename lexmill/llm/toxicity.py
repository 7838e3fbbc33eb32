"""Toxicity by compression distance: two zstandard dictionaries, trained on toxic and on ordinary text.

Texts become windows of distinct lower-cased words, one a line.  A dictionary is
trained on the word beginnings that tell its class from the other, chosen greedily
so that each training document is covered ``COVER`` times.  The windows are compressed with either dictionary (literals stored as they are, so
that only matches shorten a window); the differences in length give a score by
logistic calibration, whose threshold is set on documents kept out of the
dictionaries.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: The model is fitted on at most so many labelled documents of each class (smallest id hashes) and so many characters each, a third of them for calibration.
FIT_TOXIC, FIT_ORDINARY, FIT_CHARS = 1000, 2000, 50_000
#: Words of a window, times a document is covered, bytes of a beginning, beginnings kept, the score that decides.
WINDOW, COVER, START, LONGEST, KEPT, CUT = 16, 3, 5, 9, 300, 0.3
#: A beginning is tried if this share of its class (and three texts) has it, so many times as often as the other class, and so surprisingly often that of all beginnings about CHANCE would be by accident.
LEAST_SHARE, TELLING, CHANCE = 0.02, 6, 1.0
#: Both dictionaries and all windows have it, so that a window always compresses and one more match shortens it.
_HEAD = bytes(range(128, 160))
#: Between words: with a word's first START bytes as long as the shortest match, so that matches begin with a word.
_LINE = b"\n\n"
#: Scripts that write no spaces between words: Thai to Lao, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _pairs(m: re.Match) -> str:
    run = m[0]
    return f" {' '.join(run[i : i + 2] for i in range(max(1, len(run) - 1)))} "


def distinct_words(text: str) -> list[bytes]:
    """Lower-cased words in order; in scripts without spaces every two neighbouring characters are a word."""
    text = text.lower()
    if not text.isascii():
        text = _UNSPACED.sub(_pairs, text)
    return [*dict.fromkeys(x for x in (w.strip(_STRIP) for w in text.encode().split()) if x)]


def beginnings(text: str) -> set[bytes]:
    """Beginnings of START to LONGEST bytes of the text's words; a line end closes a word."""
    return {x[:n] for x in (w + b"\n" for w in distinct_words(text)) for n in range(START, min(LONGEST, len(x)) + 1)}


def train_segments(own: list[str], other: list[str]) -> list[bytes]:
    """Word beginnings that tell own texts from others, the most telling first.

    Greedy: each own text is to be covered COVER times.  A beginning that few own
    texts have is left out, as a family of copies alone could make it.
    """
    has = [beginnings(t) for t in own]
    seen, against = Counter(w for g in has for w in g), Counter()
    few = max(3, LEAST_SHARE * len(own))
    tried = {w for w, n in seen.items() if n >= few}
    for t in other:
        against.update(beginnings(t) & tried)
    a, b = max(1, len(own)), max(1, len(other))
    surprise = lambda n, w: n * math.log(n / ((n + against[w]) * a / (a + b)))  # noqa: E731  half of the likelihood ratio's statistic
    chance = math.log(max(1, len(tried)) / CHANCE)
    tried = {w for w in tried if seen[w] / a > TELLING * (against[w] + 0.5) / (b + 1) and surprise(seen[w], w) > chance}
    gain = lambda w, n: (n * math.log((n + 0.01) / a / ((against[w] + 0.5) / (b + 1))), len(w), w)
    has = [g & tried for g in has]
    left, count, kept = [COVER] * len(own), Counter(w for g in has for w in g), []
    while count and len(kept) < KEPT:
        w = max(count, key=lambda w: gain(w, count[w]))
        if count[w] < max(3, 0.004 * a):
            break
        kept.append(w)
        for x in [x for x in count if x.startswith(w) or w.startswith(x)]:  # one form of a beginning is enough
            del count[x]
        for i, g in enumerate(has):
            if w in g and left[i]:
                left[i] -= 1
                if not left[i]:
                    for x in g:
                        if x in count:
                            count[x] -= 1
    return kept


def dictionary(kept: list[bytes]) -> bytes:
    """The content of a zstandard dictionary, the most telling segment last (nearest).

    Segments begin at multiples of three: of a dictionary's places the fast strategy
    indexes these first (others may go under).
    """
    out = b"\0\0"
    for w in reversed(kept):
        out += b"\0" + _LINE + w
        out += b"\0" * ((2 - len(out)) % 3)
    return out + b"\0" + _HEAD


def compressor(content: bytes):
    import zstandard as z

    p = z.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=14, search_log=1, min_match=7, target_length=1, strategy=z.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(dict_data=d, compression_params=p)


def features(text: str, toxic, ordinary) -> tuple[float, float, float, float]:
    """Of the windows' differences in length: the greatest, the second, the sum of those of a match (clipped) and their share."""
    w = distinct_words(text)
    d = sorted((len(ordinary.compress(x)) - len(toxic.compress(x)) for x in (_HEAD + _LINE + _LINE.join(w[i : i + WINDOW]) + _LINE for i in range(0, len(w), WINDOW))), reverse=True)
    hits = [x for x in d if x >= 3]
    return (min(d[0], 6.0), min(d[1], 6.0) if len(d) > 1 else 0.0, min(sum(hits), 12.0), len(hits) / len(d)) if d else (0.0, 0.0, 0.0, 0.0)


def without_copies(texts: list[str]) -> list[str]:
    """The texts that are no near copy of an earlier one (half of the 16 least hashes of their neighbouring words)."""
    seen: dict[int, list[int]] = {}
    out = []
    for i, t in enumerate(texts):
        words = distinct_words(t)
        least = sorted({zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)})[:16]
        with_ = Counter(j for h in least for j in seen.get(h, ()))
        if with_ and 2 * max(with_.values()) >= len(least):
            continue
        for h in least:
            seen.setdefault(h, []).append(i)
        out.append(t)
    return out


class Model:
    """Dictionaries and calibration; score(text) is in 0 to 1 and at CUT on the decision line."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        toxic, ordinary = without_copies(toxic), without_copies(ordinary)
        keep = lambda x, r: [t for i, t in enumerate(x) if (i % 3 == 2) == r]
        a, b = keep(toxic, False), keep(ordinary, False)
        self.toxic, self.ordinary = dictionary(train_segments(a, b)), dictionary(train_segments(b, a))
        ct, co = compressor(self.toxic), compressor(self.ordinary)
        x = [(features(t, ct, co), y) for y, texts in ((1, keep(toxic, True)), (0, keep(ordinary, True))) for t in texts]
        self.weights, self.mean, self.scale, self.shift = np.zeros(4), np.zeros(4), np.ones(4), math.log(CUT / (1 - CUT)) - 1.0
        if len({y for _, y in x}) < 2:
            return
        f, y = np.array([v for v, _ in x], float), np.array([y for _, y in x], float)
        self.mean, self.scale = f.mean(axis=0), f.std(axis=0) + 1e-6
        g, w, c = (f - self.mean) / self.scale, np.zeros(4), 0.0
        for _ in range(800):  # logistic regression with a small ridge
            p = 1 / (1 + np.exp(-(g @ w + c)))
            w -= 0.5 * (g.T @ (p - y) / len(y) + 0.002 * w)
            c -= 0.5 * (p - y).mean()
        z = g @ w + c
        order = np.argsort(-z, kind="stable")
        hit, zs = np.cumsum(y[order]), z[order]
        last = np.append(zs[1:] < zs[:-1], True)
        f1 = np.where(last, 2 * hit / (np.arange(1, len(y) + 1) + y.sum()), -1)
        k = int(np.argmax(f1))
        line = zs[k] - 0.5 * min(zs[k] - zs[k + 1] if k + 1 < len(zs) else 1.0, 2.0)
        self.weights, self.shift = w, c - line + math.log(CUT / (1 - CUT))

    def scorer(self):
        ct, co = compressor(self.toxic), compressor(self.ordinary)

        def score(text: str) -> float:
            z = float((np.array(features(text, ct, co)) - self.mean) / self.scale @ self.weights) + self.shift
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from a bounded sample of labelled rows that are not held out; only ids are ordered, texts of the chosen are fetched.

    A doc_id with both labels teaches nothing; of the texts that share a doc_id that
    of least hash is taken; texts of over FIT_CHARS characters are not in the sample.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    texts = docs.where(F.length("text") <= FIT_CHARS).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    own = {}
    for y, most in ((1, FIT_TOXIC), (0, FIT_ORDINARY)):
        ids = known.where(F.col("toxic") == y).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x"))  # ``most`` ids at most
        own[y] = [r["text"] for r in sorted(some.select("doc_id", "x.text", F.xxhash64("doc_id").alias("h")).collect(), key=lambda r: (r["h"], r["doc_id"]))]
    return Model(own[1], own[0])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with columns score (0 to 1) and predicted (1 from CUT on) added; a column of that name is replaced.

    Only text is read for the score; a null or empty text has no windows and the
    score of no difference.  Repeated rows are all scored, an empty table gives no
    rows, and other columns pass through.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = next(i for i, c in enumerate(kept) if c.lower() == "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double, predicted int"

    def run(batches):
        score = model.scorer()
        for b in batches:
            s = [score(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= CUT) for x in s], pa.int32())], names=[*b.schema.names, "score", "predicted"])

    return rows.mapInArrow(tidy(run), schema)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns; rows are decided one by one."""
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def keep(batches):
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t or "") < CUT for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)
