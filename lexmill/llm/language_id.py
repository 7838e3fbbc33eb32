"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained by follow-the-regularised-leader with an elastic-net
penalty, then the scores' temperature is calibrated on documents kept out of
training.  Document frequencies are counted over all rows that may be learned
from; the regression is fitted on a bounded sample of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch

#: n-gram orders, hashed features.
ORDERS, FEATURES = (1, 2, 3), 1 << 15
#: The regression's sample: documents of each language (a fifth of them calibrates), rows in all, characters of a document.
FIT_DOCS, FIT_ROWS, FIT_CHARS = 400, 200_000, 50_000
#: FTRL: learning rate, smoothing, L1, L2, passes.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.0005, 0.00001, 3
UNKNOWN = "und"


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased text and how often each occurs."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts, h = [], np.zeros(len(c), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(c) - n + 1] * np.uint64(1_000_003) + c[n - 1 :] + np.uint64(n)
            if n in ORDERS and len(h):
                parts.append((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64))
    if len(c) < FEATURES // 4:
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        return at, n
    n = np.bincount(np.concatenate(parts), minlength=FEATURES)
    at = np.flatnonzero(n)
    return at, n[at]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = term_counts(text)
    x = (1 + np.log(n)) * idf[at]
    return at, x / (math.sqrt(float(x @ x)) or 1.0)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over the whole table; what reaches the driver has the feature space's size."""
    schema = pa.schema([("feature", pa.int32()), ("n", pa.int64())])

    def run(batches):
        df, docs = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df[term_counts(t)[0]] += 1
                docs += 1
        at = np.flatnonzero(df)
        yield batch(schema, np.append(at, -1).astype(np.int32), np.append(df[at], docs))

    df, docs = np.zeros(FEATURES, np.int64), 0
    for r in texts.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r["feature"] < 0:
            docs = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return df, docs


class Model:
    """Languages, idf, weights (one row a language), biases and temperature."""

    def __init__(self, idf: np.ndarray, samples: list[tuple[str, str]]):
        self.idf, self.languages = idf, sorted({y for _, y in samples})
        k = len(self.languages)
        name = {y: i for i, y in enumerate(self.languages)}
        data = [(*vector(t, idf), name[y]) for t, y in samples]
        learn, check = [x for i, x in enumerate(data) if i % 5 != 4], [x for i, x in enumerate(data) if i % 5 == 4]
        z, n = np.zeros((k, FEATURES + 1)), np.zeros((k, FEATURES + 1))
        rng = np.random.default_rng(11)

        def weights(at):
            zz, nn = z[:, at], n[:, at]
            return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

        for _ in range(PASSES if k > 1 else 0):
            for i in rng.permutation(len(learn)):
                at, x, y = learn[i]
                at, x = np.append(at, FEATURES), np.append(x, 0.1)  # the last feature is the bias
                w = weights(at)
                s = w @ x
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y] -= 1
                g = p[:, None] * x
                nn = n[:, at]
                z[:, at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / ALPHA * w
                n[:, at] = nn + g * g
        self.weights = weights(np.arange(FEATURES + 1))
        self.temperature = self._calibrated([(self.logits(at, x), y) for at, x, y in check]) if k > 1 and check else 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ x + 0.1 * self.weights[:, FEATURES]

    @staticmethod
    def _calibrated(pairs) -> float:
        """The temperature of least negative log-likelihood, by golden section over its logarithm."""
        s, y = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])

        def loss(log_t):
            v = s / math.exp(log_t)
            v = v - v.max(axis=1, keepdims=True)
            return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(y)), y]).mean())

        a, b, r = -4.0, 3.0, (math.sqrt(5) - 1) / 2
        for _ in range(40):
            c, d = b - r * (b - a), a + r * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        return math.exp((a + b) / 2)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        v = self.logits(*vector(text, self.idf)) / self.temperature
        v = np.exp(v - v.max())
        i = int(np.argmax(v))
        return self.languages[i], float(v[i] / v.sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """The model from docs (doc_id, text, lang) that are not held out and have text and lang.

    The sample has FIT_DOCS rows of each language (fewer where the languages would
    make more than FIT_ROWS), those of the smallest id hashes of the texts of at most
    FIT_CHARS characters; ids are ranked alone, each task keeping its own best before
    the shuffle.  Of rows that share id and language the text of least hash is taken.
    """
    known = docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    df, n = document_frequencies(known.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    from pyspark.sql import Window

    some = known.where(F.length("text") <= FIT_CHARS)
    most = max(1, min(FIT_DOCS, FIT_ROWS // max(1, some.select("lang").distinct().count())))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = some.select("doc_id", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"))
    rows = some.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("lang") == F.col("_l")))  # FIT_ROWS ids at most
    rows = rows.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("doc_id", "lang", "x.text", F.xxhash64("doc_id").alias("h"))
    sample = sorted(rows.collect(), key=lambda r: (r["h"], r["doc_id"] is None, r["doc_id"] or 0, r["lang"]))
    return Model(idf, [(r["text"], r["lang"]) for r in sample if has_letter(r["text"])])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text of docs (doc_id, text).

    A text that is null or has no letter is ``und`` with score 0; with nothing to
    learn from every text is.  Repeated rows are all predicted; an empty table
    gives no rows; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            out = [model.predict(t) for t in b.column(1).to_pylist()]
            yield batch(schema, b.column(0), [x for x, _ in out], [s for _, s in out])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
