"""Full-text search over an inverted index held as DataFrames: BM25, AND/OR queries, dictionary tiers, federated ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75
TERMS_MAX = 24


def postings(docs: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, term, tf, len): one row for each term of each document; positions are not kept."""
    t = docs.select(key, tokens(F.col(text)).alias("_t")).withColumn("len", F.size("_t"))
    return t.select(key, "len", F.explode("_t").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query in order, at most TERMS_MAX; no terms, no result."""
    import re

    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))[:TERMS_MAX]


def _count(term: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == F.lit(term)))


def matches(docs: DataFrame, query: str, require_all: bool = True, key: str = "id", text: str = "content") -> DataFrame:
    """(key, score) by BM25 of the documents that hold all (or any) of the query's terms.

    Only documents' lengths and the tf of the query's terms are computed, in one
    scan and without exploding; the statistics are one row that is joined back.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(key).limit(0).withColumn("score", F.lit(0.0))
    counted = docs.select(key, tokens(F.col(text)).alias("_t")).select(key, F.size("_t").alias("_n"), *[_count(t).alias(f"_f{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_avg"), *[F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(terms))])
    hit = [F.col(f"_f{i}") > 0 for i in range(len(terms))]
    keep = hit[0]
    for h in hit[1:]:
        keep = keep & h if require_all else keep | h
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        score = score + idf * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))
    return counted.where(keep).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))


def top(scored: DataFrame, limit: int, key: str = "id") -> DataFrame:
    return scored.orderBy(F.round("score", 9).desc(), key).limit(limit)


def search_documents(docs: DataFrame, query: str, limit: int = 50, require_all: bool = True) -> DataFrame:
    """(id, title, snippet, score) of live documents (id, title, content, deleted_time), best first."""
    live = docs.where("deleted_time = ''")
    best = top(matches(live, query, require_all), limit)
    first = query_terms(query)[:1] or [""]
    at = F.instr(F.lower("content"), first[0])
    snippet = F.substring("content", F.greatest(at - 20, F.lit(1)), F.lit(80))
    return live.join(F.broadcast(best), "id").select("id", "title", snippet.alias("snippet"), F.round("score", 6).alias("score"))


def search_page(docs: DataFrame, query: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of (id, score, total, has_more) with the total of the same predicate."""
    found = matches(docs.where("deleted_time = ''"), query)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    page = found.orderBy(F.round("score", 9).desc(), "id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).select("id", F.round("score", 6).alias("score"), "total", (F.col("total") > offset + limit).alias("has_more"))


def dictionary_tiers(words: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(id, word, tier, rank) of words (id, word): equal 0.9, beginning 0.8, containing 0.7; shorter first, then by word and id."""
    q = query.strip()
    tier = F.when(F.col("word") == q, 0.9).when(F.col("word").startswith(q), 0.8).otherwise(0.7)
    found = words.where(F.col("word").contains(q)).select("id", "word", tier.alias("tier"))
    order = [F.desc("tier"), F.length("word"), "word", "id"]
    best = found.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def minmax(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """(value - min) / (max - min) in each group; a group of one value has span 1, so 0."""
    w = Window.partitionBy(group)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, (F.col(value) - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo))


def federated(docs: DataFrame, words: DataFrame, phrases: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(source, ref_id, title, rank): documents and phrases by min-max BM25, dictionary by tier, boosts for title and tags, 1 at most."""
    q = query.lower()
    d = docs.where("deleted_time = ''").join(F.broadcast(top(matches(docs.where("deleted_time = ''"), query), limit)), "id").select(F.lit("documents").alias("source"), F.col("id").alias("ref_id"), "title", "tags", "score")
    p = phrases.join(F.broadcast(top(matches(phrases.withColumnRenamed("phrase", "content"), query), limit)), "id").select(F.lit("phrases").alias("source"), F.col("id").alias("ref_id"), F.col("phrase").alias("title"), F.lit("").alias("tags"), "score")
    both = minmax(d.unionByName(p), "source", "score", "base")
    w = dictionary_tiers(words, query, limit).select(F.lit("dictionary").alias("source"), F.col("id").alias("ref_id"), F.col("word").alias("title"), F.lit("").alias("tags"), F.col("tier").alias("base"))
    every = both.select("source", "ref_id", "title", "tags", "base").unionByName(w)
    tag = F.exists(F.filter(F.split("tags", "[,，]"), lambda t: F.trim(t) != ""), lambda t: F.lower(t).contains(q) | F.lit(q).contains(F.lower(t)))
    boost = F.when(F.lower("title").contains(q), 0.15).otherwise(0.0) + F.when(tag, 0.10).otherwise(0.0)
    ranked = every.select("source", "ref_id", "title", F.round(F.least(F.lit(1.0), F.col("base") + boost), 6).alias("rank")).dropDuplicates(["source", "ref_id"])
    return ranked.orderBy(F.desc("rank"), "source", "ref_id").limit(limit)


def paragraphs_relaxed(paras: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, score, relaxed): all terms first, in [0.5, 1]; if they find less than min(limit, 5), any term, in [0, 0.5]."""
    strict = top(matches(paras, query), limit).withColumn("relaxed", F.lit(False))
    n = strict.agg(F.count(F.lit(1)).alias("_n"))
    loose = matches(paras, query, require_all=False).join(strict.select("id"), "id", "left_anti")
    loose = top(loose, limit).withColumn("relaxed", F.lit(True)) if len(query_terms(query)) > 1 else strict.limit(0)
    loose = loose.crossJoin(F.broadcast(n)).where(F.col("_n") < min(limit, 5)).drop("_n")
    every = minmax(strict.unionByName(loose), "relaxed", "score", "base")
    score = F.when(F.col("relaxed"), F.col("base") * 0.5).otherwise(0.5 + F.col("base") * 0.5)
    text = paras.select("id", "content", "kind")
    heading = F.when((F.col("kind") == "heading") & F.lower("content").contains(query.lower()), 0.10).otherwise(0.0)
    long = F.when(F.length("content") > 400, F.least(F.lit(0.10), (F.length("content") - 400) / 2000.0 * 0.10)).otherwise(0.0)
    low, high = F.when(F.col("relaxed"), 0.0).otherwise(0.5), F.when(F.col("relaxed"), 0.5).otherwise(1.0)
    out = text.join(F.broadcast(every.select("id", score.alias("score"), "relaxed")), "id")
    return out.select("id", F.round(F.greatest(low, F.least(high, F.col("score") + heading - long)), 6).alias("score"), "relaxed").orderBy("relaxed", F.desc("score"), "id").limit(limit)


def category_profiles(docs: DataFrame, newest: int = 200) -> DataFrame:
    """(category, term, tf, total) over each category's newest documents; terms of two characters or more that are no numbers."""
    w = Window.partitionBy("category").orderBy(F.desc("id"))
    some = docs.where("deleted_time = ''").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= newest)
    t = some.select("category", F.explode(tokens(F.concat_ws(" ", "title", "content"))).alias("term")).where((F.length("term") >= 2) & ~F.col("term").rlike(r"^\d+$"))
    n = t.groupBy("category", "term").agg(F.count(F.lit(1)).alias("tf"))
    return n.withColumn("total", F.sum("tf").over(Window.partitionBy("category")))


def classify(profiles: DataFrame, text: str, n: int = 3) -> DataFrame:
    """(category, score): sum of qtf * tf / total over the distinct query terms, divided by their number."""
    import re
    from collections import Counter

    q = Counter(x for x in re.findall(r"[^\W_]+", text.lower()) if len(x) >= 2 and not x.isdigit())
    spark = profiles.sparkSession
    terms = spark.createDataFrame(list(q.items()) or [("", 0)], "term string, qtf long")
    s = profiles.join(F.broadcast(terms), "term").groupBy("category").agg((F.sum(F.col("qtf") * F.col("tf") / F.col("total")) / max(1, len(q))).alias("score"))
    return s.where("score > 0").select("category", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "category").limit(n)
