"""The corpus store: selections, trees, aggregates, set operations and copy-on-write changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(docs: DataFrame) -> DataFrame:
    return docs.where("deleted_time = ''")


def list_documents(docs: DataFrame, order: str = "newest") -> DataFrame:
    keys = {"title": [F.asc("title"), F.asc("id")], "words": [F.desc("word_count"), F.asc("id")], "newest": [F.desc("id")]}[order]
    return live(docs).orderBy(*keys)


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, node): every node of (id, parent_id) under itself and all its ancestors, by semi-naive iteration over the tree's depth."""
    step = tree.select(F.col("id").alias("node"), F.col("id").alias("ancestor"))
    parents = tree.select(F.col("id").alias("_i"), F.col("parent_id").alias("_p"))
    out = step
    for _ in range(32):
        step = step.join(parents, F.col("ancestor") == F.col("_i")).where("_p <> 0").select("node", F.col("_p").alias("ancestor"))
        if step.isEmpty():
            break
        out = out.union(step)
    return out.select("ancestor", "node")


def tree_rollup(tree: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, own, total) of documents per category and with all below it; id 0 counts all live documents, those of no category too."""
    own = live(docs).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    by = closure(tree).join(own, F.col("node") == F.col("category_id"), "left").groupBy("ancestor").agg(F.sum(F.coalesce("n", F.lit(0))).alias("total"), F.sum(F.when(F.col("ancestor") == F.col("node"), F.coalesce("n", F.lit(0))).otherwise(0)).alias("own"))
    every = live(docs).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("category_id") == 0, 1)).alias("own"))
    return by.select(F.col("ancestor").alias("id"), "own", "total").union(every.select(F.lit(0).cast("long"), "own", "total"))


def keep_last(rows: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def add_documents(existing: DataFrame, new: DataFrame) -> DataFrame:
    """new (id, text_hash) with the action: duplicate of a live one, restore of a trashed one, repeat within the batch, or insert."""
    old = existing.groupBy("text_hash").agg(F.min_by("id", F.struct(F.col("deleted_time") != "", "id")).alias("old_id"), F.max(F.col("deleted_time") == "").alias("is_live"))
    first = F.row_number().over(Window.partitionBy("text_hash").orderBy("id")) == 1
    j = new.join(old, "text_hash", "left").withColumn("_first", first)
    action = F.when(F.col("is_live"), "duplicate").when(~F.col("_first"), "duplicate").when(F.col("old_id").isNotNull(), "restore").otherwise("insert")
    return j.select("id", "text_hash", action.alias("action"), F.when(action == "restore", F.col("old_id")).alias("restored_id"))


def index_changes(docs: DataFrame, state: DataFrame) -> DataFrame:
    """(id, action): index new or changed content by hash, drop what is indexed and no longer live; unchanged rows are not in it."""
    j = docs.select("id", "text_hash").join(state.select(F.col("ref_id").alias("id"), F.col("text_hash").alias("old_hash")), "id", "full_outer")
    action = F.when(F.col("text_hash").isNull(), "drop").when(F.col("old_hash").isNull(), "add").when(~F.col("text_hash").eqNullSafe(F.col("old_hash")), "refresh")
    return j.select("id", action.alias("action")).where("action is not null")


def merge_wordlist(existing: DataFrame, entries: DataFrame) -> DataFrame:
    """entries (line, wrong, correct, confidence) with the change: skip (repeat in the batch or as it is), overwrite, conflict or add."""
    same = existing.select("wrong", "correct", F.col("confidence").alias("old_confidence"))
    other = existing.groupBy("wrong").agg(F.count(F.lit(1)).alias("others"))
    repeat = F.row_number().over(Window.partitionBy("wrong", "correct").orderBy("line")) > 1
    j = entries.withColumn("_repeat", repeat).join(same, ["wrong", "correct"], "left").join(other, "wrong", "left")
    change = F.when(F.col("_repeat"), "skip").when(F.col("old_confidence") == F.col("confidence"), "skip").when(F.col("old_confidence").isNotNull(), "overwrite").when(F.col("others") > 0, "conflict").otherwise("add")
    return j.select("line", "wrong", "correct", change.alias("change"))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Upsert: the last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def manifest(docs: DataFrame) -> DataFrame:
    """(id, name, bytes, sha256) of the package entries; equal names get _2, _3, ..."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    body = F.col("content").cast("binary")
    return docs.select("id", "name", F.octet_length("content").cast("long").alias("bytes"), F.sha2(body, 256).alias("sha256")).withColumn("_n", n).select("id", F.when(F.col("_n") > 1, F.concat("name", F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col("name")).alias("name"), "bytes", "sha256")


def verify(manifest_: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, problem) by comparing manifest and content: missing, unlisted, length, digest."""
    a = actual.select("name", F.col("bytes").alias("b2"), F.col("sha256").alias("s2"))
    j = manifest_.select("name", "bytes", "sha256").join(a, "name", "full_outer")
    problem = F.when(F.col("s2").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("bytes") != F.col("b2"), "length").when(F.col("sha256") != F.col("s2"), "digest")
    return j.select("name", problem.alias("problem")).where("problem is not null")


def like_any(column: str, keyword: str) -> Column:
    """column LIKE %keyword%, in which the keyword's own wildcards and escapes are plain characters."""
    for c in ("\\", "%", "_"):
        keyword = keyword.replace(c, "\\" + c)
    return F.col(column).like(f"%{keyword}%")
