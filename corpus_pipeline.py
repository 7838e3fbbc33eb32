"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Toxic documents go; of each group of near copies the smallest doc_id stays; leaks
of benchmark items go; secrets are masked; what is left is packed.  Every stage
keeps all other rows and, but for the last, the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import read_table, shared_dir
from lexmill.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model (fitted on the stage's labelled rows) rejects."""
    from lexmill.llm.toxicity import fit, without_toxic

    return without_toxic(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked documents, that of the least doc_id; rows are decided, not ids."""
    from lexmill.llm.jaccard_join import one_of_each

    return one_of_each(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an exact, edited or paraphrased copy of a benchmark item."""
    from lexmill.llm.decontamination import without_leaks

    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets; n_chars follows the text where it changed, other columns stay."""
    from lexmill.llm.secret_scan import fit, labelled_findings, scan

    found = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"), fit(labelled_findings(spark)))
    changed = ~F.col("masked").eqNullSafe(F.col("text"))
    new = {"text": F.col("masked"), "n_chars": F.when(changed, F.length("masked").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if new.get(c) is not None else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of 2048 tokens."""
    from lexmill.llm.packing import best_fit_packing

    return best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"), end_id=0, size=2048)


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("decontamination", decontaminate), ("secrets", secrets), ("packing", packing)]

#: No SQL: the toxicity model, the alignment and the tokenizer have none; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
