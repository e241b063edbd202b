"""From raw documents to a clean, tokenised corpus: the stages run one after the other.

Each stage takes (spark, docs, sf_dir), where docs is the whole result of the stage before it, and all
but the last return the columns of documents, whatever these are named: operators get doc_id, text and one
column that holds all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, lines, neardup, quality
from quarry.llm.common import materialize, read

REST = "_rest"


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns in one."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("_there"), *others).alias(REST))


def unpacked(df: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns as they were, but for those that ``changed`` gives."""
    changed = {k: v for k, v in (changed or {}).items() if k in columns}
    rest = [c for c in columns if c not in ("doc_id", "text")]
    own = {c: changed.get(c, F.col(REST).getField(c)) for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return df.select(*[own[c].alias(c) for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold go. The model learns from the labels of the table.

    Null and empty texts are scored like any other, repeated rows stay or go together, rows without an id are
    scored, and an empty table stays empty.
    """
    scored = quality.score(packed(docs), read(spark, sf_dir, "labels"))
    return unpacked(scored.where(F.col("score") >= quality.THRESHOLD), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but one; every document stays, n_chars follows its text.

    A null text becomes an empty one; rows of equal or no id are one document (see lines.dedup_lines).
    """
    return unpacked(lines.dedup_lines(packed(docs)), docs.columns, {"n_chars": F.length("text").cast("long")})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are alike in 0.8 of their five-word runs stays: the one of the
    smallest doc_id. Null and empty texts are alike, of repeated rows one stays (see neardup.one_of_each)."""
    return unpacked(neardup.one_of_each(packed(docs)), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay."""
    hits = decontaminate.contamination(packed(docs), read(spark, sf_dir, "benchmark"))
    return unpacked(hits.where(F.col("hits.n_hit") == 0), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document; a null or empty text has none."""
    return bpe.encode(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: Not expressible in SQL: a trained classifier, fingerprints and tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
