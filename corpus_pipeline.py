"""The corpus pipeline: five stages, each an operator of lathe.llm over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from lathe.llm._common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go; it learns from the documents given here and `labels`.

    Null and empty texts score as the machine's constant and stay; rows that repeat an id or a text are each judged;
    without labels of both classes, or without documents, nothing goes. All columns are kept.
    """
    return toxicity.keep_clean(spark, docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxic"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines with 50 words and more go; n_chars follows the text.

    Documents that lose four fifths of what their distinct lines said go as a whole: they are copies, or near-copies of
    which the next stage would get loose lines only. All others stay, null and empty texts too.
    """
    return line_dedup.keep_rest(spark, docs, Scratch(spark, "lines"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document with the smallest id stays.

    Null texts, texts without words and rows without id are near-copies of nothing and stay, each row of them; of
    rows that repeat a kept id all stay. All columns are kept.
    """
    return ngram_join.keep_one(spark, docs, Scratch(spark, "join"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources by code point, null last, weigh 5, 2, 1 in turn.

    Null and empty texts have size 0 and are taken like the others of their source. All columns are kept.
    """
    return mixing.mix_documents(docs, Scratch(spark, "mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the decoded text, a row for a row; null texts have no tokens."""
    return bpe.digest_documents(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]
#: SQL can't express a trained model nor BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written to the shared folder and read again by the next.

    What a stage has read is deleted when its own result is written.
    """
    scratch = Scratch(spark, "pipeline")
    docs = source = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = scratch.put(stage(spark, docs, sf_dir))
        if docs is not source:
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
