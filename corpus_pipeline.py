"""The corpus pipeline: quality rules, toxicity, near duplicates, packing. Each stage reads what the one before kept.

Defined results, of every stage: an empty table gives no rows; a null text counts as an empty one, and null hosts are one host; rows
are judged each for itself, also with equal or null doc_id; extra columns stay as they are, whatever their names, in all
stages but the last, whose columns are those of op9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm import best_fit, line_quality, ngram_join, toxicity
from lexiforge.llm.common import table, written
from lexiforge.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (those of few words, null and empty texts among them, and depleted ones), and so do boilerplate lines of the others."""
    return line_quality.apply_quality(docs)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Labels that are null or of no document are left out; without labels of both kinds none goes."""
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id (null last); rows equal in id and text are one."""
    return ngram_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences; long documents in pieces."""
    return best_fit.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [("quality_rules", quality), ("toxicity", harmless), ("ngram_join", one_of_each), ("packing", packed)]

#: SQL can't express the second stage's model nor the last one's search; tests/llm hold run() and its stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again for the next stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
