"""The registered queries of this subpackage with production parameters; oracles.py has the SQL of some."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, hilbert, lattice_lm, line_quality, ngram_join, piece_table, repair_files, token_counts, toxicity, vamana
from .common import shared_dir, table
from .oracles import ORACLES as ORACLES


@cache
def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is a new one each time, so that the query's figures are those of a cold cache."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_files.read_token_files(repair_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.encode_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_vamana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.nearest(table(spark, sf_dir, "embeddings"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_token_counts, op3_token_files, op4_sentencepiece, op5_line_quality, op6_vamana, op7_lattice_lm, op8_hilbert_shards, op9_packing, op10_toxicity)}
