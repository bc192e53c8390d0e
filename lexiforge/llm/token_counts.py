"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, n_tokens, tokenizer_digest) in shared storage, with a folder for each
tokenizer version, so that counts of others aren't read. Texts are normalised only by what the tokenizer ignores (ASCII
case and runs of ASCII white space), digested, and joined to the cache; each distinct missing text is encoded once and
appended. A second run over the same texts encodes nothing.

Defined results: a null or empty text has 0 tokens and 0 bytes; rows with equal or null doc_id are counted each for
itself (the join is on the text's digest); extra columns of the input are left out; an empty input gives no rows.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, spread_join, written
from .token_codec import codec, version_of

CACHE_SCHEMA = "content_digest binary, n_tokens long, tokenizer_digest string"


def normalised(text, lower: bool, special: list[str]):
    """text as the tokenizer sees it: white space runs are one blank; ASCII lower case if it ignores case.

    A special token's string is matched as it stands, before case is dropped, so texts that hold one in any case stay as they are."""
    text = F.coalesce(text, F.lit(""))
    if not lower:
        return text
    plain = F.regexp_replace(ascii_lower(text), r"[ \t\n\r]+", " ")
    return F.when(reduce(lambda x, s: x | F.contains(plain, F.lit(" ".join(s.lower().split(" ")))), special, F.lit(False)), text).otherwise(plain)


def cached_counts(spark, cache_path: str) -> DataFrame:
    """The stored counts; an empty table where the cache doesn't exist yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs; appends what the cache lacked."""
    spark, version = docs.sparkSession, version_of(tokenizer_path)
    own = codec(tokenizer_path)
    content = normalised(F.col("text"), own.words, own.special)
    digest = F.unhex(F.sha2("content", 256)).alias("content_digest")
    rows = written(docs.select("doc_id", content.alias("content"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).select("doc_id", "n_bytes", digest), "digests")
    known = cached_counts(spark, cache_path).filter(F.col("tokenizer_digest") == version)
    # Copies become one before they are shuffled, so a text that many rows share is no hot key.
    texts = docs.select(content.alias("content")).select(digest, "content").groupBy("content_digest").agg(F.first("content").alias("content"))
    misses = texts.join(known.select("content_digest"), "content_digest", "left_anti")

    def count(batches):
        packed = codec(tokenizer_path).packed_all
        for b in batches:
            n = [len(ids) // 4 for ids in packed(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([version] * len(n), pa.string())], ["content_digest", "n_tokens", "tokenizer_digest"])

    misses.mapInArrow(count, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    # Two runs at once may both have appended a text: one row of each digest counts.
    stored = cached_counts(spark, cache_path).filter(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    copies = rows.groupBy("content_digest").agg(F.count(F.lit(1)).alias("copies"))
    counts = written(copies.join(stored, "content_digest"), "counts")
    return spread_join(rows, counts, ["content_digest"], "copies", F.struct("doc_id", "n_bytes"), "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
