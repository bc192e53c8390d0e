"""Sharding along a Hilbert curve over document metadata.

Size, source and language are quantised to a byte each; the Hilbert index of that cell orders the rows, and the
order is cut into runs of equal row counts. Neighbouring rows share narrow ranges of every dimension, so a reader
that filters on any of them skips most files. Equal texts take the metadata of their first row (smallest doc_id) and
so lie side by side.

hilbert_shards() tells each row its place; write_shards() writes the rows themselves, a sorted file for each run, so that
the files' own ranges of every dimension prune them, and returns these ranges.

Law: ``rows``, shard sizes differ by one row at most. Defined results: a null text counts no bytes; nulls in any
dimension are a value of their own; rows are placed each for itself, equal ones side by side; an empty input gives no
rows and no files; extra columns are left out (write_shards() keeps all of them, whatever their names).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import spread_join, unused, written

BITS = 8


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of cells (n rows, d dimensions of so many bits), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn ^= np.where(x[d - 1] & q, q - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@F.pandas_udf(LongType())
def curve_of(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()], 1)))


def content_of(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def curve_order(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, content, curve, and the row's place: its range partition and its number there; written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), content_of(F.col("text")).alias("content"), "source", "lang")
    # Equal texts: the metadata of one row stand for all. Only texts of several rows need that.
    heads = rows.groupBy("content").agg(F.min(F.struct("doc_id", "source", "lang")).alias("head"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    own = F.coalesce("head", F.struct("doc_id", "source", "lang"))
    bucket = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(F.crc32(c) % 255 + 1).cast("int")
    scale = F.least(F.lit(255), (F.log2(F.col("size").cast("double")) * 8).cast("int"))
    cells = spread_join(rows, written(heads, "heads"), ["content"], "copies", F.struct("doc_id", "source", "lang"), "left").withColumn("own", own)
    cells = cells.select("doc_id", "size", "text_crc32", "content", curve_of(scale, bucket(F.col("own.source")), bucket(F.col("own.lang"))).alias("curve"))
    order = ["curve", "content", "doc_id"]
    placed = cells.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    # Such an id is the partition's number and, in its lower 33 bits, the row's number there.
    return written(placed.select("*", F.shiftright("id", 33).cast("int").alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("at")).drop("id"), "curve")


def positions(docs: DataFrame) -> tuple[DataFrame, int]:
    """curve_order() with each row's position on the curve, and the number of rows."""
    spark, placed = docs.sparkSession, curve_order(docs)
    total, firsts = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):  # a row a partition
        firsts.append((part, total))
        total += n
    rows = placed.join(F.broadcast(spark.createDataFrame(firsts, "part int, first long")), "part")
    return rows.withColumn("position", F.col("first") + F.col("at")).drop("first", "part", "at"), total


def hilbert_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    rows, total = positions(docs)
    rows = rows.withColumn("shard", F.expr(f"cast(position * {shards} div {max(total, 1)} as int)"))
    slot = F.col("position") - F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> DataFrame:
    """Writes all columns of docs as one sorted Parquet file for each run of the curve (in folders by shard); returns, written beside
    them, shard, rows, and the least and greatest size, source, lang and curve of each, by which a reader skips files."""
    rows, total = positions(docs)
    columns = docs.columns
    # Rows equal in doc_id and text are told apart by their number, so that each takes one of their positions.
    content, place, n, shard, slot, curve = (unused(columns, x) for x in ("content", "place", "n", "shard", "slot", "curve"))
    by = Window.partitionBy("doc_id", "content").orderBy("position")
    at = rows.withColumn("n", F.row_number().over(by)).select(F.col("doc_id").alias("of_id"), F.col("content").alias(content), F.col("n").alias(n), F.col("position").alias(place), F.col("curve").alias(curve))
    mine = docs.withColumn(content, content_of(F.col("text")))
    mine = mine.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", content).orderBy("source", "lang")))
    both = mine.alias("m").join(at.alias("a"), mine["doc_id"].eqNullSafe(at["of_id"]) & (mine[content] == at[content]) & (mine[n] == at[n]))
    both = both.select(*[F.col(f"m.`{c}`") for c in columns], F.col(f"a.`{place}`"), F.col(f"a.`{curve}`"))
    both = both.withColumn(shard, F.expr(f"cast(`{place}` * {shards} div {max(total, 1)} as int)"))
    files = both.repartitionByRange(shards, F.col(shard)).sortWithinPartitions(place)
    files.drop(place).withColumnRenamed(shard, "shard" if "shard" not in columns else shard).write.partitionBy("shard" if "shard" not in columns else shard).parquet(f"{path}/rows")
    spans = [f(c).alias(f"{name}_{c}") for c in ("source", "lang") for name, f in (("least", F.min), ("greatest", F.max))]
    sizes = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1
    both.groupBy(F.col(shard).alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.min(sizes).alias("least_size"), F.max(sizes).alias("greatest_size"), *spans, F.min(curve).alias("least_curve"), F.max(curve).alias("greatest_curve")).write.parquet(f"{path}/ranges")
    return docs.sparkSession.read.parquet(f"{path}/ranges")
