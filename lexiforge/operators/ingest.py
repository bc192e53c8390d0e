"""The ingest chain over stored tables: sanitise, section, cap, embed, append, register; delete, rebuild, search.

A store is a folder with chunks and vectors, which only grow, and registries, one for each change (S9, S11). A chunk counts if
the newest registry names its id; so a change shows at once when its registry is written, a failed one never does, and deleting
documents writes a registry and no chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import chunking, records, retrieval
from lexiforge.operators.providers import embedded, hashed_embedding
from lexiforge.sources.store import shared_dir, stored

CHUNKS = "chunk_id long, hash string, doc_name string, chunk_idx int, section_title_raw string, section_number string, chunk_index_in_section int, text string"
VECTORS = "chunk_id long, embedding array<float>"
REGISTRY = "hash string, fname string, time long, chunks array<long>"
MOST_CHUNKS = 300


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _table(self, name: str, schema: str) -> DataFrame:
        fs, path = self._fs(name)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def version(self) -> int:
        """The newest registry that was written whole; 0 in a new store."""
        fs, path = self._fs("registries")
        found = [int(f.getPath().getName()) for f in fs.listStatus(path)] if fs.exists(path) else []
        return max([n for n in found if fs.exists(self._fs(f"registries/{n}/_SUCCESS")[1])], default=0)

    def registry(self) -> DataFrame:
        """hash, fname, time, chunks (ids) of the documents in the store."""
        n = self.version()
        return self._table(f"registries/{n}", REGISTRY) if n else self.spark.createDataFrame([], REGISTRY)

    def register(self, rows: DataFrame) -> None:
        rows.select("hash", "fname", "time", "chunks").write.parquet(f"{self.path}/registries/{self.version() + 1}")

    def _ids(self) -> DataFrame:
        return self.registry().select(F.explode("chunks").alias("chunk_id"))

    def chunks(self) -> DataFrame:
        """Chunks with their metadata."""
        return self._table("chunks", CHUNKS).join(self._ids(), "chunk_id", "left_semi")

    def vectors(self) -> DataFrame:
        """chunk_id and embedding; of several of a chunk (M3) the newest batch's."""
        rows = self._table("vectors", VECTORS + ", batch long")
        return rows.join(self._ids(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max_by("embedding", "batch").alias("embedding"))


def document_chunks(docs: DataFrame, cap: int = MOST_CHUNKS) -> DataFrame:
    """M1 up to the embedding: hash, doc_name, chunk_idx, section metadata and text, for docs (hash, fname, text).

    The sanitised texts are stored on the way: with their function in the plan, sections would be computed again for each chunk."""
    clean = docs.select(F.struct("hash", "fname").alias("doc_id"), T.index_text(F.col("text")).alias("text"))
    clean = stored(clean, f"{shared_dir(docs.sparkSession)}/sanitised-{uuid.uuid4().hex}")
    rows = chunking.section_chunks(clean, cap=cap)
    return rows.select("doc_id.hash", F.col("doc_id.fname").alias("doc_name"), "chunk_idx", "section_title_raw", "section_number", "chunk_index_in_section", F.col("chunk").alias("text"))


def _numbered(rows: DataFrame, first: int, path: str) -> DataFrame:
    """rows with chunk_id from first on, in order of hash and chunk_idx, without holes.

    The rows are stored at path with their places before these are counted: a plan run twice may be dealt into other partitions."""
    ordered = rows.repartitionByRange("hash", "chunk_idx").sortWithinPartitions("hash", "chunk_idx").withColumn("at", F.monotonically_increasing_id())
    ordered = stored(ordered, path).withColumn("part", F.shiftright("at", 33))
    starts = []
    for part, n in sorted(map(tuple, ordered.groupBy("part").count().collect())):  # a row a partition
        starts.append((part, first))
        first += n
    starts = rows.sparkSession.createDataFrame(starts, "part long, start long")
    return ordered.join(F.broadcast(starts), "part").withColumn("chunk_id", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "at", "start")


def index_documents(store: Store, docs: DataFrame, time: int, embed: Callable = hashed_embedding) -> DataFrame:
    """Appends docs (hash, fname, text) that the store hasn't (J8, M7); hash and added of each of these.

    A chunk whose vector is empty or not finite is left out (P9). Vectors of another dimension than the new ones' stay in their
    table but are no candidates (M2), until rebuild_vectors()."""
    spark = store.spark
    new = docs.groupBy("hash").agg(F.min_by("fname", "fname").alias("fname"), F.min_by("text", "fname").alias("text")).join(store.registry().select("hash"), "hash", "left_anti")
    batch = f"{store.path}/work/{uuid.uuid4().hex}"
    document_chunks(new).write.parquet(f"{batch}/cut")
    first = store._table("chunks", CHUNKS).agg(F.coalesce(F.max("chunk_id") + 1, F.lit(0))).first()[0]
    _numbered(spark.read.parquet(f"{batch}/cut"), first, f"{batch}/ordered").write.parquet(f"{batch}/numbered")
    numbered = spark.read.parquet(f"{batch}/numbered")
    embedded(numbered, embed).filter(retrieval.valid_vector(F.col("embedding"))).withColumn("batch", F.lit(store.version() + 1).cast("long")).write.parquet(f"{batch}/vectors")
    vectors = spark.read.parquet(f"{batch}/vectors")
    good = numbered.join(vectors.select("chunk_id"), "chunk_id", "left_semi")
    good.select([c.split()[0] for c in CHUNKS.split(", ")]).write.mode("append").parquet(f"{store.path}/chunks")
    vectors.write.mode("append").parquet(f"{store.path}/vectors")
    ids = good.groupBy("hash").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks"))
    empty = F.array().cast("array<long>")
    rows = new.select("hash", "fname", F.lit(time).cast("long").alias("time")).join(ids, "hash", "left").withColumn("chunks", F.coalesce("chunks", empty))
    rows.write.parquet(f"{batch}/registered")
    rows = spark.read.parquet(f"{batch}/registered")
    store.register(records.registry_upsert(store.registry(), rows))
    return rows.select("hash", F.size("chunks").alias("added"))


def delete_documents(store: Store, hashes: DataFrame) -> None:
    """Hashes (hash) leave the registry."""
    store.register(store.registry().join(hashes.select("hash").distinct(), "hash", "left_anti"))


def rebuild_vectors(store: Store, embed: Callable) -> None:
    """M3: the vectors of all chunks anew; the next registry makes them the ones that count."""
    n = store.version() + 1
    embedded(store.chunks(), embed).filter(retrieval.valid_vector(F.col("embedding"))).withColumn("batch", F.lit(n).cast("long")).write.mode("append").parquet(f"{store.path}/vectors")
    store.register(store.registry())


def retrieve(store: Store, query: str, k: int = 6, embed: Callable = hashed_embedding) -> DataFrame:
    """Rank, chunk_id, score, doc_name, section_title_raw and text of the k chunks nearest to the query."""
    q = embed(query)
    asked = store.spark.createDataFrame([(0, q)], "query_id long, q array<float>")
    vectors = store.vectors().filter(F.size("embedding") == len(q)).withColumnRenamed("chunk_id", "vec_id")
    best = retrieval.knn(vectors, asked, max(1, k)).select("rank", F.col("vec_id").alias("chunk_id"), "score")
    return store.chunks().join(F.broadcast(best), "chunk_id").select("rank", "chunk_id", "score", "doc_name", "section_title_raw", "text")


def dump_texts(docs: DataFrame, path: str) -> None:
    """The raw texts before they are indexed, in a folder for each document (name and eight digits of its hash)."""
    docs.select(F.concat_ws("_", T.safe_name(F.col("fname")), F.left("hash", F.lit(8))).alias("name"), F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("name").text(path)


def compare_last(docs: DataFrame, session: str, order: str) -> DataFrame:
    """The sentences by which the last two documents (doc_id, text) of each session differ by more than case and marks."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(session).orderBy(F.col(order).desc()))
    last = docs.select(session, order, "text", n.alias("n")).filter("n <= 2")
    pairs = last.groupBy(session).agg(F.max(order).alias("id"), F.max(F.when(F.col("n") == 2, F.col("text"))).alias("text_a"), F.max(F.when(F.col("n") == 1, F.col("text"))).alias("text_b")).filter("text_a is not null and text_b is not null")
    return chunking.aligned(pairs).filter(chunking.semantically_different(F.col("original"), F.col("recognized")))
