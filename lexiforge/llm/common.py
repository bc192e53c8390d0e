"""What the operators of this subpackage share: input tables, shared storage, spread keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = {i: i + 32 for i in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir(application: str) -> str:
    made = tempfile.mkdtemp(prefix="lexiforge-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that all executors share, as spark.checkpoint.dir names it.

    Only where that is unset, and driver and executors are one process, it is a temporary one of this machine."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return f"{given.rstrip('/')}/lexiforge-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that written() made in this application; results that read them must be stored before."""
    for t in spark.catalog.listTables(pattern="lexiforge_*"):
        spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df, written once as a table in the shared folder and read back: later stages don't recompute it when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """written(), in so many buckets of key: operators that need equal keys together read it without a shuffle.

    Buckets are known to tables alone, so it is an external one of a unique name in the session's catalog."""
    spark, own = df.sparkSession, f"lexiforge_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{own}").saveAsTable(own)
    return spark.table(own)


#: Bytes of text for each partition of a shuffle whose number of partitions must grow with the input.
PARTITION_BYTES = 32 << 20


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: what sizes of buckets and partitions are derived from."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def partitions_for(spark: SparkSession, size: int, each: int = PARTITION_BYTES) -> int:
    """Partitions for so many bytes, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def power_for(size: int, each: int, least: int, most: int) -> int:
    """The power of two from least to most that gives each part so many bytes."""
    return min(most, max(least, 1 << max(0, (-(-size // each) - 1).bit_length())))


#: A key that holds more than this share of all rows is hot, so there are never more hot keys than its inverse.
HOT_SHARE, SALTS = 1000, 32


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], copies: str, spread_by: Column, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and, as copies, the number of left's rows with it; copies is dropped.

    Rows of hot keys are dealt over SALTS tasks by spread_by. The hot keys are broadcast: there are HOT_SHARE at most,
    whatever the input. right is read three times, so it should be written."""
    total = right.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    salt, mark = unused([*left.columns, *right.columns], "salt"), unused([*left.columns, *right.columns], "hot")
    hot = right.filter(F.col(copies) * HOT_SHARE > total).select(*keys, F.lit(True).alias(mark))
    mine = left.join(F.broadcast(hot), keys, "left").withColumn(salt, F.when(F.col(mark), F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop(mark)
    salts = F.when(F.col(copies) * HOT_SHARE > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return mine.join(right.withColumn(salt, F.explode(salts)).drop(copies), [*keys, salt], how).drop(salt)


def unused(columns: list[str], name: str) -> str:
    """name, longer where columns has it already."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def split_words(text: str) -> list[str]:
    """The words of text; as re.findall(WORD, text), but faster."""
    if text.isascii() and not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):
        return text.split()
    for c in SPACES[1:]:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the column as text, modulo modulus; the folds of the contracts."""
    return F.coalesce(F.crc32(column.cast("string")), F.lit(0)) % modulus
