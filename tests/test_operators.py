"""Operators that SQL can't express: fixtures, properties and round trips."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import analysis as A
from lexiforge.operators import chunking as C
from lexiforge.operators import providers
from lexiforge.operators import retrieval as R
from lexiforge.sources import readers
from lexiforge.streaming import dedup


def test_stems(spark):
    words = ["nations", "running", "used", "cat", "договорами", "акты"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(A.stem(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["nation", "runn", "used", "cat", "договор", "акт"]


def test_index_round_trip(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = R.build_index(docs)
    index.save(str(tmp_path))
    query = "of the and that"
    assert R.hybrid_search(docs, query, index=R.LexicalIndex.load(spark, str(tmp_path))).collect() == R.hybrid_search(docs, query, index=index).collect()


def test_mmr_without_diversity_is_top_k(spark):
    pool = spark.sql("select array(named_struct('id', 1L, 'score', 3d, 'words', array('a')), named_struct('id', 2L, 'score', 2d, 'words', array('a')), named_struct('id', 3L, 'score', 1d, 'words', array('b'))) as p")
    assert pool.select(R.mmr(F.col("p"), 2, 1.0).alias("x")).first()["x"] == [1, 2]
    assert pool.select(R.mmr(F.col("p"), 2, 0.3).alias("x")).first()["x"] == [1, 3]


def test_fusion(spark):
    rows = R.fused(spark.createDataFrame([(1, 1.0, 0.0), (2, 0.5, 4.0)], "doc_id int, cos double, bm double")).orderBy("doc_id").collect()
    assert [round(r["score"], 6) for r in rows] == [0.65, 0.675]


def test_windows_cover_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select(A.strip(F.col("text")).alias("t"), C.windows(F.col("text"), overlap=0).alias("w")).filter(F.length("t") > 20).collect()
    for r in rows:
        assert all(20 <= len(w) <= 1600 for w in r["w"])
        assert len("".join("".join(r["w"]).split())) >= len("".join(r["t"].split())) - 20


def test_packers_keep_the_limit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert docs.select(F.explode(C.messages(F.col("text"), 500)).alias("m")).filter(F.length("m") > 500).isEmpty()


def test_highlights(spark):
    row = spark.createDataFrame([("x" * 300 + " needle " + "y" * 300,)], "t string").select(R.highlights(F.col("t"), ["needle"]).alias("h"), R.highlights(F.col("t"), ["zz"]).alias("n")).first()
    assert len(row["h"]) == 1 and "needle" in row["h"][0] and len(row["h"][0]) == 246
    assert len(row["n"][0]) == 240


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("привет".encode("cp1251"))
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.doc").write_bytes(b"?")
    rows = {r["path"][-5:]: (r["text"], r["error"]) for r in readers.documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"] == ("привет", None) and rows[".docx"] == ("one\ntwo", None) and "unsupported" in rows["c.doc"][1]


def test_sheet_takes_the_first_filled_candidate(spark, tmp_path):
    (tmp_path / "e.csv").write_text(" , \n")
    (tmp_path / "f.csv").write_text("h1,h2\na,b\nc,d\n")
    rows = readers.sheet(spark, [str(tmp_path / x) for x in ("none.csv", "e.csv", "f.csv")], 2)
    assert [r["cells"] for r in rows.orderBy("row_no").collect()] == [["a", "b"], ["c", "d"]]
    assert readers.sheet(spark, []).isEmpty()


def test_providers(spark):
    rows = providers.embedded(spark.createDataFrame([(1, "a b"), (2, "")], "chunk_id long, text string")).collect()
    assert abs(sum(x * x for x in rows[0]["embedding"]) - 1) < 1e-6 and not any(rows[1]["embedding"])
    assert providers.answered(spark.createDataFrame([(1, "One. Two")], "id long, prompt string")).first()["answer"] == "One"
    calls = []
    with pytest.raises(ValueError):
        providers.retrying(lambda: calls.append(1) or int("x"), 3, sleep=lambda s: None)()
    assert len(calls) == 3


def test_streams_equal_batches(spark, tmp_path):
    from lexiforge.operators import records

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    done = dedup.ttl_accepted(stream, "user_id", 86400.0).writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    done.awaitTermination()
    want = records.ttl_accepted(events, "user_id", 86400.0).filter("accepted").select("event_id")
    assert {r[0] for r in spark.table("accepted").select("event_id").collect()} == {r[0] for r in want.collect()}
    done = dedup.usage_by_day(stream).writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    done.awaitTermination()
    assert {tuple(r) for r in spark.table("usage").collect()} == {tuple(r) for r in records.usage_daily(events).collect()}
