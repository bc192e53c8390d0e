"""The ingest chain, typed splitting, the adaptive chunker and the mended operators on small fixtures by hand."""

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import chunking as C
from lexiforge.operators import ingest, records
from lexiforge.plans.text_queries import CONTRACT
from lexiforge.sources import readers


def test_store(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "s"))
    body = "\n".join(["1. Title of one", "Alpha beta gamma delta sentence. " * 80, "2. Title of two", "A short text of the second section."])
    docs = spark.createDataFrame([("h1", "a.txt", body), ("h2", "b.txt", "Only one plain sentence here about kittens, in the longest line of the table, which is no header since it has more than the characters a title may hold."), ("h3", "c.txt", None), ("h1", "copy.txt", body)], "hash string, fname string, text string")
    added = {r["hash"]: r["added"] for r in ingest.index_documents(store, docs, 5).collect()}
    assert added == {"h1": len(C.cut_windows("Alpha beta gamma delta sentence. " * 80)), "h2": 1, "h3": 0}  # the last line is a header too
    assert ingest.index_documents(store, docs, 6).isEmpty()  # all known
    assert sorted(r[0] for r in store.chunks().select("chunk_id").collect()) == list(range(sum(added.values())))
    best = ingest.retrieve(store, "plain sentence about kittens", 2).orderBy("rank").collect()
    assert [r["rank"] for r in best] == [1, 2] and best[0]["doc_name"] == "b.txt" and "kittens" in best[0]["text"]
    ingest.rebuild_vectors(store, lambda t: [float(len(t)), 1.0])
    assert {len(r[0]) for r in store.vectors().select("embedding").collect()} == {2}
    assert ingest.retrieve(store, "x", 3).isEmpty()  # another dimension
    ingest.delete_documents(store, spark.createDataFrame([("h1",)], "hash string"))
    assert {r["hash"] for r in store.registry().collect()} == {"h2", "h3"} and store.chunks().count() == store.vectors().count() == 1
    ingest.dump_texts(docs.filter("hash = 'h2'"), str(tmp_path / "dump"))
    assert "kittens" in spark.read.text(str(tmp_path / "dump")).first()[0]


def test_numbers_without_holes_however_partitions_are_merged(spark, tmp_path):
    spark.range(2000).select(F.format_string("%05d", "id").alias("hash"), F.lit(0).alias("chunk_idx"), F.concat(*[F.sha2(F.concat("id", F.lit(f"-{n}")), 256) for n in range(20)]).alias("text")).write.parquet(str(tmp_path / "cut"))
    ingest._numbered(spark.read.parquet(str(tmp_path / "cut")), 7, str(tmp_path / "ordered")).write.parquet(str(tmp_path / "numbered"))  # texts make it more partitions than a count has
    rows = spark.read.parquet(str(tmp_path / "numbered")).collect()
    assert sorted((r["hash"], r["chunk_id"] - 7) for r in rows) == [(f"{n:05d}", n) for n in range(2000)]


def test_strict_and_compat_sections(spark):
    docs = spark.createDataFrame([(1, CONTRACT), (2, "Стоимость услуг составляет 120..\nтекст"), (3, ""), (4, None)], "doc_id long, text string")
    strict = C.find_sections(docs.filter("doc_id = 1")).orderBy("section").collect()
    assert [r["number"] for r in strict] == [None, "1", "2", "2.1", "3", "4", "5"] and strict[1]["title"] == "Предмет"
    compat = C.find_sections(docs.filter("doc_id = 2"), C.COMPAT_HEADER).collect()
    assert [(r["number"], r["title"]) for r in compat] == [(None, "Стоимость услуг составляет 120.."), (None, "текст")]
    assert C.section_chunks(docs).isEmpty()  # every line is a header, so no section has a text


@pytest.mark.parametrize("text,want", [("a\n\n\n\nb", ["a", "b"]), ("a\n\nb", ["a\n\nb"]), ("x" * 25 + "\n\ny", ["x" * 10, "x" * 10, "xxxxx\n\ny"]), ("", []), ("a\r\n\r\nb", ["a\n\nb"]), ("123456789\n\n12", ["123456789", "12"])])
def test_messages(text, want):
    assert C.cut_messages(text, 10) == want


def test_typed_split():
    parts = C.split_at_headings("вступление\nПредмет договора\nтекст\n1.2. Пункт длинный\nещё\nIV. Четвёртый\nОБЩАЯ ЧАСТЬ\nконец", C.CONTRACT_TITLES)
    assert [t for t, _ in parts] == ["Предмет договора", "1.2. Пункт длинный", "IV. Четвёртый", "ОБЩАЯ ЧАСТЬ"] and parts[0][1] == "Предмет договора\nтекст"
    assert C.split_at_headings(" нет ", C.GENERIC_TITLES) == [("", "нет")]
    cut = C.smart_cut("1. Первый\n" + "б" * 450 + "\n2. Второй\nмал\n3. Третий\n" + "\n\n".join("в" * 700 for _ in range(4)), "generic")
    assert cut[0].endswith("2. Второй\nмал") and cut[1:] == ["3. Третий\n" + "в" * 700 + "\n\n" + "в" * 700] * 2
    long = C.smart_cut("1. Первый\n" + "Слово и слово. " * 300, "generic")
    assert long[0] == "1. Первый" and all(len(c) <= 2000 for c in long) and sum(c.count("Слово") for c in long) == 300


def test_adaptive_chunks():
    assert C.sentences_by_start('One two. Three; "four" x. y') == ["One two.", "Three;", '"four" x. y']
    assert C.sentences_by_start("a. b. c") == ["a.", "b.", "c."]
    assert C.is_heading("Title Here") and C.is_heading("Name\n----") and not C.is_heading("just a plain line of words here") and C.is_bullets("x\n- y")
    body = "Words of the body go on here. " * 10
    assert C.adaptive_cut(f"# Head\n\n{body}\n\nShort tail with some more words in it.") == [f"# Head\n\n{body.strip()}"]  # the tail is under 133 characters
    assert C.adaptive_cut(f"{body}\n\n{body}\n\n{body}") == ["\n\n".join([body.strip()] * 3)]  # together below the target
    many = C.adaptive_cut(" ".join(f"Sentence {k} has its own words w{k} v{k} u{k}." for k in range(200)))
    assert all(133 <= len(c) <= 1400 for c in many) and sum(c.count("Sentence") for c in many) == 200


def test_near_chunks_by_all_pairs():
    import numpy as np

    rng, chunks = np.random.default_rng(2), []
    for _ in range(120):
        chunks.append(" ".join(f"w{k}" for k in rng.choice(14, rng.integers(0, 12), replace=False)))
    kept: list[str] = []
    for c in chunks:
        words = set(c.split())
        if not any(words and len(words & set(o.split())) >= 0.6 * len(words | set(o.split())) for o in kept):
            kept.append(c)
    assert C.without_near(chunks, 0.6) == kept


def test_replies_and_mixed_words(spark):
    raws = ['[{"original":"a","recognized":"b"}]\n[{"original":"c","recognized":"d"}]', '[{"original":"a","recognized":"b"}] [{"original":"c","recognized":"d"}]', '{"original":"a"}']
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string").select("id", F.size(records.reply_pairs(F.col("raw"))).alias("n")).collect()
    assert {r["id"]: r["n"] for r in rows} == {0: 2, 1: 2, 2: 1}
    assert spark.createDataFrame([("Дoм30 дом3x",)], "t string").select(T.mixed_repaired(F.col("t"))).first()[0] == "Дом30 дом3x"


def test_finished_jobs_suppress_nothing(spark):
    starts = spark.createDataFrame([(1, 0, 1), (1, 100, 2), (1, 130, 3), (1, 150, 4), (2, 10, 5)], "user_id long, s long, event_id long").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id")
    ends = spark.createDataFrame([(1, 140)], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    got = {r["event_id"]: r["accepted"] for r in records.finished(starts, ends, "user_id", 120.0).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_compare_last_two(spark):
    docs = spark.createDataFrame([("s", 1, "Old."), ("s", 2, "A. B. C."), ("s", 3, "a. X. C. D."), ("t", 1, "Alone.")], "session string, doc_id long, text string")
    assert {(r["original"], r["recognized"]) for r in ingest.compare_last(docs, "session", "doc_id").collect()} == {("B.", "X."), ("", "D.")}


def test_fetched_sheet(spark):
    answers = {"a": (404, b"x,y\n"), "b": (200, b"sign in"), "c": (200, b" , \n,\n"), "d": (200, "h1,h2\n\"a,\nb\",ж\nonly\n".encode())}

    def fetch(url):
        return answers[url]

    got = readers.fetched_sheet(spark, ["missing", *"abcd"], fetch).orderBy("row_no").collect()
    assert [(r["row_no"], r["cells"]) for r in got] == [(0, ["h1", "h2"]), (1, ["a,\nb", "ж"]), (2, ["only"])]
    for urls in ([], ["a", "b", "missing"]):
        with pytest.raises(ValueError):
            readers.fetched_sheet(spark, urls, fetch)


def test_docx_reports(spark):
    rows = spark.createDataFrame([(1, "Title <1>", "one & two\n\n  three\x00"), (2, None, None)], "id long, title string, body string")
    got = {r["id"]: readers.docx_text(bytes(r["docx"])) for r in readers.docx_reports(rows, "id").collect()}
    assert got == {1: "Title <1>\none & two\n  three", 2: ""}
    import zipfile
    from io import BytesIO

    xml = zipfile.ZipFile(BytesIO(readers.docx_bytes("x", "t", [("old", "new"), ("", None)]))).read("word/document.xml").decode()
    assert xml.count(":tr>") == 4 and xml.count(":highlight ") == 2 and xml.index("old") < xml.index("highlight") < xml.index("new")


def test_sessions(spark):
    rows = [(1, 1, "mode", "work"), (1, 2, "add", "a"), (1, 3, "clear", None), (1, 3, "add", "b"), (1, 4, "add", "c"), (1, 5, "add", "b"), (1, 6, "mode", "ai"), (2, 1, "add", "a"), (None, 1, "add", "x"), (None, 2, "clear", None), (3, 1, "mode", "tm")]
    mode, docs = records.sessions(spark.createDataFrame(rows, "user_id long, at long, action string, value string"), "user_id")
    assert {r["user_id"]: r["mode"] for r in mode.collect()} == {1: "ai", 2: None, None: None, 3: "tm"}
    assert {tuple(r) for r in docs.collect()} == {(1, "b", 5), (1, "c", 4), (2, "a", 1)}
