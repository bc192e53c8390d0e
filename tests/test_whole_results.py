"""Queries do the whole job: small fixtures against brute force, beyond the sizes where results once were cut."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import chunking, retrieval
from lexiforge.plans import text_queries


def stored(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_overlap_chunks_every_sentence(spark, tmp_path):
    texts = {1: " ".join(f"Sentence number {i} is here." for i in range(57)), 2: "One. Two! Three?", 3: "", 4: "x"}
    d = stored(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    want = set()
    for k, text in texts.items():
        parts = [p for p in (p.strip() for p in re.split(r"(?<=[.!?…])\s+", text)) if p]
        want |= {(k, i, (parts[i - 1][-10:] if i else "") + p) for i, p in enumerate(parts)}
    rows = [tuple(r) for r in text_queries.chunk_overlap(spark, d).collect()]
    assert len(rows) == len(want) == 57 + 3 + 1 and set(rows) == want


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_answers_every_query(spark, metric):
    x = np.random.default_rng(3).integers(-9, 10, (2500, 4)).astype(np.float64)
    x[~x.any(1), 0] = 1
    v = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    found = retrieval.knn(v, v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 3, metric)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
    assert len(got) == 3 * len(x)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()
    if metric == "l2":
        far = ((x[:, None] - x[None]) ** 2).sum(2)
    else:
        n = np.sqrt((x * x).sum(1))
        far = -(x @ x.T) / (n[:, None] * n[None])
    best = np.sort(far, 1)[:, :3]
    for (query, rank), (vec, score) in got.items():
        assert abs(abs(score) - abs(best[query, rank - 1])) < 1e-9 and abs(far[query, vec] - best[query, rank - 1]) < 1e-9
    if metric == "l2":
        # whole numbers: ties are exact, so the ids are fixed
        ids = np.argsort(far, 1, kind="stable")[:, :3]
        assert all(ids[q, r - 1] == v for (q, r), (v, _) in got.items())


def test_sections_by_every_alias(spark):
    aliases = spark.range(10_001).select(F.col("id").cast("int").alias("ord"), F.format_string("w%05dx", "id").alias("alias"), F.col("id").cast("string").alias("canon"))
    titles = spark.createDataFrame([(f"w{i:05d}x",) for i in (0, 9_999, 10_000)], "title string")
    assert {tuple(r) for r in chunking.canonical_section(titles, aliases).collect()} == {("w00000x", "0"), ("w09999x", "9999"), ("w10000x", "10000")}


def windows(text, size=1600, overlap=250):
    """C3 by its description: a window ends after its last full stop if that is near its end."""
    text, i, out = text.strip(), 0, []
    while i < len(text):
        j = min(len(text), i + size)
        dot = text.rfind(".", i, j)
        k = j if j == len(text) or dot < 0 or j - dot > 200 else dot + 1
        out.append(text[i:k].strip())
        if k >= len(text):
            break
        i = max(i + 1, k - overlap)
    return [w for w in out if len(w) >= 20]


def test_windows_of_a_long_text(spark, tmp_path):
    text = " ".join(f"Sentence number {i} is here." for i in range(20_000))
    d = stored(spark, tmp_path, "documents", [(1, text), (2, "A short text, of one window.")], "doc_id long, text string")
    want = {(1, i, hashlib.md5(w.encode()).hexdigest()) for i, w in enumerate(windows(text))} | {(2, 0, hashlib.md5(b"A short text, of one window.").hexdigest())}
    assert len(want) > 301
    assert {tuple(r) for r in text_queries.window_chunks(spark, d).collect()} == want


def test_index_counts_by_section(spark, tmp_path):
    body = " ".join(f"Sentence number {i} is here." for i in range(150))
    sections = ["What stands before the first header.", f"1. First Heading\n{body}", "2. Second Heading\nA short body of one window."]
    texts = {1: "\n".join(sections), 2: "One sentence. Two sentences! Three?", 3: " ", 4: " ".join(f"Sentence number {i} is here." for i in range(400))}
    d = stored(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    # Any short line that begins with a letter is a header: what stands before the first one and header lines are no text.
    want = {1: len(windows(body)), 2: 0, 3: 0, 4: 300}
    assert want[1] > 1
    assert {r["doc_id"]: r["added"] for r in text_queries.index_counts(spark, d).collect()} == want


@pytest.mark.parametrize("metric,most", [("l2", 1000), ("l2", 7), ("cosine", 1000), ("cosine", 7)])
def test_search_makes_no_row_a_pair(spark, monkeypatch, metric, most):
    """The k nearest in order, with copies, zeros, holes and other dimensions, by tasks that keep k a query; queries in one block and in some."""
    monkeypatch.setattr(retrieval, "MAX_QUERIES", most)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 5)), 1).astype(np.float32).tolist()
    x[3], x[7], x[8] = [0.0] * 5, [1.0] * 5, [1e3, 0.0, 0.0, 0.0, 1e-3]
    x[100:160] = [[1.0] * 5] * 60
    v = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = retrieval.knn(v, asked, 6, metric)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    own = {k: np.array(e, np.float64) for k, e in enumerate(x)}
    size = lambda a: sum(float(c) * float(c) for c in a) ** 0.5 or 1.0
    for q in range(0, 400, 20):
        score = {k: sum((a - b) * (a - b) for a, b in zip(e.tolist(), own[q].tolist())) if metric == "l2" else -sum(a * b for a, b in zip(e.tolist(), own[q].tolist())) / (size(e) * size(own[q])) for k, e in own.items()}
        want = sorted(score, key=lambda k: (score[k], k))[:6]
        got = sorted((r["rank"], r["vec_id"]) for r in found.filter(F.col("query_id") == q).collect()) if q in (0, 100, 200) else None
        assert got is None or [k for _, k in got] == want
    odd = v.union(spark.createDataFrame([(500, [1.0, None, 1.0, 1.0, 1.0]), (501, [1.0]), (502, None), (503, [float("nan")] * 5)], "vec_id long, embedding array<float>"))
    assert retrieval.knn(odd, asked, 404, metric).count() == 20 * 404


def test_terms_are_counted_where_texts_lie(spark):
    docs = spark.createDataFrame([(1, "Running runs; ran RUNNING договорами акты"), (2, None), (3, "a_b 12 " * 500)], "doc_id long, text string")
    found = retrieval.term_frequencies(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(1, "runn", 2), (1, "run", 1), (1, "ran", 1), (1, "договор", 1), (1, "акт", 1), (3, "a", 500), (3, "b", 500), (3, "12", 500)}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    twice = {tuple(r) for r in retrieval.term_frequencies(docs.union(docs)).collect()}
    assert twice == {(k, t, 2 * n) for k, t, n in want}


def test_slices_of_a_batch_give_every_row(spark):
    from pyspark.sql.types import ArrayType, StringType

    from lexiforge.functions.text import SLICE_ROWS, by_slices

    rows = [(k, None if k % 7 == 0 else f"t{k}") for k in range(3 * SLICE_ROWS + 1)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    found = df.select("id", by_slices(lambda t: [t or "", "x"] if t else [], ArrayType(StringType()))(F.col("text")).alias("x"))
    assert {r["id"]: r["x"] for r in found.collect()} == {k: [t, "x"] if t else [] for k, t in rows}
    assert "ArrowEvalPython" in chunking.smart_split(df.withColumnRenamed("id", "doc_id"))._jdf.queryExecution().executedPlan().toString() and found.limit(0).count() == 0
