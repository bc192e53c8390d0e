"""The corpus operators against the libraries and brute force, on rows with nulls, copies, extremes and extra columns."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexiforge.llm import best_fit, hilbert, lattice_lm, line_quality, ngram_join, piece_table, queries, repair_files, token_counts, toxicity, vamana
from lexiforge.llm.token_codec import TokenCodec

SF = "/root/testdata/sf0.001"
WORDS = P.path("word_bpe_49k.json")
BYTES = P.path("byte_bpe_50k.json")
PIECES = P.path("piece_bpe_32k.model")
BASE = " ".join(f"word{k % 37} and thing{k}" for k in range(60))
TEXTS = [None, "", "  \n\t", "a", BASE, BASE, BASE.upper(), BASE + " more", "Ünï cödé ½ ² — 日本語 text　x", "<|endoftext|> in it ▁ and <s>", "tab\t\tand  two   blanks ", "don't we'll\r\n\r\nx", "y" * 3000, ("long text " * 9000), "\x1c odd \x85 blank\xa0s", "toxic worthless idiot"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, content string, block long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, "h" if k % 3 else None, len(t or ""), "x", "y", 7) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[4], (None, "no id", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_codec_equals_the_library():
    for path in (WORDS, BYTES):
        library, own = Tokenizer.from_file(path), TokenCodec(path, 50)
        for t in TEXTS:
            assert np.frombuffer(own.packed(t), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_codec_on_random_texts():
    """Blanks, quotes, numbers and odd characters in every order, in groups, one by one, and from a table that is always full."""
    pick = random.Random(5)
    parts = ["a", "b", "'s", "'ll", "'", " ", " ", "\n", "\n\n\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\0", "1", "23", "²", "é", "À", "ß", ".", "...", "the", "ING", "ſ", "中", "<|endoftext|>", "  ", "x" * 17, "y" * 70]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 30))) for _ in range(5000)] + [None] + ["".join(pick.choices(parts[:6] + ["the"], k=12)) for _ in range(5000)]
    texts.append(" ".join(f"w{k * k}" for k in range(150_000)))  # more words than are looked up at once
    for path in (WORDS, BYTES):
        library = Tokenizer.from_file(path)
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        for entries in (50, 600_000):
            own = TokenCodec(path, entries)
            assert own.merges is not None
            assert [np.frombuffer(ids, "<u4").tolist() for ids in own.packed_all(texts)] == want
            assert [np.frombuffer(own.packed(t), "<u4").tolist() for t in texts[:200]] == want[:200]
        own.merges = None  # as for a model that Merges doesn't know
        own.fine.used = own.fine.entries
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.packed_all(texts[:500])] == want[:500]
    assert list(own.packed_all([])) == []


def test_token_counts(docs, empty, tmp_path):
    library, cache = Tokenizer.from_file(WORDS), str(tmp_path / "cache")
    want = Counter((k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in [*enumerate(TEXTS), (4, BASE), (None, "no id")])
    for _ in range(2):  # the second run finds all in the cache
        rows = token_counts.token_counts(docs, WORDS, cache).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == stored.select("content_digest").distinct().count()
    assert token_counts.token_counts(empty, WORDS, cache).isEmpty()


def test_token_files(docs, empty):
    blocks = repair_files.write_token_files(docs, BYTES)
    library, start = Tokenizer.from_file(BYTES), 0
    got = sorted(repair_files.read_token_files(blocks).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 4, 4, *range(5, len(TEXTS))]
    for r in got:
        ids = library.encode("no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert repair_files.read_token_files(repair_files.write_token_files(empty, BYTES)).isEmpty()


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    tokens = np.array([5, 1, 400, 0, 3000])
    ids = rng.integers(0, 12, tokens.sum()).astype(np.uint32)
    row = repair_files.compress(ids, tokens, 100, min_count=4)
    block = repair_files.Block({k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in row.items()} | {"doc_ids": list(range(5))})
    assert len(row["stream"]) < len(ids) and (block.ids() == ids).all()
    ends = np.cumsum(tokens)
    for k in range(5):
        own = ids[ends[k] - tokens[k] : ends[k]]
        assert (block.document(k) == own).all()
        assert [block.id_at(k, p) for p in range(0, len(own), 97)] == own[::97].tolist()


def test_sentencepiece(docs, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in piece_table.encode_decode(docs, PIECES).collect():
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert r["ids"] == sp.encode(text) + [2] and r["decoded"] == sp.decode(r["ids"])
    assert piece_table.encode_digests(empty, PIECES).isEmpty()


def test_ngram_join(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got[0] == (0, 0) and got[2] == (0, 2) and got[3] == (1, 3)
    assert {got[k][1] for k in (4, 5, 6, 7)} == {4} and got[13][1] == 13
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect())[4] == 1
    assert ngram_join.jaccard_components(empty).isEmpty()


def test_long_lists_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(f"x{rng.integers(1 << 30)}" if rng.random() < p else w for w in base) for p in rng.uniform(0, 0.08, 150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    label = list(range(len(sets)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    got = ngram_join.jaccard_components(frame).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: root(k) for k in range(len(sets))}


def test_line_quality(spark, docs, empty):
    rows = [(k, "Common line of the host.\n" + " ".join(f"w{k}x{j}" for j in range(60)), "h") for k in range(40)] + [(99, "Common line of the host.\n" * 3 + "few", "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_quality.quality_rules(frame).collect()}
    assert got[0]["removed_words"] == 0 and got[5]["removed_words"] == 5 and got[5]["kept"] and not got[99]["kept"]
    kept = {r["doc_id"]: r["text"] for r in line_quality.apply_quality(frame).collect()}
    assert "Common" in kept[0] and "Common" not in kept[7] and len(kept) == 40
    assert line_quality.repeated_words("a b c d a b c".split()) == 6
    assert line_quality.quality_rules(docs).count() == docs.count() and line_quality.apply_quality(empty).isEmpty()


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[7]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (3, x[3].tolist())]
    got = defaultdict(list)
    for r in vamana.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    y, hits = x.astype(float), 0
    for q in range(0, 600, 20):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(600), -s))[:20].tolist()) & set(got[q]))
        assert len(got[q]) == 20
    assert len(got) == 30 and hits >= 0.9 * 600


def test_lattice_by_all_segmentations(docs, empty):
    lattice = lattice_lm.Lattice(PIECES, lattice_lm.ranked(PIECES))

    def every(text):
        if not text:
            return 1.0
        return sum(np.exp(lattice.log_p[lattice.ids[text[:n]]]) * every(text[n:]) for n in range(1, len(text) + 1) if text[:n] in lattice.ids)

    for word in ("the", "reading", "aaa"):
        assert abs(lattice.log_probability(word) - np.log(every("▁" + word))) < 1e-9
        counts = np.zeros(len(lattice.log_p))
        lattice.add_expected(word, 1.0, counts)
        assert abs(sum(counts[k] * len(p) for p, k in lattice.ids.items()) - len(word) - 1) < 1e-6
    rows = lattice_lm.lattice_scores(docs, PIECES).collect()
    assert len(rows) == docs.count() and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert lattice_lm.lattice_scores(empty, PIECES).isEmpty()


def test_hilbert(docs, empty):
    cells = np.array([(a, b, c) for a in range(4) for b in range(4) for c in range(4)])
    order = cells[np.argsort(hilbert.hilbert_index(cells, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    rows = hilbert.hilbert_shards(docs, 4).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert hilbert.hilbert_shards(empty).isEmpty()


def test_packing(docs, empty):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 4096, 400).tolist()
    first = best_fit.best_fit(lengths)
    bins = best_fit.local_search([list(b) for b in first], lengths)
    assert sorted(k for b in bins for k in b) == list(range(400)) and all(sum(lengths[k] for k in b) <= 4096 for b in bins) and len(bins) <= len(first)
    assert best_fit.local_search([[0], [1, 2], [3]], [10, 2000, 2000, 80]) != [[0], [1, 2], [3]]
    rows, by = best_fit.pack_documents(docs, WORDS, 1).collect(), defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 4096
    assert best_fit.pack_documents(empty, WORDS, 1).isEmpty()


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(5)
    bad = rng.random(400) < 0.3
    rows = [(k, " ".join(f"w{j}" for j in rng.integers(0, 500, 60)) + (" vile scum " if b else ""), int(b)) for k, b in enumerate(bad)]
    frame, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame, labels).collect()}
    assert np.mean([got[k]["predicted"] == b for k, b in enumerate(bad)]) > 0.95
    assert any(got[k]["passages"] for k in np.flatnonzero(bad).tolist())
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and all(r["score"] == 0 and r["predicted"] == 0 for r in none)
    assert toxicity.toxicity(empty, labels).isEmpty()


def test_toxicity_ranks_held_out_rows_of_few_labels(spark):
    """Toxic texts share no whole word, but the beginnings of some; long and short clean texts are equal."""
    rng = np.random.default_rng(3)
    word = lambda head="": head + "".join(rng.choice(list("abdeiklmnorstu"), 7))
    bad = np.arange(160) % 4 == 1
    rows = [(k, " ".join([word() for _ in range(rng.integers(20, 200))] + [word("grimv") for _ in range(4 * b)])) for k, b in enumerate(bad)]
    labels = spark.createDataFrame([(k, int(b)) for k, b in enumerate(bad)], "doc_id long, toxic int")
    got = [r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect() if r["held_out"]]
    pairs = [(a["score"] > b["score"]) + (a["score"] == b["score"]) / 2 for a in got if bad[a["doc_id"]] for b in got if not bad[b["doc_id"]]]
    assert len(pairs) > 50 and np.mean(pairs) > 0.95


def test_segments_by_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(50):
        s = rng.normal(-0.2, 1, 30)
        found = toxicity.segments(s)
        best = max(s[i:j].sum() for i in range(30) for j in range(i + 1, 31))
        assert abs(max((x for _, _, x in found), default=best) - best) < 1e-9
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("name", queries.ORACLES)
def test_queries_with_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want, got = duck.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(rows) and rows
