"""Every contract column against plain recomputation, on rows with nulls, copies, extremes, ties and clashing extra columns."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexiforge.llm import best_fit, common, hilbert, lattice_lm, line_quality, ngram_join, piece_table, repair_files, token_counts, toxicity, vamana

WORDS, BYTES, PIECES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, content string, removed long, copies int, salt int, hot boolean, digest string, shard int"
SENTENCES = [" ".join(f"word{(7 * k + j) % 211}" for j in range(12)) + "." for k in range(40)]
LINE = "Read more on our Site today."


def texts():
    rng = np.random.default_rng(8)
    out = [None, "", " \n\t", "a", "y" * 5000, "l\0ng " * 40, "It's <|EndOfText|> here <|endoftext|> \t\t x", "Ünï cödé — 日本語"]
    for k in range(40):
        own = [SENTENCES[j] for j in rng.permutation(40)[:9]]
        out.append("\n".join([*own[:4], *([LINE] if k % 2 else []), *own[4:], f"unique{k} tail{k * k}"]))
    out += [out[20]] * 6 + [out[21] + " more"] * 3 + [out[25] + " vile scum scum", ("long text and more of it " * 3000)]
    return out


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


@pytest.fixture(scope="module")
def rows():
    own = [(k, t, "en" if k % 2 else None, f"h{k % 2}" if k % 5 else None, len(t or ""), "x", "y", 1, 2, 3, True, "z", 9) for k, t in enumerate(texts())]
    return [*own, own[12], (None, "no id at all", *own[0][2:])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(doc_id, modulus):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 2


def test_token_counts_with_special_strings(docs, rows, tmp_path):
    library = Tokenizer.from_file(WORDS)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, WORDS, str(tmp_path / "c")).collect())
    n = {t: len(library.encode(t or "", add_special_tokens=False).ids) for t in {r[1] for r in rows}}
    assert got == Counter((r[0], len((r[1] or "").encode()), n[r[1]], n[r[1]] > 2048) for r in rows)


def test_grammar_ends_without_frequent_pairs():
    rng = np.random.default_rng(4)
    tokens = np.array([1, 5000, 0, 3, 20000])
    ids = (rng.zipf(1.5, tokens.sum()) % 300 * 7).astype(np.uint32)
    row = repair_files.compress(ids, tokens, 2100)
    ends, pairs = [0, *row["doc_ends"].tolist()], Counter()
    for a, b in zip(ends, ends[1:]):
        own, last = row["stream"][a:b].tolist(), None
        for k, pair in enumerate(zip(own, own[1:])):
            if last != (pair, k - 1):  # a pair that overlaps itself counts once
                pairs[pair] += 1
                last = (pair, k)
    assert max(pairs.values()) < repair_files.MIN_COUNT and len(row["stream"]) < len(ids) and len(row["rounds"]) > 2
    block = repair_files.Block({k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in row.items()} | {"doc_ids": [0, 1, 2, 3, 4]})
    assert (block.ids() == ids).all() and (block.document(4) == ids[-20000:]).all() and block.id_at(1, 4321) == ids[4322]


def test_grammar_of_a_large_vocabulary():
    ids = np.array([70000, 5, 70000, 5, 2_000_000] * 100, np.uint32)
    row = repair_files.compress(ids, np.array([500]), 2_000_001)
    block = repair_files.Block({k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in row.items()} | {"doc_ids": [0]})
    assert row["width"] == 4 and (block.ids() == ids).all()
    with pytest.raises(ValueError):
        repair_files.compress(ids, np.array([500]), 70001)


def test_token_files_of_equal_ids(docs, rows):
    library, start = Tokenizer.from_file(BYTES), 0
    got = sorted(map(tuple, repair_files.read_token_files(repair_files.write_token_files(docs, BYTES, block_ids=3000)).collect()), key=lambda r: r[1])
    for r, row in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        ids = library.encode(row[1] or "", add_special_tokens=False).ids + [0]
        assert r == (row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_words_are_segmented_as_in_their_text(docs, rows, monkeypatch):
    own = piece_table.piece_codec(str(PIECES))
    sp, rng = own.library, np.random.default_rng(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "▁", "é", "日", "½", "\xa0", "​", "　", "<s>", "</s>", "<unk>", ".", "😀", "\r", "\x01", "�", "﻿"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(0, 12)))
        want = sp.encode(t)
        assert own.encode(t) == [*want, own.end]
        assert " ".join(sp.decode([own.ids(w) for w in own.words(t)] if t else [])) == sp.decode(want)
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in piece_table.encode_decode(docs, PIECES).collect())
    assert got == Counter((r[0], (*sp.encode(r[1] or ""), own.end), sp.decode(sp.encode(r[1] or ""))) for r in rows)


def quality(rows, limit=20):
    """doc_id, measures and verdict of each row, and its kept text."""
    hosts, lines, first = defaultdict(set), defaultdict(set), {}
    for r in rows:
        host, text = r[3], r[1] or ""
        hosts[host].add(text)
        for line in text.split("\n"):
            key = (host, " ".join(words(lower(line))))
            if key[1]:
                lines[key].add(text)
                rank = (r[0] is not None, r[0] or 0)
                first[key] = min(first.get(key, (rank, text)), (rank, text), key=lambda x: x[0])
    for r in rows:
        text, own = r[1] or "", words(r[1] or "")
        cut = [(line, words(lower(line))) for line in text.split("\n")]
        gone = lambda w, host=r[3], text=text: len(lines[host, " ".join(w)]) > limit and len(lines[host, " ".join(w)]) * 100 > len(hosts[host]) and first[host, " ".join(w)][1] != text
        grams = Counter(zip(own, own[1:], own[2:]))
        repeated = {k + j for k, g in enumerate(zip(own, own[1:], own[2:])) if grams[g] > 1 for j in range(3)}
        filled = [line for line, w in cut if w]
        removed = sum(len(w) for _, w in cut if w and gone(w))
        failed = len(own) < 50 or 100 * len(repeated) > 50 * len(own)
        kept = not failed and 100 * (len(own) - removed) >= 50 * len(own)
        measured = (r[0], len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(filled) - len(set(filled)), len(repeated), removed, failed, kept)
        yield measured, "\n".join(line for line, w in cut if not w or not gone(w))


def test_every_quality_column(docs, rows, empty):
    want = list(quality(rows, 8))
    got = line_quality.quality_rules(docs, line_docs=8)
    assert Counter(map(tuple, got.collect())) == Counter(m for m, _ in want) and any(m[6] for m, _ in want)
    kept = line_quality.apply_quality(docs, line_docs=8)
    assert kept.columns == docs.columns
    expected = Counter((*r[:1], text, r[2], r[3], len(text) if text != r[1] else r[4], *r[5:]) for r, (m, text) in zip(rows, want) if m[-1])
    assert Counter(map(tuple, kept.collect())) == expected
    assert line_quality.apply_quality(empty).isEmpty()


def test_nearest_over_shards_with_mixed_norms(spark):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(2600, 24)) * np.exp(rng.normal(size=(2600, 1)) * 0.6)).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist(), "x", 1) for k, v in enumerate(x)] + [(5000 + k, [1.0, float(k)], "y", 2) for k in range(30)] + [(None, [1.0, 2.0], "n", 3)], "vec_id long, embedding array<float>, shard string, rep int")
    got = defaultdict(list)
    for r in vamana.nearest(frame, shard_size=256).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y, hits = x.astype(float), 0
    queries = range(0, 2600, 20)
    for q in queries:
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(2600), -s))[:20].tolist()) & {v for v, _ in got[q]})
        assert len(got[q]) == 20 and all(abs(score - s[v]) < 1e-9 * max(1, abs(s[v])) for v, score in got[q]) and got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))
    assert hits >= 0.95 * 20 * len(queries)
    assert [v for v, _ in got[5000]] == list(range(5001, 5021)) and [v for v, _ in got[5020]] == [k for k in range(5029, 5008, -1) if k != 5020]
    assert vamana.nearest(frame.limit(0)).isEmpty()


def test_a_full_shard_of_gaussian_vectors():
    x = np.random.default_rng(0).normal(size=(9000, 64)).astype(np.float32)
    band = np.floor(np.log(np.linalg.norm(x, axis=1)) / vamana.BAND + 0.5)
    x = x[band == np.bincount(band.astype(int)).argmax()][:4096]
    graph, start = vamana.build(vamana.lifted(x))
    q = x[::20]
    found, _ = vamana.beam_search(vamana.lifted(x), graph, start, np.c_[q, np.zeros(len(q), np.float32)], vamana.wide_enough(x, graph, start))
    true = np.argpartition(-(q @ x.T), 20, 1)[:, :21]
    assert (found[:, :, None] == true[:, None]).any(1).mean() >= 0.9


def test_every_lattice_column(docs, rows):
    train = [r[1] or "" for r in rows if not held(r[0], 7)]
    counts = Counter(w for t in train for w in words(lower(t)))
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    lattice = lattice_lm.Lattice(PIECES, lattice_lm.ranked(PIECES))
    expected = np.zeros(len(lattice.log_p))
    for w, n in counts.items():
        lattice.add_expected(w, n, expected)
    expected += lattice_lm.SMOOTHING
    end = lattice_lm.vocabulary(PIECES)[2]
    expected[end] = len(train) + lattice_lm.SMOOTHING
    fitted = lattice_lm.Lattice(PIECES, np.log(expected / expected.sum()))
    want = defaultdict(list)
    for r in rows:
        own = words(lower(r[1] or ""))
        b = sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in own) + np.log10((len(train) + 1) / (total + kinds + 1))
        s = (sum(fitted.log_probability(w) for w in own) + fitted.log_p[end]) / np.log(10)
        want[r[0]].append((held(r[0], 7), len(own) + 1, sum(w in counts for w in own) + 1, total, b, s))
    got = defaultdict(list)
    for r in lattice_lm.lattice_scores(docs, PIECES).collect():
        got[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
    assert set(got) == set(want)
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k])):
            assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9)


def test_every_shard_column(docs, rows, empty, tmp_path):
    got = hilbert.hilbert_shards(docs).collect()
    sizes = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    in_order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in in_order] == sorted(r["curve"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    places = [r["text_crc32"] for r in in_order]
    assert all(b - a + 1 == places.count(c) for c in set(places) for a, b in [(places.index(c), len(places) - 1 - places[::-1].index(c))])
    ranges = hilbert.write_shards(docs, str(tmp_path / "s"), 4).collect()
    back = docs.sparkSession.read.parquet(str(tmp_path / "s" / "rows"))
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(rows) and sum(r["rows"] for r in ranges) == len(rows)
    assert hilbert.write_shards(empty, str(tmp_path / "e")).isEmpty()


def test_shards_prune_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ranges = hilbert.write_shards(docs, str(tmp_path / "s")).collect()
    assert len(ranges) == 16
    sizes = sorted(r[0] for r in docs.select(F.octet_length("text")).collect())
    met = lambda lo, hi: sum(r["least_size"] <= hi and r["greatest_size"] >= lo for r in ranges)
    assert met(sizes[0], sizes[50]) <= 12 and met(sizes[-20], sizes[-1]) <= 12
    curves = sorted((r["least_curve"], r["greatest_curve"]) for r in ranges)
    assert all(a[1] <= b[0] for a, b in zip(curves, curves[1:]))


def test_every_packing_column(docs, rows):
    library, want = Tokenizer.from_file(WORDS), Counter()
    streams = {}
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        streams[r[0], r[1]] = ids
        for piece, at in enumerate(range(0, len(ids), 512)):
            want[r[0], piece, at, len(ids[at : at + 512]), zlib.crc32(np.array(ids[at : at + 512], "<u4").tobytes())] += 1
    got = best_fit.pack_documents(docs, WORDS, 1, capacity=512).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    lengths = [r["length"] for r in got]
    assert len({r["sequence_id"] for r in got}) <= len(best_fit.best_fit([n for n in lengths if n < 512], 512)) + lengths.count(512)
    for r in best_fit.packed_sequences(docs, WORDS, 1, capacity=512).collect():
        ids, at = np.frombuffer(r["ids"], "<u4").tolist(), 0
        assert len(ids) == r["n_tokens"] <= 512
        for p in r["pieces"]:
            own = ids[p["offset"] : p["offset"] + p["length"]]
            assert p["offset"] == at and any(k[0] == p["doc_id"] and own == v[512 * p["piece"] : 512 * p["piece"] + p["length"]] for k, v in streams.items())
            at += p["length"]


def test_local_search_never_adds_bins():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 300, 200).tolist()
        first = best_fit.best_fit(lengths, 512)
        fills = lambda bins: sum(sum(lengths[k] for k in b) ** 2 for b in bins)
        bins = best_fit.local_search([list(b) for b in first], lengths, 512)
        assert sorted(k for b in bins for k in b) == list(range(200)) and len(bins) <= len(first) and fills(bins) >= fills(first)
        assert all(sum(lengths[k] for k in b) <= 512 for b in bins)


def toxic_rows(n=300):
    rng = np.random.default_rng(5)
    bad = rng.random(n) < 0.3
    return [(k, " ".join(f"w{j}" for j in rng.integers(0, 300, 60)) + (" vile scum filth" if b else "")) for k, b in enumerate(bad)], bad


def test_toxicity_counts_and_labels(spark):
    own, bad = toxic_rows()
    labels = [(k, int(b)) for k, b in enumerate(bad)] + [(None, 1), (3, None), (5, 1), (5, 0)]
    docs, marks = spark.createDataFrame([*own, (None, "vile scum filth")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    known = defaultdict(int)
    for k, y in labels:
        if k is not None and y is not None and not held(k, 4):
            known[k] = max(known[k], y)
    third = {r["doc_id"]: r["t"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("t")).collect()}
    with_it, n = np.zeros((2, toxicity.BUCKETS)), [0, 0]
    for k, t in own:
        if k in known and third[k] > 0:
            n[known[k]] += 1
            with_it[known[k], np.unique(toxicity.token_buckets(t))] += 1
    want = toxicity.token_scores(with_it[1], with_it[0], n[1], n[0])
    scorer = toxicity.fit(docs, marks)
    assert np.allclose(scorer.scores, want)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    x = np.array([scorer.summary(*scorer.passages(t)) for _, t in own])
    p = scorer.probability(x)
    for (k, _), score in zip(own, p):
        r = got[k]
        assert r["held_out"] == held(k, 4) and abs(r["score"] - score) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)
    assert np.mean([(got[k]["predicted"] == 1) == b for k, b in enumerate(bad) if held(k, 4)]) > 0.95
    kept = {r["doc_id"] for r in toxicity.keep_harmless(docs, marks).collect()}
    assert kept == {k for k, r in got.items() if not r["predicted"]}


def shingle_set(t):
    own = words(lower(t or ""))
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def test_keep_one_by_brute_force(docs, rows):
    sets, parent = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    want = Counter()
    for g in groups.values():
        best = min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
        want[rows[best][:2]] += 1
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_rows_of_one_id_with_unlike_texts_stay(spark):
    rows = [(1, "one two three four five six"), (1, "other words that are unlike it all"), (2, "one two three four five six"), (None, "one two three four five six"), (None, "alone and without any id here")]
    got = Counter(map(tuple, ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == Counter({rows[0]: 1, rows[1]: 1, rows[4]: 1})


def test_hot_keys_join_as_others(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit(1).alias("salt"))
    right = common.written(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2), "right")
    assert Counter(map(tuple, common.spread_join(left, right, ["k"], "n", F.col("id")).select("id", "k", "salt", "v").collect())) == Counter((k, 7 if k % 3 == 0 else k, 1, 14 if k % 3 == 0 else 2 * k) for k in range(3000))


def test_pipeline(spark, rows, tmp_path):
    own, bad = toxic_rows(80)
    more = [(1000 + k, f"{t}\n" + "\n".join(SENTENCES[(k + j) % 40] for j in range(6)), "en", "h2", len(t), *rows[0][5:]) for (k, t) in own]
    every = [*rows, *more]
    docs = spark.createDataFrame(every, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + k, int(b), 0) for k, b in enumerate(bad)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    left = [(*r[:1], text, *r[2:]) for r, (m, text) in zip(every, quality(every)) if m[-1]]
    stage = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in stage.collect()) == Counter(r[:2] for r in left) and stage.columns == docs.columns
    scorer = toxicity.fit(common.written(stage, "test-stage"), spark.read.parquet(str(tmp_path / "labels.parquet")))
    left = [r for r in left if scorer.probability(np.array([scorer.summary(*scorer.passages(r[1]))]))[0] < toxicity.THRESHOLD]
    kept = []
    for r in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
        kept.append((r, shingle_set(r[1])))
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    parent = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if linked(kept[i][1], kept[j][1]):
                old, new = parent[i], parent[j]
                parent = [min(old, new) if p in (old, new) else p for p in parent]
    survivors = [kept[k][0] for k in sorted(set(parent))]
    library, want = Tokenizer.from_file(WORDS), Counter()
    for r in survivors:
        ids = library.encode(r[1], add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            want[r[0], piece, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 4096 and [o for o, _ in sorted(v)] == list(np.cumsum([0, *[n for _, n in sorted(v)]])[:-1]) for v in by.values())


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
