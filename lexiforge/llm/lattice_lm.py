"""Subword lattice likelihood.

A word's probability is the sum over all its segmentations into pieces of an existing vocabulary, each the product
of its pieces' unigram probabilities; a forward recursion in log space gives it without listing them. Pieces cannot
cross words, so a text's probability is the product over its words and one end. Piece probabilities start from the
vocabulary's own ranking by Zipf's law and are fitted to the training texts by rounds of expected counts over the
lattices (forward and backward). Characters that no piece has are spelled in byte pieces.

Texts are cut into blocks of bounded size; each block lists its distinct words once, so words are counted and
scored once each over all texts, and what is shuffled are words by block, never tokens.

Defined results: null and empty texts are the end alone; without training texts all words have count 0 and pieces
keep the vocabulary's ranking; rows are scored each for itself; extra columns are left out.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lower_ascii, partitions_for, split_words, text_bytes, written
from .piece_table import MARK

BLOCK_WORDS, BLOCK_TOKENS, GROUP_CHARS, EM_ROUNDS, SMOOTHING, ZIPF_SHIFT = 400_000, 4_000_000, 300_000, 1, 0.1, 2.7
TOKENS = "block long, doc_id long, held_out boolean, places binary, word string, place int, n_train long"


@cache
def vocabulary(model_path: str) -> tuple[tuple[str, ...], tuple[int, ...], int]:
    """Pieces, the ids of the 256 byte pieces, and the end's id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = tuple(sp.id_to_piece(i) for i in range(sp.vocab_size()))
    return pieces, tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)), sp.eos_id()


def ranked(model_path: str) -> np.ndarray:
    """Natural log probabilities of the pieces by Zipf's law over the vocabulary's own order of scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    order = sorted(range(sp.vocab_size()), key=lambda i: (-sp.get_score(i), i))
    weight = np.empty(len(order))
    weight[order] = 1 / (np.arange(len(order)) + ZIPF_SHIFT)
    return np.log(weight / weight.sum())


def _sweep(value: np.ndarray, came: np.ndarray, goes: np.ndarray, log_p: np.ndarray, rank: np.ndarray) -> None:
    """Sets value at each node that arcs go to: the log of the sum over these arcs, nodes of lower rank first and those of one rank at once."""
    order = np.lexsort((goes, rank))
    came, goes, log_p, rank = came[order], goes[order], log_p[order], rank[order]
    node = np.flatnonzero(np.r_[True, goes[1:] != goes[:-1]])
    ends = np.r_[node[1:], len(goes)]
    steps = np.flatnonzero(np.r_[True, np.diff(rank[node]) != 0]).tolist()
    for lo, hi in zip(steps, [*steps[1:], len(node)]):
        a, b = node[lo], ends[hi - 1]
        terms, own = value[came[a:b]] + log_p[a:b], node[lo:hi] - a
        top = np.maximum.reduceat(terms, own)
        value[goes[node[lo:hi]]] = top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, ends[lo:hi] - node[lo:hi])), own))


class Lattice:
    """Lattices of many words at once: nodes are the places in the words' joined text, arcs the pieces found there."""

    def __init__(self, model_path: str, log_p: np.ndarray):
        import ahocorasick

        pieces, self.bytes, end = vocabulary(model_path)
        special = {0, 1, end, *self.bytes}
        self.log_p = np.asarray(log_p)
        self.ids = {p: k for k, p in enumerate(pieces) if k not in special}
        self.pieces = ahocorasick.Automaton()
        for p, k in self.ids.items():
            self.pieces.add_word(p, k << 16 | len(p))
        self.pieces.make_automaton()

    def _groups(self, words: list[str]):
        """Indices of words of like length, so many that their texts together are of bounded size (or one longer word)."""
        group, size = [], 0
        for k in sorted(range(len(words)), key=lambda k: len(words[k])):
            if group and size + len(words[k]) > GROUP_CHARS:
                yield group
                group, size = [], 0
            group.append(k)
            size += len(words[k]) + 2
        if group:
            yield group

    def _arcs(self, words: list[str]):
        """start, end, log_p and piece of the arcs; the characters spelled in bytes (the last arcs, piece -1); each node's word and depth; each word's first node."""
        text = "\n".join([MARK + w for w in words])
        found = np.fromiter(chain.from_iterable(self.pieces.iter(text)), np.int64).reshape(-1, 2)
        end, size, piece = found[:, 0] + 1, found[:, 1] & 0xFFFF, found[:, 1] >> 16
        nodes = np.array([len(w) + 2 for w in words])
        first = np.cumsum(nodes) - nodes
        word = np.repeat(np.arange(len(words)), nodes)
        depth = np.arange(len(word)) - first[word]
        single = np.zeros(len(word), bool)
        single[first + nodes - 1] = True  # a word's last node has no character
        single[(end - size)[size == 1]] = True
        bare = np.flatnonzero(~single)
        spelled = [[self.bytes[b] for b in text[i].encode()] for i in bare.tolist()]
        start, end, piece = np.r_[end - size, bare], np.r_[end, bare + 1], np.r_[piece, np.full(len(bare), -1)]
        log_p = np.r_[self.log_p[piece[: len(size)]], [self.log_p[s].sum() for s in spelled]]
        return start, end, log_p, piece, spelled, word, depth, first

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log, for each word, of the sum over all its segmentations."""
        out = np.zeros(len(words))
        for group in self._groups(words):
            start, end, log_p, _, _, word, depth, first = self._arcs([words[k] for k in group])
            forward = np.zeros(len(word))
            _sweep(forward, start, end, log_p, depth[end])
            out[group] = forward[np.r_[first[1:], len(word)] - 1]
        return out

    def log_probability(self, word: str) -> float:
        return float(self.log_probabilities([word])[0])

    def add_all_expected(self, words: list[str], weights: np.ndarray, counts: np.ndarray) -> None:
        """Adds the expected number of each piece over the words' segmentations, times each word's weight."""
        for group in self._groups(words):
            start, end, log_p, piece, spelled, word, depth, first = self._arcs([words[k] for k in group])
            forward, backward = np.zeros(len(word)), np.zeros(len(word))
            _sweep(forward, start, end, log_p, depth[end])
            _sweep(backward, end, start, log_p, -depth[start])
            total = forward[np.r_[first[1:], len(word)] - 1]
            share = weights[group][word[start]] * np.exp(forward[start] + log_p + backward[end] - total[word[start]])
            n = len(share) - len(spelled)
            counts += np.bincount(piece[:n], share[:n], minlength=len(counts))
            for own, x in zip(spelled, share[n:]):
                for b in own:
                    counts[b] += x

    def add_expected(self, word: str, weight: float, counts: np.ndarray) -> None:
        self.add_all_expected([word], np.array([weight]), counts)


def count_words(docs: DataFrame, fold_modulus: int = 7, held_fold: int = 2) -> DataFrame:
    """The blocks, written: a row for each text (places of its words in the block's list) and for each distinct word of a block."""

    def run(batches):
        block = TaskContext.get().partitionId() << 24
        places: dict[str, int] = {}
        train: list[int] = []
        rows: list[tuple] = []
        tokens = 0

        def flush():
            n, m = len(rows), len(places)
            empty = lambda k: [None] * k
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(n + m, block, np.int64)),
                pa.array([r[0] for r in rows] + empty(m), pa.int64()),
                pa.array([r[1] for r in rows] + empty(m), pa.bool_()),
                pa.array([r[2] for r in rows] + empty(m), pa.binary()),
                pa.array(empty(n) + list(places), pa.string()),
                pa.array(empty(n) + list(range(m)), pa.int32()),
                pa.array(empty(n) + train, pa.int64()),
            ], ["block", "doc_id", "held_out", "places", "word", "place", "n_train"])

        for b in batches:
            for doc_id, held, text in zip(*(c.to_pylist() for c in b.columns)):
                words = split_words(lower_ascii(text or ""))
                own = np.fromiter([places.setdefault(w, len(places)) for w in words], np.uint32, len(words))
                train.extend([0] * (len(places) - len(train)))
                if not held:
                    for k, n in zip(*(x.tolist() for x in np.unique(own, return_counts=True))):
                        train[k] += n
                rows.append((doc_id, held, own.tobytes()))
                tokens += len(words)
                if len(places) >= BLOCK_WORDS or tokens >= BLOCK_TOKENS:
                    yield flush()
                    block, places, train, rows, tokens = block + 1, {}, [], [], 0
        if rows:
            yield flush()

    rows = docs.select("doc_id", (fold(F.col("doc_id"), fold_modulus) == held_fold).alias("held_out"), "text")
    return written(rows.mapInArrow(run, TOKENS), "lm-blocks")


def expected_counts(words: DataFrame, model_path: str, log_p: np.ndarray) -> np.ndarray:
    """Expected piece counts over the training words; a row for each piece comes to the driver."""
    given = words.sparkSession.sparkContext.broadcast(log_p)

    def run(batches):
        lattice, counts = Lattice(model_path, given.value), np.zeros(len(given.value))
        for b in batches:
            lattice.add_all_expected(b.column(0).to_pylist(), b.column(1).to_numpy().astype(np.float64), counts)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["piece", "n"])

    out = np.zeros(len(log_p))
    sums = words.filter("n_train > 0").select("word", "n_train").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    for piece, n in sums.collect():
        out[piece] = n
    return out


def lattice_scores(docs: DataFrame, model_path: str, em_rounds: int = EM_ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row of docs."""
    partitions = partitions_for(docs.sparkSession, text_bytes(docs))
    tokens = count_words(docs)
    # Partitions grow with the input. A word is listed once a block, so no word is hot and nothing is gained by summing before.
    listed = tokens.filter("word is not null").repartition(partitions, "word")
    words = written(listed.groupBy("word").agg(F.sum("n_train").alias("n_train")), "lm-words")
    in_words, distinct = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.when(F.col("n_train") > 0, 1))).first()
    train_docs = tokens.filter("word is null and not held_out").count()
    total, kinds = in_words + train_docs, distinct + (train_docs > 0)

    log_p = ranked(model_path)
    end = vocabulary(model_path)[2]
    for _ in range(em_rounds if in_words else 0):
        counts = expected_counts(words, model_path, log_p) + SMOOTHING
        counts[end] = train_docs + SMOOTHING
        log_p = np.log(counts / counts.sum())
    given = docs.sparkSession.sparkContext.broadcast(log_p)

    def score(batches):
        lattice = Lattice(model_path, given.value)
        for b in batches:
            own = lattice.log_probabilities(b.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.float64())], ["word", "n_all", "log10_p"])

    scored = words.select("word", F.col("n_train").alias("n_all")).mapInArrow(score, "word string, n_all long, log10_p double")
    by_block = listed.select("block", "place", "word").join(scored.repartition(partitions, "word"), "word").select(F.col("block").alias("of_block"), "place", "n_all", "log10_p")
    texts = tokens.filter("word is null").select("block", "doc_id", "held_out", "places")
    per_end = (math.log10((train_docs + 1) / (total + kinds + 1)), float(log_p[end]) / math.log(10))

    def join(texts_of: pa.Table, words_of: pa.Table) -> pa.Table:
        n = words_of.num_rows
        base, own, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        at = words_of["place"].to_numpy()
        count = words_of["n_all"].to_numpy()
        base[at], own[at], known[at] = np.log10((count + 1) / (total + kinds + 1)), words_of["log10_p"].to_numpy(), count > 0
        out = []
        for places in texts_of["places"].to_pylist():
            k = np.frombuffer(places, np.uint32)
            out.append((len(k) + 1, int(known[k].sum()) + (train_docs > 0), base[k].sum() + per_end[0], own[k].sum() + per_end[1]))
        n_tokens, n_known, bases, scores = zip(*out)
        return pa.table({"doc_id": texts_of["doc_id"], "held_out": texts_of["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array(np.full(len(out), total, np.int64)), "base_score": pa.array(bases, pa.float64()), "score": pa.array(scores, pa.float64())})

    return texts.repartition(partitions, "block").groupBy("block").cogroup(by_block.repartition(partitions, "of_block").groupBy("of_block")).applyInArrow(join, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
