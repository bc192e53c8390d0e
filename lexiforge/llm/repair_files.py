"""Token-id files compressed by Re-Pair grammars.

Each block of a shard holds some millions of ids of whole documents, so that the grammar's work space is bounded
however large a shard is. Time and again all frequent pairs of adjacent symbols become nonterminals, never across
documents, the more frequent pair first where two overlap, until no pair is frequent. Counts are exact; after the first
round only pairs with a new symbol, or left over by an overlap, can still be frequent, so rounds get cheap. Symbols have
32 bits in memory; the stream and the rules are stored in 16 where that suffices. A block stores its rules, the
expansion length of every nonterminal, the stream of symbols, and where each document's symbols end, so that one
document, or one id of it, is decoded alone.

The files are a Parquet table with one row a block, which Spark's committer writes whole or not at all.

Defined results: documents lie in ascending order of doc_id, nulls first, rows of equal doc_id by
their text (equal rows are alike, so their order shows nowhere); a null or empty text has the end id alone; an empty input gives
no blocks and no rows; extra columns are left out; ids of any vocabulary below 2^31 are kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .token_codec import codec

BLOCK_IDS, SLOT_BITS, MIN_COUNT = 3_000_000, 19, 24
BLOCK_SCHEMA = "shard int, block int, first long, n_ids long, doc_ids array<long>, doc_ends binary, doc_tokens binary, terminals int, rounds array<int>, width int, rules binary, lengths binary, stream binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _frequent(key: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which keys occur so often: the places of these in key, the number of the pair at each, and the pairs, the most frequent first.

    Exact: a hash table counts one pair a slot; places of other pairs are sorted where their slot has enough of them."""
    bits = min(SLOT_BITS, max(8, len(key).bit_length()))
    slot = ((key * _ODD) >> np.uint64(64 - bits)).astype(np.int32)
    holder = np.zeros(1 << bits, np.uint64)
    holder[slot] = key
    same = holder[slot] == key
    own = slot[same]
    count = np.bincount(own, minlength=len(holder))
    often = count >= min_count
    hit = np.flatnonzero(same)[often[own]]
    other = np.flatnonzero(~same)
    other = other[np.bincount(slot[other], minlength=len(holder))[slot[other]] >= min_count]
    pairs, number, n = np.unique(key[other], return_inverse=True, return_counts=True)
    first = np.flatnonzero(often)
    keys, counts = np.concatenate([holder[first], pairs]), np.concatenate([count[first], n])
    at_slot = np.zeros(len(holder), np.int32)
    at_slot[first] = np.arange(len(first))
    at, pair = np.concatenate([hit, other]), np.concatenate([at_slot[slot[hit]], len(first) + number])
    order = np.argsort(-counts, kind="stable")
    order = order[: int((counts >= min_count).sum())]
    rank = np.full(len(keys), -1, np.int32)
    rank[order] = np.arange(len(order))
    pair = rank[pair]
    at, pair = at[pair >= 0], pair[pair >= 0]
    by_place = np.argsort(at, kind="stable")
    return at[by_place], pair[by_place], keys[order]


def _chosen(at: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Which matches are replaced: of overlapping ones that of the more frequent pair, of one pair every second from the left."""
    joined = np.diff(at, prepend=-2) == 1
    start = np.flatnonzero(~joined | (np.diff(pair, prepend=-1) != 0))
    odd = (np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))) & 1
    live = odd == 0
    places, ranks = at[live], pair[live]
    near = np.diff(places) == 1
    best = np.ones(len(places), bool)
    best[1:] &= ~near | (ranks[1:] < ranks[:-1])
    best[:-1] &= ~near | (ranks[:-1] < ranks[1:])
    out = np.zeros(len(at), bool)
    out[np.flatnonzero(live)[best]] = True
    return out


def compress(ids: np.ndarray, doc_tokens: np.ndarray, terminals: int, min_count: int = MIN_COUNT) -> dict:
    """The grammar of ids, documents of doc_tokens ids each. Symbols below terminals are ids."""
    if len(ids) and int(ids.max()) >= terminals:
        raise ValueError(f"id {int(ids.max())} is not below {terminals}")
    seq = ids.astype(np.uint32)
    ends = np.cumsum(doc_tokens)[doc_tokens > 0] - 1  # where the last symbol of each document stands
    rules, bases = [np.zeros((0, 2), np.uint32)], [terminals]
    at = np.flatnonzero(np.bincount(ends, minlength=max(len(seq), 1))[: max(len(seq) - 1, 0)] == 0)
    while len(at):
        place, pair, keys = _frequent((seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1], min_count)
        place = at[place]
        take = _chosen(place, pair)
        used = np.bincount(pair[take], minlength=len(keys)) >= 2
        take &= used[pair]
        if not take.any():
            break
        number = (np.cumsum(used) - 1 + bases[-1]).astype(np.uint32)
        keys, gone = keys[used], place[take]
        rules.append(np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        bases.append(bases[-1] + len(keys))
        seq[gone] = number[pair[take]]
        keep = np.ones(len(seq), bool)
        keep[gone + 1] = False
        changed = ~keep
        changed[gone] = True
        # What can be frequent now: matches left over that still stand, and pairs with a new symbol.
        left = place[~take]
        left = left[~changed[left] & ~changed[left + 1]]
        if 8 * len(gone) > len(seq):
            moved = (np.cumsum(keep, dtype=np.int32) - np.int32(1)).__getitem__
        else:
            moved = lambda x, after=gone + 1: x - np.searchsorted(after, x, "right")
        seq = seq[keep]
        ends, new, left = moved(ends), moved(gone), moved(left)
        next_ = np.zeros(len(seq) + 1, bool)
        next_[left] = next_[new] = next_[new - 1] = True
        next_[ends] = next_[-1] = False
        at = np.flatnonzero(next_)
    rules = np.concatenate(rules)
    lengths = np.ones(bases[-1], np.int64)
    for lo, hi in zip(bases, bases[1:]):
        own = rules[lo - terminals : hi - terminals]
        lengths[lo:hi] = lengths[own[:, 0]] + lengths[own[:, 1]]
    doc_ends = np.zeros(len(doc_tokens), np.int64)
    doc_ends[doc_tokens > 0] = ends + 1
    doc_ends = np.maximum.accumulate(doc_ends) if len(doc_ends) else doc_ends
    width = 2 if bases[-1] <= 1 << 16 else 4
    return {"doc_ends": doc_ends.astype("<u4"), "doc_tokens": doc_tokens.astype("<u4"), "terminals": terminals, "rounds": bases, "width": width, "rules": rules.astype(f"<u{width}"), "lengths": lengths[terminals:].astype("<u4"), "stream": seq.astype(f"<u{width}")}


def _gathered(symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The entries of table that symbols stand for, one after another."""
    n = lengths[symbols]
    shift = first[symbols] - (np.cumsum(n) - n)
    return table[np.repeat(shift, n) + np.arange(int(n.sum()))]


def expand(stream: np.ndarray, rules: np.ndarray, bases: list[int], lengths: np.ndarray) -> np.ndarray:
    """The ids that stream stands for: the rules are spelled out once, round by round, then the stream by copies of them.

    A rule spans at least twice its length of the block, and those of one round never overlap, so their spelling is at most half a block a round."""
    first = np.arange(bases[-1], dtype=np.int64)
    parts, size = [np.arange(bases[0], dtype=np.uint32)], bases[0]
    for lo, hi in zip(bases, bases[1:]):
        first[lo:hi] = size + np.cumsum(lengths[lo:hi]) - lengths[lo:hi]
        parts = [np.concatenate(parts)]
        parts.append(_gathered(rules[lo - bases[0] : hi - bases[0]].ravel(), first, lengths, parts[0]))
        size += len(parts[-1])
    return _gathered(stream, first, lengths, np.concatenate(parts))


class Block:
    """A stored block, opened for reading."""

    def __init__(self, row: dict):
        self.row, self.doc_ids, self.bases = row, row["doc_ids"], list(row["rounds"])
        symbol = f"<u{row['width']}"
        self.rules = np.frombuffer(row["rules"], symbol).reshape(-1, 2)
        self.stream = np.frombuffer(row["stream"], symbol)
        self.doc_ends, self.doc_tokens = np.frombuffer(row["doc_ends"], "<u4"), np.frombuffer(row["doc_tokens"], "<u4")
        self.lengths = np.concatenate([np.ones(row["terminals"], np.int64), np.frombuffer(row["lengths"], "<u4").astype(np.int64)])

    def ids(self) -> np.ndarray:
        return expand(self.stream, self.rules, self.bases, self.lengths)

    def document(self, k: int) -> np.ndarray:
        """Ids of the block's k-th document, without touching the others: its nonterminals give way until none is left."""
        seq, terminals = self.stream[self.doc_ends[k - 1] if k else 0 : self.doc_ends[k]], self.bases[0]
        while len(at := np.flatnonzero(seq >= terminals)):
            out = np.repeat(seq, (seq >= terminals) + np.uint8(1))
            place = at + np.arange(len(at))
            out[place], out[place + 1] = self.rules[seq[at] - terminals].T
            seq = out
        return seq

    def id_at(self, k: int, position: int) -> int:
        """One id of the k-th document: by expansion lengths to its symbol, then down that symbol's rules."""
        own = self.stream[self.doc_ends[k - 1] if k else 0 : self.doc_ends[k]]
        ends = np.cumsum(self.lengths[own])
        n = int(np.searchsorted(ends, position, "right"))
        symbol, position = int(own[n]), position - (int(ends[n - 1]) if n else 0)
        while symbol >= self.bases[0]:
            left, right = map(int, self.rules[symbol - self.bases[0]])
            symbol, position = (left, position) if position < self.lengths[left] else (right, position - int(self.lengths[left]))
        return symbol


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes docs (null text: empty) in ascending doc_id order (nulls first) and writes the blocks; returns the table read back."""
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def encode(batches):
        own = codec(tokenizer_path)
        end, terminals = np.array([end_id], "<u4").tobytes(), own.library.get_vocab_size()
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids, parts, size = [], [], 0

        def flush():
            nonlocal block, first, ids, parts, size
            tokens = np.array([len(p) // 4 for p in parts], np.int64)
            row = compress(np.frombuffer(b"".join(parts), "<u4"), tokens, terminals)
            row = {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in row.items()}
            row |= {"shard": shard, "block": block, "first": first, "n_ids": int(tokens.sum()), "doc_ids": ids}
            block, first, ids, parts, size = block + 1, first + row["n_ids"], [], [], 0
            return pa.RecordBatch.from_pylist([row], BLOCK_ARROW)

        for b in batches:
            for doc_id, packed in zip(b.column(0).to_pylist(), own.packed_all(b.column(1).to_pylist())):
                packed += end
                ids.append(doc_id)
                parts.append(packed)
                size += len(packed) // 4
                if size >= block_ids:
                    yield flush()
        if ids:
            yield flush()

    return written(ordered.mapInArrow(encode, BLOCK_SCHEMA), "token-files")


BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.binary()), ("doc_tokens", pa.binary()), ("terminals", pa.int32()), ("rounds", pa.list_(pa.int32())), ("width", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()), ("stream", pa.binary())])


def read_token_files(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored document, by decoding the blocks."""
    # One sum a shard, and a shard is one task of the writer: as many rows as the writer had tasks.
    start, offsets = 0, []
    for shard, n in sorted(map(tuple, blocks.groupBy("shard").agg(F.sum("n_ids")).collect())):
        offsets.append((shard, start))
        start += n
    offsets = dict(offsets)

    def decode(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                raw = block.ids().astype("<u4")
                ends = np.cumsum(block.doc_tokens.astype(np.int64))
                starts = ends - block.doc_tokens
                crc = [zlib.crc32(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(starts + row["first"] + offsets[row["shard"]]), pa.array(block.doc_tokens.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
