"""Packing documents into sequences: best fit, then local search by swaps.

Documents are cut into pieces of at most the capacity; full pieces are sequences of their own. The others are dealt
at random into blocks of a bounded number of pieces, and each block is packed alone: best fit, longest first, then a
local search over the underfull bins that moves pieces and exchanges one for one or two for one, always raising the
sum of squared fills, so that the least filled bins empty. What is left in the underfull bins of all blocks is dealt
into fewer blocks and packed once more. The local search ends when no exchange of its neighbourhood helps.

pack_documents() tells each piece its place; packed_sequences() gives the sequences with their ids.

Defined results: a null text is an empty document of its end id alone; rows are taken each for itself, also with
equal or null doc_id; an empty input gives no rows; extra columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .token_codec import codec

#: Entries of the token table: in the pipeline a worker holds the tables of other stages too.
TABLE = 250_000
CAPACITY, BLOCK_PIECES, DONORS = 4096, 8192, 24
PIECES = "doc_id long, piece int, start long, length long, ids binary, ordinal long"
PLACED = "ordinal long, length long, bin long, offset long, fill long"


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into lengths: each, longest first, goes to the fullest bin with room for it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has r left
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY, donors: int = DONORS) -> list[list[int]]:
    """Raises the sum of squared fills by exchanges between underfull bins until the least filled ones empty or none helps.

    Each exchange raises that sum, so it ends. The donors are the least filled bins; two pieces that go for one are near each other in size."""
    fill = [sum(lengths[k] for k in b) for b in bins]
    while True:
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        giving, changed = under[:donors], False
        if len(under) < 2 or sum(capacity - fill[b] for b in under) < fill[under[0]]:
            break  # all room together would not empty one bin
        for to in reversed(under):
            pool = sorted((lengths[k], k, b) for b in giving if b != to and fill[b] <= fill[to] for k in bins[b])
            while pool and (gap := capacity - fill[to]) > 0:
                best = None  # (gain, what comes, what goes)
                at = bisect_right(pool, (gap, 1 << 60)) - 1
                if at >= 0:
                    best = (pool[at][0], pool[at], ())
                own = sorted(bins[to], key=lambda k: lengths[k])
                for i, k in enumerate(own):
                    goes = [(k,)] + [(k, j) for j in own[i + 1 : i + 4]]
                    for out in goes:
                        n = sum(lengths[x] for x in out)
                        at = bisect_right(pool, (n + gap, 1 << 60)) - 1
                        if at >= 0 and pool[at][0] > n and (best is None or pool[at][0] - n > best[0]):
                            best = (pool[at][0] - n, pool[at], out)
                if best is None:
                    break
                gain, (n, k, source), out = best
                del pool[bisect_left(pool, (n, k, source))]
                bins[source].remove(k)
                for x in out:
                    bins[to].remove(x)
                    bins[source].append(x)
                    insort(pool, (lengths[x], x, source))
                bins[to].append(k)
                fill[to] += gain
                fill[source] -= gain
                changed = True
                if len(out) and gap == gain:
                    break
        if not changed:
            break
    return [b for b in bins if b]


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the encoded documents: only documents over the capacity are cut."""

    def cut(batches):
        packed, end = codec(tokenizer_path, TABLE).packed_all, np.array([end_id], "<u4").tobytes()
        ordinal = TaskContext.get().partitionId() << 40
        step = 4 * capacity
        for b in batches:
            out = []
            for doc_id, ids in zip(b.column(0).to_pylist(), packed(b.column(1).to_pylist())):
                ids = memoryview(ids + end)
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc_id, piece, at // 4, len(part) // 4, bytes(part), ordinal))
                    ordinal += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids", "ordinal"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _pack_blocks(pieces: DataFrame, blocks: int, round_no: int, capacity: int) -> DataFrame:
    """ordinal and length of pieces, dealt at random into blocks, each packed alone; bin, offset and the bin's fill are added."""

    def pack(key, frame):
        frame = frame.sort_values("ordinal", kind="stable").reset_index(drop=True)
        lengths = frame["length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        order = np.concatenate([np.array(b, np.int64) for b in bins])
        sizes = frame["length"].to_numpy()[order]
        of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        first = np.r_[True, of[1:] != of[:-1]]
        before = np.cumsum(sizes) - sizes
        fills = np.bincount(of, sizes).astype(np.int64)
        return frame.iloc[order].assign(bin=(round_no << 60) + (int(key[0]) << 24) + of, offset=before - np.repeat(before[first], np.bincount(of)), fill=fills[of])[[c.split()[0] for c in PLACED.split(", ")]]

    block = F.pmod(F.xxhash64("ordinal", F.lit(round_no)), F.lit(blocks))
    return pieces.withColumn("block", block).groupBy("block").applyInPandas(lambda key, f: pack(key, f.drop(columns="block")), PLACED)


def placed(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """ordinal, sequence_id and offset of every one of pieces (ordinal, length)."""
    part = pieces.select("ordinal", "length").filter(F.col("length") < capacity)
    packed = written(_pack_blocks(part, max(1, -(-part.count() // block_pieces)), 1, capacity), "packed")
    # Bins that local search couldn't fill up to a hundredth of the capacity meet those of other blocks.
    loose = packed.filter(F.col("fill") * 100 < capacity * 99)
    n = loose.count()
    again = _pack_blocks(loose.select("ordinal", "length"), max(1, -(-n // block_pieces)), 2, capacity)
    whole = pieces.filter(F.col("length") >= capacity).select("ordinal", (F.lit(3 << 60) + F.col("ordinal")).alias("bin"), F.lit(0).cast("long").alias("offset"))
    every = packed.filter(F.col("fill") * 100 >= capacity * 99).select("ordinal", "bin", "offset").unionAll(again.select("ordinal", "bin", "offset")).unionAll(whole)
    return every.withColumnRenamed("bin", "sequence_id")


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """cut_documents(), written: the texts are encoded once."""
    return written(cut_documents(docs, tokenizer_path, end_id, capacity), "pieces")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = pieces_of(docs, tokenizer_path, end_id, capacity)
    rows = pieces.select("ordinal", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return rows.join(placed(pieces, capacity, block_pieces), "ordinal").drop("ordinal")


def packed_sequences(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian unsigned 32-bit) and pieces (doc_id, piece, offset, length) of every sequence.

    A sequence holds at most capacity tokens, so its row is bounded."""
    pieces = pieces_of(docs, tokenizer_path, end_id, capacity)
    rows = pieces.join(placed(pieces, capacity, block_pieces), "ordinal")
    rows = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("x"))
    ids = F.unhex(F.array_join(F.transform("x", lambda p: F.hex(p["ids"])), ""))
    pieces_in = F.transform("x", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return rows.select("sequence_id", F.aggregate("x", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"), ids.alias("ids"), pieces_in.alias("pieces"))
