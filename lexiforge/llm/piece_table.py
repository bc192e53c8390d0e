"""SentencePiece encoding and decoding through a table of distinct marked words.

The library replaces blanks by a marker, puts one in front of the text, and merges pieces. Where no piece of the
vocabulary has a marker after another character, no merge crosses from a word into the next marker: the text falls
into marked words (a run of markers and what follows).

1. Blocks of texts list their distinct marked words once and keep each text as places in that list.
2. The lists are dealt to buckets by the words' hash. A bucket holds all occurrences of its words, so each distinct word
   of all texts is segmented exactly once; the ids go back to the blocks.
3. Each block decodes the ids of each of its words once, and joins ids and decoded words by position: a text's ids are
   those of its words one after another and the end id, its decoded text is its decoded words with blanks between them.

What moves is compressed where it is made: a bucket's words go by frequency and a place is a word's rank there and then
its bucket, so that places of frequent words are small numbers, which are stored by planes of bytes.
Buckets and partitions grow with the bytes of the input, so that neither a bucket's words nor a block outgrow a worker.
Texts with a NUL character, and all texts if the vocabulary has crossing pieces or the normaliser changes more than
blanks, go to the library whole.

Defined results: null and empty texts have the end id alone and decode to the empty text; every row is taken for
itself, also with equal or null doc_id; an empty input gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, power_for, text_bytes, written_by

MARK = "▁"
#: A block of texts lists at most so many distinct words and tokens (one text more may exceed it).
BLOCK_WORDS, BLOCK_TOKENS = 600_000, 4_000_000
#: Bytes of text for each bucket of words.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 64, 1 << 16
BLOCKS = "block long, bucket int, words binary, doc_ids array<long>, sizes binary, places binary, wholes array<string>"
REPLIES = "of_block long, of_bucket int, counts binary, ids binary"


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_places(places: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, all first bytes, then all second ones, and so on."""
    return _pack(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack_places(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        # Blanks and all else are kept as they are, and the library puts a marker first.
        kept = sp.normalize(" a  Ａ\xa0\xbd ") == MARK * 2 + "a" + MARK * 2 + "Ａ\xa0\xbd" + MARK
        self.apart = kept and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.mark, self.end = sp.piece_to_id(MARK), sp.eos_id()

    def words(self, text: str) -> list[str] | None:
        """The marked words of text, each without its first marker; None if it must be encoded whole."""
        if not self.apart or "\0" in text:
            return None
        words, run = text.replace(MARK, " ").split(" "), 0
        if "" in words:  # runs of blanks belong to the word after them, those at the end are a word of their own
            parts, words = words, []
            for p in parts:
                if p:
                    words.append(" " * run + p)
                    run = 0
                else:
                    run += 1
            if run:
                words.append(" " * (run - 1))
        return words

    def ids(self, word: str) -> list[int]:
        """Ids of a marked word, given without its first marker; of the marker alone for the empty one."""
        return self.library.encode(word) if word else [self.mark]

    def encode(self, text: str | None) -> list[int]:
        """All ids of text with the end id, word by word."""
        if not text:
            return [self.end]
        words = self.words(text)
        if words is None:
            return [*self.library.encode(text), self.end]
        return [k for w in words for k in self.ids(w)] + [self.end]


@cache
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _blocks(docs: DataFrame, model_path: str, buckets: int, partitions: int) -> DataFrame:
    """The blocks, written: a row with the places of its texts' words (sizes: how many; -1 for a text that goes whole), and one for each bucket of its words."""

    def run(batches):
        own, block = piece_codec(model_path), TaskContext.get().partitionId() << 24
        places: dict[str, int] = {}
        texts: list[tuple] = []
        tokens = 0

        def flush():
            words = list(places)
            bucket = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) & np.uint64(buckets - 1)
            at = [t[1] for t in texts if t[1] is not None]
            every = np.concatenate(at) if at else np.zeros(0, np.uint32)
            order = np.lexsort((-np.bincount(every, minlength=len(words)), bucket))
            first = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets)) != 0)
            ends = [*first[1:].tolist(), len(words)]
            lists = [(int(bucket[order[lo]]), _pack("\0".join([words[k] for k in order[lo:hi].tolist()]).encode())) for lo, hi in zip(first.tolist(), ends)] if words else []
            m, code = len(lists), np.empty(len(words), np.uint32)
            code[order] = (np.arange(len(words)) - np.repeat(first, np.diff(first, append=len(words)))) * buckets + bucket[order].astype(np.int64)
            sizes = np.array([-1 if t[1] is None else len(t[1]) for t in texts], "<i4")
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(1 + m, block, np.int64)),
                pa.array([None, *(x[0] for x in lists)], pa.int32()),
                pa.array([None, *(x[1] for x in lists)], pa.binary()),
                pa.array([[t[0] for t in texts], *[None] * m], pa.list_(pa.int64())),
                pa.array([_pack(sizes.tobytes()), *[None] * m], pa.binary()),
                pa.array([_pack_places(code[every]), *[None] * m], pa.binary()),
                pa.array([[t[2] for t in texts if t[1] is None], *[None] * m], pa.list_(pa.string())),
            ], ["block", "bucket", "words", "doc_ids", "sizes", "places", "wholes"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = own.words(text) if text else []
                if words is None:
                    texts.append((doc_id, None, text))
                    tokens += len(text)
                else:
                    texts.append((doc_id, np.fromiter([places.setdefault(w, len(places)) for w in words], np.uint32, len(words)), None))
                    tokens += len(words) + 1
                if len(places) >= BLOCK_WORDS or tokens >= BLOCK_TOKENS:
                    yield flush()
                    block, places, texts, tokens = block + 1, {}, [], 0
        if texts:
            yield flush()

    return written_by(docs.select("doc_id", "text").mapInArrow(run, BLOCKS), "piece-blocks", "block", partitions)


def _segmented(lists: DataFrame, model_path: str, partitions: int) -> DataFrame:
    """REPLIES to the lists: of each word the number of its ids, the ids, and the decoded word. Each distinct word is segmented once."""

    def run(batches):
        own, now, known = piece_codec(model_path), None, {}
        kind = "<u2" if own.library.vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            out = []
            for block, bucket, blob in zip(*(b.column(k).to_pylist() for k in range(3))):
                if bucket != now:
                    now, known = bucket, {}
                words = _unpack(blob).decode().split("\0")
                new = [w for w in words if w not in known]
                ids = [own.ids(w) for w in new]
                for w, x in zip(new, ids):
                    known[w] = (len(x), np.array(x, kind).tobytes())
                found = [known[w] for w in words]
                out.append((block, bucket, _pack_places(np.array([f[0] for f in found])), _pack(b"".join([f[1] for f in found]))))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], [x.split()[0] for x in REPLIES.split(", ")])

    dealt = lists.select("block", "bucket", "words").repartition(partitions, "bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(run, REPLIES)


def _joined(docs: DataFrame, model_path: str, each, schema: str, arrow: pa.Schema) -> DataFrame:
    """each(doc_id, ids of the text's words as decimal texts or None, decoded words or None, the whole text or None, codec) for every row of docs."""
    size = text_bytes(docs)
    buckets = power_for(size, BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS)
    partitions = partitions_for(docs.sparkSession, size)
    blocks = _blocks(docs, model_path, buckets, partitions)
    replies = _segmented(blocks.filter("bucket is not null"), model_path, partitions)
    texts = blocks.filter("bucket is null").select("block", "doc_ids", "sizes", "places", "wholes")

    def join(texts_of: pa.Table, replies_of: pa.Table) -> pa.Table:
        own = piece_codec(model_path)
        kind = "<u2" if own.library.vocab_size() <= 1 << 16 else "<u4"
        spelled: list[str] = []
        decoded: list[str] = []
        numbers = list(map(str, range(own.library.vocab_size())))
        base = np.zeros(buckets, np.int64)
        for row in replies_of.to_pylist():
            ids, ends = np.frombuffer(_unpack(row["ids"]), kind).tolist(), np.cumsum(_unpack_places(row["counts"])).tolist()
            base[row["of_bucket"]] = len(spelled)
            words = [ids[s:e] for s, e in zip([0, *ends], ends)]
            spelled += [" ".join([numbers[k] for k in w]) for w in words]
            decoded += own.library.decode(words, num_threads=1)
        out = []
        for row in texts_of.to_pylist():
            code, start, wholes = _unpack_places(row["places"]), 0, iter(row["wholes"])
            at = (base[code % buckets] + code // buckets).tolist()
            for doc_id, n in zip(row["doc_ids"], np.frombuffer(_unpack(row["sizes"]), "<i4").tolist()):
                if n < 0:
                    out.append(each(doc_id, [], [], next(wholes), own))
                else:
                    own_places = at[start : start + n]
                    start += n
                    out.append(each(doc_id, [spelled[k] for k in own_places], [decoded[k] for k in own_places], None, own))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    # The texts lie in buckets of their block already; only the replies move.
    return texts.groupBy("block").cogroup(replies.repartition(partitions, "of_block").groupBy("of_block")).applyInArrow(join, schema)


def _spelled(words: list[str], decoded: list[str], whole: str | None, own: PieceCodec) -> tuple[str, str]:
    """The ids as decimal text, the end id last, and the decoded text."""
    if whole is not None:
        ids = [*own.library.encode(whole), own.end]
        return " ".join(map(str, ids)), own.library.decode(ids)
    return " ".join([*words, str(own.end)]), " ".join(decoded)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (with the end id), and the text that the library decodes from them."""

    def each(doc_id, words, decoded, whole, own):
        ids, text = _spelled(words, decoded, whole, own)
        return doc_id, list(map(int, ids.split(" "))), text

    return _joined(docs, model_path, each, "doc_id long, ids array<int>, decoded string", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """encode_decode() with the ids and the decoded text as digests, so that neither leaves the worker."""

    def each(doc_id, words, decoded, whole, own):
        ids, text = _spelled(words, decoded, whole, own)
        return doc_id, ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _joined(docs, model_path, each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))
