"""N-gram Jaccard join by filters under several global token orders.

Texts are sets of word shingles. Two sets as similar as the threshold share, under any order of all shingles, a shingle
among the first n - ceil(threshold * n) + 1 of each. All orders used put first the shingles that no other text has;
after these one order goes by frequency, rare ones first, and two by different hashes alone. Prefixes so consist mostly
of shingles that can't be shared, and most texts have no candidate at all. A pair is verified only if its prefixes
meet under every order, in whichever of the two ways below it is compared.

1. Equal texts become one (by digest). Each block of texts deals its shingles to buckets by hash, where the number
   of texts of each is counted; only shingles of two texts or more come back. (The others count by the set's size, as
   they can neither be shared nor lead to a candidate.) A shingle that many texts of a block share is sent once a block.
   The number of buckets and of partitions grows with the bytes of the input.
2. Texts whose prefix holds shared shingles are listed under these. Of each list the first text is compared with all;
   linked texts join components. Where a long list keeps several components, further pivots outside its main one are
   compared for some rounds. At last the texts outside the main component are compared with all of the list: short
   lists pair by pair, but for pairs of one component and those that the triangle inequality of the Jaccard distance
   keeps apart; long lists in blocks against blocks, where the prefixes of every order are multiplied first and only
   pairs that meet under all are verified, of which only links that join two components come back. So
   no link between components is lost, and groups of near copies never become rows of all their pairs.
   Lists and components that hold much of the input are dealt over many tasks.

Defined results: texts without words (null, empty, blank) have n_shingles 0 and are linked with nothing; rows of equal or null
doc_id are taken each for itself, and a component's id is the smallest doc_id in it (null only if all are); an empty
input gives no rows; extra columns are left out (keep_one() keeps all of them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, lower_ascii, partitions_for, power_for, split_words, spread_join, text_bytes, unused, written

WORDS, SIMILARITY = 5, 75
BLOCK_TOKENS, BLOCK_TEXTS, HOT, SHORT_LIST, PIVOT_ROUNDS, SIDE = 1_500_000, 4000, 64, 32, 2, 256
#: Bytes of text for each bucket of shingles.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 4 << 20, 256, 1 << 16
#: Longer words are hashed each time, so that the table of hashes is bounded in bytes.
LONGEST_KEPT = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers, one for each order: they hash shingles to their place, in the first order only among those of one frequency.
ORDERS = (np.uint64(1), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST_KEPT:
            self[word] = h
        return h


_hash = _Hashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of text; of the whole sequence if it is shorter."""
    own = split_words(lower_ascii(text or ""))
    if not own:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(_hash.__getitem__, own), np.uint64, len(own))
    k = min(words, len(x))
    n = len(x) - k + 1
    h = x[:n] * np.uint64(k)
    for i in range(1, k):
        h ^= h >> np.uint64(29)
        h *= _MIX
        h += x[i : i + n]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def prefix_length(n, similarity: int = SIMILARITY):
    return n + (-n * similarity) // 100 + 1


BLOCKS = "bucket int, block long, tokens binary, counts binary, hot binary, hot_counts binary, digests binary, sizes binary"
REPLIES = "block long, owners binary, tokens binary, dfs binary, digests binary, sizes binary, hot binary, hot_counts binary, hot_owners binary"
SETS = "cid long, digest binary, n long, tokens array<long>, prefix0 array<long>, prefix1 array<long>, prefix2 array<long>"


def _deal(texts: DataFrame, buckets: int, words: int) -> DataFrame:
    """Blocks of texts: a row for each bucket with the shingles dealt to it, and one (negative bucket) with the block itself."""

    def run(batches):
        block = TaskContext.get().partitionId() << 20
        digests, sets, size = [], [], 0

        def flush():
            n = np.array([len(s) for s in sets], np.uint32)
            token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), n)
            ordered = np.sort(token)
            start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
            run_length = np.diff(np.r_[start, len(ordered)])
            often = run_length >= HOT
            hot, hot_n = ordered[start[often]], run_length[often].astype(np.uint32)
            hot_owner = np.zeros(0, np.uint32)
            if len(hot):
                is_hot = np.isin(token, hot)
                hot_owner = owner[is_hot][np.argsort(token[is_hot], kind="stable")]
                token, owner = token[~is_hot], owner[~is_hot]
            of = lambda t: t >> np.uint64(65 - buckets.bit_length())  # noqa: E731  the leading bits
            bucket = of(token).astype(np.uint32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            token, owner = token[order], owner[order]
            ends, hot_ends = np.searchsorted(bucket[order], np.arange(buckets + 1)), np.searchsorted(of(hot), np.arange(buckets + 1))
            rows = [{"bucket": -1 - block % buckets, "block": block, "tokens": hot_owner.tobytes(), "digests": b"".join(digests), "sizes": n.tobytes(), "hot": hot.tobytes(), "hot_counts": hot_n.tobytes()}]
            for b in range(buckets):
                s, e, hs, he = ends[b], ends[b + 1], hot_ends[b], hot_ends[b + 1]
                if e > s or he > hs:
                    rows.append({"bucket": b, "block": block, "tokens": _short(token[s:e]), "counts": np.bincount(owner[s:e], minlength=len(n)).astype(np.uint16).tobytes() if e - s < 65536 else np.bincount(owner[s:e], minlength=len(n)).astype(np.uint32).tobytes(), "hot": hot[hs:he].tobytes(), "hot_counts": hot_n[hs:he].tobytes(), "sizes": None, "digests": None})
            return pa.RecordBatch.from_pylist(rows, pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in BLOCKS.split(", ")]))

        for b in batches:
            for digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                digests.append(digest)
                sets.append(shingles(text, words))
                size += len(sets[-1])
                if size >= BLOCK_TOKENS or len(sets) >= BLOCK_TEXTS:
                    yield flush()
                    block, digests, sets, size = block + 1, [], [], 0
        if sets:
            yield flush()

    return texts.mapInArrow(run, BLOCKS)


def _short(tokens: np.ndarray) -> bytes:
    """The lower seven bytes of each: the bucket, a power of two and 256 at least, has the rest."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _long(packed: bytes, bucket: int, buckets: int) -> np.ndarray:
    out = np.zeros((len(packed) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(packed, np.uint8).reshape(-1, 7)
    out[:, 7] = bucket >> (buckets.bit_length() - 9)
    return out.reshape(-1).view(np.uint64)


def _frequencies(table: pa.Table, buckets: int) -> pa.Table:
    """Of a bucket: the shingles of two texts or more, with their number of texts, back to each block. Blocks' own rows pass."""
    rows, out = table.to_pylist(), []
    if rows[0]["bucket"] < 0:
        out = [{"block": r["block"], "digests": r["digests"], "sizes": r["sizes"], "hot": r["hot"], "hot_counts": r["hot_counts"], "hot_owners": r["tokens"]} for r in rows]
    else:
        cold, hot = [_long(r["tokens"], r["bucket"], buckets) for r in rows], [np.frombuffer(r["hot"], np.uint64) for r in rows]
        weight = np.concatenate([np.ones(sum(map(len, cold)), np.int64), *[np.frombuffer(r["hot_counts"], np.uint32).astype(np.int64) for r in rows]])
        every = np.concatenate([*cold, *hot])
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        total = np.add.reduceat(weight[order], start)
        df = np.empty(len(every), np.int64)
        df[order] = np.repeat(total, np.diff(np.r_[start, len(ordered)]))
        df = np.minimum(df, 0xFFFFFFFF).astype(np.uint32)
        at, hot_at = 0, sum(map(len, cold))
        for r, c, h in zip(rows, cold, hot):
            counts = np.frombuffer(r["counts"], np.uint16 if len(c) < 65536 else np.uint32) if r["counts"] else np.zeros(0, np.uint16)
            own, shared = df[at : at + len(c)], df[at : at + len(c)] >= 2
            owner = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)[shared]
            out.append({"block": r["block"], "owners": np.r_[owner, np.full(len(h), 0xFFFFFFFF, np.uint32)].tobytes(), "tokens": np.r_[c[shared], h].tobytes(), "dfs": np.r_[own[shared], df[hot_at : hot_at + len(h)]].tobytes()})
            at, hot_at = at + len(c), hot_at + len(h)
    return pa.Table.from_pylist(out, pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.binary()) for x in REPLIES.split(", ")]))


def _assemble(similarity: int):
    """Of a block: its sets, each with its size; those with shared shingles in their prefix also with all that they share."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["sizes"] is not None)
        get = lambda k, t: np.concatenate([np.frombuffer(r[k], t) for r in rows if r["owners"] is not None] or [np.zeros(0, t)])
        owner, token, df = get("owners", np.uint32), get("tokens", np.uint64), get("dfs", np.uint32)
        hot, hot_n, hot_owner = np.frombuffer(own["hot"], np.uint64), np.frombuffer(own["hot_counts"], np.uint32), np.frombuffer(own["hot_owners"], np.uint32)
        if len(hot):
            marked = owner == 0xFFFFFFFF
            hot_df = np.zeros(len(hot), np.uint32)
            hot_df[np.searchsorted(hot, token[marked])] = df[marked]
            owner, token, df = np.r_[owner[~marked], hot_owner], np.r_[token[~marked], np.repeat(hot, hot_n)], np.r_[df[~marked], np.repeat(hot_df, hot_n)]
        n = np.frombuffer(own["sizes"], np.uint32).astype(np.int64)
        shared = np.bincount(owner, minlength=len(n))
        inside = prefix_length(n, similarity) - (n - shared)  # so many of the prefix are shared, as single ones come first
        order = np.argsort(owner, kind="stable")
        token, df, ends = token[order], df[order], np.cumsum(shared)
        columns: list[list] = [[], [], [], []]
        for k in range(len(n)):
            if n[k] == 0 or inside[k] <= 0 or shared[k] == 0:
                for c in columns:
                    c.append(None)
                continue
            at = slice(ends[k] - shared[k], ends[k])
            t, d, q = token[at], df[at], int(min(inside[k], shared[k]))
            columns[0].append(np.sort(t).view(np.int64))
            columns[1].append(t[np.lexsort((t * ORDERS[0], d))[:q]].view(np.int64))
            for c, odd in zip(columns[2:], ORDERS[1:]):
                c.append(t[np.argsort(t * odd, kind="stable")[:q]].view(np.int64))
        digests, width = own["digests"], len(own["digests"]) // max(len(n), 1)
        return pa.table([pa.array((own["block"] << 12) + np.arange(len(n))), pa.array([digests[i : i + width] for i in range(0, len(digests), width)], pa.binary()), pa.array(n), *[pa.array(c, pa.list_(pa.int64())) for c in columns]], names=["cid", "digest", "n", "tokens", "prefix0", "prefix1", "prefix2"])

    return run


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (cid, label), written, after all components that links (a, b) connect have become one (the smallest label)."""
    ends = lambda x, y: links.join(labels.select(F.col("cid").alias("a"), F.col("label").alias(x)), "a").join(labels.select(F.col("cid").alias("b"), F.col("label").alias(y)), "b")
    edges = written(ends("u", "v").filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v"))
        up = written(up.join(up.select(F.col("u").alias("v"), F.col("v").alias("w")), "v", "left").select("u", F.coalesce("w", "v").alias("w")), "parents")
        moves = written(labels.groupBy("label").agg(F.count(F.lit(1)).alias("copies")).join(up.select(F.col("u").alias("label"), "w"), "label"), "moves")
        labels = written(spread_join(labels, moves, ["label"], "copies", F.col("cid"), "left").select("cid", F.coalesce("w", "label").alias("label")), "labels")
        moved = edges.join(up, "u", "left").select(F.coalesce("w", "u").alias("x"), "v").join(up.select(F.col("u").alias("v"), F.col("w").alias("y")), "v", "left").select("x", F.coalesce("y", "v").alias("y"))
        edges = written(moved.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
    return labels


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """a, b, distance, linked of those pairs (a < b) that pass the filters of size and of every order; written."""
    side = lambda x: sets.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "tokens", "prefix0", "prefix1", "prefix2")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    for k in range(len(ORDERS)):
        both = both.filter(F.arrays_overlap(f"prefix{k}_a", f"prefix{k}_b"))
    both = both.select("a", "b", F.col("n_a").alias("n_a"), F.col("n_b").alias("n_b"), F.size(F.array_intersect("tokens_a", "tokens_b")).alias("common"))
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return written(both.select("a", "b", (1 - F.col("common") / union).alias("distance"), (100 * F.col("common") >= similarity * union).alias("linked")), "verified")


def _ordered_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _counted(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, int]:
    """All tokens of a column of lists in ascending order, the row of each, and the number of rows."""
    token = rows[column].combine_chunks()
    owner = np.repeat(np.arange(len(token)), np.diff(token.offsets.to_numpy()))
    flat = token.flatten().to_numpy()
    order = np.argsort(flat, kind="stable")
    return flat[order], owner[order], len(token)


def _of_rows(x: tuple, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """_counted() of the rows to keep."""
    token, owner, _ = x
    live = keep[owner]
    return token[live], (np.cumsum(keep) - 1)[owner[live]], int(keep.sum())


def common_tokens(x: tuple, y: tuple, width: int = 4096) -> np.ndarray:
    """The intersection size of every set of x with every one of y, as products of slices of their token matrices."""
    both = np.intersect1d(x[0], y[0])
    out = np.zeros((x[2], y[2]), np.float32)
    for at in range(0, len(both), width):
        own = both[at : at + width]
        sides = []
        for token, owner, n in (x, y):
            lo, hi = np.searchsorted(token, own[0]), np.searchsorted(token, own[-1], "right")
            column = np.searchsorted(own, token[lo:hi])
            hit = own[column] == token[lo:hi]
            m = np.zeros((n, len(own)), np.float32)
            m[owner[lo:hi][hit], column[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _block_links(rest: DataFrame, now: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between components, of texts of rest with others of their lists, by blocks of either; written.

    Lists with one pivot overlap nearly wholly, so they are taken together. No more than a spanning forest of the components comes from each pair of blocks."""
    x, y = rest.select("pivot", "cid", "label").distinct(), now.select("pivot", "cid", "label").distinct()
    blocks = lambda df, name: df.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias(name))
    number = blocks(x, "nx").join(blocks(y, "ny"), "pivot")
    tokens = sets.select("cid", "n", "tokens", "prefix0", "prefix1", "prefix2")
    place = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n)).cast("int")
    columns = ["n", "tokens", "prefix0", "prefix1", "prefix2"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = x.join(number, "pivot").join(tokens, "cid").withColumn("i", place("nx", 1)).withColumn("j", every("ny")).select("pivot", "i", "j", "cid", "label", *columns)
    y = y.join(number, "pivot").join(tokens, "cid").withColumn("j", place("ny", 2)).withColumn("i", every("nx")).select("pivot", "i", "j", "cid", "label", *columns)
    y = y.toDF("y_pivot", "y_i", "y_j", "cid", "label", *columns)

    def compare(xs: pa.Table, ys: pa.Table) -> pa.Table:
        a, b = [], []
        if xs.num_rows and ys.num_rows:
            nx, ny = xs["n"].to_numpy(), ys["n"].to_numpy()
            lx, ly = xs["label"].to_numpy(), ys["label"].to_numpy()
            cx, cy = xs["cid"].to_pylist(), ys["cid"].to_pylist()
            candidate = (100 * np.minimum(nx[:, None], ny[None]) >= similarity * np.maximum(nx[:, None], ny[None])) & (lx[:, None] != ly[None])
            for k in range(len(ORDERS)):
                rows, others = candidate.any(1), candidate.any(0)
                if not rows.any():
                    break
                met = common_tokens(_of_rows(_counted(xs, f"prefix{k}"), rows), _of_rows(_counted(ys, f"prefix{k}"), others)) > 0
                candidate[np.ix_(rows, others)] &= met
            rows, others = np.flatnonzero(candidate.any(1)), np.flatnonzero(candidate.any(0))
            common = common_tokens(_of_rows(_counted(xs, "tokens"), candidate.any(1)), _of_rows(_counted(ys, "tokens"), candidate.any(0))).astype(np.int64)
            union = nx[rows][:, None] + ny[others][None] - common
            linked = candidate[np.ix_(rows, others)] & (100 * common >= similarity * union)
            parent: dict[int, int] = {}

            def root(k: int) -> int:
                while parent.get(k, k) != k:
                    k = parent[k]
                return k

            for i, j in zip(*np.nonzero(linked)):
                i, j = int(rows[i]), int(others[j])
                u, v = root(int(lx[i])), root(int(ly[j]))
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    a.append(cx[i])
                    b.append(cy[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return written(x.groupBy("pivot", "i", "j").cogroup(y.groupBy("y_pivot", "y_i", "y_j")).applyInArrow(compare, "a long, b long"), "block-links")


def text_sets(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """SETS of the distinct texts of docs, written."""
    size = text_bytes(docs)
    buckets, partitions = power_for(size, BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS), partitions_for(docs.sparkSession, size)
    texts = docs.filter(F.col("text").isNotNull()).select(F.unhex(F.sha2("text", 256)).alias("digest"), "text").groupBy("digest").agg(F.first("text").alias("text"))
    dealt = _deal(texts, buckets, words).repartition(partitions, "bucket")
    replies = written(dealt.groupBy("bucket").applyInArrow(lambda t: _frequencies(t, buckets), REPLIES), "shingles")
    return written(replies.repartition(partitions, "block").groupBy("block").applyInArrow(_assemble(similarity), SETS), "sets")


def components(sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """cid, label of the sets with candidates: those linked directly or through others share a label."""
    alive = sets.filter("tokens is not null")
    lists = written(alive.select("cid", F.explode("prefix0").alias("token")), "lists")
    pivots = written(lists.groupBy("token").agg(F.min("cid").alias("pivot"), F.count(F.lit(1)).alias("listed")).filter("listed > 1"), "pivots")
    lists = written(spread_join(lists, pivots, ["token"], "listed", F.col("cid")), "lists")
    labels = written(alive.select("cid", F.col("cid").alias("label")), "labels")
    first = _verified(_ordered_pairs(lists.filter("cid <> pivot"), "cid", "pivot"), alive, similarity)
    labels, known = relabel(labels, first.filter("linked")), first
    for k in range(PIVOT_ROUNDS + 1):
        now = lists.join(labels, "cid")
        counts = now.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
        mains = written(counts.groupBy("token").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("listed")).filter("listed > top.n").select("token", F.col("top.label").alias("main"), "listed"), "mains")
        if mains.isEmpty():
            break
        rest = spread_join(now, mains.withColumn("copies", F.col("listed")), ["token"], "copies", F.col("cid")).filter("label <> main")
        long = rest.filter(F.col("listed") > SHORT_LIST)
        if k < PIVOT_ROUNDS and not long.isEmpty():
            # Two further pivots a list, from outside its main component; those tried before differ, as the hash does.
            h = F.xxhash64("cid", F.lit(k))
            ends = long.groupBy("token").agg(F.min(F.struct(h.alias("h"), "cid", "label")).alias("p"), F.max(F.struct(h.alias("h"), "cid", "label")).alias("q"))
            ends = ends.select("token", F.explode(F.array("p", "q")).alias("p")).select("token", F.col("p.cid").alias("p"), F.col("p.label").alias("p_label")).distinct()
            ends = written(ends.groupBy("token").agg(F.collect_list(F.struct("p", "p_label")).alias("ends")).join(mains.select("token", "listed"), "token"), "ends")
            met = spread_join(now, ends, ["token"], "listed", F.col("cid")).withColumn("e", F.explode("ends")).select("cid", "label", "e.p", "e.p_label")
            pairs = _ordered_pairs(met.filter("label <> p_label"), "cid", "p").join(known.select("a", "b"), ["a", "b"], "left_anti")
            new = _verified(pairs, alive, similarity)
            labels, known = relabel(labels, new.filter("linked")), known.unionAll(new)
            continue
        # All that is left: texts outside the main component against the whole list.
        joined = _block_links(long, now.join(mains.filter(F.col("listed") > SHORT_LIST).select("token"), "token", "left_semi"), alive, similarity)
        rest, short = rest.filter(F.col("listed") <= SHORT_LIST), mains.filter(F.col("listed") <= SHORT_LIST)
        to_pivot = first.select("a", "b", "distance")
        far = lambda df: df.withColumns({"a": F.least("cid", "pivot"), "b": F.greatest("cid", "pivot")}).join(to_pivot, ["a", "b"], "left").withColumn("distance", F.when(F.col("cid") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("distance"))).drop("a", "b", "pivot")
        x = far(rest.select("token", "cid", "pivot", "label", "main")).select("token", F.col("cid").alias("x"), F.col("label").alias("x_label"), F.col("distance").alias("x_far"), "main")
        y = far(now.join(short.select("token"), "token", "left_semi")).select("token", F.col("cid").alias("y"), F.col("label").alias("y_label"), F.col("distance").alias("y_far"))
        apart = F.coalesce(F.abs(F.col("x_far") - F.col("y_far")) > (100 - similarity) / 100 + 1e-9, F.lit(False))
        pairs = x.join(y, "token").filter((F.col("x_label") != F.col("y_label")) & ((F.col("y_label") == F.col("main")) | (F.col("x") < F.col("y"))) & ~apart)
        pairs = _ordered_pairs(pairs, "x", "y").join(known.select("a", "b"), ["a", "b"], "left_anti")
        labels = relabel(labels, _verified(pairs, alive, similarity).filter("linked").select("a", "b").unionAll(joined))
        break
    return labels


def _members(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """doc_id, digest, n, label (null without words) of every row of docs, written."""
    sets = text_sets(docs, words, similarity)
    rows = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    classes = sets.join(components(sets, similarity), "cid", "left").select("digest", "n", F.when(F.col("n") > 0, F.coalesce("label", "cid")).alias("label"))
    classes = written(classes.join(copies, "digest"), "classes")
    return written(spread_join(rows, classes, ["digest"], "copies", F.col("doc_id"), "left"), "members")


def jaccard_components(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    rows = _members(docs, words, similarity)
    least = written(rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("copies")), "least")
    joined = spread_join(rows, least, ["label"], "copies", F.struct("doc_id", "digest"), "left")
    return joined.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """docs without all but one row of each component: the row of the smallest doc_id stays (null after all others, then the smallest
    digest of its text; rows equal in both are one). Rows without words all stay. All columns are kept as they are."""
    rows = _members(docs, words, similarity).filter("label is not null")
    heads = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("head")).select("head.doc_id", "head.digest")
    rows = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    heads = written(heads.alias("h").join(rows.alias("r"), (F.col("h.digest") == F.col("r.digest")) & F.col("h.doc_id").eqNullSafe(F.col("r.doc_id"))).select("h.doc_id", "h.digest", "rows"), "heads")
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(f"[^{SPACES}]")
    place = lambda: F.xxhash64("doc_id", "digest")  # noqa: E731  copies of one text have many places
    name = unused(docs.columns, "digest")
    found = docs.filter(worded).withColumn(name, F.unhex(F.sha2("text", 256)))

    def kept(heads_of: DataFrame) -> DataFrame:
        h = heads_of.select(F.col("doc_id").alias("h_id"), F.col("digest").alias("h_digest"), place().alias("h_place"))
        on = (F.xxhash64(found["doc_id"], found[name]) == h["h_place"]) & (found[name] == h["h_digest"]) & found["doc_id"].eqNullSafe(h["h_id"])
        return found.join(h, on, "left_semi")

    several = kept(heads.filter("rows > 1")).dropDuplicates(["doc_id", name])
    return kept(heads.filter("rows = 1")).unionByName(several).select(*docs.columns).unionByName(docs.filter(~worded))
