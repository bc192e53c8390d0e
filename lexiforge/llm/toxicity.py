"""Toxic passages by maximum-scoring segments.

Words and their first letters (4 to 6) have log-odds between toxic and other labelled documents, with a Dirichlet prior drawn
from both together; a token's score is its strongest part's, and tokens without significant evidence cost a little. A linear-time scan
(Ruzzo and Tompa) finds all maximal scoring segments of a text. Scores of the best segment of clean texts follow an extreme-value
law, whose scale solves E[exp(lambda * s)] = 1 over clean tokens and whose offset is fitted; a segment's significance under it,
that of all significant segments together and the share of evidence in the text are calibrated to a probability.

There are three models, each counted on two thirds of the labelled rows and measured on the last one, so that all rows serve for
both; a text's measures are the means of theirs. No measure counts against toxicity.

The classifier is fitted on at most MAX_LABELS labelled rows (those of smallest hash); tokens are hashed to BUCKETS, so the
model has a fixed size. Every text is scored whole.

Defined results: null and empty texts score as texts without a toxic passage; without labels of both kinds all score
the share of toxic labels (0 without any); rows are scored each for itself; labels that are null are left out, of
several labels of a document the toxic one holds; extra columns are left out.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lower_ascii

BUCKETS, MAX_LABELS, PRIOR, COST, SIGNIFICANT, THRESHOLD = 1 << 18, 30_000, 10.0, 0.3, 3.0, 0.3
#: Models, and the lengths of the beginnings of words that count beside the words.
MODELS, BEGINNINGS = 3, (4, 5, 6)
#: Tokens that are looked up at once.
SLICE = 1 << 16
#: A passage is significant if so many such are expected in a clean text of its length, at most.
EXPECTED = 0.05
#: So many clean texts have no more evidence by length than what counts as none.
USUAL = 0.9
#: Longer tokens are hashed each time, so that the table of hashes is bounded in bytes.
LONGEST_KEPT = 64
TOKEN = re.compile(r"[^\W\d_]+").findall


_ROW = struct.Struct(f"={1 + len(BEGINNINGS)}i").pack


class _Buckets(dict):
    """The buckets of a token and of its beginnings, as bytes; a token that has no such beginning has its own bucket there."""

    def __missing__(self, token: str) -> bytes:
        if len(self) > 150_000:
            self.clear()
        n, own = len(token), zlib.crc32(token.encode()) & (BUCKETS - 1)
        k = _ROW(own, *[zlib.crc32(f"^{token[:m]}".encode()) & (BUCKETS - 1) if n > m else own for m in BEGINNINGS])
        if len(token) <= LONGEST_KEPT:
            self[token] = k
        return k


_bucket = _Buckets()


def token_buckets(text: str | None) -> np.ndarray:
    """A row a token."""
    return np.frombuffer(b"".join(map(_bucket.__getitem__, TOKEN(lower_ascii(text or "")))), np.int32).reshape(-1, 1 + len(BEGINNINGS))


def token_scores(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, prior: float = PRIOR) -> np.ndarray:
    """Score of each bucket, from the documents of either kind that hold it: log-odds where significant, less the cost of a token."""
    share = n_toxic / max(n_toxic + n_other, 1)
    rate = (toxic + other + 0.1) / (n_toxic + n_other + 0.2)
    odds = lambda y, n: np.log(y + prior * rate) - np.log(n + prior - y - prior * rate)
    delta = odds(toxic, n_toxic) - odds(other, n_other)
    part = lambda y, e: np.where(y > 0, y * np.log(np.maximum(y, 1) / np.maximum(e, 1e-12)), 0.0)
    surprise = 2 * (part(toxic, (toxic + other) * share) + part(other, (toxic + other) * (1 - share)))  # the likelihood ratio of one rate against two
    sure = surprise >= SIGNIFICANT**2
    return np.where(sure, np.clip(delta, -2.0, 6.0), 0.0) - COST


def scale_of(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda with a mean of exp(lambda * score) of 1 over clean tokens."""
    p = weights / max(weights.sum(), 1.0)
    if p @ scores >= 0 or not (p[scores > 0] > 0).any():
        return 1.0
    lo, hi = 1e-3, 1.0
    f = lambda x: p @ np.exp(np.minimum(x * scores, 700.0)) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order; only positive tokens are visited."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, nearest earlier one that begins lower
    for k, before, after in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        start, j = k, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                break
            start, before, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
        found.append((start, k + 1, before, after, j))
    return [(s, e, right - left) for s, e, left, right, _ in found]


def by_token(scores: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Scores of tokens: the strongest part's that speaks for toxicity, else the strongest's against it."""
    own = np.empty((len(buckets), *scores.shape[1:]))
    for k in range(0, len(buckets), SLICE):
        x = [scores[part] for part in buckets[k : k + SLICE].T]
        most = reduce(np.maximum, x)
        own[k : k + SLICE] = np.where(most > -COST, most, reduce(np.minimum, x))
    return own


class Law:
    """One model: scores of the buckets, the law's scale and offset, and the share of evidence that most clean texts stay below."""

    def __init__(self, scores: np.ndarray):
        self.scores, self.scale, self.offset, self.usual = scores, 1.0, 0.0, 0.0

    def tokens(self, text: str | None) -> np.ndarray:
        return by_token(self.scores, token_buckets(text))

    def passages(self, own: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Start, end, score and surprise (-ln of the expected number) of each maximal segment."""
        at = self.offset + np.log(max(len(own), 1))
        return [(s, e, x, self.scale * x - at) for s, e, x in segments(own)]

    def summary(self, own: np.ndarray, found: list) -> tuple[float, float, float]:
        """Surprise of the best segment, that of all significant ones together, and the share of evidence. What clean texts usually have is no
        evidence, so texts below it are equal, be they long or short."""
        usual = -np.log(EXPECTED)
        rest = sum(x[3] - usual for x in found if x[3] > usual)
        return max((x[3] for x in found if x[3] > usual), default=usual), np.log1p(rest), max(self.share(own), self.usual)

    @staticmethod
    def share(own: np.ndarray) -> float:
        """The evidence for toxicity in a text by its length, as a logarithm."""
        return float(np.log1p(100 * np.maximum(own + COST, 0).sum() / (len(own) + 50)))


class Scorer:
    """The fitted models and their calibration."""

    def __init__(self, laws: list[Law], weights: tuple[float, ...] = (), rate: float = 0.0):
        self.laws, self.weights, self.rate = laws, weights, rate
        self.table = np.stack([law.scores for law in laws], 1)

    @property
    def scores(self) -> np.ndarray:
        """The first model's."""
        return self.laws[0].scores

    def passages(self, text: str | None) -> tuple[list[np.ndarray], list[list[tuple[int, int, float, float]]]]:
        """The tokens' scores and the maximal segments, by each model."""
        every = by_token(self.table, token_buckets(text))
        own = [every[:, k].copy() for k in range(len(self.laws))]
        return own, [law.passages(x) for law, x in zip(self.laws, own)]

    def summary(self, own: list, found: list) -> tuple[float, ...]:
        each = [law.summary(x, f) for law, x, f in zip(self.laws, own, found)]
        return tuple(sum(x) / len(each) for x in zip(*each))

    @staticmethod
    def significant(found: list) -> list[tuple[int, int, float, float]]:
        """The significant segments by the model that has the most significant one."""
        return [x for x in max(found, key=lambda f: max((x[3] for x in f), default=-np.inf)) if x[3] > -np.log(EXPECTED)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.rate)
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights of a logistic regression, by Newton's method."""
    x, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _rising(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression in which no measure counts against y: those that would are left out."""
    keep, falling = list(range(x.shape[1])), True
    while falling:
        w = _logistic(x[:, keep], y)
        falling = [k for k, v in zip(keep, w[1:]) if v < 0]
        keep = [k for k in keep if k not in falling]
    own = dict(zip(keep, w[1:]))
    return (w[0], *(own.get(k, 0.0) for k in range(x.shape[1])))


#: Bins of token scores, from the lowest to the highest that token_scores() gives.
BINS = np.linspace(-2 - COST, 6 - COST, 321)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Scorer:
    """The models from those labels whose fold isn't 2. What comes to the driver is bounded by BUCKETS and max_labels."""
    known = labels.filter((fold(F.col("doc_id"), 4) != 2) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_labels)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "text", F.pmod("h", F.lit(MODELS)).cast("int").alias("third"))
    each = lambda b: zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())

    def count(batches):
        for b in batches:
            kinds: dict[tuple[int, int], list[np.ndarray]] = {}
            for toxic, text, third in each(b):
                kinds.setdefault((third, int(toxic > 0)), []).append(np.unique(token_buckets(text)))
            for (third, kind), parts in kinds.items():
                k, docs_with = np.unique(np.concatenate(parts), return_counts=True)
                # bucket -1 counts the documents
                whole = lambda x: pa.array(np.full(len(k) + 1, x, np.int32))
                yield pa.RecordBatch.from_arrays([whole(third), whole(kind), pa.array(np.r_[-1, k].astype(np.int32)), pa.array(np.r_[len(parts), docs_with].astype(np.int64))], ["third", "toxic", "bucket", "docs"])

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([b.column(k).to_numpy() for k in range(4)]).astype(np.int64).tobytes()], pa.binary())], ["x"])

    counts = rows.mapInArrow(count, "third int, toxic int, bucket int, docs long").groupBy("third", "toxic", "bucket").agg(F.sum("docs").alias("docs"))
    with_it = np.zeros((MODELS, 2, BUCKETS + 1))
    for r in counts.mapInArrow(packed, "x binary").collect():
        third, kind, bucket, n = np.frombuffer(r["x"], np.int64).reshape(4, -1)
        with_it[third, kind, bucket] = n  # -1 is the last one
    with_it = with_it.sum(0) - with_it  # what the other thirds have
    laws = [Law(token_scores(x[1, :-1], x[0, :-1], x[1, -1], x[0, -1])) for x in with_it]

    def best(batches):
        for b in batches:
            x, bins = [], np.zeros((MODELS, len(BINS)), np.int64)
            for toxic, text, third in each(b):
                own = laws[third].tokens(text)
                x.append((third, toxic, max((v for _, _, v in segments(own)), default=0.0), len(own), Law.share(own)))
                if toxic <= 0:
                    bins[third] += np.bincount(np.rint((own - BINS[0]) / (BINS[1] - BINS[0])).astype(np.int64), minlength=len(BINS))
            x += [(third, None, None, None, None) for third in range(MODELS)]
            held = [None] * (len(x) - MODELS) + [n.tobytes() for n in bins]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in x], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64()))), pa.array(held, pa.binary())], ["third", "toxic", "best", "n", "share", "bins"])

    def measured(batches):
        for b in batches:
            x = []
            for _, text, third in each(b):
                own = laws[third].tokens(text)
                x.append(laws[third].summary(own, laws[third].passages(own)))
            x = np.array(x).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, k]) for k in range(3))], ["toxic", "best", "rest", "share"])

    # A few numbers for each of max_labels rows.
    found = rows.mapInArrow(best, "third int, toxic int, best double, n long, share double, bins binary").collect()
    y = np.array([r["toxic"] > 0 for r in found if r["bins"] is None], float)
    scorer = Scorer(laws, rate=float(y.mean()) if len(y) else 0.0)
    if len(y) and 0 < y.mean() < 1:
        for third, law in enumerate(laws):
            bins = [np.frombuffer(r["bins"], np.int64) for r in found if r["bins"] is not None and r["third"] == third]
            law.scale = scale_of(BINS, np.sum(bins, axis=0).astype(float))
            clean = [r for r in found if r["bins"] is None and r["third"] == third and r["toxic"] <= 0]
            if clean:
                law.offset = float(np.mean([law.scale * r["best"] - np.log(max(r["n"], 1)) for r in clean]) - np.euler_gamma)  # the standard law has this mean
                law.usual = float(np.quantile([r["share"] for r in clean], USUAL))
        held = rows.mapInArrow(measured, "toxic int, best double, rest double, share double").toPandas()
        scorer.weights = _rising(held[["best", "rest", "share"]].to_numpy(), (held["toxic"].to_numpy() > 0).astype(float))
    return scorer


def toxicity(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages (token positions and scores) of every row of docs."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labels))

    def score(batches):
        own = scorer.value
        for b in batches:
            x, passages = [], []
            for t in b.column(1).to_pylist():
                scores, found = own.passages(t)
                x.append(own.summary(scores, found))
                passages.append([{"start": s, "end": e, "score": v} for s, e, v, _ in own.significant(found)])
            p = own.probability(np.array(x).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))], ["doc_id", "score", "predicted", "passages"])

    rows = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int, passages array<struct<start:int,end:int,score:double>>")
    return rows.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "passages")


def keep_harmless(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't predicted toxic, all columns as they are."""
    scorer, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labels)), docs.columns.index("text")

    def keep(batches):
        own = scorer.value
        for b in batches:
            p = own.probability(np.array([own.summary(*own.passages(t)) for t in b.column(at).to_pylist()]).reshape(-1, 3))
            yield b.filter(pa.array(p < threshold))

    return docs.mapInArrow(keep, docs.schema)
