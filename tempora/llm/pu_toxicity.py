"""Toxicity (operator 8): non-negative positive-unlabelled learning with numpy classifiers.

Confirmed toxic texts are the positive set, texts without a label the unlabelled one; texts labelled
clean only give the class prior. With the prior pi the risk is estimated as
pi R_p(+) + max(0, R_u(-) - pi R_p(-)): the part in the bracket is the risk of the hidden clean texts,
and where training drives it below zero it stays at zero, so the model can't gain by fitting the
unlabelled texts. The loss is logistic, so a score is an estimate of the probability of a toxic text; where
training stops leaves the level of scores uncertain, so the bias is set last: the mean score of the unlabelled texts is the prior.

Features are hashed words and word beginnings. A word counts 1 + log(occurrences), over about the root of the number of words, so
that a word said over and over weighs little more than one said twice. The model is linear, so a text's logit is
a sum over its distinct words and each word is worked out once in a task.

Fitting uses every different text of the training rows, copies once. More than ``POSITIVES`` and ``UNLABELLED`` of them are dealt by
a hash of their text to shards of about that size, each of which one task fits; weights and biases are averaged, which leaves a linear
classifier, and every unlabelled text has had its part in the level. If one side fills fewer shards than the other, its groups are dealt
to several. The prior counts all labelled training rows. Scoring covers all rows in one narrow pass; the model sent along has ``2**HASH_BITS`` weights, whatever the corpus.

Defined cases: null and empty texts, and texts without words, get the score of the bias alone; without
a positive or unlabelled training row all scores are the prior; labels that repeat or contradict
each other count as toxic if one does; null ids are scored and never matched to labels; an empty
table gives an empty result.
"""

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialise, release, schema, table, trim

HASH_BITS = 18
BEGINNINGS = (4, 5, 6)
#: Texts of a training shard, about.
POSITIVES, UNLABELLED = 3000, 4000
#: Parts of one in which weights are added up, in whole numbers as their order is open; and the places of the bias and of the number of classifiers.
UNITS, LEVEL, COUNT = float(1 << 40), -2, -1
STEPS, RATE, DECAY = 80, 0.08, 5e-4
#: A feature is learned if it is in so many rows of the positive sample; the weight of one in less than this
#: share of them decays the faster, by the ratio to this power. Chosen on folds of the training rows.
SEEN_ROWS, COMMON_SHARE, RARER = 4, 0.2, 0.5
#: Weights of words are divided by this power of the number of words of the text, and multiplied. Chosen on folds, too.
SCALE, POWER = 9.0, 0.55
THRESHOLD = 0.7
MEMO_WORDS = 300_000
CUT_CHARS = 1 << 20
_PUNCTUATION = bytes(32 if b < 48 or 57 < b < 97 or 122 < b < 128 else b for b in range(256))


def words_of(text: str | None):
    """Lists of the words of a text, lower-cased and without ASCII punctuation, a stretch of it at a time."""
    text = text or ""
    at = 0
    while at < len(text):
        end = at + CUT_CHARS
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()
        at = end


def counts_of(text: str | None) -> tuple[Counter, int]:
    """Occurrences of each word of a text, and their number."""
    counts, n = Counter(), 0
    for words in words_of(text):
        counts.update(words)
        n += len(words)
    return counts, n


def word_features(word: bytes) -> list[int]:
    mask = (1 << HASH_BITS) - 1
    return [zlib.crc32(word) & mask] + [zlib.crc32(word[:k], k) & mask for k in BEGINNINGS if len(word) > k]


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts) -> list[float]:
        memo = self.__dict__.setdefault("memo", {})
        out = []
        for t in texts:
            counts, n = counts_of(t)
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for w in counts:
                if w not in memo:
                    memo[w] = float(self.weights[word_features(w)].sum())
            x = np.fromiter(map(memo.__getitem__, counts), np.float64, len(counts))
            total = float(x @ (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))))
            out.append(1 / (1 + np.exp(-np.clip(self.bias + SCALE * total / max(n, 1) ** POWER, -50, 50))))
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}


class _Rows:
    """Sparse rows: feature shares of texts."""

    def __init__(self, packed: list[bytes]):
        parts = [np.frombuffer(p, [("at", "<i4"), ("x", "<f4")]) for p in packed]
        size = np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, [("at", "<i4"), ("x", "<f4")])
        self.at, self.x = flat["at"], flat["x"]
        self.row = np.repeat(np.arange(len(parts), dtype=np.int32), size)
        self.n = len(parts)

    def keep(self, features):
        """Leave only these features; what is left takes its wide form, as most go."""
        at = features[self.at]
        self.at, self.x, self.row = self.at[at].astype(np.int64), self.x[at].astype(np.float64), self.row[at].astype(np.int64)

    def dot(self, w):
        return np.bincount(self.row, weights=self.x * w[self.at], minlength=self.n)

    def back(self, g, size):
        return np.bincount(self.at, weights=self.x * g[self.row], minlength=size)


def _packed(text: str | None) -> bytes:
    """A text's features, with shares, for training: (place, share) pairs."""
    counts, n = counts_of(text)
    shares: dict[int, float] = {}
    for w, c in counts.items():
        for f in word_features(w):
            shares[f] = shares.get(f, 0.0) + SCALE * (1 + math.log(c)) / n**POWER
    return np.array(list(shares.items()), [("at", "<i4"), ("x", "<f4")]).tobytes() if shares else b""


def fit(positive: list[bytes], unlabelled: list[bytes], prior: float, steps: int = STEPS) -> Classifier:
    """Minimise the non-negative risk by Adam over all rows of the two samples."""
    p, u, size = _Rows(positive), _Rows(unlabelled), 1 << HASH_BITS
    rows_with = np.bincount(p.at, minlength=size)
    for rows in (p, u):
        rows.keep(rows_with >= SEEN_ROWS)
    decay = DECAY * np.maximum(1, COMMON_SHARE * p.n / np.maximum(rows_with, 1)) ** RARER
    theta = np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    mean, kept = np.zeros_like(theta), 0
    for t in range(1, steps + 1):
        zp, zu = p.dot(theta[:-1]) + theta[-1], u.dot(theta[:-1]) + theta[-1]
        # logistic loss: of "+" softplus(-z), of "-" softplus(z)
        hidden = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, dp, du = prior * (sig(zp) - 1) / p.n, -prior * sig(zp) / p.n, sig(zu) / u.n
        gp, gu = (up + dp, du) if hidden >= 0 else (up, 0 * du)
        g = np.append(p.back(gp, size) + u.back(gu, size), gp.sum() + gu.sum())
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if 2 * t > steps:  # steps to either side of zero make the last one arbitrary; the mean of the second half is not
            kept += 1
            mean += (theta - mean) / kept
    w, z = mean[:-1], u.dot(mean[:-1])
    low, high = -50.0, 50.0
    for _ in range(60):  # the mean score rises with the bias
        bias = (low + high) / 2
        low, high = (low, bias) if sig(z + bias).mean() > prior else (bias, high)
    return Classifier(w.astype(np.float32), bias, prior)


def _shard(names: list[str], prior: float):
    """A function of one shard's rows (side, h, text): its classifier's weights and bias in ``UNITS``, and a one that counts it."""

    def run(t: pa.Table) -> pa.Table:
        seen, packed = set(), {"p": [], "u": []}
        for b in t.select(names).to_batches(max_chunksize=256):
            for side, h, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (side, h) not in seen:
                    seen.add((side, h))
                    packed[side].append(_packed(text))
        if not packed["p"] or not packed["u"]:
            return pa.table({"at": pa.array([], pa.int32()), "w": pa.array([], pa.int64())})
        made = fit(packed["p"], packed["u"], prior)
        at = np.flatnonzero(made.weights)
        w = np.rint(np.append(made.weights[at].astype(np.float64), made.bias) * UNITS)
        out = pa.table({"at": np.concatenate([at, [LEVEL, COUNT]]).astype(np.int32), "w": np.append(w, 1).astype(np.int64)})
        packed.clear()
        trim()
        return out

    return run


def _fit_shards(rows: DataFrame, picked: DataFrame, n: dict[str, int], prior: float) -> Classifier | None:
    """Classifiers of shards that hold every picked text between them, averaged; none if no shard has both sides."""
    groups = {"p": -(-n["p"] // POSITIVES), "u": -(-n["u"] // UNLABELLED)}
    shards = max(groups.values())
    of = F.when(F.col("side") == "p", groups["p"]).otherwise(groups["u"])
    # a side that fills fewer shards is dealt out again to the rest
    dealt = rows.join(picked.hint("merge"), ["id", "h"]).withColumn("shard", F.explode(F.sequence(F.pmod("h", of).cast("int"), F.lit(shards - 1), of)))
    names = ["side", "h", "text"]
    sums = dealt.select("shard", *names).groupBy("shard").applyInArrow(_shard(names, prior), schema("at int, w long")).groupBy("at").agg(F.sum("w").alias("w")).toArrow()
    at, w = (sums.column(c).to_numpy() for c in ("at", "w"))
    made = int(w[at == COUNT].sum())
    if not made:
        return None
    weights = np.zeros(1 << HASH_BITS, np.float64)
    weights[at[at >= 0]] = w[at >= 0] / UNITS / made
    return Classifier(weights.astype(np.float32), float(w[at == LEVEL][0] / UNITS / made), prior)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int | None = None, unlabelled: int | None = None) -> Classifier:
    """A classifier from toxic rows of ``labels`` and rows of ``docs`` without a label. Pass training rows only. All of them are learned from, unless a number is given."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    known = marks.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    prior = min(max((known["toxic"] or 0) / known["n"] if known["n"] else 0.05, 1e-3), 0.9)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # ids and hashes alone are told apart and counted; texts are fetched by id afterwards
    small = rows.select("id", "h")

    def once(df, n):
        x = df.groupBy("h").agg(F.min("id").alias("id")).where("id is not null")
        return x if n is None else x.orderBy("h").limit(n)

    pos = once(small.join(marks.where("y = 1"), "id", "left_semi"), positives).select("id", "h", F.lit("p").alias("side"))
    unl = once(small.join(marks, "id", "left_anti"), unlabelled).select("id", "h", F.lit("u").alias("side"))
    picked = materialise(pos.union(unl), "picked")
    n = {"p": 0, "u": 0} | {r["side"]: r["count"] for r in picked.groupBy("side").count().collect()}
    try:
        if not all(n.values()):
            model = None
        elif n["p"] > POSITIVES or n["u"] > UNLABELLED:
            model = _fit_shards(rows, picked, n, prior)
        else:

            def make():
                return lambda texts: [[_packed(t) for t in texts]]

            # one shard's rows: they go to the driver
            got = map_texts(rows.join(F.broadcast(picked.select("id", "side")), "id").select("side", "text"), ["side"], "text", schema("features binary"), make).toArrow()
            side = np.array(got.column("side").to_pylist())
            features = np.array(got.column("features").to_pylist(), object)
            model = fit(list(features[side == "p"]), list(features[side == "u"]), prior)
    finally:
        release(picked)
    return model or Classifier(np.zeros(1 << HASH_BITS, np.float32), float(np.log(prior / (1 - prior))), prior)


def score(df: DataFrame, model: Classifier, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with score for each row. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2**HASH_BITS weights

    def make():
        return lambda texts: [shared.value.scores(texts)]

    return map_texts(df, keep, text_col, schema("score double"), make)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Classifier:
    learn = F.coalesce(~held_out(), F.lit(False))
    return train(docs.where(learn), table(spark, sf_dir, "labels").where(learn))


def op8_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, trained(spark, docs, sf_dir), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
