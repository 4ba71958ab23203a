"""Quality scores by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of word characters or of signs. Features are token unigrams and bigrams, and one- to three-grams of token
shapes (lower case, capitalised, upper case, mixed, number, the sign, or "same as the token before"), hashed into a fixed
number of slots; values are log counts scaled to unit length. Training takes a bounded sample of labelled rows, by hash of
the id, in a fixed number of shards, as features, not as texts; each shard passes a fixed number of times over its rows with
per-coordinate FTRL-proximal and the models are averaged. Scoring is one sparse dot product a document in tasks that hold
the weights, whose size is fixed.

Null and empty texts have no features: their score is that of the bias. Texts of any length are taken whole. Labels are
joined by id alone; null labels are ignored and of contradicting labels the lower counts. Of several texts with one id the
one with the smallest hash is learnt from. Without any labelled row every score is 0.5. Repeated rows are scored one by one;
rows with a null id are scored and never learnt from. quality() carries no other columns over, accepted() all of them unchanged.
An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.llm.common import bounded, held

SLOTS = 1 << 18
#: Bound on the labelled rows that are learnt from.
MAX_LABELLED = 16_000
SHARDS = 4
#: Passes of a shard over its rows.
PASSES = 10
#: FTRL-proximal: learning rate, smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 4.0, 1.0, 1e-4, 1e-4
#: Tokens and characters that a worker keeps before it starts its table anew.
CACHE_TOKENS, CACHE_CHARS = 100_000, 4_000_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
LOWER, CAPITAL, UPPER, MIXED, NUMBER, SAME = range(1, 7)


class _Tokens(dict):
    """Token -> number; arrays beside it hold the hash and the shape."""

    def __init__(self):
        super().__init__()
        self.chars = 0
        self.hash, self.shape = np.zeros(CACHE_TOKENS + 1, "uint64"), np.zeros(CACHE_TOKENS + 1, "uint64")

    def __missing__(self, token: str) -> int:
        n = len(self)
        self[token] = n
        self.chars += len(token)
        if token[0].isalnum() or token[0] == "_":
            kind = NUMBER if token.isdigit() else LOWER if token.islower() else UPPER if token.isupper() and len(token) > 1 else CAPITAL if token.istitle() else MIXED
        else:
            kind = 16 + xxhash.xxh32_intdigest(token)
        if n >= len(self.hash):
            self.hash, self.shape = np.concatenate([self.hash, np.zeros_like(self.hash)]), np.concatenate([self.shape, np.zeros_like(self.shape)])
        self.hash[n], self.shape[n] = xxhash.xxh3_64_intdigest(token.lower()), kind
        return n


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text."""
    tokens = TOKEN.findall(text) if text else []
    if not tokens:
        return np.empty(0, "int64"), np.empty(0, "float32")
    known = held("tokens", _Tokens)
    if len(known) >= CACHE_TOKENS or known.chars >= CACHE_CHARS:
        known.clear()
        known.chars = 0
    ids = np.fromiter(map(known.__getitem__, tokens), "int64", len(tokens))
    word, shape = known.hash[ids], known.shape[ids].copy()
    shape[1:][ids[1:] == ids[:-1]] = SAME
    found = [word, word[:-1] * _A + word[1:] * _B, shape * _B + _A, (shape[:-1] * _A + shape[1:]) * _B, ((shape[:-2] * _A + shape[1:-1]) * _A + shape[2:]) * _B]
    slots, counts = np.unique((np.concatenate(found) * _A) >> np.uint64(46), return_counts=True)
    values = np.log1p(counts.astype("float32"))
    return slots.astype("int64"), values / np.sqrt((values * values).sum())


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; the last slot is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(slots, SLOTS), np.append(values, np.float32(1))
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", limit: int = MAX_LABELLED) -> np.ndarray:
    """Weights (SLOTS + 1) learnt from at most `limit` labelled ids, those with the smallest hashes of the id."""
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("y"))
    chosen = own.orderBy(F.xxhash64(key), key).limit(limit)
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(F.xxhash64(key).alias("at"), F.xxhash64(text).alias("h"), "y", F.col(text).alias("t"))

    def featured(batches):
        for batch in batches:
            found = [features(t) for t in batch.column(3).to_pylist()]
            slots, values = (pa.array([x[i].astype(kind).tobytes() for x in found], pa.binary()) for i, kind in enumerate(("<i4", "<f4")))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), slots, values], ["at", "h", "y", "slots", "values"])

    rows = bounded(rows).mapInArrow(featured, "at long, h long, y int, slots binary, values binary")
    rows = rows.groupBy("at", "y").agg(F.min_by(F.struct("slots", "values"), "h").alias("x")).select(F.pmod("at", F.lit(SHARDS)).alias("shard"), "at", "y", "x.slots", "x.values")

    def fit(group: pa.Table) -> pa.Table:
        slots, values, labels_ = group.column("slots"), group.column("values"), group.column("y").to_pylist()
        # Views of the table's own buffers: the shard is in memory once.
        data = [(np.frombuffer(slots[i].as_buffer(), "<i4"), np.frombuffer(values[i].as_buffer(), "<f4"), labels_[i]) for i in np.argsort(group.column("at").to_numpy()).tolist()]
        model = Ftrl()
        for _ in range(PASSES):
            for at, x, y in data:
                model.learn(at, x, y)
        return pa.table({"w": [model.weights().astype("<f4").tobytes()], "n": [len(data)]})

    fitted = rows.groupBy("shard").applyInArrow(fit, "w binary, n long").collect()  # SHARDS rows of fixed size
    if not fitted:
        return np.zeros(SLOTS + 1, "float32")
    return np.average([np.frombuffer(r.w, "<f4") for r in fitted], axis=0, weights=[r.n for r in fitted]).astype("float32")


def score(spark: SparkSession, weights: np.ndarray):
    """Function of a text column: its score. Rows stay in the JVM, texts alone go to Python and scores alone come back."""
    sent = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        w, out = sent.value, []
        for t in texts:
            slots, values = features(t.as_py())
            out.append(1 / (1 + np.exp(-np.clip(float(w[slots] @ values) + float(w[SLOTS]), -35, 35))))
        return pa.array(out, pa.float64())

    return scores


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of each row; learns only from labelled rows that are not held out."""
    weights = train(docs, labels.where(~held_out(key)), key=key, text=text)
    found = bounded(docs).select(F.col(key).alias("row"), score(docs.sparkSession, weights)(F.col(text)).alias("score"))
    return found.select(F.col("row").alias(key), held_out("row").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; learns as quality() does."""
    weights = train(docs, labels.where(~held_out(key)), key=key, text=text)
    return bounded(docs).where(score(docs.sparkSession, weights)(F.col(text)) >= threshold)
