"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms. The score is the sigmoid of a bias, a weight per
term, and an inner product per pair of terms, so that an insult beside a group mention can
count for more than the sum of the two. All pairs cost as much as the terms, by
sum over factors of ((sum v x)^2 - sum (v x)^2) / 2.

The model is fitted on labelled rows outside the held-out fold: the first
``SAMPLE_PER_CLASS`` rows of each class by a hash of doc_id. That bound keeps what the
driver gets small at any input; scores are corrected by the share of the classes in all
training labels. Label, lang, source and doc_id are no inputs of a score.

Null texts count as empty; a document without known terms gets the score of the bias. Rows
without a label (or a null one) are scored and not learned from; of repeated doc_ids each
row is scored. Without labels of both classes every score is 0. Only doc_id and text (and
doc_id, toxic of the labels) are read, so extra columns of any name do no harm.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.common import HASHED_WORDS, WordCache, documents, over_documents

BITS = 20
FACTORS = 4
SAMPLE_PER_CLASS = 4000
#: Terms of fewer sampled documents are left out.
MIN_DOCUMENTS = 4
EPOCHS, BATCH, RATE, RIDGE = 30, 64, 0.1, 1e-4
#: A term's value grows with how far its share differs between the classes, in standard
#: errors beyond ``NOISE``; a term that does not differ keeps ``FLOOR``, for its pairs.
NOISE, SCALE, FLOOR = 3.5, 4.0, 0.02
FOLDS = 5
_EDGES = b".,;:!?'\"()[]{}*#$%&|<>"


def bucket(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word.strip(_EDGES)) >> (64 - BITS)


def terms(text: str, buckets: WordCache) -> np.ndarray:
    """The distinct hashed terms of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


class Machine:
    """``index`` maps a hashed term to its row of ``values`` and of ``weights`` (1 + FACTORS
    wide), 0 for unknown ones."""

    def __init__(self, bias: float, index: np.ndarray, values: np.ndarray, weights: np.ndarray):
        self.bias, self.index, self.values, self.weights = bias, index, values, weights

    def raw(self, found: np.ndarray) -> float:
        rows = self.index[found]
        rows = rows[rows > 0]
        if not len(rows):
            return self.bias
        w = self.weights[rows] * self.values[rows, None]
        v = w[:, 1:]
        return float(self.bias + w[:, 0].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum())


def fit(found: list[np.ndarray], labels: np.ndarray, share: float) -> Machine:
    """Minimizes logistic loss by AdaGrad. ``share`` is that of label 1 among all training rows."""
    counts = np.bincount(np.concatenate(found), minlength=1 << BITS)
    known = np.flatnonzero(counts >= MIN_DOCUMENTS)
    index = np.zeros(1 << BITS, np.int32)
    index[known] = np.arange(1, len(known) + 1)
    # how the shares of sampled documents with each term differ between the classes
    sizes = [(labels == k).sum() for k in (0, 1)]
    with_term = [np.bincount(np.concatenate([f for f, y in zip(found, labels) if y == k]), minlength=1 << BITS)[known] for k in (0, 1)]
    pooled = (with_term[0] + with_term[1] + 1) / (sizes[0] + sizes[1] + 2)
    error = np.sqrt(pooled * (1 - pooled) * (1 / sizes[0] + 1 / sizes[1]))
    far = np.abs(with_term[1] / sizes[1] - with_term[0] / sizes[0]) / error
    values = np.concatenate([[0.0], np.maximum(FLOOR, np.tanh((far - NOISE) / SCALE))])
    rng = np.random.default_rng(7)
    weights = np.zeros((len(known) + 1, 1 + FACTORS))
    weights[1:, 1:] = rng.normal(0, 0.05, (len(known), FACTORS))
    seen, bias, bias_seen = np.full_like(weights, 1e-6), 0.0, 1e-6
    rows = [(r := index[f])[r > 0] for f in found]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = [i for i in order[at : at + BATCH] if len(rows[i])]
            if not some:
                continue
            flat, sizes = np.concatenate([rows[i] for i in some]), np.array([len(rows[i]) for i in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            x = values[flat][:, None]
            w = weights[flat]
            vx = w[:, 1:] * x
            sums = np.add.reduceat(vx, starts)
            score = bias + np.add.reduceat(w[:, 0] * x[:, 0], starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
            off = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some]) / len(some)
            each = np.repeat(off, sizes)[:, None]
            step = np.concatenate([each * x, each * x * (np.repeat(sums, sizes, 0) - vx)], 1)
            touched, place = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(place, step[:, k], len(touched)) for k in range(1 + FACTORS)], 1)
            grad += RIDGE * weights[touched] / len(some)
            seen[touched] += grad**2
            weights[touched] -= RATE * grad / np.sqrt(seen[touched])
            bias_seen += off.sum() ** 2
            bias -= RATE * off.sum() / np.sqrt(bias_seen)
    of_sample = labels.mean()
    bias += np.log(share / (1 - share)) - np.log(of_sample / (1 - of_sample))
    return Machine(float(bias), index, values.astype(np.float32), weights.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine | None:
    """Fits on at most ``per_class`` training rows of each class, which come to the driver as hashed terms."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    counts = dict(rows.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return None
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = [rows.filter(F.col("toxic") == k).orderBy(*by_hash).limit(per_class) for k in (0, 1)]
    sample = F.broadcast(sample[0].unionByName(sample[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    found = chosen.select("toxic", F.col("text").cast("string"))

    def featurize(batches):
        buckets = WordCache(bucket, HASHED_WORDS)
        for batch in batches:
            sets = [terms(t.as_py() or "", buckets).astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["toxic", "terms"])

    got = found.mapInArrow(featurize, "toxic int, terms binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    y = np.array([r[0] for r in got], float)
    if len(set(y)) < 2:
        return None
    return fit([np.frombuffer(r[1], "<i4") for r in got], y, counts[1] / (counts[0] + counts[1]))


def _scorer(sent):
    model, buckets = sent.value, WordCache(bucket, HASHED_WORDS)

    def one(text):
        if model is None:
            return (0.0,)
        return (float(1 / (1 + np.exp(-np.clip(model.raw(terms(text, buckets)), -30, 30)))),)

    return one


def score(docs: DataFrame, model: Machine | None) -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return over_documents(docs, partial(_scorer, sent), [("score", pa.float64(), "double")])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
