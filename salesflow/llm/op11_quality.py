"""Document quality by logistic regression on hashed word n-grams, fitted by
follow-the-regularized-leader updates (FTRL-Proximal).

Tokens are runs of word characters and runs of other visible characters, case kept. A
document's features are its hashed tokens and pairs of neighbouring tokens; a token beside
itself is one feature, whatever the token, so that repetition is known for words never seen.
A feature counts log(1 + times), and all are scaled to length 1: the score is the sigmoid of
a bias and a sparse dot product with the weights.

Each update keeps per feature the sum of gradients and of their squares; the weight follows
from both, and is exactly 0 while the sum is within the L1 bound. So features of no use
never enter the model, and rare ones learn at their own rate.

The model is fitted on labelled rows outside the held-out fold: the first
``SAMPLE_PER_CLASS`` rows of each class by a hash of doc_id, of those as many as have
``SAMPLE_FEATURES`` features together (one of each class at least). Both bounds keep what the driver gets
small at any input, repeated doc_ids and long texts included; scores are corrected by the
share of the classes in all training labels. Label, lang, source and doc_id are no inputs of
a score.

Null texts count as empty; a document without features gets the score of the bias. Rows
without a label (or one that is neither 0 nor 1) are scored and not learned from; of repeated
doc_ids each row is scored, and contrary labels of one doc_id count as 1. Where only one
class has labels its label is every score; without any labels every score is 1. Only doc_id
and text (and doc_id, quality of the labels) are read, so extra columns of any name do no harm.
"""

import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesflow.llm.common import CHUNK_CHARS, HASHED_WORDS, Stored, WordCache, documents, mixed, over_documents

BITS = 20
SAMPLE_PER_CLASS = 4000
SAMPLE_FEATURES = 6_000_000
EPOCHS = 12
#: Of the updates: learning rate, its offset, and the bounds on the sum and the squares of weights.
ALPHA, BETA, L1, L2 = 10.0, 1.0, 1.0, 0.0
FOLDS = 5
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: What stands for the second of two equal tokens.
_SAME = np.uint64(0x9E3779B97F4A7C15)


def token_hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))


def features(text: str, hashes: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of a text's n-grams, and their values."""
    # a list of tokens is quicker, but of a very long text only their hashes are held
    tokens = _TOKEN.findall(text) if len(text) <= CHUNK_CHARS else (m[0] for m in _TOKEN.finditer(text))
    one = np.fromiter(map(hashes.__getitem__, tokens), np.uint64)
    if not len(one):
        return np.zeros(0, np.int64), np.zeros(0)
    first = np.where(one[1:] == one[:-1], _SAME, one[:-1])
    second = np.where(one[1:] == one[:-1], _SAME, one[1:])
    both = np.concatenate([mixed(one), mixed(mixed(first + np.uint64(1)) * np.uint64(3) + second)])
    found, times = np.unique((both >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    values = np.log1p(times)
    return found, values / np.sqrt((values**2).sum())


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def sigmoid(raw: float) -> float:
    return float(1 / (1 + np.exp(-min(max(raw, -30.0), 30.0))))


class Leader:
    """What FTRL keeps per feature. ``weights`` are those that minimize the linear
    approximations of all losses so far, plus both regularization terms."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.sums, self.squares = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        sums = self.sums[at]
        rate = (self.beta + np.sqrt(self.squares[at])) / self.alpha + self.l2
        return np.where(np.abs(sums) <= self.l1, 0.0, (np.sign(sums) * self.l1 - sums) / rate)

    def learn(self, at: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        grown = self.squares[at] + gradient**2
        shift = (np.sqrt(grown) - np.sqrt(self.squares[at])) / self.alpha
        self.sums[at] += gradient - shift * weights
        self.squares[at] = grown


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float) -> tuple[float, np.ndarray]:
    """(bias, weights) of rows of (buckets, values). ``share`` is that of label 1 among all
    training rows, which the sample does not show."""
    leader, bias = Leader(1 << BITS), Leader(1, l1=0.0)
    rng, here = np.random.default_rng(11), np.zeros(1, np.int64)
    # both classes weigh the same
    weigh = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            found, values = rows[i]
            w, b = leader.weights(found), bias.weights(here)
            off = weigh[i] * (sigmoid(float(w @ values) + float(b[0])) - labels[i])
            leader.learn(found, off * values, w)
            bias.learn(here, np.array([off]), b)
    return float(bias.weights(here)[0] + np.log(share / (1 - share))), leader.weights().astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, per_class: int, most: int, store) -> tuple[list, np.ndarray, dict]:
    """Features and labels of the bounded training sample, and the numbers of all training rows by label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    counts = dict(rows.groupBy("quality").count().collect())
    if len(counts) < 2:
        return [], np.zeros(0), counts
    chosen = [rows.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]).groupBy("doc_id").agg(F.max("quality").alias("quality")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")

    def featurize(batches):
        hashes, names = WordCache(token_hash, HASHED_WORDS), ["doc_id", "quality", "found", "amounts", "size"]
        for batch in batches:
            for i, y, text in zip(*[batch.column(c) for c in ("doc_id", "quality", "text")]):
                found, values = features(text.as_py() or "", hashes)
                row = (i.as_py(), y.as_py(), found.astype("<i4").tobytes(), values.astype("<f4").tobytes(), len(found))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=names)

    got = store(texts.mapInArrow(featurize, "doc_id long, quality int, found binary, amounts binary, size long"), "features")
    # repeated ids may give more rows than asked for; their order is settled by numbers only
    keys = got.select("quality", "doc_id", "size", F.xxhash64("found", "amounts").alias("of"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("of")]
    keys = [keys.filter(F.col("quality") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    up_to = W.partitionBy("quality").orderBy(*order)
    placed = keys[0].unionByName(keys[1]).withColumns({"first": F.row_number().over(up_to) == 1, "total": F.sum("size").over(up_to.rowsBetween(W.unboundedPreceding, 0))})
    wanted = placed.filter(F.col("first") | (F.col("total") <= most // 2)).select("quality", "doc_id", "of").distinct()
    kept = got.withColumn("of", F.xxhash64("found", "amounts")).join(F.broadcast(wanted), ["quality", "doc_id", "of"])
    kept = kept.dropDuplicates(["quality", "doc_id", "of"]).select("quality", "found", "amounts").collect()
    kept.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    found = [(np.frombuffer(r[1], "<i4").astype(np.int64), np.frombuffer(r[2], "<f4").astype(float)) for r in kept]
    return found, np.array([r[0] for r in kept], float), counts


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most: int = SAMPLE_FEATURES, store=None) -> tuple[float, np.ndarray | None]:
    """(bias, weights). Of rows with the same features of one doc_id one is learned from."""
    found, y, counts = sample(docs, labels, per_class, most, store or Stored(docs.sparkSession, "quality"))
    if len(set(y)) < 2:
        # one class only, or no text with a label of the other: its label is all that is known
        return (-30.0 if counts and max(counts, key=counts.get) == 0 else 30.0), None
    return fit(found, y, counts[1] / (counts[0] + counts[1]))


def _scorer(sent):
    (bias, weights), hashes = sent.value, WordCache(token_hash, HASHED_WORDS)

    def one(text):
        if weights is None:
            return (sigmoid(bias),)
        found, values = features(text, hashes)
        return (sigmoid(bias + float(weights[found] @ values)),)

    return one


def score(docs: DataFrame, model: tuple[float, np.ndarray | None]) -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return over_documents(docs, partial(_scorer, sent), [("score", pa.float64(), "double")])


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
