"""Document fingerprints: bottom-k sketches of word shingles.

A sketch keeps the k smallest distinct hashes of a document's five-word shingles (its whole
word sequence, if shorter; none without words). Sketches of parts merge into that of the
whole, and give estimates of resemblance, containment and the number of distinct shingles;
below k shingles these are exact. Two empty sketches have likeness 1, an empty and another 0.

Null texts count as empty. In the order of documents, ids descend, null ids come last, and
rows of one id are ordered by their text; every row is edited and compared with the one
after it, the last with the first, a single one with itself. Only doc_id and text are read,
so extra columns of any name do no harm. An empty table gives an empty result.
"""

import base64
import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.common import CHUNK_CHARS, HASHED_WORDS, WordCache, documents, lowered_words, over_documents, shingles

WIDTH = 5
K = 128
#: Rows of a range of documents, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1_000, 50_000
#: Distinct keys a merging task gathers before it hands on what it has.
FLUSH_KEYS = 20_000


def word_hashes() -> WordCache:
    return WordCache(xxhash.xxh3_64_intdigest, HASHED_WORDS)


def sketch_of(text: str, hashes: WordCache, k: int = K) -> np.ndarray:
    """The smallest k distinct shingle hashes, of 48 bits, ascending."""
    return np.unique(shingles(lowered_words(text), hashes, WIDTH) >> np.uint64(16))[:k]


def pack(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(six), 2), np.uint8), six], 1).reshape(-1).view(">u8").astype(np.uint64)


def union(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two documents or parts."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = union(a, b, k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2**48)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(union(a, b, k), k) / distinct(a, k))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint."""

    def make():
        hashes = word_hashes()
        return lambda text: (pack(sketch_of(text, hashes)),)

    return over_documents(docs, make, [("fingerprint", pa.string(), "string")])


def _combined(batches):
    """Sketches per key, each key once in every run of ``FLUSH_KEYS`` keys."""
    held = {}

    def flush():
        columns = [pa.array(held.keys(), pa.string()), pa.array(map(pack, held.values()), pa.string())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["key", "fingerprint"])

    for batch in batches:
        for key, fingerprint in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new = unpack(fingerprint)
            held[key] = union(held[key], new) if key in held else new
            if len(held) > FLUSH_KEYS:
                yield flush()
    yield flush()


def merge(parts: DataFrame, key: str) -> DataFrame:
    """key, fingerprint: one sketch per key of (key, fingerprint) rows. Combined before and
    after the shuffle in streams, so a hot key reaches its task as a few rows per mapper."""
    ddl = "key string, fingerprint string"
    rows = parts.select(F.col(key).cast("string").alias("key"), "fingerprint")
    return rows.mapInArrow(_combined, ddl).repartition("key").sortWithinPartitions("key").mapInArrow(_last_of_run, ddl)


def _last_of_run(batches):
    key, held, rows = None, None, []
    for batch in batches:
        for next_key, fingerprint in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held is not None and next_key == key:
                held = union(held, unpack(fingerprint))
            else:
                if held is not None:
                    rows.append((key, pack(held)))
                key, held = next_key, unpack(fingerprint)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["key", "fingerprint"])
            rows = []
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([pack(held)], pa.string())], names=["key", "fingerprint"])


# --- each document beside the one after it ---


def _dealt(bounds, batches):
    """Rows with their range of ids. The largest of a range also goes, as a ghost, to the
    range above it, whose last document it follows; that of the top range to the lowest."""
    bounds = np.array(bounds, np.int64)
    for batch in batches:
        ids = batch.column(0)
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(bounds, known), len(bounds) - 1)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        place[null] = 0
        table = pa.table({"doc_id": ids, "text": batch.column(1)})
        edge = np.flatnonzero(~null & (bounds[place] == known))
        for rows, at, order in ((None, place, null.astype(np.int32)), (edge, (place[edge] + 1) % len(bounds), np.full(len(edge), 2, np.int32))):
            part = table if rows is None else table.take(pa.array(rows))
            part = part.add_column(0, "place", pa.array(at, pa.int32())).add_column(1, "turn", pa.array(order, pa.int32()))
            yield from part.combine_chunks().to_batches()


EDITED = [
    ("doc_id", pa.int64(), "long"),
    ("n_chars", pa.int64(), "long"),
    ("edited_sha256", pa.string(), "string"),
    ("fingerprint", pa.string(), "string"),
    ("edited_fingerprint", pa.string(), "string"),
    ("near_edited", pa.float64(), "double"),
    ("near_next", pa.float64(), "double"),
]


def _beside_next(batches):
    hashes, rows, size = word_hashes(), [], 0
    waiting = None  # (range, doc_id, text, sketch): the row that its next one completes
    for batch in batches:
        columns = [batch.column(i) for i in range(3)]
        for (place, turn, doc_id), text in zip(zip(*(c.to_pylist() for c in columns)), batch.column(3)):
            if waiting is None and turn == 2:
                continue  # a further row of the ghost's id
            text = text.as_py() or ""
            own = sketch_of(text, hashes)
            if waiting is not None and waiting[0] == place:
                _, before, old, sketch = waiting
                half = len(old) // 2
                edited = old[: len(old) - half] + text[:half]
                changed = sketch_of(edited, hashes)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((before, len(old), digest, pack(sketch), pack(changed), resemblance(sketch, changed), resemblance(sketch, own)))
                size += len(old)
            waiting = None if turn == 2 else (place, doc_id, text, own)
            if size > CHUNK_CHARS:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind, _) in zip(zip(*rows), EDITED)], names=[n for n, _, _ in EDITED])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each
    other and to the next document. One shuffle of the texts, by ranges of ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = int(min(MOST_RANGES, 1 + docs.count() // RANGE_ROWS))
    shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges + 1)))
    # percentile_approx gives values that occur: each bound is the largest id of its range
    found = rows.agg(F.percentile_approx("doc_id", shares, 10 * ranges + 1000).alias("at"), F.max("doc_id").alias("top")).first()
    bounds = sorted({*(found["at"] or []), found["top"]} - {None}) or [0]
    dealt = rows.mapInArrow(partial(_dealt, bounds), "place int, turn int, doc_id long, text string")
    if found["top"] is None:  # no id is an edge: the first row by text follows the last
        dealt = dealt.unionByName(rows.orderBy("text").limit(1).select(F.lit(0).alias("place"), F.lit(2).alias("turn"), "doc_id", "text"))
    ordered = dealt.repartition(len(bounds), "place").sortWithinPartitions("place", "turn", F.desc("doc_id"), "text")
    return ordered.mapInArrow(_beside_next, ", ".join(f"{name} {sql}" for name, _, sql in EDITED))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, before and after an edit."""
    return edited_likeness(documents(spark, sf_dir))
