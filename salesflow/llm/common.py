"""What the text operators share: reading documents, running a function over whole
texts in Arrow batches, and intermediate tables in the shared folder."""

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow import session

#: A mapping task hands on a batch whenever it has gathered this many characters of input.
CHUNK_CHARS = 4_000_000
#: Of Spark: the most bytes of one batch sent to a worker, where the session sets none of its own.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Words in a generation of a word cache; two generations bound a worker's memory.
CACHE_WORDS = 250_000
#: The same where a word's value is a hash, quickly computed again.
HASHED_WORDS = 60_000
#: Longer words are computed each time and never cached.
CACHED_CHARS = 48


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and bound what one
    batch of texts holds in them: some rows are a few bytes, some many megabytes."""
    session.ship(spark)
    if spark.conf.get(BATCH_SETTING, None) in (None, str(2**31 - 1), "-1"):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def free(columns: Iterable[str], name: str) -> str:
    """``name``, made longer until no column has it. Spark tells names apart without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class WordCache(dict):
    """word -> ``compute(word)``, of bounded size: when full, the words not asked for since
    the last time it was full are forgotten."""

    def __init__(self, compute: Callable, most: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.compute(word)
        if len(word) <= CACHED_CHARS:
            self.put(word, value)
        return value

    def put(self, word, value):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = value


_held: dict = {}


def held(key, make: Callable):
    """``make()``, kept in the worker process between tasks. A worker keeps one such object,
    so that stages of one session do not add up their caches."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Frees what an earlier stage kept in this worker, and hands unused memory back."""
    _held.clear()
    gc.collect()
    _hand_back()


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(mapper: Callable) -> Callable:
    """``mapper``, a generator over batches, that hands unused memory back when it ends: a worker waits
    for its next task for up to a minute, beside others that run."""

    @wraps(mapper)
    def run(*given):
        try:
            yield from mapper(*given)
        finally:
            _hand_back()

    return run


_released: list = [None]


def release_once() -> None:
    """The same, by the first call in a task alone: it takes as long as a small group's work."""
    task = TaskContext.get()
    if task is None or task.taskAttemptId() != _released[0]:
        release()
        _released[0] = task and task.taskAttemptId()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def over_texts(make: Callable[[], Callable[[str], tuple]], schema: pa.Schema) -> Callable:
    """A function for ``mapInArrow`` over (key columns..., text). ``make`` builds, once a
    task, the function from a text (null: empty) to the values of the columns of ``schema``
    after the key columns."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            keys, texts = batch.columns[:-1], batch.columns[-1]
            at = 0
            while at < len(texts):
                done, size, found = at, 0, []
                while done < len(texts) and size < CHUNK_CHARS:
                    text = texts[done].as_py() or ""
                    found.append(one(text))
                    size += len(text)
                    done += 1
                fields = list(schema)[len(keys) :]
                values = [pa.array(column, field.type) for column, field in zip(zip(*found), fields)]
                yield pa.RecordBatch.from_arrays([k.slice(at, done - at) for k in keys] + values, schema=schema)
                at = done

    return run


def over_documents(docs: DataFrame, make: Callable, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Runs ``make()``'s function over doc_id and text of ``docs``; ``fields`` are the
    resulting columns as (name, Arrow type, SQL type). Other columns are not carried."""
    schema = pa.schema([("doc_id", pa.int64()), *((name, kind) for name, kind, _ in fields)])
    ddl = ", ".join(["doc_id long", *(f"{name} {sql}" for name, _, sql in fields)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(over_texts(make, schema), ddl)


class Stored:
    """Intermediate tables of one run, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, session.workspace(spark, label)

    def __call__(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the tables; for those whose only readers have been stored elsewhere."""
        place, system = session.folder(self.spark, self.root)
        system.delete(place, True)


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def lowered_words(text: str) -> list[bytes]:
    """The same, with A-Z in lower case; ``bytes.lower`` changes nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashed(words: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes of words: ``xxh3_64_intdigest`` of each, joined as bytes, which takes less than making numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(words: Iterable[bytes], hashes: dict, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words; with fewer words, of the
    whole sequence as one; of no words, none."""
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64)
    if not len(one):
        return one
    span = min(width, len(one))
    total = np.full(len(one) - span + 1, span, np.uint64)
    for i in range(span):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + one[i : len(one) - span + 1 + i])
    return np.unique(total)
