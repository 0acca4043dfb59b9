"""Whitening of embeddings, with components from spectral divide-and-conquer by QDWH.

An entry c becomes the whole number floor(256 c); past the range of long it is the nearest
long. The fit list holds each different whole vector once. Its size, sums and covariance V
are sums over Spark tasks, centred before anything is multiplied; V has as many rows as a
vector has entries, whatever the number of vectors, and goes to the driver.

There V is split until only single directions are left. The polar factor of V - s I, by the
QR- and Cholesky-based dynamically weighted Halley iteration, is the matrix sign: +1 on the
eigenvectors above the shift s and -1 on those below. Half of it plus the identity projects onto
the upper invariant subspace; V restricted to it and to its complement are two smaller
problems of the same kind. The largest ``components`` eigenpairs are broadcast (numbers of
entries times components), and every row is projected by them.

Rows whose vector is null or holds a null or a non-finite entry are dropped. A vector shorter
than the longest counts as filled up by zeros, also an empty one. Repeated rows are each
returned; a null vec_id stays null. Vectors of no entry at all have no component and give no rows. A
component without variance has whitened 0 and explained 0 and is left out of the identity error.
``deviation`` is exact; where it passes a long it is null, and ``deviation_text`` has its
digits. Only vec_id and embedding are read, so extra columns of any name do no harm.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.common import Stored, ship

UNIT = 256
COMPONENTS = 4
#: A worker turns this many entries into doubles at a time.
CHUNK_ENTRIES = 1 << 20
_KINDS = ("<i1", "<i2", "<i4", "<i8")
_EPS = float(np.finfo(float).eps)


# --- whole vectors ---


def packed(x: np.ndarray) -> bytes:
    """A whole vector in the narrowest integers that hold it, without zeros at its end: equal
    vectors, filled up or not, have equal bytes."""
    last = np.flatnonzero(x)
    x = x[: last[-1] + 1] if len(last) else x[:0]
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kind = next(k for k, t in enumerate(_KINDS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([kind]) + x.astype(_KINDS[kind]).tobytes()


def unpacked(vectors: list[bytes], size: int) -> np.ndarray:
    """Rows of longs, filled up to ``size``."""
    rows = np.zeros((len(vectors), size), np.int64)
    if len({(len(raw), raw[0]) for raw in vectors}) == 1:
        found = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1)[:, 1:]
        found = np.ascontiguousarray(found).view(_KINDS[vectors[0][0]])
        rows[:, : found.shape[1]] = found
        return rows
    for row, raw in zip(rows, vectors):
        found = np.frombuffer(raw, _KINDS[raw[0]], offset=1)
        row[: len(found)] = found
    return rows


def whole(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(c * UNIT)
    # the largest double below 2^63 is 1024 less
    x = np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, x)


def _quantize(batches):
    for batch in batches:
        widest = max([1, *(n or 0 for n in pc.list_value_length(batch.column(1)).to_pylist())])
        step = max(1, CHUNK_ENTRIES // widest)
        for at in range(0, len(batch), step):
            some = batch.slice(at, step)
            lists = some.column(1)
            ends = lists.offsets.to_numpy()
            entries = lists.values.slice(ends[0], ends[-1] - ends[0]).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = ends - ends[0]
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
            usable = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]])
            x = whole(np.where(np.isfinite(entries), entries, 0.0))
            rows = np.flatnonzero(usable)
            found = [packed(x[ends[i] : ends[i + 1]]) for i in rows]
            sizes = (ends[1:] - ends[:-1])[rows]
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows)), pa.array(found, pa.binary()), pa.array(sizes, pa.int64())], names=["vec_id", "x", "entries"])


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (packed), entries of all rows that are not dropped."""
    ship(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(_quantize, "vec_id long, x binary, entries long")


# --- sums over the fit list ---


def _chunks(batches, size):
    for batch in batches:
        xs = batch.column("x").to_pylist()
        step = max(1, CHUNK_ENTRIES // max(1, size))
        for at in range(0, len(xs), step):
            yield unpacked(xs[at : at + step], size)


def _narrow(rows: np.ndarray) -> bool:
    """Whether sums of the rows fit a long."""
    return not rows.size or max(-int(rows.min()), int(rows.max())) < 2**62 // len(rows)


def _sum(size, batches):
    total = [0] * size
    for rows in _chunks(batches, size):
        part = rows.sum(0) if _narrow(rows) else rows.astype(object).sum(0)
        total = [a + int(b) for a, b in zip(total, part)]
    text = pa.array([str(t) for t in total], pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), text], names=["dimension", "total"])


def _products(sent, batches):
    """Products of centred vectors, projected before if ``sent`` has a projection."""
    size, mean, onto = sent.value
    width = size if onto is None else onto.shape[1]
    total = np.zeros((width, width))
    for rows in _chunks(batches, size):
        centred = rows - mean
        if onto is not None:
            centred = centred @ onto
        total += centred.T @ centred
    yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])


def products(fitted: DataFrame, n: int, size: int, mean: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """The covariance over the fit list. Each task sends one matrix; equal cells are summed by Spark."""
    sent = fitted.sparkSession.sparkContext.broadcast((size, mean, onto))
    cells = fitted.mapInArrow(partial(_products, sent), "i long, row array<double>").select("i", F.posexplode("row").alias("j", "value"))
    width = size if onto is None else onto.shape[1]
    found = np.zeros((width, width))
    for i, j, value in cells.groupBy("i", "j").agg(F.sum("value")).collect():
        found[i, j] = value / n
    return (found + found.T) / 2


# --- components ---


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix: its matrix sign, where it is not singular."""
    bound = np.abs(a).sum(0).max()
    if not bound:
        return np.eye(len(a))
    x, low, one = a / bound, _EPS / 4, np.eye(len(a))
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        weight = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        if c > 100:
            # stable for a matrix of any condition
            q = np.linalg.qr(np.concatenate([np.sqrt(c) * x, one]))[0]
            after = b / c * x + (weight - b / c) / np.sqrt(c) * q[: len(a)] @ q[len(a) :].T
        else:
            root = np.linalg.cholesky(one + c * x.T @ x)
            after = b / c * x + (weight - b / c) * np.linalg.solve(root.T, np.linalg.solve(root, x.T)).T
        after = (after + after.T) / 2
        moved, x = np.abs(after - x).max(), after
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        if moved < np.cbrt(_EPS) / 100 and 1 - low < 10 * _EPS or low == 1.0 and moved < 10 * _EPS:
            break
        low = min(low, 1 - _EPS / 2)
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Bases of the invariant subspaces above and below the shift, and how far they are from invariant."""
    projector = (polar(a - shift * np.eye(len(a))) + np.eye(len(a))) / 2
    rank = int(round(float(np.trace(projector))))
    if not 0 < rank < len(a):
        return a, a, np.inf
    # a random start meets every direction of the subspace; the projection is repeated once
    start = np.random.default_rng(len(a)).normal(size=(len(a), rank))
    basis = np.linalg.qr(projector @ np.linalg.qr(projector @ start)[0])[0]
    full = np.linalg.qr(np.concatenate([basis, np.eye(len(a)) - basis @ basis.T], 1))[0]
    upper, lower = full[:, :rank], full[:, rank : len(a)]
    return upper, lower, float(np.abs(lower.T @ a @ upper).max())


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix. Of equal
    eigenvalues any orthonormal directions are right. The largest entry of a vector is positive."""
    size, norm = len(v), np.linalg.norm(v)
    found, todo = [], [(v, np.eye(size))]
    while todo:
        a, basis = todo.pop()
        middle = float(np.trace(a)) / max(1, len(a))
        if len(a) <= 1 or np.linalg.norm(a - middle * np.eye(len(a))) <= _EPS * norm:
            found.append(basis)
            continue
        best = None
        diagonal = np.sort(np.diag(a))
        # the mean of all eigenvalues lies between the first and the last; others in case it is close to one
        for shift in (middle, float(np.median(diagonal)), middle + 0.3 * np.sqrt(np.square(a - middle * np.eye(len(a))).sum() / len(a)), float(diagonal[len(a) // 4]), float(diagonal[3 * len(a) // 4])):
            tried = _halves(a, shift)
            if best is None or tried[2] < best[2]:
                best = tried
            if best[2] <= 8 * _EPS * norm:
                break
        upper, lower, off = best
        if off > 1e-8 * norm:
            # the remaining eigenvalues are one within rounding
            found.append(basis)
            continue
        todo += [(part.T @ a @ part, basis @ part) for part in (lower, upper)]
    vectors_ = np.linalg.qr(np.concatenate(found, 1))[0]
    values = np.einsum("ij,ij->j", vectors_, v @ vectors_)
    order = np.argsort(-values, kind="stable")
    values, vectors_ = values[order], vectors_[:, order]
    signs = np.sign(vectors_[np.abs(vectors_).argmax(0), np.arange(size)])
    return values, vectors_ * signs


# --- rows ---


class Model:
    """What rows are projected by: n, sums S, mean S / n, and per component its vector over the
    square root of its eigenvalue, its share of the variance, and one identity error."""

    def __init__(self, n: int, sums: list[int], onto: np.ndarray, explained: np.ndarray, error: float):
        self.n, self.sums, self.onto, self.explained, self.error = n, sums, onto, explained, error
        self.mean = np.array([s / n for s in sums])


def fit(rows: DataFrame, store: Stored, most: int = COMPONENTS) -> Model | None:
    """``rows`` from ``vectors``. None where there is no component."""
    fitted = store(rows.groupBy("x").agg(F.max("entries").alias("entries")), "fit")
    n, size = fitted.agg(F.count(F.lit(1)), F.max("entries")).first()
    if not size:
        return None
    sums = [0] * size
    cells = fitted.mapInArrow(partial(_sum, size), "dimension long, total string")
    for dimension, total in cells.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():
        sums[dimension] = int(total)
    mean = np.array([s / n for s in sums])
    v = products(fitted, n, size, mean)
    values, directions = components(v)
    trace = float(np.trace(v))
    values, directions = values[:most], directions[:, :most]
    real = values > size * _EPS * max(trace, 0.0)
    onto = np.where(real, directions / np.sqrt(np.where(real, values, 1.0)), 0.0)
    explained = np.where(real, values / (trace or 1.0), 0.0)
    error = np.abs(products(fitted, n, size, mean, onto) - np.diag(real.astype(float))).max()
    return Model(n, sums, onto, explained, float(error))


def _project(sent, batches):
    model = sent.value
    size, width = model.onto.shape
    sums = np.array(model.sums, object)
    small = max(map(abs, model.sums)) < 2**62
    for batch in batches:
        xs = batch.column("x").to_pylist()
        step = max(1, CHUNK_ENTRIES // size)
        for at in range(0, len(xs), step):
            rows = unpacked(xs[at : at + step], size)
            ids = batch.column("vec_id").slice(at, len(rows)).take(pa.array(np.repeat(np.arange(len(rows)), width)))
            white = ((rows - model.mean) @ model.onto).ravel()
            far = max(-int(rows.min()), int(rows.max())) * model.n + max(map(abs, model.sums))
            if small and far < 2**62 and size * far * far < 2**63:
                apart = rows * model.n - np.array(model.sums, np.int64)
                exact = (apart * apart).sum(1).tolist()
            else:
                apart = rows.astype(object) * model.n - sums
                exact = (apart * apart).sum(1).tolist()
            each = [e for e in exact for _ in range(width)]
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, width + 1), len(rows)), pa.int32()),
                pa.array(np.full(len(white), model.n), pa.int64()),
                pa.array([e if e < 2**63 else None for e in each], pa.int64()),
                pa.array(white, pa.float64()),
                pa.array(np.tile(model.explained, len(rows)), pa.float64()),
                pa.array(np.full(len(white), model.error), pa.float64()),
                pa.array([str(e) for e in each], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"])


def whiten(embeddings: DataFrame, store: Stored, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text: a row for
    each remaining row and each of its first ``most`` components."""
    rows = vectors(embeddings)
    model = fit(rows, store, most)
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], ddl)
    sent = embeddings.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_project, sent), ddl)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened vectors of the whole table, by its first components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Stored(spark, "whitening"))
