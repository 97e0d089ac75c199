"""Whitening of embeddings by eigenvectors refined in mixed precision.

Entries become whole numbers, so all sums are exact: pass one adds up the vectors, pass two the
products of the vectors less their whole mean, pass three projects. Tasks multiply matrices and
send sums of at most ``dim`` x ``dim`` numbers, added by Spark. On the driver, which never holds more than that
matrix, eigenvectors in single precision start the iteration of Ogita and Aishima: with
R = I - X'X and S = X'AX, each step corrects X by X E, where E is (S + lambda R) over the
eigenvalue gap, or R / 2 where a gap is no larger than the error bound. Eigenvalues that stay so
close are a cluster: its own small problem, shifted to its mean, is solved after each step.
Matrices are held in long double, so the components are right to double precision. (Where the
platform's long double is a plain double, the last one or two bits are not.)

Cases: rows whose vector is null or has null, infinite or NaN entries are dropped, as are vectors
of another length than the most frequent one (the longer one of a tie) and empty vectors; a null
id and repeated rows are kept, each row on its own; an empty table gives an empty result; a
component without variance (fewer rows than dimensions, constant vectors) has a null ``whitened``
and counts in no ``identity_error``; equal eigenvalues give any orthonormal basis of their space.
Other columns are not read. Values too large for exact 64-bit sums raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.scratch import materialize

COMPONENTS = 8
#: The driver holds a few matrices of this many rows and columns at most.
MAX_DIM = 4096
#: Entries handled at once in a task.
BLOCK_ENTRIES = 1 << 19
STEPS = 12
EXACT = 1 << 53


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x array<bigint>) of the usable rows, all of one length."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(vector) > 0)
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("v")).where(usable)
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    if dim > MAX_DIM:
        raise ValueError(f"{dim} dimensions, at most {MAX_DIM}")
    whole = F.transform("v", lambda c: F.floor(c * scale).cast("long") + shift)
    return rows.where(F.size("v") == dim).select("vec_id", whole.alias("x"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their ``x`` as a matrix), of bounded size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        dim = len(batch.column("x")[0])
        step = max(1, BLOCK_ENTRIES // dim)
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, np.asarray(pc.list_flatten(part.column("x")), np.int64).reshape(part.num_rows, dim)


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x'x in whole numbers: by float matrix products while these are exact, else by integer ones."""
    top = int(np.abs(x).max(initial=0))
    if top * top * len(x) < EXACT:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    if top * top * len(x) >= 1 << 63:
        raise OverflowError("products of the vectors do not fit 64 bits")
    return x.T @ x


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in blocks(batches):
            if int(np.abs(x).max(initial=0)) * len(x) >= 1 << 63:
                raise OverflowError("sums of the vectors do not fit 64 bits")
            yield pa.RecordBatch.from_pydict(
                {"d": np.arange(x.shape[1], dtype=np.int32), "s": x.sum(0), "n": np.full(x.shape[1], len(x))}
            )

    added = rows.select("x").mapInArrow(add, "d int, s long, n long").groupBy("d")
    out = added.agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n")).collect()  # MAX_DIM rows at most
    out.sort(key=lambda r: r["d"])
    return (out[0]["n"] if out else 0), [int(r["s"]) for r in out]


def centred_products(rows: DataFrame, mean: list[int]) -> list[tuple[int, int, int]]:
    """(i, j, sum of products) for i <= j, exact, of the vectors less the whole numbers ``mean``."""
    middle = np.array(mean, np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(len(middle))
        total = None
        for _, x in blocks(batches):
            gram = exact_gram(x - middle)
            if total is not None and int(np.abs(total).max()) + int(np.abs(gram).max()) >= 1 << 62:
                yield send(i, j, total)
                total = None
            total = gram if total is None else total + gram
        if total is not None:
            yield send(i, j, total)

    def send(i: np.ndarray, j: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    added = rows.select("x").mapInArrow(multiply, "i int, j int, s long").groupBy("i", "j")
    out = added.agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()  # MAX_DIM squared rows at most
    return [(r["i"], r["j"], int(r["s"])) for r in out]


def long_double(value: int) -> np.longdouble:
    """A whole number of any size, rounded once."""
    high, low = divmod(abs(value), 1 << 60)
    out = np.longdouble(float(high >> 60)) * np.longdouble(2.0**120) + np.longdouble(high & ((1 << 60) - 1)) * np.longdouble(2.0**60)
    return (out + np.longdouble(low)) * (1 if value >= 0 else -1)


def covariance(n: int, rest: list[int], products: list[tuple[int, int, int]]) -> np.ndarray:
    """Covariance, divisor ``n``: whole-number arithmetic, one rounding to long double for each entry."""
    out = np.zeros((len(rest), len(rest)), np.longdouble)
    for i, j, s in products:
        out[i, j] = out[j, i] = long_double(n * s - rest[i] * rest[j])
    return out / np.longdouble(n) / np.longdouble(n)


def clusters(values: np.ndarray, bound: float) -> list[np.ndarray]:
    """Index groups, of two or more, of values that lie within ``bound`` of a neighbour."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > bound) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns of ``x``, nearly orthonormal, made so by Newton steps in its own precision."""
    for _ in range(3):
        x = x + x @ (np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2
    return x


def refine(a: np.ndarray, x: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of the symmetric ``a`` in its precision, from approximate vectors ``x``."""
    x, one = x.astype(a.dtype), np.eye(len(a), dtype=a.dtype)
    size = np.sqrt((a * a).sum())
    for _ in range(steps):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        bound = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > bound
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        np.fill_diagonal(e, np.diag(r) / 2)
        x = x + x @ e
        change = np.abs(e).max()
        for group in clusters(values, bound):
            basis = orthonormal(x[:, group])
            middle = values[group].mean()
            small = basis.T @ (a @ basis - middle * basis)
            top = np.abs(small).max()
            if top:  # shifted and scaled, so that the cluster's own gaps are what the solver sees
                _, turn = np.linalg.eigh(((small + small.T) / (2 * top)).astype(np.float64))
                basis = basis @ orthonormal(turn.astype(a.dtype))
            x[:, group] = basis
        if change <= 2 * np.finfo(a.dtype).eps:
            break
    x = orthonormal(x)
    values = (x * (a @ x)).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of the covariance ``a``."""
    size = np.abs(a).max(initial=0)
    if not size:
        return np.zeros(len(a), a.dtype), np.eye(len(a), dtype=a.dtype)
    _, start = np.linalg.eigh((a / size).astype(np.float32))
    return refine(a, start)


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the kept components, falling
    vectors: np.ndarray  # one column each
    trace: float

    @property
    def alive(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values.astype(np.float64) > self.trace * len(self.sums) * np.finfo(np.float64).eps


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The first ``components`` of all rows of ``x``; None without rows."""
    n, totals = sums(rows)
    if not n:
        return None
    mean = [s // n for s in totals]
    rest = [s - n * m for s, m in zip(totals, mean)]
    a = covariance(n, rest, centred_products(rows, mean))
    values, vectors = eigen(a)
    return Whitening(n, totals, values[:components], vectors[:, :components], float(np.trace(a)))


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, w array<double>) of each row; entries of ``w`` without variance are null."""
    alive = model.alive
    scale = np.where(alive, np.sqrt(np.where(alive, model.values, 1)), 1)
    basis = (model.vectors / scale).astype(np.float64)
    n, mean = model.n, [s // model.n for s in model.sums]
    rest = [s - model.n * m for s, m in zip(model.sums, mean)]
    middle, left = np.array(mean, np.int64), np.array(rest, np.int64)
    part_of_one = np.array([r / n for r in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dead = np.flatnonzero(~alive)
        for part, x in blocks(batches):
            x = x - middle
            top = int(np.abs(x).max(initial=0)) * n + n
            if top * top * x.shape[1] >= 1 << 63:
                exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in x.tolist()]
                if max(exact) >= 1 << 63:
                    raise OverflowError("a deviation does not fit 64 bits")
                deviation = np.array(exact, np.int64)
            else:
                apart = n * x - left
                deviation = (apart * apart).sum(1)
            w = (x.astype(np.float64) - part_of_one) @ basis
            mask = np.zeros(w.shape, bool)
            mask[:, dead] = True
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id"),
                    pa.array(deviation),
                    pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), mask=mask.ravel())),
                ],
                ["vec_id", "deviation", "w"],
            )

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {id_type}, deviation long, w array<double>")


def identity_error(projected: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of ``w`` less the identity, worked out from the rows themselves."""
    alive = np.flatnonzero(model.alive).tolist()
    if not alive:
        return None
    means = projected.agg(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in alive]).first()
    off = {i: F.get("w", F.lit(i)) - F.lit(means[f"m{i}"]) for i in alive}
    pairs = [(i, j) for i in alive for j in alive if i <= j]
    found = projected.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    scale: int = 1024,
    shift: int = 100_000,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = whole_numbers(vectors, id_col, vector_col, scale, shift)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    projected = materialize(project(rows, model), "whitened")
    error = F.lit(identity_error(projected, model)).cast("double")
    share = [float(v) / model.trace if model.trace else 0.0 for v in model.values]
    explained = F.get(F.array(*map(F.lit, share)), F.col("at"))
    each = projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        error.alias("identity_error"),
    )
