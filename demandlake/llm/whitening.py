"""Embedding whitening by shifted CholeskyQR.

The fit list is every distinct integer vector x = floor(64 * c) + 1000000 once, counted by one
aggregate and written to the shared checkpoint folder. ``fit`` takes n and the sums S from it, then
runs Gram passes: each task centres its rows, applies the triangular factors found so far by
substitution, and adds up q'q; Spark sums the d x d partial results, and the driver takes the
Cholesky factor of the sum. The first Gram matrix, and any that Cholesky cannot factor, is shifted
by 11 (n d + d (d + 1)) u times its largest eigenvalue, so no pass breaks down. Passes (three at
least) end when the rows are orthonormal; R is the product of the factors, and its singular values
and right singular vectors give the eigenvalues and components. A last pass measures the whitened
covariance. Only d x d matrices reach the driver, whatever the number of rows.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped, and so
are vectors without entries or of another width than that of most distinct vectors (ties: the
wider); floor(64 * c) counts as at most 2**35 in size; repeated rows and ids are transformed each on
their own and count once in the fit; a component without variance (to double precision, 1e-13 of the
largest deviation) has explained 0 and a null ``whitened``; ``deviation`` is null where it exceeds a
long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, save, table

SCALE, OFFSET, BOUND = 64, 1_000_000, 2.0**35
COMPONENTS = 16
LEAST_PASSES, MOST_PASSES = 3, 10
CLOSE = 1e-12  # of the Gram matrix to the identity
FLAT = 1e-13  # a deviation below this share of the largest is none
STEP = 2048  # rows at a time


@dataclass(frozen=True)
class Whitener:
    """What ``fit`` learns: counts and sums of the fit list, components (d x k, falling variance) and how far whitening got."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def width(self) -> int:
        return len(self.sums)


def integers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable rows, their widths, their x laid end to end) of a list column."""
    lengths = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(lengths)
    keep = (bad[ends] == bad[ends - lengths]) & (lengths > 0)
    own = flat[np.repeat(keep, lengths)]
    return np.flatnonzero(keep), lengths[keep], np.clip(np.floor(SCALE * own), -BOUND, BOUND).astype(np.int64) + OFFSET


def fit_list(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(x): each distinct x vector once, as little-endian 64-bit integers."""

    def run(batches):
        for b in batches:
            _, widths, x = integers(b.column(0))
            flat, at = x.astype("<i8").tobytes(), 8 * np.concatenate([[0], np.cumsum(widths)])
            yield pa.RecordBatch.from_arrays([pa.array([flat[a:z] for a, z in zip(at[:-1], at[1:])], pa.binary())], names=["x"])

    return arrow_map(vectors.select(column), run, "x binary").distinct()


def _centre(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, the whole parts subtracted first."""
    whole = sums // n
    return (x - whole) - (sums - n * whole) / n


def substitute(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The q with r' q = a for an upper triangular r: rows of data are columns here."""
    q = np.empty_like(a)
    for j in range(len(r)):
        q[j] = (a[j] - r[:j, j] @ q[:j]) / r[j, j]
    return q


def _passes(listed: DataFrame, width: int):
    """A function that sums, over the rows of the fit list, what ``part`` makes of a block of them (a matrix of fixed shape)."""

    def total(part, shape: tuple[int, int]) -> np.ndarray:
        def run(batches):
            held = np.zeros(shape)
            for b in batches:
                for a in range(0, b.num_rows, STEP):
                    x = np.frombuffer(b"".join(b.column(0).slice(a, STEP).to_pylist()), "<i8").reshape(-1, width)
                    held += part(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), pa.array(list(held), pa.list_(pa.float64()))], names=["i", "row"])

        cells = arrow_map(listed, run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
        out = np.zeros(shape)
        for r in cells.collect():  # width x width cells at most
            out[r.i, r.j] = r.v
        return out

    return total


def _sums(listed: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """(n, exact sums per dimension)."""

    def run(batches):
        n, held = 0, np.zeros(width, np.int64)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8").reshape(-1, width)
            n, held = n + len(x), held + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(held), pa.array(np.full(width, n))], names=["i", "s", "n"])

    rows = arrow_map(listed, run, "i int, s long, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return rows[0].n, np.array([r.s for r in rows], np.int64)


def factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular r with r' r = gram, shifted if asked to or if it has no such factor."""
    d = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(np.linalg.eigvalsh(gram)[-1], np.finfo(float).tiny)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """Whitening components of the distinct vectors; None if there is no usable vector."""
    listed = save(fit_list(vectors, column), "fit-list")
    widths = listed.groupBy((F.octet_length("x") / 8).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("k"))
    most = widths.orderBy(F.desc("k"), F.desc("d")).first()
    if most is None:
        return None
    d = most.d
    listed = listed.where(F.octet_length("x") == 8 * d)
    n, sums = _sums(listed, d)
    total, factors, r = _passes(listed, d), [], np.eye(d)
    while True:
        def gram(x, factors=tuple(factors)):
            q = np.ascontiguousarray(_centre(x, n, sums).T)
            for f in factors:
                q = substitute(q, f)
            return q @ q.T

        g = total(gram, (d, d))
        if not factors:
            trace = float(np.trace(g)) / n
        if not np.any(g) or (len(factors) >= LEAST_PASSES and np.abs(g - np.eye(d)).max() < CLOSE) or len(factors) == MOST_PASSES:
            break
        factors.append(factor(g, n, shifted=not factors))
        r = factors[-1] @ r
    spread, v = (np.zeros(d), np.eye(d)) if not factors else np.linalg.svd(r)[1:]
    k = min(components, d)
    spread = np.where(spread > FLAT * max(spread[0], 1e-300), spread, 0.0)[:k]
    v = v[:k].T * np.where(v[:k].T[np.abs(v[:k].T).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    variances = spread**2 / n
    live = variances > 0
    error = 0.0
    if live.any():
        scaled = v[:, live] / np.sqrt(variances[live])

        def whitened(x):
            w = _centre(x, n, sums) @ scaled
            return w.T @ w

        error = float(np.abs(total(whitened, (int(live.sum()), int(live.sum()))) / n - np.eye(int(live.sum()))).max())
    return Whitener(n, sums, v, variances, trace, error, len(factors))


def transform(vectors: DataFrame, model: Whitener, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    d, k, n, sums = model.width, model.components.shape[1], model.n, model.sums
    live = model.variances > 0
    scaled = model.components * np.where(live, 1 / np.sqrt(np.where(live, model.variances, 1.0)), 0.0)
    explained = model.variances / model.trace if model.trace > 0 else np.zeros(k)
    whole = sums // n

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                b = batch.slice(a, STEP)
                usable, widths, x = integers(b.column(1))
                x = x[np.repeat(widths == d, widths)].reshape(-1, d)
                usable = usable[widths == d]
                white = _centre(x, n, sums) @ scaled
                near = n * (x - whole).astype(float) - (sums - n * whole)
                fits = (near**2).sum(1) < 2.0**63 * 0.999
                gaps = np.where(fits[:, None], n * (x - whole) - (sums - n * whole), 0)
                deviation = pa.array((gaps * gaps).sum(1), mask=~fits)
                rows = np.repeat(np.arange(len(usable)), k)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(usable[rows])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(usable))), pa.array(np.full(len(rows), n, np.int64)), deviation.take(pa.array(rows)),
                    pa.array(white.ravel(), mask=np.tile(~live, len(usable))), pa.array(np.tile(explained, len(usable))), pa.array(np.full(len(rows), model.identity_error))],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    key_type = vectors.schema[key].dataType.simpleString()
    return arrow_map(vectors.select(key, column), run, f"`{key}` {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_embedding_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    model = fit(vectors)
    if model is None:
        model = Whitener(1, np.zeros(1, np.int64), np.zeros((1, 1)), np.zeros(1), 0.0, 0.0, 0)
    return transform(vectors, model)
