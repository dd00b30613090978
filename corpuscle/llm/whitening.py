"""Embedding whitening by a bit-sliced scatter matrix.

Entries become integers. Each dimension is shifted by its minimum, and the bit planes of the shifted
values are packed across rows into 64-bit words: the cross-product of two dimensions is then a sum of
AND-popcounts of their planes, weighted by powers of two, and exact. Partial sums meet in a group-by
by pair of dimensions; the driver centres the matrix in whole numbers and only then takes eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ego_join import _matrices

#: Rows whose planes are packed at a time, and bits of the sums that one row of the scatter carries.
PACKED_ROWS, LIMB = 1 << 15, 32
#: Larger values, in size, count as this; all sums stay exact.
MOST = 1 << 56


@dataclass
class Model:
    """What whitening needs of all vectors of one width."""

    n: int
    sums: np.ndarray  # int64, or Python integers where they do not fit
    directions: np.ndarray  # width x components
    scales: np.ndarray  # square roots of the eigenvalues, 0 where a direction holds nothing
    explained: np.ndarray
    identity_error: float | None = None


def quantize(x: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64) + shift


def _sound(column: pa.Array, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) of the vectors without null or non-finite entries, by width."""
    for rows, x in _matrices(column):
        ok = np.isfinite(x).all(1) & (x.shape[1] > 0)
        if ok.any():
            yield rows[ok], quantize(x[ok], scale, shift)


def _encode(x: np.ndarray, shift: int) -> list[bytes]:
    """One key per row, equal for equal vectors: a byte for the smallest integer type that holds it less the shift, then the entries."""
    least, most = (x - shift).min(1), (x - shift).max(1)
    size = np.select([(least >= -(2 ** (b - 1))) & (most < 2 ** (b - 1)) for b in (8, 16, 32)], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(x)
    for s in np.unique(size).tolist():
        at = np.flatnonzero(size == s)
        raw = np.ascontiguousarray((x[at] - shift).astype(f"<i{s}"))
        for i, row in zip(at.tolist(), raw, strict=True):
            out[i] = b"%d" % s + row.tobytes()
    return out


def _decode(keys: list[bytes], shift: int) -> Iterator[np.ndarray]:
    """Integer matrices of keys of one width."""
    kinds: dict[int, list[bytes]] = {}
    for k in keys:
        kinds.setdefault(k[0] - 48, []).append(k[1:])
    for s, rows in kinds.items():
        yield np.frombuffer(b"".join(rows), dtype=f"<i{s}").reshape(len(rows), -1).astype(np.int64) + shift


def _keys(scale: int, shift: int):
    schema = pa.schema([("width", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _sound(batch.column(0), scale, shift):
                keys = _encode(x, shift)
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(keys), pa.int32()), pa.array(keys, pa.binary())], schema=schema)

    return run


def _by_width(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[np.ndarray]:
    """Matrices of at most PACKED_ROWS rows."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for width, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(width, []).append(key)
            if len(held[width]) == PACKED_ROWS:
                yield from _decode(held.pop(width), shift)
    for keys in held.values():
        yield from _decode(keys, shift)


def _ranges(shift: int):
    """(width, dim, n, sums of the entries' low and high parts, least, most) of a task's vectors."""
    names = ["width", "dim", "n", "low", "high", "least", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_width(batches, shift):
            d = x.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([len(x)] * d, pa.int64()),
                *(pa.array(v) for v in ((x & (2**LIMB - 1)).sum(0), (x >> LIMB).sum(0), x.min(0), x.max(0))),
            ], names)

    return run


def scatter(x: np.ndarray, least: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """counts[i, j, s], i <= j: the weighted popcounts of the pairs of planes of dimensions i and j whose powers add up to s.

    The sum over s of counts * 2^s is the exact cross-product of the shifted dimensions.
    """
    d = x.shape[1]
    dim = np.repeat(np.arange(d), bits)
    power = np.concatenate([np.arange(b) for b in bits.tolist()]).astype(np.int64)
    words = -(-len(x) // 64)
    planes = np.zeros((len(dim), words * 8), dtype=np.uint8)
    shifted = np.ascontiguousarray((x - least).T)
    for k, (i, a) in enumerate(zip(dim.tolist(), power.tolist(), strict=True)):
        packed = np.packbits((shifted[i] >> a & 1).astype(bool))
        planes[k, : len(packed)] = packed
    planes = planes.view(np.uint64)
    top = 2 * int(bits.max(initial=1)) - 1
    counts = np.zeros((d, d, top), dtype=np.int64)
    for k, (i, a) in enumerate(zip(dim.tolist(), power.tolist(), strict=True)):
        both = np.bitwise_count(planes[k] & planes[k:]).sum(axis=1, dtype=np.int64)
        both[1:][dim[k + 1 :] == i] *= 2  # inside a dimension planes a < b stand for both orders
        np.add.at(counts[i], (dim[k:], a + power[k:]), both)
    return counts


def _scatter(ranges: dict[int, tuple[np.ndarray, np.ndarray]], shift: int):
    """(width, i, j, limb, value): value * 2^(32 limb), summed, is the cross-product of dimensions i <= j."""
    names = ["width", "i", "j", "limb", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for x in _by_width(batches, shift):
            counts = scatter(x, *ranges[x.shape[1]])
            sums[x.shape[1]] = sums.get(x.shape[1], 0) + counts
        for width, counts in sums.items():
            i, j = np.triu_indices(width)
            for limb, at in enumerate(range(0, counts.shape[2], LIMB)):
                part = counts[i, j, at : at + LIMB]
                value = (part << np.arange(part.shape[1])).sum(1)
                same = lambda v: pa.array(np.full(len(i), v, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([same(width), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), same(limb), pa.array(value)], names)

    return run


def solve(n: int, sums: list[int], cross: dict[tuple[int, int], int], components: int) -> Model:
    """The model of one width, from exact sums and exact sums of products (i <= j)."""
    d = len(sums)
    v = np.zeros((d, d))
    for (i, j), c in cross.items():
        v[i, j] = v[j, i] = (n * c - sums[i] * sums[j]) / (n * n)  # a quotient of whole numbers, rounded once
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(v))
    held = values > max(trace, 0.0) * d * np.finfo(float).eps
    values = np.where(held, values, 0.0)
    small = max(map(abs, sums), default=0) < 2**62
    return Model(n, np.array(sums, dtype=np.int64 if small else object), np.ascontiguousarray(vectors), np.sqrt(values), values / trace if trace > 0 else values)


def _centred(x: np.ndarray, model: Model) -> np.ndarray:
    """n x - S, in 64-bit integers where all fit."""
    most = max(abs(int(x.max())), abs(int(x.min())))
    if model.sums.dtype == np.int64 and model.n * most < 2**61:
        return model.n * x - model.sums
    return model.n * x.astype(object) - model.sums


def whitened(x: np.ndarray, model: Model) -> np.ndarray:
    """Vectors by components; NaN in components of variance 0."""
    y = (_centred(x, model) / model.n).astype(float) @ model.directions
    return np.divide(y, model.scales, out=np.full_like(y, np.nan), where=model.scales > 0)


def _deviation(x: np.ndarray, model: Model) -> pa.Array:
    """Sums over dimensions of (n x - S)^2; null beyond 64 bits."""
    c = _centred(x, model)
    if c.dtype == np.int64 and int(np.abs(c).max()) ** 2 * c.shape[1] < 2**63:
        return pa.array((c * c).sum(1))
    return pa.array([s if (s := sum(int(v) ** 2 for v in row)) < 2**63 else None for row in c], pa.int64())


def _moments(models, shift: int):
    """(width, i, j, value): sums of products of whitened components i <= j over a task's vectors, which are centred already."""
    names = ["width", "i", "j", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_width(batches, shift):
            w = whitened(x, models.value[x.shape[1]])
            i, j = np.triu_indices(w.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), x.shape[1], np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array((w.T @ w)[i, j])], names)

    return run


def _apply(models, scale: int, shift: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _sound(batch.column(1), scale, shift):
                model = models.value[x.shape[1]]
                w = whitened(x, model)
                m, k = w.shape
                each = np.repeat(np.arange(m), k)
                ids, deviation = batch.column(0).take(pa.array(rows[each])), _deviation(x, model).take(pa.array(each))
                error = pa.array([model.identity_error] * (m * k), pa.float64())
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation,
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(model.explained, m)), error,
                ], schema=schema)

    return run


def whiten(df: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Projects vectors onto unit-variance principal components, fitted on the distinct quantized vectors.

    An entry c, as double, becomes x = floor(scale * c) + shift. One row per vector and component: id_col,
    component (from 1, by falling variance, `components` at most), n (distinct x vectors), deviation (sum over
    dimensions of (n x - S)^2, exact; null beyond 64 bits), whitened, explained (share of the variance) and
    identity_error (largest absolute entry of the whitened vectors' covariance minus the identity, measured over
    the distinct vectors).

    Vectors that are null, or hold null or non-finite entries, are dropped, and so are empty ones, as they have no
    component. Vectors of different widths are fitted apart, each width with its own n, S and components. A component
    without variance (a constant dimension, a single vector) has whitened null, explained 0 and no part in
    identity_error, which is null if none has any. Entries beyond 2^56 in size count as 2^56. Repeated
    rows, repeated and null ids are rows of their own; other columns are ignored; an empty table gives an empty
    result. The driver holds width x width sums of each width, never vectors.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = materialize(vectors.select("v").mapInArrow(_keys(scale, shift), "width int, x binary").distinct(), "fit")
    seen = fit.mapInArrow(_ranges(shift), "width int, dim int, n long, low long, high long, least long, most long").groupBy("width", "dim").agg(
        F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")), F.min("least").alias("least"), F.max("most").alias("most")
    )
    dims: dict[int, list] = {}
    for r in seen.orderBy("width", "dim").collect():
        dims.setdefault(r.width, []).append(r)
    ranges = {w: (np.array([r.least for r in rows]), np.array([(r.most - r.least).bit_length() for r in rows])) for w, rows in dims.items()}
    parts = fit.mapInArrow(_scatter(ranges, shift), "width int, i int, j int, limb int, value long").groupBy("width", "i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    cross: dict[int, dict[tuple[int, int], int]] = {w: {} for w in dims}
    for r in parts.toLocalIterator():
        own = cross[r.width]
        own[r.i, r.j] = own.get((r.i, r.j), 0) + (int(r.value) << LIMB * r.limb)
    models = {}
    for w, rows in dims.items():
        # Covariances don't depend on the shift by each dimension's least entry, so the sums are shifted as the planes are.
        sums = [int(r.low) + (int(r.high) << LIMB) for r in rows]
        model = solve(rows[0].n, [s - rows[0].n * r.least for s, r in zip(sums, rows, strict=True)], cross[w], components)
        small = max(map(abs, sums)) < 2**62
        model.sums = np.array(sums, dtype=np.int64 if small else object)
        models[w] = model
    sent = spark.sparkContext.broadcast(models)
    moments = fit.mapInArrow(_moments(sent, shift), "width int, i int, j int, value double").groupBy("width", "i", "j").agg(F.sum("value").alias("value"))
    for r in moments.collect():
        model = models[r.width]
        if not np.isnan(r.value):
            model.identity_error = max(model.identity_error or 0.0, abs(r.value / model.n - (r.i == r.j)))
    measured = spark.sparkContext.broadcast(models)
    out = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = pa.schema([(id_col, pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), *((c, pa.float64()) for c in ("whitened", "explained", "identity_error"))])
    return vectors.mapInArrow(_apply(measured, scale, shift, schema), out)
