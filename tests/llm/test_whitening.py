"""Whitening against plain integer sums and a dense decomposition."""

import math

import numpy as np
import pytest

from corpuscle.llm import queries, whitening


def exact(vectors, scale=64, shift=1_000_000):
    """{vector number: x} of the sound vectors, by Python's own numbers."""
    out = {}
    for k, v in enumerate(vectors):
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v):
            out[k] = tuple(max(-(2**56), min(2**56, math.floor(scale * c))) + shift for c in v)
    return out


def check(rows, got, components=16):
    """rows: (id, vector). got: Rows, compared as a multiset through (id, deviation)."""
    x = exact([v for _, v in rows])
    want = []
    for width in {len(v) for v in x.values()}:
        fit = sorted({v for v in x.values() if len(v) == width})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        v = np.array([[float((n * sum(f[i] * f[j] for f in fit) - sums[i] * sums[j]) / n**2) for j in range(width)] for i in range(width)])
        values = np.linalg.eigvalsh(v)[::-1][:components]
        own = {k: sum((n * c - s) ** 2 for c, s in zip(f, sums, strict=True)) for k, f in x.items() if len(f) == width}
        for k, dev in own.items():
            want += [(rows[k][0], c + 1, n, dev if dev < 2**63 else None, values[c] / v.trace() if v.trace() > 0 and values[c] > 1e-9 * v.trace() else 0.0) for c in range(len(values))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want.sort(key=key)
    found = sorted(((r.vec_id, r.component, r.n, r.deviation, r.explained) for r in got), key=key)
    assert [w[:4] for w in want] == [f[:4] for f in found]
    assert np.allclose([w[4] for w in want], [f[4] for f in found], rtol=1e-6, atol=1e-12)
    return x


def test_scatter_is_exact():
    rng = np.random.default_rng(0)
    for n, d, spread in ((1, 3, 5), (63, 4, 100), (64, 4, 1), (65, 5, 2**30), (200, 3, 2**40)):
        x = rng.integers(-spread, spread + 1, (n, d))
        x[:, 0] = 7
        least, bits = x.min(0), np.array([int(b).bit_length() for b in x.max(0) - x.min(0)])
        counts = whitening.scatter(x, least, bits)
        for i in range(d):
            for j in range(i, d):
                assert sum(int(c) << s for s, c in enumerate(counts[i, j])) == sum(int(a) * int(b) for a, b in zip(x[:, i] - least[i], x[:, j] - least[j], strict=True))


def test_keys_hold_vectors_exactly():
    x = np.array([[1_000_000, 999_990], [1_000_127, 1_000_000], [1_000_128, 0], [2**40, -5], [2**56 + 1_000_000, 1_000_000 - 2**56]])
    keys = whitening._encode(x, 1_000_000)
    assert sorted(map(tuple, np.concatenate(list(whitening._decode(keys, 1_000_000))).tolist())) == sorted(map(tuple, x.tolist()))
    assert [k[:1] for k in keys] == [b"1", b"1", b"4", b"8", b"8"]


def test_whitening_of_embeddings(spark, sf):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op11_whitening(spark, sf).collect()
    x = check(rows, got)
    assert all(r.identity_error < 1e-9 for r in got)
    ids = [rows[k][0] for k in x]
    w = {(r.vec_id, r.component): r.whitened for r in got}
    projected = np.array([[w[i, c] for c in range(1, 17)] for i in ids])
    first = {v: k for k, v in enumerate(x.values())}
    fit = np.array(list(first), dtype=float)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    plain = (fit - fit.mean(0)) @ vectors[:, ::-1][:, :16] / np.sqrt(values[::-1][:16])
    mine = projected[list(first.values())]
    assert np.allclose(np.abs((mine * plain).mean(0)), 1, atol=1e-6)
    assert np.allclose(mine.T @ mine / len(mine), np.eye(16), atol=1e-9)


@pytest.mark.parametrize("components", [2, 16])
def test_whitening_odd_rows(spark, components):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.3]), (2, [0.9, -0.2, 0.3]), (None, [0.1, 0.7, 0.3]), (None, None), (3, None), (4, []), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [None, 1.0, 1.0]),
        (8, [5.0, 6.0]), (9, [1e300, 1.0, 0.5, -1e300]), (10, [1.0, 1e9, 0.5, 3.0]), (11, [2.0, 1.5, -0.0, 1e12]), (12, [0.5, 0.25, 0.5, 0.0]), (13, [0.0]), (14, [1.0]), (1, [0.1, 0.2, 0.3]), (15, [-3.0, 0.0, 0.3]),
    ]
    df = spark.createDataFrame([(i, v, 7, "clash") for i, v in rows], "vec_id long, embedding array<double>, n int, component string").repartition(3)
    got = whitening.whiten(df, components).collect()
    check(rows, got, components)
    alone = [r for r in got if r.vec_id == 8]
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, 0.0, None)] * 2
    assert sorted(round(r.whitened, 9) ** 2 for r in got if r.vec_id in (13, 14)) == [1.0, 1.0]
    none = whitening.whiten(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(df.where("vec_id between 3 and 7")).count() == 0
