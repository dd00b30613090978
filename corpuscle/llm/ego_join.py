"""Epsilon grid order self-join of embeddings by cosine similarity.

Each vector becomes a key of its direction in one Arrow pass; equal directions form one class
first. Unit vectors with cosine >= t lie within eps = sqrt(2 - 2 t) of one another, so do their
projections on any orthonormal directions, and so their eps-grid cells differ by one at most in
each. Vectors are sorted by label and by their cells on the leading principal directions,
and the sequence is cut into blocks with the box of their cells. Pairs of blocks that no
box rules out are joined recursively: an interval pair is skipped if its boxes are more than
a cell apart in some direction, halved while it is large, and else compared exactly in
double precision. Neither all vectors of a label nor all pairs are ever in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Forest, groups, materialize
from .graph import connected_components

#: Vectors in a block, and in a leaf of the recursion.
BLOCK, LEAF = 2048, 256
#: Vectors that the principal directions are fitted on, at most; any directions give the same links.
SAMPLE = 10_000


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of a list column's rows, for each length; null rows are left out, null components are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    there = np.flatnonzero(~np.isnan(sizes.astype(float)))
    if not len(there):
        return
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = sizes[there].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield there[at], flat[starts[at][:, None] + np.arange(n)]


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by the largest component first, so that very large and very small ones stay exact; unsound rows become NaN."""
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(1, keepdims=True) + 0.0 if x.shape[1] else x
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keyed(schema: pa.Schema):
    """Adds the key of each vector's length, label and direction; null where it can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, keys = batch.column(1).to_pylist(), [None] * batch.num_rows
            for rows, x in _matrices(batch.column(2)):
                u = units(x)
                sound = np.isfinite(u).all(1) & (u.shape[1] > 0)
                for i, ok, one in zip(rows.tolist(), sound.tolist(), u, strict=True):
                    if ok and labels[i] is not None:
                        keys[i] = hashlib.blake2b(one.tobytes() + labels[i].encode("utf-8", "surrogatepass"), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.binary())], schema=schema)

    return run


def principal_directions(vectors: DataFrame, keep: int, n: int) -> np.ndarray:
    """The leading `keep` principal directions (width x keep) of the commonest length among at most SAMPLE of the n vectors, picked by hash."""
    slots = 1 << 20
    some = vectors.where(F.pmod(F.xxhash64("key"), F.lit(slots)) < slots * SAMPLE // (2 * max(n, 1)) + 1).limit(SAMPLE).select("v").toArrow()
    best = max(_matrices(some.column("v")), key=lambda m: len(m[0]), default=(None, np.zeros((0, 1))))[1]
    x = units(best) if len(best) else np.zeros((1, best.shape[1]))
    _, v = np.linalg.eigh(np.cov(x, rowvar=False).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    return np.ascontiguousarray(v[:, ::-1][:, :keep])


def _cells(directions: np.ndarray, eps: float, schema: pa.Schema):
    """Adds the cells of each unit vector's projections. Vectors of other lengths use the coordinates that they have: that, too, brings no two of them further apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros((batch.num_rows, directions.shape[1]), dtype=np.int32)
            for rows, x in _matrices(batch.column(batch.schema.get_field_index("v"))):
                n = min(x.shape[1], len(directions))
                cell[rows] = np.floor(units(x)[:, :n] @ directions[:n] / eps)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cell.size + 1, cell.shape[1]), pa.int32()), pa.array(cell.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], schema=schema)

    return run


def _blocks(schema: pa.Schema):
    """Numbers the blocks of a sorted partition; a block holds one label."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled, label = (TaskContext.get().partitionId() << 40) - 1, BLOCK, None
        for batch in batches:
            out = np.empty(batch.num_rows, dtype=np.int64)
            for i, x in enumerate(batch.column("label").to_pylist()):
                if filled == BLOCK or x != label:
                    number, filled, label = number + 1, 0, x
                out[i] = number
                filled += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], schema=schema)

    return run


def _recurse(x: np.ndarray, cells: np.ndarray, a: slice, b: slice, cosine: float, found: list) -> None:
    """Appends (rows, columns) of the pairs a x b with the cosine, i < j only."""
    if a.start > b.start or a.start == a.stop or b.start == b.stop:
        return
    ca, cb = cells[a], cells[b]
    if a != b and ((ca.min(0) > cb.max(0) + 1) | (cb.min(0) > ca.max(0) + 1)).any():
        return
    na, nb = a.stop - a.start, b.stop - b.start
    if na <= LEAF and nb <= LEAF:
        i, j = np.nonzero(x[a] @ x[b].T >= cosine)
        i, j = i + a.start, j + b.start
        keep = i < j
        found.append((i[keep], j[keep]))
        return
    halves = lambda s: (slice(s.start, (s.start + s.stop) // 2), slice((s.start + s.stop) // 2, s.stop))
    if a == b:
        lo, hi = halves(a)
        for p, q in ((lo, lo), (lo, hi), (hi, hi)):
            _recurse(x, cells, p, q, cosine, found)
    elif na >= nb:
        for p in halves(a):
            _recurse(x, cells, p, b, cosine, found)
    else:
        for q in halves(b):
            _recurse(x, cells, a, q, cosine, found)


def _join(cosine: float):
    schema = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["p", "q"]):
            p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
            t = t.sort_by([("block", "ascending"), ("seq", "ascending")])
            ids, size = t.column("id").to_numpy(), t.column("size").to_numpy()
            ((_, x),) = _matrices(t.column("v"))  # a block's vectors have one length
            x, cells = units(x), np.stack(t.column("cells").to_numpy())
            n = int((t.column("block").to_numpy() == p).sum())
            found: list = []
            a = slice(0, n)
            _recurse(x, cells, a, a if p == q else slice(n, len(ids)), cosine, found)
            i, j = (np.concatenate([f[k] for f in found] or [np.empty(0, int)]) for k in (0, 1))
            if not len(i):
                continue
            order = np.argsort(ids, kind="stable")  # the forest's roots are the smallest ids
            rank = np.empty(len(ids), dtype=np.int64)
            rank[order] = np.arange(len(ids))
            forest = Forest(len(ids))
            for u, v in zip(rank[i].tolist(), rank[j].tolist(), strict=True):
                forest.join(u, v)
            links = np.bincount(i, weights=size[j], minlength=len(ids)) + np.bincount(j, weights=size[i], minlength=len(ids))
            on = np.unique(np.concatenate([i, j]))
            roots = [int(ids[order[forest.find(int(rank[k]))]]) for k in on]
            keys = t.column("key").combine_chunks().take(pa.array(on))
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids[on]), pa.array(links[on].astype(np.int64)), pa.array(roots, pa.int64())], schema=schema)

    return run


def ego_join(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", keep: int = 6) -> DataFrame:
    """Links vectors of equal label with a cosine of at least `cosine` (above 0), in double precision.

    One row per input row: id_col, n_links (other rows linked directly), component_id
    (smallest id that links reach, itself included), kept (id_col = component_id).

    Rows whose label is null, or whose vector is null, empty, zero or holds null or
    non-finite components link with nothing and are their own component; vectors are compared
    with those of their own length only. Equal directions form one class first, so copies are never
    paired with one another. label_col None compares all rows. Null ids link with nothing and
    keep a null component_id and kept true. Rows that repeat an id are rows of their own with
    their own n_links; those that can link share one component, as links go by id. Other columns
    are ignored, and an empty table gives an empty result.
    """
    single = isinstance(getattr(df.schema[vector_col].dataType, "elementType", None), T.FloatType)
    label = F.concat_ws("/", F.size(vector_col).cast("string"), F.when(F.col(id_col).isNotNull(), F.col(label_col).cast("string") if label_col else F.lit("")))
    known = F.col(id_col).isNotNull() & (F.col(label_col).isNotNull() if label_col else F.lit(True))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(known, label).alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    keyed = T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType())])
    rows = materialize(rows.mapInArrow(_keyed(_arrow(keyed)), keyed), "vectors")
    sound = rows.where("key is not null")
    classes = materialize(sound.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("v").alias("v")), "classes")

    eps = math.sqrt(2 - 2 * cosine) * (1 + 1e-9) + 1e-9
    directions = principal_directions(classes, keep, classes.count())
    k = directions.shape[1]
    schema = T.StructType([*classes.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    blocked = T.StructType([*schema.fields, T.StructField("block", T.LongType())])
    own = classes.mapInArrow(_cells(directions, eps, _arrow(schema)), schema)
    grid = ["label", *[F.col("cells")[i] for i in range(k)], "key"]
    own = own.repartitionByRange(*grid).sortWithinPartitions(*grid)
    own = own.mapInArrow(_blocks(_arrow(blocked)), blocked).withColumn("seq", F.monotonically_increasing_id())
    own = materialize(own, "sequence")

    bounds = [f(F.col("cells")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = own.groupBy("label", "block").agg(*bounds)
    # An equi-join on the cells that a box touches in two directions (ten or so each, as unit vectors
    # are bounded): boxes that meet there share a cell or hold neighbours. The rest is a filter.
    touched = boxes
    for i in range(2):
        bound = (F.col(f"lo{i}"), F.col(f"hi{i}") + 1) if i < k else (F.lit(0), F.lit(0))
        touched = touched.withColumn(f"cell{i}", F.explode(F.sequence(*bound)))
    cell = ["label", "cell0", "cell1"]
    other = touched.select(*cell, *[F.col(c).alias(f"o_{c}") for c in boxes.columns if c != "label"])
    near = F.lit(True)
    for i in range(k):
        near &= (F.col(f"lo{i}") <= F.col(f"o_hi{i}") + 1) & (F.col(f"o_lo{i}") <= F.col(f"hi{i}") + 1)
    pairs = touched.join(other, cell).where((F.col("block") <= F.col("o_block")) & near).select(F.col("block").alias("p"), F.col("o_block").alias("q")).distinct()
    pairs = materialize(pairs, "pairs")
    sides = pairs.select("p", "q", F.col("p").alias("block")).unionByName(pairs.where("p <> q").select("p", "q", F.col("q").alias("block")))
    work = own.join(sides, "block").repartition("p", "q").sortWithinPartitions("p", "q")
    found = work.select("p", "q", "block", "seq", "id", "key", "size", "v", "cells").mapInArrow(_join(cosine), "key binary, id long, links long, root long")
    found = materialize(found, "links")

    # An id that stands for several directions joins their components.
    several = sound.groupBy("id").agg(F.min(F.xxhash64("key")).alias("a"), F.max(F.xxhash64("key")).alias("b")).where("a <> b").select("id")
    ties = sound.select("id", "key").join(several, "id", "left_semi").join(classes.select("key", F.col("id").alias("root")), "key").select("id", "root")
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(ties.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    counted = classes.select("key", "id", "size").join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    # Written first, so that Spark can split the partition of a class with very many copies.
    counted = materialize(counted.select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "id").alias("component")), "counted")
    out = sound.select("id", "key").join(counted, "key").select("id", "links", "component")
    out = out.unionByName(rows.where("key is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
