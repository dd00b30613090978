"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of bytes other than space and \t \n \v \f \r.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new one in local mode (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_corpuscle_shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark._corpuscle_shared = tempfile.mkdtemp(prefix="corpuscle-")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Removes a scratch table when the driver ends, through the file system that holds it."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage (a lost executor costs a reread, not a recomputation), keeps
    columns prunable, and gives the optimizer true sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is known and not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names (other columns may clash)."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str, most_chars: int = 4_000_000) -> DataFrame:
    """Applies a batch function to (id, text): make() runs once per task and returns f(ids, texts) -> columns.

    Batches are cut again so that no call sees more than most_chars code points, except
    for a single longer text. Further columns of df whose names schema holds are passed on.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)
    more = [c for c in df.columns[2:] if c in fields.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in cuts([len(t) if t else 0 for t in texts], most_chars):
                out = f(ids[start:stop], texts[start:stop])
                out |= {c: batch.column(k).slice(start, stop - start) for k, c in enumerate(more, 2)}
                yield pa.RecordBatch.from_arrays([out[c.name] if c.name in more else pa.array(out[c.name], type=c.type) for c in target], schema=target)

    return df.select("id", "text", *more).mapInArrow(run, fields)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list], np.ndarray]], text_col: str, most_chars: int = 1_000_000) -> DataFrame:
    """The rows of df, all columns as they are, for whose texts make()(texts) is true; no shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            texts = batch.column(at).to_pylist()
            for start, stop in cuts([len(t) if t else 0 for t in texts], most_chars):
                keep = pa.array(np.asarray(f(texts[start:stop]), dtype=bool))
                yield batch.slice(start, stop - start).filter(keep)

    return df.mapInArrow(run, df.schema)


def cuts(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges that cover sizes in order, each of at most `most` in sum or of one entry."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive runs of equal keys in a partition sorted by them; a run may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        first = tuple(t.column(k)[0].as_py() for k in keys)
        edges = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for i in range(len(edges) - 1):
            piece = t.slice(edges[i], edges[i + 1] - edges[i])
            if i == 0 and last is not None and first == last:
                held.append(piece)
                continue
            if held:
                yield pa.concat_tables(held) if len(held) > 1 else held[0]
            held = [piece]
        last = tuple(t.column(k)[t.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.concat_tables(held) if len(held) > 1 else held[0]


class Forest:
    """Union-find over the rows of one block, with the smallest row as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
