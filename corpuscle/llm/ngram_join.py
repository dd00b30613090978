"""N-gram Jaccard self-join: MinHash banding finds candidates, full n-gram sets decide.

Plan
----
1. One scan turns every text into a key of its word sequence and the band hashes of its
   MinHash signature (vectorised over Arrow batches; texts never leave the scan).
2. Texts with the same words form one class (a partially aggregated group-by), so copies
   are never paired with one another.
3. Class representatives are shuffled on (band, band hash). A bucket of m classes is cut
   into chunks, and each pair of chunks is one block; a bucket of any size thus becomes many
   tasks of bounded size. A pair that shares several bands belongs to its first one.
4. Only members of blocks with a new pair get their text (one join), and each block
   compares full n-gram sets by a sliced incidence product. It returns a count of links
   per class and a spanning forest of the links, never the pairs.
5. Connected components of the forests give the class id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, cuts, groups, id_and_text, materialize
from .graph import connected_components

U = np.uint64
P, P_INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes hashed at a time, unless one text alone is longer.
CHUNK_BYTES = 1 << 20


def band_plan(threshold: float = 0.8, recall: float = 0.9999, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands of `rows` rows that find a pair at the threshold with the wanted probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))), rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = U(1)
    return np.multiply.accumulate(out)


class Shingler:
    """Hashes of all n-word shingles of a run of UTF-8 texts, a few numpy passes over their bytes.

    Words are runs of bytes other than ASCII white space. A text of fewer than n words has
    one shingle, all its words; an empty or null text has none.
    """

    def __init__(self, n: int = 5):
        self.n = n
        self.pow, self.inv = _powers(P, 1), _powers(P_INV, 1)
        self.weights = _mix(np.arange(1, n + 1, dtype=U)) | U(1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """data: bytes of all texts; offsets: their starts and the end. Returns shingle hashes, their starts by text (and the end), words by text."""
        n, size = len(offsets) - 1, len(data)
        if size >= len(self.pow):
            self.pow, self.inv = _powers(P, size + 1), _powers(P_INV, size + 1)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        begins = ~blank
        cut = np.zeros(size + 1, dtype=bool)
        cut[offsets[:-1]] = True
        begins[1:] &= blank[:-1] | cut[1:size]
        starts = np.flatnonzero(begins)
        ends_at = ~blank
        ends_at[:-1] &= blank[1:] | cut[1:size]
        ends = np.flatnonzero(ends_at) + 1
        total = np.zeros(size + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * self.pow[:size], out=total[1:])
        words = _mix((total[ends] - total[starts]) * self.inv[starts])
        word_at = np.searchsorted(starts, offsets)  # the first word of each text
        counts = np.diff(word_at)
        have = np.where(counts >= self.n, counts - self.n + 1, (counts > 0).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(have)])
        first = np.repeat(word_at[:-1] - at[:-1], have) + np.arange(at[-1])
        length = np.minimum(np.repeat(counts, have), self.n)
        out = length.astype(U) * U(0x632BE59BD9B4E019)
        for k in range(self.n):
            inside = length > k
            out += np.where(inside, words[np.minimum(first + k, max(len(words) - 1, 0))], U(0)) * self.weights[k] if len(words) else U(0)
        return _mix(out), at, counts


def _run_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])


def word_key(raw: bytes) -> bytes:
    """128 bits that texts share if and only if they have the same words in the same order."""
    return hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest()


def _signatures(ngram: int, bands: int, rows: int):
    coef = _mix(np.arange(1, bands * rows + 1, dtype=U) * P) | U(1)
    shift = _mix(np.arange(1, bands * rows + 1, dtype=U) * P_INV)
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(ngram)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in cuts([3 * len(t) if t else 0 for t in texts], CHUNK_BYTES):
                data, offsets = _run_of(texts[a:b])
                hashes, at, counts = shingle(data, offsets)
                full = np.flatnonzero(counts > 0)
                sig = np.empty((bands * rows, len(full)), dtype=U)
                for k in range(bands * rows):
                    if len(full):
                        sig[k] = np.minimum.reduceat(hashes * coef[k] ^ shift[k], at[:-1][full])
                band = np.zeros((b - a, bands), dtype=np.int64)
                for j in range(bands):
                    h = np.full(len(full), j, dtype=U)
                    for k in range(rows):
                        h = _mix(h ^ sig[j * rows + k])
                    band[full, j] = h.view(np.int64)
                raw = data.tobytes()
                keys = [word_key(raw[offsets[i] : offsets[i + 1]]) if counts[i] else None for i in range(b - a)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * bands + 1, bands), pa.int32()), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), lists], schema=schema)

    return run


def _new_pairs(bands: np.ndarray, band: int, chunk: np.ndarray, c: int, d: int) -> np.ndarray:
    """Upper triangle of pairs whose first common band is this one, between the block's two chunks."""
    new = np.triu(np.ones((len(bands), len(bands)), dtype=bool), 1)
    for j in range(band):
        new &= bands[:, None, j] != bands[None, :, j]
    if c != d:
        new &= chunk[:, None] != chunk[None, :]
    return new


def _block(t: pa.Table) -> tuple:
    bands = np.stack(t.column("bands").to_numpy())
    row = lambda k: t.column(k)[0].as_py()
    return bands, _new_pairs(bands, row("band"), t.column("chunk").to_numpy(), row("c"), row("d"))


BLOCK = ["band", "hash", "c", "d"]


def _participants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a block that have a pair which no earlier band has."""
    for t in groups(batches, BLOCK):
        if t.num_rows < 2:
            continue
        _, new = _block(t)
        on = new.any(0) | new.any(1)
        if on.any():
            yield from t.filter(pa.array(on)).combine_chunks().to_batches()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted unique sets, by slices of an incidence matrix."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1
    column, owner = column[common], owner[common]
    out = np.zeros((m, m))
    if len(column):
        column = np.cumsum(np.concatenate([[0], np.diff(column) > 0]))
        width = max(256, (1 << 20) // m)
        edges = np.searchsorted(column, np.arange(0, column[-1] + width, width))
        for a, b in zip(edges, np.append(edges[1:], len(column)), strict=True):
            if b > a:
                x = np.zeros((m, width), dtype=np.float32)
                x[owner[a:b], column[a:b] - column[a] // width * width] = 1
                out += x @ x.T
    return out


def _verify(ngram: int, threshold: float):
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(ngram)
        for t in groups(batches, BLOCK):
            own = [word_key(x.encode("utf-8", "surrogatepass")) == k for x, k in zip(t.column("text").to_pylist(), t.column("key").to_pylist(), strict=True)]
            t = t.filter(pa.array(own)).sort_by("id")
            ids, size = t.column("id").to_numpy(), t.column("size").to_numpy()
            _, new = _block(t)
            sets = []
            for text in t.column("text").to_pylist():
                sets.append(np.unique(shingle(*_run_of([text]))[0]))
            n = np.array([len(s) for s in sets], dtype=np.float64)
            both = shared_counts(sets)
            linked = new & (both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9)
            if not linked.any():
                continue
            forest = Forest(len(ids))
            for i, j in zip(*np.nonzero(linked), strict=True):
                forest.join(int(i), int(j))
            either = linked | linked.T
            on = np.flatnonzero(either.any(1))
            keys = t.column("key").combine_chunks().take(pa.array(on))
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), keys, pa.array((either @ size)[on].astype(np.int64)), pa.array([int(ids[forest.find(int(i))]) for i in on], pa.int64())], schema=schema)

    return run


def ngram_jaccard_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, threshold: float = 0.8,
    recall: float = 0.9999, block_members: int = 128, block_words: int = 400_000,
    filter_buckets: int = 1 << 20,
) -> DataFrame:
    """Links texts whose sets of n-word shingles have a Jaccard similarity of at least `threshold`.

    One row per input row: id_col, class_id (smallest id that links reach, itself included),
    copy_id (smallest id with the same words), n_links (rows linked directly, copies
    included), n_words, kept (id_col = class_id).

    Words are runs of bytes other than ASCII white space, compared as they are. A text of
    fewer than `ngram` words has one shingle, all its words. Null, empty and blank texts link
    with nothing and are their own class. Repeated rows count as rows. Rows of one id with other
    words are one document: they share the class that any of them is linked to, and each has
    its own n_links. Null ids are kept, link with nothing and have
    class_id null and kept true. Extra columns of df are ignored. An empty input gives an empty result.
    """
    bands, rows = band_plan(threshold, recall)
    docs = id_and_text(df, id_col, text_col)
    sigs = materialize(docs.mapInArrow(_signatures(ngram, bands, rows), "id long, key binary, n_words long, bands array<long>"), "signatures")
    whole = sigs.where("key is not null and id is not null")
    classes = materialize(whole.groupBy("key").agg(F.min("id").alias("copy_id"), F.count("*").alias("size"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands")), "classes")

    # Only (id, band hash) is shuffled for every class; signatures join the few members of shared buckets.
    hashes = classes.select(F.col("key"), F.col("n_words"), F.explode("bands").alias("hash"))
    chunks = F.ceil(F.greatest(F.col("m") / block_members, F.col("w") / block_words)).cast("int")
    buckets = materialize(hashes.groupBy("hash").agg(F.count("*").alias("m"), F.sum("n_words").alias("w")).where("m > 1").select("hash", chunks.alias("chunks")), "buckets")
    # Written first, so that Spark can split the partition of a hash that very many classes share.
    shared = hashes.select("key", "hash").join(buckets, "hash")
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    members = (
        shared.join(classes.select("key", F.col("copy_id").alias("id"), "size", "bands"), "key")
        .withColumn("band", (F.array_position("bands", F.col("hash")) - 1).cast("int"))
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("id", "key", "size", "bands", "band", "hash", "chunk", F.least("chunk", "other").alias("c"), F.greatest("chunk", "other").alias("d"))
    )
    ordered = members.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    fresh = materialize(ordered.mapInArrow(_participants, members.schema), "blocks")

    # The ids' hashes fall into filter_buckets buckets at most, so this list is bounded and can be sent to every
    # task: it keeps most other texts out of the shuffle, and passes more of them the more candidates there are.
    bucket = F.pmod(F.xxhash64("id"), F.lit(filter_buckets)).alias("bucket")
    near = docs.withColumn("bucket", bucket).join(F.broadcast(fresh.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    texts = near.join(fresh.select("id").distinct(), "id", "left_semi").groupBy("id", F.sha2("text", 256)).agg(F.first("text").alias("text")).select("id", "text")
    blocks = fresh.join(texts, "id").repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    found = materialize(blocks.mapInArrow(_verify(ngram, threshold), "id long, key binary, links long, root long"), "links")

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "copy_id")
    named = classes.select("key", "copy_id", "size").join(links, "key", "left").join(components, "copy_id", "left")
    # Written first, so that Spark can split the partition of a class with very many copies.
    named = materialize(named.select("key", "copy_id", F.coalesce("component", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links")), "named")
    out = whole.select("id", "key", "n_words").join(named, "key").select("id", "class_id", "copy_id", "n_links", "n_words")
    alone = sigs.where("key is null or id is null").select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), "n_words")
    return out.unionByName(alone).select(F.col("id").alias(id_col), "class_id", "copy_id", "n_links", "n_words", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df, all columns as they are, without all but one of each class of near copies.

    The row with the class's smallest id stays; of rows that repeat an id one stays. Rows
    with null ids stay.
    """
    found = materialize(ngram_jaccard_join(df, id_col, text_col, **options).select(F.col(id_col).alias("_near_id"), "kept"), "kept")
    key = df[id_col].cast("long")
    dropped = found.where("not kept").select("_near_id").distinct()
    repeated = materialize(found.where("kept and _near_id is not null").groupBy("_near_id").count().where("count > 1").select("_near_id"), "repeated")
    # As in the join itself: a bounded list of id buckets lets most rows stay where they are scanned, and only the
    # rows of the buckets in question meet the exact lists.
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20))
    buckets = F.broadcast(dropped.unionByName(repeated).select(bucket(F.col("_near_id")).alias("_near_bucket")).distinct())
    far = df.join(buckets, bucket(key) == F.col("_near_bucket"), "left_anti")
    left = df.join(buckets, bucket(key) == F.col("_near_bucket"), "left_semi").join(dropped, key == F.col("_near_id"), "left_anti")
    if repeated.isEmpty():
        return far.unionByName(left)
    once = left.join(repeated, key == F.col("_near_id"), "left_anti")
    return far.unionByName(once).unionByName(left.join(repeated, key == F.col("_near_id"), "left_semi").dropDuplicates([id_col]))
