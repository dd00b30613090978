"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to a few owners by their document frequency, the rarest to the first, such that each
owner holds about as many postings. Documents form shards of consecutive rows, items form bundles.
A bundle visits the owners in turn, once for each shard: a cogroup brings it together with that owner's postings of
the shard, the owner adds its integer contributions, and the bundle carries its sparse accumulators
and the rest of its terms on. Accumulators that the terms still to come cannot lift among
the shard's best are left behind, which is exact. After the last owner each shard gives its best,
and a window selects among those.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, materialize

#: Maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isascii() and chr(c).isalnum() or c >= 128 else 32 for c in range(256))
#: Slots of the filter by which a scan leaves out terms that no item holds.
FILTER_SLOTS = 1 << 20
#: Documents of a shard (a power of two), items of a bundle on average.
SHARD_BITS, BUNDLE_ITEMS = 11, 256
#: No document's part of a term, div included, reaches this.
MOST_PART = 1_000_000


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


def slot_of(term: bytes) -> int:
    return zlib.crc32(term) % FILTER_SLOTS


BAGS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _bags(slots: Callable[[], bytes] | None):
    """(row, id, n, terms, counts) of texts with a term; row numbers rows within a task, above 2^40 the task. slots: only terms of these slots are listed, though all count in n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        wanted = slots() if slots else None
        for batch in batches:
            rows, ids, sizes, terms, counts, ends = [], [], [], [], [], [0]
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = terms_of(raw) if raw else None
                if not found:
                    continue
                bag = Counter(found)
                kept = list(bag) if wanted is None else [t for t in bag if wanted[zlib.crc32(t) % FILTER_SLOTS]]
                rows.append(row)
                ids.append(i)
                sizes.append(len(found))
                terms += kept
                counts += map(bag.__getitem__, kept)
                ends.append(len(terms))
                row += 1
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], schema=BAGS)

    return run


BAG = "row long, id long, n long, terms array<string>, counts array<long>"
BUNDLE = (
    "shard long, bundle int, item_row array<long>, item_id array<long>, route_item array<int>, route_owner array<int>, route_term array<long>, route_gain array<long>, "
    "acc_item array<int>, acc_slot array<int>, acc_score array<long>"
)
FOUND = "item_row long, item_id long, id long, score long"


def best_of(scores: np.ndarray, top: int) -> int:
    """The top-th largest score, 0 if fewer are positive."""
    return int(np.partition(scores, -top)[-top]) if len(scores) >= top else 0


def _owner(owner: int, last: bool, top: int):
    """One owner's step for one bundle and one shard."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        field = lambda name: left.column(name)[0].values.to_numpy(zero_copy_only=False)
        item_row, item_id = left.column("item_row")[0].values, left.column("item_id")[0].values
        route_item, route_owner, route_term, route_gain = (field(f"route_{x}") for x in ("item", "owner", "term", "gain"))
        scores = np.zeros((len(item_row), 1 << SHARD_BITS), dtype=np.int64)
        scores[field("acc_item"), field("acc_slot")] = field("acc_score")
        term, slot = right.column("term").to_numpy(), right.column("slot").to_numpy()
        own = np.flatnonzero(term >= 0)
        order = own[np.argsort(term[own], kind="stable")]
        term, spot, part = term[order], slot[order], right.column("part").combine_chunks().fill_null(0).to_numpy()[order]
        mine = np.flatnonzero(route_owner == owner)
        begin, end = np.searchsorted(term, route_term[mine], side="left"), np.searchsorted(term, route_term[mine], side="right")
        for item, gain, a, b in zip(route_item[mine].tolist(), route_gain[mine].tolist(), begin.tolist(), end.tolist(), strict=True):
            if b > a:
                scores[item, spot[a:b]] += gain * part[a:b]
        if last:
            return _select(scores, item_row, item_id, right, top)
        later = route_owner > owner
        rest = np.zeros(len(item_row), dtype=np.int64)
        np.add.at(rest, route_item[later], route_gain[later] * MOST_PART)
        least = np.array([best_of(s, top) for s in scores], dtype=np.int64)
        at_item, at_slot = np.nonzero((scores > 0) & (scores + rest[:, None] >= least[:, None]))
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        columns = {
            "shard": left.column("shard"), "bundle": left.column("bundle"), "item_row": left.column("item_row"), "item_id": left.column("item_id"),
            "route_item": one(route_item[later], pa.int32()), "route_owner": one(route_owner[later], pa.int32()), "route_term": one(route_term[later], pa.int64()), "route_gain": one(route_gain[later], pa.int64()),
            "acc_item": one(at_item.astype(np.int32), pa.int32()), "acc_slot": one(at_slot.astype(np.int32), pa.int32()), "acc_score": one(scores[at_item, at_slot], pa.int64()),
        }
        return pa.table(columns)

    return step


def _select(scores: np.ndarray, item_row: pa.Array, item_id: pa.Array, right: pa.Table, top: int) -> pa.Table:
    """The shard's best of each item; rows of term -1 hold the documents' ids."""
    named = np.flatnonzero(right.column("term").to_numpy() == -1)
    slot, ids = right.column("slot").to_numpy()[named], right.column("part").combine_chunks().take(pa.array(named))
    place, known = np.zeros(1 << SHARD_BITS, dtype=np.int64), np.zeros(1 << SHARD_BITS, dtype=bool)
    place[slot], known[slot] = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
    items, slots = [], []
    for item, own in enumerate(scores):
        at = np.flatnonzero(own >= max(best_of(own, top), 1))
        at = at[np.lexsort((place[at], ~known[at], -own[at]))][:top]
        items += [item] * len(at)
        slots += at.tolist()
    take = pa.array(items, pa.int64())
    doc = pa.array(place[slots], mask=~known[slots], type=pa.int64()) if slots else pa.array([], pa.int64())
    return pa.table({"item_row": item_row.take(take), "item_id": item_id.take(take), "id": doc, "score": pa.array(scores[items, slots] if slots else [], pa.int64())})


def term_search(docs: DataFrame, items: DataFrame, top: int = 10, owners: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The `top` highest-scoring documents of each item: (item_col, rank, id_col, score), rank from 1.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower
    case. N documents hold a term, L is the number of their terms, n of one document's, df of the documents
    that hold a term. A term weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))), a document m = 25 + (75 n N) div L,
    and scores the sum of w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included, in
    64-bit integers. Only scores above 0 are returned; equal ones by ascending id, null ids last.

    Null, empty and term-free texts count in nothing; an item without a match has no row. Repeated
    rows, repeated and null ids are documents, or items, of their own; other columns are ignored; an empty
    table on either side gives an empty result. Every document is scored exactly for every item: accumulators are
    left out only where they cannot be among a shard's best. A task holds one shard's postings of one owner and
    one bundle's accumulators, however many documents share a term. The driver holds a filter of 2^20 slots
    and at most 260 counts of frequency classes.
    """
    spark = docs.sparkSession
    asked = materialize(id_and_text(items, item_col, item_text_col).mapInArrow(_bags(None), BAG), "items")
    words = materialize(asked.select(F.explode("terms").alias("term")).distinct(), "words")
    slots = bytearray(FILTER_SLOTS)
    for r in words.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_SLOTS)).alias("slot")).distinct().toLocalIterator():
        slots[r.slot] = 1
    wanted = spark.sparkContext.broadcast(bytes(slots))
    index = materialize(id_and_text(docs, id_col, text_col).mapInArrow(_bags(lambda: wanted.value), BAG), "index")
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    # Document frequencies of the items' terms; owners by classes of frequency, with about as many postings each.
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(words, "term", "left_semi")
    level = F.floor(4 * F.log2("df")).cast("int")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    vocabulary = materialize(df.select("term", F.monotonically_increasing_id().alias("term_id"), "df", weight.alias("w"), level.alias("level")).where("w > 0"), "vocabulary")
    held = sorted((r.level, r.n) for r in vocabulary.groupBy("level").agg(F.sum("df").alias("n")).collect())
    total, before, starts = sum(n for _, n in held), 0, {}
    for at, n in held:
        starts.setdefault(before * owners // max(total, 1), at)
        before += n
    first_levels = [v for k, v in starts.items() if k > 0]
    owner = sum([(F.col("level") >= v).cast("int") for v in first_levels], F.lit(0))
    vocabulary = vocabulary.select("term", "term_id", "w", owner.alias("owner"))

    # Bundles of items with their routes, and which bundle asks for which term.
    n_bundles = max(1, -(-asked.count() // BUNDLE_ITEMS))
    bundle = F.pmod(F.xxhash64("row"), F.lit(n_bundles)).cast("int").alias("bundle")
    uses = asked.select("row", "id", bundle, F.explode(F.arrays_zip("terms", "counts")).alias("u")).select("row", "id", "bundle", F.col("u.terms").alias("term"), F.col("u.counts").alias("times")).join(vocabulary, "term")
    uses = materialize(uses, "uses")
    routes = uses.groupBy("bundle", "row", "id").agg(F.collect_list(F.struct("owner", "term_id", (F.col("w") * F.col("times")).alias("gain"))).alias("route"))
    packed = routes.groupBy("bundle").agg(F.collect_list(F.struct("row", "id", "route")).alias("items"))
    steps = F.flatten(F.transform("items", lambda x, i: F.transform(x["route"], lambda r: F.struct(i.alias("item"), r["owner"].alias("owner"), r["term_id"].alias("term"), r["gain"].alias("gain")))))
    packed = packed.select("bundle", F.col("items.row").alias("item_row"), F.col("items.id").alias("item_id"), steps.alias("route"))
    packed = materialize(packed.select("bundle", "item_row", "item_id", *(F.col(f"route.{x}").alias(f"route_{x}") for x in ("item", "owner", "term", "gain"))), "bundles")
    asks = materialize(uses.select("term", "term_id", "owner", "bundle").distinct(), "asks")

    shard, slot = F.shiftright("row", SHARD_BITS).alias("shard"), F.col("row").bitwiseAND((1 << SHARD_BITS) - 1).cast("int").alias("slot")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle")
    none = lambda name, kind: F.array().cast(f"array<{kind}>").alias(name)
    state = index.select(shard).distinct().select("shard", every).join(packed, "bundle").select("shard", *packed.columns, none("acc_item", "int"), none("acc_slot", "int"), none("acc_score", "long"))
    n, tf = F.col("n"), F.col("tf")
    m = F.lit(25) + F.expr(f"({75 * n_docs}L * n) div {max(n_terms, 1)}L")
    postings = index.select(shard, slot, m.alias("m"), F.explode(F.arrays_zip("terms", "counts")).alias("u")).select("shard", "slot", "m", F.col("u.terms").alias("term"), F.col("u.counts").alias("tf"))
    part = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    for k in range(len(first_levels) + 1):
        last = k == len(first_levels)
        own = postings.join(asks.where(F.col("owner") == k), "term").select("shard", "bundle", "slot", F.col("term_id").alias("term"), part.alias("part"))
        if last:
            own = own.unionByName(index.select(shard, every, slot, F.lit(-1).cast("long").alias("term"), F.col("id").alias("part")))
        state = state.groupBy("shard", "bundle").cogroup(own.groupBy("shard", "bundle")).applyInArrow(_guarded(_owner(k, last, top), FOUND if last else BUNDLE), FOUND if last else BUNDLE)
    rank = F.row_number().over(Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return state.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _guarded(step: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A shard that no bundle visits, as where no item has a term, gives nothing."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows:
            return step(left, right)
        kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
        return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]).empty_table()

    return run
