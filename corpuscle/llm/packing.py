"""Best-fit packing of tokenised documents, planned over the histogram of their lengths.

One Arrow pass encodes the texts, cuts those over the capacity and numbers the pieces of equal
length within its task. The histogram of lengths has at most `capacity` rows, so the driver plans
on it: lengths in falling order, each placed into the fullest open sequences that hold it, for
all pieces of a length at a time. The plan is a list of runs (length, first rank, pieces, first
sequence, pieces in each sequence, offset), whose number depends on the capacity and not on the documents.
Every piece then takes the slot of its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import cuts, id_and_text, materialize
from .pieces import TO_CHARACTER

#: Words between white space that a worker remembers at least, and the characters of one at most.
MOST_WORDS, LONGEST_WORD = 400_000, 64
#: Bytes of text encoded at a time, unless one text alone is longer.
BATCH_BYTES = 1 << 22
#: Letters that all Unicode versions know, compose alike and lower one by one (İ becomes two characters, Σ depends on its place).
LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0391-\u03a1\u03a4-\u03ce\u0410-\u044f\u4e00-\u9fa5"
#: A word of them and the marks that end it, which are a pre-token of their own.
PLAIN = f"^(?P<word>[{LETTERS}]+)(?P<tail>[.,;:!?]*)$"


class Memory(dict):
    """Remembers `most` entries at least: what was used since the last turn stays, the rest goes at the next."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: list) -> list:
        """Those of the keys that are unknown; the others are in the dictionary afterwards."""
        if len(self) + len(keys) > self.most:
            self.old = dict(self)
            self.clear()
        old, new = self.old, []
        for k in keys:
            if k not in self:
                if k in old:
                    self[k] = old[k]
                else:
                    new.append(k)
        return new


class WordEncoder:
    """Ids of whole texts, by what stands between ASCII white space.

    For tokenizers of lower-case words whose pre-tokens never hold white space and which drop it: each such chunk then has
    the same ids in every text, special strings included. A chunk of common letters and marks has those of
    its lower-case word, which the library's model merges, and of the marks. All others go through the whole
    library. Splitting and finding the distinct words is Arrow's work.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks take all cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.plain = self.tokenizer.model.tokenize, re.compile(f"[{LETTERS}]+").fullmatch
        self.known = Memory(MOST_WORDS)
        probe = "It's a\tword, <|twice|> 12.\nÉtÉ ?!"
        whole, *parts = self._library([probe, *probe.split()])
        if whole != b"".join(parts) or whole != self.encode(pa.array([probe]))[0].tobytes():
            raise ValueError(f"{path} keeps white space, or is not of lower-case words, so its texts cannot be encoded by words")

    def _library(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _ids(self, keys: list[str]) -> list[bytes]:
        """The ids of each of distinct lower-case words and other chunks."""
        new, odd, long = self.known.missing(keys), [], {}
        for k in new:
            if not (k.isascii() and k.isalpha() or self.plain(k)):
                odd.append(k)
            else:
                ids = array("I", [t.id for t in self.merge(k if k.isascii() else k.encode().decode("latin-1").translate(TO_CHARACTER))]).tobytes()
                (self.known if len(k) <= LONGEST_WORD else long)[k] = ids
        for k, ids in zip(odd, self._library(odd), strict=True):
            (self.known if len(k) <= LONGEST_WORD else long)[k] = ids
        return [long[k] if k in long else self.known[k] for k in keys] if long else list(map(self.known.__getitem__, keys))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """An array of 32-bit ids for each text."""
        split = pc.ascii_split_whitespace(texts)
        sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = split.flatten().dictionary_encode()
        parts = pc.extract_regex(chunks.dictionary, PLAIN)
        plain = parts.is_valid()
        keys = pc.if_else(plain, pc.utf8_lower(pc.struct_field(parts, "word")), chunks.dictionary).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(parts, "tail"), "").dictionary_encode()
        values = [*self._ids(keys.dictionary.to_pylist()), *self._ids(tails.dictionary.to_pylist())]
        # Each chunk is two pieces of the values laid end to end: its word's and its marks'.
        table, length = np.frombuffer(b"".join(values), dtype="<u4"), np.array([len(v) // 4 for v in values], dtype=np.int64)
        start = np.cumsum(length) - length
        piece = np.stack([keys.indices.to_numpy(), tails.indices.to_numpy() + len(keys.dictionary)], 1)[chunks.indices.to_numpy()].ravel()
        n = length[piece]
        ends = np.cumsum(n)
        ids = table[np.repeat(start[piece] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[2 * np.cumsum(sizes)]
        return np.split(ids, upto[:-1])


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """One encoder, and what it remembers, for all tasks of a worker process."""
    return WordEncoder(path)


PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("turn", pa.int64())])


def _pieces(path: str, capacity: int, end_id: int):
    end, width = array("I", [end_id]).tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            for a, b in cuts(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
                rows: list[tuple] = []
                for doc, own in zip(ids[a:b], encoder.encode(texts.slice(a, b - a)), strict=True):
                    raw = own.tobytes() + end
                    for k, at in enumerate(range(0, len(raw), width)):
                        part = raw[at : at + width]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), task))
                *columns, length, crc, same = map(list, zip(*rows, strict=True))
                # The turn of each among the task's pieces of its length.
                size = np.array(length)
                order = np.argsort(size, kind="stable")
                first = np.searchsorted(size[order], size[order], side="left")
                turn = np.empty(len(size), dtype=np.int64)
                turn[order] = np.arange(len(size)) - first
                turn += seen[size]
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, length, crc, same, turn], PIECES.types, strict=True)], schema=PIECES)

    return run


def plan_runs(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit over counts: rows (length, first rank, pieces, first sequence, pieces in each sequence, offset), by length and rank.

    Sequences with equal room form ranges of numbers. All pieces of a length, longest first, go
    to the ranges with the least room that holds one, then to new sequences: the result is
    that of best fit on the single pieces in falling order. The run of rank k of a length puts it
    into sequence first + (k - rank) // each at offset + (k - rank) % each * length.
    """
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    runs, sequences = [], 0

    def put_back(room: int, first: int, n: int) -> None:
        if room and n:
            if not spans[room]:
                insort(rooms, room)
            spans[room].append((first, n))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit into {capacity}")
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = spans[room].pop()
                if not spans[room]:
                    del rooms[at]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            used = full
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                left, rank = left - full * each, rank + full * each
                put_back(room - each * length, first, full)
            if left and used < n:
                runs.append((length, rank, left, first + used, left, capacity - room))
                put_back(room - left * length, first + used, 1)
                left, used = 0, used + 1
            put_back(room, first + used, n - used)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)


def _take_slots(plan):
    """Adds the planned sequence and offset to rows (.., length, .., rank as the last column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, first, each, offset = plan.value.T
        key = (length << 44) + rank
        for batch in batches:
            size, own = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (size << 44) + own, side="right") - 1
            step = own - rank[at]
            slots = [pa.array(first[at] + step // each[at]), pa.array(offset[at] + step % each[at] * size)]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *slots], [*names, "sequence_id", "offset"])

    return run


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every text's ids and one end_id into sequences of at most `capacity` ids, as few as best fit finds.

    One row per piece: id_col, piece (from 0), start (the text's ids before it), length, ids_crc32
    (of little-endian 32-bit ids), sequence_id (from 0), offset (gapless from 0 in each sequence).
    Only texts of more than `capacity` ids, end_id included, are cut, each piece but the last being full.

    Null, empty and blank texts are a piece of end_id alone. Repeated rows, repeated and null
    ids are texts of their own; other columns are ignored; an empty table gives an empty result.
    The driver holds the histogram (`capacity` rows at most) and the plan made of it. No window or
    group runs over the pieces of a length: ranks are a task's own turns plus the counts of the tasks before it.
    """
    spark = df.sparkSession
    pieces = materialize(id_and_text(df, id_col, text_col).mapInArrow(_pieces(path, capacity, end_id), "id long, piece int, start long, length long, ids_crc32 long, task int, turn long"), "pieces")
    counts = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_runs(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("turn")).alias("rank"))
    return ranked.mapInArrow(_take_slots(plan), f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
