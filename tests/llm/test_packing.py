"""Best-fit packing against the library's own ids and best fit on single pieces."""

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuscle.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t", "one", "It's we'RE <|endoftext|> and<|startoftext|>x a<|endoftext|>", "word " * 5000, "\x1c\x85   ΟΔΥΣΣΕΎΣ İı ẞ é ̸x  à́b",
    "日本語の文章" * 900, "🙂" * 3000, "Ab" * 40_000, "1234567890 -- ?!​﻿", "a\x0bb\x0cc\x1fd\x00e", "x" * 64 + " " + "x" * 65,
]


def best_fit(lengths, capacity):
    rooms, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        opened += at == len(rooms)
        room = (rooms.pop(at) if at < len(rooms) else capacity) - n
        if room:
            bisect.insort(rooms, room)
    return opened


def slots(histogram, capacity):
    out = defaultdict(list)
    for length, rank, n, first, each, offset in packing.plan_runs(histogram, capacity).tolist():
        for k in range(n):
            out[first + k // each].append((offset + k % each * length, length, rank + k))
    return out


@pytest.mark.parametrize("capacity,longest,n", [(1, 1, 3), (7, 7, 50), (100, 30, 400), (100, 100, 900), (2048, 2048, 3000), (2048, 90, 5000)])
def test_plan_is_best_fit_over_pieces(capacity, longest, n):
    lengths = np.random.default_rng(n).integers(1, longest + 1, n).tolist()
    found = slots(Counter(lengths), capacity)
    assert len(found) == best_fit(lengths, capacity) and sorted(found) == list(range(len(found)))
    ranks = defaultdict(list)
    for pieces in found.values():
        at = 0
        for offset, length, rank in sorted(pieces):
            assert offset == at
            at += length
            ranks[length].append(rank)
        assert at <= capacity
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(m)) for k, m in Counter(lengths).items()}


def test_plan_does_not_grow_with_the_documents():
    few, many = (packing.plan_runs({k: 1 + scale // k for k in range(1, 513)}, 512) for scale in (10**6, 10**12))
    assert len(many) < 2 * len(few) < 10_000
    with pytest.raises(ValueError):
        packing.plan_runs({5: 1}, 4)
    assert packing.plan_runs({}, 10).shape == (0, 6)


def test_words_encode_as_the_library():
    library, encoder = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    texts = [t or "" for t in ODD]
    # Every character of one code unit in front of, behind and between letters; words in capitals and with marks.
    texts += [f"{chr(c)} a{chr(c)} {chr(c)}B. a{chr(c)}é, {chr(c) * 3}!?" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    for k in (1, 2):  # from memory the second time
        got = encoder.encode(pa.array(texts))
        assert [t for t, a, b in zip(texts, got, want, strict=True) if a.tolist() != b] == []
    with pytest.raises(ValueError):
        packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_memory_keeps_what_is_used():
    memory = packing.Memory(4)
    for k in range(3):
        assert memory.missing(["a", "b"]) == (["a", "b"] if k == 0 else [])
        memory.update(a=1, b=2)
        assert memory.missing([f"c{k}", f"d{k}"]) == [f"c{k}", f"d{k}"]
        memory.update({f"c{k}": 3, f"d{k}": 4})
    assert len(memory) <= 4 and len(memory.old) <= 4


def check(got, rows, capacity):
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], dtype="<u4").tobytes()
            want[doc, k // capacity, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(placed) == best_fit([r.length for r in got], capacity)


def test_packing_of_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check(packing.pack(df, PATH).collect(), [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 2048)


def test_packing_odd_rows(spark):
    rows = [*enumerate(ODD), (3, "one"), (3, "others"), (None, "text"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, length int, sequence_id string").repartition(3)
    for capacity in (2048, 5, 1):
        check(packing.pack(df, PATH, capacity).collect(), rows, capacity)
    none = packing.pack(df.limit(0), PATH)
    assert none.count() == 0 and none.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
