"""Ranked lexical search against a plain scorer of every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from corpuscle.llm import term_search

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    bags = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, b in bags:
            m = 25 + 75 * b.total() * n_docs // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, k in asked.items() if b[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return Counter(out)


def frames(spark, docs, items):
    left = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(3)
    return left, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")


def found(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_terms():
    assert term_search.terms_of("A-b_C9É日本 x\tÀ{z}~".encode()) == [t.encode() for t in terms("A-b_C9É日本 x\tÀ{z}~")]


ODD_DOCS = [
    (1, None), (2, ""), (3, " -- \n"), (4, "one"), (5, "One two TWO three"), (6, "x " * 5000 + "two"), (7, "日本語 É é two"), (8, "one two three four " * 30), (4, "one"), (4, "two one"),
    (None, "one two"), (None, "three three"), (9, "z" * 50_000), (10, "one"), (11, "one"), (12, "ONE"),
]
ODD_ITEMS = [(1, "one two two"), (2, None), (3, ""), (4, "nothing here"), (5, "日本語 three É"), (1, "one two two"), (None, "four two"), (6, "z" * 50_000), (7, "one " * 500 + "x")]


@pytest.mark.parametrize("owners,top", [(1, 3), (3, 10), (5, 2)])
def test_search_odd_rows(spark, owners, top):
    got = term_search.term_search(*frames(spark, ODD_DOCS, ODD_ITEMS), top=top, owners=owners)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == brute(ODD_DOCS, ODD_ITEMS, top)


def test_search_of_empty_tables(spark):
    docs, items = frames(spark, ODD_DOCS, ODD_ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.where("doc_id < 4"), items)):
        assert term_search.term_search(d, i).count() == 0


def test_search_over_many_shards_and_bundles(spark, monkeypatch):
    """Small shards and bundles, so that accumulators are left behind in most steps; many equal scores."""
    monkeypatch.setattr(term_search, "SHARD_BITS", 4)
    monkeypatch.setattr(term_search, "BUNDLE_ITEMS", 7)
    rng = np.random.default_rng(5)
    word = lambda: f"w{int(rng.zipf(1.3)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.integers(1, 40)))) for i in range(400)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(120)]
    items = [(i, " ".join(word() for _ in range(rng.integers(1, 12)))) for i in range(40)]
    assert found(term_search.term_search(*frames(spark, docs, items), top=5, owners=4)) == brute(docs, items, 5)


def test_search_of_documents(spark, sf):
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    assert found(term_search.term_search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))) == brute(docs, items, 10)
