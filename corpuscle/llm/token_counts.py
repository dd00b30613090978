"""Exact token counts at every prefix, by dynamic programming.

BPE merges inside pre-tokens only. Inside one, the encoding of a prefix ends with the one token that
fits there: it spells the prefix's end, and beside the last token of what comes before it the library
would keep both as they are. So count[i] = count[i - length of that token] + 1, byte by byte, and
the count of a text's prefix is the sum over the whole pre-tokens before it and the entry of the
one that it cuts. Truncation and budget questions then read the stored counts; no text is encoded again.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain, pairwise

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import id_and_text, map_texts
from .pieces import TO_CHARACTER, PieceEncoder, is_blank, special_strings

#: Pre-tokens, entries of their counts and pairs of tokens that a worker remembers.
MOST_PIECES, MOST_ENTRIES, MOST_PAIRS = 500_000, 8_000_000, 1_000_000


class PrefixTable:
    """counts[k]: the tokens of a text's first k characters."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        #: least[k]: the fewest tokens of any prefix of k characters or more, which rises with k, unlike counts.
        self.least = np.minimum.accumulate(counts[::-1])[::-1]

    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, chars: int) -> int:
        return int(self.counts[min(max(chars, 0), len(self.counts) - 1)])

    def fit(self, budget: int) -> int:
        """The longest prefix of at most `budget` tokens, in characters, by one binary search."""
        return max(int(np.searchsorted(self.least, budget, side="right")) - 1, 0)


class Counter:
    """Counts at every prefix by one tokenizer file, special strings handled as the library does by default."""

    def __init__(self, path: str, pattern: str):
        tokenizer = Tokenizer.from_file(path)
        self.encoder = PieceEncoder(tokenizer, pattern, special_strings(path))
        self.merge, self.presplit = tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str
        self.ending = ahocorasick.Automaton()  # all tokens that end at a place
        for token in tokenizer.get_vocab(with_added_tokens=False):
            self.ending.add_word(token, token)
        self.ending.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.start, self.size, self.total, self.blank, self.begins_blank = ([np.zeros(0, np.int64)] for _ in range(5))
        self.pool = [np.zeros(0, np.int32)]
        self.entries = 0

    def beside(self, a: str, b: str) -> bool:
        """The library keeps the tokens a and b as they are where they meet ("" for a: b alone)."""
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        held = self.pairs[a, b] = [t.value for t in self.merge(a + b)] == ([a, b] if a else [b])
        return held

    def grow(self, piece: str) -> list[int]:
        """The counts of all prefixes of a pre-token, by character."""
        raw = piece.encode("utf-8")
        count, last = [0] * (len(raw) + 1), [""] * (len(raw) + 1)
        known = self.pairs.get
        for end, token in self.ending.iter(raw.decode("latin-1").translate(TO_CHARACTER)):
            end += 1
            if count[end]:
                continue
            begin = end - len(token)
            before = last[begin]
            fits = known((before, token))
            if self.beside(before, token) if fits is None else fits:
                count[end], last[end] = count[begin] + 1, token
        if len(raw) > len(piece):
            count = [c for c, b in zip(count[1:], chain(raw[1:], b"x"), strict=True) if b & 0xC0 != 0x80]
        else:
            del count[0]
        if len(piece) == 3 and piece[0] == "'" and piece[1:].isalpha():  # a contraction that a cut turns into a mark and a letter
            count[1] = count[0] + self.grow(piece[1])[0]
        return count

    def learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.row)
        if new and (len(self.row) + len(new) > MOST_PIECES or self.entries > MOST_ENTRIES):
            self.clear()
            new = pieces
        if not new:
            return
        grown = []
        for piece in new:
            self.row[piece] = len(self.row)
            grown.append(self.grow(piece))
        size = np.array([len(g) for g in grown], dtype=np.int64)
        self.start.append(self.entries + np.cumsum(size) - size)
        self.size.append(size)
        self.total.append(np.array([g[-1] for g in grown], dtype=np.int64))
        self.blank.append(np.array([is_blank(p) is not None for p in new], dtype=np.int64))
        self.begins_blank.append(np.array([is_blank(p[0]) is not None for p in new], dtype=np.int64))
        self.pool.append(np.fromiter(chain.from_iterable(grown), dtype=np.int32, count=int(size.sum())))
        self.entries += int(size.sum())
        for name in ("start", "size", "total", "blank", "begins_blank", "pool"):
            setattr(self, name, [np.concatenate(getattr(self, name))])

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings; where Unicode versions may differ, the library splits."""
        if self.encoder.plain(text):
            return self.encoder.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.presplit(text)]

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """The counts of all prefixes of texts whose special strings count as plain text."""
        split = [self.split(t) if t else [] for t in texts]
        need = set().union(*split)
        # A prefix that ends inside white space ends with a single run of it, which the whole text splits before its last character.
        blank = {p for p in need if is_blank(p)}
        need.update(a + b[0] for s in split if not blank.isdisjoint(s) for a, b in pairwise(s) if a in blank)
        self.learn(need)
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(map(len, split)))
        size, total = self.size[0][rows], self.total[0][rows]
        upto, ends = np.cumsum(total), np.cumsum(size)
        before, begins = upto - total, ends - size
        counts = np.repeat(before, size) + self.pool[0][np.repeat(self.start[0][rows] - begins, size) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.cumsum([0, *map(len, split)])
        follows = np.zeros(len(rows), dtype=bool)
        follows[1:] = self.blank[0][rows[:-1]] > 0
        follows[edges[:-1][edges[:-1] < len(rows)]] = False
        at = np.flatnonzero(follows & (self.begins_blank[0][rows] > 0))
        if len(at):
            flat = list(chain.from_iterable(split))
            counts[begins[at]] = before[at - 1] + self.total[0][[self.row[flat[i - 1] + flat[i][0]] for i in at.tolist()]]
        out = []
        for k, s in enumerate(split):
            a, b = edges[k], edges[k + 1]
            if not s:
                out.append(np.zeros(1, dtype=np.int64))
            else:
                out.append(np.concatenate([[0], counts[begins[a] : ends[b - 1]] - before[a]]))
        return out

    def _with_special(self, text: str) -> np.ndarray:
        """A cut inside a special string leaves plain text, which its neighbours' pre-tokens take in."""
        parts = self.encoder.special_split.split(text)
        out, base = [np.zeros(1, dtype=np.int64)], 0
        for k in range(0, len(parts), 2):
            name = parts[k + 1] if k + 1 < len(parts) else ""
            counts = self.plain([parts[k] + name[:-1]])[0]
            out.append(base + counts[1:])
            base += int(counts[len(parts[k])])
            if name:
                base += 1
                out.append(np.array([base]))
        return np.concatenate(out)

    def tables(self, texts: list) -> list[PrefixTable]:
        texts = [t or "" for t in texts]
        special = [any(s in t for s in self.encoder.special) for t in texts]
        plain = iter(self.plain([t for t, s in zip(texts, special, strict=True) if not s]))
        return [PrefixTable(self._with_special(t) if s else next(plain)) for t, s in zip(texts, special, strict=True)]


@lru_cache(maxsize=2)
def counter_of(path: str, pattern: str) -> Counter:
    """One counter, and what it remembers, for all tasks of a worker process."""
    return Counter(path, pattern)


def prefix_counts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, counts): counts[k] are the tokens of the first k characters of the text, from 0 to all of them.

    Null and empty texts have the one entry 0. One row per input row; other columns are ignored.
    """

    def make():
        counter = counter_of(path, pattern)
        return lambda ids, texts: {"id": ids, "counts": [t.counts for t in counter.tables(texts)]}

    return map_texts(id_and_text(df, id_col, text_col), make, "id long, counts array<int>", 200_000).withColumnRenamed("id", id_col)


def tokens_at(counts: Column, chars: Column) -> Column:
    """Tokens of the first `chars` characters, from prefix_counts()."""
    return F.get(counts, F.least(F.greatest(chars, F.lit(0)), F.size(counts) - 1))


def fitting(counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most `budget` tokens, from prefix_counts(); 0 if none."""
    return F.coalesce(F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i))), F.lit(0))


def token_counts(df: DataFrame, path: str, pattern: str, budget: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit, fit_chars) for each whole text.

    over_limit: more tokens than `budget`. fit_chars: characters of the longest prefix within
    it; both from the stored prefix counts. Null texts count as empty (0, 0, false, 0). One row per
    input row, repeated rows and null ids included; other columns are ignored; an empty
    table gives an empty result. It needs no shuffle.
    """

    def make():
        counter = counter_of(path, pattern)

        def run(ids: list, texts: list) -> dict:
            tables = counter.tables(texts)
            totals = [t.total() for t in tables]
            return {
                "id": ids, "n_bytes": [len(t.encode("utf-8")) if t else 0 for t in texts], "n_tokens": totals,
                "over_limit": [n > budget for n in totals], "fit_chars": [t.fit(budget) for t in tables],
            }

        return run

    return map_texts(id_and_text(df, id_col, text_col), make, "id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long", 500_000).withColumnRenamed("id", id_col)
