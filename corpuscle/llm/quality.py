"""Quality rules, with the distribution-divergence rule on top.

A document's histograms of character classes and of common words are compared with those
of each language, summed over all documents of the language that pass the base rules, by the
Jensen-Shannon distance. A language's common words are those in most of its documents. A document far
from every language is dropped; texts too short for a histogram to mean anything are judged by the
base rules alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, materialize

SYMBOLS = "#*$%&|<>"
#: Character classes: small and capital ASCII letters, other letters, digits, blanks, punctuation, the symbols, the rest.
CLASSES = ("small", "capital", "letter", "digit", "blank", "point", "symbol", "rest")


def _class_table() -> np.ndarray:
    table = np.full(0x3000, CLASSES.index("rest"), dtype=np.uint8)
    for c in range(len(table)):
        s = chr(c)
        if c < 128 and s.isalpha():
            table[c] = CLASSES.index("small" if s.islower() else "capital")
        elif s.isalpha():
            table[c] = CLASSES.index("letter")
        elif s.isdigit():
            table[c] = CLASSES.index("digit")
        elif s in " \t\n\v\f\r":
            table[c] = CLASSES.index("blank")
        elif s in SYMBOLS:
            table[c] = CLASSES.index("symbol")
        elif s in ".,;:!?'\"()-":
            table[c] = CLASSES.index("point")
    return table


TABLE = _class_table()


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    n = len(ids)
    if n < 4:
        return 0
    if ids.max() < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # number the pairs first, so that the key fits
        _, pair = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)
        key = (pair[:-1].astype(np.int64) << 32) | ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def forms(vocabulary: list[str]) -> list[tuple[bytes, ...]]:
    """How each common word is written: as it is, with a capital, or in capitals."""
    return [tuple({w.encode(), w.capitalize().encode(), w.upper().encode()}) for w in vocabulary]


def measure(text: str | None, common_forms: list[tuple[bytes, ...]]) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, counts of character classes and of common words (the last: other words)."""
    if not text:
        return 0, 0, 0, 0, 0, [0] * len(CLASSES), [0] * (len(common_forms) + 1)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), len(TABLE))
    kinds = np.where(codes < len(TABLE), TABLE[np.minimum(codes, len(TABLE) - 1)], CLASSES.index("letter"))  # later planes: mostly letters
    kinds = np.bincount(kinds, minlength=len(CLASSES))
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]
    often = np.bincount(ids, minlength=len(number)) if words else ids
    common = [0] * (len(common_forms) + 1)
    for k, written in enumerate(common_forms):
        for w in written:
            i = number.get(w)
            if i is not None:
                common[k] += int(often[i])
    common[-1] = len(words) - sum(common)
    return len(words), len(text) - int(kinds[CLASSES.index("blank")]), int(kinds[CLASSES.index("symbol")]), len(lines) - len(set(lines)), repeated_words(ids), kinds.tolist(), common


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By batch and language, in how many documents each word (in lower case) stands."""
    for batch in batches:
        held: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(set(text.lower().encode("utf-8", "surrogatepass").split()))
        for lang, counts in held.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(counts), "word": pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})


def common_words(rows: DataFrame, per_lang: int) -> dict[str, list[str]]:
    """The per_lang words that stand in most documents of each language, ties by the word; from all of (lang, text).

    Each batch sends a word once with its number of documents; the best of a language are
    picked by a window that Spark limits before its shuffle. per_lang words of each language reach the driver.
    """
    pairs = rows.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_document_counts, "lang string, word string, n long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    best = pairs.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("rank", rank).where(F.col("rank") <= per_lang)
    out: dict[str, list[str]] = {}
    for r in best.orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.word)
    return out


def divergence(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of rows of counts to a reference, one for all or one for each row; 0 for rows without counts on either side."""
    total, whole = counts.sum(1, keepdims=True), np.atleast_2d(reference).sum(1, keepdims=True)
    p, q = counts / np.maximum(total, 1), np.broadcast_to(np.atleast_2d(reference) / np.where(whole > 0, whole, 1), counts.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) / 2 + np.where(q > 0, q * np.log2(q / m), 0).sum(1) / 2
    return np.where((total[:, 0] > 0) & np.broadcast_to(whole[:, 0] > 0, len(p)), np.sqrt(np.maximum(d, 0)), 0.0)


def shrunk(own: np.ndarray, pooled: np.ndarray, weight: float) -> np.ndarray:
    """A language's counts and `weight` more, dealt as in the pooled counts of all languages; rows, or one."""
    return own + weight * pooled / np.maximum(pooled.sum(-1, keepdims=True), 1)


#: Distance of the common-word histograms up to which a text is near a language.
MOST_WORD = 0.29


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    most_char: float = 0.3, most_word: float = MOST_WORD, least_chars: int = 200, least_words: int = 150,
    common_per_lang: int = 26, shrink_chars: float = 10_000, shrink_words: float = 2_000,
) -> DataFrame:
    """The base counts and verdicts of each whole text.

    (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance, nearest). base_failed: fewer than 50 words, or over half of
    them in repeated 3-word windows. kept: not base_failed, and the nearest language is
    within most_char by character classes (for texts of least_chars word characters or more) and
    within most_word by common words (of least_words words or more).

    A language's reference is the summed counts of all its documents that pass the base rules, shrunk towards those of all
    languages by the weight of shrink_chars characters and shrink_words words, so that a language counts
    by how much is known of it. A document's own counts are left out of what it is compared with. Its common words are
    learned from all its documents; they count as they are, with a capital and in capitals. Where nothing
    else is left, as with a single document, distances are 0. A document without a language is compared with all references.
    Null and empty texts have no words and fail. One row per input row, repeated rows and null ids included;
    other columns are ignored; an empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    lists = common_words(rows, common_per_lang)
    vocabulary = sorted({w for words in lists.values() for w in words})
    written = forms(vocabulary)

    def make():
        def run(ids: list, texts: list) -> dict:
            found = [measure(t, written) for t in texts]
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common")
            return {"id": ids} | {n: [f[k] for f in found] for k, n in enumerate(names)}

        return run

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    seen = map_texts(rows, make, f"id long, lang string, {counts}, chars array<long>, common array<long>", 2_000_000)
    seen = materialize(seen.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "measured")
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in (("chars", len(CLASSES)), ("common", len(vocabulary) + 1)) for i in range(n)]
    known = seen.where(F.col("lang").isNotNull() & ~F.col("base_failed"))
    # One row for each language.
    sums = known.groupBy("lang").agg(*sums).orderBy("lang").collect()
    langs = [r.lang for r in sums]
    by_lang = [np.array([[r[f"{c}{i}"] for i in range(n)] for r in sums], float).reshape(len(sums), n) for c, n in (("chars", len(CLASSES)), ("common", len(vocabulary) + 1))]

    @F.pandas_udf("char_distance double, word_distance double, nearest string, near boolean")
    def judge(chars, common, word_chars, n_words, lang, base_failed):
        import pandas as pd

        n = len(chars)
        if not langs or not n:
            return pd.DataFrame({"char_distance": np.zeros(n), "word_distance": np.zeros(n), "nearest": [None] * n, "near": np.ones(n, bool)})
        taught = ~base_failed.to_numpy() & lang.notna().to_numpy()
        distances = []
        for counts, sums, weight in ((chars, by_lang[0], shrink_chars), (common, by_lang[1], shrink_words)):
            counts = np.stack(counts.to_numpy()).astype(float)
            pooled = sums.sum(0) - counts * taught[:, None]
            distances.append(np.stack([divergence(counts, shrunk(sums[k] - counts * (taught & (lang == name).to_numpy())[:, None], pooled, weight)) for k, name in enumerate(langs)], axis=1))
        by_char, by_word = distances
        excess = np.maximum(np.where(word_chars.to_numpy()[:, None] >= least_chars, by_char / most_char, 0), np.where(n_words.to_numpy()[:, None] >= least_words, by_word / most_word, 0))
        best = (excess + 1e-6 * (by_char + by_word)).argmin(1)
        at = np.arange(n), best
        return pd.DataFrame({"char_distance": by_char[at], "word_distance": by_word[at], "nearest": [langs[i] for i in best], "near": excess[at] <= 1})

    out = seen.withColumn("judged", judge("chars", "common", "word_chars", "n_words", "lang", "base_failed"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("judged.near")).alias("kept"), "judged.char_distance", "judged.word_distance", "judged.nearest",
    )
