"""Language identification by unigram piece models, summed over all segmentations.

The vocabulary is fixed and public (the normal pieces of a sentencepiece model). A language
gives each piece a probability, learned by expectation maximisation over all segmentations
of training words. The likelihood of a word, however long, is the sum over its segmentations of
the product of their pieces' probabilities, by the forward algorithm; pieces do not cross white
space, so a text's is the product over its words. Distinct words are scored once per
worker, all short words of a batch and all languages at a time.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filter_texts, id_and_text, map_texts, materialize, trainable

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
MARK = "▁"
#: Longer words are not batched, but scored on their own.
LONG = 64
#: Log probability of a character without a piece, alike in all languages; and a scale by character against underflow.
UNKNOWN, SCALE = -12.0, 2.5
#: Deviations, and log likelihood by character, that a floor is below the mean at least.
MARGIN, LEAST_MARGIN = 8.0, 3.0
LETTER = regex.compile(r"\p{L}")
UND = "und"


class Pieces:
    """The vocabulary, found by hashes of substrings in two direct tables."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.longest = max(map(len, self.names))
        self.length = np.array([len(n) for n in self.names])
        hashes = np.zeros(len(self.names), dtype=U)
        for k, name in enumerate(self.names):
            h = 0
            for c in name:
                h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
            hashes[k] = h
        salt = 1
        while not self._build(hashes, salt):
            salt += 2

    def _build(self, hashes: np.ndarray, salt: int) -> bool:
        self.salts = [U((salt * 0xBF58476D1CE4E5B9 + 2 * i + 1) & (2**64 - 1) | 1) for i in (1, 2)]
        self.tables = [np.full(1 << 20, -1, dtype=np.int32) for _ in self.salts]
        self.hashes = hashes
        left = np.arange(len(hashes))
        for salt_of, table in zip(self.salts, self.tables, strict=True):
            slots = (hashes[left] * salt_of) >> U(44)
            table[slots[::-1]] = left[::-1]
            left = left[table[slots] != left]
        return not len(left)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        for salt, table in zip(self.salts, self.tables, strict=True):
            k = table[(hashes * salt) >> U(44)]
            hit = (k >= 0) & (self.hashes[k] == hashes)
            out[hit] = k[hit]
        return out

    def lattice(self, words: list[str]) -> Lattice:
        return Lattice(self, words)


class LongWord:
    """All pieces in one word: by end, the starts and pieces of those that end there. Sums are kept as logarithms, so that no length overflows."""

    def __init__(self, pieces: Pieces, word: str):
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U) + U(1)
        self.size, self.longest = len(chars), pieces.longest
        power = [U(pow(int(BASE), k, 2**64)) for k in range(pieces.longest + 1)]
        ends, starts, found = [], [], []
        window = np.zeros(self.size, dtype=U)  # the hash of the last `length` characters at each end
        for length in range(1, min(pieces.longest, self.size) + 1):
            window[length - 1 :] += chars[: self.size - length + 1] * power[length - 1]
            piece = pieces.find(window[length - 1 :])
            at = np.arange(len(piece)) if length == 1 else np.flatnonzero(piece >= 0)  # characters without a piece of their own stand for themselves
            ends.append(at + length)
            starts.append(at)
            found.append(piece[at])
        ends, starts, found = (np.concatenate(x) for x in (ends, starts, found))
        order = np.argsort(ends, kind="stable")
        self.ends, self.starts, self.found = ends[order], starts[order], found[order]
        self.cut = np.searchsorted(self.ends, np.arange(1, self.size + 2))

    def forward(self, table: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over segmentations up to each character (size + 1, models)."""
        out = np.zeros((self.size + 1, table.shape[1]))
        p = table[self.found]
        for end in range(1, self.size + 1):
            e = slice(self.cut[end - 1], self.cut[end])
            out[end] = out[end - 1] + np.log((np.exp(out[self.starts[e]] - out[end - 1]) * p[e]).sum(0))
        return out

    def log_likelihood(self, table: np.ndarray) -> np.ndarray:
        """forward()'s last row, by plain numbers (few pieces end at a character), scaled where they leave the middle of their range."""
        cut, starts, out = self.cut.tolist(), self.starts.tolist(), []
        for p in table[self.found].T.tolist():
            sums, shift = [1.0], 0.0
            for end in range(1, self.size + 1):
                total = 0.0
                for e in range(cut[end - 1], cut[end]):
                    total += sums[starts[e]] * p[e]
                sums.append(total)
                if not 1e-100 < total < 1e100:
                    shift += math.log(total)
                    sums[max(0, end - self.longest) :] = [x / total for x in sums[max(0, end - self.longest) :]]
            out.append(math.log(sums[-1]) + shift)
        return np.array(out) - SCALE * self.size

    def expected(self, table: np.ndarray, weight: float) -> np.ndarray:
        """Expected counts of the pieces under one model."""
        upto = self.forward(table)[:, 0]
        back = np.full(self.size + 1, -np.inf)
        back[-1] = 0.0
        p = np.log(table[self.found, 0])
        for end in range(self.size, 0, -1):
            e = slice(self.cut[end - 1], self.cut[end])
            if back[end] > -np.inf:  # else no segmentation goes on from here
                s = self.starts[e]
                back[s] = np.logaddexp(back[s], back[end] + p[e])
        share = np.exp(upto[self.starts] + p + back[self.ends] - upto[-1])
        return np.bincount(np.where(self.found < 0, len(table) - 1, self.found), weight * share, len(table))[:-1]


class Lattice:
    """All pieces in all words of a batch: edges (word, start, end, piece), by end and length."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.pieces, n = pieces, len(words)
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-self.sizes, kind="stable")  # long words first: those that reach a position are a prefix
        self.order = order
        width = int(self.sizes.max()) if n else 0
        chars = np.frombuffer("".join(w.ljust(width, "\0") for w in (words[i] for i in order)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, width).astype(U) + U(1)
        prefix = np.zeros((n, width + 1), dtype=U)
        for i in range(width):
            prefix[:, i + 1] = prefix[:, i] * BASE + chars[:, i]
        reach = np.searchsorted(-self.sizes[order], -np.arange(width + 1), side="right")  # words of at least so many characters
        power = [U(pow(int(BASE), k, 2**64)) for k in range(pieces.longest + 1)]
        self.width, self.n, self.reach, self.edges = width, n, reach, []
        for end in range(1, width + 1):
            m = reach[end]
            for length in range(1, min(pieces.longest, end) + 1):
                found = pieces.find(prefix[:m, end] - prefix[:m, end - length] * power[length])
                at = np.flatnonzero(found >= 0)
                piece = found[at]
                if length == 1 and len(at) < m:  # characters without a piece of their own
                    at, piece = np.arange(m), found
                if len(at):
                    self.edges.append((end, length, at, piece))

    def _weights(self, table: np.ndarray, length: int, piece: np.ndarray) -> np.ndarray:
        """table: probabilities (pieces + 1, models), already scaled by length; its last row is the unknown character (index -1)."""
        return table[piece]

    def forward(self, table: np.ndarray) -> np.ndarray:
        """Sums over segmentations (width + 1, words in lattice order, models)."""
        alpha = np.zeros((self.width + 1, self.n, table.shape[1]))
        if self.n:
            alpha[0] = 1
        for end, length, at, piece in self.edges:
            alpha[end, at] += alpha[end - length, at] * self._weights(table, length, piece)
        return alpha

    def log_likelihood(self, table: np.ndarray) -> np.ndarray:
        """(words, models), in the order the words were given."""
        out = np.empty((self.n, table.shape[1]))
        if self.n:
            alpha = self.forward(table)
            sizes = self.sizes[self.order]
            out[self.order] = np.log(alpha[sizes, np.arange(self.n)]) - SCALE * sizes[:, None]
        return out

    def expected(self, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces under one model, words counting by weight."""
        alpha = self.forward(table)[:, :, 0]
        sizes = self.sizes[self.order]
        whole = alpha[sizes, np.arange(self.n)]
        beta = np.zeros_like(alpha)
        beta[sizes, np.arange(self.n)] = weight[self.order] / whole
        counts = np.zeros(len(table))
        for end, length, at, piece in reversed(self.edges):
            p = table[piece, 0] * beta[end, at]
            counts += np.bincount(np.where(piece < 0, len(table) - 1, piece), p * alpha[end - length, at], len(table))
            beta[end - length, at] += p
        return counts[:-1]


def _table(pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """Scaled probabilities (pieces + 1, models)."""
    scaled = probabilities * np.exp(SCALE * pieces.length)[:, None]
    return np.concatenate([scaled, np.full((1, scaled.shape[1]), np.exp(UNKNOWN + SCALE))])


def train(texts: list[str], langs: list[str], vocabulary: str, rounds: int = 3, smoothing: float = 0.05) -> dict | None:
    """Piece probabilities of every language: {"langs", "table" (pieces + 1, languages)}; None without a text."""
    names = sorted(set(langs))
    if not names:
        return None
    pieces, columns = pieces_of(vocabulary), []
    for name in names:
        counts = Counter(MARK + w for t, lang in zip(texts, langs, strict=True) if lang == name for w in t.split())
        short = [w for w in counts if len(w) <= LONG]
        lattice, weight = pieces.lattice(short), np.array([counts[w] for w in short], dtype=np.float64)
        long = [(LongWord(pieces, w), n) for w, n in counts.items() if len(w) > LONG]
        p = np.full((len(pieces.names), 1), 1 / len(pieces.names))
        for _ in range(rounds if counts else 0):
            table = _table(pieces, p)
            c = sum((w.expected(table, n) for w, n in long), lattice.expected(table, weight) if short else np.zeros(len(pieces.names)))
            p = ((c + smoothing) / (c.sum() + smoothing * len(c)))[:, None]
        columns.append(p)
    return {"langs": names, "table": _table(pieces, np.concatenate(columns, axis=1))}


@lru_cache(maxsize=2)
def pieces_of(vocabulary: str) -> Pieces:
    """The vocabulary's tables, built once in a process."""
    return Pieces(vocabulary)


class Identifier:
    """Predicts the language of texts; the likelihoods of words met before are kept."""

    def __init__(self, model: dict, vocabulary: str, most: int = 250_000):
        self.langs, self.table, self.pieces, self.most = model["langs"], model["table"], pieces_of(vocabulary), most
        self.floor = model.get("floor")
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        marked = [MARK + w for w in words]
        short = [i for i, w in enumerate(marked) if len(w) <= LONG]
        out = np.empty((len(words), len(self.langs)))
        for i in range(0, len(short), 10_000):
            out[short[i : i + 10_000]] = self.pieces.lattice([marked[k] for k in short[i : i + 10_000]]).log_likelihood(self.table)
        for i, w in enumerate(marked):
            if len(w) > LONG:
                out[i] = LongWord(self.pieces, w).log_likelihood(self.table)
        self.scores = np.concatenate([self.scores, out.astype(np.float32)])

    def log_likelihoods(self, texts: list) -> np.ndarray:
        if len(self.row) > self.most:
            self._clear()
        split, row = [t.split() if t else [] for t in texts], self.row  # as train() does, at any white space
        new: list[str] = []
        for words in split:
            for w in set(words).difference(row):
                row[w] = len(row)
                new.append(w)
        if new:
            self._learn(new)
        out = np.zeros((len(texts), len(self.langs)))
        for i, words in enumerate(split):
            if words:
                out[i] = self.scores[np.fromiter(map(row.__getitem__, words), dtype=np.int64, count=len(words))].sum(0, dtype=np.float64)
        return out

    def __call__(self, texts: list) -> tuple[list[str], list[float], list[float]]:
        """Predicted languages, their posterior probabilities under equal priors, and their log likelihoods by character."""
        ll = self.log_likelihoods(texts)
        post = np.exp(ll - ll.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        best = post.argmax(1)
        lettered = [t is not None and LETTER.search(t) is not None for t in texts]
        chars = [len(t) if t else 1 for t in texts]
        return (
            [self.langs[b] if ok else UND for b, ok in zip(best, lettered, strict=True)],
            [float(post[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, lettered, strict=True))],
            [float(ll[i, b]) / n for i, (b, n) in enumerate(zip(best, chars, strict=True))],
        )

    def known(self, texts: list, least: float) -> np.ndarray:
        """Texts with a language whose score is `least` or more and that their language explains as well as the worst of its own, with a margin."""
        langs, scores, fits = self(texts)
        floor = dict(zip(self.langs, self.floor, strict=True)) if self.floor is not None else {}
        return np.array([n != UND and s >= least and f >= floor_of(floor.get(n), len(t)) for t, n, s, f in zip(texts, langs, scores, fits, strict=True)], dtype=bool)


def floor_of(own: tuple[float, float] | None, chars: int) -> float:
    """The least log likelihood by character of a text of so many characters: MARGIN deviations of their mean below the language's, LEAST_MARGIN at least."""
    return -math.inf if own is None else own[0] - max(MARGIN * own[1] / math.sqrt(max(chars, 1)), LEAST_MARGIN)


def sample_of(rows: DataFrame, group: str, per_group: int, total_chars: int) -> DataFrame:
    """(id, group, text): of each group at most per_group ids by hash, as far as their texts' characters before them stay under total_chars.

    A row's text is whole; of rows that repeat an id one stays. So per_group texts, and total_chars
    and one text more, bound what a group has, however large the table or its texts.
    """
    # A share of about four times per_group ids by hash first, so that no group's ids meet in one task.
    slots = 1 << 20
    ids = rows.groupBy("id", group).agg(F.max(F.length("text")).alias("chars"))
    share = materialize(ids.groupBy(group).agg(F.least(F.lit(slots), F.floor(F.lit(slots) * 4 * per_group / F.count("*")) + 1).alias("upto")), "share")  # written, so that Spark knows its size
    few = ids.join(share, group).where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(slots)) < F.col("upto"))
    order = Window.partitionBy(group).orderBy(F.xxhash64("id"), "id")
    before = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = few.withColumn("rank", F.row_number().over(order)).withColumn("before", F.coalesce(before, F.lit(0)))
    chosen = materialize(ranked.where((F.col("rank") <= per_group) & (F.col("before") < total_chars)).select("id", group), "sample")
    return rows.join(chosen, ["id", group]).groupBy("id", group).agg(F.max("text").alias("text"))


def fit(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300, total_chars: int = 3_000_000) -> dict | None:
    """Learns from a bounded sample of rows with a language that are not held out.

    The sample: of each language at most per_lang ids by hash, whole texts, as far as those before
    them have under total_chars characters. Four in five of the sample teach the pieces; the fifth
    sets `floor`, from which floor_of() takes the least log likelihood by character that counts as the language. A
    language is a column of the model, which grows with the languages. None without such rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    able = rows.where(trainable(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    docs = sorted((r.lang, zlib.crc32(str(r.id).encode()), r.id, r.text) for r in sample_of(able, "lang", per_lang, total_chars).collect())
    if not docs:
        return None
    model = train([d[3] for d in docs], [d[0] for d in docs], vocabulary)
    model["floor"] = _floors(docs, vocabulary)
    return model


def _floors(docs: list[tuple], vocabulary: str) -> list[tuple[float, float] | None]:
    """By language, over texts that a model did not learn from: the median log likelihood by character, and the deviation of one character, as the median of the texts' own times the square root of their lengths tells it: medians, since junk is among the texts. None without two such texts."""
    apart = train([d[3] for i, d in enumerate(docs) if i % 5], [d[0] for i, d in enumerate(docs) if i % 5], vocabulary)
    names = sorted({d[0] for d in docs})
    if apart is None or apart["langs"] != names:
        return [None] * len(names)
    held = [d for i, d in enumerate(docs) if i % 5 == 0 and d[3].strip()]
    ll = Identifier(apart, vocabulary).log_likelihoods([d[3] for d in held]) if held else np.zeros((0, len(names)))
    out: list[tuple[float, float] | None] = []
    for k, name in enumerate(names):
        own = np.array([(row[k], len(d[3])) for d, row in zip(held, ll, strict=True) if d[0] == name]).reshape(-1, 2)
        if len(own) < 2:
            out.append(None)
            continue
        fit = own[:, 0] / own[:, 1]
        middle = float(np.median(fit))
        out.append((middle, 1.4826 * float(np.median(np.abs(fit - middle) * np.sqrt(own[:, 1])))))
    return out


def identify(df: DataFrame, model: dict | None, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, fit) of each whole text.

    lang_pred is a learned language, or "und" (score 0) if the text is null or has no letter,
    or if model is None; ties go to the first by name. score is the posterior probability
    of lang_pred, fit the log likelihood by character under it (null if model is None). One row per input row, repeated rows and null ids included; other columns
    are ignored; an empty table gives an empty result.
    """
    texts = id_and_text(df, id_col, text_col)
    if model is None:
        return texts.select(F.col("id").alias(id_col), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("fit"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # the vocabulary's size times the number of languages

    def make():
        identifier = Identifier(shared.value, vocabulary)

        def run(ids: list, texts: list) -> dict:
            lang, score, fits = identifier(texts)
            return {"id": ids, "lang_pred": lang, "score": score, "fit": fits}

        return run

    return map_texts(texts, make, "id long, lang_pred string, score double, fit double", 500_000).withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, model: dict | None, vocabulary: str, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, in a known language; all of them if model is None.

    Known: the best language's score is `least` or more and its log likelihood by character is no less
    than the model's floor for it at the text's length, which falls as the text gets shorter: among any number of
    languages one is the best, so the score alone rejects hardly any text that none of them explains.
    """
    if model is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        identifier = Identifier(shared.value, vocabulary)
        return lambda texts: identifier.known(texts, least)

    return filter_texts(df, make, text_col, 500_000)
