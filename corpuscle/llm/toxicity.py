"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the embedding of its normalised form (hashed) joined with the mean embedding
of its character trigrams (hashed). Windows of WINDOW words that overlap run through a GRU in
both directions; attention pools the states into one logit per window. A document's logit
is the largest of its windows', so that training finds the windows that make a
document toxic (multiple-instance learning) and a short passage in a long text counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filter_texts, id_and_text, map_texts, trainable

WINDOW, STRIDE = 48, 24
WORD_ROWS, TRIGRAM_ROWS = 1 << 15, 1 << 12
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
#: Characters of a model word; longer runs become several.
LONGEST = 40
#: White space that bytes.split() leaves (and marks without width), punctuation, and what is between them.
PARTS = regex.compile(r"(?P<white>[\s\p{Z}\x00-\x1f\x7f-\x9f\u200b\ufeff]+)|(?P<marks>[\p{P}\p{S}]+)|[^\s\p{Z}\p{P}\p{S}\x00-\x1f\x7f-\x9f\u200b\ufeff]+")
EDGES = "\"'`.,;:!?()[]{}<>*#$%&|-_=+~^/\\@“”‘’«»…"

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _plain(word: str) -> str:
    low = word.lower()
    return low.strip(EDGES) or low


def pieces(run: bytes) -> list[bytes]:
    """A run as model words: itself, or if it is longer than LONGEST its parts between white space and punctuation, cut every LONGEST characters.

    Marks that hashing strips stay with the part before them, others are parts of their own: only white space is lost.
    """
    text = run.decode("utf-8", "surrogatepass")
    if len(_plain(text)) <= LONGEST:
        return [run]
    parts: list[str] = []
    joins = False  # the last part is a word that marks may follow
    for m in PARTS.finditer(text):
        if m["white"]:
            joins = False
        elif joins and m["marks"] and not m["marks"].strip(EDGES):
            parts[-1] += m["marks"]
            joins = False
        else:
            parts.append(m[0])
            joins = not m["marks"]
    return [p[i : i + LONGEST].encode("utf-8", "surrogatepass") for p in parts for i in range(0, len(p), LONGEST)]


class Words:
    """Rows of the words met so far; row 0 is the padding. New words' hashes are handed out once, by fresh()."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.new: list[bytes] = [b""]

    def rows(self, texts: list) -> list[np.ndarray]:
        """The rows of every text's words (runs without ASCII white space, long ones in pieces); null texts have none."""
        if len(self.row) > self.most:
            self.clear()
        row, split = self.row, [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        for k, words in enumerate(split):
            new = set(words).difference(row)
            parts = {w: pieces(w) for w in new if len(w) > LONGEST}
            if parts:
                split[k] = words = [p for w in words for p in parts.get(w, (w,))]
                new = set(words).difference(row)
            for w in new:
                row[w] = len(row) + 1
                self.new.append(w)
        return [np.fromiter(map(row.__getitem__, words), dtype=np.int32, count=len(words)) for words in split]

    def fresh(self) -> Hashed:
        """The hashes of the rows that were added since the last call."""
        new, self.new = self.new, []
        return Hashed.of(new)


class Hashed:
    """Hashes of words and of their character trigrams: word[i]; grams[at[i]:at[i + 1]]."""

    def __init__(self, word: np.ndarray, grams: np.ndarray, at: np.ndarray):
        self.word, self.grams, self.at = word, grams, at

    @classmethod
    def of(cls, words: list[bytes]) -> Hashed:
        low = b"\n".join(words).decode("utf-8", "replace").lower().split("\n")
        plain = [(w.strip(EDGES) or w).encode("utf-8", "surrogatepass") for w in low]
        word = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in plain), dtype=np.int32, count=len(plain))
        raw = np.frombuffer(b"".join(b"<%s>" % w for w in plain), dtype=np.uint8).astype(np.uint32)
        size = np.array([len(w) for w in plain], dtype=np.int64)  # trigrams of <w>; none if w is empty
        begin = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
        h = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)) if len(raw) > 2 else np.zeros(0, np.uint32)
        at = np.concatenate([[0], np.cumsum(size)])
        first = np.repeat(begin - at[:-1], size) + np.arange(at[-1])
        return cls(word, ((h[first] >> np.uint32(16)) % TRIGRAM_ROWS).astype(np.int32), at)

    def take(self, rows: np.ndarray) -> Hashed:
        size = np.diff(self.at)[rows]
        at = np.concatenate([[0], np.cumsum(size)])
        return Hashed(self.word[rows], self.grams[np.repeat(self.at[rows] - at[:-1], size) + np.arange(at[-1])], at)

    def inputs(self, p: Params) -> np.ndarray:
        """Joined word and mean character embeddings."""
        chars = np.zeros((len(self.word), CHAR_DIM), dtype=np.float32)
        size = np.diff(self.at)
        some = size > 0
        if some.any():
            chars[some] = np.add.reduceat(p["chars"][self.grams], self.at[:-1][some], axis=0) / size[some, None]
        return np.concatenate([p["words"][self.word], chars], axis=1)

    def spread(self, d_x: np.ndarray, grad: Params) -> None:
        """Adds the gradient of the inputs to those of the embeddings."""
        size = np.maximum(np.diff(self.at), 1)
        per_gram = np.repeat(d_x[:, WORD_DIM:] / size[:, None], np.diff(self.at), axis=0)
        for k in range(WORD_DIM):
            grad["words"][:, k] += np.bincount(self.word, d_x[:, k], WORD_ROWS).astype(np.float32)
        for k in range(CHAR_DIM):
            grad["chars"][:, k] += np.bincount(self.grams, per_gram[:, k], TRIGRAM_ROWS).astype(np.float32)


def windows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW rows, number of windows by text); the last window ends with the text, shorter texts are padded."""
    out, counts = [], np.ones(len(rows), dtype=np.int64)
    for k, r in enumerate(rows):
        if len(r) <= WINDOW:
            out.append(np.pad(r, (0, WINDOW - len(r)))[None])
        else:
            starts = np.append(np.arange(0, len(r) - WINDOW, STRIDE), len(r) - WINDOW)
            counts[k] = len(starts)
            out.append(r[starts[:, None] + np.arange(WINDOW)[None]])
    return (np.concatenate(out) if out else np.zeros((0, WINDOW), np.int32)), counts


def start_params(seed: int = 5) -> Params:
    """Random parameters."""
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"words": rng.normal(0, 0.1, (WORD_ROWS, WORD_DIM)), "chars": rng.normal(0, 0.1, (TRIGRAM_ROWS, CHAR_DIM)), "v": rng.normal(0.5, 0.1, 2 * h), "w": rng.normal(0.5, 0.1, 2 * h), "b": np.array([-1.0])}
    for way in "fb":
        p |= {f"W{way}": rng.normal(0, 0.3, (d, 3 * h)), f"U{way}": rng.normal(0, 0.3, (h, 3 * h)), f"c{way}": np.zeros(3 * h)}
    return {k: x.astype(np.float32) for k, x in p.items()}


def _gates(p: Params, x: np.ndarray, way: str, padded: bool = True) -> np.ndarray:
    """Input part of the gates of every row; the padding's (row 0) update gate is shut, so the state passes through."""
    g = x @ p[f"W{way}"] + p[f"c{way}"]
    if padded:
        g[0] = 0
        g[0, :HIDDEN] = 30
    return g


def _scan(p: Params, gates: np.ndarray, win: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
    """States (WINDOW x windows x HIDDEN) of one direction."""
    h = HIDDEN
    states = np.empty((WINDOW, len(win), h), dtype=np.float32)
    s = np.zeros((len(win), h), dtype=np.float32)
    for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
        g = gates[win[:, t]]
        u = s @ p[f"U{way}"]
        zr = _sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(g[:, 2 * h :] + r * u[:, 2 * h :])
        if keep is not None:
            keep.append((t, s, z, r, n, u[:, 2 * h :]))
        s = n + z * (s - n)
        states[t] = s
    return states


def _pool(p: Params, states: np.ndarray, win: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = states @ p["v"] + np.where(win.T == 0, np.float32(-1e4), np.float32(0))
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    c = np.einsum("tn,tnh->nh", a, states)
    return c @ p["w"] + p["b"][0], a, c


def logits(p: Params, gates: dict[str, np.ndarray], win: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """One logit per window."""
    out = [np.zeros(0, np.float32)]
    for i in range(0, len(win), chunk):
        w = win[i : i + chunk]
        out.append(_pool(p, np.concatenate([_scan(p, gates[way], w, way) for way in "fb"], axis=2), w)[0])
    return np.concatenate(out)


def gradients(p: Params, hashed: Hashed, win: np.ndarray, y: np.ndarray) -> Params:
    """Gradients of the mean log loss of the windows' logits."""
    h, kept = HIDDEN, {"f": [], "b": []}
    used, local = np.unique(np.append(win.ravel(), 0), return_inverse=True)
    own, local = hashed.take(used), local[:-1].reshape(win.shape)
    x = own.inputs(p)
    gates = {way: _gates(p, x, way) for way in "fb"}
    states = np.concatenate([_scan(p, gates[way], local, way, kept[way]) for way in "fb"], axis=2)
    out, a, c = _pool(p, states, local)
    d_out = ((_sigmoid(out) - y) / len(y)).astype(np.float32)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["b"][0], grad["w"] = d_out.sum(), c.T @ d_out
    d_c = d_out[:, None] * p["w"]
    d_a = np.einsum("tnh,nh->tn", states, d_c)
    d_e = a * (d_a - (a * d_a).sum(0))
    grad["v"] = np.einsum("tn,tnh->h", d_e, states)
    d_states = a[:, :, None] * d_c[None] + d_e[:, :, None] * p["v"]
    d_x = np.zeros_like(x)
    order = np.argsort(local.T.ravel(), kind="stable")
    begin = np.flatnonzero(np.diff(local.T.ravel()[order], prepend=-1))
    seen = local.T.ravel()[order][begin]
    for k, way in enumerate("fb"):
        d_steps, d_s = np.empty((WINDOW, len(win), 3 * h), dtype=np.float32), np.zeros((len(win), h), dtype=np.float32)
        for t, s, z, r, n, u in reversed(kept[way]):
            d_s = d_s + d_states[t, :, k * h : (k + 1) * h]
            d_n = d_s * (1 - z) * (1 - n * n)
            d_z, d_r = d_s * (s - n) * z * (1 - z), d_n * u * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
            grad[f"U{way}"] += s.T @ d_u
            d_steps[t, :, : 2 * h], d_steps[t, :, 2 * h :] = d_u[:, : 2 * h], d_n
            d_s = d_s * z + d_u @ p[f"U{way}"].T
        d_gates = np.zeros_like(gates[way])
        d_gates[seen] = np.add.reduceat(d_steps.reshape(-1, 3 * h)[order], begin, axis=0)
        d_gates[0] = 0
        grad[f"W{way}"], grad[f"c{way}"] = x.T @ d_gates, d_gates.sum(0)
        d_x += d_gates @ p[f"W{way}"].T
    own.spread(d_x, grad)
    return grad


def _evidence(hashed: Hashed, rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log-odds of each word hash for label 1, from the documents that hold it; and those documents' number."""
    counts = np.zeros((2, WORD_ROWS))
    for r, label in zip(rows, y, strict=True):
        counts[int(label), np.unique(hashed.word[r])] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    odds = np.log((counts[1] + 1) / (n1 + 2)) - np.log((counts[0] + 1) / (n0 + 2))
    total = counts.sum(0)
    return np.clip(odds * total / (total + 10), -3, 3).astype(np.float32), total


def train(texts: list[str], labels: list[int], epochs: int = 4, steps: int = 80, batch: int = 128, rate: float = 0.01, decay: float = 1e-3, least: int = 3, seed: int = 5) -> dict | None:
    """Fits the network by Adam, for `epochs` rounds and `steps` batches at least; None unless both labels occur.

    All parameters start at random; words' log-odds only pick the window of each text that the first
    round learns from. Words that fewer than `least` texts hold have no embedding of their own: only their
    characters count, so that single texts cannot be learned by heart.
    """
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    words = Words(most=1 << 62)
    rows = words.rows(texts)
    hashed = words.fresh()
    win, counts = windows(rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    p = start_params(seed)
    odds, holders = _evidence(hashed, rows, y)
    known = (holders >= least)[:, None]
    p["words"] *= known
    by_row = odds[hashed.word]
    by_row[0] = -3
    rng = np.random.default_rng(seed)
    worst = by_row[win].max(1)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(max(epochs, -(-steps * batch // (2 * len(y))))):
        if epoch:
            worst = _all_logits(p, hashed, win)
        top = np.array([first[i] + worst[first[i] : first[i] + counts[i]].argmax() for i in range(len(y))])
        other = first + (rng.random(len(y)) * counts).astype(np.int64)
        clean = y == 0
        chosen, target = np.concatenate([top, other[clean]]), np.concatenate([y, y[clean]])
        order = rng.permutation(len(chosen))
        for i in range(0, len(order), batch):
            k = order[i : i + batch]
            grad = gradients(p, hashed, win[chosen[k]], target[k])
            grad["words"] *= known
            step += 1
            for name, g in grad.items():
                g = g + decay * p[name]
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.001 * (g * g - v[name])
                p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return {"params": p, "scale": _platt(np.maximum.reduceat(_all_logits(p, hashed, win), first).astype(np.float64), y.astype(np.float64))}


def _all_logits(p: Params, hashed: Hashed, win: np.ndarray) -> np.ndarray:
    x = hashed.inputs(p)
    return logits(p, {way: _gates(p, x, way) for way in "fb"}, win)


def _platt(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic fit of y on x."""
    a = np.array([1.0, 0.0])
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(25):
        q = _sigmoid(np.clip(z @ a, -30, 30))
        a -= np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge * np.eye(2), z.T @ (q - y) + ridge * (a - [1.0, 0.0]))
    return float(max(a[0], 0.0)), float(a[1])


class Scorer:
    """Scores texts; the gates of words met before are kept."""

    def __init__(self, model: dict):
        self.p, self.scale, self.words = model["params"], model["scale"], Words()
        self.gates: dict[str, np.ndarray] = {}

    def __call__(self, texts: list) -> np.ndarray:
        rows = self.words.rows(texts)
        x = self.words.fresh()
        if len(x.word):
            whole = not self.gates or len(x.word) == len(self.words.row) + 1  # at the start, and after the words were forgotten
            for way in "fb":
                new = _gates(self.p, x.inputs(self.p), way, padded=whole)
                self.gates[way] = new if whole else np.concatenate([self.gates[way], new])
        win, counts = windows(rows)
        if not len(win):
            return np.zeros(0)
        best = np.maximum.reduceat(logits(self.p, self.gates, win), np.concatenate([[0], np.cumsum(counts)[:-1]]))
        return _sigmoid(np.clip(self.scale[0] * best.astype(np.float64) + self.scale[1], -30, 30))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: tuple[int, int] = (1600, 800), total_chars: int = 12_000_000) -> dict | None:
    """Trains on a bounded sample of labelled rows that are not held out.

    The sample: of each label the per_class ids with the lowest hashes, their texts whole, as far as
    those before them have under total_chars characters. So sum(per_class) texts, and of each label
    total_chars characters and one text more, reach the driver at most, however large the tables
    and their texts are. A document that is labelled twice counts as toxic if one label says so; of rows
    that repeat an id one text counts. None if a label is missing.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(trainable(F.col("id")))
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    sample = None
    for label, n in enumerate(per_class):
        one = marked.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(n)
        sample = one if sample is None else sample.unionByName(one)
    # At most sum(per_class) rows of two numbers: a proven bound.
    docs = id_and_text(df, id_col, text_col).join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.max("text").alias("text"))
    before = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1))
    rows = sorted((r.id, r.text or "", r.label) for r in docs.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < total_chars).drop("before").collect())
    return train([r[1] for r in rows], [r[2] for r in rows])


def score(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of each whole text, over all its overlapping windows; 0 for all if model is None.

    Null and empty texts are one window of padding. One row per input row, repeated rows and null
    ids included; other columns are ignored; an empty table gives an empty result.
    """
    texts = id_and_text(df, id_col, text_col)
    if model is None:
        return texts.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # about 1.3 MB, whatever the data

    def make():
        scorer = Scorer(shared.value)
        return lambda ids, texts: {"id": ids, "score": scorer(texts)}

    return map_texts(texts, make, "id long, score double", 500_000).withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: dict | None, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of df, all columns as they are, whose score is under `most`; all of them if model is None."""
    if model is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: scorer(texts) < most

    return filter_texts(df, make, text_col, 500_000)
