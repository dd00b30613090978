"""Byte-level BPE by the tokenizers library, once for each distinct pre-token.

Byte-level BPE merges inside pre-tokens only, so a text's ids are those of its pre-tokens.
Natural text repeats them: a batch is split with the vocabulary's own pattern, and the library
encodes the pre-tokens that the worker has not met yet.
"""

from __future__ import annotations

import base64
import json

import regex
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

#: Characters that every Unicode version splits alike.
COMMON = regex.compile(r"[\t-\r\x20-\x7e\xa1-\u024f\u0391-\u03a1\u03a3-\u03ce\u0410-\u044f\u2010-\u2027\u4e00-\u9fa5]*")
#: Python's \s has four separators (1C to 1F) that Unicode's White_Space lacks.
SPACE = r"\p{White_Space}"


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = [""] * 256, 256
    for b in range(256):
        if b in kept:
            table[b] = chr(b)
        else:
            table[b], free = chr(free), free + 1
    return table


TO_CHARACTER = dict(enumerate(byte_table()))
is_blank = regex.compile(SPACE + "+").fullmatch


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A tokenizers.Tokenizer that merges as ranks say: of all adjacent pairs whose concatenation has a rank, the lowest first.

    Every way to split a token into two is a merge, in the order of the token's rank, as a
    rank file names results and not pairs. A pre-token that is itself in the file is taken whole.
    """
    table = byte_table()
    name = {token: "".join(table[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        merges += [(name[token[:i]], name[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    t = Tokenizer(models.BPE(vocab={name[k]: v for k, v in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.decoder = decoders.ByteLevel()
    return t


class PieceEncoder:
    """Encodes texts pre-token by pre-token, remembering at most `most` of them.

    rare_whole: a text with characters on which Unicode versions may differ is given to the
    library whole, whose own split then holds.
    """

    def __init__(self, tokenizer: Tokenizer, pattern: str, special: tuple[str, ...] = (), rare_whole: bool = True, most: int = 250_000):
        self.whole, self.most, self.rare_whole = tokenizer, most, rare_whole
        self.special = frozenset(special)
        body = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\s", SPACE).replace(r"\S", r"\P{White_Space}")
        names = "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))
        self.pattern = regex.compile(f"{names}|{body}" if names else body)
        self.special_split = regex.compile(f"({names})") if names else None
        self.known: dict[str, tuple[int, ...]] = {}

    def plain(self, text: str) -> bool:
        return not self.rare_whole or COMMON.fullmatch(text) is not None

    def split(self, text: str) -> list[str]:
        """The text's pre-tokens; special strings are pre-tokens of their own."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out = []
        for part in self.special_split.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Merges what is new among the pieces: the library's model on the characters that stand for a pre-token's bytes."""
        if len(self.known) + len(pieces) > self.most:
            self.known = {}
        merge, known = self.whole.model.tokenize, self.known
        for p in pieces.difference(known):
            if p in self.special:
                known[p] = tuple(self.whole.encode(p, add_special_tokens=False).ids)
            else:
                known[p] = tuple([t.id for t in merge(p.encode("utf-8").decode("latin-1").translate(TO_CHARACTER))])

    def encode_pieces(self, texts: list) -> list[list[tuple[int, ...]]]:
        """The ids of every text, by pre-token; a text with rare characters is one piece that the library encodes whole."""
        split = [self.split(t) if t and self.plain(t) else None for t in texts]
        need: set[str] = set()
        for s in split:
            if s:
                need.update(s)
        self.learn(need)
        known = self.known
        out = [[known[p] for p in s] if s else [] for s in split]
        odd = [i for i, t in enumerate(texts) if t and split[i] is None]
        for i, e in zip(odd, self.whole.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = [tuple(e.ids)]
        return out


def special_strings(path: str) -> tuple[str, ...]:
    """Contents of a tokenizer file's added tokens."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", []))


__all__ = ["TO_CHARACTER", "PieceEncoder", "byte_table", "is_blank", "read_ranks", "special_strings", "tokenizer_of_ranks"]
