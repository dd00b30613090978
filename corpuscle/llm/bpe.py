"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import id_and_text, map_texts
from .pieces import PieceEncoder, byte_table, read_ranks, tokenizer_of_ranks


class Codec:
    """Encoder and decoder of one rank file. Ids are ranks; there are no special tokens."""

    def __init__(self, rank_path: str, pattern: str):
        ranks = read_ranks(rank_path)
        tokenizer = tokenizer_of_ranks(ranks, pattern)
        self.encoder = PieceEncoder(tokenizer, pattern, rare_whole=False)
        back = {c: b for b, c in enumerate(byte_table())}
        #: Bytes of each id, by reversing the byte table on the token's characters.
        self.bytes = {i: bytes(back[c] for c in token) for token, i in tokenizer.get_vocab().items()}
        self.text = {i: str(i) for i in self.bytes}

    def encode(self, texts: list) -> list[list[int]]:
        return [[i for piece in pieces for i in piece] for pieces in self.encoder.encode_pieces(texts)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def pieces_of_text(self, ids: Iterable[int]) -> list[str]:
        """The text that each id completes: a character whose bytes are split among ids belongs to the last of them."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        ids = list(ids)
        return [decoder.decode(self.bytes[i], final=k == len(ids) - 1) for k, i in enumerate(ids)]

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """(start, end) of each id in characters; ids that split a character all cover it."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        char_of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes[i]) for i in ids], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        return list(zip(char_of_byte[starts].tolist(), (char_of_byte[ends - 1] + 1).tolist(), strict=True)) if len(ids) else []


@lru_cache(maxsize=2)
def codec_of(rank_path: str, pattern: str) -> Codec:
    """One codec, and what it remembers, for all tasks of a worker process."""
    return Codec(rank_path, pattern)


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, starts, ends): the ids of each text and their character offsets. Null and empty texts have none."""

    def make():
        codec = codec_of(rank_path, pattern)

        def run(ids: list, texts: list) -> dict:
            found = codec.encode(texts)
            spans = [codec.offsets(t or "", i) for t, i in zip(texts, found, strict=True)]
            return {"id": ids, "ids": found, "starts": [[s for s, _ in x] for x in spans], "ends": [[e for _, e in x] for x in spans]}

        return run

    return map_texts(id_and_text(df, id_col, text_col), make, "id long, ids array<int>, starts array<int>, ends array<int>", 1_000_000).withColumnRenamed("id", id_col)


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): what the ids stand for; bytes that form no character become U+FFFD. A null list gives null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text_of(column):
        codec = codec_of(rank_path, pattern)
        return column.map(lambda ids: None if ids is None else codec.decode(ids).decode("utf-8", "replace"))

    return df.select(id_col, text_of(ids_col).alias("text"))


def round_trip(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, decodes the ids, and returns digests of both.

    (id_col, n_tokens, ids_sha256, decoded_sha256): the hex SHA-256 of the decimal ids joined
    by commas, and of the decoded bytes. Null texts count as empty (no ids, digests of
    nothing). One row per input row, repeated rows and null ids included; other columns are
    ignored; an empty table gives an empty result. It needs no shuffle.
    """

    def make():
        codec = codec_of(rank_path, pattern)

        def run(ids: list, texts: list) -> dict:
            n, of_ids, of_bytes = [], [], []
            for one in codec.encode(texts):
                n.append(len(one))
                of_ids.append(hashlib.sha256(",".join(map(codec.text.__getitem__, one)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(one)).hexdigest())
            return {"id": ids, "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_bytes}

        return run

    return map_texts(id_and_text(df, id_col, text_col), make, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 1_000_000).withColumnRenamed("id", id_col)
