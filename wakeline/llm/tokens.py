"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

The vocabulary file (ranks of byte strings) is turned into a sentencepiece BPE
model without any training: every byte is mapped to a printable character, every
token becomes a piece scored by its negative rank, normalisation is the identity.
Texts are cut into pre-tokens by the vocabulary's pattern; each distinct
pre-token of a task is encoded once by the model.  Decoding maps pieces back to
bytes.  Null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_BYTES = 64 << 20  # a vocabulary is sent to every executor: its size is checked
CACHE_WORDS = 200_000

# The published pre-token pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern for texts of ASCII characters only, where the classes are plain ranges.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
UNKNOWN = "⁇"  # stands for no byte, so it is never met


def byte_letters() -> str:
    """The printable character of each byte: itself where printable, else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return "".join(out)


LETTERS = byte_letters()
TO_LETTERS = {b: LETTERS[b] for b in range(256)}
TO_BYTE = {c: b for b, c in enumerate(LETTERS)}


def lettered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(TO_LETTERS)


def read_ranks(path: str = DEFAULT_PATH) -> list[bytes]:
    """Tokens in order of rank."""
    if Path(path).stat().st_size > MOST_BYTES:
        raise ValueError(f"{path} is no vocabulary: larger than {MOST_BYTES} bytes")
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def field(number: int, value: int | bytes | float) -> bytes:
    """One protobuf field: varint, length-delimited or 32-bit float."""
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3) + varint(value)


def serialise(ranks: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; one unknown piece stands at the end."""
    pieces = []
    for rank, token in enumerate(ranks):
        piece = "".join(LETTERS[b] for b in token).encode()
        pieces.append(field(1, field(1, piece) + field(2, float(-rank))))
    pieces.append(field(1, field(1, UNKNOWN.encode()) + field(2, float(-len(ranks))) + field(3, 2)))
    none = varint((1 << 64) - 1)  # -1: no such piece
    trainer = field(3, 2) + field(4, len(ranks) + 1) + field(40, len(ranks)) + b"".join(varint(n << 3) + none for n in (41, 42, 43)) + field(45, UNKNOWN.encode())
    normalizer = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(pieces) + field(2, trainer) + field(3, normalizer)


class Encoder:
    """Encoding and decoding with a serialised model; holds a bounded cache of pre-tokens."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.words: dict[str, list[int]] = {}
        self.ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.any = regex.compile(PATTERN).findall

    def pre_tokens(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.any(text)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts."""
        cut = [self.pre_tokens(t) if t else [] for t in texts]
        words = self.words
        if len(words) > CACHE_WORDS:
            words.clear()
        new = list(set(chain.from_iterable(cut)).difference(words))
        if new:
            words.update(zip(new, self.model.encode([lettered(w) for w in new], num_threads=1)))
        look = words.__getitem__
        ids = [list(chain.from_iterable(map(look, c))) for c in cut]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return offsets, np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[1].tolist()

    def decode(self, ids: list[int]) -> str:
        letters = "".join(self.model.id_to_piece(list(ids))) if len(ids) else ""
        return bytes(TO_BYTE[c] for c in letters).decode("utf-8", "replace")


def encode_corpus(df: DataFrame, text: str = "text", key: str = "doc_id", path: str = DEFAULT_PATH) -> DataFrame:
    """(key, ids): token ids of every row's whole text, without special tokens.

    Map-only.  Null and empty texts give an empty list, blanks are ordinary text;
    rows with a null key are kept; strings that look like special tokens are
    ordinary text; repeated rows come out as often as they go in.  Empty in,
    empty out; extra columns are dropped.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(serialise(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                offsets, ids = enc.encode_batch(part[1].to_pylist())
                yield pa.record_batch({key: part[0], "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
