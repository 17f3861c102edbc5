"""Encoding of a corpus with a byte-level BPE vocabulary, by a sentencepiece model.

The vocabulary (ranks of byte strings) is written directly as a sentencepiece
BPE model: each piece is its byte string with every byte mapped to one printable
character, its score the negative rank, so that the best merge is the lowest
rank; normalisation is the identity. Texts are split by the vocabulary's pattern
and each pre-token is encoded; decoding maps the characters back to bytes.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of every function that reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens that one Python worker remembers.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it prints, else one from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in prints:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def read_vocabulary(path: str) -> list[bytes]:
    """Byte strings in order of rank; the ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranked = {int(n): base64.b64decode(b) for b, n in pairs}
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto with one piece per vocabulary entry and <unk> after them."""
    chars = byte_characters()
    out = bytearray()
    for rank, piece in enumerate(vocabulary):
        text = "".join(chars[b] for b in piece).encode()
        out += _field(1, _field(1, text) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(vocabulary)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n)  # BPE; vocab_size; unk_id
    none = (1 << 64) - 1
    trainer += _field(41, none) + _field(42, none) + _field(43, none)  # no bos, eos, pad
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, blanks kept, not escaped
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Encoder:
    """Text to ids and back."""

    def __init__(self, path: str = VOCABULARY):
        import regex
        import sentencepiece

        vocabulary = read_vocabulary(path)
        self._processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(vocabulary))
        self._vocabulary = vocabulary
        self._split = regex.compile(PATTERN).findall
        self._map = {b: ord(c) for b, c in enumerate(byte_characters())}
        self._seen: dict[str, list[int]] = {}

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        seen = self._seen
        if len(seen) > REMEMBERED:
            seen.clear()
        split = [self._split(t) if t else [] for t in texts]
        new = list({p for pre in split for p in pre if p not in seen})
        if new:
            mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._map) for p in new]
            seen.update(zip(new, self._processor.encode(mapped, num_threads=1)))
        return [[i for p in pre for i in seen[p]] for pre in split]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self._vocabulary[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary; reads the file that ``given`` sent along."""
    sent = SparkFiles.get(os.path.basename(path))
    return Encoder(sent if os.path.exists(sent) else path)


def given(spark: SparkSession, path: str) -> str:
    """Send the vocabulary of the driver to every executor, so that only the driver needs the path."""
    spark.sparkContext.addFile(path)
    return path


def encode_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids), row for row, without special tokens.

    Null and empty texts give an empty list, a blank text its own ids; strings
    that look like special tokens are ordinary text.
    """

    path = given(documents.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": e.encode_all([t if isinstance(t, str) else None for t in b["text"]])})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); the inverse of encoding for valid text."""

    path = given(encoded.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [e.decode(list(i)) if i is not None else None for i in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Documents and tokens per source."""
    n = encode_documents(documents.select("doc_id", "text"), path).select("doc_id", F.size("ids").cast("long").alias("n"))
    by_doc = documents.select("doc_id", "source").distinct().join(n.distinct(), "doc_id")
    return by_doc.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))
