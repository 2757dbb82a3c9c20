"""Byte-level BPE through a sentencepiece BPE model that is serialised straight from a rank file.

Each byte stands for one printable character, so that a token's bytes become a piece; a piece's score
is its negative rank, which makes the model merge in rank order, and the normaliser is the identity.
Piece ids are the ranks. A pre-token that is itself a token is looked up whole, as the rank files'
own library does; every other one is merged by the model. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanframe.llm.chunks import ChunkEncoder
from spanframe.llm.common import batch, per_worker, table, texts, vocabulary

#: Marks that end a chunk as a pre-token of their own after letters.
_ENDS = frozenset(".,;:!?")


def byte_characters() -> list[str]:
    """A printable, non-space character for each byte: itself where it is one, else one from 256 up."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | str | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model file of a rank table; id = rank, the unknown piece comes last."""
    chars = byte_characters()
    size = max(ranks.values()) + 1
    pieces = [b""] * size
    for token, rank in ranks.items():
        pieces[rank] = _field(1, "".join(chars[b] for b in token)) + _field(2, float(-rank))
    out = [_field(1, p or _field(1, f" unused{i}") + _field(2, -1e9) + _field(3, 5)) for i, p in enumerate(pieces)]
    out.append(_field(1, _field(1, " unk") + _field(2, 0.0) + _field(3, 2)))
    trainer = [(3, 2), (4, size + 1), (40, size), (41, -1), (42, -1), (43, -1), (45, " unk")]  # BPE, sizes, special ids
    normaliser = [(1, "identity"), (2, b""), (3, 0), (4, 0), (5, 0)]
    out.append(_field(2, b"".join(_field(k, v) for k, v in trainer)))
    out.append(_field(3, b"".join(_field(k, v) for k, v in normaliser)))
    return b"".join(out)


class ByteBpe:
    """encode(texts) -> id bytes, decode(id bytes) -> text bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.chars = dict(enumerate(byte_characters()))
        self.whole = {k.decode(): struct.pack("<I", v) for k, v in self.ranks.items() if _is_text(k)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.encode = ChunkEncoder(self._encode)

    def _encode(self, strings: list[str]) -> list[bytes]:
        """Ids of each string's pre-tokens, the merges of all strings in one call."""
        whole, split = self.whole, self.split
        pre = [(s,) if s[1:].isalpha() and s[0] == " " else (s[:-1], s[-1]) if s[-1:] in _ENDS and s[1:-1].isalpha() and s[0] == " " else split(s) for s in strings]
        merge = list({p for some in pre for p in some if p not in whole})
        if merge:
            ids = self.model.encode(self._mapped(merge), num_threads=1)
            merged = dict(zip(merge, [array("I", x).tobytes() for x in ids], strict=True))
        else:
            merged = {}
        return [b"".join([whole[p] if p in whole else merged[p] for p in some]) for some in pre]

    def _mapped(self, pieces: list[str]) -> list[str]:
        """Each piece's bytes as the model's characters; all at once where no piece holds the separator."""
        joined = "\0".join(pieces)
        if joined.count("\0") == len(pieces) - 1:
            return joined.encode().decode("latin-1").translate(self.chars).split(self.chars[0])
        return [p.encode().decode("latin-1").translate(self.chars) for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def worker_bpe(path: str) -> ByteBpe:
    return per_worker("byte-bpe", path, lambda: ByteBpe(path))


def encode_texts(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids binary (little-endian unsigned 32-bit) and n_tokens; null text is empty."""
    return _mapped(df, ranks, id_col, text_col, "n_tokens long, ids binary", lambda bpe, text: {"n_tokens": pa.array([len(i) // 4 for i in text], pa.int64()), "ids": pa.array(text, pa.binary())})


def decode_ids(df: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The inverse: id and text binary."""
    path = vocabulary(ranks)

    def run(batches):
        bpe = worker_bpe(path)
        for b in batches:
            yield batch({id_col: b.column(0), "text": pa.array([bpe.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())})

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text binary")


def round_trip_digests(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass and returns digests of both: id, n_tokens, ids_sha256, decoded_sha256.

    Repeated rows stay apart; a null text has no tokens, and a null id stays null.
    """

    def digests(bpe: ByteBpe, ids: list[bytes]) -> dict[str, pa.Array]:
        return {
            "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]),
        }

    return _mapped(df, ranks, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(df: DataFrame, ranks: str, id_col: str, text_col: str, columns: str, made) -> DataFrame:
    path = vocabulary(ranks)

    def run(batches):
        bpe = worker_bpe(path)
        for b in batches:
            step = 200
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                yield batch({id_col: part.column(0), **made(bpe, bpe.encode(texts(part.column(1))))})

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {columns}")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens and the digests of ids and of the decoded bytes; a null text is empty, rows that share an id stay apart."""
    return round_trip_digests(table(spark, sf_dir, "documents", "doc_id", "text"), "byte_bpe_multi_50k.tiktoken")
