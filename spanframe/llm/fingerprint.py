"""Document fingerprints: the set of a text's chunk digests, each weighted by its chunk's length.

Chunks end at normalised gear-hash boundaries, so an insertion moves only the chunks around it.
A fingerprint is text: base64 of sorted (digest, length) pairs, the whole set. How much of a document
another one holds is the shared weight over the document's own (containment).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.cdc import boundaries
from spanframe.llm.common import batch, map_arrow, table

LEAST, NORMAL, MOST, STRICT_BITS, LOOSE_BITS = 12, 32, 128, 6, 3
#: Rows of one range of ids, and the most ranges; beyond, ranges grow (they are streamed, not held).
RANGE_ROWS, RANGES = 4_096, 16_384
_FIRST = -(1 << 63)
_PAIR = np.dtype([("digest", "<u8"), ("length", "<u2")])


def chunk_weights(text: str) -> dict[int, int]:
    """Digest -> length in bytes of a text's distinct chunks."""
    data = text.encode()
    out, at, digest = {}, 0, xxhash.xxh64_intdigest
    for end in boundaries(data, LEAST, NORMAL, MOST, STRICT_BITS, LOOSE_BITS):
        out[digest(data[at:end])] = end - at
        at = end
    return out


def to_string(weights: dict[int, int]) -> str:
    return base64.b64encode(np.array(sorted(weights.items()), _PAIR).tobytes()).decode()


def from_string(fingerprint: str) -> dict[int, int]:
    pairs = np.frombuffer(base64.b64decode(fingerprint), _PAIR)
    return dict(zip(pairs["digest"].tolist(), pairs["length"].tolist(), strict=True))


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    """Share of own's weight that other holds; two empty sets are alike, an empty one is like no other."""
    if not own or not other:
        return float(own == other)
    return sum(n for d, n in own.items() if d in other) / sum(own.values())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id and fingerprint; a null or empty text has the empty string."""

    def run(batches):
        for b in batches:
            yield batch({id_col: b.column(0), "fingerprint": pa.array([to_string(chunk_weights(t or "")) for t in b.column(1).to_pylist()], pa.string())})

    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fingerprint string")


def with_next(df: DataFrame, out_schema: str, made, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """made(ids, texts, next texts) -> columns, the next row being that of the next id; after the last, the first.

    Ids are dealt to ranges whose bounds come from a small sample, each range goes to one task in sorted
    order, and the first rows of a range are copied to the range before it: one shuffle, and no task
    holds more than a batch. Equal ids are ordered by text; null ids come first.
    """
    keys = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = df.count()
    wanted = min(RANGES, -(-n // RANGE_ROWS))
    bounds = np.zeros(0, np.int64)
    if wanted > 1:
        share = min(1.0, 20 * wanted / n)
        sample = np.sort(keys.select("key").sample(share, seed=11).limit(40 * RANGES).toArrow()["key"].to_numpy())
        bounds = np.unique(sample[np.arange(1, wanted) * len(sample) // wanted]) if len(sample) else bounds

    def ranges(batches):
        for b in batches:
            yield batch({"part": pa.array(np.searchsorted(bounds, b.column(0).to_numpy(), "right")), "key": b.column(0)})

    firsts = map_arrow(keys.select("key"), ranges, "part long, key long").groupBy("part").agg(F.min("key").alias("key")).orderBy("part").toArrow()
    parts, first = firsts["part"].to_pylist(), firsts["key"].to_pylist()
    before = {k: parts[i - 1] for i, k in enumerate(first)}  # the range to copy that key's rows to
    first_keys = np.array(sorted(before), np.int64)

    def dealt(batches):
        for b in batches:
            key = b.column(0).to_numpy()
            part = np.searchsorted(bounds, key, "right")
            yield batch({"part": pa.array(part), "copy": pa.array(np.zeros(len(key), bool)), "key": b.column(0), "text": b.column(1)})
            at = np.flatnonzero(np.isin(key, first_keys))
            if len(at):
                yield batch({"part": pa.array([before[k] for k in key[at].tolist()], pa.int64()), "copy": pa.array(np.ones(len(at), bool)), "key": b.column(0).take(pa.array(at)), "text": b.column(1).take(pa.array(at))})

    rows = map_arrow(keys, dealt, "part long, copy boolean, key long, text string")
    # Each range is one partition: dealt by hash, several would meet in one.
    spread = rows.repartitionById(len(bounds) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "copy", "key", "text")

    def paired(batches):
        held = None
        for b in batches:
            ids, own, following = [], [], []
            for part, copy, key, text in zip(*(b.column(c).to_pylist() for c in ("part", "copy", "key", "text")), strict=True):
                if held and held[0] == part:
                    ids.append(held[1])
                    own.append(held[2])
                    following.append(text)
                held = None if copy else (part, key, text)
            if ids:
                yield batch({id_col: pa.array([None if i == _FIRST else i for i in ids], pa.int64()), **made(own, following)})

    return map_arrow(spread, paired, f"`{id_col}` long, {out_schema}")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint beside those of its edited text and of the next document, by with_next().

    A null text is empty; the fingerprint of an empty text is empty and is like no other but an empty one. An
    empty table gives no rows; of a single row it is its own next.
    """

    def made(own: list[str], following: list[str]) -> dict[str, pa.Array]:
        rows = []
        for text, after in zip(own, following, strict=True):
            new = edited(text, after)
            a, e, f = (chunk_weights(t) for t in (text, new, after))
            rows.append((len(text), hashlib.sha256(new.encode()).hexdigest(), to_string(a), to_string(e), containment(a, e), containment(a, f)))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        return {n: pa.array(x, k) for n, x, k in zip(names, zip(*rows, strict=True), kinds, strict=True)}

    schema = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(table(spark, sf_dir, "documents", "doc_id", "text"), schema, made)
