"""Removal of passages that an earlier document holds too, exact to the word.

A passage is repeated where MIN_WORDS words in a row also stand in a document with a smaller id. Each
run of MIN_WORDS words (a window) is named by the least digest of the shorter phrases inside it, so equal
windows have equal names wherever they stand, and a document has few different names. Names are counted
over all documents first; then only windows whose name several documents share are told apart by
digests of their own. Digests go to buckets in packed arrays of each batch of documents, and a bucket
answers which documents share them or are not the first (by smallest id) to hold them. What windows of
an earlier document cover is cut out. Where a script has no spaces or words are very long, characters
stand for words and a window is MIN_WORDS mean words of bytes. The first document keeps its copy, and repeats inside one stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm import shingles
from spanframe.llm.common import KeyFilter, batch, dropped, fresh, map_arrow, stored, table

MIN_WORDS = 25
#: Weight of a word, its mean bytes; longer words than LONG bytes are taken by their characters.
WORD, LONG = 6, 40
BUCKET_DIGESTS = 250_000
_NULL_ID = -(1 << 63)
_ITEM = np.dtype([("digest", "<u8"), ("id", "<i8")])
_FOUND = np.dtype([("id", "<i8"), ("digest", "<u8")])


def _edges(start: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(start)
    stop = start | space
    stops = np.append(np.flatnonzero(stop), len(start))
    return starts, stops[np.searchsorted(stops, starts, "right")]


def units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, weights) of the units of UTF-8 bytes: words between white space, each of weight WORD.

    Letters of scripts written without spaces, and the characters of words of more than LONG bytes, are
    units of their own and weigh their bytes. What a unit is depends on the text at its place only.
    """
    space = shingles._IS_SPACE[raw]
    start = ~space
    start[1:] &= space[:-1]
    alone = np.zeros(len(raw), bool)
    if raw.max(initial=0) >= 0xE0:
        second = np.append(raw[1:], 0)
        # Thai, Lao; Myanmar, Khmer; kana and ideographs; ideographs of the second and third plane.
        own = (raw == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (raw == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second >= 0x9E) & (second <= 0x9F)) | (raw >= 0xE3) & (raw <= 0xE9) | (raw == 0xF0) & (second >= 0xA0) & (second <= 0xBF)
        if own.any():
            char = raw & 0xC0 != 0x80
            after = own[np.maximum.accumulate(np.where(char, np.arange(len(raw)), 0))]
            start |= own
            start[1:] |= after[:-1] & char[1:] & ~space[1:]
            alone |= own
    starts, ends = _edges(start, space)
    far = ends - starts > LONG
    if far.any():
        turn = np.zeros(len(raw) + 1, np.int8)
        turn[starts[far]] += 1
        turn[ends[far]] -= 1
        inside = (np.cumsum(turn[:-1]) > 0) & (raw & 0xC0 != 0x80)
        start |= inside
        alone |= inside
        starts, ends = _edges(start, space)
    return starts, ends, np.where(alone[starts], ends - starts, WORD)


def _prefix(values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * shingles._grow(len(values))[0][: len(values)], out=total[1:])
    return total


def _phrases(total: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Digests of the values from first to before last, from their prefix sums."""
    return shingles.mix((total[last] - total[first]) * shingles._grow(len(total))[1][first] + (last - first).astype(np.uint64))


def windows(data: bytes, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of units that weigh min_words words: its byte span (to the next unit's start), its digest and its name."""
    none = np.zeros(0, np.int64)
    if not data:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    raw = np.frombuffer(data, np.uint8)
    starts, ends, weights = units(raw)
    weight = np.append(0, np.cumsum(weights))
    # Units after the last of the run, and of the phrase, that begin at each; n runs fit.
    last = np.searchsorted(weight, weight[:-1] + min_words * WORD)
    n = int(np.searchsorted(last, len(starts), "right"))
    if n < 1:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    total = _prefix(_phrases(_prefix(shingles._VALUE[raw]), starts, ends))
    last, first = last[:n], np.arange(n)
    end = np.searchsorted(weight, weight[:-1] + (min_words + 1) // 2 * WORD)
    inner = int(np.searchsorted(end, len(starts), "right"))
    names = _phrases(total, np.arange(inner), end[:inner])
    # The phrases from a run's first to the last that ends in it.
    pairs = np.column_stack((first, np.searchsorted(end[:inner], last, "right"))).ravel()
    names = np.minimum.reduceat(np.append(names, ~np.uint64(0)), pairs)[::2]
    return starts[:n], np.append(starts, len(raw))[last], _phrases(total, first, last), names


def _among(values: np.ndarray, flagged: np.ndarray) -> np.ndarray:
    """Which values the sorted array flagged holds."""
    if not len(flagged):
        return np.zeros(len(values), bool)
    return flagged[np.minimum(np.searchsorted(flagged, values), len(flagged) - 1)] == values


def repeats(data: bytes, flagged: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Byte spans that windows with flagged digests (sorted) cover."""
    first, last, own, _ = windows(data, min_words)
    hit = _among(own, flagged)
    first, last = first[hit], last[hit]
    if not len(first):
        return []
    turn = np.flatnonzero(first[1:] > last[:-1]) + 1
    return list(zip(first[np.append(0, turn)].tolist(), last[np.append(turn - 1, len(last) - 1)].tolist(), strict=True))


def _flagged(parts) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(parts or []), "<u8"))


def _names(min_words: int):
    return lambda b: [np.unique(windows((t or "").encode(), min_words)[3]) for t in b.column(1).to_pylist()]


def _shared(min_words: int):
    """The digests of the windows whose names (third column) several documents share."""

    def sets(b):
        out = []
        for t, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            _, _, own, names = windows((t or "").encode() if parts else b"", min_words)
            out.append(np.unique(own[_among(names, _flagged(parts))]))
        return out

    return sets


def _parts(bits: int, digests):
    def run(batches):
        fresh()
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 24
        for b in batches:
            ids = b.column(0).to_numpy()
            sets = digests(b)
            item = np.zeros(sum(map(len, sets)), _ITEM)
            rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            item["digest"], item["id"] = np.concatenate(sets) if sets else [], ids[rows]
            item = item[np.argsort(item["digest"], kind="stable")]
            bucket = (item["digest"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(item), np.int64)
            turn = np.flatnonzero(np.diff(bucket)) + 1
            first = np.concatenate(([0], turn)).astype(int) if len(bucket) else []
            last = np.concatenate((turn, [len(bucket)])).astype(int)
            # Columns one after the other: what ids share compresses.
            data = [b"".join(np.ascontiguousarray(item[c][s:e]).tobytes() for c in _ITEM.names) for s, e in zip(first, last, strict=False)]
            if data:
                yield batch({"bucket": pa.array([int(bucket[s]) for s in first], pa.int64()), "block": pa.array([block] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})
            block += 1

    return run


def _items(data: bytes) -> np.ndarray:
    n = len(data) // _ITEM.itemsize
    out, at = np.zeros(n, _ITEM), 0
    for c in _ITEM.names:
        kind = _ITEM[c]
        out[c] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return out


def _held(t: pa.Table, every: bool) -> pa.Table:
    """One bucket: per block, the (id, digest) of which a document with a smaller id (every: any other) holds a copy."""
    fresh()
    parts = [_items(x) for x in t["data"].to_pylist()]
    own = np.zeros(sum(map(len, parts)), [("digest", "<u8"), ("id", "<i8"), ("block", "<i8")])
    own["digest"], own["id"] = (np.concatenate([x[c] for x in parts]) for c in ("digest", "id"))
    own["block"] = np.repeat(t["block"].to_numpy(), [len(x) for x in parts])
    own = own[np.lexsort((own["id"], own["digest"]))]
    new = np.concatenate(([True], own["digest"][1:] != own["digest"][:-1]))
    group = np.cumsum(new) - 1
    least, most = own["id"][new][group], own["id"][np.append(new[1:], True)][group]
    own = own[(own["id"] > least) | (every & (most > least))]
    own = own[np.argsort(own["block"], kind="stable")]
    turn = np.flatnonzero(np.diff(own["block"])) + 1
    first = np.concatenate(([0], turn)).astype(int) if len(own) else []
    last = np.concatenate((turn, [len(own)])).astype(int)
    pairs = list(zip(first, last, strict=False))
    return pa.table({"block": pa.array([int(own["block"][s]) for s, _ in pairs], pa.int64()), "data": pa.array([own[["id", "digest"]][s:e].astype(_FOUND).tobytes() for s, e in pairs], pa.binary())})


def _later(t: pa.Table) -> pa.Table:
    return _held(t, False)


def _several(t: pa.Table) -> pa.Table:
    return _held(t, True)


def _by_id(t: pa.Table) -> pa.Table:
    """One block: the repeated digests of each of its documents."""
    own = np.concatenate([np.frombuffer(x, _FOUND) for x in t["data"].to_pylist()])
    own = own[np.argsort(own["id"], kind="stable")]
    turn = np.flatnonzero(np.diff(own["id"])) + 1
    pairs = list(zip([0, *turn], [*turn, len(own)], strict=True))
    return pa.table({"key": pa.array([int(own["id"][s]) for s, _ in pairs], pa.int64()), "digests": pa.array([own["digest"][s:e].tobytes() for s, e in pairs], pa.binary())})


def _asked(rows: DataFrame, digests, n: int, answer) -> DataFrame:
    """(key, parts array<binary>): the digests of each document that answer keeps, of about n; rows: key, text, ..."""
    bits = min(22, max(0, (n // BUCKET_DIGESTS).bit_length()))
    parts = map_arrow(rows, _parts(bits, digests), "bucket long, block long, data binary")
    found = parts.groupBy("bucket").applyInArrow(answer, "block long, data binary")
    by_id = found.groupBy("block").applyInArrow(_by_id, "key long, digests binary")
    return by_id.groupBy("key").agg(F.collect_list("digests").alias("parts"))


def repeated_digests(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, parts array<binary>), stored: the window digests of each document that an earlier one holds; rows: key, text.

    Only texts that may share a name, by a filter of their keys, travel to meet their names.
    """
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    names = stored(_asked(rows, _names(min_words), chars // 40, _several), "names")
    shared = names.agg(F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p)))).first()[0] or 0
    may = KeyFilter(names, "key")
    some = map_arrow(rows.select("key", "text", may.slot(F.col("key")).alias("slot")), _kept(may, True), "key long, text string")
    # A name stands for some min_words / 4 windows.
    out = stored(_asked(some.join(names, "key"), _shared(min_words), shared // 8 * (min_words // 4 + 1), _later), "repeats")
    dropped(names)
    return out


def _kept(may: KeyFilter, held: bool):
    """Rows, without their last column (slot), whose key the filter holds, or does not."""

    def run(batches):
        for b in batches:
            keep = b.filter(pa.array(may.holds(b.column(b.num_columns - 1)) == held))
            if keep.num_rows:
                yield pa.RecordBatch.from_arrays(keep.columns[:-1], names=keep.schema.names[:-1])

    return run


_SPANS = "array<struct<start:bigint,end:bigint>>"
_SPANS_TYPE = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))


def _cut(text: str | None, parts, min_words: int) -> tuple[str | None, list[dict]]:
    """A text without the windows whose digests are among parts, and where these stood."""
    found = repeats(text.encode(), _flagged(parts), min_words) if text and parts else []
    if not found:
        return text, []
    data, kept, at, chars, marks = text.encode(), [], 0, 0, []
    for s, e in found:
        piece, gone = data[at:s].decode(), data[s:e].decode()
        kept.append(piece)
        marks.append({"start": chars + len(piece), "end": chars + len(piece) + len(gone)})
        chars, at = marks[-1]["end"], e
    return "".join(kept) + data[at:].decode(), marks


def remove_repeats(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's columns, text_col without the repeated passages, then `spans` (array of struct start, end).

    Spans are code points of the text before. A null text stays null and holds nothing; rows that share
    an id count as one document, and null ids as one that comes first. Texts may become empty; an empty table
    stays empty. A column of df named `spans` is refused. Documents that hold no repeat are not shuffled.
    """
    names = df.columns
    if "spans" in names:
        raise ValueError("a column named spans is in the way of the result's")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    flags = repeated_digests(df.select(key.alias("key"), F.col(text_col).alias("text")), min_words)
    may = KeyFilter(flags, "key")
    # The columns by number, so that none of df's names clash with ours.
    rows = df.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)), key.alias("key")).withColumn("slot", may.slot(F.col("key")))
    kinds = [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]
    numbered = ", ".join(f"c{i} {df.schema[n].dataType.simpleString()}" for i, n in enumerate(names))
    place = names.index(text_col)

    def whole(batches):
        for b in _kept(may, False)(batches):
            yield batch({n: b.column(i) for i, n in enumerate(names)} | {"spans": pa.array([[]] * b.num_rows, _SPANS_TYPE)})

    def cut(batches):
        for b in batches:
            pairs = [_cut(t, p, min_words) for t, p in zip(b.column(place).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
            columns = {n: b.column(i) for i, n in enumerate(names)} | {names[place]: pa.array([t for t, _ in pairs], pa.string())}
            yield batch(columns | {"spans": pa.array([s for _, s in pairs], _SPANS_TYPE)})

    schema = f"{', '.join(kinds)}, spans {_SPANS}"
    some = map_arrow(rows, _kept(may, True), f"{numbered}, key long")
    met = some.join(flags, "key", "left").select(*(f"c{i}" for i in range(len(names))), "parts")
    return map_arrow(rows, whole, schema).unionAll(map_arrow(met, cut, schema))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, text without what an earlier document holds, n_chars before, n_removed, n_spans; nulls, repeated
    ids and empty tables as remove_repeats() says."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "text", (F.coalesce(F.length("text"), F.lit(0)) + removed).alias("n_chars"), removed.alias("n_removed"), F.size("spans").alias("n_spans"))
