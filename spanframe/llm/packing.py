"""Packing token sequences by linear grouping, then best fit.

The driver sees one histogram, at most `capacity` lengths with their counts, and plans on it:

1. whole pieces of `capacity` tokens are sequences by themselves;
2. lengths over `capacity // SMALL` are sorted and cut into groups of equal cardinality, each length
   rounded up to its group's largest; over these few sizes configurations are chosen one after the
   other: the largest size left with the subset of the others that fills it best (a bounded knapsack),
   taken as often as the counts allow;
3. each slot of a configuration takes actual pieces of its group, largest first;
4. shorter pieces go, longest first, where they leave the least room; new sequences open last.

Several group counts are tried and the plan with the fewest sequences is kept. A plan is a list of
placements (length, first rank, sequence, pieces of that length in each sequence, offset); it has a
few thousand entries at most, whatever the number of pieces. Executors rank the pieces of a length
(hot lengths salted, then counts added up) and look their placement up.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.chunks import ChunkEncoder
from spanframe.llm.common import batch, map_arrow, per_worker, stored, table, texts, vocabulary

SMALL = 8
GROUPS = (24, 48, 96, 192)
#: Pieces of one length that one task ranks.
RANKED_AT_ONCE = 50_000


class ByteLevelEncoder:
    """Ids of a byte-level .json tokenizer; its merges run in the rank engine, special strings in its own."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        from spanframe.llm.byte_bpe import byte_characters

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocab.items()}
        self.engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = ChunkEncoder(self._encode)

    def _encode(self, strings: list[str]) -> list[bytes]:
        special, fast = self.special, self.engine.encode_ordinary
        return [array("I", self.own.encode(s, add_special_tokens=False).ids if any(x in s for x in special) else fast(s)).tobytes() for s in strings]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what whole pieces leave."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, first rank, first sequence, per sequence, offset) and the number of sequences."""
    plans = [_plan(histogram, capacity, k) for k in GROUPS]
    return min(plans, key=lambda p: p[1])


def _plan(histogram: dict[int, int], capacity: int, k: int):
    placed: list[tuple[int, int, int, int, int]] = []
    nxt = histogram.get(capacity, 0)
    if nxt:
        placed.append((capacity, 0, 0, 1, 0))
    taken: dict[int, int] = defaultdict(int)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of (first sequence, count)
    large = sorted((x for x in histogram if capacity // SMALL < x < capacity), reverse=True)
    sizes, members = _groups(large, histogram, k)
    left = [sum(n for _, n in m) for m in members]
    for slots in iter(lambda: _configuration(sizes, left, capacity), None):
        times = min(left[g] // slots.count(g) for g in set(slots))
        # One run for each slot and stretch of equal actual lengths.
        runs = [(nxt, times, 0)]  # first sequence, count, used
        for g in slots:
            left[g] -= times
            cuts = []
            for first, count, used in runs:
                while count:
                    length, n = members[g][0]
                    m = min(n, count)
                    placed.append((length, taken[length], first, 1, used))
                    taken[length] += m
                    members[g][0] = (length, n - m)
                    if n == m:
                        members[g].pop(0)
                    cuts.append((first, m, used + length))
                    first, count = first + m, count - m
            runs = cuts
        nxt += times
        for first, count, used in runs:
            if used < capacity:
                room[capacity - used].append((first, count))
    open_rooms = sorted(room)
    for length in sorted((x for x in histogram if x <= capacity // SMALL), reverse=True):
        nxt = _best_fit(length, histogram[length], room, open_rooms, placed, nxt, capacity)
    return placed, nxt


def _groups(lengths: list[int], histogram: dict[int, int], k: int):
    """Groups of equal cardinality over lengths in falling order: rounded-up sizes and members."""
    total = sum(histogram[x] for x in lengths)
    target = max(1, math.ceil(total / k))
    sizes: list[int] = []
    members: list[list[tuple[int, int]]] = []
    space = 0
    for x in lengths:
        n = histogram[x]
        while n:
            if not space:
                sizes.append(x)
                members.append([])
                space = target
            m = min(n, space)
            members[-1].append((x, m))
            n, space = n - m, space - m
    return sizes, members


def _configuration(sizes: list[int], left: list[int], capacity: int):
    """The largest size left and the others that fill its sequence best, as group numbers; None when none is left."""
    first = next((g for g, n in enumerate(left) if n), None)
    if first is None:
        return None
    space = capacity - sizes[first]
    reach = np.full(space + 1, -1, np.int32)  # the group that first reached a fill
    reach[0] = len(sizes)
    for g in range(first, len(sizes)):
        for _ in range(min(left[g] - (g == first), space // sizes[g])):
            new = np.flatnonzero((reach[sizes[g] :] < 0) & (reach[: space + 1 - sizes[g]] >= 0)) + sizes[g]
            if not len(new):
                break
            reach[new] = g
    fill = int(np.flatnonzero(reach >= 0)[-1])
    slots = [first]
    while fill:
        slots.append(int(reach[fill]))
        fill -= sizes[slots[-1]]
    counts = {g: slots.count(g) for g in slots}
    return slots if all(left[g] >= n for g, n in counts.items()) else [first]


def _best_fit(length, count, room, open_rooms, placed, nxt, capacity):
    from bisect import bisect_left, insort

    rank = 0

    def keep(space, first, n):
        if space and n:
            if not room[space]:
                insort(open_rooms, space)
            room[space].append((first, n))

    while count:
        at = bisect_left(open_rooms, length)
        if at == len(open_rooms):
            per = capacity // length
            first, n, space = nxt, -(-count // per), capacity
            nxt += n
        else:
            space = open_rooms[at]
            first, n = room[space].pop()
            if not room[space]:
                open_rooms.pop(at)
            per = space // length
        whole = min(n, count // per)
        used = capacity - space
        if whole:
            placed.append((length, rank, first, per, used))
            rank, count = rank + whole * per, count - whole * per
            keep(space - per * length, first, whole)
        if whole < n:
            if count and count < per:
                placed.append((length, rank, first + whole, count, used))
                keep(space - count * length, first + whole, 1)
                rank, count, whole = rank + count, 0, whole + 1
            keep(space, first + whole, n - whole)
    return nxt


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids binary if asked).

    A null text is empty (one end id). Repeated rows and ids are packed each; ties of a length are
    ranked by id and piece, which moves no boundary. An empty table gives an empty result.
    """
    path = vocabulary(tokenizer)
    end = array("I", [end_id]).tobytes()

    def pieces(batches):
        encode = per_worker("byte-level", path, lambda: ByteLevelEncoder(path)).encode
        for b in batches:
            for k in range(0, b.num_rows, 200):
                some = b.slice(k, 200)
                ids = [i + end for i in encode(texts(some.column(1)))]
                parts = [(row, p, s, n) for row, i in enumerate(ids) for p, (s, n) in enumerate(cut(len(i) // 4, capacity))]
                row, piece, start, length = (np.array(x, np.int64) for x in zip(*parts, strict=True))
                cuts = [ids[r][4 * s : 4 * (s + n)] for r, _, s, n in parts]
                out = {id_col: some.column(0).take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64())}
                yield batch(out | ({"ids": pa.array(cuts, pa.binary())} if keep_ids else {}))

    kind = df.schema[id_col].dataType.simpleString()
    columns = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    rows = stored(map_arrow(df.select(id_col, text_col), pieces, columns), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    placed, _ = plan(histogram, capacity)
    salts = max(1, -(-max(histogram.values(), default=1) // RANKED_AT_ONCE))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32")) - 1)
    sizes = salted.groupBy("length", "_salt").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).drop("count")
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")

    key = np.array([(p[0] << 44) + p[1] for p in placed], np.int64)
    order = np.argsort(key, kind="stable")
    key, where = key[order], np.array(placed, np.int64).reshape(-1, 5)[order]
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def place(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "_rank"))
            at = where[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            i = rank - at[:, 1]
            out = {n: b.column(n) for n in names}
            yield batch(out | {"sequence_id": pa.array(at[:, 2] + i // at[:, 3]), "offset": pa.array(at[:, 4] + i % at[:, 3] * length)})

    return map_arrow(ranked.select(*names, "_rank"), place, f"{columns}, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of each document: where it is cut and where it stands, as pack() says; a null text is empty, rows that share an id stay apart."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), "byte_bpe_50k.json")
