"""Alignment of two tokenizers' tokens by a dangling-suffix transducer, with corpus-wide counts of linked ids.

Both tokenizers cut the same bytes. The transducer reads their tokens in turn and keeps which side leads
and the bytes by which it does: the next token of the side that lags either uses up some of these bytes or
passes them and leads by what is left of it. Transitions are remembered by (bytes left, next token). Where no
bytes are left both sides end a token at one place, and a group closes.

Neither tokenizer joins anything over a single space between two other characters, so a text is aligned
piece by piece between such spaces, and pieces seen before are looked up in the worker. A group's
links are counted from its distinct ids and their numbers, never pair by pair.

How many documents hold a pair linked is counted in two steps. A block (an Arrow batch) of documents keeps its
documents' pairs as places in the sorted list of its distinct pairs and sends each distinct pair once,
with its number of documents. Sums over blocks give the counts; each id's highest is a maximum over at
most as many pairs as the other side has ids; the counts return to the blocks, once each.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.byte_bpe import ByteBpe
from spanframe.llm.common import batch, bounded, dropped, map_arrow, per_worker, stored, table, vocabulary

#: Pieces and transitions that a worker remembers; longer pieces are aligned each time.
PIECES, TRANSITIONS, LONG_PIECE = 200_000, 200_000, 100
#: Links of a group that are listed one by one; those of a larger one are counted by distinct ids.
FEW = 16
#: Characters of the texts whose pieces are looked up together.
RUN_CHARS = 1_000_000
SPACE_MARK = "▁"

_RUN = re.compile(r"\s\s")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def pieces_of(text: str) -> list[str]:
    """text cut at the single spaces that have no white space on either side; these go."""
    if text[:1].isspace() or text[-1:].isspace() or _RUN.search(text):
        return _BETWEEN.split(text)
    return text.split(" ")


def piece_bytes(model) -> list[bytes]:
    """What each id of a sentencepiece model stands for: its piece with marks as spaces, or one byte."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in range(model.vocab_size())]


class Transducer:
    """Reads two sides' ids in turn. A state is which side leads and by what bytes; state 0 is neither, and A reads.

    States with A in the lead have positive numbers, with B negative ones. Transitions are remembered by
    state and the next id of the side that lags.
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes_of = (a_bytes, b_bytes)
        self.span = max(len(a_bytes), len(b_bytes))
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple[int, bytes], int] = {(0, b""): 0, (1, b""): 0}
        self.left: dict[int, bytes] = {0: b""}
        self.steps: dict[int, int | None] = {}

    def state(self, lead: int, left: bytes) -> int:
        key = (lead, left)
        if key not in self.number:
            n = len(self.number) if not lead else -len(self.number)
            self.number[key], self.left[n] = n, left
        return self.number[key]

    def step(self, state: int, token: int) -> int | None:
        """The state after the side that lags reads a token; None where its bytes differ from those left."""
        reads = int(state > 0)
        left, read = self.left[state], self.bytes_of[reads][token]
        after = self.state(1 - reads, left[len(read) :]) if left.startswith(read) else self.state(reads, read[len(left) :]) if read.startswith(left) else None
        self.steps[state * self.span + token] = after
        return after

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The groups of two sides' ids, or None where the bytes of the sides differ."""
        if len(self.steps) > TRANSITIONS or len(self.number) > TRANSITIONS:
            self.clear()
        known, span, out = self.steps.get, self.span, []
        i = j = i0 = j0 = state = 0
        n, m = len(a), len(b)
        while i < n or j < m:
            if state > 0:
                if j == m:
                    return None
                token = b[j]
                j += 1
            else:
                if i == n:
                    return None
                token = a[i]
                i += 1
            key = state * span + token
            state = known(key)
            if state is None:
                state = self.step(key // span, token)
                if state is None:
                    return None
            if not state:
                out.append((a[i0:i], b[j0:j]))
                i0, j0 = i, j
        return None if state else out


def links(groups) -> Counter:
    """(a id, b id) -> linked occurrence pairs."""
    out = Counter()
    for a, b in groups:
        own = Counter(b)
        for x, n in Counter(a).items():
            for y, m in own.items():
                out[x, y] += n * m
    return out


class Aligner:
    """What is known of pieces: place in the columns n_a, n_b, n_groups, n_links, text and, from offset, pair and times."""

    def __init__(self, ranks: str, model: str):
        import sentencepiece

        self.a = ByteBpe(ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size_b = self.b.vocab_size()
        of_b = piece_bytes(self.b)
        self.by = Transducer(self.a.bytes_of, of_b)
        # Of each of A's ids: one of B's with the same bytes, or -1; and how a group of one token begins and ends.
        same = {x: i for i, x in enumerate(of_b)}
        self.twin = [same.get(x, -1) for x in self.a.bytes_of]
        self.name_a, self.name_b = [f"{i}|" for i in range(len(self.a.bytes_of))], [str(i) for i in range(len(of_b))]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.columns = tuple(array("q") for _ in range(4))
        self.text: list[str | None] = []
        self.offset, self.pair, self.times = array("q", [0]), array("q"), array("q")

    def learn(self, pieces: set[str]) -> None:
        """Aligns the pieces not known yet, each after a space; those whose bytes differ get no text."""
        new = [p for p in pieces if p not in self.place]
        if len(self.place) + len(new) > PIECES:
            self.clear()
            new = list(pieces)
        if not new:
            return
        sides = zip(self.a._encode([" " + p for p in new]), self.b.encode(new, num_threads=1), strict=True)
        place, text, size, twin, name_a, name_b = self.place, self.text, self.size_b, self.twin, self.name_a, self.name_b
        counts, offset, pairs, others, base = ([], [], [], []), [], [], [], len(self.pair)
        n_a, n_b, n_groups, n_links = counts
        for piece, (ids, b) in zip(new, sides, strict=True):
            a = array("I", ids).tolist()
            n, m, k, start, parts = len(a), len(b), 0, len(pairs), []
            # While both sides' tokens are the same bytes, each two are a group.
            while k < n and k < m and twin[a[k]] == b[k]:
                parts.append(name_a[a[k]] + name_b[b[k]])
                pairs.append(a[k] * size + b[k])
                k += 1
            groups = None if SPACE_MARK in piece else self.by.groups(a[k:], b[k:]) if k < n or k < m else ()
            place[piece] = len(text)
            n_a.append(n)
            n_b.append(m)
            if groups is None:
                del pairs[start:]
                text.append(None)
                n_groups.append(0)
                n_links.append(0)
            else:
                total = k
                for x, y in groups:
                    if len(x) == 1 and len(y) == 1:
                        parts.append(name_a[x[0]] + name_b[y[0]])
                        pairs.append(x[0] * size + y[0])
                        total += 1
                        continue
                    parts.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
                    total += len(x) * len(y)
                    if len(x) * len(y) <= FEW:
                        pairs += [u * size + v for u in x for v in y]
                    else:
                        some = links([(x, y)])
                        others.append((len(pairs), list(some.values())))
                        pairs += [u * size + v for u, v in some]
                text.append(";".join(parts))
                n_groups.append(k + len(groups))
                n_links.append(total)
            offset.append(base + len(pairs))
        for own, more in zip(self.columns, counts, strict=True):
            own.extend(array("q", more))
        self.offset.extend(array("q", offset))
        self.pair.extend(array("q", pairs))
        times = array("q", [1]) * len(pairs)
        for at, some in others:
            times[at : at + len(some)] = array("q", some)
        self.times.extend(times)

    def forget_long(self, pieces: set[str]) -> None:
        """Long pieces would fill the memory: all is forgotten after a run that holds many bytes of them."""
        if sum(map(len, pieces)) > RUN_CHARS // 4:
            self.clear()


_PAIRS_OF = np.dtype([("doc", "<i8"), ("pair", "<i8"), ("times", "<i8")])


def aligned_run(own: Aligner, run: list[str | None]) -> tuple[list[tuple], np.ndarray]:
    """(n_a, n_b, n_groups, n_links, groups or None) of each text; and (doc, pair, times), sorted, of their links."""
    split = [pieces_of(t) if t else [] for t in run]
    distinct = set().union(*split)
    own.learn(distinct)
    place = np.fromiter(map(own.place.__getitem__, chain.from_iterable(split)), np.int64)
    texts = [own.text[i] for i in place.tolist()]
    ends = np.cumsum([len(s) for s in split], dtype=np.int64)
    rows, whole = [], np.ones(len(run), bool)
    sums = [np.append(0, np.cumsum(np.frombuffer(c, np.int64)[place] if len(place) else place)) for c in own.columns]
    for i, e in enumerate(ends.tolist()):
        s = e - len(split[i])
        some = texts[s:e]
        whole[i] = bool(some) and None not in some
        rows.append((*(int(c[e] - c[s]) for c in sums), ";".join(some)) if whole[i] else (0, 0, 0, 0, None))
    doc = np.repeat(np.arange(len(run)), [len(s) for s in split])
    used = whole[doc]
    key, n = np.unique(doc[used] * len(own.text) + place[used], return_counts=True)
    doc, place = key // max(1, len(own.text)), key % max(1, len(own.text))
    offset = np.frombuffer(own.offset, np.int64)
    length = offset[place + 1] - offset[place]
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(offset[place], length)
    pair, times = np.array(own.pair, np.int64)[at], np.array(own.times, np.int64)[at] * np.repeat(n, length)
    doc = np.repeat(doc, length)
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros(len(first), _PAIRS_OF)
    if len(first):
        out["doc"], out["pair"], out["times"] = doc[first], pair[first], np.add.reduceat(times, first)
    own.forget_long({p for p in distinct if len(p) > LONG_PIECE})
    return rows, out


def _runs(texts: list[str | None]):
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= RUN_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _aligned(ranks: str, model: str):
    """All of a batch's (rows, pairs), documents numbered through the batch."""

    def run(b: pa.RecordBatch) -> tuple[list[tuple], np.ndarray]:
        own = per_worker("aligner", (ranks, model), lambda: Aligner(ranks, model))
        rows, pairs = [], [np.zeros(0, _PAIRS_OF)]
        for some in _runs(b.column(1).to_pylist()):
            more, found = aligned_run(own, some)
            found["doc"] += len(rows)
            rows += more
            pairs.append(found)
        return rows, np.concatenate(pairs)

    return run


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def align(df: DataFrame, ranks: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links and groups (`a1,a2|b1;a3|b2,b3`), as align_counted() says."""
    bounded(df.sparkSession)
    made = _aligned(vocabulary(ranks), vocabulary(model))

    def run(batches):
        for b in batches:
            rows, _ = made(b)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield batch({id_col: b.column(0)} | {c: pa.array(v, pa.int64()) for c, v in zip(_COUNTS, columns, strict=False)} | {"groups": pa.array([t or "" for t in columns[4]], pa.string())})

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, groups string")


def _squeezed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def _array(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.int64) if n else np.zeros(0, np.int64)


def _blocks(made, id_type: pa.DataType):
    """Batches -> one row each: its distinct pairs, how many of its documents hold each, and its documents with
    what they hold: per document the number of its pairs; per pair its place among the distinct ones and its times."""
    kinds = pa.list_(pa.struct([("id", id_type), *((c, pa.int64()) for c in _COUNTS), ("groups_sha256", pa.string()), ("n_pairs", pa.int64())]))

    def run(batches):
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 24
        for b in batches:
            rows, pairs = made(b)
            distinct, place = np.unique(pairs["pair"], return_inverse=True)
            held = np.bincount(pairs["doc"], minlength=len(rows))
            docs = [{"id": i, **dict(zip(_COUNTS, r, strict=False)), "groups_sha256": hashlib.sha256(r[4].encode()).hexdigest() if r[4] is not None else "", "n_pairs": int(n)} for i, r, n in zip(b.column(0).to_pylist(), rows, held, strict=True)]
            yield batch({
                "block": pa.array([block], pa.int64()), "n_distinct": pa.array([len(distinct)], pa.int64()), "n_held": pa.array([len(pairs)], pa.int64()),
                "pairs": pa.array([_squeezed(np.diff(distinct, prepend=0))], pa.binary()), "documents": pa.array([_squeezed(np.bincount(place, minlength=len(distinct)).astype(np.int64))], pa.binary()),
                "docs": pa.array([docs], kinds), "places": pa.array([_squeezed(place.astype(np.int64))], pa.binary()), "times": pa.array([_squeezed(pairs["times"])], pa.binary()),
            })
            block += 1

    return run


def _sent(batches):
    """(block, n_distinct, pairs, documents) -> a row for each of the block's distinct pairs."""
    for b in batches:
        for block, n, pairs, documents in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            yield batch({"block": pa.array(np.full(n, block, np.int64)), "pair": pa.array(np.cumsum(_array(pairs, n))), "n": pa.array(_array(documents, n))})


def _finished(id_col: str, id_type: pa.DataType):
    """(docs, n_distinct, n_held, places, times, reply) -> document rows; reply: the block's (pair, count, best)."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                docs = b.column(0)[i].values
                n, held = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
                if n:
                    reply = b.column(5)[i].values
                    order = np.argsort(reply.field("pair").to_numpy())
                    count, best = reply.field("count").to_numpy()[order], reply.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
                place, times = _array(b.column(3)[i].as_py(), held), _array(b.column(4)[i].as_py(), held)
                ends = np.cumsum(docs.field("n_pairs").to_numpy())
                n_best, total = (np.append(0, np.cumsum(x[place] * times)) for x in (best, count))
                starts = np.append(0, ends[:-1])[: len(ends)]
                counts = {c: docs.field(c) for c in _COUNTS}
                yield batch({id_col: docs.field("id").cast(id_type)} | counts | {"n_best": pa.array(n_best[ends] - n_best[starts]), "count_sum": pa.array(total[ends] - total[starts]), "groups_sha256": docs.field("groups_sha256")})

    return run


def pair_counts(sent: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best) of (block, pair, n): documents that hold a pair, and whether no pair of its a id has more."""
    counts = sent.groupBy("pair").agg(F.sum("n").alias("count"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / F.lit(size_b)))  # at most size_b rows each
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_a))


def align_counted(df: DataFrame, ranks: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A: space + text by a rank file of a byte-level tokenizer; B: text by a sentencepiece model that adds the
    space. Tokens that begin and end at common bytes make a group, and all A-B pairs inside one are links.
    A pair's count is the number of input rows that hold it linked; n_best are links whose count is the
    highest of their A id (ties included), count_sum sums the counts over links. Texts that are null or
    empty, or that the model does not give back whole (those with its space mark), have no tokens: zeros
    and ''. Rows alike count each; ids, null ones too, only pass through; an empty table gives no
    rows; other columns are not read.
    """
    import sentencepiece

    bounded(df.sparkSession)
    model_path = vocabulary(model)
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_path).vocab_size()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    doc = f"struct<id:bigint,{','.join(f'{c}:bigint' for c in _COUNTS)},groups_sha256:string,n_pairs:bigint>"
    schema = f"block long, n_distinct long, n_held long, pairs binary, documents binary, docs array<{doc}>, places binary, times binary"
    blocks = stored(map_arrow(rows, _blocks(_aligned(vocabulary(ranks), model_path), pa.int64()), schema), "aligned")
    sent = map_arrow(blocks.select("block", "n_distinct", "pairs", "documents"), _sent, "block long, pair long, n long")
    counts = stored(pair_counts(sent, size_b), "pair-counts")
    reply = sent.select("block", "pair").join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("reply"))
    joined = blocks.select("block", "docs", "n_distinct", "n_held", "places", "times").join(reply, "block", "left")
    columns = f"`{id_col}` long, {', '.join(f'{c} long' for c in _COUNTS)}, n_best long, count_sum long, groups_sha256 string"
    return map_arrow(joined.select("docs", "n_distinct", "n_held", "places", "times", "reply"), _finished(id_col, pa.int64()), columns)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; nulls, repeats and empty tables as align_counted() says."""
    return align_counted(table(spark, sf_dir, "documents", "doc_id", "text"), "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
