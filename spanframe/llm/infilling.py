"""Fill-in-middle rewriting of documents, cut between units (`[A-Za-z]+|[^A-Za-z]`) found by a parallel automaton scan.

A four-state automaton over UTF-8 bytes counts units and looks for the markers `<P>`, `<S>` and `<M>`.
A chunk of a text, wherever its bytes begin, emits what it does from each start state: the state it
ends in, the units that begin in it and the markers it completes. These functions compose
associatively, so the entry states of all chunks follow from the functions alone.

- Texts of one chunk are scanned a whole Arrow batch at once from the first state.
- Longer texts are dealt out as chunks; each emits its function; composition of a document's functions
  (one short row a chunk) gives each chunk its entry state and the units before it; every chunk then
  tells by these alone whether it holds a cut, and only that chunk is scanned again, from its entry
  state, when the text is put together.

A marker begins with `<` and holds it nowhere else, so a text without markers stays without them on
either side of a cut, and the output of such a text can be taken apart again exactly.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.common import batch, bounded, map_arrow, table

#: Bytes of one chunk; a longer text is scanned by several tasks.
CHUNK = 1 << 16
#: Out of 100: documents that are rewritten, and rewritten ones with the suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20
SEED = 1

#: States: after any other character, inside letters, after `<`, after `<` and a marker's letter.
FIRST, WORD, OPEN, NAMED = range(4)
#: Classes of bytes.
_LETTER, _NAME, _LESS, _MORE, _OTHER, _REST = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _REST
for _b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    _CLASS[_b] = _LETTER
_CLASS[list(b"PSM")], _CLASS[ord("<")], _CLASS[ord(">")] = _NAME, _LESS, _MORE


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, whether a unit begins, whether a marker ends) by state and class."""
    step, unit, hit = np.zeros((4, 6), np.uint8), np.zeros((4, 6), np.uint8), np.zeros((4, 6), np.uint8)
    for state in range(4):
        for kind in range(6):
            letter = kind in (_LETTER, _NAME)
            step[state, kind] = NAMED if state == OPEN and kind == _NAME else WORD if letter else OPEN if kind == _LESS else FIRST
            unit[state, kind] = kind != _REST and not (letter and state in (WORD, NAMED))
            hit[state, kind] = state == NAMED and kind == _MORE
    return step, unit, hit


STEP, UNIT, HIT = _automaton()
#: The state after two bytes does not depend on that before them.
_AFTER_TWO = np.array([[STEP[STEP[FIRST, a], b] for b in range(6)] for a in range(6)], np.uint8)


def states(kinds: np.ndarray, starts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The state before each byte, of texts that lie one after the other: where each begins, and in which state."""
    before = np.empty(len(kinds), np.uint8)
    before[2:] = _AFTER_TWO[kinds[:-2], kinds[1:-1]]
    ends = np.append(starts[1:], len(kinds))
    one, two = ends > starts, ends > starts + 1
    before[starts[one]] = entries[one]
    before[starts[two] + 1] = STEP[entries[two], kinds[starts[two]]]
    return before


def chunk_function(data: bytes) -> tuple[list[int], list[int], list[int], int]:
    """A chunk's end states, units and markers by start state, and its code points."""
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    before = states(kinds, np.zeros(1, np.int64), np.zeros(1, np.uint8))
    units, hits = int(UNIT[before, kinds].sum()), int(HIT[before, kinds].sum())
    ends, n_units, n_hits = [], [], []
    for state in range(4):
        now, more_units, more_hits = state, 0, 0
        for i, kind in enumerate(kinds[:2].tolist()):
            more_units += int(UNIT[now, kind]) - int(UNIT[before[i], kind])
            more_hits += int(HIT[now, kind]) - int(HIT[before[i], kind])
            now = int(STEP[now, kind])
        ends.append(now if len(kinds) < 3 else int(STEP[before[-1], kinds[-1]]))
        n_units.append(units + more_units)
        n_hits.append(hits + more_hits)
    return ends, n_units, n_hits, int((kinds != _REST).sum())


def then(f: tuple, g: tuple) -> tuple:
    """The function of a chunk f followed by a chunk g; associative."""
    ends, units, hits, chars = f
    return [g[0][s] for s in ends], [u + g[1][s] for u, s in zip(units, ends, strict=True)], [h + g[2][s] for h, s in zip(hits, ends, strict=True)], chars + g[3]


def entries(functions: Iterable[tuple]) -> tuple[list[tuple[int, int, int]], tuple]:
    """For each chunk in order (entry state, units before it, code points before it); and the whole text's function."""
    so_far, out = (list(range(4)), [0] * 4, [0] * 4, 0), []
    for f in functions:
        out.append((so_far[0][FIRST], so_far[1][FIRST], so_far[3]))
        so_far = then(so_far, f)
    return out, so_far


def form_of(n, hits, h3, h4) -> str:
    if not n or hits or h3 % 100 >= REWRITTEN:
        return "plain"
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm"


def assembled(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return b"".join((b"<P>", prefix, b"<S>", suffix, b"<M>", middle))
    return b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle)) if form == "spm" else prefix + middle + suffix


def restored(output: Column, form: Column) -> Column:
    """The text again from an output and its form."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, "<M>", -1)
    return F.when(form == "psm", F.concat(between("<P>", "<S>"), middle, between("<S>", "<M>"))).when(form == "spm", F.concat(between("<P>", "<M>"), middle, between("<S>", "<P>"))).otherwise(output)


_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def _rows(ids: pa.Array, id_col: str, rows: list[tuple]) -> pa.RecordBatch:
    n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
    return batch({id_col: ids, "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(output, pa.binary()).cast(pa.string())})


def _short(id_col: str):
    """(id, text, h1..h4) of texts of one chunk -> rewritten rows, a batch's texts as one array of bytes."""

    def run(batches):
        for b in batches:
            data = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            h = [b.column(i).to_pylist() for i in range(2, 6)]
            every = b"".join(data)
            kinds = _CLASS[np.frombuffer(every, np.uint8)]
            ends = np.cumsum([len(d) for d in data], dtype=np.int64)
            starts = np.append(0, ends[:-1])[: len(ends)]
            before = states(kinds, starts, np.zeros(len(starts), np.uint8))
            units, hits = np.flatnonzero(UNIT[before, kinds]), np.flatnonzero(HIT[before, kinds])
            chars = np.append(0, np.cumsum(kinds != _REST))
            at, until = np.searchsorted(units, starts).tolist(), np.searchsorted(units, ends).tolist()
            marked = (np.searchsorted(hits, ends) > np.searchsorted(hits, starts)).tolist()
            rows = []
            for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                n = until[i] - at[i]
                form = form_of(n, marked[i], h[2][i], h[3][i])
                if form == "plain":
                    rows.append((n, form, None, None, data[i]))
                    continue
                low, high = sorted((h[0][i] % (n + 1), h[1][i] % (n + 1)))
                p, m = (int(units[at[i] + k]) if k < n else e for k in (low, high))
                rows.append((n, form, int(chars[p] - chars[s]), int(chars[m] - chars[p]), assembled(form, every[s:p], every[p:m], every[m:e])))
            yield _rows(b.column(0), id_col, rows)

    return run


def _chunks(batches):
    """(key, text, h1, h2) -> (key, h1, h2, no, data): chunks of CHUNK bytes, a few at a time."""
    for b in batches:
        for key, text, h1, h2 in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            view = memoryview(text.as_buffer())
            for s in range(0, len(view), 16 * CHUNK):
                data = [bytes(view[k : k + CHUNK]) for k in range(s, min(s + 16 * CHUNK, len(view)), CHUNK)]
                yield batch({"key": pa.array([key] * len(data)), "h1": pa.array([h1] * len(data), pa.int64()), "h2": pa.array([h2] * len(data), pa.int64()), "no": pa.array(range(s // CHUNK, s // CHUNK + len(data)), pa.int32()), "data": pa.array(data, pa.binary())})


def _functions(batches):
    """(key, h1, h2, no, data) -> (key, h1, h2, no, ends, units, hits, chars)."""
    for b in batches:
        ends, units, hits, chars = zip(*map(chunk_function, b.column(4).to_pylist()), strict=True) if b.num_rows else ((),) * 4
        yield batch({c: b.column(c) for c in ("key", "h1", "h2", "no")} | {"ends": pa.array(ends, pa.list_(pa.int64())), "units": pa.array(units, pa.list_(pa.int64())), "hits": pa.array(hits, pa.list_(pa.int64())), "chars": pa.array(chars, pa.int64())})


def _resolved(t: pa.Table) -> pa.Table:
    """One document's functions -> (key, h1, h2, no, entry, units, before, chars, n, marked) of its chunks."""
    rows = list({r["no"]: r for r in t.to_pylist()}.values())  # rows alike have the same chunks
    rows.sort(key=lambda r: r["no"])
    at, whole = entries((r["ends"], r["units"], r["hits"], r["chars"]) for r in rows)
    out = [{"key": r["key"], "h1": r["h1"], "h2": r["h2"], "no": r["no"], "entry": s, "units": r["units"][s], "before": u, "chars": c, "n": whole[1][FIRST], "marked": whole[2][FIRST] > 0} for r, (s, u, c) in zip(rows, at, strict=True)]
    kinds = [("key", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("no", pa.int32()), ("entry", pa.int32()), ("units", pa.int64()), ("before", pa.int64()), ("chars", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_())]
    return pa.Table.from_pylist(out, pa.schema(kinds))


def cut_places(long_texts: DataFrame) -> DataFrame:
    """(key, text, h1, h2) -> (key, n, marked, low, high): the chunk that holds each cut with its entry state, the
    units of it before the cut and the code points before the chunk; null where the cut is the text's end."""
    chunks = map_arrow(long_texts.select("key", "text", "h1", "h2"), _chunks, "key string, h1 long, h2 long, no int, data binary").repartition("key", "no")
    functions = map_arrow(chunks, _functions, "key string, h1 long, h2 long, no int, ends array<long>, units array<long>, hits array<long>, chars long")
    at = functions.groupBy("key").applyInArrow(_resolved, "key string, h1 long, h2 long, no int, entry int, units long, before long, chars long, n long, marked boolean")
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)

    def held(cut: Column) -> Column:
        here = (F.col("before") <= cut) & (cut < F.col("before") + F.col("units"))
        return F.max(F.when(here, F.struct("no", "entry", (cut - F.col("before")).alias("units"), "chars")))

    return at.groupBy("key").agg(F.max("n").alias("n"), F.max("marked").alias("marked"), held(F.least(a, b)).alias("low"), held(F.greatest(a, b)).alias("high"))


def _place(view: memoryview, cut: dict | None) -> tuple[int, int | None]:
    """(byte, code points before it) of a cut; the chunk that holds it is scanned from its entry state."""
    if cut is None:
        return len(view), None
    s = cut["no"] * CHUNK
    kinds = _CLASS[np.frombuffer(view[s : s + CHUNK], np.uint8)]
    units = np.flatnonzero(UNIT[states(kinds, np.zeros(1, np.int64), np.array([cut["entry"]], np.uint8)), kinds])
    k = int(units[cut["units"]])
    return s + k, cut["chars"] + int((kinds[:k] != _REST).sum())


def _long(id_col: str):
    """(id, text, h3, h4, n, marked, low, high) -> rewritten rows, a text at a time."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, _, h3, h4, n, marked, low, high = (b.column(k)[i].as_py() if k > 1 else None for k in range(8))
                text = b.column(1).slice(i, 1).cast(pa.binary())[0].as_buffer()
                view = memoryview(text)
                form = form_of(n, marked, h3, h4)
                if form == "plain":
                    yield _rows(b.column(0).slice(i, 1), id_col, [(n, form, None, None, bytes(view))])
                    continue
                (p, before), (m, until) = _place(view, low), _place(view, high)
                whole = int((_CLASS[np.frombuffer(view, np.uint8)] != _REST).sum()) if until is None else None
                before, until = whole if before is None else before, whole if until is None else until
                yield _rows(b.column(0).slice(i, 1), id_col, [(n, form, before, until - before, assembled(form, bytes(view[:p]), bytes(view[p:m]), bytes(view[m:])))])

    return run


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per input row: id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and output.

    h1 to h4 are the first 32-bit groups of the sha256 of `seed:id`. The prefix ends after the smaller of
    h1 % (n+1) and h2 % (n+1) units, the middle after the larger. Plain texts (empty or null ones, those
    that hold a marker, and 100 - REWRITTEN of 100 by h3) are their own output, with null lengths. A null
    id counts as empty; rows alike, or with the same id, stay rows of their own; an empty table gives no
    rows; other columns are not read. A long text is one row here too: it is cut by several tasks and
    put together in one.
    """
    bounded(df.sparkSession)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(named, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *h)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {_SCHEMA}"
    short = map_arrow(rows.where(size <= CHUNK), _short(id_col), schema)
    key = F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256)
    long_texts = rows.where(size > CHUNK).withColumn("key", key)
    placed = long_texts.join(cut_places(long_texts), "key").select("id", "text", "h3", "h4", "n", "marked", "low", "high")
    return short.unionAll(map_arrow(placed, _long(id_col), schema))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text restored
    from it; nulls, repeats and empty tables as fill_in_middle() says."""
    out = fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP12_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
p AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM h),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM p),
s AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""
