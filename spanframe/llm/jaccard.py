"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes, as components.

Two sets with |A & B| >= t |A | B| share at least o = ceil(t |A|) shingles of A. In any fixed order of
all shingles, the first |A| - o + l shingles of A and the first |B| - o' + l of B then have l in
common, for every l. The order here is by document frequency, rarest first, so most prefixes are made
of shingles that no other document has and cost nothing.

1. Equal sets are one class, and one document stands for it.
2. Shingle hashes go to buckets of hash ranges in packed arrays of each block of documents, each hash
   once a block; a bucket counts how many sets hold each hash and sends back, per block, those that
   several do. Only these can be shared: sets with fewer than o of them link with no other set.
3. Each set takes the number l of matches, 1 to MATCHES, whose longer prefix and fewer candidates cost
   least by its shingles' frequencies; pairs that share l of them in prefixes of that length are
   candidates, and what their bitmaps allow is verified on the whole sets.

A bitmap's words toggle a bit for each shingle, so the number of bits in which two differ is at most
their symmetric difference, which linked sets bound.

Groups of thousands of near copies would make candidates of all their pairs. Sets whose least shingle
under one of MERGE hashes is also that of more than HEAVY others meet before step 3: in rounds, those of
a group that are not in one component yet are compared with WIDER of the group, then with WIDER times as
many others, until a round finds no link. Pairs within one component make no candidates afterwards.

Every linked pair is compared or already within one component, so the components are exact (up to
collisions of 64-bit hashes).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import batch, dropped, fresh, map_arrow, pieces, stored, table
from spanframe.llm.components import components, stars
from spanframe.llm.shingles import mix, shingle_hashes

MATCHES = 4
#: Hashes by which large groups of near copies meet, and what is a large group.
MERGE, HEAVY = 4, 12
#: How many sets of a group the first round compares all others with, and how many times as many each further one.
WIDER = 4
#: 64-bit words of a set's bitmap.
BITMAP = 8
#: Weight of verifying a candidate against reading one posting.
VERIFY = 8
#: Shingles that one bucket counts, and documents and characters of one block.
BUCKET_SHINGLES = 1_500_000
BLOCK_ROWS, BLOCK_CHARS = 1_000, 8_000_000
_META = np.dtype([("id", "<i8"), ("null", "?"), ("n", "<i4"), ("digest", "<i8")])
#: In place of a row: the whole block.
_ALL = 0xFFFF
_U = np.uint64


def packed(values: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending 64-bit values and 16-bit columns as bytes: steps between the values, of as few bytes as pay."""
    base = int(values[0]) if len(values) else 0
    step = np.diff(values, prepend=_U(base))
    costs = []
    for width in range(3, 9):
        fill = step // _U((1 << 8 * width) - 1)
        costs.append(((len(step) + float(fill.sum(dtype=np.float64))) * (width + 2 * len(columns)), width))
    width = min(costs)[1]
    top = _U((1 << 8 * width) - 1)
    fill = (step // top).astype(np.int64)
    # A step of the largest number stands for itself and says that its value is not whole.
    at = np.cumsum(fill + 1) - 1
    out = np.full(int(at[-1]) + 1 if len(at) else 0, top, _U)
    out[at] = step % top
    parts = [np.array([base], "<u8").tobytes(), bytes([width]), np.ascontiguousarray(out.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()]
    for c in columns:
        full = np.zeros(len(out), "<u2")
        full[at] = c
        parts.append(full.tobytes())
    return b"".join(parts)


def unpacked(data: bytes, columns: int) -> tuple[np.ndarray, ...]:
    """What packed() was given."""
    width = data[8]
    n = (len(data) - 9) // (width + 2 * columns)
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, n * width, 9).reshape(n, width)
    step = raw.view("<u8").ravel()
    whole = step != _U((1 << 8 * width) - 1)
    value = np.cumsum(step) + np.frombuffer(data, "<u8", 1)[0]
    at = 9 + n * width
    return value[whole], *(np.frombuffer(data, "<u2", n, at + 2 * n * i)[whole] for i in range(columns))


def _runs(values: np.ndarray) -> zip:
    """(first, end) of runs of equal neighbours."""
    cut = np.flatnonzero(np.diff(values)) + 1
    return zip([0, *cut.tolist()], [*cut.tolist(), len(values)], strict=True) if len(values) else zip((), ())


def _parts(k: int, bits: int):
    """Batches of documents -> (bucket, block, kind, data): each bucket's shingles; and, in buckets below 0, the
    documents themselves and the shingles that several sets of the block hold."""

    def run(batches):
        fresh()
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 24
        for b in batches:
            for some in pieces(b, 1, BLOCK_ROWS, BLOCK_CHARS):
                sets = [shingle_hashes(t or "", k) for t in some.column(1).to_pylist()]
                ids = some.column(0).to_pylist()
                meta = np.zeros(len(ids), _META)
                meta["id"], meta["null"] = [0 if i is None else i for i in ids], [i is None for i in ids]
                meta["n"] = [len(s) for s in sets]
                meta["digest"] = [int.from_bytes(hashlib.sha256(s.tobytes()).digest()[:8], "little", signed=True) for s in sets]
                first = np.zeros(len(sets), bool)
                first[np.unique(meta["digest"], return_index=True)[1]] = True
                own = np.flatnonzero(first & (meta["n"] > 0))
                tokens = np.concatenate([sets[i] for i in own]) if len(own) else np.zeros(0, _U)
                rows = np.repeat(own.astype(np.uint16), meta["n"][own])
                order = np.argsort(tokens, kind="stable")
                tokens, rows = tokens[order], rows[order]
                new = np.ones(len(tokens), bool)
                new[1:] = tokens[1:] != tokens[:-1]
                count = np.diff(np.append(np.flatnonzero(new), len(tokens)))
                several = np.repeat(count > 1, count)
                inside = packed(tokens[several], rows[several])
                tokens, rows = tokens[new], np.where(count > 1, _ALL, rows[new])
                bucket = (tokens >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
                data, buckets = [], []
                for s, e in _runs(bucket):
                    buckets.append(int(bucket[s]))
                    data.append(packed(tokens[s:e], rows[s:e], np.minimum(count[s:e], 0xFFFF)))
                home = -1 - (block * 0x9E3779B1 >> 12) % (1 << 20)
                kinds = [0] * len(data) + [1, 2]
                yield batch({"bucket": pa.array([*buckets, home, home], pa.int64()), "block": pa.array([block] * len(kinds), pa.int64()), "kind": pa.array(kinds, pa.int8()), "data": pa.array([*data, meta.tobytes(), inside], pa.binary())})
                block += 1

    return run


def _counted(t: pa.Table) -> pa.Table:
    """One bucket: per block, the shingles that more than one set holds, with how many do (65,535 at most)."""
    if t["bucket"][0].as_py() < 0:
        return t.select(["block", "kind", "data"])
    parts = [unpacked(x, 2) for x in t["data"].to_pylist()]
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    token, row, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(token, kind="stable")
    s = token[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    total = np.add.reduceat(count[order].astype(np.int64), first)
    df = np.empty(len(s), np.int64)
    df[order] = np.repeat(total, np.diff(np.append(first, len(s))))
    keep = np.flatnonzero(df > 1)
    blocks, out = t["block"].to_numpy(), ([], [])
    for i, j in _runs(owner[keep]):
        own = keep[i:j]
        out[0].append(int(blocks[owner[own[0]]]))
        out[1].append(packed(token[own], row[own], np.minimum(df[own], 0xFFFF)))
    return pa.table({"block": pa.array(out[0], pa.int64()), "kind": pa.array([0] * len(out[0]), pa.int8()), "data": pa.array(out[1], pa.binary())})


def least_overlap(n, num: int, den: int):
    """ceil(num n / den)."""
    return -(-num * n // den)


def _assembled(num: int, den: int):
    """One block: a row for every document, with its shared shingles in the global order if its set can link with another."""

    def run(t: pa.Table) -> pa.Table:
        of = {kind: [d for d, k in zip(t["data"].to_pylist(), t["kind"].to_pylist(), strict=True) if k == kind] for kind in (0, 1, 2)}
        meta = np.frombuffer(of[1][0], _META)
        back = [unpacked(d, 2) for d in of[0]]
        token, row, df = (np.concatenate([b[i] for b in back]) if back else np.zeros(0, _U if i == 0 else np.uint16) for i in range(3))
        # Shingles of several sets of the block came back once: to each of these.
        inside, rows = unpacked(of[2][0], 1)
        whole = row == _ALL
        order = np.argsort(token[whole], kind="stable")
        common, common_df = token[whole][order], df[whole][order]
        own_df = common_df[np.searchsorted(common, inside)] if len(inside) else np.zeros(0, np.uint16)
        token, row, df = np.concatenate((token[~whole], inside)), np.concatenate((row[~whole], rows)), np.concatenate((df[~whole], own_df))
        order = np.lexsort((token, df, row))
        token, row, df = token[order], row[order], df[order]
        ends = np.searchsorted(row, np.arange(len(meta) + 1))
        able = (meta["n"] > 0) & (np.diff(ends) >= least_overlap(meta["n"].astype(np.int64), num, den))
        tokens = [token[ends[i] : ends[i + 1]].tobytes() if able[i] else None for i in range(len(meta))]
        dfs = [df[ends[i] : ends[i + 1]].tobytes() if able[i] else None for i in range(len(meta))]
        block = t["block"][0].as_py()
        return pa.table({"uid": pa.array((block << 16) + np.arange(len(meta)), pa.int64()), "id": pa.array(meta["id"], pa.int64(), mask=meta["null"]), "n": pa.array(meta["n"], pa.int64()), "digest": pa.array(meta["digest"], pa.int64()), "tokens": pa.array(tokens, pa.binary()), "dfs": pa.array(dfs, pa.binary())})

    return run


def best_matches(df: np.ndarray, spare: int) -> int:
    """The number of matches whose prefix costs least; spare: shared shingles the shortest prefix holds, less one."""
    options = []
    for k in range(1, MATCHES + 1):
        if spare + k > len(df) and k > 1:
            break
        postings = float((df[: spare + k] - 1).sum())
        options.append((postings + VERIFY * postings / k, k))
    return min(options)[1]


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """BITMAP words in which each token toggles one bit."""
    place = (mix(tokens) % np.uint64(64 * BITMAP)).astype(np.int64)
    odd = np.bincount(place, minlength=64 * BITMAP) % 2 == 1
    return np.packbits(odd, bitorder="little").view("<i8")


def _may_link(x: str, y: str, num: int, den: int):
    """Sizes and bitmaps allow a link: the symmetric difference is at most (n + n') (den - num) / (den + num)."""
    differ = sum((F.bit_count(F.col(f"bits{i}_{x}").bitwiseXOR(F.col(f"bits{i}_{y}"))) for i in range(BITMAP)), F.col(f"alone_{x}") + F.col(f"alone_{y}"))
    near_size = (F.col(f"n_{x}") * den >= F.col(f"n_{y}") * num) & (F.col(f"n_{y}") * den >= F.col(f"n_{x}") * num)
    return near_size & (differ * (den + num) <= (F.col(f"n_{x}") + F.col(f"n_{y}")) * (den - num))


def _postings(num: int, den: int):
    """(token, uid, component, n, alone, bits, level, matches): level is the smallest l whose prefix holds the token,
    alone the number of shingles that no other set has, bits the bitmap of the rest."""

    def run(batches):
        for b in batches:
            out = tuple([] for _ in range(7 + BITMAP))
            for uid, component, n, tokens, dfs in zip(*(b.column(c).to_pylist() for c in ("uid", "component", "n", "tokens", "dfs")), strict=True):
                token, df = np.frombuffer(tokens, "<u8"), np.frombuffer(dfs, "<u2").astype(np.int64)
                spare = len(token) - least_overlap(n, num, den)  # shared shingles of the 0-prefix
                k = min(len(token), spare + MATCHES)
                out[0].append(token[:k].astype(np.int64))
                level = np.maximum(1, np.arange(k) - spare + 1).astype(np.int32)
                for i, value in enumerate((uid, component, n, len(token), best_matches(df, spare)), 1):
                    out[i].append(np.full(k, n - value if i == 4 else value, np.int64))
                out[6].append(level)
                for i, word in enumerate(bitmap(token)):
                    out[7 + i].append(np.full(k, word, np.int64))
            if out[0]:
                names = ("token", "uid", "component", "n", "alone", "matches", "level", *(f"bits{i}" for i in range(BITMAP)))
                yield batch({c: pa.array(np.concatenate(x)) for c, x in zip(names, out, strict=True)})

    return run


_SALTS = mix(np.arange(1, MERGE + 1, dtype=_U) << _U(40))


def _met(batches):
    """Sets -> (key, uid, n, alone, bits): key is the least shingle under each of MERGE hashes, the rest as in _postings()."""
    names = ("key", "uid", "n", "alone", *(f"bits{i}" for i in range(BITMAP)))
    for b in batches:
        rows = []
        for uid, n, tokens in zip(*(b.column(c).to_pylist() for c in ("uid", "n", "tokens")), strict=True):
            token = np.frombuffer(tokens, "<u8")
            least = np.array([mix(token ^ s).min() for s in _SALTS], _U)
            own = (uid, n, n - len(token), *bitmap(token).tolist())
            rows += [(key, *own) for key in mix(least + _SALTS).view(np.int64).tolist()]
        if rows:
            yield batch({c: pa.array(x, pa.int64()) for c, x in zip(names, zip(*rows, strict=True), strict=True)})


def _linked(num: int, den: int):
    def run(batches):
        for b in batches:
            keep = []
            for na, ta, nb, tb in zip(*(b.column(c).to_pylist() for c in ("na", "ta", "nb", "tb")), strict=True):
                both = len(np.intersect1d(np.frombuffer(ta, "<u8"), np.frombuffer(tb, "<u8"), assume_unique=True))
                keep.append(den * both >= num * (na + nb - both))
            mask = pa.array(keep, pa.bool_())
            yield batch({"u": b.column("a").filter(mask), "v": b.column("b").filter(mask)})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, as edges (u, v)."""
    a = sets.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return map_arrow(pairs.join(b, "b").join(a, "a"), _linked(num, den), "u long, v long")


def _sided(rows: DataFrame, side: str, key: str) -> DataFrame:
    return rows.select(key, *(F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != key))


def _with_component(rows: DataFrame, near: DataFrame | None) -> DataFrame:
    """rows (uid, ..) with their component in near (uid, component), their own uid where they have none."""
    if near is None:
        return rows.withColumn("component", F.col("uid"))
    return rows.join(near, "uid", "left").withColumn("component", F.coalesce("component", "uid"))


def _of_several(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, component, ..) of keys that more than one component holds."""
    of_key = Window.partitionBy(key)
    return rows.withColumns({"low": F.min("component").over(of_key), "high": F.max("component").over(of_key)}).where("low <> high").drop("low", "high")


def star_pairs(open_: DataFrame, taken: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets of one key and different components that may link, b one of `taken` chosen by hash for each key."""
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("uid", F.lit(taken)), "uid"))
    centers = open_.withColumn("turn", turn).where(F.col("turn") <= taken).drop("turn")
    met = _sided(open_, "x", "key").join(_sided(centers, "y", "key"), "key")
    met = met.where((F.col("component_x") != F.col("component_y")) & _may_link("x", "y", num, den))
    return met.select(F.least("uid_x", "uid_y").alias("a"), F.greatest("uid_x", "uid_y").alias("b")).distinct()


def _merged(sets: DataFrame, num: int, den: int) -> DataFrame | None:
    """(uid, component) of sets that link within the large groups they meet in, but for the least of each component; None without such groups."""
    met = map_arrow(sets.select("uid", "n", "tokens"), _met, ", ".join(f"{c} long" for c in ("key", "uid", "n", "alone", *(f"bits{i}" for i in range(BITMAP)))))
    many = F.count("*").over(Window.partitionBy("key"))
    heavy = stored(met.withColumn("size", many).where(F.col("size") > HEAVY), "heavy")
    if heavy.isEmpty():
        dropped(heavy)
        return None
    own = stored(sets.select("uid", "n", "tokens").join(heavy.select("uid").distinct(), "uid", "left_semi"), "met")
    near, taken, rest = None, WIDER, heavy
    while True:
        open_ = stored(_of_several(_with_component(rest.drop("size"), near), "key"), "open")
        links = None if open_.isEmpty() else stored(_verified(star_pairs(open_, taken, num, den), own, num, den), "merging")
        dropped(open_)
        if links is None or links.isEmpty():
            break
        # What is merged already is a star around each component's least set.
        edges = links if near is None else links.unionAll(near.select(F.col("uid").alias("u"), F.col("component").alias("v")))
        before, near = near, stars(edges).withColumnsRenamed({"u": "uid", "v": "component"})
        for t in (links, *([] if before is None else [before])):
            dropped(t)
        # All pairs of a group of no more than `taken` have been compared.
        rest, taken = heavy.where(F.col("size") > taken), taken * WIDER
    for t in (heavy, own):
        dropped(t)
    return near


def linked_sets(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame | None]:
    """(edges (u, v) found by adaptive prefixes, edges of large groups merged before or None) of sets (uid, n, tokens, dfs)."""
    near = _merged(sets, num, den)
    placed = _with_component(sets, near)
    kinds = "token long, uid long, component long, n long, alone long, matches long, level int, " + ", ".join(f"bits{i} long" for i in range(BITMAP))
    postings = map_arrow(placed.select("uid", "component", "n", "tokens", "dfs"), _postings(num, den), kinds)
    # Both sides of the join read one shuffle of the postings, so each keeps all columns.
    open_ = _of_several(postings, "token").where("level > 0 and matches > 0")
    later = (F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("uid_x") > F.col("uid_y")))
    shared = _sided(open_.where("level <= matches"), "x", "token").join(_sided(open_, "y", "token"), "token")
    shared = shared.where(later & (F.col("component_x") != F.col("component_y")) & (F.col("level_y") <= F.col("matches_x")) & _may_link("x", "y", num, den))
    pairs = shared.groupBy(F.col("uid_x").alias("a"), F.col("uid_y").alias("b"), "matches_x").agg(F.count("*").alias("c")).where("c >= matches_x").select("a", "b")
    found = stored(_verified(pairs, sets, num, den), "links")
    return found, None if near is None else near.select(F.col("uid").alias("u"), F.col("component").alias("v"))


def similar_components(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_shingles, component_id and is_first (one row of each component).

    Sets link when den * |A & B| >= num * |A | B|. A text without words (null, empty, only white space)
    has no shingles and links with nothing. component_id is the smallest id of the component, null if
    it holds null ids only; rows that share an id stay rows of their own. is_first marks the row with
    that id (the first read of several). An empty table gives no rows; other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(30, max(0, (int(chars / 6) // BUCKET_SHINGLES).bit_length()))
    parts = map_arrow(rows, _parts(k, bits), "bucket long, block long, kind byte, data binary")
    back = parts.groupBy("bucket").applyInArrow(_counted, "block long, kind byte, data binary")
    docs = stored(back.groupBy("block").applyInArrow(_assembled(num, den), "uid long, id long, n long, digest long, tokens binary, dfs binary"), "sets")

    # Nodes order by id, null ids last, so a component's least node has its smallest id.
    small = docs.select(F.struct(F.col("id").isNull().alias("none"), "id", "uid").alias("node"), "n", "digest")
    able = F.min(F.when(F.col("tokens").isNotNull(), F.col("uid"))).alias("able")
    classes = stored(docs.where("n > 0").groupBy("digest", "n").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("node"), able), "classes")
    sets = stored(docs.where(F.col("tokens").isNotNull()).select("uid", "n", "tokens", "dfs").join(classes.select(F.col("able").alias("uid")), "uid", "left_semi"), "reps")
    found, merged = linked_sets(sets, num, den)
    dropped(sets)
    edges = found if merged is None else found.unionAll(merged)
    nodes = classes.where("able is not null").select("able", "node")
    edges = edges.join(nodes.select(F.col("able").alias("u"), F.col("node").alias("x")), "u").join(nodes.select(F.col("able").alias("v"), F.col("node").alias("y")), "v")
    final = components(edges.select(F.col("x").alias("u"), F.col("y").alias("v")))
    least = stored(classes.join(final, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component")), "components")

    linked = small.where("n > 0").join(least, ["digest", "n"]).select("node", "n", "component")
    alone = small.where("n = 0").select("node", "n", F.col("node").alias("component"))
    return linked.unionAll(alone).select(F.col("node.id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component.id").alias("component_id"), (F.col("component.uid") == F.col("node.uid")).alias("is_first"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, as similar_components() says."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return similar_components(docs, k=3, num=90, den=100).drop("is_first")
