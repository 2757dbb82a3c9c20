"""Nearest neighbours by cosine through additive quantisation.

A unit vector is coded as a sum of CODEBOOKS full-dimensional code words. Codebooks start from k-means
on successive residuals of a bounded sample and are refit by least squares between rounds of beam
search; every row is then encoded by beam search and stored with its code, the norm of what the code
stands for and the vector. A query scores codes by table look-ups (its inner products with all code
words, less half the stored squared norm), keeps the best candidates of each block and reranks them
exactly, in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import batch, map_arrow, stored, table

CODEBOOKS, WORDS, BEAM = 16, 128, 4
#: The index is fitted on at most so many rows; every row is indexed.
FIT_ROWS = 8_192
FIT_ROUNDS = 2
#: Rows reranked exactly for each query and block: so many, but no more than one in RERANK_SHARE of the block and 4 k
#: at least, so that the share hardly depends on how rows fall into partitions.
RERANK, RERANK_SHARE, BLOCK = 128, 16, 4_096
#: Queries whose tables are broadcast at once: 20,000 of 64 doubles are 10 MB.
QUERIES_AT_ONCE = 20_000
SCORED_AT_ONCE = 256


def usable(col: str):
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(col).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(col, lambda v: v != 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _means(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1)[None] - 2 * x @ centres.T, axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
        centres[count == 0] = x[rng.choice(len(x), int((count == 0).sum()))]
    return centres


def fit(x: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = FIT_ROUNDS, seed: int = 5) -> np.ndarray:
    """Codebooks (codebooks, words, dim) for unit vectors x."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float32)
    books, rest = [], x.copy()
    for _ in range(codebooks):
        c = _means(rest, words, rng)
        near = np.argmin((c * c).sum(1)[None] - 2 * rest @ c.T, axis=1)
        rest -= c[near]
        books.append(c)
    books = np.stack(books)
    for _ in range(rounds):
        codes = encode(x, books)
        used = np.zeros((len(x), codebooks * words), np.float32)
        used[np.arange(len(x))[:, None], codes + np.arange(codebooks) * words] = 1
        gram = used.T @ used + 0.1 * np.eye(codebooks * words, dtype=np.float32)
        prior = books.reshape(-1, x.shape[1])
        books = np.linalg.solve(gram, used.T @ x + 0.1 * prior).astype(np.float32).reshape(books.shape)
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, codebooks) by beam search: the partial sums nearest to x stay in the beam."""
    m, k, dim = books.shape
    flat = books.reshape(-1, dim)
    norm = (flat * flat).sum(1)
    between = flat @ flat.T
    out = np.zeros((len(x), m), np.uint8 if k <= 256 else np.int32)
    for at in range(0, len(x), 512):
        some = np.asarray(x[at : at + 512], np.float32)
        n = len(some)
        inner = some @ flat.T
        codes = np.zeros((n, 1, 0), np.int32)
        error = np.zeros((n, 1), np.float32)  # squared distance less |x|^2
        for j in range(m):
            own = slice(j * k, (j + 1) * k)
            step = norm[own] - 2 * inner[:, own]
            total = error[:, :, None] + step[:, None, :]
            for i in range(j):
                total += 2 * between[i * k + codes[:, :, i], own]
            b = codes.shape[1]
            total = total.reshape(n, b * k)
            keep = min(beam, b * k) if j < m - 1 else 1
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(total, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None].astype(np.int32)], 2)
        out[at : at + n] = codes[:, 0]
    return out


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray | None]:
    """(stored table of id, vector, codes, norm2; codebooks) over every usable row of df.

    Rows whose vector is null, zero or holds null or non-finite components are left out, and so are vectors of
    another length than most have (of equally common lengths the smallest counts), and rows without an id.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable("vector") & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is not None:
        rows = rows.where(F.size("vector") == lengths["size"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vector").toArrow()["vector"]
    if not len(sample):
        return rows.withColumns({"codes": F.lit(b""), "norm2": F.lit(0.0)}).limit(0), None
    books = fit(unit(np.stack([np.asarray(v, float) for v in sample.to_pylist()])))
    sent = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column(1)))
                codes = encode(x, sent.value)
                back = decoded(codes, sent.value)
                yield batch({"id": b.column(0), "vector": b.column(1), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "norm2": pa.array((back.astype(float) ** 2).sum(1))})

    return stored(map_arrow(rows, run, "id long, vector array<double>, codes binary, norm2 double"), "index"), books


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def search(index: DataFrame, books: np.ndarray | None, queries: DataFrame, k: int = 5, metric_rows: int = RERANK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest rows of the index but itself.

    queries: columns id and vector, usable vectors only. Queries go in blocks of QUERIES_AT_ONCE, one block
    after the other: each is broadcast, its result stored and the broadcast given up before the next, so what
    is held is bounded however many there are. Ties go to the smaller id. Rows that share the query's id count
    as its own; rows that share another id stay rows of their own.
    """
    schema = "query_id long, vec_id long, score double"
    spark = index.sparkSession
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = queries.count()
    blocks = max(1, -(-n // QUERIES_AT_ONCE))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "vector").toArrow()
        ids = own["id"].to_numpy()
        raw = np.array(own["vector"].to_pylist(), float).reshape(len(ids), -1)
        sent = spark.sparkContext.broadcast((ids, raw, books))
        nearest = map_arrow(index, _scorer(sent, k, metric_rows), schema).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            nearest = stored(nearest, "nearest")
            sent.unpersist()
        found = nearest if found is None else found.unionAll(nearest)
    return found


def _scorer(sent, k: int, rerank: int):
    def run(batches):
        ids, raw, books = sent.value
        if not len(ids):
            return
        q = unit(raw)
        tables = (q.astype(np.float32) @ books.reshape(-1, books.shape[2]).T).reshape(len(q), *books.shape[:2])
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BLOCK:
                yield from _block(held, ids, q, tables, k, rerank)
                held, size = [], 0
        if size:
            yield from _block(held, ids, q, tables, k, rerank)

    return run


def _block(held, ids, q, tables, k, rerank):
    rows = pa.Table.from_batches(held).combine_chunks()
    own = rows["id"].to_numpy()
    order = np.argsort(own, kind="stable")
    own = own[order]
    x = unit(np.concatenate([_matrix(b.column(1)) for b in held])[order])
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(own), -1)[order]
    half = (rows["norm2"].to_numpy()[order] / 2).astype(np.float32)
    keep = min(len(own), max(4 * k, min(rerank, -(-len(own) // RERANK_SHARE))))
    for at in range(0, len(ids), SCORED_AT_ONCE):
        t = tables[at : at + SCORED_AT_ONCE]
        score = np.zeros((len(t), len(own)), np.float32) - half
        for j in range(codes.shape[1]):
            score += t[:, j, :][:, codes[:, j]]
        # The best, ties to the smaller id: rows are in id order and equal codes score alike.
        bound = np.partition(score, len(own) - keep, axis=1)[:, len(own) - keep]
        got = ([], [], [])
        for i, row in enumerate(score):
            near = np.flatnonzero(row >= bound[i])
            over = len(near) - keep
            if over > 0:  # equal scores at the bound: the smallest ids of them, exactly reranked below
                same = near[row[near] == bound[i]]
                near = np.setdiff1d(near, same[len(same) - over :], assume_unique=True) if over < len(same) else near
            exact = (x[near] * q[at + i]).sum(axis=1)
            other = own[near] != ids[at + i]
            near, exact = near[other], exact[other]
            best = np.lexsort((own[near], -exact))[:k]
            got[0].append(np.full(len(best), ids[at + i]))
            got[1].append(own[near[best]])
            got[2].append(exact[best])
        yield batch({n: pa.array(np.concatenate(v)) for n, v in zip(("query_id", "vec_id", "score"), got, strict=True)})


def op6_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found for every vector whose vec_id is divisible by 50: query_id, rank, vec_id, score."""
    index, books = build_index(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return search(index, books, index.where(F.pmod("id", F.lit(50)) == 0), k=5)
