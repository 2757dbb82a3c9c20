"""Near-duplicate components by one-permutation MinHash with optimal densification and star-shaped candidates.

1. A set's shingles have uniform 64-bit hashes, so their range cut into BANDS * ROWS equal bins is one
   permutation's bins: a bin's value is its least hash. An empty bin borrows that of the first bin not
   empty in a sequence of pseudo-random bins of its own, the same for all sets (optimal densification).
   ROWS bins in a row make one bucket key. Two sets at exactly 0.8 share no bucket with a chance of
   (1 - 0.8^5)^32 = 3e-6.
2. Equal sets are one class. Every class meets the least class of each of its buckets only (a star), so
   there are at most BANDS candidates a class, each pair once.
3. Sizes and bitmaps (a lower bound of the symmetric difference, see jaccard.py) discard candidates that
   cannot link; the others are confirmed on the full sets, which are hashed again from the texts of
   these classes only.
4. A bucket all of whose classes are in one component is done. In the others, classes that do not link with the
   least one may still link with each other: those outside of the bucket's largest component become centers
   of stars, a few in the first round and several times as many in each further one, until each pair of
   classes of a bucket has been compared or is within one component.

So no link of classes that share a bucket is lost, and no bucket is paired off where its stars suffice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import KeyFilter, batch, bounded, dropped, map_arrow, pieces, stored, table
from spanframe.llm.components import stars
from spanframe.llm.jaccard import BITMAP, bitmap
from spanframe.llm.shingles import mix, shingle_hashes

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Centers that a bucket's second round takes, and how many times as many each further one.
STRAYS, WIDER = 32, 8
#: Characters hashed at once.
RUN_CHARS = 4_000_000
_U = np.uint64
_EDGES = np.array([-(-(i << 64) // BINS) for i in range(BINS)], dtype=_U)


def _probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    """The bin that each of bins looks at in an attempt."""
    return (mix(bins.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(attempt)) % _U(BINS)).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Bin values (sets by BINS) of sorted, not empty arrays of hashes."""
    value, full = np.zeros((len(sets), BINS), _U), np.zeros((len(sets), BINS), bool)
    for i, own in enumerate(sets):
        first = np.searchsorted(own, _EDGES)
        full[i] = first < np.append(first[1:], len(own))
        value[i] = own[np.minimum(first, len(own) - 1)]
    row, column = np.nonzero(~full)
    attempt = 0
    while len(row):
        attempt += 1
        near = _probe(column, attempt)
        found = full[row, near]
        value[row[found], column[found]] = value[row[found], near[found]]
        row, column = row[~found], column[~found]
    return value


def bucket_keys(value: np.ndarray) -> np.ndarray:
    """Keys (sets by BANDS) of the buckets of bin values."""
    parts = value.reshape(len(value), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), parts.shape[:2])
    for r in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.sha256(own.tobytes()).digest()[:16]


def _signed(k: int):
    """(id, text) -> (id, n, digest, bits0.., keys); bits and keys of the first of a run's equal sets only."""

    def run(batches):
        for b in batches:
            for some in pieces(b, 1, 1000, RUN_CHARS):
                sets = [shingle_hashes(t or "", k) for t in some.column(1).to_pylist()]
                digests = [_digest(s) if len(s) else None for s in sets]
                first: dict[bytes, int] = {}
                for i, d in enumerate(digests):
                    if d is not None:
                        first.setdefault(d, i)
                own = sorted(first.values())
                keys, bits = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), BITMAP), np.int64)
                if own:
                    keys[own] = bucket_keys(signatures([sets[i] for i in own]))
                    bits[own] = [bitmap(sets[i]) for i in own]
                other = np.ones(len(sets), bool)
                other[own] = False
                listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield batch(
                    {"id": some.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array(digests, pa.binary())}
                    | {f"bits{i}": pa.array(bits[:, i], mask=other) for i in range(BITMAP)}
                    | {"keys": listed.filter(pa.array(~other)).take(pa.array(np.where(other, 0, np.cumsum(~other) - 1), mask=other))}
                )

    return run


def _hashed(k: int, may: KeyFilter):
    """(id, text, slot) -> (digest, tokens) of rows that the filter holds."""

    def run(batches):
        for b in batches:
            keep = b.filter(pa.array(may.holds(b.column(2))))
            for some in pieces(keep, 1, 1000, RUN_CHARS):
                sets = {_digest(s): s for s in (shingle_hashes(t or "", k) for t in some.column(1).to_pylist()) if len(s)}
                yield batch({"digest": pa.array(list(sets), pa.binary()), "tokens": pa.array([s.tobytes() for s in sets.values()], pa.binary())})

    return run


def _sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(uid, tokens) of the wanted (uid, digest, id): only texts whose id may be wanted are hashed."""
    may = KeyFilter(wanted, "id")
    hashed = map_arrow(rows.withColumn("slot", may.slot(F.col("id"))), _hashed(k, may), "digest binary, tokens binary")
    return hashed.join(wanted.select("digest", "uid"), "digest").groupBy("digest").agg(F.first("uid").alias("uid"), F.first("tokens").alias("tokens")).drop("digest")


def _linked(num: int, den: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                a, c = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(a, c, assume_unique=True))
                keep.append(den * both >= num * (len(a) + len(c) - both))
            mask = pa.array(keep, pa.bool_())
            yield batch({"u": b.column(0).filter(mask), "v": b.column(1).filter(mask)})

    return run


def may_link(x: str, y: str, num: int, den: int) -> Column:
    """Whether sizes and bitmaps of sides x and y allow a link."""
    differ = sum((F.bit_count(F.col(f"bits{i}_{x}").bitwiseXOR(F.col(f"bits{i}_{y}"))) for i in range(1, BITMAP)), F.bit_count(F.col(f"bits0_{x}").bitwiseXOR(F.col(f"bits0_{y}"))))
    near = (F.col(f"n_{x}") * den >= F.col(f"n_{y}") * num) & (F.col(f"n_{y}") * den >= F.col(f"n_{x}") * num)
    return near & (differ * (den + num) <= (F.col(f"n_{x}") + F.col(f"n_{y}")) * (den - num))


def _side(classes: DataFrame, side: str, key: str) -> DataFrame:
    return classes.select(F.col("uid").alias(key), F.col("n").alias(f"n_{side}"), *(F.col(f"bits{i}").alias(f"bits{i}_{side}") for i in range(BITMAP)))


def able_pairs(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (u, v) of classes that sizes and bitmaps allow to link."""
    return pairs.join(_side(classes, "x", "u"), "u").join(_side(classes, "y", "v"), "v").where(may_link("x", "y", num, den)).select("u", "v")


def confirmed(able: DataFrame, rows: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """Those of the pairs (u, v) of classes that link, on the full sets; None where there is no pair."""
    able = stored(able, "candidates")
    if able.isEmpty():
        dropped(able)
        return None
    uids = able.select(F.col("u").alias("uid")).unionAll(able.select(F.col("v").alias("uid"))).distinct()
    wanted = stored(uids.join(classes.select("uid", "digest", "id"), "uid"), "wanted")
    sets = stored(_sets(rows, wanted, k), "confirming")
    both = able.join(sets.select(F.col("uid").alias("v"), F.col("tokens").alias("tv")), "v").join(sets.select(F.col("uid").alias("u"), F.col("tokens").alias("tu")), "u")
    found = stored(map_arrow(both.select("u", "v", "tu", "tv"), _linked(num, den), "u long, v long"), "links")
    for t in (able, wanted, sets):
        dropped(t)
    return found


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """label (uid, component) of all classes with links but the least of each component, with further links."""
    edges = links if label is None else links.unionAll(label.select("uid", "component"))
    out = stars(edges).withColumnsRenamed({"u": "uid", "v": "component"})
    for t in (links, *([] if label is None else [label])):
        dropped(t)
    return out


def _placed(rest: DataFrame, label: DataFrame | None, taken: int) -> DataFrame:
    """(bucket, uid, component, center) of buckets (bucket, uid) that hold several components; centers are the first
    `taken` classes outside the bucket's largest component."""
    if label is None:
        placed = rest.withColumn("component", F.col("uid"))
    else:
        placed = rest.join(label, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    # Dealt by bucket once, for all windows.
    placed = placed.select("bucket", "uid", "component").repartition("bucket").withColumn("n", F.count("*").over(Window.partitionBy("bucket", "component")))
    whole = Window.partitionBy("bucket")
    placed = placed.withColumns({"low": F.min("component").over(whole), "main": F.max(F.struct("n", "component")).over(whole)["component"], "high": F.max("component").over(whole)})
    stray = F.col("component") != F.col("main")
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy(F.when(stray, 0).otherwise(1), "uid"))
    return placed.where("low <> high").select("bucket", "uid", "component", (stray & (turn <= taken)).alias("center"))


def class_components(rows: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """(uid, component) of the classes that link but the least of each component; rows: id, text; classes: uid, digest, id, n, bits0.., keys.

    After the first round a bucket's classes are those of its largest component there and strays. Strays become
    centers, STRAYS and then WIDER times as many, each compared with all of the bucket that are not in its
    component, and leave the bucket; it is done when one component is left in it.
    """
    members = classes.select("uid", F.explode("keys").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("uid").alias("center"), F.count("*").alias("size")).where("size > 1")
    met = stored(members.join(heads, "bucket").where("uid <> center"), "met")
    links = confirmed(able_pairs(met.select(*_ordered("uid", "center")).distinct(), classes, num, den), rows, classes, k, num, den)
    label = None if links is None else _joined(None, links)
    rest, taken = met.where("size > 2").select("bucket", "uid"), STRAYS
    while True:
        # Sizes and bitmaps travel with the few open buckets' classes, so what cannot link is never a row.
        open_ = stored(_placed(rest, label, taken).join(_side(classes, "x", "uid"), "uid"), "open")
        if open_.isEmpty():
            dropped(open_)
            return label
        centers = open_.where("center").select("bucket", F.col("uid").alias("other"), F.col("component").alias("of_other"), *(F.col(f"{c}_x").alias(f"{c}_y") for c in ("n", *(f"bits{i}" for i in range(BITMAP)))))
        pairs = open_.join(centers, "bucket").where((F.col("component") != F.col("of_other")) & may_link("x", "y", num, den)).select(*_ordered("uid", "other")).distinct()
        links = confirmed(pairs, rows, classes, k, num, den)
        label = label if links is None else _joined(label, links)
        rest = open_.where("not center").select("bucket", "uid")
        taken *= WIDER


def near_duplicates(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_shingles, component_id and kept.

    Sets link when den * |A & B| >= num * |A | B|. A text without words (null, empty, only white space)
    has no shingles and links with nothing. component_id is the smallest id of the component, null if it
    holds null ids only; kept says whether a row's id is that (null like null). Rows that share an id
    stay rows of their own; an empty table gives no rows; other columns are not read.
    """
    bounded(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bits = [f"bits{i}" for i in range(BITMAP)]
    signed = stored(map_arrow(rows, _signed(k), f"id long, n long, digest binary, {', '.join(f'{b} long' for b in bits)}, keys array<long>"), "signed")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least")
    named = signed.where("n > 0").groupBy("digest").agg(least)
    own = signed.where(F.col("keys").isNotNull()).groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n", *bits, "keys")))
    numbered = own.join(named, "digest").withColumn("uid", F.monotonically_increasing_id())
    classes = stored(numbered.select("uid", "digest", "least", F.col("least.id").alias("id"), "n", *bits, "keys"), "classes")
    label = class_components(rows, classes, k, num, den)
    placed = classes.select("digest", "least", "uid") if label is None else classes.select("digest", "least", "uid").join(label, "uid", "left")
    placed = placed.withColumn("component", F.coalesce("component", "uid") if label is not None else F.col("uid"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("of_all"))
    of_class = stored(placed.join(smallest, "component").select("digest", F.col("of_all.id").alias("component_id")), "components")
    named = signed.where("n > 0").select("id", "n", "digest").join(of_class, "digest").select("id", "n", "component_id")
    alone = signed.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return named.unionAll(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept, as near_duplicates() says."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=4, num=80, den=100)


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_hold AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y FROM both_hold JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, least) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT e.y, r.least FROM reached r JOIN edges e ON e.x = r.doc_id WHERE r.least < e.y),
c AS (SELECT doc_id, min(least) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
