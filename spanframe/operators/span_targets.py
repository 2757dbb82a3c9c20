"""Training targets of spans on a band of words by widths, and losses against them, as columns and grouped sums.

A cell (word, k) is the span of k + 1 words from a word on. Gold spans are few among a document's words x width
cells, so targets stay sparse (one row a cell that is not plainly none) until a word's row needs all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.text import let
from spanframe.operators.alignment import word_bounds

#: Class of cells and tokens that take no part in a loss.
IGNORE = -100


def gold_cells(words: DataFrame, spans: DataFrame, types: Sequence[str], width: int) -> DataFrame:
    """(doc_id, word, k, target): the class of each gold span's cell, 1 + its type's place among sorted types.

    words: doc_id, pos, t_start, t_end; spans: doc_id, start, end, label. Spans wider than `width`, of other labels
    or without words have none; of spans in one cell the last by start, end and label counts.
    """
    number = F.array_position(F.array(*map(F.lit, sorted(types))), F.col("label")).cast("int")
    at = word_bounds(words, spans, width).where(~F.col("lost")).withColumn("target", number).where("target > 0")
    return at.groupBy("doc_id", F.col("first").alias("word"), "k").agg(F.max_by("target", F.struct("start", "end", "label")).alias("target"))


def cell_targets(words: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """(doc_id, word, targets): `width` classes for each word (doc_id, pos, numbered from 0 without gaps): 0 none,
    IGNORE where the span would leave the document."""
    n = words.groupBy("doc_id").agg(F.count("*").alias("n"))
    own = cells.groupBy("doc_id", "word").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), "target"))).alias("own"))
    rows = words.select("doc_id", F.col("pos").alias("word")).join(n, "doc_id").join(own, ["doc_id", "word"], "left")

    def target(k: Column) -> Column:
        return F.when(F.col("word") + k >= F.col("n"), F.lit(IGNORE)).otherwise(F.coalesce(F.try_element_at("own", k), F.lit(0)))

    return rows.select("doc_id", "word", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), target).alias("targets"))


def shifts(distance: int) -> list[tuple[int, int]]:
    """(di, dk) of cells whose edges are 1 to `distance` words away together."""
    span = range(-distance, distance + 1)
    return [(i, j - i) for i in span for j in span if 0 < abs(i) + abs(j) <= distance]


def smoothed_targets(cells: DataFrame, lengths: DataFrame, types: Sequence[str], width: int, epsilon: float, distance: int = 1) -> DataFrame:
    """(doc_id, word, k, target array<double>) of the cells that gold cells (doc_id, word, k, target) reach.

    A gold cell gives epsilon of its mass to the cells of the document (lengths: doc_id, n words) whose edges are at
    most `distance` words away together, alike, and keeps the rest; all, if there are none. What types leave of a
    cell is none (not below 0), and the whole is brought to 1. Every cell that is not listed is plainly none.
    """
    placed = cells.join(lengths, "doc_id")
    near = F.array(*(F.struct((F.col("word") + i).alias("word"), (F.col("k") + d).alias("k")) for i, d in shifts(distance)))
    inside = F.filter(near, lambda c: (c["word"] >= 0) & (c["k"] >= 0) & (c["k"] < width) & (c["word"] + c["k"] < F.col("n")))
    placed = placed.withColumn("near", inside)
    given = F.transform("near", lambda c: F.struct(c["word"].alias("word"), c["k"].alias("k"), (F.lit(float(epsilon)) / F.size("near")).alias("mass")))
    kept = F.struct("word", "k", F.when(F.size("near") > 0, 1 - epsilon).otherwise(1.0).alias("mass"))
    spread = placed.select("doc_id", "target", F.inline(F.concat(F.array(kept), given)))
    mass = [F.sum(F.when(F.col("target") == c, F.col("mass")).otherwise(0.0)).alias(f"_{c}") for c in range(1, len(types) + 1)]
    sums = spread.groupBy("doc_id", "word", "k").agg(*mass)
    typed = [F.col(f"_{c}") for c in range(1, len(types) + 1)]
    of_types = sum(typed[1:], typed[0])
    none = F.greatest(F.lit(0.0), 1 - of_types)
    return sums.select("doc_id", "word", "k", F.array(*(x / (none + of_types) for x in (none, *typed))).alias("target"))


def log_softmax(scores: Column) -> Column:
    def told(top):
        total = F.log(F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
        return let(total, lambda t: F.transform(scores, lambda x: x - top - t))

    return let(F.array_max(scores), told)  # each once for all scores


def cross_entropy(scores: Column, target: Column) -> Column:
    """Of a distribution (target array<double>) against log_softmax of scores."""
    parts = F.zip_with(target, log_softmax(scores), lambda t, x: t * x)
    return -F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def class_cross_entropy(scores: Column, target: Column) -> Column:
    """Of a class; null where it is IGNORE."""
    return F.when(target != IGNORE, -F.get(log_softmax(scores), target))


def focal(scores: Column, target: Column, gamma: float = 2.0) -> Column:
    """(1 - p)^gamma times the cross-entropy, p the target's probability; null where it is IGNORE."""
    loss = class_cross_entropy(scores, target)
    return F.pow(1 - F.exp(-loss), F.lit(float(gamma))) * loss


def class_weight(weights: Sequence[float], target: Column) -> Column:
    return F.when(target != IGNORE, F.get(F.array(*map(F.lit, map(float, weights))), target))


def reduced(loss: Column, reduction: str, weight: Column | None = None) -> Column:
    """An aggregate of losses: sum or mean of those that are not null, a mean by weights over their sum; an error where all are ignored."""
    if reduction not in ("sum", "mean"):
        raise ValueError(f"reduction: {reduction}")
    total = F.sum(loss if weight is None else loss * weight)
    if reduction == "mean":
        total = total / (F.count(loss) if weight is None else F.greatest(F.sum(F.when(loss.isNotNull(), weight)), F.lit(1e-8)))
    return F.when(F.count(loss) == 0, F.raise_error(F.lit("all targets are ignored"))).otherwise(total)


def span_losses(scores: DataFrame, targets: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc_id, loss, n): the sum of cross-entropies over a document's cells, and how many these are.

    scores: doc_id, word, k, scores; targets: doc_id, word, k, target as smoothed_targets() gives them; cells that leave the
    document (lengths: doc_id, n) are ignored. Sums add up: a mean over documents is sum(loss) / sum(n).
    """
    inside = scores.join(lengths.select("doc_id", F.col("n").alias("_n")).hint("shuffle_hash"), "doc_id").where(F.col("word") + F.col("k") < F.col("_n"))
    # A document's few targets come to its cells as one row, so cells stay where they are.
    by_word = targets.groupBy("doc_id", "word").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), "target"))).alias("own"))
    own = by_word.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "own"))).alias("_own"))
    target = F.try_element_at(F.try_element_at("_own", F.col("word")), F.col("k").cast("int"))
    met = inside.join(own.hint("shuffle_hash"), "doc_id", "left").withColumn("target", target)
    loss = F.when(F.col("target").isNull(), -F.get(log_softmax(F.col("scores")), F.lit(0))).otherwise(cross_entropy(F.col("scores"), F.col("target")))
    return met.groupBy("doc_id").agg(F.sum(loss).alias("loss"), F.count("*").alias("n"))


def smoothed_grid(words: tuple[np.ndarray, ...], spans: tuple[np.ndarray, ...], types: int, width: int, epsilon: float, distance: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """smoothed_targets() of gold_cells() for many documents at a time: (inside, cells, targets).

    words: document, start and end of each, in order, neither starts nor ends falling within a document; spans: document,
    start, end and class (from 1, in the order of the types' names). inside: words x width, whether a cell is one of its
    document; cells: the places in that grid (word * width + k) that gold reaches, targets their distributions.
    """
    (of, w_start, w_end), (at, start, end, kind) = words, spans
    n = np.bincount(of, minlength=int(at.max(initial=-1)) + 1)
    last = np.cumsum(n)[of] - 1
    left = last - np.arange(len(of)) + 1  # words from here to the document's end
    inside = np.arange(width) < left[:, None]
    far = int(max(w_end.max(initial=0), end.max(initial=0))) + 1
    low = np.searchsorted(of * far + w_end, at * far + start, "right")
    k = np.searchsorted(of * far + w_start, at * far + end, "left") - 1 - low
    some = (k >= 0) & (k < width)
    order = np.lexsort((kind[some], end[some], start[some], k[some], low[some]))
    low, k, kind = (x[some][order] for x in (low, k, kind))
    top = np.append((low[1:] != low[:-1]) | (k[1:] != k[:-1]), True)[: len(low)]  # of spans in one cell the last
    low, k, kind = low[top], k[top], kind[top]
    first = last[low] + 1 - n[of[low]]
    near = []
    for i, d in shifts(distance):
        w, j = low + i, k + d
        near.append(((w >= first) & (j >= 0) & (j < width) & (w + j <= last[low]), w * width + j))
    m = sum((ok.astype(np.int64) for ok, _ in near), np.zeros(len(low), np.int64))
    place = np.concatenate([low * width + k, *(p[ok] for ok, p in near)])
    mass = np.concatenate([np.where(m > 0, 1 - epsilon, 1.0), *(epsilon / m[ok] for ok, _ in near)])
    cells, own = np.unique(place, return_inverse=True)
    out = np.zeros((len(cells), types + 1))
    np.add.at(out, (own, np.concatenate([kind, *(kind[ok] for ok, _ in near)])), mass)
    out[:, 0] = np.maximum(0.0, 1 - out[:, 1:].sum(1))
    return inside, cells, out / out.sum(1, keepdims=True)


def grid_losses(of: np.ndarray, scores: np.ndarray, inside: np.ndarray, cells: np.ndarray, targets: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """span_losses() against smoothed_grid(): the sum of each document's cross-entropies, and how many cells it has.

    of: each word's document; scores: words x width x classes.
    """
    top = scores.max(-1)
    total = np.log(np.exp(scores - top[..., None]).sum(-1)) + top
    loss = total - scores[..., 0]  # plainly none
    width = inside.shape[1]
    w, k = cells // width, cells % width
    loss[w, k] = (targets * (total[w, k][:, None] - scores[w, k])).sum(1)
    return np.bincount(of, weights=(loss * inside).sum(1), minlength=documents), np.bincount(of, weights=inside.sum(1), minlength=documents).astype(np.int64)
