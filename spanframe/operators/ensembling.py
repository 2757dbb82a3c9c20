"""Models' outputs on a common word grid, as DataFrames: tokens to words, emissions, spans; batches by length.

Tokens, words and cells are rows of a document id, a number within it and character bounds. They meet by the
id and by overlap, so nothing is compared across documents, and means are grouped sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.operators import decoding as D
from spanframe.operators.alignment import met


def grouped_words(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """tokens (doc_id, token, start, end) with `word`, its number in the document; empty tokens go.

    A token joins the word before it where the two touch and a letter or digit stands on both sides.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "token")
    # Stretches of 256 characters: a token looks up its own, and the text is not read up to its place.
    stretches = docs.select("doc_id", F.regexp_extract_all("text", F.lit("(?s).{1,256}"), F.lit(0)).alias("_s"))
    rows = tokens.where("start < end").join(stretches.hint("shuffle_hash"), "doc_id")
    at = lambda i: F.substring(F.coalesce(F.get("_s", F.shiftright(i, 8).cast("int")), F.lit("")), (i % 256 + 1).cast("int"), F.lit(1))
    sides = F.concat(at(F.col("start") - 1), at(F.col("start")))
    rows = rows.withColumn("inside", (F.col("start") > 0) & sides.rlike(r"^[\p{L}\p{N}]{2}$")).drop("_s")
    opens = ~(F.col("inside") & (F.lag("end").over(order) == F.col("start")))
    word = F.sum(F.coalesce(opens, F.lit(True)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.select("doc_id", "token", "start", "end", word.alias("word"))


def _share(begin: Column, inside: Column) -> Column:
    return F.when(begin + inside > 0, begin / (begin + inside)).otherwise(0.0)


def word_emissions(tokens: DataFrame, words: DataFrame, classes: int) -> DataFrame:
    """(doc_id, word, probs): tag probabilities (O, then B and I of each type) of words from those of tokens.

    tokens: doc_id, token, start, end, probs; words: doc_id, word, start, end, of any model's grid. A token counts
    for every word that it overlaps. A type's mass is the mean over a word's tokens, dealt to B and I as on the
    first of them; none goes to B where that token began before the word. Words that no token meets are O.
    """
    grid = words.select("doc_id", "word", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    rows = met(grid, tokens.where("start < end").select("doc_id", "token", "start", "end", "probs"))
    mean = lambda c: F.aggregate("met", F.lit(0.0), lambda a, t: a + F.get(t["probs"], F.lit(c))) / F.size("met")
    first = F.array_min(F.transform("met", lambda t: F.struct(t["start"].alias("start"), t["token"].alias("token"), t["probs"].alias("probs"), (t["start"] >= F.col("t_start")).alias("whole"))))
    by_word = rows.select("doc_id", "word", F.when(F.size("met") > 0, F.array(*map(mean, range(classes)))).alias("mean"), F.when(F.size("met") > 0, first).alias("first"))

    def dealt(c: int) -> Column:
        begin, mass = c - (c + 1) % 2, F.get("mean", F.lit(c - (c + 1) % 2)) + F.get("mean", F.lit(c - (c + 1) % 2 + 1))
        share = F.when(F.col("first.whole"), _share(F.get("first.probs", F.lit(begin)), F.get("first.probs", F.lit(begin + 1)))).otherwise(0.0)
        return mass * (share if c % 2 else 1 - share)

    probs = F.array(F.get("mean", F.lit(0)), *(dealt(c) for c in range(1, classes)))
    outside = F.array(*(F.lit(float(c == 0)) for c in range(classes)))
    return by_word.select("doc_id", "word", F.when(F.col("mean").isNull(), outside).otherwise(probs).alias("probs"))


#: Pairs of a word and a token that are looked at together.
PAIRS = 4_000_000


def emissions(words: tuple[np.ndarray, ...], tokens: tuple[np.ndarray, ...], probs: np.ndarray) -> np.ndarray:
    """word_emissions() for many documents at a time: a row of probabilities for each word.

    words: document, start and end of each; tokens alike, in the order of document, start and number; probs: a row a token.
    """
    some = tokens[1] < tokens[2]
    (at, w_start, w_end), (of, start, end), probs = words, (x[some] for x in tokens), probs[some]
    out = np.zeros((len(at), probs.shape[1]))
    out[:, 0] = 1
    if not len(of) or not len(at):
        return out
    # Documents side by side: what a word meets lies between the first token that reaches past its start and the last before its end.
    far = int(max(end.max(), w_end.max(), w_start.max())) + 1
    ends = of * far + end
    reach = np.maximum.accumulate(ends)
    low = np.searchsorted(reach, at * far + w_start, "right")
    n = np.maximum(np.searchsorted(of * far + start, at * far + w_end, "left") - low, 0)
    nested = bool((reach != ends).any())
    upto = np.cumsum(n)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - n[a] + PAIRS, "right")))
        word = np.repeat(np.arange(b - a), n[a:b])
        token = np.arange(len(word)) - np.repeat(upto[a:b] - n[a:b] - (upto[a] - n[a]) - low[a:b], n[a:b])
        if nested:
            over = end[token] > w_start[a + word]
            word, token = word[over], token[over]
        count = np.bincount(word, minlength=b - a)
        met = np.flatnonzero(count)
        first = token[(np.cumsum(count) - count)[met]]
        mean = [np.bincount(word, weights=probs[token, c], minlength=b - a)[met] / count[met] for c in range(probs.shape[1])]
        whole = start[first] >= w_start[a + met]
        out[a + met, 0] = mean[0]
        for c in range(1, probs.shape[1], 2):
            begin, both = probs[first, c], probs[first, c] + probs[first, c + 1]
            share = np.where(whole & (both > 0), begin / np.where(both > 0, both, 1), 0.0)
            out[a + met, c] = (mean[c] + mean[c + 1]) * share
            out[a + met, c + 1] = (mean[c] + mean[c + 1]) * (1 - share)
        a = b
    return out


def cells_on_words(cells: DataFrame, own: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """A model's span cells on another grid: (doc_id, first, last, probs), where the span has at most `width` words.

    cells: doc_id, first, last (words of its own grid), probs; own and words: doc_id, word, start, end. A cell goes
    from the first word that its first meets to the last that its last meets; cells that meet none are left out,
    and cells that share a place there keep the one with the least chance of being no span.
    """
    a = own.select("doc_id", F.col("word").alias("mine"), F.col("start").alias("a"), F.col("end").alias("b"))
    met = a.join(words, "doc_id").where((F.col("a") < F.col("end")) & (F.col("start") < F.col("b")))
    bounds = met.groupBy("doc_id", "mine").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    left = bounds.select("doc_id", F.col("mine").alias("first"), F.col("low").alias("to_first"))
    right = bounds.select("doc_id", F.col("mine").alias("last"), F.col("high").alias("to_last"))
    placed = cells.join(left, ["doc_id", "first"]).join(right, ["doc_id", "last"]).where((F.col("to_first") <= F.col("to_last")) & (F.col("to_last") - F.col("to_first") < width))
    return placed.groupBy("doc_id", F.col("to_first").alias("first"), F.col("to_last").alias("last")).agg(F.min("probs").alias("probs"))


def combined(parts: Sequence[tuple[DataFrame, float]], keys: Sequence[str], classes: int) -> DataFrame:
    """keys and probs: the mean, by weight, of models' rows of the same keys; a row that a model lacks is none of the classes but the first there."""
    total = sum(w for _, w in parts)
    rows = None
    for df, weight in parts:
        own = df.select(*keys, "probs", F.lit(float(weight)).alias("weight"))
        rows = own if rows is None else rows.unionAll(own)
    sums = [F.sum(F.get("probs", F.lit(c)) * F.col("weight")) for c in range(classes)]
    missing = F.lit(float(total)) - F.sum("weight")
    return rows.groupBy(*keys).agg(F.array((sums[0] + missing) / total, *(s / total for s in sums[1:])).alias("probs"))


#: Decimals of averaged probabilities.
DIGITS = 9


def averaged_cells(tags: pa.Array, cells: pa.Array, width: int, classes: int, weights: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """combined() for the documents of a batch: the cells of a span model and those of tag probabilities, averaged.

    tags: of each document its words' probabilities; cells: its (first, last, probs). Documents lie side by side with
    an empty word between them, which no span enters. Gives (document, first word, words after it, probabilities) in
    order; cells of the first model that begin off the words or have more than `width` are left out.
    """
    n = pc.fill_null(pc.list_value_length(tags), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.cumsum(n + 1) - (n + 1)
    doc = np.repeat(np.arange(len(n)), n + 1)
    left = n[doc] - (np.arange(len(doc)) - base[doc])  # words from here to the document's end
    grid = np.zeros((len(doc), classes))
    grid[left > 0] = np.reshape(tags.flatten().flatten().to_numpy(zero_copy_only=False), (-1, classes))
    mass = D.tag_bands(grid[None], width)[0]
    fits = np.arange(width) < left[:, None]
    weight = weights[1] * fits
    mass *= weight[..., None]
    own = cells.flatten()
    first, last = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last"))
    probs = np.reshape(own.field("probs").flatten().to_numpy(zero_copy_only=False), (-1, mass.shape[-1]))
    of = np.repeat(np.arange(len(n)), pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False))
    some = (first >= 0) & (first < n[of]) & (last >= first) & (last - first < width)
    place = base[of[some]] + first[some], (last - first)[some]
    np.add.at(mass, place, weights[0] * probs[some])
    np.add.at(weight, place, weights[0])
    total = sum(weights)
    mass[..., 0] += total - weight
    at, k = np.nonzero(weight)
    return doc[at], at - base[doc[at]], k, np.round(mass[at, k] / total, DIGITS)


def document_masses(df: DataFrame, width: int, classes: int, weights: tuple[float, float]) -> DataFrame:
    """(doc_id, n, mass): how many averaged cells each document (doc_id, tags, cells) has, and their sum by class."""

    def run(batches):
        for b in batches:
            for part in D.together(b, 1):
                doc, _, _, probs = averaged_cells(part.column(1), part.column(2), width, classes, weights)
                n = np.bincount(doc, minlength=part.num_rows)
                mass = np.stack([np.bincount(doc, weights=p, minlength=part.num_rows) for p in probs.T], 1)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(n[some], pa.int64()), pa.array(list(mass[some]), pa.list_(pa.float64()))], names=["doc_id", "n", "mass"])

    return df.select("doc_id", "tags", "cells").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n long, mass array<double>")


def decode_documents(df: DataFrame, types: tuple[str, ...], width: int, weights: tuple[float, float], mode: str = "greedy", none: float = 1.0, scales: Mapping[str, float] | None = None) -> DataFrame:
    """decode_cells() of averaged cells for rows of whole documents (doc_id, text, start, end, tags, cells), which stay where they are.

    start and end: of each word; tags: its probabilities; cells: the other model's (first, last, probs). weights: of
    the cells and of the tags. A null list is empty.
    """
    names, factor = sorted(types), D.class_factors(types, none, scales)

    def run(batches):
        for b in batches:
            for part in D.together(b, 4):
                doc, first, k, probs = averaged_cells(part.column(4), part.column(5), width, 2 * len(names) + 1, weights)
                lengths = pc.fill_null(pc.list_value_length(part.column(4)), 0).to_numpy(zero_copy_only=False)
                both = np.stack([part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3)], 1)
                bounds = np.split(both, np.cumsum(lengths)[:-1])
                yield D.spans_of(part.column(0), part.column(1), lengths.tolist(), bounds, (doc, first, k, probs * factor), names, width, mode)

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text", "start", "end", "tags", "cells").mapInArrow(run, f"doc_id {kind}, start long, end long, label string")


def check_label_sets(models: dict[str, Sequence[str]]) -> tuple[str, ...]:
    """The label set that all models have; raises with the differences where they have not one."""
    sets = {name: frozenset(labels) for name, labels in models.items()}
    every = frozenset().union(*sets.values())
    lacking = {name: sorted(every - own) for name, own in sets.items() if own != every}
    if lacking:
        raise ValueError(f"models lack labels: {lacking}")
    return tuple(sorted(every))


def length_batches(lengths: list[int], rows: int, padded: int) -> list[list[int]]:
    """Row numbers, longest first, in batches within a row and a padded-size bound; what is over it stands alone."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    out: list[list[int]] = []
    for i in order:
        top = lengths[out[-1][0]] if out else 0
        if out and len(out[-1]) < rows and top * (len(out[-1]) + 1) <= padded:
            out[-1].append(i)
        else:
            out.append([i])
    return out
