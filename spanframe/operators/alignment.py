"""Spans against tokens: BIO and BIOES tags, word grids, surfaces."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.constants import PROMPT_APOSTROPHES
from spanframe.functions.text import let


#: Characters of a place as a power of two, and of spans that stand in a list of their own.
PLACE, WIDE = 6, 4096


def places(start: Column, end: Column) -> Column:
    """The numbers of the stretches of 2^PLACE characters that bounds touch; those of an empty span's start."""
    return F.sequence(F.shiftright(start, PLACE), F.shiftright(F.greatest(end - 1, start), PLACE))


def met(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens (doc_id, t_start, t_end) and `met`, the array of the spans (doc_id, start, end; their other columns too) that
    they overlap; null or empty without any.

    A document's spans come to its tokens as one row, laid by the places they touch, so tokens stay where they are and
    are not sorted, and each looks at the spans around it. Spans over WIDE characters stand in a list.
    """
    s = F.struct(*(c for c in spans.columns if c != "doc_id"))
    wide = F.col("end") - F.col("start") > WIDE
    at = spans.where(~wide).select("doc_id", F.explode(places(F.col("start"), F.col("end"))).alias("_at"), s.alias("_s"))
    near = at.groupBy("doc_id", "_at").agg(F.collect_list("_s").alias("_s")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_s"))).alias("_near"))
    far = spans.where(wide).groupBy("doc_id").agg(F.collect_list(s).alias("_far"))
    laid = near.join(far, "doc_id", "full_outer")
    rows = tokens.join(laid.hint("shuffle_hash"), "doc_id", "left")
    own, last = F.shiftright("t_start", PLACE), F.shiftright(F.greatest(F.col("t_end") - 1, F.col("t_start")), PLACE)
    over = lambda x: (F.col("t_start") < x["end"]) & (x["start"] < F.col("t_end"))
    here = lambda i: F.try_element_at("_near", i)
    # A pair that shares several places counts at the first of them.
    several = F.flatten(F.transform(places(F.col("t_start"), F.col("t_end")), lambda i: F.filter(F.coalesce(here(i), F.array().cast(laid.schema["_far"].dataType)), lambda x: F.greatest(F.shiftright(x["start"], PLACE), own) == i)))
    found = F.when(F.col("_near").isNotNull(), F.filter(F.when(own == last, here(own)).otherwise(several), over))
    both = F.when(F.col("_far").isNull(), found).otherwise(F.concat(F.coalesce(found, F.array().cast(laid.schema["_far"].dataType)), F.filter("_far", over)))
    return rows.select(*tokens.columns, both.alias("met"))


def overlapping(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens (doc_id, pos, t_start, t_end) with the spans (doc_id, start, end, label) they overlap."""
    return met(tokens, spans).where(F.size("met") > 0).select(*tokens.columns, F.inline("met"))


def bio_tags(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, pos, tag: the first token that a span overlaps begins it, the rest are inside; others O."""
    first = overlapping(tokens, spans).groupBy("doc_id", "start", "end", "label").agg(F.min("pos").alias("first"))
    tag = F.transform("met", lambda s: F.struct(s["start"].alias("start"), F.concat(F.when(s["first"] == F.col("pos"), "B-").otherwise("I-"), s["label"]).alias("tag")))
    return met(tokens.select("doc_id", "pos", "t_start", "t_end"), first).select("doc_id", "pos", F.coalesce(F.array_max(tag)["tag"], F.lit("O")).alias("tag"))


def begun(tokens: tuple[np.ndarray, ...], spans: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """bio_tags() for many documents at a time: each token's span (its place, -1 for O) and whether it begins it.

    tokens: document, start and end of each, none empty, in order: neither starts nor ends fall within a document;
    spans: document, start, end and label, whose order is that of the labels' names.
    """
    (of, start, end), (at, s_start, s_end, label) = tokens, spans
    far = int(max(end.max(initial=0), s_end.max(initial=0))) + 1
    low = np.searchsorted(of * far + end, at * far + s_start, "right")
    n = np.maximum(np.searchsorted(of * far + start, at * far + s_end, "left") - low, 0)
    span = np.repeat(np.arange(len(at)), n)
    token = np.arange(len(span)) + np.repeat(low - (np.cumsum(n) - n), n)
    begins = token == low[span]
    # The last by start and by tag, B- before I-, counts.
    order = np.lexsort((label[span], ~begins, s_start[span], token))
    span, token, begins = span[order], token[order], begins[order]
    top = np.append(token[1:] != token[:-1], True)[: len(token)]
    own, first = np.full(len(of), -1), np.zeros(len(of), bool)
    own[token[top]], first[token[top]] = span[top], begins[top]
    return own, first


def covering_tags(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, pos, tag: a token that holds the first character of the span it overlaps (the first of several) begins
    it, others are inside, or O; null for empty tokens."""
    begins = lambda s: (F.col("t_start") <= s["start"]) & (s["start"] < F.col("t_end"))
    tag = lambda s: F.concat(F.when(begins(s), "B-").otherwise("I-"), s["label"]).alias("tag")
    tags = F.transform("met", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), tag(s)))
    found = F.when(F.col("t_end") > F.col("t_start"), F.coalesce(F.array_min(tags)["tag"], F.lit("O")))
    return met(tokens, spans).select("doc_id", "pos", found.alias("tag"))


def truncated(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, truncated: whether the text, but for white space at its end, goes on after its last token; null texts do not."""
    covered = tokens.groupBy("doc_id").agg(F.max("t_end").alias("_end"))
    whole = F.length(F.regexp_replace("text", r"[\s\p{Z}]+$", ""))
    j = docs.select("doc_id", whole.alias("_whole")).join(covered, "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.coalesce("_end", F.lit(0)) < F.col("_whole"), F.lit(False)).alias("truncated"))


def alignment_counts(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document: n_misaligned (an edge off the token edges, or nothing met inside covered text), n_lost (beyond it)."""
    hit = overlapping(tokens, spans).groupBy("doc_id", "start", "end", "label").agg(F.min("t_start").alias("a"), F.max("t_end").alias("b"))
    covered = tokens.groupBy("doc_id").agg(F.max("t_end").alias("covered"))
    j = spans.join(covered, "doc_id", "left").join(hit, ["doc_id", "start", "end", "label"], "left")
    lost = F.col("a").isNull() & (F.col("start") >= F.coalesce("covered", F.lit(0)))
    off = (F.col("a").isNull() & ~lost) | (F.col("a") != F.col("start")) | (F.col("b") != F.col("end"))
    return j.groupBy("doc_id").agg(F.count_if(off).alias("n_misaligned"), F.count_if(lost).alias("n_lost"))


def decode_tags(tags: Column, orphans: bool = True) -> Column:
    """array of struct(first, last, label) of BIO or BIOES tags, in order.

    orphans: an inside tag without its own run opens one (else it is ignored).
    """
    marked = F.transform(tags, lambda t: F.struct(F.substring(t, 1, 1).alias("prefix"), F.regexp_extract(t, "^[A-Z]-(.*)$", 1).alias("label")))
    kinds = ("B", "S", "I", "E")

    def runs(m):
        def goes_on(i):
            own, before = F.get(m, i), F.get(m, i - 1)
            return F.coalesce(own["prefix"].isin("I", "E") & before["prefix"].isin(*kinds) & (own["label"] == before["label"]), F.lit(False))

        # What begins here goes on to the next place that does not go on.
        heads = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: ~goes_on(i))
        each = let(heads, lambda h: F.transform(h, lambda first, j: F.struct(first.alias("first"), (F.coalesce(F.get(h, j + 1), F.size(m)) - 1).alias("last"), F.get(m, first)["label"].alias("label"))))
        return F.filter(each, lambda r: F.coalesce(F.get(m, r["first"])["prefix"].isin(*(kinds if orphans else kinds[:2])), F.lit(False)))

    return F.when(F.size(tags) > 0, let(marked, runs)).when(tags.isNotNull(), F.array().cast("array<struct<first:int,last:int,label:string>>"))


def word_bounds(words: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """First word and width of each span on the word grid (doc_id, pos, t_start, t_end); wider ones are lost."""
    hit = overlapping(words, spans).groupBy("doc_id", "start", "end", "label").agg(F.min("pos").alias("first"), (F.max("pos") - F.min("pos")).alias("k"))
    return hit.withColumn("lost", F.col("k") >= width)


def placed(text: str, items: list[tuple[str, str]], labels: Sequence[str]) -> list[tuple[int, int, str]]:
    """Spans of surfaces named in order: each at its first free place, exact, with folded apostrophes, then caseless.

    Places once taken stay taken, so a surface's search goes on from its last place: a text is read once for each
    different surface.
    """
    folded = text.translate(_FOLD)
    hays = (text, folded, _lower(folded))
    starts: list[int] = []
    ends: list[int] = []
    since: dict[tuple[int, str], int] = {}
    out = []
    for surface, label in items:
        surface, label = (surface or "").strip(" "), (label or "").upper()
        if not surface or label not in labels:
            continue
        plain = surface.translate(_FOLD)
        for kind, needle in enumerate((surface, plain, _lower(plain))):
            at = hays[kind].find(needle, since.get((kind, needle), 0))
            while at >= 0:
                i = bisect_right(starts, at)
                if (not i or ends[i - 1] <= at) and (i == len(starts) or starts[i] >= at + len(needle)):
                    break
                at = hays[kind].find(needle, at + 1)
            since[kind, needle] = len(text) + 1 if at < 0 else at
            if at >= 0:
                starts.insert(i, at)
                ends.insert(i, at + len(needle))
                out.append((at, at + len(needle), label))
                break
    return sorted(out)


_FOLD = {ord(c): "'" for c in PROMPT_APOSTROPHES}


def _lower(text: str) -> str:
    """Lower case where that is one character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def align_surfaces(df: DataFrame, labels: Sequence[str], text_col: str = "text", items_col: str = "items") -> DataFrame:
    """df and spans (array of struct start, end, type) of items (array of struct text, label) as placed() finds them.

    Unknown labels and surfaces that are not found are dropped; a null text or list has no spans.
    """
    kind = pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "type": pa.string()}))
    names = df.columns

    def run(batches):
        for b in batches:
            rows = zip(b.column(names.index(text_col)).to_pylist(), b.column(names.index(items_col)).to_pylist(), strict=True)
            found = [[{"start": s, "end": e, "type": t} for s, e, t in placed(text or "", [(i["text"], i["label"]) for i in items or []], labels)] for text, items in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*names, "spans"])

    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return df.mapInArrow(run, f"{schema}, spans array<struct<start:int,end:int,type:string>>")
