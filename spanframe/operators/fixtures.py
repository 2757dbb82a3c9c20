"""Span tables derived from documents: every capitalised word is a candidate entity.

k = (doc_id * 7 + pos) % 10 decides its part: absent from gold (3), missed (0), one character short (1),
of the next type (2) in the predictions; else right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.constants import LABELS

#: Bytes of text in a part of dealt documents: what is made of its words can be sorted in a task's memory.
PART_BYTES = 4_000_000
#: Documents whose words are found in one go.
TOGETHER = 500
NAMED = r"^\p{Lu}\p{Ll}{3,}$"
_WORDS = pa.list_(pa.struct({"pos": pa.int32(), "word": pa.string(), "start": pa.int64(), "end": pa.int64(), "before": pa.string()}))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_name(i):
    return F.element_at(F.array(*map(F.lit, LABELS)), (i + 1).cast("int"))


def parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of up to TOGETHER rows and about PART_BYTES / 4 bytes of text, a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        passed = size[a - 1] if a else 0
        b = min(a + TOGETHER, max(a + 1, int(np.searchsorted(size, passed + PART_BYTES // 4, "right"))))
        yield batch.slice(a, b - a)
        a = b


def bounds(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of the pieces between single spaces: row of the text, place in it, start and end; null texts have none."""
    lists = pc.split_pattern(texts, " ")
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    length = pc.utf8_length(pc.list_flatten(lists)).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(n) - n
    passed = np.append(0, np.cumsum(length + 1))
    row = np.repeat(np.arange(len(n)), n)
    start = passed[:-1] - passed[first[row]]
    return row, np.arange(len(row)) - first[row], start, start + length


def _placed(texts: pa.Array, shape: str | None) -> pa.Array:
    """Of each text the pieces between single spaces, all or those of a shape: place, word, start, end and the word before."""
    lists = pc.split_pattern(texts, " ")
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(lists)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(n) - n
    passed = np.append(0, np.cumsum(length + 1))
    doc = np.repeat(np.arange(len(n)), n)
    keep = np.arange(len(words)) if shape is None else np.flatnonzero(pc.match_substring_regex(words, shape).to_numpy(zero_copy_only=False))
    of = doc[keep]
    start = passed[keep] - passed[first[of]]
    before = words.take(pa.array(keep - 1, mask=(keep == first[of]))) if shape else pa.nulls(len(keep), pa.string())
    each = pa.StructArray.from_arrays([pa.array((keep - first[of]).astype(np.int32)), words.take(pa.array(keep)), pa.array(start), pa.array(start + length[keep]), before], fields=list(_WORDS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(n)))).astype(np.int32)), each)


def _words(text: str, shape: str | None = None) -> Column:
    @F.arrow_udf("array<struct<pos:int,word:string,start:bigint,end:bigint,before:string>>")
    def words(texts: pa.Array) -> pa.Array:
        parts = [_placed(texts.slice(i, TOGETHER), shape) for i in range(0, len(texts), TOGETHER)]
        return pa.concat_arrays(parts) if parts else pa.array([], _WORDS)

    return F.inline(words(text))


def _starts(text: str) -> Column:
    """Where the pieces between single spaces begin."""

    @F.arrow_udf("array<int>")
    def starts(texts: pa.Array) -> pa.Array:
        parts = [_placed(texts.slice(i, TOGETHER), None) for i in range(0, len(texts), TOGETHER)]
        each = [pa.ListArray.from_arrays(p.offsets, pc.struct_field(p.values, "start").cast(pa.int32())) for p in parts]
        return pa.concat_arrays(each) if each else pa.array([], pa.list_(pa.int32()))

    return starts(text)


def placed_words(docs: DataFrame) -> DataFrame:
    """doc_id, text, start and end of its pieces between single spaces, and the places of capitalised ones (`named`), as lists; null texts go."""

    @F.arrow_udf("array<int>")
    def named(texts: pa.Array) -> pa.Array:
        parts = [_placed(texts.slice(i, TOGETHER), NAMED) for i in range(0, len(texts), TOGETHER)]
        each = [pa.ListArray.from_arrays(p.offsets, pc.struct_field(p.values, "pos")) for p in parts]
        return pa.concat_arrays(each) if each else pa.array([], pa.list_(pa.int32()))

    rows = docs.where("text is not null").select("doc_id", "text", _starts("text").alias("start"), named("text").alias("named"))
    after = F.transform(F.slice("start", 2, F.greatest(F.size("start") - 1, F.lit(0))), lambda s: s - 1)
    return rows.withColumn("end", F.concat(after, F.array(F.length("text"))))


def dealt(docs: DataFrame) -> DataFrame:
    """doc_id, text and the starts of its pieces, dealt by id in as many parts as the texts need (PART_BYTES), the usual number at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    return docs.select("doc_id", "text", _starts("text").alias("starts")).repartition(parts, "doc_id")


def word_table(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word, start, end of the pieces between single spaces. Documents are dealt by id once; words are not."""
    each = F.posexplode(F.arrays_zip(F.split("text", " ").alias("word"), F.col("starts").alias("start"))).alias("pos", "w")
    rows = dealt(docs).where("text is not null").select("doc_id", each).select("doc_id", "pos", "w.word", F.col("w.start").cast("long").alias("start"))
    return rows.withColumn("end", F.col("start") + F.length("word"))


def named_words(docs: DataFrame, *keep: str) -> DataFrame:
    """The rows of word_table() of capitalised words of over three letters, with the word before (null at first) and the document's columns keep, found where the texts are read."""
    return docs.select("doc_id", *keep, _words("text", NAMED))


def candidates(docs: DataFrame) -> DataFrame:
    w = named_words(docs).drop("before")
    return w.withColumn("k", F.pmod(F.col("doc_id") * 7 + F.col("pos"), F.lit(10))).withColumn("lab", F.pmod(F.col("doc_id") + F.col("pos"), F.lit(3)))


def gold_spans(docs: DataFrame) -> DataFrame:
    return candidates(docs).where("k <> 3").select("doc_id", "start", "end", label_name(F.col("lab")).alias("label"))


def pred_spans(docs: DataFrame) -> DataFrame:
    end = F.when(F.col("k") == 1, F.col("end") - 1).otherwise(F.col("end"))
    lab = F.when(F.col("k") == 2, (F.col("lab") + 1) % 3).otherwise(F.col("lab"))
    return candidates(docs).where("k <> 0").select("doc_id", "start", end.alias("end"), label_name(lab).alias("label"))


def gold_of(ids: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """gold_spans() of texts at hand, in order: row of the text, start, end and the label's place in LABELS."""
    lists = _placed(texts, NAMED)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    pos, start, end = (pc.struct_field(lists.values, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "start", "end"))
    keep = (ids[row] * 7 + pos) % 10 != 3
    row, pos, start, end = (x[keep] for x in (row, pos, start, end))
    return row, start, end, (ids[row] + pos) % 3


def gold_lists(docs: DataFrame) -> DataFrame:
    """doc_id, text and the array of its gold spans as `entities` (label, start, end), in their order, where the texts are read."""

    def run(batches):
        for b in batches:
            for part in parts(b, 1):
                row, start, end, label = gold_of(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), part.column(1))
                order = np.lexsort((end, start, np.array(LABELS)[label], row))
                each = pa.StructArray.from_arrays([pa.array(LABELS).take(pa.array(label[order])), pa.array(start[order].astype(np.int32)), pa.array(end[order].astype(np.int32))], names=["label", "start", "end"])
                at = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), each)], names=["doc_id", "text", "entities"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, entities array<struct<label:string,start:int,end:int>>")


SPANS_SQL = r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(generate_series(0, len(string_split(text, ' ')) - 1)) AS pos FROM documents),
s AS MATERIALIZED (SELECT doc_id, pos, word, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM w),
c AS MATERIALIZED (SELECT doc_id, pos, word, start, start + length(word) AS "end", (doc_id * 7 + pos) % 10 AS k, (doc_id + pos) % 3 AS lab FROM s WHERE regexp_full_match(word, '\p{Lu}\p{Ll}+') AND length(word) > 3),
gold AS MATERIALIZED (SELECT doc_id, start, "end", ['ORG', 'NAME', 'GEO'][CAST(lab AS INT) + 1] AS label FROM c WHERE k <> 3),
pred AS MATERIALIZED (SELECT doc_id, start, CASE WHEN k = 1 THEN "end" - 1 ELSE "end" END AS "end", ['ORG', 'NAME', 'GEO'][CAST(CASE WHEN k = 2 THEN (lab + 1) % 3 ELSE lab END AS INT) + 1] AS label FROM c WHERE k <> 0)
"""
