"""Prompts for span extraction by a language model, and lenient reading of its answers. No network here."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators.alignment import align_surfaces

ENTITIES = "array<struct<text:string,label:string>>"


def system_prompt(labels: tuple[str, ...], keep_case_endings: bool, split_nested: bool, include_titles: bool, repeat_mentions: bool) -> str:
    """One rule for each convention, by its flag."""
    rules = [
        "Keep case endings inside the span." if keep_case_endings else "Leave case endings out of the span.",
        "List nested names apart." if split_nested else "List the longest name only.",
        "Include titles." if include_titles else "Leave titles out.",
        "List every occurrence." if repeat_mentions else "List each name once.",
    ]
    return "\n".join([f"Mark entities of the types {', '.join(labels)}.", *rules, 'Answer with JSON: {"entities": [{"text": ..., "label": ...}]}'])


def user_prompt(text: Column, shots: list[tuple[str, str]]) -> Column:
    """Examples, each with its answer, then the text."""
    parts = [F.lit(f"Text: {t}\nAnswer: {a}") for t, a in shots]
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Text: "), text, F.lit("\nAnswer:")))


def parse_lenient(raw: Column) -> Column:
    """Entities of an answer that may be fenced, have words around it, or end too early; [] when nothing can be read."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(raw.rlike(r"(?s)```(?:json)?\s*(.*?)```"), fenced).otherwise(raw)
    opened = F.when(F.instr(body, "{") > 0, F.substring(body, F.instr(body, "{"), F.length(body)))
    closed = F.when(F.instr(opened, "}") > 0, F.regexp_extract(opened, r"(?s)^(.*\})", 1))
    trimmed = F.regexp_replace(closed, r"[\s,]+$", "")
    tries = [closed, F.concat(trimmed, F.lit("]}")), F.concat(opened, F.lit("]}")), F.concat(opened, F.lit('"}]}')), F.concat(opened, F.lit("}]}"))]
    read = [F.when(F.try_parse_json(t).isNotNull(), F.coalesce(F.from_json(t, f"entities {ENTITIES}")["entities"], F.from_json(F.lit("[]"), ENTITIES))) for t in tries]
    return F.filter(F.coalesce(*[F.when(closed.isNotNull(), r) for r in read], F.from_json(F.lit("[]"), ENTITIES)), lambda e: e.isNotNull())


def answered(df: DataFrame, call: Callable[[str], str], prompt_col: str = "prompt", attempts: int = 3, at_once: int = 8) -> DataFrame:
    """df with `raw`, the answer of call(prompt), and `error`, why there is none. The caller brings the client.

    A partition keeps at most at_once calls in the air and gives its rows back in their order; a call that fails is
    made again, `attempts` times in all, and fails its own row only. A null prompt is not asked.
    """
    names = df.columns
    place = names.index(prompt_col)

    def one(prompt: str | None) -> tuple[str | None, str | None]:
        why = None
        for _ in range(attempts if prompt is not None else 0):
            try:
                return call(prompt), None
            except Exception as e:  # whatever the client raises is the row's reason
                why = f"{type(e).__name__}: {e}"
        return None, why

    def run(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                for at in range(0, b.num_rows, 16 * at_once):  # the pool's queue stays short
                    part = b.slice(at, 16 * at_once)
                    raw, error = zip(*pool.map(one, part.column(place).to_pylist()), strict=True)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.string()), pa.array(error, pa.string())], names=[*names, "raw", "error"])

    kinds = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return df.mapInArrow(run, f"{kinds}, raw string, error string")


def extracted(docs: DataFrame, call: Callable[[str], str], labels: Sequence[str], shots: Sequence[tuple[str, str]] = (), id_col: str = "doc_id", attempts: int = 3, at_once: int = 8) -> DataFrame:
    """(id, spans, error) of documents (id, text): prompt, answer, lenient reading, surfaces placed in the text.

    spans: array of struct(start, end, type), empty where the answer names nothing that the text holds; null, with
    the reason in error, where there is no answer.
    """
    asked = docs.select(id_col, "text").withColumn("prompt", user_prompt(F.col("text"), list(shots)))
    told = answered(asked, call, "prompt", attempts, at_once).withColumn("items", parse_lenient(F.col("raw")))
    out = align_surfaces(told.select(id_col, "text", "raw", "error", "items"), labels)
    return out.select(id_col, F.when(F.col("raw").isNotNull(), F.col("spans")).alias("spans"), "error")


def errors_dumped(gold: DataFrame, predicted: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, missed, spurious, text) of the documents whose spans (id, start, end, label) differ: what to read when a run went wrong."""
    g = gold.select("doc_id", "start", "end", "label").distinct().withColumn("g", F.lit(True))
    p = predicted.select("doc_id", "start", "end", "label").distinct().withColumn("p", F.lit(True))
    wrong = g.join(p, ["doc_id", "start", "end", "label"], "full_outer").where("g is null or p is null")
    one = F.struct("start", "end", "label")
    sides = wrong.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("p").isNull(), one))).alias("missed"), F.sort_array(F.collect_list(F.when(F.col("g").isNull(), one))).alias("spurious"))
    return sides.join(docs.select("doc_id", "text"), "doc_id")


def response(df: DataFrame) -> DataFrame:
    """hash, entities -> one JSON object per row, as the service answers."""
    return df.select(F.to_json(F.struct("hash", "entities")).alias("value"))
