"""Records from tagged sentences, and mixes of the sources' records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.text import clean_span, spaced, with_offsets
from spanframe.operators.alignment import decode_tags
from spanframe.operators.ordered import capped, row_index
from spanframe.operators.sampling import hash_bucket, shuffled


def assembled(sentences: DataFrame, mapping: Mapping[str, str], size: int = 4, bucket: Column | None = None) -> DataFrame:
    """hash, text, entities, source, lang, n_dropped: `size` sentences in a row of a source are one document, a line each.

    sentences: source, lang, sentence (their order), tokens, tags (BIO). Labels that mapping lacks go; spans that cut a
    word or hold no letter or digit go too and are counted in n_dropped. The last document of a source may be shorter.
    bucket: what never decreases along sentence and holds some thousands of them; by default sentence / 4096.
    """
    names = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    pieces = spaced(F.col("tokens"))
    rows = row_index(sentences, ["sentence"], F.floor(F.col("sentence") / 4096) if bucket is None else bucket, ["source"], "place")
    rows = rows.select("source", "lang", "place", "tokens", F.array_join(pieces, "").alias("line"), with_offsets(pieces).alias("at"), decode_tags(F.col("tags")).alias("runs"))

    def span(r):
        first, last = r["first"], r["last"]
        start = F.get("at", first)["end"] - F.length(F.get("tokens", first))
        return F.struct(F.element_at(names, r["label"]).alias("label"), clean_span(F.col("line"), start, F.get("at", last)["end"]).alias("span"))

    rows = rows.withColumn("spans", F.filter(F.transform("runs", span), lambda s: s["label"].isNotNull()))
    kept = F.filter("spans", lambda s: s["span"].isNotNull())
    rows = rows.select("source", "lang", "place", "line", kept.alias("spans"), (F.size("spans") - F.size(kept)).alias("n_dropped"))
    parts = F.sort_array(F.collect_list(F.struct("place", "line", "spans"))).alias("parts")
    docs = rows.groupBy("source", F.floor(F.col("place") / size).alias("grp")).agg(F.max("lang").alias("lang"), parts, F.sum("n_dropped").alias("n_dropped"))

    def placed(p, i):
        base = F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x["line"]) + 1)
        return F.transform(p["spans"], lambda s: F.struct(s["label"].alias("label"), (base + s["span"]["start"]).alias("start"), (base + s["span"]["end"]).alias("end")))

    docs = docs.withColumn("text", F.array_join(F.transform("parts", lambda p: p["line"]), "\n"))
    name = F.sha1(F.concat_ws(":", "source", (F.col("grp") + 1).cast("string"), "text").cast("binary"))
    return docs.select(name.alias("hash"), "text", F.flatten(F.transform("parts", placed)).alias("entities"), "source", "lang", "n_dropped")


def bad_edges(text: Column, entities: Column) -> Column:
    """Whether an entity is outside the text, has white space at an edge, or a letter right beside it."""

    def bad(e):
        s, n = e["start"], e["end"] - e["start"]
        surface = F.substring(text, s + 1, n)
        beside = F.concat(F.when(s > 0, F.substring(text, s, F.lit(1))).otherwise(""), F.substring(text, e["end"] + 1, F.lit(1)))
        return F.coalesce((s < 0) | (n <= 0) | (e["end"] > F.length(text)) | surface.rlike(r"^[\s\p{Z}]|[\s\p{Z}]$") | beside.rlike(r"\p{L}"), F.lit(True))

    return F.exists(entities, bad)


def copies(records: DataFrame, times: int) -> DataFrame:
    """Every record so many times; from the second on with -r and its number behind the hash."""
    turn = records.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    name = F.when(F.col("_r") == 0, F.col("hash")).otherwise(F.concat("hash", F.lit("-r"), F.col("_r").cast("string")))
    return turn.withColumn("hash", name).drop("_r")


def mixed(records: DataFrame, caps: Mapping[str, int], seed: int, original: DataFrame | None = None, times: int = 2) -> DataFrame:
    """Records (hash, text, entities, source) of all sources with _h, by which they are in random order.

    A source gives records in that order until its entities reach its cap: the record that crosses it stays, and a
    source without a cap gives all. `original` records join in `times` copies.
    """
    names = F.create_map(*(x for k, v in caps.items() for x in (F.lit(k), F.lit(v).cast("long")))) if caps else None
    cap = F.lit(2**62) if names is None else F.coalesce(F.element_at(names, F.col("source")), F.lit(2**62))
    columns = ["hash", "text", "entities", "source"]
    kept = capped(shuffled(records.select(*columns), seed, "hash"), F.size("entities"), cap, ["_h", "hash"], hash_bucket(), ["source"]).select(*columns)
    if original is not None:
        kept = kept.unionByName(copies(original.select(*columns), times))
    return shuffled(kept, seed + 1, "hash")


def without_label(entities: Column, source: Column, rules: Mapping[str, str]) -> Column:
    """Entities without the one label that the rules name for their source."""
    names = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))
    out = F.element_at(names, source)
    return F.filter(entities, lambda e: ~e["label"].eqNullSafe(out) | out.isNull())


def numbered_languages(parts: Mapping[str, DataFrame], ids: Mapping[str, int], text_col: str = "text") -> DataFrame:
    """text and lang_id of all parts in one table: each part's texts with the number of its language."""
    out = None
    for lang, df in parts.items():
        rows = df.select(F.col(text_col).alias("text"), F.lit(ids[lang]).alias("lang_id"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no parts")
    return out


def subset_size(total: int, subset: str, fraction: int = 10) -> int:
    """Synthetic texts of a subset: all for train, one in `fraction` of these, one at least, for the others."""
    return total if subset == "train" else max(total // fraction, 1)
