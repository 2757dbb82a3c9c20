"""Corpus building: script filter, chunks, budgets with overflow, transliterated copies, code switching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.text import corpus_script, looks_clean, sentences, split_chunks, strip, words
from spanframe.functions.translit import corpus_latin_to_cyrillic
from spanframe.operators.ordered import row_index, running_before, uniform


def chunked(docs: DataFrame, most: int, least: int = 0, clean: bool = False) -> DataFrame:
    """doc_id, i, text of the documents' chunks that are long enough and, if asked, look clean."""
    rows = docs.select("doc_id", F.posexplode(split_chunks(F.col("text"), most)).alias("i", "text"))
    kept = rows.where(F.length(strip(F.col("text"))) >= least)
    return kept.where(looks_clean(F.col("text"))) if clean else kept


def budget_buckets(chunks: DataFrame, first: int, second: int) -> DataFrame:
    """Chunks in order: up to `first` characters as they are, then up to `second` more transliterated; the rest goes."""
    n = F.length("text")
    rows = running_before(chunks, n, ["doc_id", "i"], F.floor(F.col("doc_id") / 4096))
    bucket = F.when(F.col("before") < first, "plain").when(F.col("before") < first + second, "translit")
    text = F.when(F.col("bucket") == "translit", corpus_latin_to_cyrillic(F.col("text"))).otherwise(F.col("text"))
    return rows.withColumn("bucket", bucket).where("bucket is not null").select("doc_id", "i", "bucket", text.alias("text"))


def script_documents(docs: DataFrame, script: str) -> DataFrame:
    return docs.where(corpus_script(F.col("text")) == script)


def code_switched(docs: DataFrame, n: int, seed: int, lang_col: str = "lang", pairs: float = 0.5) -> DataFrame:
    """n texts of two languages each: a share of `pairs` two sentences in random order, the others a sentence with one
    to four words of another inside. Sentences are numbered in hash order per language and each text takes one of
    either language by number, so no pair is searched for."""
    pool = docs.select("doc_id", lang_col, F.posexplode(sentences(F.col("text"))).alias("i", "sentence"))
    pool = pool.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("i").cast("string"))))
    ranked = row_index(pool, ["_h", "doc_id", "i"], F.substring("_h", 1, 2), [lang_col], "place").select(lang_col, "place", "sentence")
    sizes = {r[0]: r[1] for r in ranked.groupBy(lang_col).count().collect()}
    if len(sizes) < 2:
        return ranked.select(F.lit(0).cast("long").alias("k"), F.col("sentence").alias("text")).limit(0)
    langs = F.array(*map(F.lit, sorted(sizes)))
    counts = F.create_map(*(F.lit(x) for k in sorted(sizes) for x in (k, sizes[k])))
    m = len(sizes)
    draws = docs.sparkSession.range(n).withColumnRenamed("id", "k")
    a = F.floor(uniform(seed + 1, "k") * m).cast("int")
    b = F.pmod(a + 1 + F.floor(uniform(seed + 2, "k") * (m - 1)).cast("int"), F.lit(m))
    sides = draws.select("k", F.get(langs, a).alias("la"), F.get(langs, b).alias("lb"), (uniform(seed + 3, "k") < 0.5).alias("swap"))
    place = lambda c, s: F.floor(uniform(s, "k") * F.element_at(counts, F.col(c))).cast("long")
    x = sides.withColumns({"pa": place("la", seed + 4), "pb": place("lb", seed + 5)})
    one = ranked.select(F.col(lang_col).alias("la"), F.col("place").alias("pa"), F.col("sentence").alias("sa"))
    two = ranked.select(F.col(lang_col).alias("lb"), F.col("place").alias("pb"), F.col("sentence").alias("sb"))
    j = x.join(one, ["la", "pa"]).join(two, ["lb", "pb"])
    pair = F.when(F.col("swap"), F.concat_ws(" ", "sb", "sa")).otherwise(F.concat_ws(" ", "sa", "sb"))
    j = j.withColumns({"wa": words(F.col("sa")), "wb": words(F.col("sb"))})
    inside = inserted(F.col("wa"), F.col("wb"), *(uniform(seed + i, "k") for i in (6, 7, 8)))
    return j.select("k", F.when(uniform(seed + 9, "k") < pairs, pair).otherwise(inside).alias("text"))


def inserted(base: Column, other: Column, size: Column, start: Column, at: Column) -> Column:
    """The words of base with one to four neighbouring words of other among them, by three draws from [0, 1)."""
    n = 1 + F.floor(size * F.least(F.lit(4), F.size(other))).cast("int")
    first = 1 + F.floor(start * (F.size(other) - n + 1)).cast("int")
    left = F.greatest(1 + F.floor(at * (F.size(base) - 1)).cast("int"), F.lit(1))
    return F.concat_ws(" ", F.concat(F.slice(base, F.lit(1), left), F.slice(other, first, n), F.slice(base, left + 1, F.size(base))))
