"""Mention pools learned from text: a dictionary of known stems, endings split by look-up, pools built, merged, kept.

The dictionary is a table (kind, key): whole stems, and the last words of stems of several words. Every
mention's candidate split asks it by an equi-join, so pools of any size can be learned from; mentions are
counted by surface first, so a surface that makes up a third of all rows is one row by then. What one
round learns is in the dictionary of the next.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.text import prepare, script_presence, words
from spanframe.operators.pool import candidate_splits, dedupe_first, is_clean_mention, is_plural, transliterated_stem

ENTRY = "label string, stem string, n_words int, script string, lang string, source string"
_WORD = r"[\p{L}\p{Nl}\p{No}][\p{L}\p{N}_'’‘ʻʼ\-]*"


@dataclass(frozen=True)
class MentionPool:
    """entries: label, stem, n_words, script, lang, source; known: kind (stem, last), key."""

    entries: DataFrame
    known: DataFrame


def _last(c: Column) -> Column:
    return F.element_at(F.concat(F.array(F.lit("")), words(c)), -1)


def _known(keys: DataFrame) -> DataFrame:
    """(kind, key) of lower-case stems (key)."""
    lasts = keys.where(F.size(words(F.col("key"))) > 1).select(F.lit("last").alias("kind"), _last(F.col("key")).alias("key"))
    return keys.select(F.lit("stem").alias("kind"), "key").unionAll(lasts).distinct()


def learned(mentions: DataFrame) -> DataFrame:
    """The dictionary of mentions (surface): every clean one is a known stem as it stands."""
    return _known(mentions.where(is_clean_mention(F.col("surface"))).select(F.lower("surface").alias("key")).distinct())


def common_words(texts: DataFrame, least: int = 3) -> DataFrame:
    """(word) that the texts hold at least so often with a small first letter."""
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("word")).where(F.col("word").rlike(r"^\p{Ll}"))
    return found.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


def split_endings(surfaces: DataFrame, known: DataFrame) -> DataFrame:
    """(surface, stem, ending) of distinct surfaces: cut where the stem is known, or its last word ends a known stem
    of several words, or the ending is a telling one after a last word of four letters; else whole.

    No two endings end the same word, so a surface has one candidate at most.
    """
    rows = surfaces.select("surface").distinct().withColumn("cut", F.get(candidate_splits(F.col("surface")), F.lit(0)))
    low = F.lower("cut.stem")
    asks = F.array(F.struct(F.lit("stem").alias("kind"), low.alias("key")), F.struct(F.lit("last").alias("kind"), F.when(F.size(words(low)) > 1, _last(low)).alias("key")))
    asked = rows.where("cut is not null").select("surface", F.inline(asks)).where("key is not null")
    hits = asked.join(known, ["kind", "key"], "left_semi").select("surface").distinct().withColumn("hit", F.lit(True))
    bare = F.regexp_replace(F.lower("cut.ending"), f"^[{K.MENTION_APOSTROPHES}]+", "")
    telling = bare.isin(*K.CLEAR_ENDINGS) & (F.regexp_count(_last(F.col("cut.stem")), F.lit(r"\p{L}")) >= 4)
    cuts = F.col("cut").isNotNull() & (F.col("hit").isNotNull() | telling)
    stem, ending = F.when(cuts, F.col("cut.stem")).otherwise(F.col("surface")), F.when(cuts, F.col("cut.ending")).otherwise("")
    return rows.join(hits, "surface", "left").select("surface", stem.alias("stem"), ending.alias("ending"))


def _commonest(rows: DataFrame, value: str) -> DataFrame:
    """(key, value): each key's commonest, the first seen of equals."""
    counted = rows.groupBy("key", value).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return counted.groupBy("key").agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def build_pool(mentions: DataFrame, min_count: int = 2, min_purity: float = 0.8, reference: DataFrame | None = None, reference_texts: DataFrame | None = None, transliterate: bool = False, split: bool = True, source: str = "", known: DataFrame | None = None) -> MentionPool:
    """A pool of mentions (label, surface, lang, ord: their order).

    A stem stays for the labels that have min_purity of its mentions, if it has min_count. Its spelling and
    language are the commonest, the first seen of equals. One word in the plural goes; so do stems of one or
    two words that are all common words of reference_texts; of names, common words in front go (titles).
    reference: more mentions whose surfaces are known stems; known: a dictionary learned before. transliterate
    adds the stem in the other alphabet where that is safe. An entry is one of its label, stem and script;
    the first seen stays. Null or unclean surfaces are left out; no mentions give an empty pool.
    """
    clean = mentions.where(is_clean_mention(F.col("surface"))).groupBy("label", "surface", "lang").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    own = learned(clean)
    for more in ([learned(reference)] if reference is not None else []) + ([known] if known is not None else []):
        own = own.unionAll(more)
    own = own.distinct()
    rows = clean.join(split_endings(clean, own), "surface") if split else clean.withColumn("stem", F.col("surface"))
    rows = rows.withColumn("key", F.lower("stem"))

    by_label = rows.groupBy("key", "label").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    of_key = Window.partitionBy("key")  # a row a label
    pure = by_label.withColumns({"total": F.sum("n").over(of_key), "seen": F.min("first").over(of_key)}).where((F.col("total") >= min_count) & (F.col("n") >= min_purity * F.col("total")))
    named = _commonest(rows, "stem").join(_commonest(rows, "lang"), "key").where(~is_plural(F.col("stem"))).withColumn("n_words", F.size(words(F.col("stem"))))
    if reference_texts is None:
        named = named.withColumn("lead", F.lit(0))
    else:
        common = common_words(reference_texts).withColumn("common", F.lit(True))
        each = named.select("key", F.posexplode(words(F.col("stem"))).alias("i", "w")).withColumn("word", F.lower("w")).join(common, "word", "left")
        lead = each.groupBy("key").agg(F.min(F.when(F.col("common").isNull(), F.col("i"))).alias("lead"))
        named = named.join(lead, "key").withColumn("lead", F.coalesce("lead", "n_words")).where((F.col("n_words") > 2) | (F.col("lead") < F.col("n_words")))
    j = pure.join(named, "key")
    titles = F.when(F.col("label") == "NAME", F.least(F.col("lead"), F.col("n_words") - 1)).otherwise(0)
    stem = F.when(titles > 0, F.regexp_replace("stem", F.concat(F.lit(r"^(?:\S+\s+){"), titles.cast("string"), F.lit("}")), F.lit(""))).otherwise(F.col("stem"))
    j = j.withColumn("stem", stem).withColumn("script", script_presence(F.col("stem")))
    variants = [F.struct("stem", "script", F.lit(0).alias("variant"))]
    if transliterate:
        plain = prepare(F.col("stem"), homoglyphs=False)
        other = F.when(F.col("script") == "latin", transliterated_stem(plain, "cyrillic")).otherwise(transliterated_stem(plain, "latin"))
        variants.append(F.struct(other.alias("stem"), F.when(F.col("script") == "latin", "cyrillic").otherwise("latin").alias("script"), F.lit(1).alias("variant")))
    every = j.select("label", "lang", "seen", F.explode(F.array(*variants)).alias("v")).select("label", "lang", "seen", "v.*").where("stem is not null")
    once = dedupe_first(every, ["label", "lower(stem)", "script"], ["seen", "variant"])
    entries = once.select("label", "stem", F.size(words(F.col("stem"))).alias("n_words"), "script", "lang", F.lit(source).alias("source"))
    return MentionPool(entries, own.unionAll(_of_entries(entries)).distinct())


def _of_entries(entries: DataFrame) -> DataFrame:
    return _known(entries.select(F.lower("stem").alias("key")).distinct())


def merged(pool: MentionPool, *others: MentionPool) -> MentionPool:
    """All entries; of equal label, stem and script that of the pool named first."""
    entries, known = pool.entries.withColumn("_turn", F.lit(0)), pool.known
    for i, other in enumerate(others, 1):
        entries, known = entries.unionByName(other.entries.withColumn("_turn", F.lit(i))), known.unionByName(other.known)
    return MentionPool(dedupe_first(entries, ["label", "lower(stem)", "script"], ["_turn", "stem"]).drop("_turn"), known.distinct())


def relearned(pool: MentionPool, mentions: DataFrame) -> MentionPool:
    """The pool, with the surfaces of mentions as further known stems."""
    return MentionPool(pool.entries, pool.known.unionAll(learned(mentions)).distinct())


def pool_stats(entries: DataFrame) -> DataFrame:
    """(label, slice, n): stems of each label in all (`total`) and by language and script (`uz-lat`)."""
    kind = F.concat_ws("-", "lang", F.left("script", F.lit(3)))
    return entries.select("label", F.explode(F.array(F.lit("total"), kind)).alias("slice")).groupBy("label", "slice").agg(F.count("*").alias("n"))


def write_pool(entries: DataFrame, path: str) -> None:
    """JSON lines in files that follow each other in the order of label and stem."""
    rows = entries.repartitionByRange("label", "stem").sortWithinPartitions("label", "stem", "script")
    rows.select(F.to_json(F.struct("label", "stem", "n_words", "script", "lang", "source")).alias("value")).write.mode("overwrite").text(path)


def read_pool(spark: SparkSession, path: str) -> MentionPool:
    """What write_pool() wrote; of equal entries the first by file and line, blank lines go."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    rows = lines.select("file", "at", F.from_json("value", ENTRY).alias("r")).select("file", "at", "r.*")
    entries = dedupe_first(rows, ["label", "lower(stem)", "script"], ["file", "at"]).select("label", "stem", "n_words", "script", "lang", "source")
    return MentionPool(entries, _of_entries(entries))
