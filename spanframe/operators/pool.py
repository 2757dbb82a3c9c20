"""Mention pools: clean surfaces, stems and endings, purity, deduplication, replacement."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.text import script_presence, strip, words
from spanframe.operators.ordered import uniform

_MARKS = f"[{K.MENTION_APOSTROPHES}]"


def is_clean_mention(c: Column) -> Column:
    """At least two characters, trimmed, of the allowed shape, one script, few and short words."""
    w = words(c)
    return (F.length(c) >= 2) & (c == strip(c)) & c.rlike(K.CLEAN_SHAPE) & c.rlike(r"\p{L}") & (F.size(w) <= 8) & F.forall(w, lambda x: F.length(x) <= 25) & script_presence(c).isin("cyrillic", "latin")


def candidate_splits(c: Column) -> Column:
    """array of struct(stem, ending), longest ending first; an apostrophe before the ending goes with it."""
    endings = F.when(script_presence(c) == "cyrillic", F.array(*map(F.lit, K.ENDINGS_CYRILLIC))).otherwise(F.array(*map(F.lit, K.ENDINGS_LATIN)))
    low = F.lower(c)

    def split(e):
        n = F.length(c) - F.length(e)
        n = n - F.substring(c, n, F.lit(1)).rlike(_MARKS).cast("int")
        return F.struct(F.substring(c, F.lit(1), n).alias("stem"), F.substring(c, n + 1, F.lit(99)).alias("ending"))

    cut = F.transform(F.filter(endings, lambda e: low.endswith(e)), split)
    return F.filter(cut, lambda s: F.regexp_count(F.element_at(F.concat(F.array(F.lit("")), words(s["stem"])), -1), F.lit(r"\p{L}")) >= 3)


def split_ending(c: Column, known: Column) -> Column:
    """struct(stem, ending): the first split with a known stem (lower case), else a telling ending of a long stem, else none."""
    cut = candidate_splits(c)
    by_stem = F.filter(cut, lambda s: F.array_contains(known, F.lower(s["stem"])))
    plain = lambda e: F.regexp_replace(F.lower(e), f"^{_MARKS}", "")
    telling = F.filter(cut, lambda s: plain(s["ending"]).isin(*K.CLEAR_ENDINGS) & (F.regexp_count(F.element_at(F.concat(F.array(F.lit("")), words(s["stem"])), -1), F.lit(r"\p{L}")) >= 4))
    whole = F.struct(c.alias("stem"), F.lit("").alias("ending"))
    return F.coalesce(F.get(by_stem, F.lit(0)), F.get(telling, F.lit(0)), whole)


def attach_ending(stem: Column, ending: Column) -> Column:
    """The ending on another stem; the dative follows the stem's last letter unless an apostrophe stands before it."""
    mark = F.regexp_extract(ending, f"^{_MARKS}", 0)
    bare = F.substring(ending, F.length(mark) + 1, F.lit(99))
    last = F.when(mark == "", F.lower(F.right(stem, F.lit(1)))).otherwise("")
    cyrillic = F.lower(bare).isin("га", "ка", "қа")
    base = F.when(cyrillic, F.when(last == "к", "ка").when(last == "қ", "қа").otherwise("га")).otherwise(F.when(last == "k", "ka").when(last == "q", "qa").otherwise("ga"))
    fitted = F.when(F.lower(bare).isin(*K.DATIVE), F.when((bare == F.upper(bare)), F.upper(base)).otherwise(base)).otherwise(bare)
    return F.concat(stem, mark, fitted)


def is_plural(c: Column) -> Column:
    return (F.size(words(c)) == 1) & F.lower(c).rlike("(lar|лар)$")


def dedupe_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order; partial minima before the shuffle."""
    rest = F.struct(*df.columns)
    return df.groupBy(*[F.expr(b).alias(f"_k{i}") for i, b in enumerate(by)]).agg(F.min_by(rest, F.struct(*order)).alias("r")).select("r.*")


_ANY = "*"


def _own_and_any(lang: str) -> Column:
    return F.array_distinct(F.array_compact(F.array(lang, F.lit(_ANY))))


def replacements(mentions: DataFrame, pool: DataFrame, seed: int, bias: float = 0.0, extra: int | None = None, max_per_doc: int | None = None, bias_by_label: Mapping[str, float] | None = None) -> DataFrame:
    """(id, label, stem, new): another stem of the pool for each mention (id, label, stem, script, and lang if it has one).

    All forms of a stem in a document, in any case, get the same one. Stems of the mention's own language are taken,
    those of any language only where that has no other; the draw is weighted by n_words ** bias (or its label's),
    among stems of at most `extra` words more than the mention's. Of a document at most max_per_doc stems that can
    be replaced are (those of the least hashes). Only a mention whose stems leave no other has none.

    Stems of a group (label, script, language) stand in a row by words and name, each as long as its weight; a
    mention draws a place in the part that its number of words allows, less its own stem's, and what holds the place
    is found by an equi-join on slices of the row, as many as it has stems.
    """
    group = ["label", "script", "lang"]
    own = F.col("lang") if "lang" in pool.columns else F.lit(None).cast("string")
    stock = pool.select("label", "script", own.alias("lang"), F.col("stem").alias("new"), "n_words")
    stock = stock.withColumn("lang", F.explode(_own_and_any("lang"))).groupBy(*group, F.lower("new").alias("key")).agg(F.min("new").alias("new"), F.min("n_words").alias("n_words"))
    row = Window.partitionBy(*group).orderBy("n_words", "key")
    power = F.lit(float(bias))
    for label, other in (bias_by_label or {}).items():
        power = F.when(F.col("label") == label, float(other)).otherwise(power)
    sized = stock.withColumn("weight", F.pow(F.col("n_words").cast("double"), power))
    to = F.sum("weight").over(row.rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumns({"to": to, "place": F.row_number().over(row)})
    every = Window.partitionBy(*group)
    placed = placed.withColumns({"from": F.coalesce(F.lag("to").over(row), F.lit(0.0)), "whole": F.max("to").over(every), "slices": F.max("place").over(every)})
    by_words = placed.groupBy(*group, F.col("n_words").alias("up_to")).agg(F.max("to").alias("part"), F.max("place").alias("stems"))
    limits = by_words.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("up_to", "part", "stems"))).alias("limits"), F.max("part").alias("whole"), F.max("stems").alias("slices"))

    lang = F.col("lang") if "lang" in mentions.columns else F.lit(None).cast("string")
    asked = mentions.select("id", "label", "stem", "script", lang.alias("own")).groupBy("id", "label", F.lower("stem").alias("key")).agg(F.collect_set("stem").alias("forms"), F.min("script").alias("script"), F.min("own").alias("own"))
    # Its own language's group and that of all languages.
    choice = asked.withColumn("lang", F.explode(_own_and_any("own"))).join(limits, group)
    choice = choice.join(placed.select(*group, "key", F.struct("from", "to", "place").alias("same")), [*group, "key"], "left")
    choice = choice.where(F.col("slices") > F.when(F.col("same").isNotNull(), 1).otherwise(0))
    taken = F.struct((F.col("lang") != _ANY).cast("int").alias("own"), "lang", "limits", "whole", "slices", "same", "forms")
    choice = choice.groupBy("id", "label", "script", "key").agg(F.max_by(taken, (F.col("lang") != _ANY).cast("int")).alias("c")).select("id", "label", "script", "key", "c.*")
    # The widest part that the mention's words allow; its own stem may stand in it.
    fits = F.col("limits") if extra is None else F.filter("limits", lambda x: x["up_to"] <= F.size(words(F.col("key"))) + extra)
    draw = choice.withColumn("part", F.get(fits, F.size(fits) - 1)).withColumn("same", F.when(F.col("same.place") <= F.col("part.stems"), F.col("same")))
    draw = draw.where(F.col("part.stems") > F.when(F.col("same").isNotNull(), 1).otherwise(0))
    if max_per_doc is not None:
        first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(F.lit(seed), "id", "label", "key"), "label", "key"))
        draw = draw.withColumn("_n", first).where(F.col("_n") <= max_per_doc)
    others = F.coalesce(F.col("same.from") + (F.col("part.part") - F.col("same.to")), F.col("part.part"))
    draw = draw.withColumn("u", uniform(seed, "id", "label", "key") * others)
    behind = F.col("same.to") + (F.col("u") - F.col("same.from"))
    draw = draw.withColumn("u", F.when(F.col("u") >= F.col("same.from"), F.least(behind, F.col("part.part") * (1 - 2.0**-52))).otherwise(F.col("u")))

    slice_of = lambda at: F.least(F.floor(F.col(at) / F.col("whole") * F.col("slices")), F.col("slices") - 1)
    parts = placed.withColumn("slice", F.explode(F.sequence(slice_of("from"), slice_of("to")))).select(*group, "slice", "from", "to", "new")
    draw = draw.withColumn("slice", slice_of("u")).select("id", *group, "slice", "u", "forms")
    hit = draw.join(parts, [*group, "slice"]).where((F.col("from") <= F.col("u")) & (F.col("u") < F.col("to")))
    return hit.select("id", "label", F.explode_outer("forms").alias("stem"), "new")


def transliterated_stem(c: Column, to: str) -> Column:
    """The stem in the other alphabet; null where it looks foreign or the result is not clean and of that script."""
    from spanframe.functions.translit import cyrillic_to_latin, latin_to_cyrillic

    out = latin_to_cyrillic(c) if to == "cyrillic" else cyrillic_to_latin(c)
    foreign = c.rlike(K.FOREIGN_LATIN) if to == "cyrillic" else F.lit(False)
    return F.when(~foreign & is_clean_mention(out) & (script_presence(out) == to), out)


def rebuilt(text: Column, entities: Column, surfaces: Column) -> Column:
    """struct(text, entities): each entity (in text order, disjoint) with its new surface, null keeping the old one."""
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.array().cast("array<struct<label:string,start:int,end:int>>").alias("entities"))

    def step(a, x):
        e = x["e"]
        between = F.substring(text, a["at"] + 1, e["start"] - a["at"])
        surface = F.coalesce(x["s"], F.substring(text, e["start"] + 1, e["end"] - e["start"]))
        before = F.concat(a["text"], between)
        moved = F.struct(e["label"].alias("label"), F.length(before).alias("start"), (F.length(before) + F.length(surface)).alias("end"))
        return F.struct(F.concat(before, surface).alias("text"), e["end"].alias("at"), F.concat(a["entities"], F.array(moved)).alias("entities"))

    pairs = F.arrays_zip(entities.alias("e"), surfaces.alias("s"))
    return F.aggregate(pairs, zero, step, lambda a: F.struct(F.concat(a["text"], F.substring(text, a["at"] + 1, F.length(text))).alias("text"), a["entities"].alias("entities")))


def match_case(new: Column, old: Column) -> Column:
    """New in capitals or small letters where old is, else as it stands; one capital alone tells nothing."""
    capitals, small = (old == F.upper(old)) & (old != F.lower(old)) & (F.length(old) > 1), (old == F.lower(old)) & (old != F.upper(old))
    return F.when(capitals, F.upper(new)).when(small, F.lower(new)).otherwise(new)
