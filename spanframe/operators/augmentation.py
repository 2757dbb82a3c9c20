"""Changed copies of records: other mentions, a part in the other alphabet, another case."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.text import change_case, has_cyrillic, has_latin, unify_apostrophes, with_offsets
from spanframe.functions.translit import moves
from spanframe.operators.ordered import uniform
from spanframe.operators.pool import rebuilt
from spanframe.operators.sampling import pick_case


def direction(text: Column, key: str, seed: int, to_latin: float, to_cyrillic: float) -> Column:
    """latin, cyrillic or null: each alphabet by a draw of its own, Cyrillic text first; a text without its letters has none."""
    latin = has_cyrillic(text) & (uniform(seed, key) < to_latin)
    return F.when(latin, "latin").when(has_latin(text) & (uniform(seed + 1, key) < to_cyrillic), "cyrillic")


def transliterated_chunks(records: DataFrame, key: str, to: str, seed: int, whole: float = 0.3, least: int = 3, share: float = 0.5) -> DataFrame:
    """records (key, text, entities) with new_text and new_entities: some words in a row, or by chance the whole text, in the other alphabet.

    The run begins at a word that has letters of the old alphabet and has `least` words up to `share` of all. Both are
    null where no word has such letters, an entity begins or ends inside a pair of letters that become one, or vanishes.
    """
    letters = has_cyrillic if to == "latin" else has_latin
    rows = records.withColumn("_t", unify_apostrophes(F.col("text")))
    cut = with_offsets(F.regexp_extract_all("text", F.lit(r"[^\s\p{Z}]+|[\s\p{Z}]+"), F.lit(0)))
    rows = rows.withColumn("_w", F.filter(cut, lambda w: ~w["text"].rlike(r"^[\s\p{Z}]")))
    able = F.filter(F.transform("_w", lambda w, i: F.when(letters(w["text"]), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_able", able)
    first = F.get("_able", F.floor(uniform(seed, key) * F.size("_able")).cast("int"))
    most = F.greatest(F.lit(least), F.floor(F.size("_w") * F.lit(share)).cast("int"))
    n = least + F.floor(uniform(seed + 1, key) * (most - least + 1)).cast("int")
    rows = rows.withColumn("_first", first).withColumn("_last", F.least(F.col("_first") + n, F.size("_w")) - 1)
    all_ = uniform(seed + 2, key) < whole
    rows = rows.withColumn("_a", F.when(all_, 0).otherwise(F.get("_w", F.col("_first"))["start"])).withColumn("_b", F.when(all_, F.length("_t")).otherwise(F.get("_w", F.col("_last"))["end"]))
    rows = rows.withColumn("_m", moves(F.substring("_t", F.col("_a") + 1, F.col("_b") - F.col("_a")), to))
    grown = F.length("_m.text") - (F.col("_b") - F.col("_a"))

    def moved(at):
        inside = F.get(F.col("_m.at"), (at - F.col("_a")).cast("int"))
        return F.when(at < F.col("_a"), at).when(at > F.col("_b"), at + grown).otherwise(F.col("_a") + inside)

    spans = F.transform("entities", lambda e: F.struct(e["label"].alias("label"), moved(e["start"]).alias("start"), moved(e["end"]).alias("end")))
    rows = rows.withColumn("_s", spans)
    good = (F.size("_able") > 0) & ~F.exists("_s", lambda e: F.coalesce(e["start"] >= e["end"], F.lit(True)))
    text = F.concat(F.substring("_t", F.lit(1), F.col("_a")), F.col("_m.text"), F.substring("_t", F.col("_b") + 1, F.length("_t")))
    return rows.select(*records.columns, F.when(good, text).alias("new_text"), F.when(good, F.col("_s")).alias("new_entities"))


def augmented(records: DataFrame, key: str, seed: int, cases: Mapping[str, float], to_latin: float = 0.0, to_cyrillic: float = 0.0) -> DataFrame:
    """records (key, text, entities, and surfaces if mentions are replaced) changed in this order: mentions, alphabet, case.

    surfaces holds each entity's new surface or null; what cannot be transliterated stays as it was. `augmented` tells
    whether the text differs. cases: the shares of upper, lower and title; spans stay, as a case keeps lengths.
    """
    rows = records.withColumn("_old", F.col("text"))
    if "surfaces" in records.columns:
        new = rebuilt(F.col("text"), F.col("entities"), F.col("surfaces"))
        rows = rows.withColumn("_n", new).withColumns({"text": F.col("_n.text"), "entities": F.col("_n.entities")}).drop("_n", "surfaces")
    rows = rows.withColumn("_d", direction(F.col("text"), key, seed, to_latin, to_cyrillic))
    for i, to in enumerate(("latin", "cyrillic")):
        rows = transliterated_chunks(rows, key, to, seed + 10 * (i + 1))
        use = F.col("_d").eqNullSafe(to) & F.col("new_text").isNotNull()
        changed = {"text": F.when(use, F.col("new_text")).otherwise(F.col("text")), "entities": F.when(use, F.col("new_entities")).otherwise(F.col("entities"))}
        rows = rows.withColumns(changed).drop("new_text", "new_entities")
    case = pick_case(seed + 30, key, cases.get("upper", 0.0), cases.get("lower", 0.0), cases.get("title", 0.0))
    text = F.col("text")
    rows = rows.withColumn("_c", case)
    cased = F.when(F.col("_c") == "upper", change_case(text, "upper")).when(F.col("_c") == "lower", change_case(text, "lower")).when(F.col("_c") == "title", change_case(text, "title")).otherwise(text)
    rows = rows.withColumn("text", cased)
    return rows.withColumn("augmented", F.col("text") != F.col("_old")).drop("_old", "_d", "_c")
