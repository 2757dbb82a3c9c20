"""Column functions on text: normalisation, scripts, language, words, chunks.

All are built-in expressions. Characters are counted as code points; regular expressions find pieces,
never offsets, which come from lengths.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanframe.functions import constants as K

SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
LETTER = r"\p{L}"
ALNUM = r"[\p{L}\p{N}]"


def _one_of(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    """Pieces between runs of Unicode white space."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# ---------------------------------------------------------------- normalisation


def unify_apostrophes(c: Column) -> Column:
    """After o and g the turned comma, between other letters the modifier apostrophe; others stay.

    The second kind goes first: its neighbours must be those of the text as it was.
    """
    mark = _one_of(K.APOSTROPHES)
    inner = F.regexp_replace(c, rf"(?<=[\p{{L}}&&[^oOgG]]){mark}(?=\p{{L}})", K.MODIFIER_APOSTROPHE)
    return F.regexp_replace(inner, rf"(?<=[oOgG]){mark}", K.TURNED_COMMA)


def fold_apostrophes(c: Column) -> Column:
    """Every variant as the ASCII mark; for comparison only, length kept."""
    return F.translate(c, K.PROMPT_APOSTROPHES, "'" * len(K.PROMPT_APOSTROPHES))


def fix_homoglyphs(c: Column) -> Column:
    """Each word's look-alike letters in the script that most of its letters have; ties stay."""
    pieces = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{Nl}\p{No}]+|[^\p{L}\p{Nl}\p{No}]+"), F.lit(0))

    def fixed(w):
        latin, cyrillic = F.regexp_count(w, F.lit("[A-Za-z]")), F.regexp_count(w, F.lit(r"[\x{400}-\x{4ff}]"))
        return (
            F.when((latin > cyrillic) & (cyrillic > 0), F.translate(w, K.HOMOGLYPHS_CYRILLIC, K.HOMOGLYPHS_LATIN))
            .when((cyrillic > latin) & (latin > 0), F.translate(w, K.HOMOGLYPHS_LATIN, K.HOMOGLYPHS_CYRILLIC))
            .otherwise(w)
        )

    return F.array_join(F.transform(pieces, fixed), "")


def prepare(c: Column, homoglyphs: bool = True) -> Column:
    out = unify_apostrophes(c)
    return fix_homoglyphs(out) if homoglyphs else out


def visible_edges(surface: Column) -> tuple[Column, Column]:
    """How many format characters (Cf) to drop from the left and from the right."""
    left = F.length(F.regexp_extract(surface, r"^\p{Cf}*", 0))
    return left, F.when(left == F.length(surface), 0).otherwise(F.length(F.regexp_extract(surface, r"\p{Cf}*$", 0)))


def change_case(c: Column, to: str) -> Column:
    """upper, lower or title by character, where the mapped character is one character."""

    def told(chars):
        def mapped(ch, i):
            m = F.upper(ch) if to == "upper" else F.lower(ch)
            if to == "title":
                inside = (i > 0) & F.coalesce(F.get(chars, i - 1), F.lit("")).rlike(LETTER)
                m = F.when(inside, F.lower(ch)).otherwise(F.upper(ch))
            return F.when(F.length(m) == 1, m).otherwise(ch)

        return F.array_join(F.transform(chars, mapped), "")

    return let(F.split(c, ""), told)


def repair_mojibake(c: Column) -> Column:
    return F.replace(c, F.lit("â€™"), F.lit("’"))


# ---------------------------------------------------------------- scripts and language

LATIN_RE, CYRILLIC_RE = "[A-Za-z]", r"[\x{400}-\x{4ff}]"


def has_latin(c: Column) -> Column:
    return c.rlike(LATIN_RE)


def has_cyrillic(c: Column) -> Column:
    return c.rlike(CYRILLIC_RE)


def script_presence(c: Column) -> Column:
    """cyrillic, latin, mixed or other by which letters occur."""
    return F.when(has_cyrillic(c) & has_latin(c), "mixed").when(has_cyrillic(c), "cyrillic").when(has_latin(c), "latin").otherwise("other")


def script_of(c: Column) -> Column:
    """The slicing variant: code points A to z (marks between included) and À to ɏ are Latin."""
    latin, cyrillic = c.rlike(r"[A-z\x{c0}-\x{24f}]"), c.rlike(CYRILLIC_RE)
    return F.when(latin & cyrillic, "mixed").when(latin, "latin").when(cyrillic, "cyrillic").otherwise("other")


def script_shares(c: Column) -> tuple[Column, Column]:
    latin, cyrillic = F.regexp_count(c, F.lit(LATIN_RE)), F.regexp_count(c, F.lit(CYRILLIC_RE))
    return ratio(latin, latin + cyrillic), ratio(cyrillic, latin + cyrillic)


def corpus_script(c: Column) -> Column:
    """latin or cyrillic for text that looks Uzbek in it; null for short, mixed, English or Russian text."""
    latin, cyrillic = F.regexp_count(c, F.lit(LATIN_RE)), F.regexp_count(c, F.lit(CYRILLIC_RE))
    total = latin + cyrillic
    more = lambda a, b: F.regexp_count(c, F.lit(a)) > F.regexp_count(c, F.lit(b))
    return (
        F.when(total < 20, F.lit(None).cast("string"))
        .when(latin >= 0.8 * total, F.when(more(K.UZ_LATIN_MARKS, K.EN_MARKS), "latin"))
        .when(cyrillic >= 0.8 * total, F.when(more(K.UZ_CYRILLIC_MARKS, K.RU_MARKS), "cyrillic"))
    )


def detect_language(c: Column) -> Column:
    """uz, ru, en or other by scripts, telling letters and stop words."""
    plain = F.regexp_replace(c, "[ʻʼ'’‘`]", "")
    runs = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))
    word = F.transform(runs, F.lower)

    def hits(listed):
        return F.size(F.filter(word, lambda w: w.isin(*dict.fromkeys(listed))))

    n_cyrillic, n_latin = F.regexp_count(c, F.lit(CYRILLIC_RE)), F.regexp_count(c, F.lit(LATIN_RE))
    letters = F.regexp_count(c, F.lit(r"[\p{L}\p{Nl}\p{No}]"))
    uz_c, ru = hits(K.UZ_CYRILLIC_STOPWORDS), hits(K.RU_STOPWORDS)
    uz_l, en = hits(K.UZ_LATIN_STOPWORDS), hits(K.EN_STOPWORDS)
    cyrillic = (
        F.when(c.rlike(f"[{K.CYRILLIC_FOREIGN}]") & (uz_c == 0) & (ru == 0), "other")
        .when(2 * F.regexp_count(c, F.lit(f"[{K.RU_CYRILLIC}]")) + ru > 2 * F.regexp_count(c, F.lit(f"[{K.UZ_CYRILLIC}]")) + uz_c, "ru")
        .otherwise("uz")
    )
    latin = F.when(en > uz_l, "en").when((uz_l == 0) & c.rlike(f"[{K.LATIN_FOREIGN}]"), "other").otherwise("uz")
    return F.when(letters == 0, "uz").when(F.greatest(n_cyrillic, n_latin) < letters * 0.5, "other").when(n_cyrillic >= n_latin, cyrillic).otherwise(latin)


# ---------------------------------------------------------------- words, sentences, chunks


def let(value: Column, body) -> Column:
    """body(value), with value computed once for all its uses, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums_before(n: Column) -> Column:
    """For each number the sum of those before it, in blocks of about the root of their count, as a fold copies what it has."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))
    block = F.ceil(F.sqrt(F.size(n))).cast("int")
    firsts = F.sequence(F.lit(1), F.size(n), block)
    sums = F.transform(firsts, lambda i: F.aggregate(F.slice(n, i, block), zero, step))
    bases = lambda s: F.aggregate(F.transform(s, lambda x: x["at"]), zero, step)["starts"]
    whole = let(sums, lambda s: F.flatten(F.zip_with(s, bases(s), lambda x, o: F.transform(x["starts"], lambda v: v + o))))
    return F.when(F.size(n) > 0, whole).otherwise(F.array().cast("array<int>"))


def with_offsets(pieces: Column) -> Column:
    """array of struct(text, start, end) for the pieces of a text laid end to end."""
    placed = lambda t, s: F.struct(t.alias("text"), s.alias("start"), (s + F.length(t)).alias("end"))
    return let(pieces, lambda p: let(F.transform(p, lambda t: F.length(t)), lambda n: F.zip_with(p, _sums_before(n), placed)))


WORD_PIECES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s\p{Z}\p{Cf}]|[\s\p{Z}\p{Cf}]+"


def canonical_words(c: Column) -> Column:
    """Maximal letter-digit runs and every other visible character alone, with offsets."""
    all_ = with_offsets(F.regexp_extract_all(c, F.lit(WORD_PIECES), F.lit(0)))
    return F.filter(all_, lambda w: ~w["text"].rlike(r"^[\s\p{Z}\p{Cf}]+$"))


def looks_clean(c: Column) -> Column:
    """At least 20 words, enough letters, few one-letter pieces, usual word lengths."""
    w = words(c)
    n = F.size(w)
    letter = r"[\p{L}\p{Nl}\p{No}]"
    short = F.size(F.filter(w, lambda x: F.regexp_count(x, F.lit(letter)) <= 1))
    mean = F.try_divide(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("double"), n.cast("double"))
    return F.coalesce((n >= 20) & (F.try_divide(F.regexp_count(c, F.lit(letter)).cast("double"), F.length(c).cast("double")) >= 0.6) & (F.try_divide(short.cast("double"), n.cast("double")) <= 0.2) & mean.between(3.0, 14.0), F.lit(False))


def split_chunks(c: Column, most: int) -> Column:
    """Paragraphs joined greedily up to `most` characters; an over-long paragraph stays whole."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("buffer"), F.lit(0).alias("n"))

    def step(a, p):
        full = (a["n"] + F.length(p) > most) & a["buffer"].isNotNull()
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["buffer"]))).otherwise(a["done"]).alias("done"),
            F.when(full | a["buffer"].isNull(), p).otherwise(F.concat(a["buffer"], F.lit("\n"), p)).alias("buffer"),
            (F.when(full, 0).otherwise(a["n"]) + F.length(p) + 1).alias("n"),
        )

    folded = F.aggregate(F.split(c, "\n"), zero, step, lambda a: F.concat(a["done"], F.array(a["buffer"])))
    return F.when(F.length(c) <= most, F.array(c)).otherwise(folded)


def sentences(c: Column, least: int = 6, most: int = 40) -> Column:
    """Pieces after a closing mark and space, with least to most words."""
    parts = F.transform(F.split(c, rf"(?<=[.!?…]){SPACE}+"), strip)
    return F.filter(parts, lambda s: F.size(words(s)).between(least, most))


def spaced(tokens: Column) -> Column:
    """Tokens with a space before each but the first, closing marks, and what follows an opening mark."""
    before, after = _one_of(K.NO_SPACE_BEFORE), _one_of(K.NO_SPACE_AFTER)

    def told(all_):
        def piece(t, i):
            glued = (i == 0) | t.rlike(f"^{before}") | F.coalesce(F.get(all_, i - 1), F.lit("")).rlike(f"{after}$")
            return F.when(glued, t).otherwise(F.concat(F.lit(" "), t))

        return F.transform(all_, piece)

    return let(tokens, told)


def detokenize(tokens: Column) -> Column:
    """Tokens joined by spaces, none before closing marks and after opening ones."""
    return F.array_join(spaced(tokens), "")


def trim_parenthesis(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)[\s\p{Z}]*\(.*$", ""), "[ .]+$", "")


def clean_span(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) without non-alphanumeric edges; null for spans that begin with an apostrophe or cut a word."""
    surface = F.substring(text, start + 1, end - start)
    left = F.length(F.regexp_extract(surface, r"^[^\p{L}\p{N}]*", 0))
    right = F.length(F.regexp_extract(surface, r"[^\p{L}\p{N}]*$", 0))
    s, e = start + left, end - right
    before = F.regexp_extract(F.substring(text, F.lit(1), s), r"[^\s\p{Z}]*$", 0)
    after = F.regexp_extract(F.substring(text, e + 1, F.length(text)), r"^[^\s\p{Z}]*", 0)
    bad = surface.rlike("^['’ʻʼ]") | (left == F.length(surface)) | before.rlike(ALNUM) | (after.rlike(ALNUM) & ~after.rlike("^['’ʻʼ]"))
    return F.when(~bad, F.struct(s.alias("start"), e.alias("end")))


def quality_flags(c: Column) -> Column:
    return F.struct(F.size(words(c)).alias("n_words"), looks_clean(c).alias("clean"))


def trim_offsets(c: Column, offsets: Column) -> Column:
    """Token offsets without leading white space; a token of white space only becomes empty."""

    def trimmed(o):
        token = F.substring(c, o["start"] + 1, o["end"] - o["start"])
        skip = F.length(F.regexp_extract(token, f"^{SPACE}*", 0))
        return F.struct((o["start"] + skip).alias("start"), o["end"].alias("end"))

    return F.transform(offsets, trimmed)


def composed(c: Column) -> Column:
    """NFC, no-break spaces as spaces, no format characters; composition has no built-in and runs on Arrow batches."""
    return F.regexp_replace(F.regexp_replace(_nfc()(c), r"[\x{a0}\x{202f}\x{2007}]", " "), r"\p{Cf}", "")


def _nfc():
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.pandas_udf(nfc, "string")
