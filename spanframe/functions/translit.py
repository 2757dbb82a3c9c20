"""Transliteration between the Cyrillic and the Latin alphabet, with offsets."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.text import let, prepare, unify_apostrophes, with_offsets

#: Words (letter runs) and what is between them; casing is decided by word.
_RUNS = r"[\p{L}\p{Nl}\p{No}]+|[^\p{L}\p{Nl}\p{No}]+"
_CYRILLIC = r"[\x{400}-\x{4ff}]"


def _table(mapping: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))


def _cased(piece: Column, source: Column, all_caps: Column) -> Column:
    first = source.substr(F.lit(1), F.lit(1))
    upper = (first == F.upper(first)) & (first != F.lower(first))
    return F.when(all_caps, F.upper(piece)).when(upper, F.concat(F.upper(piece.substr(F.lit(1), F.lit(1))), piece.substr(F.lit(2), F.lit(9)))).otherwise(piece)


def _caps(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _latin_letters(w: Column) -> Column:
    table, chars, caps = _table(K.CYRILLIC_TO_LATIN), F.split(w, ""), _caps(w)

    def piece(ch, i):
        low = F.lower(ch)
        plain = F.element_at(table, low)
        starts = (i == 0) | F.lower(F.get(chars, i - 1)).isin(*K.YE_AFTER)
        mapped = F.when((low == "е") & starts, F.lit("ye")).otherwise(plain)
        return F.struct(ch.alias("source"), F.when(mapped.isNull(), ch).otherwise(_cased(mapped, ch, caps)).alias("piece"))

    return F.transform(chars, piece)


def latin_pieces(c: Column) -> Column:
    """array of struct(source, piece): what each character of Cyrillic text becomes, the rest unchanged."""
    return F.flatten(F.transform(F.regexp_extract_all(c, F.lit(_RUNS), F.lit(0)), _latin_letters))


_ONE = {a: b for a, b in K.CYRILLIC_TO_LATIN.items() if len(b) == 1}
_OTHER = {a: b for a, b in K.CYRILLIC_TO_LATIN.items() if len(b) != 1}


def _small_latin(w: Column) -> Column:
    """A word of small letters, all at once."""
    out = F.when(F.contains(w, F.lit("е")), F.regexp_replace(w, f"^е|(?<=[{K.YE_AFTER}])е", "ye")).otherwise(w)
    for a, b in _OTHER.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, "".join(_ONE), "".join(_ONE.values()))


def cyrillic_to_latin(c: Column) -> Column:
    """As latin_pieces(); only words with capitals, whose case is decided by word, go letter by letter."""
    by_letter = lambda w: F.array_join(F.transform(_latin_letters(w), lambda p: p["piece"]), "")
    word = lambda w: F.when(w.rlike(_CYRILLIC), F.when(w == F.lower(w), _small_latin(w)).otherwise(by_letter(w))).otherwise(w)
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_RUNS), F.lit(0)), word), "")


def cyrillic_pieces(c: Column) -> Column:
    """array of struct(source, piece) of Latin text: pairs first, then letters; a source of two letters is one piece."""
    pairs, single = _table(K.LATIN_PAIRS), _table(K.LATIN_TO_CYRILLIC)
    pattern = "(?is)" + "|".join(K.LATIN_PAIRS) + "|."

    def word(w):
        caps = _caps(w)

        def piece(s):
            low = F.lower(s)
            mapped = F.coalesce(F.element_at(pairs, low), F.element_at(single, low))
            return F.struct(s.alias("source"), F.when(mapped.isNull(), s).otherwise(_cased(mapped, s, caps)).alias("piece"))

        return F.transform(F.regexp_extract_all(w, F.lit(pattern), F.lit(0)), piece)

    return F.flatten(F.transform(F.regexp_extract_all(c, F.lit(_RUNS), F.lit(0)), word))


def latin_to_cyrillic(c: Column) -> Column:
    return F.array_join(F.transform(cyrillic_pieces(c), lambda p: p["piece"]), "")


def corpus_latin_to_cyrillic(c: Column) -> Column:
    """The corpus builder's variant: literal pairs in order, э at the start of words, then single letters."""
    out = prepare(c)
    for latin, cyrillic in K.CORPUS_PAIRS:
        out = F.replace(out, F.lit(latin), F.lit(cyrillic))
    edge = r"(?<![\p{L}\p{N}_])"
    out = F.regexp_replace(F.regexp_replace(out, f"{edge}e", "э"), f"{edge}E", "Э")
    return F.translate(out, K.CORPUS_LATIN, K.CORPUS_CYRILLIC)


def moves(source: Column, to: str) -> Column:
    """struct(text, at): the other alphabet's text, and for each place of the old text, its end too, the place in the new one; null inside a pair."""

    def told(pieces):
        ends = let(with_offsets(F.transform(pieces, lambda p: p["piece"])), lambda o: F.concat(F.array(F.lit(0)), F.transform(o, lambda x: x["end"])))
        # A pair of letters takes two old places, of which the first is inside it.
        own = lambda e: F.zip_with(pieces, F.slice(e, F.lit(2), F.size(pieces)), lambda p, x: F.when(F.length(p["source"]) == 2, F.array(F.lit(None).cast("int"), x)).otherwise(F.array(x)))
        at = F.concat(F.array(F.lit(0)), F.flatten(let(ends, own)))
        return F.struct(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"), at.alias("at"))

    return let(latin_pieces(source) if to == "latin" else cyrillic_pieces(source), told)


def _cased_text(piece: str, source: str, all_caps: bool) -> str:
    first = source[:1]
    if all_caps:
        return piece.upper()
    return piece[:1].upper() + piece[1:] if first == first.upper() and first != first.lower() else piece


def run_pieces(word: str, to: str) -> list[tuple[str, str]]:
    """(source, piece) of a run as latin_pieces() and cyrillic_pieces() have them."""
    caps, out = word == word.upper() and word != word.lower(), []
    sources = list(word) if to == "latin" else _PIECES.findall(word)
    for i, source in enumerate(sources):
        low = source.lower()
        if to == "latin":
            mapped = "ye" if low == "е" and (not i or sources[i - 1].lower() in _YE_AFTER) else K.CYRILLIC_TO_LATIN.get(low)
        else:
            mapped = K.LATIN_PAIRS.get(low, K.LATIN_TO_CYRILLIC.get(low))
        out.append((source, source if mapped is None else _cased_text(mapped, source, caps)))
    return out


_PIECES = re.compile("(?is)" + "|".join(K.LATIN_PAIRS) + "|.", re.ASCII)
_YE_AFTER = frozenset(K.YE_AFTER)
_SPLIT = re.compile(r"[^\W\d_]+|[\W\d_]+")
#: Runs that a worker remembers, and texts that are put together in one go.
RUNS, TOGETHER = 200_000, 500


@lru_cache(maxsize=RUNS)
def _run(run: str, to: str) -> str:
    return "".join(p for _, p in run_pieces(run, to))


def _word(word: str, to: str) -> str:
    return _run(word, to) if word.isalpha() else "".join([_run(r, to) for r in _SPLIT.findall(word)])


_PAIRS = re.compile("|".join(K.LATIN_PAIRS))
_LETTERS = {ord(a): b for a, b in K.LATIN_TO_CYRILLIC.items() if len(a) == 1}


def _words(words: list[str], to: str) -> list[str]:
    """Words in the other alphabet: to Cyrillic those of small letters, but for a first ASCII one, all at once."""
    if to == "latin":
        return [_word(w, to) for w in words]
    low = [w.lower() for w in words]
    first = [w != x and w[0].isascii() and w[0].isupper() and w[1:2].islower() and w[1:] == x[1:] for w, x in zip(words, low, strict=True)]
    small = " ".join([x if w == x or f else "" for w, x, f in zip(words, low, first, strict=True)])
    done = _PAIRS.sub(lambda m: K.LATIN_PAIRS[m.group()], small).translate(_LETTERS).split(" ")
    return [d if w == x else d[0].upper() + d[1:] if f else _word(w, to) for w, x, f, d in zip(words, low, first, done, strict=False)]


@lru_cache(maxsize=RUNS)
def _inside(word: str, at: int, to: str) -> int | None:
    """Where a place within a word goes in what it becomes; None inside a pair."""
    old = new = 0
    for run in _SPLIT.findall(word):
        for source, piece in run_pieces(run, to):
            if old >= at:
                return new if old == at else None
            old, new = old + len(source), new + len(piece)
    return new if old == at else None


def _moved(texts: pa.Array, lists: pa.Array, to: str) -> pa.StructArray:
    """transliterate() for texts and their spans; runs of letters end at spaces, so words between these are looked up."""
    split = pc.split_pattern(texts, " ")
    n = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(split).dictionary_encode()
    new = pa.array(_words(words.dictionary.to_pylist(), to), pa.string()).take(words.indices)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), new), " ")
    row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n

    def placed(length: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        length = length.to_numpy(zero_copy_only=False).astype(np.int64)
        passed = np.append(0, np.cumsum(length + 1))[:-1]
        return length, passed - passed[first[row]]

    of_word, letters = words.indices.to_numpy(zero_copy_only=False), pc.utf8_length(words.dictionary)
    (old_n, old_at), (new_n, new_at) = placed(letters.take(words.indices)), placed(pc.utf8_length(new))
    each = lists.flatten()
    count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(n)), count)
    whole = np.full(len(n), -1)
    whole[n > 0] = (old_at + old_n)[(first + n - 1)[n > 0]]
    far = int(whole.max(initial=0)) + 2

    def moved(name: str) -> tuple[np.ndarray, np.ndarray]:
        at = pc.struct_field(each, name)
        lacks = at.is_null().to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        lacks |= (at < 0) | (at > whole[of])
        out = np.zeros(len(at), np.int64)
        some = np.flatnonzero(~lacks)
        word = np.searchsorted(row * far + old_at, of[some] * far + at[some], "right") - 1
        rest = at[some] - old_at[word]
        out[some] = new_at[word] + np.where(rest == old_n[word], new_n[word], 0)
        for i in np.flatnonzero((rest > 0) & (rest < old_n[word])).tolist():
            place = _inside(words.dictionary[of_word[word[i]]].as_py(), int(rest[i]), to)
            if place is None:
                lacks[some[i]] = True
            else:
                out[some[i]] += place
        return out, lacks

    (start, no_start), (end, no_end) = moved("start"), moved("end")
    inside = np.bincount(of, weights=no_start | no_end, minlength=len(n)) > 0
    gone = np.bincount(of, weights=start >= end, minlength=len(n)) > 0
    reason = pa.array(np.where(inside, "inside a pair", "vanished").astype(object), pa.string(), mask=~(inside | gone))
    told = inside | gone
    spans = pa.StructArray.from_arrays([pc.struct_field(each, "label").cast(pa.string()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["label", "start", "end"])
    no_list = told | lists.is_null().to_numpy(zero_copy_only=False)
    entities = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), spans, mask=pa.array(no_list))
    no_text = pa.array(told | texts.is_null().to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pc.if_else(no_text, pa.scalar(None, pa.string()), joined), entities, reason], names=["text", "entities", "reason"])


_MOVED = "struct<text:string,entities:array<struct<label:string,start:int,end:int>>,reason:string>"


def transliterate(text: Column, entities: Column, to: str) -> Column:
    """struct(text, entities, reason): spans follow their pieces; null with a reason where one cannot.

    A span may not begin or end inside a pair that becomes one letter, nor vanish. Runs of letters are looked up in the worker.
    """

    @F.arrow_udf(_MOVED)
    def told(texts: pa.Array, lists: pa.Array) -> pa.Array:
        parts = [_moved(texts.slice(i, TOGETHER), lists.slice(i, TOGETHER), to) for i in range(0, max(1, len(texts)), TOGETHER)]
        return pa.concat_arrays(parts)

    return told(unify_apostrophes(text), entities)
