"""Pools learned from the documents' mentions: stems by look-up, building, counts, replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions import text as T
from spanframe.operators import pool as P
from spanframe.operators import stems as S
from spanframe.operators.fixtures import label_name, named_words, read
from spanframe.plans.base import query

#: Endings that the mentions take in turn; every fifth has the word before it in front, as titles stand.
_ENDINGS = ("", "", "ning", "da", "ga", "dan")


def mentions(spark, sf_dir) -> DataFrame:
    """(doc_id, pos, label, surface, lang, ord) of capitalised words."""
    docs = read(spark, sf_dir, "documents")
    w = named_words(docs, "lang")
    front = F.when((F.col("pos") % 5 == 0) & F.col("before").rlike("^[A-Za-z]{2,20}$"), F.concat(F.upper(F.left("before", F.lit(1))), F.lower(F.substring("before", 2, 99)), F.lit(" "))).otherwise("")
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.pmod(F.col("doc_id") * 3 + F.col("pos"), F.lit(6)) + 1).cast("int"))
    label = label_name(F.when(F.length("word") % 3 == 0, 0).otherwise(F.pmod(F.col("doc_id") + F.col("pos"), F.lit(3))))
    return w.select("doc_id", "pos", label.alias("label"), F.concat(front, "word", ending).alias("surface"), (F.shiftleft("doc_id", 32) + F.col("pos")).alias("ord"), "lang")


_STEMS_SQL = r"""WITH w AS (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS word, unnest(generate_series(0, len(string_split(text, ' ')) - 1)) AS pos FROM documents),
b AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM w),
m AS MATERIALIZED (SELECT doc_id, pos, lang, doc_id * 4294967296 + pos AS ord, ['ORG', 'NAME', 'GEO'][CAST(CASE WHEN length(word) % 3 = 0 THEN 0 ELSE (doc_id + pos) % 3 END AS INT) + 1] AS label,
 (CASE WHEN pos % 5 = 0 AND regexp_full_match(before, '[A-Za-z]{2,20}') THEN upper(before[1]) || lower(before[2:]) || ' ' ELSE '' END) || word || ['', '', 'ning', 'da', 'ga', 'dan'][CAST((doc_id * 3 + pos) % 6 AS INT) + 1] AS surface
 FROM b WHERE regexp_full_match(word, '\p{Lu}\p{Ll}+') AND length(word) > 3),
clean AS MATERIALIZED (SELECT * FROM m WHERE regexp_matches(surface, '[A-Za-z]') AND len(list_filter(string_split(surface, ' '), lambda x: length(x) > 25)) = 0),
known AS MATERIALIZED (SELECT DISTINCT lower(surface) AS key FROM clean),
lasts AS MATERIALIZED (SELECT DISTINCT string_split(key, ' ')[-1] AS key FROM known WHERE contains(key, ' ')),
e AS (SELECT s.surface, ending, left(s.surface, length(s.surface) - length(ending)) AS stem FROM (SELECT DISTINCT surface FROM clean) s, (VALUES ('ning'), ('dagi'), ('dan'), ('da'), ('ga'), ('ka'), ('qa'), ('ni')) v(ending) WHERE lower(s.surface) LIKE '%' || ending),
l AS (SELECT *, string_split(stem, ' ')[-1] AS tail, len(regexp_extract_all(string_split(stem, ' ')[-1], '\p{L}')) AS letters FROM e),
cut AS MATERIALIZED (SELECT surface, stem, right(surface, length(ending)) AS ending FROM l WHERE letters >= 3 AND (lower(stem) IN (SELECT key FROM known) OR (contains(stem, ' ') AND lower(tail) IN (SELECT key FROM lasts)) OR (ending IN ('ning', 'dagi', 'dan') AND letters >= 4))),
stems AS MATERIALIZED (SELECT DISTINCT c.surface, coalesce(cut.stem, c.surface) AS stem, coalesce(cut.ending, '') AS ending FROM clean c LEFT JOIN cut USING (surface))
"""


@query(_STEMS_SQL + "SELECT surface, stem, ending FROM stems")
def mention_stems(spark, sf_dir):
    """Endings of all distinct mentions, cut by the dictionary of all of them."""
    m = mentions(spark, sf_dir).where(P.is_clean_mention(F.col("surface")))
    return S.split_endings(m, S.learned(m))


def _pool(spark, sf_dir) -> S.MentionPool:
    docs = read(spark, sf_dir, "documents").select("text")
    return S.build_pool(mentions(spark, sf_dir), 2, 0.5, reference_texts=docs)


_POOL_SQL = _STEMS_SQL + r""", r AS MATERIALIZED (SELECT clean.*, stems.stem, lower(stems.stem) AS key FROM clean JOIN stems USING (surface)),
bl AS (SELECT key, label, count(*) AS n, min(ord) AS first FROM r GROUP BY 1, 2),
pure AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY key) AS total, min(first) OVER (PARTITION BY key) AS seen FROM bl) WHERE total >= 2 AND n >= 0.5 * total),
sp AS (SELECT key, stem FROM (SELECT key, stem, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(ord)) AS i FROM r GROUP BY 1, 2) WHERE i = 1),
lg AS (SELECT key, lang FROM (SELECT key, lang, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(ord)) AS i FROM r GROUP BY 1, 2) WHERE i = 1),
common AS MATERIALIZED (SELECT word FROM (SELECT lower(x) AS word FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}][\p{L}\p{N}_''’‘ʻʼ\-]*')) AS x FROM documents) WHERE regexp_matches(x, '^\p{Ll}')) GROUP BY word HAVING count(*) >= 3),
parts AS (SELECT key, unnest(string_split(stem, ' ')) AS x, unnest(generate_series(0, len(string_split(stem, ' ')) - 1)) AS i FROM sp),
lead AS (SELECT key, coalesce(min(i) FILTER (common.word IS NULL), count(*)) AS lead, count(*) AS n_words FROM parts LEFT JOIN common ON lower(parts.x) = common.word GROUP BY key),
j AS (SELECT pure.label, pure.seen, lg.lang, CASE WHEN pure.label = 'NAME' THEN array_to_string(string_split(sp.stem, ' ')[least(lead, n_words - 1) + 1:], ' ') ELSE sp.stem END AS stem
 FROM pure JOIN sp USING (key) JOIN lg USING (key) JOIN lead USING (key) WHERE NOT (n_words = 1 AND lower(sp.stem) LIKE '%lar') AND (n_words > 2 OR lead < n_words)),
pool AS MATERIALIZED (SELECT label, stem, len(string_split(stem, ' '))::INT AS n_words, CASE WHEN regexp_matches(stem, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS script, lang FROM (SELECT *, row_number() OVER (PARTITION BY label, lower(stem) ORDER BY seen) AS i FROM j) WHERE i = 1)
"""


@query(_POOL_SQL + "SELECT label, stem, n_words, script, lang FROM pool")
def mention_pool(spark, sf_dir):
    """Stems that two mentions or more share and half of them label alike; titles and common words go."""
    return _pool(spark, sf_dir).entries.drop("source")


@query(_POOL_SQL + "SELECT label, 'total' AS slice, count(*) AS n FROM pool GROUP BY label UNION ALL SELECT label, lang || '-' || left(script, 3), count(*) FROM pool GROUP BY 1, 2")
def pool_stats_pivot(spark, sf_dir):
    return S.pool_stats(_pool(spark, sf_dir).entries)


@query()
def replaced_mentions(spark, sf_dir):
    """Another stem for every mention of the first round's stems, with its ending put back and in its case."""
    m = mentions(spark, sf_dir).where(P.is_clean_mention(F.col("surface")))
    cut = S.split_endings(m, S.learned(m))
    forms = m.select(F.col("doc_id").alias("id"), "label", "surface", "lang").distinct().join(cut, "surface")
    counted = m.groupBy("label", "surface", "lang").agg(F.count("*").alias("n"), F.min("ord").alias("first")).join(cut, "surface")
    by_lang = counted.groupBy("label", T.script_presence(F.col("stem")).alias("script"), F.lower("stem").alias("key"), "lang").agg(F.min("stem").alias("stem"), F.sum("n").alias("n"), F.min("first").alias("first"))
    pool = by_lang.groupBy("label", "script", "key").agg(F.min("stem").alias("stem"), F.max_by("lang", F.struct("n", -F.col("first"))).alias("lang")).withColumn("n_words", F.size(T.words(F.col("stem"))))
    asked = forms.select("id", "label", "stem", T.script_presence(F.col("stem")).alias("script"), "lang")
    new = P.replacements(asked, pool, 11, bias=1.5, extra=3)
    surface = P.match_case(P.attach_ending(F.col("new"), F.col("ending")), F.col("stem"))
    return forms.join(new, ["id", "label", "stem"]).select("id", "label", "surface", "stem", surface.alias("new"))
