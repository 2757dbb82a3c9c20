"""Span scoring, validation and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions import text as T
from spanframe.operators import scoring as S
from spanframe.operators.fixtures import SPANS_SQL, gold_spans, pred_spans, read, word_table
from spanframe.operators.validation import entity_errors
from spanframe.plans.base import query

_PRF = """round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1"""
_MATCH = SPANS_SQL + """, m AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.label, p.label) AS label, coalesce(g.start, p.start) AS start, coalesce(g."end", p."end") AS "end",
CAST(g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL AS INT) AS tp, CAST(g.doc_id IS NULL AS INT) AS fp, CAST(p.doc_id IS NULL AS INT) AS fn
FROM (SELECT DISTINCT * FROM gold) g FULL OUTER JOIN (SELECT DISTINCT * FROM pred) p ON g.doc_id = p.doc_id AND g.start = p.start AND g."end" = p."end" AND g.label = p.label)
"""
_SCRIPT_SQL = """CASE WHEN regexp_matches(text, '[A-zÀ-ɏ]') AND regexp_matches(text, '[Ѐ-ӿ]') THEN 'mixed' WHEN regexp_matches(text, '[A-zÀ-ɏ]') THEN 'latin' WHEN regexp_matches(text, '[Ѐ-ӿ]') THEN 'cyrillic' ELSE 'other' END"""


def spans(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return gold_spans(docs), pred_spans(docs)


@query(_MATCH + f""", pl AS (SELECT l.label, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn FROM (VALUES ('ORG'), ('NAME'), ('GEO')) l(label) LEFT JOIN m ON l.label = m.label GROUP BY 1)
SELECT label AS scope, tp, fp, fn, {_PRF} FROM pl
UNION ALL SELECT 'micro', tp, fp, fn, {_PRF} FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM pl)
UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(coalesce(tp / nullif(tp + fp, 0), 0.0)), 6), round(avg(coalesce(tp / nullif(tp + fn, 0), 0.0)), 6), round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)), 6) FROM pl""")
def exact_span_metrics(spark, sf_dir):
    return S.label_metrics(S.match(*spans(spark, sf_dir)))


@query(_MATCH + """, k AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = m.doc_id AND g.start = m.start AND g."end" = m."end") THEN 'type_only'
WHEN EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = m.doc_id AND g.start < m."end" AND m.start < g."end") THEN 'boundary_only' ELSE 'spurious' END AS kind FROM m WHERE fp = 1
UNION ALL SELECT 'missed' FROM m WHERE fn = 1 AND NOT EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = m.doc_id AND p.start < m."end" AND m.start < p."end"))
SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def error_taxonomy(spark, sf_dir):
    return S.error_kinds(*spans(spark, sf_dir))


@query(_MATCH + f""", d AS (SELECT doc_id, {_SCRIPT_SQL} AS script FROM documents), j AS (SELECT m.*, d.script FROM m JOIN d USING (doc_id)),
a AS (SELECT CASE WHEN grouping(label) = 0 THEN 'label:' || label WHEN grouping(script) = 0 THEN 'slice:' || script ELSE 'all' END AS scope, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM j GROUP BY GROUPING SETS ((label), (script), ()))
SELECT scope, tp, fp, fn, {_PRF} FROM a""")
def metrics_by_script(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return S.sliced_metrics(S.match(*spans(spark, sf_dir)), docs.select("doc_id", T.script_of(F.col("text")).alias("script")), "script")


@query(_MATCH + """, w2 AS (SELECT d.doc_id, coalesce(max(greatest(fp, fn)), 0) AS wrong FROM documents d LEFT JOIN m USING (doc_id) GROUP BY 1)
SELECT count(*) AS n_docs, count(*) FILTER (wrong = 0) AS n_right, round(count(*) FILTER (wrong = 0) / count(*), 6) AS accuracy FROM w2""")
def doc_accuracy(spark, sf_dir):
    return S.document_accuracy(S.match(*spans(spark, sf_dir)), read(spark, sf_dir, "documents"))


@query("""SELECT * FROM (SELECT 'missing' AS side, doc_id, count(*) OVER () AS total FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'extra', doc_id, count(*) OVER () FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) ORDER BY doc_id LIMIT 5)""")
def missing_extra_hashes(spark, sf_dir):
    """The first five ids on one side only, with how many there are: the report shows no more."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")

    def side(name, a, b):
        only = a.join(b, "doc_id", "left_anti")
        total = only.agg(F.count("*").alias("total"))
        return only.orderBy("doc_id").limit(5).select(F.lit(name).alias("side"), "doc_id").join(F.broadcast(total))

    return side("missing", docs, labels).unionAll(side("extra", labels, docs.where("doc_id % 3 <> 0")))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_subset(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(good, "doc_id", "left_semi")


@query("SELECT d.doc_id, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_default(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return read(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query(SPANS_SQL + """SELECT p.doc_id, p.start AS a_start, p."end" AS a_end, p.label AS a_label, g.start AS b_start, g."end" AS b_end, g.label AS b_label FROM pred p JOIN gold g ON p.doc_id = g.doc_id AND p.start < g."end" AND g.start < p."end" """)
def overlap_join(spark, sf_dir):
    gold, pred = spans(spark, sf_dir)
    return S.overlaps(pred, gold)


@query(SPANS_SQL + """SELECT p.doc_id, p.start, p."end", g.label AS gold_label, p.label AS pred_label FROM pred p JOIN gold g ON p.doc_id = g.doc_id AND p.start = g.start AND p."end" = g."end" WHERE p.label <> g.label""")
def same_bounds_other_label(spark, sf_dir):
    gold, pred = spans(spark, sf_dir)
    g = gold.withColumnRenamed("label", "gold_label")
    return pred.withColumnRenamed("label", "pred_label").join(g, ["doc_id", "start", "end"]).where("gold_label <> pred_label").select("doc_id", "start", "end", "gold_label", "pred_label")


@query(SPANS_SQL + """, g AS (SELECT doc_id, start, "end", label FROM gold UNION ALL SELECT doc_id, start, "end", label FROM gold WHERE start % 11 = 0 UNION ALL SELECT doc_id, start + 2, "end" + 2, 'PER' FROM gold WHERE start % 7 = 0 UNION ALL SELECT doc_id, start, "end" + 100000, label FROM gold WHERE start % 13 = 0),
n AS (SELECT g.*, length(text) AS n_chars, lead(start) OVER (PARTITION BY g.doc_id ORDER BY start, "end", label) AS next_start FROM g JOIN documents USING (doc_id)),
d AS (SELECT doc_id, max(c) > 1 AS duplicate FROM (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id, start, "end", label) GROUP BY 1)
SELECT n.doc_id, bool_or(label NOT IN ('ORG', 'NAME', 'GEO')) AS bad_label, bool_or(NOT (0 <= start AND start < "end" AND "end" <= n_chars)) AS bad_bounds, any_value(d.duplicate) AS duplicate, coalesce(bool_or(next_start < "end"), false) AS overlap FROM n JOIN d USING (doc_id) GROUP BY 1""")
def entity_validation(spark, sf_dir):
    """Gold spans, some of them twice, moved under another label, or beyond the text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    gold = gold_spans(docs)
    every = gold.unionAll(gold.where("start % 11 = 0")).unionAll(gold.where("start % 7 = 0").select("doc_id", F.col("start") + 2, F.col("end") + 2, F.lit("PER"))).unionAll(gold.where("start % 13 = 0").select("doc_id", "start", F.col("end") + 100_000, "label"))
    one = F.struct("label", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    rows = docs.join(every.groupBy("doc_id").agg(F.collect_list(one).alias("entities")), "doc_id")
    errors = entity_errors(F.col("entities"), F.length("text"))
    return rows.select("doc_id", *(errors[c].alias(c) for c in ("bad_label", "bad_bounds", "duplicate", "overlap")))


@query(SPANS_SQL + "SELECT label, count(*) AS n FROM gold GROUP BY label")
def label_counts(spark, sf_dir):
    return spans(spark, sf_dir)[0].groupBy("label").agg(F.count("*").alias("n"))


@query(SPANS_SQL + """, g AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY 1), d AS (SELECT documents.doc_id, len(string_split(text, ' ')) AS n_words, coalesce(g.n, 0) AS n, source FROM documents LEFT JOIN g USING (doc_id)),
r AS (SELECT n_words, row_number() OVER (ORDER BY n_words, doc_id) - 1 AS i, count(*) OVER () AS c FROM d)
SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT count(*) FROM d WHERE n > 0) AS n_with, (SELECT sum(n)::BIGINT FROM d) AS n_spans, (SELECT count(DISTINCT source) FROM d) AS n_sources,
(SELECT max(n_words) FROM r WHERE i = least(c - 1, CAST(floor(c * 0.5) AS BIGINT)))::BIGINT AS p50, (SELECT max(n_words) FROM r WHERE i = least(c - 1, CAST(floor(c * 0.95) AS BIGINT)))::BIGINT AS p95""")
def dataset_stats(spark, sf_dir):
    """Totals and index-rule percentiles of word counts; the percentile needs counts of each length only."""
    from spanframe.operators.statistics import index_percentiles

    docs = read(spark, sf_dir, "documents")
    n = spans(spark, sf_dir)[0].groupBy("doc_id").agg(F.count("*").alias("n"))
    d = docs.select("doc_id", "source", F.size(F.split("text", " ")).alias("n_words")).join(n, "doc_id", "left")
    totals = d.agg(F.count("*").alias("n_docs"), F.count_if(F.col("n") > 0).alias("n_with"), F.sum("n").alias("n_spans"), F.countDistinct("source").alias("n_sources"))
    return totals.join(F.broadcast(index_percentiles(d, "n_words", {"p50": 0.5, "p95": 0.95})))


@query("""SELECT coalesce(source, '<none>') AS source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (coalesce(source, '<none>'), lang)""")
def source_histogram(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("<none>")).alias("source"), "lang", "n_chars")
    return docs.rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '\\p{Ll}+') GROUP BY word HAVING count(*) >= 3""".replace("\\\\", "\\"))
def word_frequency_having(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).where(F.col("word").rlike(r"^\p{Ll}+$"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3")


@query(SPANS_SQL + """, k AS (SELECT CASE WHEN regexp_matches(w2.word, '^[A-Za-z]+$') THEN 'plain' ELSE 'other' END AS shape, g.label FROM gold g JOIN s w2 ON g.doc_id = w2.doc_id AND g.start = w2.start)
SELECT shape, label, count(*) AS n FROM k GROUP BY 1, 2""")
def surface_shapes(spark, sf_dir):
    """Surfaces taken out of the texts by their spans."""
    docs = read(spark, sf_dir, "documents")
    surface = word_table(docs).select("doc_id", "start", "word")
    j = gold_spans(docs).join(surface, ["doc_id", "start"])
    return j.select(F.when(F.col("word").rlike("^[A-Za-z]+$"), "plain").otherwise("other").alias("shape"), "label").groupBy("shape", "label").agg(F.count("*").alias("n"))
