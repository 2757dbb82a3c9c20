"""Records assembled, mixed and reported on."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions.constants import LABELS
from spanframe.operators import alignment as A
from spanframe.operators import assembly as B
from spanframe.operators import reports as R
from spanframe.operators.fixtures import SPANS_SQL, candidates, gold_spans, label_name, read
from spanframe.operators.scoring import label_metrics, match
from spanframe.operators.validation import unknown_labels as unknown
from spanframe.plans.base import query
from spanframe.plans.decode_queries import _PIECES_SQL, _pieces
from spanframe.plans.span_queries import _MATCH, _PRF, spans


def _docs(spark, sf_dir, *columns):
    return read(spark, sf_dir, "documents").select(*columns)


@query("""WITH x AS (SELECT doc_id, source, string_split(text, '. ') AS parts FROM documents), y AS (SELECT doc_id, source, unnest(parts) AS part, unnest(generate_series(0, len(parts) - 1)) AS i FROM x),
t AS (SELECT doc_id, i, source, regexp_extract_all(part, '[A-Za-z0-9]+') AS tok FROM y), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS place, array_to_string(tok, ' ') AS line FROM t),
g AS (SELECT *, place // 4 AS grp, coalesce(sum(length(line) + 1) OVER (PARTITION BY source, place // 4 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM r),
d AS (SELECT source, grp, string_agg(line, chr(10) ORDER BY place) AS text FROM g GROUP BY 1, 2),
w AS (SELECT source, grp, place, base, unnest(tok) AS word, unnest(generate_series(1, len(tok))) AS pos FROM g),
p AS (SELECT *, base + coalesce(sum(length(word) + 1) OVER (PARTITION BY source, place ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w),
e AS (SELECT source, grp, count(*) AS n, sum(start)::BIGINT AS starts, sum(start + length(word))::BIGINT AS ends FROM p WHERE regexp_full_match(word, '[A-Z][a-z]+') AND length(word) % 4 < 3 GROUP BY 1, 2)
SELECT sha1(d.source || ':' || (grp + 1) || ':' || text) AS hash, d.source, length(text) AS n_chars, coalesce(n, 0) AS n, coalesce(starts, 0) AS starts, coalesce(ends, 0) AS ends FROM d LEFT JOIN e USING (source, grp)""")
def assembled_records(spark, sf_dir):
    """Words of the documents' sentences with tags; a fourth label is not mapped."""
    parts = _docs(spark, sf_dir, "doc_id", "source", "lang", F.posexplode(F.split("text", r"\. ")).alias("i", "part"))
    tokens = F.regexp_extract_all("part", F.lit("[A-Za-z0-9]+"), F.lit(0))
    names = F.array(*(F.lit(f"B-{x}") for x in (*LABELS, "OTHER")))
    tags = F.transform("tokens", lambda t: F.when(t.rlike("^[A-Z][a-z]+$"), F.get(names, F.length(t) % 4)).otherwise("O"))
    sentences = parts.select("source", "lang", (F.shiftleft("doc_id", 20) + F.col("i")).alias("sentence"), tokens.alias("tokens")).withColumn("tags", tags)
    out = B.assembled(sentences, {x: x for x in LABELS}, bucket=F.shiftright("sentence", 20 + 9))  # 512 documents
    total = lambda c: F.aggregate("entities", F.lit(0).cast("long"), lambda a, e: a + e[c])
    return out.select("hash", "source", F.length("text").cast("long").alias("n_chars"), F.size("entities").cast("long").alias("n"), total("start").alias("starts"), total("end").alias("ends"))


def _records(spark, sf_dir):
    """hash, text, entities, source of the documents with their gold spans."""
    e = F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("e")
    g = gold_spans(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(e)
    entities = F.transform(F.coalesce("e", F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")), lambda x: F.struct(x["label"].alias("label"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))
    return _docs(spark, sf_dir, "doc_id", "text", "source").join(g, "doc_id", "left").select(F.col("doc_id").cast("string").alias("hash"), "text", entities.alias("entities"), "source")


@query(SPANS_SQL + """, n AS (SELECT doc_id, source, count(gold.doc_id) AS n FROM documents LEFT JOIN gold USING (doc_id) GROUP BY 1, 2), h AS (SELECT *, doc_id::VARCHAR AS hash, md5('13|' || doc_id) AS h FROM n),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT hash, source, n FROM b WHERE before < CASE source WHEN 'src1' THEN 50 WHEN 'src2' THEN 200 ELSE 1000000000 END
UNION ALL SELECT CASE r WHEN 0 THEN hash ELSE hash || '-r1' END, source, n FROM h, (VALUES (0), (1)) v(r) WHERE source = 'src3'""")
def mixed_records(spark, sf_dir):
    """Sources capped by their entities, one of them twice more below."""
    records = _records(spark, sf_dir)
    return B.mixed(records, {"src1": 50, "src2": 200}, 13, records.where("source = 'src3'")).select("hash", "source", F.size("entities").cast("long").alias("n"))


@query(SPANS_SQL + """, k2 AS (SELECT source, ['ORG', 'NAME', 'GEO'][CAST(lab AS INT) + 1] AS label, lower(word) AS stem FROM c JOIN documents USING (doc_id)), f AS (SELECT label, stem, min(source) AS source FROM k2 GROUP BY 1, 2),
a AS (SELECT source, label, count(*) AS n FROM f GROUP BY 1, 2), l AS (SELECT DISTINCT source, label FROM k2)
SELECT l.source, l.label, (SELECT count(*) FROM documents d WHERE d.source = l.source) AS n_docs, (SELECT count(*) FROM k2 WHERE k2.source = l.source) AS n_mentions, coalesce(a.n, 0) AS n_added FROM l LEFT JOIN a ON a.source = l.source AND a.label = l.label""")
def source_report(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    mentions = candidates(docs).select("doc_id", label_name(F.col("lab")).alias("label"), F.col("word").alias("stem"), F.lit("latin").alias("script"))
    return R.source_report(docs.select("source"), mentions.join(docs.select("doc_id", "source"), "doc_id"))


@query("""WITH w AS (SELECT * FROM (VALUES ('src1', 500, 0.5), ('src2', 300, 0.3), ('nowhere', 200, 0.2)) v(source, draws, weight)), n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT source, coalesce(n, 0) AS n, draws::BIGINT AS draws, weight::DOUBLE AS weight, round(draws::DOUBLE / greatest(coalesce(n, 0), 1), 2) AS coverage FROM w LEFT JOIN n USING (source)""")
def coverage_report(spark, sf_dir):
    return R.coverage(_docs(spark, sf_dir, "source"), "source", {"src1": 0.5, "src2": 0.3, "nowhere": 0.2}, 1000)


@query(_MATCH + """, x AS (SELECT * FROM m WHERE fp + fn > 0), f AS (SELECT DISTINCT doc_id FROM x ORDER BY doc_id LIMIT 20), s2 AS (SELECT x.*, d.text, x.label || ':' || substring(d.text, CAST(x.start + 1 AS BIGINT), CAST(x."end" - x.start AS BIGINT)) AS shown FROM x JOIN f USING (doc_id) JOIN documents d USING (doc_id))
SELECT doc_id, any_value(CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END) AS text, coalesce(string_agg(shown, ', ' ORDER BY start, "end", label) FILTER (fn = 1), '') AS missed, coalesce(string_agg(shown, ', ' ORDER BY start, "end", label) FILTER (fp = 1), '') AS spurious FROM s2 GROUP BY doc_id""")
def error_sample(spark, sf_dir):
    """The first 20 documents with errors: the report shows no more."""
    return R.error_sample(match(*spans(spark, sf_dir)), _docs(spark, sf_dir, "doc_id", "text"))


@query(_MATCH + f""", pl AS (SELECT l.label, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn FROM (VALUES ('ORG'), ('NAME'), ('GEO')) l(label) LEFT JOIN m ON l.label = m.label GROUP BY 1),
a AS (SELECT label AS scope, tp, fp, fn, {_PRF} FROM pl UNION ALL SELECT 'micro', tp, fp, fn, {_PRF} FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM pl)
UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(coalesce(tp / nullif(tp + fp, 0), 0.0)), 6), round(avg(coalesce(tp / nullif(tp + fn, 0), 0.0)), 6), round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)), 6) FROM pl)
SELECT scope, printf('%-8s %10.4f %10.4f %10.4f', scope, precision, recall, f1) || ' ' || lpad(coalesce(tp::VARCHAR, '-'), 8, ' ') || ' ' || lpad(coalesce(fp::VARCHAR, '-'), 8, ' ') || ' ' || lpad(coalesce(fn::VARCHAR, '-'), 8, ' ') AS line FROM a""")
def metrics_lines(spark, sf_dir):
    return R.metrics_lines(label_metrics(match(*spans(spark, sf_dir))))


@query(SPANS_SQL + """SELECT DISTINCT label FROM gold WHERE doc_id % 2 = 1 AND label NOT IN (SELECT label FROM gold WHERE doc_id % 2 = 0 AND label <> 'GEO')""")
def unknown_labels(spark, sf_dir):
    gold = gold_spans(read(spark, sf_dir, "documents"))
    return unknown(gold.where("doc_id % 2 = 0 and label <> 'GEO'"), gold.where("doc_id % 2 = 1"))


@query(_PIECES_SQL + """, hit AS (SELECT tk.doc_id, token, arg_min(CASE WHEN tk.start <= g.start AND g.start < tk."end" THEN 'B-' ELSE 'I-' END || g.label, g.start) AS tag FROM tk JOIN gold g ON tk.doc_id = g.doc_id AND tk.start < g."end" AND g.start < tk."end" GROUP BY 1, 2)
SELECT tk.doc_id, tk.token AS pos, coalesce(tag, 'O') AS tag FROM tk LEFT JOIN hit ON tk.doc_id = hit.doc_id AND tk.token = hit.token""")
def covering_bio(spark, sf_dir):
    """B on the token that holds a span's first character, else I."""
    tokens = _pieces(spark, sf_dir)[0].select("doc_id", F.col("token").alias("pos"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    return A.covering_tags(tokens, gold_spans(read(spark, sf_dir, "documents")))


@query("""WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents) SELECT doc_id, coalesce(length(array_to_string(w[1:64], ' ')) < length(rtrim(text)), false) AS truncated FROM d""")
def truncated_texts(spark, sf_dir):
    """Whether a text goes on after its first 64 words."""
    docs = _docs(spark, sf_dir, "doc_id", "text")
    first = F.slice(F.split("text", " "), 1, 64)
    tokens = docs.select("doc_id", F.length(F.array_join(first, " ")).alias("t_end"))
    return A.truncated(tokens, docs)


@query(SPANS_SQL + """SELECT doc_id, count(*) AS n FROM gold JOIN documents USING (doc_id) WHERE NOT coalesce(source = 'src1' AND label = 'ORG', false) GROUP BY 1""")
def source_without_label(spark, sf_dir):
    left = B.without_label(F.col("entities"), F.col("source"), {"src1": "ORG"})
    return _records(spark, sf_dir).select(F.col("hash").cast("long").alias("doc_id"), F.size(left).cast("long").alias("n")).where("n > 0")
