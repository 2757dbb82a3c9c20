"""Corpus building, sampling and pools."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanframe.functions import text as T
from spanframe.operators import ordered as O
from spanframe.operators import pool as P
from spanframe.operators import sampling as R
from spanframe.operators.fixtures import SPANS_SQL, candidates, label_name, read
from spanframe.operators.statistics import exact_mode
from spanframe.plans.base import query

_BEFORE = "coalesce(sum({v}) OVER ({p}ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


def _docs(spark, sf_dir, *columns):
    return read(spark, sf_dir, "documents").select(*columns)


@query(f"""WITH h AS (SELECT doc_id, source, n_chars, md5('7|' || doc_id) AS h FROM documents), b AS (SELECT *, {_BEFORE.format(v="n_chars", p="PARTITION BY source ", o="h, doc_id")} AS before FROM h)
SELECT doc_id, source, before::BIGINT AS before FROM b WHERE before < 20000""")
def running_cap(spark, sf_dir):
    """Shuffle, then cap each source's characters; the row that crosses the cap stays."""
    rows = R.shuffled(_docs(spark, sf_dir, "doc_id", "source", "n_chars"), 7, "doc_id")
    return O.capped(rows, F.col("n_chars"), F.lit(20000), ["_h", "doc_id"], R.hash_bucket(), ["source"]).select("doc_id", "source", "before")


@query(f"""WITH b AS (SELECT doc_id, text, {_BEFORE.format(v="n_chars", p="PARTITION BY lang ", o="doc_id")} AS before FROM documents)
SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk FROM b WHERE before < 50000""")
def budget_by_doc(spark, sf_dir):
    """Character budget per language over documents; every chunk of the crossing document stays."""
    kept = O.capped(_docs(spark, sf_dir, "doc_id", "lang", "n_chars"), F.col("n_chars"), F.lit(50000), ["doc_id"], F.floor(F.col("doc_id") / 4096), ["lang"])
    return _docs(spark, sf_dir, "doc_id", "text").join(kept.select("doc_id"), "doc_id").select("doc_id", F.explode(F.split("text", "\n")).alias("chunk"))


@query(f"""WITH b AS (SELECT doc_id, n_chars, {_BEFORE.format(v="n_chars", p="", o="doc_id")} AS before, (SELECT sum(n_chars) FROM documents) AS total FROM documents)
SELECT doc_id, CASE WHEN before < total / 2 THEN 'first' ELSE 'second' END AS bucket FROM b""")
def budget_overflow_bucket(spark, sf_dir):
    """Rows in order until half of all characters, the overflow to a second bucket."""
    docs = _docs(spark, sf_dir, "doc_id", "n_chars")
    total = docs.agg(F.sum("n_chars").alias("total"))
    rows = O.running_before(docs, F.col("n_chars"), ["doc_id"], F.floor(F.col("doc_id") / 4096)).join(F.broadcast(total))
    return rows.select("doc_id", F.when(F.col("before") < F.col("total") / 2, "first").otherwise("second").alias("bucket"))


@query("SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) % 50 = 49 THEN 'validation' ELSE 'train' END AS split FROM documents")
def every_nth_split(spark, sf_dir):
    return R.every_nth(_docs(spark, sf_dir, "doc_id"), 50, ["doc_id"], F.floor(F.col("doc_id") / 4096)).select("doc_id", "split")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS turn FROM documents)
SELECT doc_id, source, turn, row_number() OVER (ORDER BY turn, source) - 1 AS place FROM r""")
def interleave_sources(spark, sf_dir):
    """Round-robin over sources until all are used up: turn within the source, then place over all."""
    turns = O.row_index(_docs(spark, sf_dir, "doc_id", "source"), ["doc_id"], F.floor(F.col("doc_id") / 4096), ["source"], "turn")
    return O.row_index(turns, ["turn", "source"], F.floor(F.col("turn") / 64), name="place")


@query("""WITH r AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS grp FROM conversations)
SELECT conv_id, grp, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM r GROUP BY 1, 2""")
def group_of_four(spark, sf_dir):
    return R.groups_of(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), 4, "conv_id", "turn", "text")


@query("""WITH r AS (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM r""")
def gaps_islands(spark, sf_dir):
    return O.islands(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "role", "turn", "conv_id")


@query("""WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 16 - 1, 0), 48)) AS start FROM d)
SELECT doc_id, start, list_sort(w[start + 1 : start + 64]) AS words FROM s""")
def sliding_windows(spark, sf_dir):
    """Windows of 64 words that overlap by 16 and cover the text."""
    w = F.split("text", " ")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 16 - 1, F.lit(0)), F.lit(48))
    rows = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", w.alias("w"), F.explode(starts).alias("start"))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.array_sort(F.slice("w", F.col("start") + 1, F.lit(64))).alias("words"))


@query("""WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 16 - 1, 0), 48)) AS start FROM d),
p AS (SELECT doc_id, start, unnest(generate_series(start, least(start + 63, len(w) - 1))) AS pos FROM s), q AS (SELECT doc_id, pos, ((doc_id + pos * 7 + start) % 100) / 100 AS score FROM p)
SELECT doc_id, pos, round(avg(score), 6) AS score, count(*) AS n FROM q GROUP BY 1, 2""")
def window_score_average(spark, sf_dir):
    """Scores of overlapping windows averaged at each word."""
    w = F.size(F.split("text", " "))
    rows = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", w.alias("n_words"), F.explode(F.sequence(F.lit(0), F.greatest(w - 17, F.lit(0)), F.lit(48))).alias("start"))
    places = rows.select("doc_id", "start", F.explode(F.sequence(F.col("start").cast("long"), F.least(F.col("start") + 63, F.col("n_words") - 1).cast("long"))).alias("pos"))
    score = F.pmod(F.col("doc_id") + F.col("pos") * 7 + F.col("start"), F.lit(100)) / 100
    return places.groupBy("doc_id", "pos").agg(F.round(F.avg(score), 6).alias("score"), F.count("*").alias("n"))


_WEIGHTS = {"src1": 0.35, "src2": 0.25, "src3": 0.25, "src4": 0.15}


@query("""WITH n AS (SELECT source, sum(n_chars)::DOUBLE AS w FROM documents GROUP BY 1), q AS (SELECT source, round_even(w / sum(w) OVER () * 1001, 0)::BIGINT AS quota, row_number() OVER (ORDER BY w DESC, source) AS i FROM n)
SELECT source, quota + CASE WHEN i = 1 THEN 1001 - (SELECT sum(quota) FROM q) ELSE 0 END::BIGINT AS quota FROM q""")
def quota_allocation(spark, sf_dir):
    """1,001 places dealt to the sources by their characters."""
    chars = _docs(spark, sf_dir, "source", "n_chars").groupBy("source").agg(F.sum("n_chars").alias("weight"))
    return R.allocated(chars, "source", "weight", 1001)


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT * FROM (VALUES ('src1', 35), ('src2', 25), ('src3', 25), ('src4', 15)) v(source, k)),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('3|' || doc_id), doc_id) - 1 AS i FROM documents),
t AS (SELECT doc_id, source, k // n + CASE WHEN i < k % n THEN 1 ELSE 0 END AS times FROM r JOIN n USING (source) JOIN k USING (source))
SELECT doc_id, source, unnest(generate_series(0, times - 1))::INT AS pass FROM t WHERE times > 0""")
def oversample_passes(spark, sf_dir):
    return R.draws(_docs(spark, sf_dir, "doc_id", "source"), "source", "doc_id", R.quotas(_WEIGHTS, 100), 3)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('5|' || doc_id), doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents), p AS (SELECT doc_id, idx FROM r UNION ALL SELECT doc_id, idx + n FROM r WHERE idx < (7 - n % 7) % 7)
SELECT doc_id, idx FROM p WHERE idx % 7 = 2""")
def rank_stride(spark, sf_dir):
    return R.rank_slice(_docs(spark, sf_dir, "doc_id"), "doc_id", 5, 7, 2).select("doc_id", "idx")


@query("""SELECT CASE r WHEN 0 THEN sha1(source || ':' || doc_id || ':' || text) ELSE sha1(source || ':' || doc_id || ':' || text) || '-r' || r END AS hash, doc_id, r FROM documents, (VALUES (0), (1)) v(r)
UNION ALL SELECT 'b' || lpad(item_id::VARCHAR, 6, '0'), item_id, 0 FROM benchmark""")
def union_replicate(spark, sf_dir):
    """Content ids, two copies of each document with a suffix, and another source below."""
    h = F.sha1(F.concat_ws(":", "source", F.col("doc_id").cast("string"), "text").cast("binary"))
    docs = read(spark, sf_dir, "documents").select(h.alias("h"), "doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("r"))
    copies = docs.select(F.when(F.col("r") == 0, F.col("h")).otherwise(F.concat("h", F.lit("-r"), "r")).alias("hash"), "doc_id", "r")
    other = read(spark, sf_dir, "benchmark").select(F.format_string("b%06d", "item_id").alias("hash"), F.col("item_id").alias("doc_id"), F.lit(0).alias("r"))
    return copies.unionByName(other)


_MENTIONS = SPANS_SQL + """, k2 AS (SELECT lower(word) AS stem, ['ORG', 'NAME', 'GEO'][CAST(CASE WHEN length(word) % 3 = 0 THEN 0 ELSE lab END AS INT) + 1] AS label, word, doc_id, pos FROM c)
"""


def _mentions(spark, sf_dir):
    c = candidates(read(spark, sf_dir, "documents"))
    lab = F.when(F.length("word") % 3 == 0, 0).otherwise(F.col("lab"))
    return c.select(F.lower("word").alias("stem"), label_name(lab).alias("label"), "word", "doc_id", "pos")


@query(_MENTIONS + """, n AS (SELECT stem, label, count(*) AS n FROM k2 GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY stem) AS total FROM n)
SELECT stem, label, n, total::BIGINT AS total, round(n / total, 6) AS purity FROM t WHERE total >= 2 AND n >= 0.6 * total""")
def type_purity(spark, sf_dir):
    n = _mentions(spark, sf_dir).groupBy("stem", "label").agg(F.count("*").alias("n"))
    t = n.withColumn("total", F.sum("n").over(Window.partitionBy("stem")))
    return t.where("total >= 2 and n >= 0.6 * total").withColumn("purity", F.round(F.col("n") / F.col("total"), 6))


@query(_MENTIONS + """, a AS (SELECT left(stem, 4) AS stem, word, count(*) AS n, min(doc_id * 100000 + pos) AS first FROM k2 GROUP BY 1, 2)
SELECT stem, arg_max(word, n * 1000000000000 - first) AS mode, sum(n)::BIGINT AS n FROM a GROUP BY 1""")
def stem_mode_spelling(spark, sf_dir):
    m = _mentions(spark, sf_dir).select(F.left("stem", F.lit(4)).alias("stem"), "word", (F.shiftleft("doc_id", 32) + F.col("pos")).alias("ord"))
    return exact_mode(m, "stem", "word", "ord")


@query(_MENTIONS + """, r AS (SELECT *, row_number() OVER (PARTITION BY label, stem ORDER BY doc_id, pos) AS i FROM k2) SELECT label, stem, word, doc_id, pos FROM r WHERE i = 1""")
def pool_dedupe_first_wins(spark, sf_dir):
    return P.dedupe_first(_mentions(spark, sf_dir).select("label", "stem", "word", "doc_id", "pos"), ["label", "stem"], ["doc_id", "pos"])


@query("""SELECT source, lang, count(*) AS chunks, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars < 200) AS dropped FROM documents GROUP BY 1, 2""")
def bucket_accounting(spark, sf_dir):
    d = _docs(spark, sf_dir, "source", "lang", "n_chars")
    return d.groupBy("source", "lang").agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 200).alias("dropped"))


@query("""SELECT lang, round(exp(sum(n_chars * ln(1 + doc_id % 17)) / sum(n_chars)), 6) AS perplexity, sum(n_chars)::BIGINT AS weight FROM documents GROUP BY lang""")
def perplexity_by_lang(spark, sf_dir):
    """exp of the weighted mean loss per language."""
    loss = F.log(1 + F.col("doc_id") % 17)
    d = _docs(spark, sf_dir, "doc_id", "lang", "n_chars")
    return d.groupBy("lang").agg(F.round(F.exp(F.sum(F.col("n_chars") * loss) / F.sum("n_chars")), 6).alias("perplexity"), F.sum("n_chars").alias("weight"))


@query("""WITH d AS (SELECT doc_id, lang, n_chars, source, md5('9|' || doc_id) AS h FROM documents WHERE n_chars > 60 AND n_chars < 400), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS i FROM d)
SELECT doc_id, lang, source FROM r WHERE i = 1""")
def few_shot_pick(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "lang", "source", "n_chars").where("n_chars > 60 and n_chars < 400").drop("n_chars")
    return R.few_shots(d, ["lang", "source"], "doc_id", 9)


@query("""WITH s AS (SELECT DISTINCT source FROM documents), w AS (SELECT * FROM (VALUES ('src1'), ('src2'), ('nowhere')) v(source))
SELECT source, 'no weight' AS side FROM s WHERE source NOT IN (SELECT source FROM w) UNION ALL SELECT source, 'no data' FROM w WHERE source NOT IN (SELECT source FROM s)""")
def source_agreement(spark, sf_dir):
    from spanframe.operators.validation import source_agreement as check

    return check(_docs(spark, sf_dir, "source"), "source", {"src1": 0.5, "src2": 0.3, "nowhere": 0.2})
