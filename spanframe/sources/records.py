"""Readers and writers of records: JSON lines, column text, buckets, caches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.text import repair_mojibake, strip
from spanframe.operators.ordered import running_before
from spanframe.operators.validation import valid

RECORD = "hash string, text string, entities array<struct<label:string,start:int,end:int>>, source string"


def read_jsonl(spark: SparkSession, path: str, strict: bool = True, labels: tuple[str, ...] | None = None, require_entities: bool = False, limit: int | None = None) -> DataFrame:
    """Records of JSON lines. Strict: a blank or bad line, an empty or repeated hash, invalid entities or a file set
    without records raise an error that names the file and the line. limit: the first so many records by file and place.
    """
    lines = _lines(spark, path)
    if not strict:
        lines = lines.where(F.col("value").rlike(r"\S"))
    if limit is not None:
        lines = lines.orderBy("file", "block", "turn").limit(limit)
    if strict:
        lines = running_before(lines, F.lit(1), ["turn"], F.col("block"), ["file"], "line")
    parsed = lines.select("value", F.concat_ws(":", "file", *([(F.col("line") + 1).cast("string")] if strict else [])).alias("file"), F.try_parse_json("value").alias("json"), F.from_json("value", RECORD).alias("r"))
    if not strict:
        return parsed.select("r.*")
    if not lines.limit(1).count():
        raise ValueError(f"no records: {path}")
    r = F.col("r")
    bad = F.col("json").isNull() | r["hash"].isNull() | (r["hash"] == "") | r["text"].isNull()
    if require_entities:
        bad |= r["entities"].isNull()
    bad |= r["entities"].isNotNull() & ~valid(r["entities"], F.length(r["text"]), labels)
    kept = parsed.select(F.when(bad, F.raise_error(F.concat(F.lit("invalid record in "), F.col("file"), F.lit(": "), F.left("value", F.lit(200))))).otherwise(r).alias("r")).select("r.*")
    count = F.count("*").over(Window.partitionBy("hash"))
    once = kept.withColumn("_n", count)
    return once.select(*(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated hash: "), "hash"))).otherwise(F.col(c)).alias(c) if c == "hash" else F.col(c) for c in kept.columns))


def write_jsonl(df: DataFrame, path: str, keep_meta: bool = True) -> None:
    """One compact JSON object per line; without keep_meta only hash, text and entities."""
    out = df if keep_meta else df.select("hash", "text", "entities")
    out.select(F.to_json(F.struct(*out.columns)).alias("value")).write.mode("overwrite").text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A small report as one JSON lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, turn, value) of text files: lines of a split stand in the order of turn, splits in that of block, the byte where they begin.

    A large file is read as several splits, in any store; a line belongs to the split that it begins in.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * F.lit(1)).alias("block"), "value")
    return lines.withColumn("turn", F.monotonically_increasing_id())


def _told_before(lines: DataFrame, key: str) -> DataFrame:
    """lines with `new`, 1 where the key is not that of the line before in the file: across splits that of the last line of an earlier one."""
    split = Window.partitionBy("file", "block").orderBy("turn")
    rows = lines.withColumns({"_first": F.row_number().over(split) == 1, "_before": F.lag(key).over(split)})
    last = lines.groupBy("file", "block").agg(F.max_by(F.struct(key), "turn").alias("_last"))  # a row a split
    earlier = last.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.lag("_last").over(Window.partitionBy("file").orderBy("block")).alias("_earlier"))
    joined = rows.join(earlier, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    inside = ~F.col(key).eqNullSafe(F.col("_before"))
    across = F.col("_earlier").isNull() | ~F.col(key).eqNullSafe(F.col(f"_earlier.{key}"))
    new = F.when(F.col("_first"), across).otherwise(inside).cast("int")
    return joined.withColumn("new", new).drop("_first", "_before", "_file", "_block", "_earlier")


def read_tagged_tsv(spark: SparkSession, path: str, sentence: str, token: str, tag: str, fix_mojibake: bool = False, least: int = 1) -> DataFrame:
    """sentence (running number), tokens, tags: rows of one key in a row are one sentence; rows without token or with fewer
    columns than `least` go, no tag is O. The first line names the columns. Files are split; a sentence may run over a split's end.
    """
    lines = _lines(spark, path)
    first = lines.where("block = 0").groupBy("file").agg(F.min("turn").alias("_head"), F.min_by(F.split("value", "\t"), "turn").alias("names"))
    cells = lines.join(first, "file").where(~((F.col("block") == 0) & (F.col("turn") == F.col("_head")))).withColumn("c", F.split("value", "\t")).where(F.size("c") >= least)
    at = lambda n: F.get("c", F.array_position("names", n).cast("int") - 1)
    table = cells.select("file", "block", "turn", at(sentence).alias("key"), at(token).alias("token"), F.coalesce(F.nullif(at(tag), F.lit("")), F.lit("O")).alias("tag")).where(F.coalesce("token", F.lit("")) != "")
    if fix_mojibake:
        table = table.withColumn("token", repair_mojibake(F.col("token")))
    told = _told_before(table, "key")
    numbered = running_before(told, F.col("new"), ["turn"], F.col("block"), ["file"], "island")
    return _sentences(numbered.withColumn("island", F.col("island") + F.col("new")))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """The same of text with a token in the first and a tag in the last column; blank lines end sentences."""
    blank = (strip(F.col("value")) == "").cast("int")
    rows = running_before(_lines(spark, path), blank, ["turn"], F.col("block"), ["file"], "island")
    parts = F.split(strip(F.col("value")), r"\s+")
    return _sentences(rows.where(blank == 0).select("file", "block", "turn", "island", F.get(parts, F.lit(0)).alias("token"), F.element_at(parts, -1).alias("tag")))


def _sentences(table: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("block", "turn", "token", "tag")))
    grouped = table.groupBy("file", "island").agg(rows.alias("r"))
    return grouped.select("file", F.col("island").alias("sentence"), F.transform("r", lambda x: x["token"]).alias("tokens"), F.transform("r", lambda x: x["tag"]).alias("tags"))


def decode_tag_ids(ids, names: list[str]):
    """Tag numbers as names."""
    listed = F.array(*map(F.lit, names))
    return F.transform(ids, lambda i: F.get(listed, i))


def long_texts(df: DataFrame, column: str, least: int = 200) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.length(column) >= least))


def write_bucket(df: DataFrame, path: str, val_every: int, order: list[str], bucket, text_col: str = "text", least: int = 0) -> None:
    """text partitioned by split: every val_every-th kept row is validation. A finished bucket stays as it is."""
    from spanframe.operators.sampling import every_nth

    kept = df.where(F.length(strip(F.col(text_col))) >= least)
    if not finished(df.sparkSession, path):
        every_nth(kept, val_every, order, bucket).select("split", text_col).write.mode("overwrite").partitionBy("split").parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder ended; what a lost run left there is no result."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def scaled_budgets(scale: float) -> dict[str, int]:
    return {k: int(v * scale) for k, v in K.CORPUS_BUDGETS.items()}


def cache_key(payload: dict) -> str:
    """First 24 hex digits of the SHA-256 of the payload as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:24]


def cached(df: DataFrame, root: str, payload: dict) -> DataFrame:
    """df from the folder of its payload's key, written there once; a finished folder is never rewritten."""
    path = f"{root}/{cache_key(payload)}"
    if not finished(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
