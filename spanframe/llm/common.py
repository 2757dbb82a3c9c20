"""What the operators of this subpackage share: inputs, checkpoints, word caches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

#: ASCII white space, the only separators of the word operators.
SPACE = " \t\n\x0b\x0c\r"


def bounded(spark: SparkSession) -> None:
    """Arrow batches within BATCH_ROWS rows and BATCH_BYTES bytes, for what this session runs from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table, read in small Arrow batches downstream."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="spanframe-"))
    return where


_OWN: dict[str, str] = {}


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    freed(spark)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that have ended; it waits for the driver's collector otherwise."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(b: pa.RecordBatch, text: int, rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    """b in slices of at most so many rows, and of so many bytes in column `text` unless one row has more."""
    size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < b.num_rows:
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, total[at] + chars, "right")) - 1))
        yield b.slice(at, end - at)
        at = end


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a stored() table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


#: Most bits of a broadcast filter of keys (8 MB).
FILTER_BITS = 1 << 26


class KeyFilter:
    """A broadcast bitmap of long keys: holds() is true of every key put in, and of others by chance.

    It has 16 bits a key, FILTER_BITS at most, and is put together in parts by the executors. It only
    spares work: whatever passes by chance has to be dropped by a join after it.
    """

    def __init__(self, keys: DataFrame, column: str):
        self.size = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (16 * keys.count()).bit_length()))
        slots = keys.select(self.slot(F.col(column)).alias("slot")).distinct().withColumn("part", F.shiftright("slot", 16))
        bits = bytearray(self.size >> 3)
        for r in slots.groupBy("part").applyInArrow(_part_of_bits, "part long, bits binary").collect():
            bits[r["part"] << 13 : (r["part"] + 1) << 13] = r["bits"]
        self.bits = keys.sparkSession.sparkContext.broadcast(bytes(bits))

    def slot(self, key: Column) -> Column:
        """The place of a key; a null one counts as 0."""
        return F.pmod(F.xxhash64(F.coalesce(key, F.lit(0).cast("long"))), F.lit(self.size))

    def holds(self, slots: pa.Array) -> np.ndarray:
        """In tasks: which slots are set."""
        at = slots.to_numpy()
        return np.frombuffer(self.bits.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _part_of_bits(t: pa.Table) -> pa.Table:
    here = np.zeros(1 << 16, np.uint8)
    here[t["slot"].to_numpy() & 0xFFFF] = 1
    return pa.table({"part": t["part"][:1], "bits": pa.array([np.packbits(here, bitorder="little").tobytes()], pa.binary())})


def divided(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose long key in `column` is surely none of keys' only column, all others): told by broadcast bitmaps of
    16 bits a key, FILTER_BITS at most, so that only the others need to meet the keys in a shuffle."""
    size = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (16 * keys.count()).bit_length()))

    def slot(key: str) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(0).cast("long"))), F.lit(size))

    set_ = keys.select(slot(keys.columns[0]).alias("slot_"))
    bits = set_.groupBy(F.bitmap_bucket_number("slot_").alias("part_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot_")).alias("bits_"))
    met = rows.withColumn("slot_", slot(column)).withColumn("part_", F.bitmap_bucket_number("slot_")).join(F.broadcast(bits), "part_", "left")
    at = F.bitmap_bit_position("slot_")
    byte = F.conv(F.hex(F.substring("bits_", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return tuple(met.where(h).select(*rows.columns) for h in (~held, held))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def texts(column: pa.Array) -> list[str]:
    """Strings of a text column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def id_crc(doc_id: int | None) -> int:
    """crc32 of the id as text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_mod(col: str, n: int):
    """The same in the JVM."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; an absolute path stands for itself."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_WORKER: dict = {}


def fresh() -> None:
    """Drops what earlier operators left in this Python worker and hands freed memory back to the system."""
    _WORKER.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def per_worker(kind: str, key, make: Callable):
    """make() once per Python worker and kind, again when key changes.

    Task functions are sent by value with what they refer to; this one is found in its module, so what
    it keeps lasts from task to task.
    """
    if kind not in _WORKER or _WORKER[kind][0] != key:
        _WORKER.pop(kind, None)
        _WORKER[kind] = (key, make())
    return _WORKER[kind][1]


class WordCache(dict):
    """Word -> value; clears itself back to its fixed part at a bound, so worker memory stays bounded."""

    def __init__(self, limit: int, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.limit, self.fixed = limit + len(fixed or {}), fixed or {}

    def learn(self, words: set, encode: Callable[[list], list]) -> None:
        """Adds what is missing of words; a set larger than the bound is allowed for the moment of one batch."""
        missing = [w for w in words if w not in self]
        if missing:
            if len(self) + len(missing) > self.limit:
                self.clear()
                self.update(self.fixed)
                missing = [w for w in words if w not in self]
            self.update(zip(missing, encode(missing), strict=True))
