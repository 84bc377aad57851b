"""Lineage cuts: intermediate tables in the folder that the whole cluster shares.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only a session
that names none (a local test) gets a folder of its own.  Tables are written as
Parquet, so a lost executor costs a re-read and never a recomputation, and a reader
fetches only the columns it needs.  They are removed when the driver ends.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as a Hadoop path."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, with a folder for each value of ``by``, and return it as read back from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/threadloom/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _written.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made._tl_path = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the table of ``materialize`` that ``df`` reads; nothing may read it any more."""
    for i, (spark, path) in enumerate(_written):
        if path == getattr(df, "_tl_path", None):
            del _written[i]
            _delete(spark, path)
            return


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def sweep() -> None:
    """Delete every intermediate table of this driver; frames that read them end too."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may already be gone; nothing else depends on it
            return


atexit.register(sweep)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a frame, by Arrow: from a list, executors would start a pool of Python workers of its own to unpickle them."""
    fields = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in schema.split(","))])
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever columns its owner added."""
    taken, name = {c.lower() for c in df.columns}, f"__tl_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let Arrow batches to Python end at ``most`` bytes, unless the session's bound is lower still."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < bound <= most:
        spark.conf.set(key, str(most))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written already."""
    gc.collect()
    spark._jvm.System.gc()


#: Bits of a sieve: its words, 2**17 rows of 16 bytes at most, are broadcast whatever the tables' sizes.
SIEVE = 23


def sieve(df: DataFrame, hash_: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows that may be among ``wanted``, and rows that aren't.

    ``hash_`` hashes a row of ``df``, the column h of ``wanted`` is the same hash of what is wanted.
    Only the first part needs a join, so long texts that aren't wanted don't move.  A full
    sieve lets all through: then that join takes everything.
    """
    bit, word, bits = (fresh(df, x) for x in ("bit", "word", "bits"))
    place = F.pmod(F.col("h"), F.lit(1 << SIEVE))
    words = wanted.select(place.alias(bit)).groupBy(F.shiftright(bit, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({bit} & 63 as int))")).alias(bits))
    words = materialize(words, "sieve")
    marked = df.withColumn(bit, F.pmod(hash_, F.lit(1 << SIEVE))).withColumn(word, F.shiftright(bit, 6)).join(F.broadcast(words), word, "left")
    inside = F.coalesce(F.expr(f"shiftright({bits}, cast({bit} & 63 as int)) & 1"), F.lit(0)) == 1
    columns = [F.col(f"`{c}`") for c in df.columns]
    return marked.where(inside).select(*columns), marked.where(~inside).select(*columns)
