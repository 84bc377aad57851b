"""The rows of a table that stay, by decisions about (digest, doc_id) keys, without moving the texts of most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.workspace import fresh, materialize, sieve


def key_hash(digest: Column, doc_id: Column) -> Column:
    return F.xxhash64(digest, F.coalesce(doc_id.cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, digest: Column, found: DataFrame, order: list[Column]) -> DataFrame:
    """Of each key (digest, doc_id) the first ``times`` rows by ``order``, with all columns of ``docs``.

    ``found`` has digest, doc_id, the number of rows with them, and ``times``, how many stay.  Keys
    of which all rows stay need no join, so the texts that stay don't move as long as the
    sieve isn't full; nulls in doc_id are a value like others.
    """
    dg, key, mine, times, rank = (fresh(docs, x) for x in ("dg", "key", "id", "times", "rank"))
    touched = found.where("times < rows").select(F.col("digest").alias(key), F.col("doc_id").alias(mine), F.col("times").alias(times))
    touched = materialize(touched, "touched")
    left = docs.withColumn(dg, digest)
    maybe, clear = sieve(left, key_hash(F.col(dg), F.col("doc_id")), touched.select(key_hash(F.col(key), F.col(mine)).alias("h")))
    met = maybe.join(touched, (F.col(dg) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(mine)), "left").where(F.coalesce(times, F.lit(1)) > 0)
    met = met.withColumn(rank, F.row_number().over(Window.partitionBy(dg, "doc_id").orderBy(*order)))
    met = met.where(F.col(times).isNull() | (F.col(rank) <= F.col(times)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return clear.select(*columns).union(met.select(*columns))
