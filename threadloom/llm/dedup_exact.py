"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical without white space.  One scan turns each row
into a digest row (no text), written to the shared folder.  Misra-Gries finds the digests
that may be frequent, one exact count verifies them, and those winners - at most
``HEAVY + 1`` rows - are broadcast, so that copies from large groups leave on the map side.
Every other digest has under 3/(HEAVY+1) of the rows and takes an ordinary shuffle.

Defined results: a null text counts as empty; empty texts are one group; a null doc_id
loses ties against any other; of rows that agree in everything one stays, whichever was
read first; an empty table gives an empty result; other columns are ignored by
``duplicates`` and carried along by ``keep_first``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.keep import keep_rows
from threadloom.llm.sketch import heavy_keys
from threadloom.workspace import materialize, small_table

#: Counters of the frequent-digest sketch; also bounds the broadcast winners.
HEAVY = 1023

WHITE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without white space."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, "").cast("binary"), 256)


def duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest doc_id.
    """
    rows = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            F.char_length(F.coalesce("text", F.lit(""))).alias("n"),
            F.unhex(digest(F.col("text"))).alias("dg"),
        ),
        "digests",
    )
    spark = docs.sparkSession
    hashed = rows.select(F.xxhash64("dg").alias("h"))
    often = heavy_keys(hashed, lambda b: iter([b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)]), heavy)
    first = F.struct((-F.col("n")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("uid").alias("d"))
    candidates = F.broadcast(small_table(spark, [(x,) for x in often.tolist()], "h long"))
    winners = (
        rows.withColumn("h", F.xxhash64("dg"))
        .join(candidates, "h", "left_semi")
        .groupBy("dg")
        .agg(F.min(first).alias("best"), F.count("*").alias("size"))
        .select(F.col("dg").alias("w_dg"), F.col("best.c").alias("w_id"), F.col("best.d").alias("w_uid"), F.col("size").alias("w_size"))
        .orderBy(F.desc("w_size"))
        .limit(heavy + 1)
        if len(often)
        else small_table(spark, [], "w_dg binary, w_id long, w_uid long, w_size long")
    )
    winners = materialize(winners, "winners")
    marked = rows.join(F.broadcast(winners), F.col("dg") == F.col("w_dg"), "left")
    of_winner = marked.where(F.col("w_dg").isNotNull()).select("doc_id", "uid", "dg", F.col("w_id").alias("keep_id"), F.col("w_uid").alias("keep_uid"), F.col("w_size").alias("size"))
    group = Window.partitionBy("dg")
    order = group.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"), "uid")
    rest = marked.where(F.col("w_dg").isNull()).select(
        "doc_id", "uid", "dg", F.first("doc_id").over(order).alias("keep_id"), F.first("uid").over(order).alias("keep_uid"), F.count("*").over(group).alias("size")
    )
    return of_winner.unionByName(rest).select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("dg")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The documents that stay, with all their columns; of rows that agree in id and digest the longest."""
    found = duplicates(docs, heavy).groupBy(F.unhex("text_sha256").alias("digest"), "doc_id").agg(F.count("*").alias("rows"), F.sum(F.col("kept").cast("int")).alias("times"))
    return keep_rows(docs, F.unhex(digest(F.col("text"))), found, [F.desc(F.char_length(F.coalesce("text", F.lit(""))))])


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS dg FROM documents),
r AS (
  SELECT doc_id, dg, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY dg) AS group_size
  FROM t WINDOW w AS (PARTITION BY dg ORDER BY n DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, dg AS text_sha256 FROM r
"""
