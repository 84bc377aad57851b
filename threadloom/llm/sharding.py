"""Sharding by vector bin packing.

What is packed is groups of equal texts, each a vector (bytes, tokens, rows).  There can be
billions of groups, so they are packed in *units*: a group's digest picks one of ``units``
cells, and the cells' vectors are sums that one map-side combined aggregation makes.  A
group too large for that (over 1/64 of a shard in any dimension) is a unit of its own, found
by drilling into the few cells that are too large; one larger than a shard is split by row
into pieces of about 1/``PIECES`` of a shard, since no law of near equal sizes could hold otherwise.
The driver gets at most ``units`` + 6 * 64 * shards vectors, a bound set by parameters and not by
the data.
It places them largest first, each where the dot product with the residual capacity is highest
among the shards whose bytes still allow it, so the law ``bytes`` holds: sizes near equal.

Slots number the rows of a shard without gaps: each unit (or piece) starts where the one
before it in its shard ends, so rows are numbered within units only and no task ever
sorts a whole shard.

Columns of other names are ignored, also where they clash with those made here.

Defined results: a null text has no bytes, the crc of the empty string and size 8; null ids
come last within their unit; repeated rows get slots of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.workspace import materialize

#: Cells for groups of equal texts; production value for any input size.
UNITS = 8192
#: Pieces a shard's worth of a large group, in which its rows are numbered and, beyond a shard's size, placed.
PIECES = 64
#: Weights of bytes, tokens and rows in the dot product.
WEIGHTS = (4.0, 1.0, 1.0)
#: Bytes, as a share of a shard, within which shards count as equally empty: the room in which tokens and rows decide.
SLACK = 0.005


def place(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Shard of each vector; rows of ``vectors`` are (bytes, tokens, rows) of units.

    Largest share first.  A unit goes where the weighted dot product of its vector and the
    residual capacity is highest; ties go to the lowest shard.  Bytes are the law: among
    the candidates are only shards whose bytes are within one unit, or ``SLACK``, of the emptiest.
    """
    total = vectors.sum(axis=0).astype(float)
    share = vectors / np.where(total > 0, total, 1) * shards
    w = np.asarray(weights)
    order = np.lexsort((np.arange(len(share)), -share.max(axis=1), -share[:, 0]))
    left, out = np.ones((shards, 3)), np.zeros(len(share), np.int64)
    for i in order:
        near = left[:, 0] >= left[:, 0].max() - max(share[i, 0], SLACK)
        score = np.where(near, (left * w) @ share[i], -np.inf)
        out[i] = s = int(np.argmax(score))
        left[s] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = 24, units: int = UNITS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            F.monotonically_increasing_id().alias("uid"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
            F.unhex(F.md5(text.cast("binary"))).alias("g"),
        ).withColumn("cell", F.pmod(F.xxhash64("g"), F.lit(units)).cast("int")),
        "sizes",
    )
    measure = (F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    cells = rows.groupBy("cell").agg(*measure).collect()  # at most ``units`` rows
    total = np.array([[c.b, c.t, c.r] for c in cells], float).reshape(-1, 3).sum(axis=0)
    large = total / (64 * shards)
    over = [c.cell for c in cells if any(x > y for x, y in zip((c.b, c.t, c.r), large, strict=True))]
    heavy = []
    if over:
        groups = rows.where(F.col("cell").isin(over)).groupBy("cell", "g").agg(*measure)
        hits = [F.col(c) > F.lit(float(y)) for c, y in zip("btr", large, strict=True)]
        heavy = groups.where(hits[0] | hits[1] | hits[2]).collect()  # under 3 * 64 * shards rows
        heavy.sort(key=lambda h: bytes(h.g))  # so the plan doesn't depend on how rows were dealt
    per = np.array([[h.b, h.t, h.r] for h in heavy], float).reshape(-1, 3) / np.where(total > 0, total, 1) * shards
    pieces = np.ceil(per.max(axis=1) * PIECES).astype(int) if len(heavy) else np.empty(0, int)  # shares sum up to ``shards`` in each measure
    offset = units + np.concatenate(([0], np.cumsum(pieces)))
    whole = {i for i, h in enumerate(heavy) if all(x <= y for x, y in zip((h.b, h.t, h.r), total / shards, strict=True))}
    ids = [(bytearray(h.g), int(o), int(n), i in whole) for i, (h, o, n) in enumerate(zip(heavy, offset, pieces, strict=False))]
    ids = spark.createDataFrame(ids, "hg binary, off int, pieces int, whole boolean")
    # rows are dealt to pieces by what they are; only rows without an id, of a group beyond a shard, by their place
    known = F.coalesce("doc_id", F.when(F.col("whole"), F.lit(-1)).otherwise(F.col("uid")))
    piece = F.pmod(F.xxhash64(known, "text_crc32", F.lit("piece")), F.col("pieces")).cast("int")
    tagged = rows.join(F.broadcast(ids), F.col("g") == F.col("hg"), "left").withColumn("unit", F.when(F.col("off").isNull(), F.col("cell")).otherwise(F.col("off") + piece))
    sums = sorted(tagged.groupBy("unit").agg(*measure).collect(), key=lambda x: x.unit)  # bounded as above
    of = lambda unit: int(np.searchsorted(offset, unit, "right")) - 1
    owner = [-1 - of(s.unit) if s.unit >= units and of(s.unit) in whole else s.unit for s in sums]
    names = sorted(set(owner))
    at = {x: i for i, x in enumerate(names)}
    vectors = np.zeros((len(names), 3))
    for s, x in zip(sums, owner, strict=True):
        vectors[at[x]] += (s.b, s.t, s.r)
    placed = place(vectors, shards) if len(names) else []
    start, plan = [0] * shards, []
    for s, x in zip(sums, owner, strict=True):
        to = int(placed[at[x]])
        plan.append((s.unit, to, start[to]))
        start[to] += s.r
    plan = spark.createDataFrame(plan, "unit int, shard int, start long")
    within = Window.partitionBy("unit").orderBy(F.asc_nulls_last("doc_id"), "g", "size")
    return (
        tagged.withColumn("rn", F.row_number().over(within))
        .join(F.broadcast(plan), "unit")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens",
        )
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
