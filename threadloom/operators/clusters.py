"""Checks of a clustering: silhouettes, null cosines, retrieval, splits of a leaf, stability under resampling.

Vectors are rows with an array.  What compares all with all works on blocks of arrays and returns a number a
point, never a row a pair; what draws at random draws by hashes, so that another engine finds the same rows.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from threadloom.operators.dialect import expand
from threadloom.operators.registry import register
from threadloom.operators.sqlop import canonical, twin
from threadloom.workspace import materialize, small_batches

#: Users of a block of the retrieval; points of a tile, and of a block of silhouettes.
TILE = 1024
POINTS = 4096


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, leaf, x of the embeddings in a leaf."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null and embedding is not null").selectExpr("vec_id as user_id", "label as leaf", "cast(embedding as array<double>) as x")


def dense_index(rows: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """``rows`` with their place (from 0) in their group by ``order``: sorted ranges, and the counts of the ranges before."""
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = materialize(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_run", F.shiftright("_at", 33))
    starts = runs.groupBy("_run", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")  # a row a range
    starts = starts.withColumn("_before", before).drop("_n")
    return runs.join(starts, ["_run", *group]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_run", "_first", "_before")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# C08 ------------------------------------------------------------------------------------------------


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``distances``, with those of near points, where the products cancel, taken from the differences."""
    x, y = (a * a).sum(1)[:, None], (b * b).sum(1)[None]
    square = x + y - 2 * a @ b.T
    i, j = np.nonzero(square < 1e-4 * (x + y))
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        square[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    return np.sqrt(square)


def silhouette(rows: DataFrame, most: int | None = None) -> DataFrame:
    """leaf (null for all), silhouette, n: means over all points (or ``most``, drawn by hash), each against all rows.

    Points alone in their leaf count 0, as they do where only one leaf is.  Blocks of points meet blocks of rows in
    order of their leaves; a pair of blocks gives an array of sums a leaf, so no task holds more than two blocks.
    """
    small_batches(rows.sparkSession)
    placed = dense_index(rows.select("user_id", "leaf", "x").withColumn("all", F.lit(0)), ["all"], ["leaf", "user_id"])
    packed = lambda df: df.groupBy(F.floor(F.col("pos") / POINTS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "leaf", "x"))).alias("m")).select("block", F.col("m.leaf").alias("leaf"), F.col("m.x").alias("x"))
    gallery = materialize(packed(placed), "gallery")
    asked = gallery
    if most is not None:
        drawn = rows.select("user_id", "leaf", "x").orderBy(F.md5(F.col("user_id").cast("string")), "user_id").limit(most)
        asked = materialize(packed(dense_index(drawn.withColumn("all", F.lit(0)), ["all"], ["leaf", "user_id"])), "asked")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = asked.select(F.col("block").alias("q"), F.col("x").alias("qx")).repartition(tasks, "q").crossJoin(gallery.select("leaf", "x"))

    def sums(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                q, a, leaf, b = (batch.column(c)[at] for c in range(4))
                a, leaf, b = _matrix(a.values), leaf.values.to_numpy(), _matrix(b.values)
                starts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
                of = np.concatenate([np.add.reduceat(_exact(a[i : i + TILE], b), starts, axis=1) for i in range(0, len(a), TILE)])
                n = np.diff(np.append(starts, len(leaf)))
                yield pa.RecordBatch.from_pydict({"q": [q.as_py()] * len(starts), "to_leaf": leaf[starts], "sums": list(of.T), "n": n}, schema=schema)

    schema = pa.schema([("q", pa.int64()), ("to_leaf", pa.int32()), ("sums", pa.list_(pa.float64())), ("n", pa.int64())])
    met = near.mapInArrow(sums, "q long, to_leaf int, sums array<double>, n long").select("q", "to_leaf", "n", F.posexplode("sums").alias("point", "sum"))
    met = met.groupBy("q", "point", "to_leaf").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    own = asked.select(F.col("block").alias("q"), F.posexplode("leaf").alias("point", "leaf"))
    mine = F.col("leaf") == F.col("to_leaf")
    each = met.join(own, ["q", "point"]).groupBy("q", "point", "leaf").agg(F.max(F.when(mine, F.col("n"))).alias("n"), F.max(F.when(mine, F.col("sum"))).alias("a"), F.min(F.when(~mine, F.col("sum") / F.col("n"))).alias("b"))
    each = each.withColumn("a", F.col("a") / F.greatest(F.col("n") - 1, F.lit(1)))
    s = F.when((F.col("n") > 1) & F.col("b").isNotNull() & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    means = each.select("leaf", s.alias("s")).groupingSets([[F.col("leaf")], []], F.col("leaf")).agg(F.avg("s").alias("s"), F.count("*").alias("n")).where("n > 0")
    return means.select("leaf", F.expr(expand("@r6(s)", spark=True)).alias("silhouette"), "n")


_C08 = """WITH e AS (SELECT vec_id AS i, label AS leaf, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT a.i, a.leaf, b.leaf AS other, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM e a CROSS JOIN e b GROUP BY a.i, a.leaf, b.leaf),
p AS (SELECT i, leaf, max(n) FILTER (other = leaf) AS n, max(s) FILTER (other = leaf) AS own, min(s / n) FILTER (other <> leaf) AS b FROM d GROUP BY i, leaf),
s AS (SELECT leaf, CASE WHEN n > 1 AND b IS NOT NULL AND greatest(own / (n - 1), b) > 0 THEN (b - own / (n - 1)) / greatest(own / (n - 1), b) ELSE 0.0 END AS s FROM p)
SELECT leaf, @r6(avg(s)) AS silhouette, @n(count(*)) AS n FROM s GROUP BY GROUPING SETS ((leaf), ())"""


# E08, E09 -------------------------------------------------------------------------------------------


def _means(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean of each component: a sum a task and key before anything moves."""
    return rows.select(*keys, F.posexplode("x").alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("x"))


def random_groups(rows: DataFrame, trials: int = 3) -> DataFrame:
    """trial (null for all), cosine: mean centred cosine of a group to its nearest one, users being dealt to groups of the leaves' sizes by hash."""
    spark = rows.sparkSession
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("n")).orderBy("leaf").collect()  # a row a leaf
    if len(sizes) < 2:
        return spark.createDataFrame([], "trial int, cosine double")
    starts = np.concatenate(([0], np.cumsum([r.n for r in sizes])[:-1])).tolist()
    dealt = rows.select("user_id").crossJoin(F.broadcast(spark.range(trials).select(F.col("id").cast("int").alias("trial"))))  # a few rows a user
    dealt = dealt.withColumn("h", F.md5(F.concat(F.col("trial").cast("string"), F.lit("|"), F.col("user_id").cast("string"))))
    placed = dense_index(dealt, ["trial"], ["h", "user_id"])
    grouped = placed.withColumn("g", F.size(F.filter(F.lit(starts), lambda s: s <= F.col("pos")))).select("user_id", "trial", "g").join(rows.select("user_id", "x"), "user_id")
    centre = materialize(_means(grouped, "trial", "g"), "centroids")
    centre.createOrReplaceTempView("tl_random_groups")
    return spark.sql(expand("""
WITH g AS (SELECT trial, dim, avg(x) AS x FROM tl_random_groups GROUP BY trial, dim), c AS (SELECT m.trial, m.g, m.dim, m.x - g.x AS x FROM tl_random_groups m JOIN g ON m.trial = g.trial AND m.dim = g.dim),
l AS (SELECT trial, g, sqrt(sum(x * x)) + 1e-9 AS n FROM c GROUP BY trial, g),
p AS (SELECT a.trial, a.g AS a, b.g AS b, sum(a.x * b.x) AS dot FROM c a JOIN c b ON a.trial = b.trial AND a.dim = b.dim AND a.g <> b.g GROUP BY a.trial, a.g, b.g),
m AS (SELECT p.trial, p.a, max(dot / (x.n * y.n)) AS cosine FROM p JOIN l x ON p.trial = x.trial AND p.a = x.g JOIN l y ON p.trial = y.trial AND p.b = y.g GROUP BY p.trial, p.a)
SELECT trial, @r6(avg(cosine)) AS cosine FROM m GROUP BY GROUPING SETS ((trial), ())""", spark=True))


_E08 = """WITH e AS (SELECT vec_id AS i, label AS leaf, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
z AS (SELECT leaf, n, sum(n) OVER (ORDER BY leaf) - n AS start FROM (SELECT leaf, count(*) AS n FROM e GROUP BY leaf)),
q AS (SELECT t, i, x, row_number() OVER (PARTITION BY t ORDER BY md5(t || '|' || i), i) - 1 AS pos FROM e CROSS JOIN range(3) r(t)),
u AS (SELECT q.t, z.leaf AS g, unnest(range(len(x))) AS dim, unnest(x) AS x FROM q JOIN z ON pos >= start AND pos < start + n), m AS (SELECT t, g, dim, avg(x) AS x FROM u GROUP BY t, g, dim),
v AS (SELECT t, g, list(x ORDER BY dim) AS x FROM (SELECT t, g, dim, x - avg(x) OVER (PARTITION BY t, dim) AS x FROM m) GROUP BY t, g),
c AS (SELECT a.t, a.g, max(list_inner_product(a.x, b.x) / ((sqrt(list_inner_product(a.x, a.x)) + 1e-9) * (sqrt(list_inner_product(b.x, b.x)) + 1e-9))) AS c FROM v a JOIN v b ON a.t = b.t AND a.g <> b.g GROUP BY a.t, a.g)
SELECT t::INTEGER AS trial, @r6(avg(c)) AS cosine FROM c GROUP BY GROUPING SETS ((t), ())"""


def random_pairs(rows: DataFrame, pairs: int = 3000) -> DataFrame:
    """cosine, n: mean over ``pairs`` hash-drawn pairs of users (a user with itself is skipped), centred at the mean of all."""
    spark = rows.sparkSession
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], "cosine double, n long")
    mean = [r.x for r in _means(rows.select("x")).orderBy("dim").collect()]  # a number a component
    drawn = spark.range(pairs).selectExpr(*(expand(f"@draw(concat('{s}|', cast(id as varchar(20)))) % {n} AS {s}", spark=True) for s in "ab")).where("a <> b")
    placed = dense_index(rows.select("user_id", "x").withColumn("all", F.lit(0)), ["all"], ["user_id"]).select("pos", "x")
    side = lambda to: placed.select(F.col("pos").alias(to), F.zip_with("x", F.lit(mean), lambda x, m: x - m).alias(f"x_{to}"))
    met = side("a").join(F.broadcast(drawn), "a").join(side("b"), "b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("x_a", "x_b") / ((F.sqrt(dot("x_a", "x_a")) + 1e-9) * (F.sqrt(dot("x_b", "x_b")) + 1e-9))
    return met.agg(F.avg(cosine).alias("c"), F.count("*").alias("n")).select(F.expr(expand("@r6(c)", spark=True)).alias("cosine"), "n")


_E09 = """WITH e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT dim, avg(x) AS m FROM (SELECT unnest(range(len(x))) AS dim, unnest(x) AS x FROM e) GROUP BY dim),
c AS (SELECT pos, list(x - m ORDER BY u.dim) AS x FROM (SELECT pos, unnest(range(len(x))) AS dim, unnest(x) AS x FROM e) u JOIN g ON g.dim = u.dim GROUP BY pos),
d AS (SELECT @draw(concat('a|', cast(id as varchar(20)))) % (SELECT count(*) FROM e) AS a, @draw(concat('b|', cast(id as varchar(20)))) % (SELECT count(*) FROM e) AS b FROM range(3000) r(id))
SELECT @r6(avg(list_inner_product(x.x, y.x) / ((sqrt(list_inner_product(x.x, x.x)) + 1e-9) * (sqrt(list_inner_product(y.x, y.x)) + 1e-9)))) AS cosine, @n(count(*)) AS n FROM d JOIN c x ON x.pos = d.a JOIN c y ON y.pos = d.b WHERE a <> b"""


# E16 ------------------------------------------------------------------------------------------------

#: Fewest texts of a user that are split into two halves.
MIN_TEXTS = 8
KINDS = {"mean": ("avg",), "max": ("max",), "mean+std": ("avg", "stddev_pop"), "mean+max": ("avg", "max")}


def _halves(texts: DataFrame, kind: str) -> DataFrame:
    """user_id, a, b: the two halves of each user's texts by ``seq``, pooled and scaled to length 1."""
    w = Window.partitionBy("user_id")
    cut = texts.withColumn("i", F.row_number().over(w.orderBy("seq")) - 1).withColumn("n", F.count("*").over(w)).where(F.col("n") >= MIN_TEXTS)
    half = cut.select("user_id", (F.col("i") >= F.expr("n div 2")).alias("late"), F.posexplode("x").alias("dim", "x")).groupBy("user_id", "late", "dim").agg(*(F.expr(f"{f}(x)").alias(f) for f in KINDS[kind]))
    parts = half.select("user_id", "late", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), "dim", F.col(f).alias("x")) for k, f in enumerate(KINDS[kind])))).alias("s"))
    whole = parts.groupBy("user_id").pivot("late", [False, True]).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]))  # as many as a vector has components
    norm = lambda c: F.transform(c, lambda x: x / F.coalesce(F.nullif(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)), F.lit(0.0)), F.lit(1.0)))
    return whole.select("user_id", norm(F.col("false")).alias("a"), norm(F.col("true")).alias("b"))


def split_half(texts: DataFrame, kind: str = "mean") -> DataFrame:
    """n, rank1, mrr of finding each user's second half by its first among all users' second halves (texts: user_id, seq, x).

    Blocks of users meet blocks of the gallery; a pair of blocks gives a count a user, and the counts add up to
    ranks.  Cosines within 1e-12 are ties, which the lesser user wins.
    """
    small_batches(texts.sparkSession)  # a row holds two blocks
    pooled = materialize(_halves(texts, kind), "halves")
    block = F.pmod(F.xxhash64("user_id"), F.lit(max(1, -(-pooled.count() // TILE))))
    blocks = pooled.groupBy(block.alias("block")).agg(F.collect_list(F.struct("user_id", "a", "b")).alias("m"))  # some TILE users each
    blocks = materialize(blocks.select("m.user_id", "m.a", "m.b"), "tiles")
    met = blocks.crossJoin(blocks.select(F.col("user_id").alias("other"), F.col("b").alias("gallery")))

    def count(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                own, a, b, other, gallery = (batch.column(c)[at].values for c in range(5))
                own, other, a, b, gallery = own.to_numpy(), other.to_numpy(), _matrix(a), _matrix(b), _matrix(gallery)
                mine = (a * b).sum(1)[:, None]
                s = a @ gallery.T
                ahead = (s > mine + 1e-12) | ((np.abs(s - mine) <= 1e-12) & (other[None] < own[:, None]))
                yield pa.RecordBatch.from_pydict({"user_id": own, "ahead": (ahead & (other[None] != own[:, None])).sum(1)}, schema=pa.schema([("user_id", pa.int64()), ("ahead", pa.int64())]))

    rank = met.mapInArrow(count, "user_id long, ahead long").groupBy("user_id").agg((F.sum("ahead") + 1).alias("rank"))
    made = rank.agg(F.count("*").alias("n"), F.avg((F.col("rank") == 1).cast("double")).alias("r"), F.avg(1 / F.col("rank")).alias("m"))
    return made.where("n > 0").select("n", F.expr(expand("@r6(r)", spark=True)).alias("rank1"), F.expr(expand("@r6(m)", spark=True)).alias("mrr"))


def e16_split_half(spark, sf_dir: str) -> DataFrame:
    """Every ten embeddings in order of id count as one user's texts."""
    rows = vectors(spark, sf_dir).selectExpr("user_id div 10 as user_id", "user_id as seq", "x")
    made = None
    for kind in KINDS:
        one = split_half(rows, kind).select(F.lit(kind).alias("kind"), "n", "rank1", "mrr")
        made = one if made is None else made.unionByName(one)
    return made


_E16 = """WITH e AS (SELECT vec_id // 10 AS u, vec_id AS i, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY vec_id // 10) AS n FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
h AS (SELECT u, k >= n // 2 AS late, dim, avg(x) AS mean, max(x) AS max, stddev_pop(x) AS std FROM (SELECT u, k, n, unnest(range(len(x))) AS dim, unnest(x) AS x FROM e WHERE n >= 8) GROUP BY 1, 2, 3),
p AS (SELECT 'mean' AS kind, u, late, list(mean ORDER BY dim) AS x FROM h GROUP BY u, late UNION ALL SELECT 'max', u, late, list(max ORDER BY dim) FROM h GROUP BY u, late
  UNION ALL SELECT 'mean+std', u, late, list_concat(list(mean ORDER BY dim), list(std ORDER BY dim)) FROM h GROUP BY u, late UNION ALL SELECT 'mean+max', u, late, list_concat(list(mean ORDER BY dim), list(max ORDER BY dim)) FROM h GROUP BY u, late),
c AS (SELECT a.kind, a.u AS a, b.u AS b, list_cosine_similarity(a.x, b.x) AS c FROM p a JOIN p b ON a.kind = b.kind AND NOT a.late AND b.late),
r AS (SELECT o.kind, o.a, 1 + count(*) FILTER (c.b <> c.a AND (c.c > o.c + 1e-12 OR (abs(c.c - o.c) <= 1e-12 AND c.b < c.a))) AS rank FROM c o JOIN c ON c.kind = o.kind AND c.a = o.a WHERE o.a = o.b GROUP BY o.kind, o.a)
SELECT kind, @n(count(*)) AS n, @r6(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END)) AS rank1, @r6(avg(1.0 / rank)) AS mrr FROM r GROUP BY kind"""


# numeric kernels --------------------------------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 5, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of the best of ``starts`` runs of Lloyd's rule from spread seeds."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        centres = x[rng.integers(len(x))][None]
        near = ((x - centres[0]) ** 2).sum(1)
        for _ in range(1, k):
            at = rng.choice(len(x), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(x))
            centres = np.vstack([centres, x[at]])
            near = np.minimum(near, ((x - x[at]) ** 2).sum(1))
        label = None
        for _ in range(rounds):
            d = distances(x, centres)
            new = d.argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            sums = np.zeros_like(centres)
            np.add.at(sums, label, x)
            n = np.bincount(label, minlength=k)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        d = distances(x, centres)
        cost = float((d.min(1) ** 2).sum())
        if best is None or cost < best[0] - 1e-12:
            best = (cost, centres, d.argmin(1))
    return best[1], best[2]


def mean_silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Of all points, in tiles; for groups that fit a task."""
    kinds = np.unique(label)
    n, out = np.array([(label == k).sum() for k in kinds]), []
    for at in range(0, len(x), TILE):
        d = distances(x[at : at + TILE], x)
        sums = np.stack([d[:, label == k].sum(1) for k in kinds], 1)
        own = np.searchsorted(kinds, label[at : at + TILE])
        rows = np.arange(len(d))
        a = sums[rows, own] / np.maximum(n[own] - 1, 1)
        other = sums / n
        other[rows, own] = np.inf
        b = other.min(1)
        out.append(np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0))
    return float(np.concatenate(out).mean())


def hungarian(gain: np.ndarray) -> list[int]:
    """Column for each row with the greatest total gain (rows <= columns), by shortest augmenting paths over potentials."""
    n, m = gain.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            now = -gain[i0 - 1] - u[i0] - v[1:]
            better = free & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = 1 + int(np.where(free, least[1:], np.inf).argmin())
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    pairs = lambda n: float((n * (n - 1) / 2).sum())
    _, i = np.unique(a, return_inverse=True)
    _, j = np.unique(b, return_inverse=True)
    table = np.zeros((i.max() + 1, j.max() + 1))
    np.add.at(table, (i, j), 1)
    both, x, y, total = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), len(a) * (len(a) - 1) / 2
    chance, most = x * y / total, (x + y) / 2
    return 1.0 if most == chance else (both - chance) / (most - chance)


def normal_scores(train: np.ndarray, *others: np.ndarray, quantiles: int = 1000) -> list[np.ndarray]:
    """Components of ``train`` and ``others`` to normal scores by the quantiles of ``train``, ties in the middle, clipped at 1e-7."""
    q = min(quantiles, len(train))
    grid = np.linspace(0, 1, q)
    inverse, out = np.frompyfunc(NormalDist().inv_cdf, 1, 1), []
    at = np.quantile(train, grid, axis=0)
    for x in (train, *others):
        p = np.empty_like(x)
        for d in range(x.shape[1]):
            up = np.interp(x[:, d], at[:, d], grid)
            down = np.interp(-x[:, d], -at[::-1, d], -grid[::-1])
            p[:, d] = (up - down) / 2
        out.append(inverse(np.clip(p, 1e-7, 1 - 1e-7)).astype(float))
    return out


# E10 ------------------------------------------------------------------------------------------------


def leaf_splits(rows: DataFrame, least: int = 20, most: int = 2000, seed: int = 42) -> DataFrame:
    """leaf, silhouette, n_large, n_small, minority (ten ids) of a two-way split of each leaf of ``least`` users, of ``most`` drawn by hash."""
    first = Window.partitionBy("leaf").orderBy(F.md5(F.col("user_id").cast("string")), "user_id")
    drawn = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)  # each task keeps ``most`` a leaf

    none = pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("leaf", "int32"), ("silhouette", "float64"), ("n_large", "int64"), ("n_small", "int64"), ("minority", "object"))})

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("user_id")
        if len(pdf) < least:
            return none
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        x -= x.mean(0)
        _, label = kmeans(x, 2, seed, 10)
        n = np.bincount(label, minlength=2)
        if not n.all():
            return none
        small = 0 if n[0] < n[1] else 1
        ids = pdf["user_id"].to_numpy()[label == small][:10]
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "silhouette": [round(mean_silhouette(x, label), 6)], "n_large": [int(n.max())], "n_small": [int(n.min())], "minority": [ids.tolist()]})

    return drawn.select("leaf", "user_id", "x").groupBy("leaf").applyInPandas(split, "leaf int, silhouette double, n_large long, n_small long, minority array<long>")


# C13 ------------------------------------------------------------------------------------------------


def locked_bootstrap(rows: DataFrame, merge: dict[int, int] | None = None, draws: int = 20, train: int = 30_000, evaluate: int = 10_000, seed: int = 42) -> DataFrame:
    """draw, source_ari, final_ari: how well a refit on users drawn with replacement gives the leaves back.

    All draws are one table keyed by draw; each group of at most ``train`` rows is scaled to normal scores, clustered anew
    into as many clusters as there are leaves, and predicts one fixed sample of at most ``evaluate`` users.
    Fitted clusters take the leaves that agree most with them; ``merge`` then maps leaves to final ones.
    """
    spark, merge = rows.sparkSession, merge or {}
    rows = rows.where("leaf >= 0")
    n = rows.count()
    leaves = sorted(r.leaf for r in rows.select("leaf").distinct().collect())  # a row a leaf
    if n < 100 or len(leaves) < 2:
        raise ValueError("a locked clustering needs 100 users and two leaves")
    fixed = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|eval|"), F.col("user_id").cast("string"))), "user_id").limit(evaluate).toPandas()  # ``evaluate`` rows
    held = spark.sparkContext.broadcast((np.stack(fixed["x"].to_numpy()).astype(float), fixed["leaf"].to_numpy(int)))
    placed = dense_index(rows.withColumn("all", F.lit(0)), ["all"], ["user_id"]).select("pos", "leaf", "x")
    picks = spark.range(draws * min(train, n)).select((F.col("id") % draws).cast("int").alias("draw"), F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n)).alias("pos"))
    final = lambda y: np.array([merge.get(int(k), int(k)) for k in y])

    def refit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(pdf["x"].to_numpy()).astype(float), pdf["leaf"].to_numpy(int)
        order = np.lexsort((*x.T[::-1], y))
        x, y = x[order], y[order]
        at, truth = held.value
        fit, asked = normal_scores(x, at)
        centres, label = kmeans(fit, len(leaves), seed + int(key[0]))
        predicted = distances(asked, centres).argmin(1)
        table = np.zeros((len(leaves), len(leaves)))
        np.add.at(table, (label, np.searchsorted(leaves, y)), 1)
        aligned = np.array(leaves)[hungarian(table)][predicted]
        return pd.DataFrame({"draw": [key[0]], "source_ari": [adjusted_rand(truth, predicted)], "final_ari": [adjusted_rand(final(truth), final(aligned))]})

    return placed.join(picks, "pos").groupBy("draw").applyInPandas(refit, "draw int, source_ari double, final_ari double")


def stability(scores: DataFrame, least_mean: float = 0.80, most_variance: float = 0.02) -> DataFrame:
    """Mean, variance and 95 % interval of the final scores, the mean of the source scores, and whether the clustering is stable."""
    made = scores.agg(F.count("*").alias("draws"), F.avg("source_ari").alias("source_mean"), F.avg("final_ari").alias("final_mean"), F.var_pop("final_ari").alias("final_variance"), F.percentile("final_ari", F.lit(0.025)).alias("low"), F.percentile("final_ari", F.lit(0.975)).alias("high"))
    return made.withColumn("is_stable", (F.col("final_mean") >= least_mean) & (F.col("final_variance") <= most_variance))


# X18 ------------------------------------------------------------------------------------------------


def bootstrap_draws(users: DataFrame, reps: int = 20) -> DataFrame:
    """rep, user_id, times: as many draws with replacement as there are ``users`` (user_id, each once), by hash."""
    n = users.count()
    placed = dense_index(users.withColumn("all", F.lit(0)), ["all"], ["user_id"]).select("pos", "user_id")
    drawn = users.select(F.col("user_id").alias("of")).crossJoin(F.broadcast(users.sparkSession.range(reps).select(F.col("id").cast("int").alias("rep"))))  # ``reps`` rows a user
    drawn = drawn.select("rep", F.expr(expand(f"@draw(concat(cast(rep as varchar(20)), '|', cast(of as varchar(20)))) % {max(n, 1)}", spark=True)).alias("pos"))
    return drawn.groupBy("rep", "pos").agg(F.count("*").alias("times")).join(placed, "pos").select("rep", "user_id", "times")


_X18 = """WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM {messages}) x),
d AS (SELECT rep, @draw(concat(cast(rep as varchar(20)), '|', cast(user_id as varchar(20)))) % n AS pick FROM u CROSS JOIN range(20) r(rep))
SELECT rep::INTEGER AS rep, u.user_id, @n(count(*)) AS times FROM d JOIN u ON u.pos = d.pick GROUP BY rep, u.user_id"""

register("x18_bootstrap_draws", lambda s, d: bootstrap_draws(canonical(s, d, "messages").select("user_id").distinct()), twin(_X18))
register("c08_silhouette", lambda s, d: silhouette(vectors(s, d)), twin(_C08))
register("c13_locked_bootstrap", lambda s, d: stability(locked_bootstrap(vectors(s, d), {1: 0, 3: 2})))
register("e08_random_group_cosine", lambda s, d: random_groups(vectors(s, d)), twin(_E08))
register("e09_random_pair_cosine", lambda s, d: random_pairs(vectors(s, d)), twin(_E09))
register("e10_leaf_splits", lambda s, d: leaf_splits(vectors(s, d)))
register("e16_split_half", e16_split_half, twin(_E16))
