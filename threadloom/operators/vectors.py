"""Embeddings and clusterings, in long form: one row for each component."""

from threadloom.operators.sqlop import operator

MEAN = "mean_ AS (SELECT leaf, dim, avg(x) AS x FROM {vectors} GROUP BY leaf, dim)"
NORM = "norm_ AS (SELECT user_id, sqrt(sum(x * x)) AS len FROM {vectors} GROUP BY user_id), unit AS (SELECT v.user_id, v.leaf, v.dim, v.x / coalesce(nullif(n.len, 0.0), 1.0) AS x FROM {vectors} v JOIN norm_ n ON v.user_id = n.user_id)"
DIST = f"{MEAN}, dist AS (SELECT v.user_id, v.leaf, m.leaf AS to_leaf, sqrt(sum((v.x - m.x) * (v.x - m.x))) AS d FROM {{vectors}} v JOIN mean_ m ON v.dim = m.dim GROUP BY v.user_id, v.leaf, m.leaf)"
BETWEEN = f"{MEAN}, pair AS (SELECT a.leaf AS a, b.leaf AS b, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM mean_ a JOIN mean_ b ON a.dim = b.dim AND a.leaf <> b.leaf GROUP BY a.leaf, b.leaf)"

operator("e01_mean_std_pooling", "SELECT leaf, dim, @r6(avg(x)) AS mean, @r6(stddev_pop(x)) AS std FROM {vectors} GROUP BY leaf, dim")
operator("e02_pool_variants", "SELECT leaf, dim, @r6(avg(x)) AS mean, @r6(max(x)) AS high FROM {vectors} GROUP BY leaf, dim")
operator("e03_pairwise_cosine", f"WITH {NORM}, s AS (SELECT leaf, dim, sum(x) AS t FROM unit GROUP BY leaf, dim), n AS (SELECT leaf, count(DISTINCT user_id) AS n FROM {{vectors}} GROUP BY leaf) SELECT s.leaf, @r6((sum(t * t) - max(n)) / nullif(@f(max(n)) * (max(n) - 1), 0.0)) AS cosine FROM s JOIN n ON s.leaf = n.leaf GROUP BY s.leaf")
operator("e04_contrastive_score", f"WITH {DIST} SELECT user_id, @r6(max(CASE WHEN leaf = to_leaf THEN d END) - min(CASE WHEN leaf <> to_leaf THEN d END)) AS score FROM dist GROUP BY user_id")
operator("e05_representatives", f"WITH {DIST}, s AS (SELECT user_id, leaf, max(CASE WHEN leaf = to_leaf THEN d END) - min(CASE WHEN leaf <> to_leaf THEN d END) AS score FROM dist GROUP BY user_id, leaf), r AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY score, user_id) AS k FROM s) SELECT leaf, user_id FROM r WHERE k <= 10")
operator("e06_nearest_leaf", f"WITH {BETWEEN}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM pair) SELECT a AS leaf, b AS nearest, @r6(d) AS distance FROM r WHERE k = 1")
operator("e07_centred_cosine", f"""
WITH {MEAN}, g AS (SELECT dim, avg(x) AS x FROM mean_ GROUP BY dim), c AS (SELECT m.leaf, m.dim, m.x - g.x AS x FROM mean_ m JOIN g ON m.dim = g.dim), l AS (SELECT leaf, sqrt(sum(x * x)) AS n FROM c GROUP BY leaf),
p AS (SELECT a.leaf AS a, b.leaf AS b, sum(a.x * b.x) AS dot FROM c a JOIN c b ON a.dim = b.dim AND a.leaf <> b.leaf GROUP BY a.leaf, b.leaf)
SELECT p.a AS leaf, @r6(max(dot / (x.n * y.n))) AS cosine FROM p JOIN l x ON p.a = x.leaf JOIN l y ON p.b = y.leaf GROUP BY p.a""")
CENTRED = f"{MEAN}, cos_ AS (SELECT v.user_id, v.leaf, 1 - sum(v.x * m.x) / nullif(sqrt(sum(v.x * v.x)) * sqrt(sum(m.x * m.x)), 0.0) AS d FROM {{vectors}} v JOIN mean_ m ON v.leaf = m.leaf AND v.dim = m.dim GROUP BY v.user_id, v.leaf)"
operator("e11_quality_flags", f"WITH {CENTRED}, s AS (SELECT leaf, count(*) AS n, avg(d) AS d FROM cos_ GROUP BY leaf) SELECT leaf, @n(n) AS size, @r6(d) AS spread, n < 30 AS small, d > 0.85 AS loose FROM s")
operator("e12_calibration", f"WITH {CENTRED}, t AS (SELECT leaf, @percentile(d, 0.95) AS q95 FROM cos_ WHERE user_id % 5 <> 0 GROUP BY leaf) SELECT c.leaf, @r6(max(q95)) AS threshold, @r6(avg(CASE WHEN d > q95 THEN 1.0 ELSE 0.0 END)) AS reject_rate FROM cos_ c JOIN t ON c.leaf = t.leaf WHERE c.user_id % 5 = 0 GROUP BY c.leaf")
operator("e13_filter_decision", f"WITH {CENTRED} SELECT user_id, d <= 0.85 AS passes, @r6(0.5 * least(d / 0.85, 1.0)) AS rejection FROM cos_")
operator("z11_alpha_gates", f"WITH {CENTRED} SELECT user_id, @f(@draw(concat('3|', cast(user_id as varchar(20))))) / 268435456.0 < 0.5 * least(d / 0.85, 1.0) AS gated FROM cos_")
operator("e14_top_k_retrieval", f"WITH {MEAN}, s AS (SELECT v.user_id, m.leaf, sum(v.x * m.x) / nullif(sqrt(sum(v.x * v.x)) * sqrt(sum(m.x * m.x)), 0.0) AS c FROM {{vectors}} v JOIN mean_ m ON v.dim = m.dim WHERE v.user_id % 20 = 0 GROUP BY v.user_id, m.leaf), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, leaf) AS k FROM s) SELECT user_id, leaf, @r6(c) AS cosine FROM r WHERE k <= 5")
operator("e15_preservation", "WITH m AS (SELECT user_id % 2 AS side, dim, avg(x) AS x FROM {vectors} GROUP BY user_id % 2, dim) SELECT @r6(sum(a.x * b.x) / nullif(sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)), 0.0)) AS cosine FROM m a JOIN m b ON a.dim = b.dim AND a.side = 0 AND b.side = 1")
operator("e17_effective_dimension", "WITH c AS (SELECT user_id, dim, x - avg(x) OVER (PARTITION BY dim) AS x FROM {vectors}), n AS (SELECT count(DISTINCT user_id) AS n FROM {vectors}), g AS (SELECT a.dim AS i, b.dim AS j, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.user_id = b.user_id GROUP BY a.dim, b.dim) SELECT @r6(sum(CASE WHEN i = j THEN s ELSE 0.0 END) * sum(CASE WHEN i = j THEN s ELSE 0.0 END) / sum(s * s)) AS dimension FROM g")
operator("e20_manipulation_audit", f"WITH {CENTRED} SELECT coalesce(leaf, -1) AS leaf, coalesce(rep, -1) AS repeat, @r6(avg(CASE WHEN d > 0.85 THEN 1.0 ELSE 0.0 END)) AS rejected, @n(count(*)) AS n FROM (SELECT leaf, user_id % 3 AS rep, d FROM cos_) x GROUP BY GROUPING SETS ((), (leaf), (rep))")
operator("c01_robust_scaling", "WITH q AS (SELECT dim, @percentile(x, 0.5) AS m, @percentile(x, 0.95) - @percentile(x, 0.05) AS r FROM {vectors} GROUP BY dim) SELECT v.user_id, v.dim, @r6((v.x - q.m) / coalesce(nullif(q.r, 0.0), 1.0)) AS x FROM {vectors} v JOIN q ON v.dim = q.dim")
operator("c02_standard_scaling", "SELECT user_id, dim, @r6((x - avg(x) OVER (PARTITION BY dim)) / coalesce(nullif(stddev_pop(x) OVER (PARTITION BY dim), 0.0), 1.0)) AS x FROM {vectors}")
operator("c06_cluster_size_bounds", "WITH n AS (SELECT @f(count(DISTINCT user_id)) AS n FROM {vectors}) SELECT @floor(least(greatest(greatest(200.0, power(n, 0.65)), n / 30), n / 3)) AS min_cluster_size FROM n")
operator("c07_orphan_imputation", f"WITH {DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, to_leaf) AS k FROM dist) SELECT user_id, to_leaf AS leaf FROM r WHERE k = 1")
operator("j12_nearest_centroid", f"WITH {DIST} SELECT user_id, @r6(min(d)) AS distance FROM dist GROUP BY user_id")
operator("c09_davies_bouldin", f"WITH {DIST}, s AS (SELECT leaf, avg(d) AS s FROM dist WHERE leaf = to_leaf GROUP BY leaf), p AS (SELECT a.leaf AS a, b.leaf AS b, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM mean_ a JOIN mean_ b ON a.dim = b.dim AND a.leaf <> b.leaf GROUP BY a.leaf, b.leaf), m AS (SELECT p.a, max((x.s + y.s) / p.d) AS r FROM p JOIN s x ON p.a = x.leaf JOIN s y ON p.b = y.leaf GROUP BY p.a) SELECT @r6(avg(r)) AS davies_bouldin FROM m")
operator("c10_centroids", f"WITH {MEAN} SELECT leaf, dim, @r6(x) AS x FROM mean_")
operator("c11_adjusted_rand", """
WITH l AS (SELECT DISTINCT user_id, leaf AS a, CASE WHEN user_id % 4 = 0 THEN (leaf + 1) % 10 ELSE leaf END AS b FROM {vectors}), c AS (SELECT a, b, @f(count(*)) AS n FROM l GROUP BY a, b),
ra AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a) x), rb AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b) x), t AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM c)
SELECT @r6((i - ra.s * rb.s / (n * (n - 1) / 2)) / nullif((ra.s + rb.s) / 2 - ra.s * rb.s / (n * (n - 1) / 2), 0.0)) AS ari FROM t CROSS JOIN ra CROSS JOIN rb""")
operator("c15_zscore_tags", "WITH m AS (SELECT community, avg(toxicity) AS tox, avg(@f(indentation)) AS ind FROM {messages} GROUP BY community), z AS (SELECT community, (tox - avg(tox) OVER ()) / coalesce(nullif(stddev_pop(tox) OVER (), 0.0), 1.0) AS zt, (ind - avg(ind) OVER ()) / coalesce(nullif(stddev_pop(ind) OVER (), 0.0), 1.0) AS zi FROM m) SELECT community, @r4(zt) AS z_toxicity, @r4(zi) AS z_indentation, CASE WHEN zt >= 1 THEN 'hostile' WHEN zt <= -1 THEN 'civil' ELSE '' END AS tag FROM z")
operator("c16_merged_leaves", "SELECT CASE WHEN leaf < 2 THEN 0 ELSE leaf - 1 END AS merged, @n(count(DISTINCT user_id)) AS size, @join_sorted(cast(leaf as varchar(4)), ',') AS sources FROM {vectors} GROUP BY 1")
operator("c18_dead_columns", "SELECT dim, stddev_pop(x) < 0.0001 OR avg(CASE WHEN x <> 0 THEN 1.0 ELSE 0.0 END) < 0.01 AS dead, avg(CASE WHEN x <> 0 THEN 1.0 ELSE 0.0 END) < 0.05 AS near_dead FROM {vectors} GROUP BY dim")
operator("c19_capture_audit", "WITH k AS (SELECT leaf, toxic, row_number() OVER (PARTITION BY leaf ORDER BY msg_id) AS i FROM {texts}) SELECT leaf, @n(sum(CASE WHEN i <= 15 AND toxic = 1 THEN 1 ELSE 0 END)) AS first_k, @n(least(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 7)) AS stratified FROM k GROUP BY leaf")
operator("c20_allocation", "WITH c AS (SELECT leaf, count(DISTINCT user_id) AS n FROM {vectors} GROUP BY leaf) SELECT leaf, @n(floor(30.0 * n / sum(n) OVER () + 0.5)) AS proportional, @n(3) AS balanced FROM c")
operator("c21_engagement", "WITH a AS (SELECT user_id, count(*) AS n FROM {messages} GROUP BY user_id), q AS (SELECT user_id, percent_rank() OVER (ORDER BY n, md5(cast(user_id as varchar(20)))) AS q FROM a) SELECT user_id, @r6(least(greatest(0.05 + 0.45 * q * q, 0.05), 0.5)) AS engagement FROM q")
operator("c23_roles", "WITH a AS (SELECT user_id, count(*) AS n, avg(CASE WHEN action = 'edit' THEN 1.0 ELSE 0.0 END) AS e, avg(CASE WHEN action = 'revert' THEN 1.0 ELSE 0.0 END) AS r FROM {messages} GROUP BY user_id) SELECT user_id, CASE WHEN r >= 0.25 THEN 'reverter' WHEN e >= 0.25 THEN 'editor' WHEN n >= 75 THEN 'regular' ELSE 'casual' END AS role FROM a")
