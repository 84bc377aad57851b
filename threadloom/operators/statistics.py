"""Statistics over condition by metric results: effects, corrections, ceilings, verdicts."""

from threadloom.operators.sqlop import operator

_SIDES = "t AS (SELECT action_distance AS x FROM {results} WHERE condition = '1-URGENT'), c AS (SELECT action_distance AS x FROM {results} WHERE condition = '5-LOW')"
_PAIRS = "p AS (SELECT a.dataset, a.repeat, a.action_distance AS t, b.action_distance AS c, a.action_distance - b.action_distance AS d FROM {results} a JOIN {results} b ON a.dataset = b.dataset AND a.model = b.model AND a.repeat = b.repeat WHERE a.condition = '1-URGENT' AND b.condition = '5-LOW')"
_RANKS = "r AS (SELECT d, avg(k) OVER (PARTITION BY round(abs(d), 12)) AS rank FROM (SELECT d, @f(row_number() OVER (ORDER BY abs(d), dataset, repeat)) AS k FROM p WHERE d <> 0) s)"
#: p-values of a table of hypotheses, made of the results so that both engines have them
_P = "h AS (SELECT condition, dataset, @f(1.0) / (1.0 + 40.0 * abs(avg(action_distance) - avg(interaction_distance)) + @f(sum(message_count) % 97)) AS p FROM {results} GROUP BY condition, dataset)"
_RANKED = f"{_P}, k AS (SELECT *, row_number() OVER (ORDER BY p, condition, dataset) AS i, count(*) OVER () AS n FROM h)"
_LONG = """long AS (SELECT condition, dataset, repeat, 'action' AS layer, action_distance AS x FROM {results} UNION ALL SELECT condition, dataset, repeat, 'interaction', interaction_distance FROM {results}
  UNION ALL SELECT condition, dataset, repeat, 'language', @f(language_distance) FROM {results})"""

operator("w13_average_ranks", f"WITH {_PAIRS}, {_RANKS} SELECT @r6(d) AS d, @r6(rank) AS rank FROM r")
operator("s01_wilcoxon", f"WITH {_PAIRS}, {_RANKS} SELECT @n(count(*)) AS n, @r4(sum(CASE WHEN d > 0 THEN rank ELSE 0.0 END)) AS w_plus, @r6((sum(CASE WHEN d > 0 THEN rank ELSE 0.0 END) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2.0 * count(*) + 1) / 24.0)) AS z FROM r")
operator("s03_cliffs_delta", f"""WITH {_SIDES}, u AS (SELECT x, 1 AS t, 0 AS c FROM t UNION ALL SELECT x, 0, 1 FROM c), g AS (SELECT x, sum(t) AS t, sum(c) AS c FROM u GROUP BY x),
r AS (SELECT t, sum(c) OVER (ORDER BY x) - c AS below, sum(c) OVER () - sum(c) OVER (ORDER BY x) AS above FROM g) SELECT @r6(@f(sum(t * (below - above))) / ((SELECT count(*) FROM t) * (SELECT count(*) FROM c))) AS delta FROM r""")
operator("j11_pair_counts", f"WITH {_SIDES}, u AS (SELECT x, 1 AS t, 0 AS c FROM t UNION ALL SELECT x, 0, 1 FROM c), g AS (SELECT x, sum(t) AS t, sum(c) AS c FROM u GROUP BY x), r AS (SELECT t, sum(c) OVER (ORDER BY x) - c AS below, sum(c) OVER () - sum(c) OVER (ORDER BY x) AS above FROM g) SELECT @n(sum(t * below)) AS greater, @n(sum(t * above)) AS less FROM r")
operator("s04_cohens_d", f"WITH {_SIDES}, a AS (SELECT count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM t), b AS (SELECT count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM c) SELECT @r6(coalesce((a.m - b.m) / nullif(sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 0.0), 0.0)) AS d FROM a CROSS JOIN b")
operator("s05_paired_d", f"WITH {_PAIRS} SELECT @r6(coalesce(avg(d) / nullif(stddev_samp(d), 0.0), 0.0)) AS paired_d, @n(count(*)) AS n_pairs FROM p")
operator("s06_bh_reject", f"WITH {_RANKED}, m AS (SELECT max(CASE WHEN p <= 0.05 * i / n THEN i ELSE 0 END) AS top FROM k) SELECT condition, dataset, i <= top AS rejected FROM k CROSS JOIN m")
operator("s07_bh_qvalues", f"WITH {_RANKED} SELECT condition, dataset, @r6(least(min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1.0)) AS q FROM k")
operator("w08_cumulative_min", f"WITH {_RANKED} SELECT @n(i) AS i, @r6(min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS running FROM k")
operator("s08_comparison_table", """
WITH b AS (SELECT condition, count(*) AS n, avg(action_distance) AS m, var_samp(action_distance) AS v FROM {results} GROUP BY condition)
SELECT c.condition AS baseline, @r6(t.m) AS treatment, @r6(c.m) AS control, @r6(t.m - c.m) AS difference, @r6((t.m - c.m) / nullif(sqrt(((t.n - 1) * t.v + (c.n - 1) * c.v) / (t.n + c.n - 2)), 0.0)) AS d FROM b t JOIN b c ON t.condition = '1-URGENT' AND c.condition <> '1-URGENT'""")
operator("s09_layered_bh", f"WITH {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p, condition) AS i, count(*) OVER (PARTITION BY dataset) AS n FROM h) SELECT dataset AS layer, condition, @r6(least(min(p * n / i) OVER (PARTITION BY dataset ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1.0)) AS q FROM k")
operator("s10_cohens_kappa", """
WITH x AS (SELECT @f(quality) AS a, @f(toxic) AS b FROM {labels}), s AS (SELECT avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM x)
SELECT @r6(CASE WHEN pe >= 1 THEN 0.0 ELSE (po - pe) / nullif(1 - pe, 0.0) END) AS kappa_events, @r6(CASE WHEN pe >= 1 THEN 1.0 ELSE (po - pe) / nullif(1 - pe, 0.0) END) AS kappa_ratings FROM s""")
operator("s11_consensus", """
SELECT CASE WHEN doc_id % 2 = 0 THEN 'conflict' ELSE 'persuasion' END AS kind, @n(sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END)) AS agreed, @n(sum(CASE WHEN quality <> toxic THEN 1 ELSE 0 END)) AS to_adjudicate,
  @n(sum(CASE WHEN quality = toxic THEN toxic ELSE 0 END)) AS positive FROM {labels} GROUP BY 1""")
operator("s12_ratings", "SELECT doc_id % 5 AS rater, @r6(avg(@f(quality))) AS mean, @r6(stddev_samp(@f(quality))) AS std, @r6(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END)) AS accuracy, @n(count(*)) AS n FROM {labels} GROUP BY doc_id % 5")
operator("s13_fleiss_kappa", """
WITH c AS (SELECT doc_id, @f(quality + toxic) AS a, @f(2 - quality - toxic) AS b FROM {labels}), s AS (SELECT avg((a * (a - 1) + b * (b - 1)) / 2) AS pbar, avg(a / 2) AS pa FROM c)
SELECT @r6((pbar - (pa * pa + (1 - pa) * (1 - pa))) / nullif(1 - (pa * pa + (1 - pa) * (1 - pa)), 0.0)) AS kappa FROM s""")
operator("s14_drift_slope", "WITH s AS (SELECT community, round, avg(toxicity) AS y FROM {messages} GROUP BY community, round) SELECT community, @r6(covar_pop(@f(round), y) / nullif(var_pop(@f(round)), 0.0)) AS slope FROM s GROUP BY community")
operator("s15_layer_loss", f"WITH {_LONG}, s AS (SELECT condition, layer, avg(x) AS m, stddev_pop(x) AS sd FROM long GROUP BY condition, layer) SELECT a.condition, a.layer, @r6((a.m - f.m) / coalesce(nullif(f.sd, 0.0), 1.0)) AS loss FROM s a JOIN s f ON a.layer = f.layer AND f.condition = '1-URGENT' WHERE a.condition <> '1-URGENT'")
operator("s17_ceiling", f"""
WITH {_LONG}, f AS (SELECT condition, layer, greatest(0.0, least(1.0, 1 - avg(x))) AS fidelity FROM long GROUP BY condition, layer), m AS (SELECT layer, max(fidelity) AS top FROM f GROUP BY layer)
SELECT f.condition, f.layer, @r6(f.fidelity) AS fidelity, @r6(greatest(0.0, m.top - f.fidelity)) AS gap FROM f JOIN m ON f.layer = m.layer""")
operator("s21_alpha_optimum", "WITH g AS (SELECT condition, dataset, avg(action_distance) AS v FROM {results} GROUP BY condition, dataset), m AS (SELECT dataset, min(v) AS best FROM g GROUP BY dataset) SELECT g.dataset, @r6(min(best)) AS best, @r6(avg(CASE WHEN v <= best * 1.05 THEN 1.0 ELSE 0.0 END)) AS coverage, CASE WHEN avg(CASE WHEN v <= best * 1.05 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'plateau' WHEN avg(CASE WHEN v <= best * 1.05 THEN 1.0 ELSE 0.0 END) >= 0.25 THEN 'moderate' ELSE 'sharp' END AS shape FROM g JOIN m ON g.dataset = m.dataset GROUP BY g.dataset")
operator("s22_transfer_gap", f"WITH {_LONG}, s AS (SELECT layer, dataset, avg(x) AS m FROM long GROUP BY layer, dataset) SELECT a.layer, a.dataset, @r6(a.m - b.m) AS gap, abs(a.m - b.m) < 0.1 AS transfers FROM s a JOIN s b ON a.layer = b.layer AND b.dataset = 'BUILDING'")
operator("s23_experiment_grid", "SELECT c.condition, d.dataset, r.repeat, concat(c.condition, '/', d.dataset, '/', cast(r.repeat as varchar(4))) AS cell FROM (SELECT DISTINCT condition FROM {results}) c CROSS JOIN (SELECT DISTINCT dataset FROM {results}) d CROSS JOIN (SELECT DISTINCT repeat FROM {results}) r")
operator("s24_mean_std_table", f"WITH {_LONG} SELECT condition, layer, @fixed2('%.3f ± %.3f', avg(x), stddev_samp(x)) AS cell FROM long GROUP BY condition, layer")
operator("s25_radar_zscores", f"WITH {_LONG}, s AS (SELECT condition, layer, avg(x) AS m FROM long GROUP BY condition, layer) SELECT condition, layer, @r6(m / nullif(max(m) OVER (PARTITION BY layer), 0.0)) AS radar, @r4((m - avg(m) OVER (PARTITION BY layer)) / nullif(stddev_samp(m) OVER (PARTITION BY layer), 0.0)) AS z FROM s")
operator("s26_provenance_table", "SELECT dataset, model, @n(count(*)) AS cells, @n(sum(message_count)) AS messages, min(condition) AS first_condition FROM {results} GROUP BY dataset, model")
operator("s27_cost_model", "SELECT condition, @r6(sum(message_count) * 0.0012 + sum(message_count) / 5.0 * 0.0004) AS cost FROM {results} GROUP BY condition")
operator("s28_resume_counters", "SELECT dataset, @n(sum(CASE WHEN message_count < 50 THEN 1 ELSE 0 END)) AS failed, @n(sum(CASE WHEN message_count < 50 AND repeat < 3 THEN 1 ELSE 0 END)) AS recoverable FROM {results} GROUP BY dataset")
operator("t10_number_cells", "SELECT condition, dataset, @fixed('%.3f', avg(action_distance)) AS cell, avg(action_distance) = min(avg(action_distance)) OVER (PARTITION BY dataset) AS best FROM {results} GROUP BY condition, dataset")
operator("z10_alpha_grid", "SELECT @n(face) AS face, @r6(a / 4.0) AS a, @r6(b / 4.0) AS b FROM (SELECT @explode(@range(0, 2)) AS face) f CROSS JOIN (SELECT @explode(@range(0, 4)) AS a) x CROSS JOIN (SELECT @explode(@range(0, 4)) AS b) y CROSS JOIN (SELECT count(*) AS n FROM {nation}) c")
operator("z13_table_subsets", "SELECT condition, @r6(avg(action_distance)) AS value FROM {results} WHERE condition IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY condition")
