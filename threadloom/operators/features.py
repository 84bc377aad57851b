"""Per-user behavioural features and the relational pieces they are made of."""

from threadloom.operators.sqlop import operator

LINKED = """linked AS (SELECT m.*, p.user_id AS parent_user, p.toxicity AS parent_toxicity, p.action AS parent_action
  FROM {messages} m LEFT JOIN {messages} p ON m.thread_id = p.thread_id AND m.parent_id = p.msg_id)"""
PEOPLE = "people AS (SELECT thread_id, count(DISTINCT user_id) AS n FROM {messages} GROUP BY thread_id)"

USER_FEATURES = f"""
WITH {LINKED}, {PEOPLE},
own AS (SELECT l.user_id, count(*) AS n, count(DISTINCT l.thread_id) AS threads, count(DISTINCT l.topic) AS topics,
    avg(CASE WHEN parent_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS reply_rate, avg(@f(greatest(coalesce(indentation, 0), 0))) AS indentation,
    (max(@epoch(ts)) - min(@epoch(ts))) / 86400 AS days, avg(toxicity) AS tox, max(toxicity) AS tox_max, avg(severe_toxicity) AS sev, max(severe_toxicity) AS sev_max,
    avg(CASE WHEN action = 'discuss' AND parent_id IS NOT NULL THEN CASE WHEN coalesce(parent_toxicity, 0.0) >= 0.6 THEN 1.0 ELSE 0.0 END END) AS to_toxic,
    avg(CASE WHEN people.n >= 3 THEN 1.0 ELSE 0.0 END) AS contested,
    avg(CASE WHEN page_type = 'user_talk' THEN 1.0 ELSE 0.0 END) AS interpersonal, avg(CASE WHEN page_type IN ('talk', 'article', 'file_talk', 'category_talk') THEN 1.0 ELSE 0.0 END) AS content,
    avg(CASE WHEN page_type IN ('wikipedia_talk', 'template_talk', 'help_talk') THEN 1.0 ELSE 0.0 END) AS project
  FROM linked l JOIN people ON l.thread_id = people.thread_id GROUP BY l.user_id),
edges AS (SELECT user_id AS a, parent_user AS b, count(*) AS n, sum(toxicity) AS tox, count(toxicity) AS scored FROM linked WHERE parent_user <> user_id GROUP BY user_id, parent_user),
outs AS (SELECT a AS user_id, count(*) AS targets FROM edges GROUP BY a),
ins AS (SELECT b AS user_id, count(*) AS repliers, sum(n) AS replies, sum(tox) / nullif(sum(scored), 0) AS tox_received FROM edges GROUP BY b),
mutual AS (SELECT x.a AS user_id, count(*) AS both_ways FROM edges x JOIN edges y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
gaps AS (SELECT user_id, @epoch(ts) - lag(@epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, msg_id) AS gap FROM {{messages}}),
rhythm AS (SELECT user_id, CASE WHEN count(gap) >= 2 THEN stddev_pop(gap) / (avg(gap) + 1e-9) ELSE 0.0 END AS cv FROM gaps GROUP BY user_id)
SELECT own.user_id, @r6(reply_rate) AS reply_rate, @r6(least(indentation, 20.0)) AS mean_indentation, @r6(ln(1.0 + own.n)) AS activity,
  @r6(@f(coalesce(targets, 0)) / own.n) AS interlocutor_breadth, @r6(ln(1.0 + coalesce(replies, 0))) AS attention_received,
  @r6(coalesce(@f(both_ways) / nullif(coalesce(targets, 0) + coalesce(repliers, 0) - both_ways, 0), 0.0)) AS reciprocity,
  @r6(ln(1.0 + topics)) AS topical_breadth, @r6(ln(1.0 + greatest(days, 0.0))) AS tenure, @r6(coalesce(tox, 0.0)) AS own_toxicity_mean, @r6(coalesce(sev, 0.0)) AS own_severe_toxicity_mean,
  @r6(coalesce(to_toxic, 0.0)) AS reply_to_toxic_rate, @r6(coalesce(tox_received, 0.0)) AS toxicity_received_mean, @r6(contested) AS conflict_engagement_ratio,
  @r6(interpersonal) AS frac_interpersonal, @r6(content) AS frac_content, @r6(project) AS frac_project, @r6(coalesce(tox_max, 0.0)) AS tox_max, @r6(coalesce(sev_max, 0.0)) AS sev_max,
  @r4(coalesce(cv, 0.0)) AS burstiness_cv, @r6(CASE WHEN days > 0 THEN ln(1.0 + own.n / (days + 1.0)) ELSE ln(1.0 + own.n) END) AS activity_density,
  @r6(greatest(coalesce(tox_max, 0.0), coalesce(sev_max, 0.0))) AS hostility_score, @r6(content - interpersonal) AS namespace_focus, @n(own.n) AS message_count, @n(threads) AS thread_count
FROM own LEFT JOIN outs ON own.user_id = outs.user_id LEFT JOIN ins ON own.user_id = ins.user_id LEFT JOIN mutual ON own.user_id = mutual.user_id LEFT JOIN rhythm ON own.user_id = rhythm.user_id
""".replace("{{messages}}", "{messages}")

operator("u00_user_features", USER_FEATURES)


def feature(name: str, columns: str) -> None:
    operator(name, f"SELECT user_id, {columns} FROM ({USER_FEATURES}) AS u")


for _name, _columns in {
    "u01_reply_rate": "reply_rate", "u02_mean_indentation": "mean_indentation", "u04_activity": "activity", "u05_interlocutor_breadth": "interlocutor_breadth",
    "u06_attention_received": "attention_received", "u07_reciprocity": "reciprocity", "u08_topical_breadth": "topical_breadth", "u09_tenure": "tenure",
    "u10_own_toxicity": "own_toxicity_mean", "u11_own_severe_toxicity": "own_severe_toxicity_mean", "u12_reply_to_toxic": "reply_to_toxic_rate",
    "u13_toxicity_received": "toxicity_received_mean", "u14_conflict_engagement": "conflict_engagement_ratio", "u17_namespace_shares": "frac_interpersonal, frac_content, frac_project",
    "u22_toxicity_extremes": "tox_max, sev_max", "u24_burstiness": "burstiness_cv", "u25_activity_density": "activity_density", "u26_hostility": "hostility_score",
    "u27_namespace_focus": "namespace_focus", "u28_counts": "message_count, thread_count",
}.items():
    feature(_name, _columns)

_TEXT = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY thread_id, seq) AS nth FROM {turns}),
tok AS (SELECT user_id, @explode(@all(lower(text), @re('[a-z]+'))) AS w FROM t WHERE nth <= 50),
ttr AS (SELECT user_id, @f(count(DISTINCT w)) / count(*) AS ttr FROM tok GROUP BY user_id)
SELECT t.user_id, @r6(ln(1.0 + avg(@f(length(text))))) AS verbosity, @r6(avg(CASE WHEN @matches(text, @re('[?]\\s*$')) THEN 1.0 ELSE 0.0 END)) AS question_rate,
  @r6(avg(CASE WHEN @contains(text, 'WP:') OR @contains(text, 'Wikipedia:') THEN 1.0 ELSE 0.0 END)) AS wp_citation_rate,
  @r6(avg(CASE WHEN @contains(text, '!') THEN 1.0 ELSE 0.0 END)) AS exclaim_rate, @r6(coalesce(max(ttr), 0.0)) AS lexical_ttr
FROM t LEFT JOIN ttr ON t.user_id = ttr.user_id GROUP BY t.user_id
"""
for _name, _columns in {
    "u03_verbosity": "verbosity", "u15_question_rate": "question_rate", "u16_wp_citations": "wp_citation_rate", "u20_exclaim_rate": "exclaim_rate", "u21_lexical_ttr": "lexical_ttr",
    "u29_text_vector": "verbosity, question_rate, exclaim_rate, lexical_ttr",
}.items():
    operator(_name, f"SELECT user_id, {_columns} FROM ({_TEXT}) AS u")

operator("u30_audit_candidates", """
SELECT user_id, @r6(stddev_pop(toxicity)) AS tox_std, @r6(@percentile(toxicity, 0.9)) AS tox_p90, @r6(avg(CASE WHEN toxicity >= 0.6 THEN 1.0 ELSE 0.0 END)) AS tox_high_share,
  @r6(stddev_pop(severe_toxicity)) AS sev_std, @r6(stddev_pop(@f(indentation))) AS indent_std, @n(max(indentation)) AS indent_max, @n(count(DISTINCT cast(ts as date))) AS active_days
FROM {messages} GROUP BY user_id""")

operator("f01_activity_floor", "SELECT user_id, @n(count(*)) AS n FROM {messages} GROUP BY user_id HAVING count(*) >= 5")
operator("f02_ghost_removal", f"""
WITH {LINKED}, active AS (SELECT user_id FROM {{messages}} GROUP BY user_id HAVING count(*) >= 5)
SELECT l.parent_user AS user_id, @n(count(*)) AS replies FROM linked l WHERE l.parent_user IN (SELECT user_id FROM active) AND l.user_id IN (SELECT user_id FROM active) GROUP BY l.parent_user""".replace("{{", "{").replace("}}", "}"))
operator("f03_background_label", """
WITH c AS (SELECT user_id, count(*) AS n FROM {messages} GROUP BY user_id)
SELECT c.user_id, @n(c.n) AS n, @n(coalesce(l.leaf, -1)) AS leaf FROM c LEFT JOIN (SELECT DISTINCT user_id, community AS leaf FROM {messages} WHERE user_id % 3 <> 0) l ON c.user_id = l.user_id""")
operator("f04_contested_threads", "SELECT thread_id, @n(count(DISTINCT user_id)) AS participants, count(DISTINCT user_id) >= 3 AS contested FROM {messages} GROUP BY thread_id")
operator("f05_text_predicates", """
SELECT msg_id, @contains(text, '!') AS exclaims, @matches(text, @re('[?]\\s*$')) AS asks, @contains(text, 'WP:') OR @contains(text, 'Wikipedia:') AS cites, length(trim(text)) >= 10 AS long_enough,
  NOT (substr(text, 1, 2) = '::') AS not_indented FROM {turns}""")
CANONICAL_ACTION = """CASE action WHEN 'discuss' THEN 'participation' WHEN 'agree' THEN 'participation' WHEN 'post' THEN 'participation' WHEN 'reply' THEN 'participation'
  WHEN 'disagree' THEN 'conflict' WHEN 'revert' THEN 'conflict' WHEN 'edit' THEN 'content_change' WHEN 'delete' THEN 'moderation' WHEN 'restore' THEN 'moderation' WHEN 'report' THEN 'moderation' ELSE 'other' END"""
operator("f06_canonical_actions", f"SELECT {CANONICAL_ACTION} AS class, @n(count(*)) AS n FROM {{messages}} GROUP BY 1")
operator("f07_graph_members", f"WITH {LINKED} SELECT msg_id, user_id, parent_user FROM linked WHERE parent_user IS NOT NULL AND parent_user <> user_id")
operator("f08_scored_toxicity", "SELECT thread_id, @n(count(toxicity)) AS scored, @r6(avg(toxicity)) AS mean FROM {messages} GROUP BY thread_id")
operator("f09_degenerate_reference", f"""
WITH c AS (SELECT {CANONICAL_ACTION} AS class, count(*) AS n FROM {{messages}} GROUP BY 1)
SELECT @n(count(*)) AS classes, @r6(max(@f(n)) / sum(n)) AS top_share, count(*) < 2 OR max(@f(n)) / sum(n) >= 0.995 AS degenerate FROM c""")
operator("f10_required_metrics", """
SELECT condition, @n(sum(CASE WHEN action_distance IS NULL OR isnan(action_distance) THEN 1 ELSE 0 END)) AS bad_action, @n(sum(CASE WHEN interaction_distance IS NULL OR isnan(interaction_distance) THEN 1 ELSE 0 END)) AS bad_interaction,
  @n(sum(CASE WHEN language_distance IS NULL THEN 1 ELSE 0 END)) AS bad_language FROM {results} GROUP BY condition""")
operator("f11_round_completeness", """
WITH r AS (SELECT DISTINCT round FROM {messages}), x AS (SELECT max(round) AS top FROM r), want AS (SELECT @explode(@range(0, top)) AS round FROM x)
SELECT @n(count(*)) AS rounds, @n(sum(CASE WHEN r.round IS NULL THEN 1 ELSE 0 END)) AS missing, sum(CASE WHEN r.round IS NULL THEN 1 ELSE 0 END) = 0 AS complete FROM want LEFT JOIN r ON want.round = r.round""")
operator("f13_metric_preflight", f"""
WITH {LINKED} SELECT @n(sum(CASE WHEN parent_user <> user_id THEN 1 ELSE 0 END)) AS reply_edges, @n(count(DISTINCT {CANONICAL_ACTION})) AS classes, @n(sum(CASE WHEN {CANONICAL_ACTION} <> 'participation' THEN 1 ELSE 0 END)) AS non_participation,
  sum(CASE WHEN parent_user <> user_id THEN 1 ELSE 0 END) >= 1 AND count(DISTINCT {CANONICAL_ACTION}) >= 2 AS passes FROM linked""")
operator("f14_evidence_type", """SELECT CASE WHEN quality = 0 THEN 'delete' WHEN toxic = 1 THEN 'attack' WHEN length(text) >= 5000 THEN 'toxic' ELSE 'none' END AS evidence, @n(count(*)) AS n FROM {texts} GROUP BY 1""")
operator("f15_utterance_tier", """SELECT CASE WHEN role = 'system' THEN 'decision' WHEN length(text) >= 200 THEN 'substantive' ELSE 'casual' END AS tier, @n(count(*)) AS n FROM {turns} GROUP BY 1""")
operator("f16_valid_revert", """
SELECT a.thread_id, a.user_id, @any(b.user_id IS NOT NULL) AS may_revert FROM (SELECT DISTINCT thread_id, user_id FROM {messages}) a
LEFT JOIN (SELECT DISTINCT thread_id, user_id FROM {messages} WHERE action = 'edit') b ON a.thread_id = b.thread_id AND a.user_id <> b.user_id GROUP BY a.thread_id, a.user_id""")
operator("f17_level_buckets", """
SELECT user_id, CASE WHEN avg(toxicity) < 0.3 THEN 'low' WHEN avg(toxicity) < 0.6 THEN 'moderate' ELSE 'high' END AS hostility, CASE WHEN count(*) < 40 THEN 'low' WHEN count(*) < 70 THEN 'moderate' ELSE 'high' END AS activity FROM {messages} GROUP BY user_id""")
operator("f19_grid_equality", """
WITH want AS (SELECT c.condition, d.dataset, r.repeat FROM (SELECT DISTINCT condition FROM {results}) c CROSS JOIN (SELECT DISTINCT dataset FROM {results}) d CROSS JOIN (SELECT DISTINCT repeat FROM {results}) r)
SELECT @n(count(*)) AS cells, @n(sum(CASE WHEN have.condition IS NULL THEN 1 ELSE 0 END)) AS missing, @n(sum(CASE WHEN want.condition IS NULL THEN 1 ELSE 0 END)) AS unexpected
FROM want FULL OUTER JOIN {results} have ON want.condition = have.condition AND want.dataset = have.dataset AND want.repeat = have.repeat""")
operator("f20_condition_names", "SELECT DISTINCT condition, condition LIKE '1-%' OR condition LIKE '2-%' AS treated, substr(condition, 1, 1) AS suffix FROM {results}")

operator("j01_parent_join", f"WITH {LINKED} SELECT msg_id, user_id, parent_user, @r6(parent_toxicity) AS parent_toxicity FROM linked")
operator("j03_conflict_labels", "SELECT msg_id, coalesce(toxic, 0) = 1 AS attack FROM {texts}")
operator("j04_active_messages", "SELECT m.msg_id FROM {messages} m WHERE m.user_id IN (SELECT user_id FROM {messages} GROUP BY user_id HAVING count(*) >= 60)")
operator("j06_thread_majority", """
WITH v AS (SELECT thread_id, community, count(DISTINCT user_id) AS n FROM {messages} GROUP BY thread_id, community), r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY n DESC, community) AS k FROM v)
SELECT thread_id, @n(community) AS leaf, @n(n) AS votes FROM r WHERE k = 1""")
operator("j07_paired_results", """
SELECT t.dataset, t.repeat, @r6(t.action_distance) AS treatment, @r6(c.action_distance) AS control FROM {results} t JOIN {results} c ON t.dataset = c.dataset AND t.model = c.model AND t.repeat = c.repeat
WHERE t.condition = '1-URGENT' AND c.condition = '5-LOW'""")
operator("j08_positional_pairs", """
WITH r AS (SELECT condition, action_distance AS x, row_number() OVER (PARTITION BY condition ORDER BY dataset, repeat) AS k FROM {results})
SELECT a.k, @r6(a.x) AS treatment, @r6(b.x) AS control FROM r a JOIN r b ON a.k = b.k WHERE a.condition = '1-URGENT' AND b.condition = '2-HIGH'""")
operator("j09_leakage", """
SELECT d.doc_id FROM {documents} d JOIN {benchmark} b ON @contains(d.text, b.text) GROUP BY d.doc_id""")
operator("j15_prefix_join", """
WITH p AS (SELECT msg_id, user_id, lower(@first_chars(trim(@replace(text, @re('\\s+'), ' ')), 200)) AS prefix FROM {texts}), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, prefix ORDER BY msg_id) AS k FROM p)
SELECT p.msg_id, f.msg_id AS first_msg FROM p JOIN f ON p.user_id = f.user_id AND p.prefix = f.prefix WHERE f.k = 1""")
operator("j16_merge_map", "SELECT CASE leaf WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE leaf END AS merged, @n(count(DISTINCT user_id)) AS users FROM {vectors} GROUP BY 1")
# role labels come under pseudonyms: the messages' users are hashed to the same keys before they meet
operator("j18_pseudonym_join", """
WITH roles AS (SELECT DISTINCT concat('user_', substr(@sha(concat('salt::', cast(user_id as varchar(20)))), 1, 16)) AS who, community AS role FROM {messages} WHERE user_id % 3 <> 0),
m AS (SELECT concat('user_', substr(@sha(concat('salt::', cast(user_id as varchar(20)))), 1, 16)) AS who, thread_id FROM {messages})
SELECT m.thread_id, coalesce(roles.role, -1) AS role, @n(count(*)) AS n FROM m LEFT JOIN roles ON m.who = roles.who GROUP BY 1, 2""",
         check="SELECT thread_id, CASE WHEN user_id % 3 = 0 THEN -1 ELSE community END AS role, @n(count(*)) AS n FROM {messages} GROUP BY ALL")
operator("j02_conversation_metadata", """
WITH c AS (SELECT thread_id, count(*) AS turns, count(DISTINCT user_id) AS people, min(CASE WHEN seq = 0 THEN role END) AS opener FROM {turns} GROUP BY thread_id)
SELECT t.msg_id, @n(c.turns) AS turns, @n(c.people) AS people, c.opener FROM {turns} t LEFT JOIN c ON t.thread_id = c.thread_id""")
operator("j05_features_and_embeddings", """
WITH f AS (SELECT user_id, count(*) AS n, avg(toxicity) AS mean_toxicity FROM {messages} GROUP BY user_id), e AS (SELECT user_id, sqrt(sum(x * x)) AS norm FROM {vectors} GROUP BY user_id)
SELECT f.user_id, @n(f.n) AS n, @r6(f.mean_toxicity) AS mean_toxicity, @r6(e.norm) AS norm FROM f JOIN e ON f.user_id = e.user_id""")
operator("j10_ordered_pairs", "WITH l AS (SELECT DISTINCT leaf FROM {vectors}) SELECT a.leaf AS i, b.leaf AS j FROM l a JOIN l b ON a.leaf < b.leaf")
operator("w14_allocation_remainder", """
WITH c AS (SELECT leaf, count(DISTINCT user_id) AS n FROM {vectors} GROUP BY leaf), s AS (SELECT leaf, n, @floor(30.0 * n / sum(n) OVER ()) AS share, row_number() OVER (ORDER BY leaf) AS i, count(*) OVER () AS k FROM c)
SELECT leaf, @n(CASE WHEN i = k THEN 30 - (sum(share) OVER () - share) ELSE share END) AS seats FROM s""")
operator("d03_iso_times", "SELECT msg_id, @iso(ts) AS iso FROM {messages}")

operator("a01_messages_per_user", "SELECT user_id, @n(count(*)) AS n FROM {messages} GROUP BY user_id")
operator("a02_action_counts", f"""
WITH {LINKED}, own AS (SELECT user_id, sum(CASE WHEN action = 'edit' THEN 1 ELSE 0 END) AS edits, sum(CASE WHEN action = 'revert' THEN 1 ELSE 0 END) AS reverts, sum(CASE WHEN action = 'restore' THEN 1 ELSE 0 END) AS restores FROM linked GROUP BY user_id),
got AS (SELECT parent_user AS user_id, sum(CASE WHEN action = 'edit' THEN 1 ELSE 0 END) AS edited, sum(CASE WHEN action = 'revert' THEN 1 ELSE 0 END) AS reverted FROM linked WHERE parent_user IS NOT NULL GROUP BY parent_user)
SELECT own.user_id, @n(edits) AS edits, @n(reverts) AS reverts, @n(restores) AS restores, @n(coalesce(edited, 0)) AS edited, @n(coalesce(reverted, 0)) AS reverted FROM own LEFT JOIN got ON own.user_id = got.user_id""")
operator("a03_distinct_sizes", f"WITH {LINKED} SELECT user_id, @n(count(DISTINCT parent_user)) AS targets, @n(count(DISTINCT topic)) AS topics, @n(count(DISTINCT thread_id)) AS threads FROM linked GROUP BY user_id")
operator("a04_accumulator", """
WITH y AS (SELECT user_id, round % 3 AS part, count(*) AS n, max(toxicity) AS hi, min(@epoch(ts)) AS first, max(@epoch(ts)) AS last FROM {messages} GROUP BY user_id, round % 3)
SELECT user_id, @n(sum(n)) AS n, @r6(max(hi)) AS tox_max, @r6(min(first)) AS first_seen, @r6(max(last)) AS last_seen FROM y GROUP BY user_id""")
operator("a05_action_distribution", "SELECT action, @r6(@f(count(*)) / sum(count(*)) OVER ()) AS share FROM {messages} GROUP BY action")
_MATRIX = "SELECT user_id, " + ", ".join(f"sum(CASE WHEN action = '{a}' THEN 1 ELSE 0 END) AS {a}" for a in ("discuss", "edit", "report", "restore", "revert")) + " FROM {messages} GROUP BY user_id"
operator("a06_action_matrix", "SELECT user_id, @n(discuss) AS discuss, @n(edit) AS edit, @n(report) AS report, @n(restore) AS restore, @n(revert) AS revert FROM (" + _MATRIX + ") AS a")
operator("a07_action_profiles", "SELECT user_id, " + ", ".join(f"@r6(@f({a}) / nullif(discuss + edit + report + restore + revert, 0)) AS {a}" for a in ("discuss", "edit", "report", "restore", "revert")) + " FROM (" + _MATRIX + ") AS a")
operator("a08_cluster_summary", "SELECT community, @r6(avg(toxicity)) AS mean, @r6(stddev_pop(toxicity)) AS std, @r6(min(toxicity)) AS low, @r6(max(toxicity)) AS high, @r6(@percentile(toxicity, 0.5)) AS median FROM {messages} GROUP BY community")
operator("a09_majority_action", "WITH c AS (SELECT user_id, action, count(*) AS n FROM {messages} GROUP BY user_id, action), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, action) AS k FROM c) SELECT user_id, action, @n(n) AS n FROM r WHERE k = 1")
operator("a10_token_frequency", """
WITH w AS (SELECT leaf, @explode(@all(lower(text), @re('[a-z]+'))) AS word FROM {texts}), c AS (SELECT leaf, word, count(*) AS n FROM w GROUP BY leaf, word), r AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY n DESC, word) AS k FROM c)
SELECT leaf, word, @n(n) AS n, @n(k) AS rank FROM r WHERE k <= 20""")
operator("a11_numeric_summary", "SELECT @r6(avg(value)) AS mean, @r6(stddev_pop(value)) AS std, @r6(@percentile(value, 0.5)) AS p50, @r6(@percentile(value, 0.9)) AS p90, @r6(avg(CASE WHEN value <> 0 THEN 1.0 ELSE 0.0 END)) AS nonzero FROM {events}")
operator("a12_corpus_header", "SELECT @n(count(DISTINCT thread_id)) AS threads, @n(count(*)) AS messages, @n(count(DISTINCT user_id)) AS users, @r6(avg(toxicity)) AS toxicity, @r6(avg(CASE WHEN toxicity >= 0.6 THEN 1.0 ELSE 0.0 END)) AS toxic_share FROM {messages}")
operator("a13_correlations", f"SELECT @r6(@corr(reply_rate, activity)) AS reply_activity, @r6(@corr(tenure, activity)) AS tenure_activity, @r6(@corr(own_toxicity_mean, tox_max)) AS tox_mean_max, @r6(@corr(frac_content, frac_interpersonal)) AS content_interpersonal FROM ({USER_FEATURES}) AS u")
operator("a14_cost_rollup", "SELECT condition, @n(sum(message_count)) AS messages, @r6(sum(action_distance)) AS cost FROM {results} GROUP BY ROLLUP (condition)")
operator("a15_first_value", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY condition, repeat) AS k FROM {results}) SELECT dataset, model, condition, @r6(action_distance) AS value FROM r WHERE k = 1")
operator("a16_weighted_mean", "SELECT dataset, @r6(sum(message_count * action_distance) / sum(message_count)) AS value FROM {results} GROUP BY dataset")
operator("a17_mean_std_cells", "SELECT condition, @fixed2('%.3f ± %.3f', avg(action_distance), stddev_samp(action_distance)) AS cell FROM {results} GROUP BY condition")
operator("a19_provenance", "SELECT dataset, @any(safe_rate > 0.04) AS any_flag, NOT @any(safe_rate > 0.9) AS release_ready FROM {results} GROUP BY dataset")
operator("a18_sketches", "SELECT action, approx_count_distinct(user_id) AS users, hll_sketch_estimate(hll_sketch_agg(user_id)) AS sketched FROM {messages} GROUP BY action", oracle=False)

operator("w01_gaps", "SELECT msg_id, @r6(@epoch(ts) - lag(@epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, msg_id)) AS gap FROM {messages}")
operator("w02_first_k", "SELECT user_id, msg_id, @n(k) AS k FROM (SELECT user_id, msg_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM {messages}) AS r WHERE k <= 15")
operator("w04_position_bins", """
WITH p AS (SELECT action, row_number() OVER (PARTITION BY thread_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY thread_id) AS n FROM {messages})
SELECT least(@floor(@f(i) / (n - 1) * 30), 29) AS bin, @n(count(*)) AS n FROM p WHERE n > 1 GROUP BY 1""")
_ROUND = "r AS (SELECT round, count(*) AS n, sum(CASE WHEN action IN ('disagree', 'revert', 'counter_argue', 'report', 'block') THEN 1 ELSE 0 END) AS conflicts FROM {messages} GROUP BY round)"
operator("w05_escalation_episodes", f"""
WITH {_ROUND}, h AS (SELECT round, @f(conflicts) / n > 0.2 AS high FROM r), g AS (SELECT round, round - row_number() OVER (ORDER BY round) AS island FROM h WHERE high)
SELECT @n(min(round)) AS first_round, @n(max(round)) AS last_round, @n(count(*)) AS rounds FROM g GROUP BY island""")
# an item's age is counted from the last round of its thread; system turns are summaries; every second thread is the one asked about
_IMPORTANCE = "(1.0 + CASE WHEN length(text) > 200 THEN 0.5 ELSE 0.0 END) * CASE WHEN thread_id % 2 = 0 THEN 2.0 ELSE 1.0 END * CASE WHEN role = 'system' THEN 1.5 ELSE 1.0 END"
operator("w06_memory_ranking", f"""
WITH a AS (SELECT thread_id, msg_id, text, role, max(seq) OVER (PARTITION BY thread_id) - seq AS age FROM {{turns}}), s AS (SELECT thread_id, msg_id, {_IMPORTANCE} / (1 + 0.1 * age) AS score, length(text) AS cost FROM a),
c AS (SELECT *, row_number() OVER w AS k, sum(cost) OVER (PARTITION BY thread_id ORDER BY score DESC, msg_id ROWS UNBOUNDED PRECEDING) AS used FROM s WINDOW w AS (PARTITION BY thread_id ORDER BY score DESC, msg_id))
SELECT thread_id, msg_id, @r6(score) AS score FROM c WHERE k = 1 OR (used <= 2000 AND k <= 5)""",
         check=f"""
WITH l AS (SELECT thread_id, max(seq) AS last FROM {{turns}} GROUP BY thread_id), s AS (SELECT t.thread_id, t.msg_id, {_IMPORTANCE.replace('thread_id', 't.thread_id')} / (1 + 0.1 * (l.last - t.seq)) AS score, length(t.text) AS cost FROM {{turns}} t JOIN l ON l.thread_id = t.thread_id),
p AS (SELECT x.thread_id, x.msg_id, x.score, count(y.msg_id) AS ahead, coalesce(sum(y.cost), 0) + x.cost AS used FROM s x LEFT JOIN s y ON y.thread_id = x.thread_id AND (y.score > x.score OR (y.score = x.score AND y.msg_id < x.msg_id)) GROUP BY x.thread_id, x.msg_id, x.score, x.cost)
SELECT thread_id, msg_id, @r6(score) AS score FROM p WHERE ahead = 0 OR (used <= 2000 AND ahead < 5)""")  # fmt: skip
operator("w07_cdf", "SELECT msg_id, @r6(cume_dist() OVER (ORDER BY toxicity)) AS cdf, @n(rank() OVER (ORDER BY toxicity)) AS rank FROM {messages}")
operator("w10_latest_round", "SELECT thread_id, @n(max(round)) AS round, max_by(msg_id, round * 10000000 + msg_id) AS msg_id FROM {messages} GROUP BY thread_id")
operator("w11_direction_changes", """
WITH d AS (SELECT user_id, seq, sign(toxicity - lag(toxicity) OVER (PARTITION BY user_id ORDER BY seq)) AS s FROM {messages}), e AS (SELECT user_id, s, lag(s) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM d)
SELECT user_id, @n(sum(CASE WHEN s <> before THEN 1 ELSE 0 END)) AS changes FROM e GROUP BY user_id""")
# a row for each place of a thread: the last place before it, and the last one before the run of places that one user alone holds
operator("w12_reply_target", """
WITH g AS (SELECT thread_id, seq, min(user_id) AS lo, max(user_id) AS hi FROM {messages} WHERE thread_id IS NOT NULL AND seq IS NOT NULL AND user_id IS NOT NULL GROUP BY thread_id, seq),
p AS (SELECT *, lag(seq) OVER w AS p_seq, lag(lo) OVER w AS p_lo, lag(hi) OVER w AS p_hi, lag(seq, 2) OVER w AS q_seq, lag(lo, 2) OVER w AS q_lo, lag(hi, 2) OVER w AS q_hi FROM g WINDOW w AS (PARTITION BY thread_id ORDER BY seq)),
b AS (SELECT *, max(CASE WHEN p_lo <> p_hi OR q_lo <> p_lo OR q_hi <> p_lo THEN q_seq END) OVER (PARTITION BY thread_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS before FROM p),
t AS (SELECT m.msg_id, CASE WHEN p_lo <> m.user_id OR p_hi <> m.user_id THEN p_seq ELSE before END AS target FROM {messages} m JOIN b ON b.thread_id = m.thread_id AND b.seq = m.seq WHERE m.user_id IS NOT NULL)
SELECT msg_id, @n(max(target)) AS target FROM t WHERE target IS NOT NULL GROUP BY msg_id""", check="""
WITH l AS (SELECT a.msg_id, max(b.seq) AS target FROM {messages} a JOIN {messages} b ON a.thread_id = b.thread_id AND b.seq < a.seq AND b.user_id <> a.user_id GROUP BY a.msg_id) SELECT msg_id, @n(target) AS target FROM l""")
operator("w15_even_split", "WITH c AS (SELECT DISTINCT community FROM {messages}), k AS (SELECT community, row_number() OVER (ORDER BY community) - 1 AS i, count(*) OVER () AS n FROM c) SELECT community, @n(@div(18, n) + CASE WHEN i < 18 % n THEN 1 ELSE 0 END) AS agents FROM k")
operator("w16_index_quantiles", """
WITH c AS (SELECT user_id, count(*) AS x FROM {messages} GROUP BY user_id), o AS (SELECT x, row_number() OVER (ORDER BY x, user_id) - 1 AS i, count(*) OVER () AS n FROM c)
SELECT @n(max(CASE WHEN i = @div(n * 3, 4) THEN x END)) AS upper_quarter, @n(max(CASE WHEN i = @div(n, 2) THEN x END)) AS half FROM o""")

_EDGE = f"{LINKED}, e AS (SELECT DISTINCT user_id AS a, parent_user AS b FROM linked WHERE parent_user <> user_id)"
operator("o02_reciprocity_sets", f"WITH {_EDGE} SELECT x.a AS user_id, @n(count(*)) AS mutual FROM e x JOIN e y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
operator("o03_coverage", """
WITH s AS (SELECT DISTINCT action FROM {messages} WHERE side = 'sim'), r AS (SELECT DISTINCT action FROM {messages} WHERE side = 'real')
SELECT @r6(coalesce(@f((SELECT count(*) FROM r WHERE action IN (SELECT action FROM s))) / nullif((SELECT count(*) FROM r), 0), 1.0)) AS coverage""")
operator("o04_set_difference", "SELECT DISTINCT topic, user_id FROM {messages} WHERE action = 'edit' EXCEPT SELECT topic, user_id FROM {messages} WHERE action = 'revert'")
operator("o05_action_union", "SELECT action FROM {messages} WHERE side = 'sim' UNION SELECT action FROM {messages} WHERE side = 'real'")
operator("o07_common_users", "SELECT v.user_id FROM (SELECT DISTINCT user_id FROM {vectors}) v JOIN (SELECT DISTINCT user_id FROM {messages}) m ON v.user_id = m.user_id")
operator("o01_event_union", "SELECT action, @n(count(*)) AS n FROM (SELECT msg_id, action FROM {messages} UNION ALL SELECT msg_id, 'base' AS action FROM {messages}) AS u GROUP BY action")
