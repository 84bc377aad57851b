"""Scrubbing of personal data, tokens and text profiles."""

from threadloom.operators.sqlop import operator

# Of the compressed forms of IPv6 those with groups after "::" can't be reached: where one of them matches,
# the groups up to "::" have matched before.
# The patterns of personal data and their tokens, in the order in which they apply.
PII = (
    ("p01_email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    ("p02_url", r"(?:https?://|www\.)[^\s<>\"]+[^\s<>\".,;!?)\]]", "[URL]"),
    ("p03_ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", "[IP]"),
    ("p04_ipv6", r"(?:(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}|(?:[A-Fa-f0-9]{1,4}:){1,7}:|(?:[A-Fa-f0-9]{1,4}:){1,6}:[A-Fa-f0-9]{1,4}|::(?:[A-Fa-f0-9]{1,4}:){0,6}[A-Fa-f0-9]{1,4}|::)(?:/\d{1,3})?", "[IP]"),
    ("p05_mention", r"(?:^|\s)(?:@[A-Za-z0-9_]{3,}|u/[A-Za-z0-9_]{3,})", " [MENTION]"),
    ("p07_long_digits", r"\b\d{7,}\b", "[ID]"),
)
for _name, _pattern, _token in PII:
    operator(_name, f"SELECT msg_id, md5(@replace(text, @re('{_pattern}'), '{_token}')) AS digest, @matches(text, @re('{_pattern}')) AS found FROM {{texts}}")
operator("p06_bare_handle", "SELECT msg_id, md5(@handles(text)) AS digest, @handles(text) <> text AS found FROM {texts}")
_SCRUB = "text"
for _name, _pattern, _token in PII:
    if _name == "p07_long_digits":  # bare handles go after mentions and before digits
        _SCRUB = f"@handles({_SCRUB})"
    _SCRUB = f"@replace({_SCRUB}, @re('{_pattern}'), '{_token}')"
operator("p09_scrubbed_messages", f"SELECT msg_id, md5({_SCRUB}) AS digest, {_SCRUB} <> text AS scrubbed FROM {{texts}}")
operator("p02_page_urls", f"SELECT page_id, md5(@replace(coalesce(html, ''), @re('{PII[1][1]}'), '[URL]')) AS digest FROM {{pages}}")
operator("p08_pseudonyms", "SELECT user_id, concat('user_', substr(@sha(concat('salt::', cast(user_id as varchar(20)))), 1, 16)) AS pseudonym FROM (SELECT DISTINCT user_id FROM {messages}) u")

operator("t01_word_tokens", "SELECT msg_id, @n(@size(@all(lower(text), @re('[a-z]+')))) AS words FROM {texts}")
operator("t02_sentences", "SELECT msg_id, @n(@size(@filter_nonempty(@split(text, @re('[.!?]+'))))) AS sentences FROM {texts}")
operator("t03_whitespace", "SELECT msg_id, md5(lower(trim(@replace(text, @re('\\s+'), ' ')))) AS digest FROM {texts}")
operator("t04_truncations", "SELECT msg_id, md5(@first_chars(text, 80)) AS c80, md5(@first_chars(text, 200)) AS c200, md5(@first_chars(text, 512)) AS c512 FROM {texts}")
operator("t05_marker_counts", "SELECT msg_id, @n(@div(length(text) - length(replace(text, 'the', '')), 3)) AS the_count, @n(@size(@all(lower(text), @re('\\band\\b')))) AS and_count FROM {texts}")
operator("t07_token_estimate", "SELECT msg_id, @n(floor(greatest(1, @div(length(text), 3)) * @f(1.15)) + 1) AS tokens FROM {turns}")
operator("t08_key_positions", "SELECT msg_id, @n(least(@size(@filter_nonempty(@split(text, @re('[.]')))), 3)) AS positions FROM {turns}")
operator("t09_evidence_lines", "SELECT CASE WHEN @contains(text, 'License') THEN 'license' WHEN @contains(text, '@') THEN 'contact' ELSE 'other' END AS kind, @n(count(*)) AS n FROM {texts} GROUP BY 1")
operator("t11_url_normal", "SELECT page_id, CASE WHEN url LIKE '%/' THEN substr(url, 1, length(url) - 1) ELSE url END AS url, CASE WHEN @contains(url, '?') THEN 'query' ELSE 'plain' END AS kind FROM {pages}")

# Word lists of the style profile.
CERTAIN = ("certainly", "obviously", "clearly", "definitely", "absolutely", "undoubtedly", "surely", "must", "always", "never", "fact")
HEDGE = ("maybe", "perhaps", "possibly", "might", "could", "seem", "appear", "likely", "probably", "somewhat", "arguably")
TRANSITION = ("but", "however", "nevertheless", "nonetheless", "yet", "although", "though", "whereas", "while", "on the other hand", "conversely", "in contrast", "despite", "in spite of")
FIRST = ("i", "me", "my", "mine", "myself", "we", "us", "our", "ours")
ACADEMIC = ("furthermore", "moreover", "consequently", "nevertheless", "hypothesis", "empirical", "methodology", "theoretical", "analysis", "systematic", "comprehensive", "significant")
ANALOGY = ("like", "as if", "similar to", "analogous", "comparable", "in the same way", "much like", "akin to")
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_TOKENS = "tok AS (SELECT leaf, @explode(@all(lower(text), @re('[a-z0-9_]+'))) AS w FROM {texts})"
_SENT = "sent AS (SELECT leaf, @explode(@filter_nonempty(@split(text, @re('[.!?]+')))) AS s FROM {texts})"
_COUNT = lambda words, as_: f"sum(CASE WHEN w IN {_IN(words)} THEN 1 ELSE 0 END) AS {as_}"
#: Words of each kind in a leaf, and words and sentences; sentences have lost their marks, so none is a question.
_WORDS = f"words AS (SELECT leaf, count(*) AS n, {_COUNT(FIRST, 'me')}, {_COUNT(CERTAIN, 'sure')}, {_COUNT(HEDGE, 'hedged')}, {_COUNT(ACADEMIC, 'academic')}, sum(CASE WHEN @matches(w, @re('^[0-9]')) THEN 1 ELSE 0 END) AS data FROM tok GROUP BY leaf)"
_LENGTHS = "lens AS (SELECT leaf, avg(@f(@size(@all(s, @re('\\S+'))))) AS len, avg(CASE WHEN s LIKE '%?' THEN 1.0 ELSE 0.0 END) AS asked FROM sent GROUP BY leaf)"
_ANALOGIES = " + ".join(f"@div(length(lower(text)) - length(replace(lower(text), '{m}', '')), {len(m)})" for m in ANALOGY)
_TRANSITIONS = " + ".join(f"@size(@all(lower(text), @re('\\b{m}\\b')))" for m in TRANSITION)
_MARKERS = f"marks AS (SELECT leaf, sum(length(text)) AS chars, sum({_ANALOGIES}) AS analogies, sum({_TRANSITIONS}) AS transitions FROM {{texts}} GROUP BY leaf)"
# twins count within each text, by lists, and not in a table of all words
_OF = lambda words: f"sum(len(list_filter(t, lambda w: list_contains({list(words)}, w))))"
_BY_TEXT = f"""WITH l AS (SELECT leaf, text, lower(text) AS low, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM {{texts}}),
m AS (SELECT leaf, list_transform(s, lambda x: len(regexp_extract_all(x, '\\S+'))) AS k, * EXCLUDE (leaf) FROM l),
g AS (SELECT leaf, sum(len(t)) AS n, {_OF(FIRST)} AS me, {_OF(CERTAIN)} AS sure, {_OF(HEDGE)} AS hedged, {_OF(ACADEMIC)} AS academic, sum(len(list_filter(t, lambda w: w[1] BETWEEN '0' AND '9'))) AS data, sum(len(s)) AS sentences, sum(list_sum(k)) AS words, sum(length(text)) AS chars,
  sum({' + '.join(f"(len(string_split(low, '{m}')) - 1)" for m in ANALOGY)}) AS analogies, sum({' + '.join(f"(len(regexp_split_to_array(low, '{chr(92)}b{m}{chr(92)}b')) - 1)" for m in TRANSITION)}) AS transitions,
  avg(k[1]) FILTER (len(s) > 1) AS first, avg(list_avg(k[2:])) FILTER (len(s) > 1) AS rest FROM m GROUP BY leaf)"""
operator("t20_style_fingerprint", f"""
WITH {_TOKENS}, {_WORDS}, {_SENT}, {_LENGTHS}, {_MARKERS}
SELECT m.leaf, @r6(coalesce(len, 0.0)) AS sentence_words, @r6(coalesce(asked, 0.0)) AS question_share, @r6(coalesce(1000.0 * analogies / nullif(chars, 0), 0.0)) AS analogy_density, @r6(coalesce(@f(me) / n, 0.0)) AS first_person_rate,
  @r6(coalesce(@f(sure) / nullif(sure + hedged, 0), 0.5)) AS certainty_ratio, @r6(coalesce(1000.0 * transitions / nullif(chars, 0), 0.0)) AS transition_frequency FROM marks m LEFT JOIN words w ON m.leaf = w.leaf LEFT JOIN lens l ON m.leaf = l.leaf""",
         check=f"""{_BY_TEXT} SELECT leaf, @r6(coalesce(words / nullif(sentences, 0), 0.0)) AS sentence_words, @r6(0.0) AS question_share, @r6(coalesce(1000.0 * analogies / nullif(chars, 0), 0.0)) AS analogy_density, @r6(coalesce(me / nullif(n, 0), 0.0)) AS first_person_rate,
  @r6(coalesce(sure / nullif(sure + hedged, 0), 0.5)) AS certainty_ratio, @r6(coalesce(1000.0 * transitions / nullif(chars, 0), 0.0)) AS transition_frequency FROM g""")  # fmt: skip
#: Words of the first sentence and the mean of the others', of texts of two sentences and more.
_FIRST_REST = """numbered AS (SELECT leaf, @filter_nonempty(@split(text, @re('[.!?]+'))) AS s, msg_id FROM {texts}), each AS (SELECT leaf, msg_id, @size(@all(@get(s, 0), @re('\\S+'))) AS first, @size(s) AS n, @explode(s) AS x FROM numbered WHERE @size(s) > 1),
tell AS (SELECT leaf, msg_id, max(first) AS first, (sum(@size(@all(x, @re('\\S+')))) - max(first)) / @f(max(n) - 1) AS rest FROM each GROUP BY leaf, msg_id), conclusion AS (SELECT leaf, avg(@f(first)) AS first, avg(rest) AS rest FROM tell GROUP BY leaf)"""
_CONCLUSION = "CASE WHEN rest > 0 THEN greatest(0.0, least(1.0, 1 - (first / rest - 0.5) / 1.5)) ELSE 0.5 END"
operator("t21_style_tags", f"""
WITH {_TOKENS}, {_WORDS}, {_SENT}, {_LENGTHS}, {_FIRST_REST}
SELECT t.leaf, @r6(least(greatest(1 - 10.0 * coalesce(academic, 0) / coalesce(n, 1), 0.0), 1.0)) AS formal_casual, @r6(least(coalesce(len, 0.0) / 30, 1.0)) AS abstract_concrete, @r6(coalesce(@f(sure) / (sure + hedged + 1), 0.0)) AS cautious_assertive,
  @r6(least(10.0 * coalesce(academic, 0) / coalesce(n, 1), 1.0)) AS academic_plain, @r6(CASE WHEN coalesce(len, 0.0) <= 40 THEN least(1 - coalesce(len, 0.0) / 40, 1.0) ELSE 0.0 END) AS long_short, @r6({_CONCLUSION}) AS conclusion_first, @r6(coalesce(least(@f(data) / n / 0.15, 1.0), 0.5)) AS data_narrative
FROM (SELECT DISTINCT leaf FROM {{texts}}) t LEFT JOIN words w ON t.leaf = w.leaf LEFT JOIN lens l ON t.leaf = l.leaf LEFT JOIN conclusion c ON t.leaf = c.leaf""",
         check=f"""{_BY_TEXT} SELECT leaf, @r6(least(greatest(1 - 10 * coalesce(academic / nullif(n, 0), 0.0), 0.0), 1.0)) AS formal_casual, @r6(least(coalesce(words / nullif(sentences, 0), 0.0) / 30, 1.0)) AS abstract_concrete, @r6(sure / (sure + hedged + 1)) AS cautious_assertive,
  @r6(least(coalesce(10 * academic / nullif(n, 0), 0.0), 1.0)) AS academic_plain, @r6(CASE WHEN coalesce(words / nullif(sentences, 0), 0.0) <= 40 THEN 1 - coalesce(words / nullif(sentences, 0), 0.0) / 40 ELSE 0.0 END) AS long_short,
  @r6(CASE WHEN rest > 0 THEN greatest(0.0, least(1.0, 1 - (first / rest - 0.5) / 1.5)) ELSE 0.5 END) AS conclusion_first, @r6(coalesce(least(data / nullif(n, 0) / 0.15, 1.0), 0.5)) AS data_narrative FROM g""")  # fmt: skip
operator("t22_conclusion_first", f"WITH {_FIRST_REST} SELECT leaf, @r6({_CONCLUSION}) AS score FROM conclusion", check=f"{_BY_TEXT} SELECT leaf, @r6(CASE WHEN rest > 0 THEN greatest(0.0, least(1.0, 1 - (first / rest - 0.5) / 1.5)) ELSE 0.5 END) AS score FROM g WHERE first IS NOT NULL")
operator("t23_data_words", f"WITH {_TOKENS} SELECT leaf, @r6(least(avg(CASE WHEN @matches(w, @re('[0-9]')) THEN 1.0 ELSE 0.0 END) / 0.15, 1.0)) AS ratio FROM tok GROUP BY leaf")
operator("t24_vocabulary", f"WITH {_TOKENS}, c AS (SELECT leaf, w, count(*) AS n FROM tok WHERE length(w) > 2 GROUP BY leaf, w), r AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY n DESC, w) AS k FROM c) SELECT leaf, w AS word, @n(n) AS n FROM r WHERE k <= 30")
operator("t26_toxic_keywords", """
WITH tok AS (SELECT coalesce(toxic, 0) AS t, @explode(@all(lower(text), @re('[a-z]{3,12}'))) AS w FROM {texts} WHERE toxic IS NOT NULL), c AS (SELECT w, sum(t) AS a, sum(1 - t) AS b FROM tok GROUP BY w), s AS (SELECT sum(a) AS na, sum(b) AS nb, count(*) AS v FROM c),
o AS (SELECT w, a, ln((a + 1.0) / (na + v)) - ln((b + 1.0) / (nb + v)) AS odds FROM c CROSS JOIN s WHERE a >= 5), r AS (SELECT *, row_number() OVER (ORDER BY odds DESC, w) AS k FROM o WHERE odds >= 0.5)
SELECT w AS word, @n(a) AS n, @r6(odds) AS odds FROM r WHERE k <= 50""")
operator("t27_behaviour_gaps", "WITH p AS (SELECT community, action, @f(count(*)) / sum(count(*)) OVER (PARTITION BY community) AS p FROM {messages} GROUP BY community, action) SELECT a.community, b.community AS other, a.action FROM p a JOIN p b ON a.action = b.action AND a.community <> b.community WHERE b.p > 0.1 AND a.p < b.p")
operator("t28_other_clusters", "WITH c AS (SELECT community, action, count(*) AS n FROM {messages} GROUP BY community, action), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, action) AS k FROM c) SELECT community, @n(sum(n)) AS size, @join_sorted(CASE WHEN k <= 3 THEN action END, ',') AS top FROM r GROUP BY community")
operator("t29_orthogonality", """
WITH x AS (SELECT @f(@size(@all(text, @re('[?]')))) / greatest(length(text), 1) AS q, @f(@size(@all(text, @re('!')))) / greatest(length(text), 1) AS e, @f(@size(@all(text, @re('[.]')))) / greatest(length(text), 1) AS d, @f(@size(@all(text, @re('[0-9]')))) / greatest(length(text), 1) AS g FROM {texts})
SELECT @r4(coalesce(@corr(q, d), 0.0)) AS question_stop, @r4(coalesce(@corr(e, d), 0.0)) AS exclaim_stop, @r4(coalesce(@corr(g, d), 0.0)) AS digit_stop FROM x""")
operator("t30_profile_numbers", "SELECT community, @fixed2('%.2f toxic, %.1f turns', avg(toxicity), @f(count(*)) / count(DISTINCT user_id)) AS profile FROM {messages} GROUP BY community")
operator("t31_pole_labels", "SELECT user_id, CASE WHEN avg(toxicity) <= 0.33 THEN 'low' WHEN avg(toxicity) >= 0.67 THEN 'high' ELSE 'blend' END AS pole FROM {messages} GROUP BY user_id")
operator("t32_evidence_fill", "SELECT leaf, @n(least(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END), 13)) AS deletes, @n(least(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 2)) AS attacks FROM {texts} GROUP BY leaf")
operator("f18_clean_words", r"SELECT leaf, word, count(*) AS n FROM (SELECT leaf, explode(regexp_extract_all(lower(text), r'[a-z]+', 0)) AS word FROM {texts}) w WHERE length(word) BETWEEN 3 AND 12 AND NOT word rlike r'(.)\1{2,}' AND size(array_distinct(split(word, ''))) > 2 GROUP BY leaf, word", oracle=False)
operator("h01_id_hash", "SELECT community, @sha(@join_sorted(cast(msg_id as varchar(20)), ',')) AS digest FROM {messages} GROUP BY community")
