"""The registered queries as SQL over the same tables.

`VIEWS` are the inputs of `views.py`; a statement names the views it needs and
`ORACLE[name]` is the statement with those views in front.
"""

from __future__ import annotations

import re

from tideguard.config import AUDIT_LABELS, AUDIT_UNSAFE_WORDS, GUARD_CATEGORIES

VIEWS: dict[str, str] = {}
ORACLE: dict[str, str] = {}
START = 1704067200


def _view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def _oracle(name: str, sql: str) -> None:
    """Registers a statement with the views it needs, directly or through other views."""
    needed: list[str] = []

    def add(text: str) -> None:
        for view in VIEWS:
            if view not in needed and re.search(rf"\bv_{view}\b", text):
                add(VIEWS[view])
                if view not in needed:
                    needed.append(view)

    add(sql)
    parts = ",\n".join(f"v_{n} AS ({VIEWS[n]})" for n in needed)
    ORACLE[name] = (f"WITH {parts}\n" if parts else "") + sql.strip()


# --- inputs -------------------------------------------------------------------------------

_view("content", f"""
SELECT doc_id AS content_id, text, source, lang, doc_id * 120 + {START} AS ts FROM documents
""")
_view("signals", """
SELECT doc_id AS content_id,
  CASE WHEN (doc_id * 13) % 3 = 0 THEN 'unsafe' ELSE 'safe' END AS score_label,
  ((doc_id * 37) % 101) / CAST(100 AS DOUBLE) AS score_confidence,
  CASE WHEN (doc_id * 7) % 2 = 0 THEN 'unsafe' ELSE 'safe' END AS second_label,
  ((doc_id * 71) % 101) / CAST(100 AS DOUBLE) AS second_confidence,
  CASE WHEN doc_id % 7 <> 0 THEN CASE (doc_id * 3) % 7 WHEN 0 THEN 'safe' WHEN 1 THEN 'toxic'
    WHEN 2 THEN 'violence' WHEN 3 THEN 'politics' WHEN 4 THEN 'porn' WHEN 5 THEN 'gambling'
    ELSE 'spam' END END AS audit_label,
  CASE WHEN doc_id % 7 <> 0 THEN ((doc_id * 53) % 101) / CAST(100 AS DOUBLE) END
    AS audit_confidence,
  CASE WHEN doc_id % 7 <> 0 THEN 'audit of ' || source END AS audit_reason,
  CASE WHEN doc_id % 6 = 0 THEN 'nsfw' WHEN doc_id % 3 = 0 THEN 'normal' END AS image_label,
  CASE WHEN doc_id % 3 = 0 THEN ((doc_id * 29) % 101) / CAST(100 AS DOUBLE) END
    AS image_confidence
FROM documents
""")
_view("decisions", f"""
SELECT sha256(text) AS key,
  doc_id * 120 + {START} + 3600 - ((doc_id * 53) % 101) * 120 AS decided_at,
  doc_id AS entry_ord,
  CASE doc_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'block' ELSE 'review' END AS decision,
  ((doc_id * 37) % 101) / CAST(100 AS DOUBLE) AS confidence,
  'earlier ' || lang AS reason,
  CASE WHEN doc_id % 2 = 0 THEN 'L2_bert' ELSE 'L3_llm' END AS tier
FROM documents
""")
_view("requests", "SELECT content_id, sha256(text) AS key, ts FROM v_content")
_view("images", """
SELECT vec_id AS image_id, label, CAST(list_sum(list_transform(range(56), lambda i:
  CASE WHEN embedding[(i // 7) * 8 + i % 7 + 1] < embedding[(i // 7) * 8 + i % 7 + 2]
  THEN CAST(1 AS BIGINT) << CAST(55 - i AS INTEGER) ELSE 0 END)) AS BIGINT) AS image_hash
FROM embeddings
""")
_view("known", """
SELECT image_hash AS known_hash, image_id AS known_ord, 'category_' || (image_id % 3) AS category
FROM v_images WHERE label = 0
""")
_view("vectors", """
SELECT vec_id AS entry_id, embedding, CASE WHEN label < 5 THEN 'pass' ELSE 'block' END AS decision,
  CAST(0.5 AS DOUBLE) + label / CAST(20 AS DOUBLE) AS confidence,
  'like label ' || label AS reason, 'L2_bert' AS tier
FROM embeddings
""")
_view("gateway_content", """
SELECT c.content_id, CASE WHEN c.content_id % 50 = 7 THEN ' ' ELSE c.text END AS text, c.source,
  c.ts, CASE WHEN c.content_id % 3 = 0 THEN 'http://img/' || c.source END AS image_url,
  CASE WHEN c.content_id % 3 = 0 THEN substr(sha256('http://img/' || c.source), 1, 16) END
    AS image_ref,
  CASE WHEN c.content_id % 3 = 0 THEN i.image_hash END AS image_hash,
  e.embedding
FROM v_content c LEFT JOIN embeddings e ON e.vec_id = c.content_id
LEFT JOIN v_images i ON i.image_id = c.content_id
""")
_view("hash_store", """
SELECT image_hash, 'review' AS decision, CAST(0.6 AS DOUBLE) AS confidence,
  'seen as image ' || min(image_id) AS reason, 'image_agent' AS tier
FROM v_images WHERE label = 1 GROUP BY image_hash
""")
_view("ref_store", """
SELECT DISTINCT substr(sha256('http://img/' || source), 1, 16) AS image_ref, 'pass' AS decision,
  CAST(0.9 AS DOUBLE) AS confidence, 'reference seen' AS reason, 'image_agent' AS tier
FROM documents WHERE lang = 'en' AND source < 'src2'
""")
_view("mod_events", f"""
SELECT doc_id AS event_id, doc_id AS content_id, text, source, doc_id * 120 + {START} AS ts,
  CASE (doc_id * 13) % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'block' WHEN 2 THEN 'review'
    ELSE 'block' END AS decision,
  ((doc_id * 37) % 101) / CAST(100 AS DOUBLE) AS confidence,
  CASE doc_id % 5 WHEN 0 THEN 'L3_llm' WHEN 1 THEN 'L2_bert' WHEN 2 THEN 'L1_keyword'
    WHEN 3 THEN 'cache' ELSE 'L3_llm' END AS tier,
  'uses ''' || source || ''' with "' || lang || '" and ''idiot'' or ''x''' AS reason,
  'ai' AS source_label,
  CASE WHEN doc_id % 5 IN (0, 4) THEN 'L3_llm' ELSE 'L2_bert' END AS text_tier,
  CASE WHEN (doc_id * 7) % 3 = 0 THEN 'unsafe' ELSE 'safe' END AS text_label,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'unsafe' ELSE 'safe' END
    AS bert_preliminary
FROM documents
""")
_view("reviews", """
SELECT 'rev' || c.content_id AS review_id, c.content_id, c.text,
  CASE c.content_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'reviewed' ELSE 'dismissed' END AS status,
  c.ts AS enqueued_at, ((c.content_id * 17) % 101) / CAST(100 AS DOUBLE) AS priority,
  CASE c.content_id % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'block' WHEN 2 THEN 'pass' ELSE 'block'
    END AS ai_decision,
  s.score_confidence AS ai_confidence,
  CASE WHEN c.content_id % 3 = 1 THEN CASE WHEN c.content_id % 5 < 2 THEN 'pass' ELSE 'block' END
    END AS human_decision,
  CASE WHEN c.content_id % 3 = 1 THEN 'checked, says "abuse of ' || c.source || '"' END AS human_reason
FROM v_content c JOIN v_signals s ON s.content_id = c.content_id
WHERE s.score_confidence BETWEEN 0.3 AND 0.7
""")
_view("resolutions", f"""
SELECT 'rev' || doc_id AS review_id, CASE doc_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'block'
    WHEN 2 THEN 'maybe' WHEN 3 THEN 'block' ELSE 'pass' END AS human_decision,
  'mod' || source AS reviewer, 'because ' || lang AS reason,
  doc_id * 120 + {START} + 86400 AS resolved_at
FROM documents
""")
_view("human", """
SELECT content_id, text, human_decision AS decision, CAST(1.0 AS DOUBLE) AS confidence,
  human_reason AS reason, 'human' AS source_label, ai_decision, ai_confidence, human_decision,
  human_reason, 'human_review' AS tier
FROM v_reviews WHERE status = 'reviewed'
""")
_view("events", """
SELECT event_id, content_id, text, ts, decision, confidence, tier, reason, source_label, text_tier,
  text_label, bert_preliminary, CAST(NULL AS VARCHAR) AS ai_decision,
  CAST(NULL AS DOUBLE) AS ai_confidence, CAST(NULL AS VARCHAR) AS human_decision,
  CAST(NULL AS VARCHAR) AS human_reason
FROM v_mod_events
UNION ALL
SELECT NULL, content_id, text, NULL, decision, confidence, tier, reason, source_label, NULL, NULL,
  NULL, ai_decision, ai_confidence, human_decision, human_reason
FROM v_human
""")
_view("cases", """
SELECT c.*, CASE WHEN l.toxic = 1 THEN 'unsafe' ELSE 'safe' END AS expected, l.quality
FROM v_content c JOIN labels l ON l.doc_id = c.content_id
""")
_view("results", """
SELECT content_id, text, lang, source, quality, expected,
  CASE WHEN (expected = 'unsafe') = (content_id % 5 <> 0)
    THEN CASE WHEN content_id % 2 = 0 THEN 'block' ELSE 'review' END ELSE 'pass' END AS decision,
  ((content_id * 37) % 101) / CAST(100 AS DOUBLE) AS confidence,
  CASE (content_id * 5) % 8 WHEN 0 THEN 'L0_memory' WHEN 1 THEN 'L1_keyword' WHEN 2 THEN 'L2_bert'
    WHEN 3 THEN 'L3_llm' WHEN 4 THEN 'L0_whitelist' WHEN 5 THEN 'L1_chroma' WHEN 6 THEN 'L2_bert'
    ELSE 'human_review' END AS tier,
  CASE WHEN (content_id * 5) % 8 IN (0, 1, 4, 5) THEN 'hot' ELSE 'cold' END AS path,
  ((content_id * 97) % 2000) / CAST(4 AS DOUBLE) AS latency_ms,
  'because of ' || lang AS reason
FROM v_cases
""")
_view("graded", """
SELECT *, (expected = 'unsafe' AND decision IN ('block', 'review'))
  OR (expected = 'safe' AND decision = 'pass') AS correct FROM v_results
""")
_view("history", """
SELECT strftime(ts, '%Y-%m-%d') AS date,
  round(1 - count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE), 4) AS accuracy,
  count(*) AS sample_size
FROM events GROUP BY 1
""")

# Keywords.
_view("kw_dict", """
SELECT * FROM (VALUES ('idiot', 'toxic', 4), ('moron', 'toxic', 4), ('stupid', 'toxic', 4),
  ('clown', 'toxic', 4), ('scum', 'violence', 1), ('trash', 'violence', 1),
  ('worthless', 'porn', 2), ('pathetic', 'porn', 2), ('loser', 'gambling', 3),
  ('disgusting', 'politics', 0)) t(word, category, severity)
""")
_view("combos", """
SELECT * FROM (VALUES (0, 'idiot', 'trash', 'violence', 'insult and trash'),
  (1, 'moron', 'worthless', 'toxic', 'double insult'),
  (2, 'the', 'token', 'politics', 'words outside the dictionary')) t(ord, w1, w2, label, note)
""")


def _keyword_views(prefix: str, source: str) -> None:
    """Matches, surviving words and verdicts of the texts of a view."""
    _view(f"{prefix}hits", f"""
SELECT content_id, word, category, severity, t,
  (length(t) - length(replace(t, word, ''))) // length(word) AS n
FROM (SELECT content_id, lower(text) AS t FROM {source}) c, v_kw_dict
WHERE contains(t, word)
""")
    _view(f"{prefix}judged", f"""
SELECT content_id, word, category, severity, n, n > coalesce(list_sum(list_transform(
    regexp_extract_all(t, 'idiot\\ of|idiot\\ and|trash\\ idiot|trash\\ the'),
    lambda s: (length(s) - length(replace(s, word, ''))) // length(word))), 0) AS survives,
  CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || word || '([^\\p{{L}}\\p{{N}}_]|$)')
    THEN 'standalone' ELSE 'embedded' END AS context
FROM v_{prefix}hits
""")
    _view(f"{prefix}combo_hit", f"""
SELECT content_id, arg_min(label, ord) AS combo_label, arg_min(note, ord) AS combo_note,
  min(ord) AS ord
FROM (SELECT content_id, lower(text) AS t FROM {source}) c, v_combos
WHERE contains(t, w1) AND contains(t, w2) GROUP BY content_id
""")
    _view(f"{prefix}counted", f"""
SELECT content_id, count(*) AS found, CAST(coalesce(sum(n) FILTER (survives), 0) AS INTEGER) AS n,
  CAST(count(*) FILTER (survives) AS INTEGER) AS words,
  CAST(count(DISTINCT category) FILTER (survives) AS INTEGER) AS cats,
  coalesce(bool_or(context = 'standalone') FILTER (survives), false) AS alone,
  min(severity) FILTER (survives) AS worst
FROM v_{prefix}judged GROUP BY content_id
""")
    _view(f"{prefix}verdict", f"""
SELECT content_id, CASE WHEN combo THEN combo_label WHEN words > 0 THEN
    CASE worst WHEN 0 THEN 'politics' WHEN 1 THEN 'violence' WHEN 2 THEN 'porn'
    WHEN 3 THEN 'gambling' ELSE 'toxic' END END AS label,
  CAST(CASE WHEN combo THEN 1 WHEN n = 0 THEN 0 WHEN alone THEN 1 WHEN n = 1 THEN 0.6
    WHEN cats >= 3 THEN 1 WHEN cats = 2 THEN 0.9 WHEN n >= 3 THEN 0.85 ELSE 0.75 END AS DOUBLE)
    AS confidence,
  n AS n_matches, CASE WHEN combo AND cats = 0 THEN 1 ELSE cats END AS category_count,
  combo OR n >= 2 AS multi_hit, alone AS standalone, whitelisted AS whitelist_hit,
  CASE WHEN combo THEN combo_label END AS combo_label,
  CASE WHEN combo THEN combo_note END AS combo_note, words
FROM (
  SELECT c.content_id, coalesce(k.n, 0) AS n, coalesce(k.words, 0) AS words,
    coalesce(k.cats, 0) AS cats, coalesce(k.alone, false) AS alone, k.worst,
    coalesce(k.found > 0 AND k.words = 0, false) AS whitelisted, combo_label, combo_note,
    combo_label IS NOT NULL AND NOT coalesce(k.found > 0 AND k.words = 0, false) AS combo
  FROM {source} c LEFT JOIN v_{prefix}counted k ON k.content_id = c.content_id
  LEFT JOIN v_{prefix}combo_hit h ON h.content_id = c.content_id)
""")


_keyword_views("", "v_content")
_keyword_views("gw_", "v_gateway_content")

# --- sources --------------------------------------------------------------------------------

_oracle("src_jsonl", "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents")
_oracle("src_csv", r"""
SELECT CAST(doc_id AS VARCHAR) AS id,
  regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text
FROM documents
""")
_oracle("events_recent", """
SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100
""")
_oracle("events_append", """
SELECT ts // 86400 AS day, decision, count(*) AS n FROM v_mod_events GROUP BY 1, 2
""")
_oracle("events_count", "SELECT count(*) AS n FROM events")
_oracle("dict_load", """
SELECT lower(source) AS word, max(lang) AS category FROM documents GROUP BY 1
""")
_oracle("eval_cases", "SELECT text, expected FROM v_cases")
_oracle("eval_label_map", """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END AS by_toxicity,
  CASE WHEN quality + toxic IN (0, 1) THEN 'unsafe' ELSE 'safe' END AS by_class,
  CASE WHEN quality = 1 THEN 'safe' ELSE 'unsafe' END AS by_prompt
FROM labels
""")
_oracle("train_load", """
SELECT content_id, CASE WHEN content_id % 6 IN (3, 4) THEN 1 ELSE 0 END AS label
FROM v_content WHERE content_id % 50 <> 7
""")
_oracle("hash_db_load", """
SELECT hash, max(load_ord) AS load_ord, arg_max(category, load_ord) AS category
FROM (SELECT lower(to_hex(image_hash)) AS hash, image_id AS load_ord, 'category_' || label AS category FROM v_images
  UNION ALL SELECT lower(to_hex(image_hash)), image_id + 10000000, 'again' FROM v_images WHERE image_id % 3 = 0)
GROUP BY hash
""")
_oracle("result_table", """
SELECT content_id, substr(text, 1, 300) AS text, expected, decision,
  round(confidence, 4) AS confidence, tier, path, round(latency_ms, 2) AS latency_ms, reason,
  'decision|final|zero|{"decision":"' || decision || '"}' || chr(10)
    || 'decision|final|zero|{"decision":"' || decision || '"}' AS traces
FROM v_results
""")
_oracle("image_b64", """
SELECT content_id, CASE WHEN content_id % 3 < 2 THEN strlen(text) END AS n_bytes,
  CASE WHEN content_id % 3 < 2 THEN sha256(text) END AS sha FROM v_content
""")

# --- projections ----------------------------------------------------------------------------

_oracle("resolve_text", r"""
SELECT content_id, CASE WHEN NOT regexp_matches(text, '\S') AND image_url IS NOT NULL
  THEN '[Image URL: ' || image_url || ']'
  ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS resolved
FROM v_gateway_content
""")
_oracle("empty_pass", r"""
SELECT content_id, NOT regexp_matches(text, '\S') AS is_blank,
  CASE WHEN NOT regexp_matches(text, '\S') THEN 'L0_empty' END AS tier FROM v_gateway_content
""")
_oracle("route_content", r"""
SELECT content_id, CASE WHEN regexp_matches(text, '\S') OR content_id % 4 = 3 THEN 'text'
    ELSE 'decision' END AS next_step,
  CASE WHEN regexp_matches(text, '\S') AND image_ref IS NOT NULL THEN 'mixed'
    WHEN image_ref IS NOT NULL THEN 'image_only' WHEN regexp_matches(text, '\S') THEN 'text_only'
    ELSE 'empty' END AS content_type
FROM v_gateway_content
""")
_oracle("ocr_append", r"""
SELECT content_id, CASE WHEN content_id % 4 = 3 THEN
    regexp_replace(text || ' [OCR: ' || source || ']', '^\s+|\s+$', '', 'g') ELSE text END AS text
FROM v_gateway_content
""")
_oracle("content_keys", """
SELECT content_id, sha256(text) AS key, 'mod:v1:' || sha256(text) AS shared_key,
  substr(sha256(text), 1, 12) AS sample_id,
  substr(sha256(CASE WHEN lang = 'en' THEN source ELSE text END), 1, 16)
    AS image_ref
FROM v_content
""")
_oracle("decision_label", """
SELECT content_id, CASE WHEN decision = 'pass' THEN 'safe' ELSE 'unsafe' END AS from_decision,
  expected AS from_label, 'safe' AS from_unknown FROM v_results
""")
_view("raw_labels", """
SELECT content_id, lang, text, CASE content_id % 8 WHEN 0 THEN 'toxic' WHEN 1 THEN 'OK'
    WHEN 2 THEN 'H2' WHEN 3 THEN 'S3' WHEN 4 THEN 'obscene' WHEN 5 THEN 'LABEL_1' WHEN 6 THEN 'V'
    ELSE 'insult' END AS raw,
  (content_id * 37 % 101) / CAST(100 AS DOUBLE) AS s37,
  (content_id * 53 % 101) / CAST(100 AS DOUBLE) AS s53,
  (content_id * 29 % 101) / CAST(100 AS DOUBLE) AS s29
FROM v_content
""")
_oracle("label_map", """
SELECT content_id, raw,
  CASE WHEN raw = 'OK' THEN 'safe' WHEN raw <> 'LABEL_1' THEN 'unsafe' END AS label
FROM v_raw_labels
""")
_oracle("score_verdict", """
SELECT content_id, CASE WHEN lang = 'de' OR raw = 'OK' THEN 'safe' WHEN raw <> 'LABEL_1'
    THEN 'unsafe' WHEN greatest(s53, s29) > 0.5 THEN 'unsafe' ELSE 'safe' END AS label,
  CASE WHEN lang = 'de' THEN CAST(1 AS DOUBLE) WHEN raw <> 'LABEL_1' THEN round(s37, 4)
    WHEN greatest(s53, s29) > 0.5 THEN round(greatest(s53, s29), 4)
    ELSE round(1 - greatest(s53, s29), 4) END AS confidence
FROM v_raw_labels
""")
_oracle("softmax_verdict", """
SELECT vec_id, CASE WHEN top > 0.5 THEN 'unsafe' ELSE 'safe' END AS label,
  round(CASE WHEN top > 0.5 THEN top ELSE 1 - top END, 4) AS confidence
FROM (SELECT vec_id, 1 / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS top
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 20) AS l
    FROM embeddings))
""")
_oracle("nsfw_verdict", """
SELECT content_id, CASE WHEN NOT unfit AND s53 > 0.5 THEN 'nsfw' ELSE 'normal' END AS label,
  CASE WHEN unfit THEN CAST(0.5 AS DOUBLE) WHEN s53 > 0.5 THEN round(s53, 4)
    ELSE round(1 - s53, 4) END AS confidence
FROM (SELECT *, length(text) * 1000 > 10485760 OR content_id % 20 < 10 OR content_id % 30 < 10
    AS unfit FROM v_raw_labels)
""")
_oracle("ocr_blocks", """
SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text,
  round(avg((turn * 17 + 3) % 11 / CAST(10 AS DOUBLE)), 4) AS confidence
FROM conversations GROUP BY conv_id
""")
_oracle("is_correct", "SELECT content_id, expected, decision, correct FROM v_graded")
_oracle("result_filter", """
SELECT content_id, tier, decision FROM v_graded
WHERE path = 'cold' AND expected = 'safe' AND correct AND contains(lower(text), 'the ')
""")
_oracle("outcome_split", """
SELECT decision AS outcome, lang, count(*) AS n FROM v_results GROUP BY 1, 2
""")
_oracle("response_format", """
SELECT content_id, CASE WHEN content_id % 5 = 0 THEN 'pass' ELSE decision END AS decision,
  CASE WHEN content_id % 5 = 1 THEN CAST(0 AS DOUBLE) ELSE confidence END AS confidence,
  CASE WHEN content_id % 5 = 2 THEN '' ELSE reason END AS reason,
  CASE WHEN content_id % 5 = 3 THEN 'L3_llm' ELSE tier END AS tier,
  CASE WHEN content_id % 5 = 4 THEN 'cold' ELSE path END AS path
FROM v_results
""")
_oracle("audit_prompt", """
SELECT content_id, 'Text to moderate:' || chr(10) || '```' || chr(10) || text || chr(10) || '```'
  || CASE WHEN lang = 'en' THEN chr(10) || chr(10) || 'Additional context:' || chr(10)
    || '{"source":"' || source || '"}' ELSE '' END AS prompt
FROM v_content
""")
_oracle("trace_steps", """
SELECT content_id, 'decision' AS node, 'final' AS step, substr(text, 1, 200) AS input,
  '{"decision":"' || decision || '"}' AS output, 'zero' AS cost
FROM v_results
""")

# --- text matching --------------------------------------------------------------------------

_oracle("kw_match", """
SELECT content_id, word, category, CAST(n AS INTEGER) AS n FROM v_hits
""")
_view("large_dictionary", """
SELECT w, CASE (row_number() OVER (ORDER BY md5(w)) - 1) % 5 WHEN 0 THEN 'politics' WHEN 1 THEN 'violence'
  WHEN 2 THEN 'porn' WHEN 3 THEN 'gambling' ELSE 'toxic' END AS category
FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,8}')) AS w FROM documents)
ORDER BY md5(w) LIMIT 2000
""")
# A word of a-z lies within one run of such letters; runs are few, so their words are found once.
_view("letter_runs", """
SELECT doc_id, run, count(*) AS times
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS run FROM documents) GROUP BY doc_id, run
""")
_view("words_of_runs", """
SELECT run, w, category, len(list_filter(range(1, length(run) + 1), lambda i: substr(run, i, length(w)) = w)) AS n
FROM (SELECT DISTINCT run FROM v_letter_runs) JOIN v_large_dictionary ON contains(run, w)
""")
_oracle("kw_match_many", """
SELECT doc_id AS content_id, w AS word, category, CAST(sum(times * n) AS INTEGER) AS n
FROM v_letter_runs r JOIN v_words_of_runs x ON x.run = r.run GROUP BY doc_id, w, category
""")
_oracle("kw_match_distinct", """
SELECT content_id, words AS n_matches, category_count, CAST(CASE
    WHEN combo_label IS NOT NULL THEN 1 WHEN words = 0 THEN 0 WHEN standalone THEN 1
    WHEN words = 1 THEN 0.6 WHEN category_count >= 3 THEN 1 WHEN category_count = 2 THEN 0.9
    WHEN words >= 3 THEN 0.85 ELSE 0.75 END AS DOUBLE) AS confidence
FROM v_verdict
""")
_oracle("kw_whitelist", "SELECT content_id, word, survives FROM v_judged")
_oracle("kw_context", "SELECT content_id, word, context FROM v_judged WHERE survives")
_oracle("kw_positions", """
SELECT content_id, CAST(unnest(list_filter(range(1, length(t) + 1),
  lambda i: substr(t, i, 5) = 'idiot')) AS INTEGER) AS position
FROM (SELECT content_id, lower(text) AS t FROM v_content WHERE contains(lower(text), 'idiot'))
""")
_oracle("cjk_flag", r"""
SELECT lang, regexp_matches(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}]')
  AS has_cjk, count(*) AS n FROM v_content GROUP BY 1, 2
""")
_oracle("kw_severity", """
SELECT content_id, label FROM v_verdict WHERE words > 0 AND combo_label IS NULL
""")
_oracle("kw_combo", """
SELECT content_id, ord, combo_label AS label, combo_note AS note FROM v_combo_hit
""")
_oracle("kw_confidence", """
SELECT content_id, n_matches, category_count, standalone, confidence FROM v_verdict
WHERE combo_label IS NULL
""")
_oracle("kw_verdict", """
SELECT content_id, label, confidence, n_matches, category_count, multi_hit, whitelist_hit,
  combo_label, combo_note FROM v_verdict
""")
_view("audit_bodies", """
SELECT content_id, audit_label, '{"label": "' || coalesce(audit_label, 'none')
  || '", "confidence": ' || CAST(coalesce(audit_confidence, CAST(7 AS DOUBLE)) AS VARCHAR)
  || CASE WHEN content_id % 5 = 0 THEN '' ELSE ', "reason": "' || coalesce(audit_reason, '') || '"'
    END || '}' AS body,
  coalesce(audit_label, 'none') AS label,
  coalesce(audit_confidence, CAST(7 AS DOUBLE)) AS confidence,
  CASE WHEN content_id % 5 = 0 THEN '' ELSE coalesce(audit_reason, '') END AS reason
FROM v_signals
""")
_view("audit_answers", """
SELECT content_id, CASE content_id % 4 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
  WHEN 2 THEN 'The answer is ' || body || ' as asked.'
  ELSE 'I think this is ' || coalesce(audit_label, 'fine') || ' content' END AS raw
FROM (SELECT *, '{"label": "' || coalesce(audit_label, 'none') || '", "confidence": '
    || CAST(coalesce(audit_confidence, 7) AS VARCHAR) || CASE WHEN content_id % 5 = 0 THEN ''
    ELSE ', "reason": "' || coalesce(audit_reason, '') || '"' END || '}' AS body FROM v_signals)
""")
_view("audit_objects", r"""
SELECT content_id, raw, CASE WHEN direct THEN raw WHEN fenced THEN fence WHEN braced THEN braces END AS obj,
  CASE WHEN direct THEN 'direct' WHEN fenced THEN 'fenced' WHEN braced THEN 'braces' ELSE 'heuristic' END AS parsed_as
FROM (SELECT *, starts_with(ltrim(raw), '{') AND json_valid(raw) AS direct,
    starts_with(ltrim(fence), '{') AND json_valid(fence) AS fenced, braces <> '' AND json_valid(braces) AS braced
  FROM (SELECT *, regexp_extract(raw, '(?s)```(?:json)?\s*\n?(.*?)\n?```', 1) AS fence,
      regexp_extract(raw, '(?s)\{.*\}', 0) AS braces FROM v_audit_answers))
""")
_oracle("audit_parse", f"""
SELECT content_id, CASE WHEN obj IS NOT NULL THEN coalesce(json_extract_string(obj, '$.label'), 'safe')
    WHEN regexp_matches(lower(raw), '{"|".join(AUDIT_UNSAFE_WORDS)}') THEN 'unsafe' ELSE 'safe' END AS label,
  CASE WHEN obj IS NULL THEN CAST(0.5 AS DOUBLE)
    ELSE coalesce(CAST(json_extract_string(obj, '$.confidence') AS DOUBLE), 0.8) END AS confidence,
  CASE WHEN obj IS NULL THEN 'JSON parse failed, heuristic fallback. Raw: ' || substr(raw, 1, 200)
    ELSE coalesce(json_extract_string(obj, '$.reason'), '') END AS reason, parsed_as
FROM v_audit_objects
""")
_view("guard_answers", """
SELECT content_id, CASE content_id % 5 WHEN 0 THEN 'Safety: Unsafe' || chr(10) || 'Categories: PII, Violent ' || source
  WHEN 1 THEN 'safety:  SAFE' || chr(10) || 'Categories: None'
  WHEN 2 THEN 'Safety: Controversial' || chr(10) || 'Categories: Jailbreak'
  WHEN 3 THEN 'this is unsafe ' || source ELSE 'it is ' || lang END AS answer
FROM v_content
""")
_oracle("guard_parse", rf"""
SELECT content_id, safety, CASE WHEN safety IN ('unsafe', 'controversial')
    OR (safety IS NULL AND contains(lower(answer), 'unsafe')) THEN 'unsafe' ELSE 'safe' END AS label,
  CAST(CASE WHEN safety IN ('safe', 'unsafe') THEN 0.99 WHEN safety = 'controversial' OR contains(lower(answer), 'safe')
    THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence,
  'Qwen3Guard: ' || coalesce(safety, 'unknown') || CASE WHEN listed <> '' THEN ' — ' || listed ELSE '' END AS reason
FROM (SELECT *, nullif(lower(regexp_extract(answer, '(?i)Safety:\s*(Safe|Unsafe|Controversial)', 1)), '') AS safety,
    array_to_string(list_filter(regexp_extract_all(answer, '({"|".join(re.escape(c).replace(chr(92) + " ", " ") for c in GUARD_CATEGORIES)})'),
      lambda c: c <> 'None'), ', ') AS listed FROM v_guard_answers)
""")
_oracle("match_ratio", """
SELECT content_id, round(CASE WHEN content_id % 9 = 0 THEN 0 ELSE
  (length(want) - length(regexp_replace(want, '[' || source || ']', '', 'g')))
  / CAST(length(want) AS DOUBLE) END, 6) AS ratio
FROM (SELECT *, lower(replace(text, ' ', '')) AS want FROM v_content)
""")
_oracle("audit_validate", f"""
SELECT content_id, problems = '' AS valid, problems FROM (
  SELECT content_id, CASE WHEN obj IS NULL THEN 'not an object'
    ELSE concat_ws(', ',
      CASE WHEN json_extract_string(obj, '$.label') IS NULL THEN 'label missing' END,
      CASE WHEN json_extract_string(obj, '$.label') NOT IN ({", ".join(f"'{x}'" for x in AUDIT_LABELS)}) THEN 'label unknown' END,
      CASE WHEN json_extract_string(obj, '$.confidence') IS NULL THEN 'confidence missing' END,
      CASE WHEN CAST(json_extract_string(obj, '$.confidence') AS DOUBLE) NOT BETWEEN 0 AND 1
        THEN 'confidence out of range' END,
      CASE WHEN json_extract_string(obj, '$.reason') IS NULL THEN 'reason missing' END) END AS problems
  FROM (SELECT content_id, CASE WHEN parsed_as = 'direct' THEN obj END AS obj FROM v_audit_objects))
""")

# --- reuse ----------------------------------------------------------------------------------


def _as_of(requests: str, ttl: int) -> str:
    return f"""
SELECT r.content_id, arg_max(d, struct_pack(a := d.decided_at, o := d.entry_ord)) AS e
FROM {requests} r JOIN v_decisions d ON d.key = r.key AND d.decided_at <= r.ts
  AND r.ts < d.decided_at + {ttl}
GROUP BY r.content_id
"""


_view("local_hit", _as_of("v_requests", 3600))
_view("shared_hit", _as_of("v_requests", 7200))
_oracle("reuse_exact", """
SELECT r.content_id, l.e IS NOT NULL AS hit, l.e.decided_at, l.e.decision, l.e.confidence,
  l.e.reason, l.e.tier
FROM v_requests r LEFT JOIN v_local_hit l ON l.content_id = r.content_id
""")
_oracle("reuse_two_tier", """
SELECT r.content_id, CASE WHEN l.e IS NOT NULL THEN 'local' WHEN s.e IS NOT NULL THEN 'shared' END
  AS store, coalesce(l.e, s.e).decided_at AS decided_at, coalesce(l.e, s.e).decision AS decision,
  coalesce(l.e, s.e).confidence AS confidence, coalesce(l.e, s.e).reason AS reason,
  coalesce(l.e, s.e).tier AS tier
FROM v_requests r LEFT JOIN v_local_hit l ON l.content_id = r.content_id
LEFT JOIN v_shared_hit s ON s.content_id = r.content_id
""")
_oracle("reuse_image", """
SELECT g.content_id, coalesce(h.decision, f.decision) AS decision,
  coalesce(h.confidence, f.confidence) AS confidence, coalesce(h.reason, f.reason) AS reason
FROM v_gateway_content g LEFT JOIN v_hash_store h ON h.image_hash = g.image_hash
LEFT JOIN v_ref_store f ON f.image_ref = g.image_ref
WHERE g.image_ref IS NOT NULL
""")
_view("known_match", """
SELECT i.image_hash, arg_min(k, k.known_ord) AS k
FROM (SELECT DISTINCT image_hash FROM v_images) i
JOIN v_known k ON bit_count(xor(i.image_hash, k.known_hash)) <= 10 GROUP BY 1
""")
_oracle("hash_known", """
SELECT i.image_id, m.k.known_hash AS known_hash,
  CAST(bit_count(xor(i.image_hash, m.k.known_hash)) AS INTEGER) AS distance,
  m.k.category AS category
FROM v_images i LEFT JOIN v_known_match m ON m.image_hash = i.image_hash
""")
_oracle("hash_near", """
SELECT i.image_id, m.k.known_ord AS known_ord, CAST(m.k.d AS INTEGER) AS distance
FROM v_images i LEFT JOIN (
  SELECT i.image_id, min(struct_pack(d := bit_count(xor(i.image_hash, k.known_hash)),
    known_ord := k.known_ord)) AS k
  FROM v_images i JOIN v_known k ON bit_count(xor(i.image_hash, k.known_hash)) <= 15
  GROUP BY 1) m ON m.image_id = i.image_id
""")
_view("originals", """
SELECT label, min(image_id) AS image_id, arg_min(image_hash, image_id) AS image_hash
FROM v_images GROUP BY label
""")
_oracle("hash_pairs", """
SELECT pairs, count(*) AS n, CAST(min(d) AS INTEGER) AS min_distance,
  CAST(max(d) AS INTEGER) AS max_distance, round(avg(d), 4) AS avg_distance
FROM (
  SELECT 'similar' AS pairs, bit_count(xor(i.image_hash, o.image_hash)) AS d
  FROM v_images i JOIN v_originals o ON o.label = i.label AND o.image_id <> i.image_id
  UNION ALL
  SELECT 'different', bit_count(xor(a.image_hash, b.image_hash))
  FROM v_originals a JOIN v_originals b ON a.label < b.label)
GROUP BY pairs
""")
_oracle("hash_sweep", """
SELECT CAST(t AS INTEGER) AS threshold,
  count(*) FILTER (own AND d <= t) AS recovered,
  count(*) FILTER (NOT own AND d <= t) AS false_matches,
  round(count(*) FILTER (own AND d <= t) / CAST(count(*) FILTER (own) AS DOUBLE), 4)
    AS recovery_rate,
  round(count(*) FILTER (NOT own AND d <= t) / CAST(count(*) FILTER (NOT own) AS DOUBLE), 4)
    AS false_match_rate
FROM (SELECT true AS own, bit_count(xor(i.image_hash, o.image_hash)) AS d
  FROM v_images i JOIN v_originals o ON o.label = i.label AND o.image_id <> i.image_id
  UNION ALL
  SELECT false, bit_count(xor(a.image_hash, b.image_hash))
  FROM v_originals a JOIN v_originals b ON a.label < b.label),
  (VALUES (2), (5), (8), (10), (12), (15), (20)) x(t)
GROUP BY t
""")
_oracle("key_collisions", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(contents) AS BIGINT) AS distinct_contents,
  count(*) AS distinct_keys, CAST(sum(contents - 1) AS BIGINT) AS collisions
FROM (SELECT substr(sha256(text), 1, 4) AS k, count(*) AS n, count(DISTINCT text) AS contents
  FROM documents GROUP BY 1)
""")
_oracle("reuse_potential", """
SELECT count(*) AS requests, count(*) - count(DISTINCT key) AS hits,
  count(DISTINCT key) AS misses,
  round((count(*) - count(DISTINCT key)) / CAST(count(*) AS DOUBLE), 4) AS hit_rate
FROM v_requests
""")
_view("vec", """
SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
""")
_view("near", """
SELECT q.vec_id AS query_id, max(struct_pack(
  s := (1 + list_cosine_similarity(q.e, s.e)) / 2, o := -s.vec_id)) AS b
FROM v_vec q JOIN v_vec s ON s.vec_id < q.vec_id
WHERE (1 + list_cosine_similarity(q.e, s.e)) / 2 >= 0.7 GROUP BY 1
""")
_oracle("reuse_semantic", """
SELECT q.vec_id AS query_id, -n.b.o AS entry_id, round(n.b.s, 6) AS similarity, v.decision, v.reason
FROM embeddings q LEFT JOIN v_near n ON n.query_id = q.vec_id
LEFT JOIN v_vectors v ON v.entry_id = -n.b.o
""")
_view("raised", """
SELECT vec_id AS query_id, list_transform(embedding, lambda x, i:
  CAST(x AS DOUBLE) * CASE WHEN (i - 1 + vec_id) % 3 = 0 THEN 1.25 ELSE 1 END) AS e FROM embeddings
""")
_view("near_raised", """
SELECT query_id, max(struct_pack(s := (1 + list_cosine_similarity(q.e, v.e)) / 2, o := -v.vec_id)) AS b
FROM v_raised q JOIN v_vec v ON (1 + list_cosine_similarity(q.e, v.e)) / 2 >= 0.95 GROUP BY 1
""")
_oracle("reuse_semantic_near", """
SELECT q.query_id, -n.b.o AS entry_id, round(n.b.s, 6) AS similarity, v.decision, v.reason
FROM v_raised q LEFT JOIN v_near_raised n ON n.query_id = q.query_id
LEFT JOIN v_vectors v ON v.entry_id = -n.b.o
""")
_oracle("batch_semantic", """
SELECT q.vec_id AS query_id, -max(struct_pack(s := (1 + list_cosine_similarity(q.e, s.e)) / 2,
    o := -s.vec_id)).o AS entry_id,
  round(max((1 + list_cosine_similarity(q.e, s.e)) / 2), 6) AS similarity
FROM v_vec q JOIN v_vec s ON s.vec_id < q.vec_id
WHERE (1 + list_cosine_similarity(q.e, s.e)) / 2 >= 0.7
  AND q.vec_id IN (SELECT min(content_id) FROM v_gateway_content WHERE embedding IS NOT NULL
    GROUP BY text)
  AND s.vec_id IN (SELECT min(content_id) FROM v_gateway_content WHERE embedding IS NOT NULL
    GROUP BY text)
GROUP BY 1
""")
_oracle("cosine", """
SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine,
  round((1 + list_cosine_similarity(a.e, b.e)) / 2, 6) AS similarity, CAST(1 AS DOUBLE) AS norm
FROM v_vec a JOIN v_vec b ON b.vec_id = a.vec_id + 1
""")
_oracle("score_named", """
SELECT content_id, sha256(text) AS key, CASE WHEN regexp_matches(text, '\\S') THEN length(l) END AS n_letters,
  CASE WHEN regexp_matches(text, '\\S') THEN round(length(b) / CAST(greatest(length(l), 1) AS DOUBLE), 6) END AS share
FROM (SELECT content_id, text, regexp_replace(text, '[^A-Za-z]', '', 'g') AS l,
  regexp_replace(text, '[^A-Z]', '', 'g') AS b FROM v_content)
""")
_oracle("dhash", """
SELECT image_id, image_hash, lpad(lower(to_hex(image_hash)), 14, '0') AS hex FROM v_images
""")
# A cosine transform of 32 x 32 points, of which the image of 8 x 8 repeats each four times.
_view("cosines", """
SELECT u, k, sqrt(2 / CAST(32 AS DOUBLE)) * CASE WHEN u = 0 THEN 1 / sqrt(CAST(2 AS DOUBLE)) ELSE 1 END
  * sum(cos((2 * (4 * k + i) + 1) * u * pi() / 64)) AS w
FROM (SELECT unnest(range(8)) AS u) a, (SELECT unnest(range(8)) AS k) b, (SELECT unnest(range(4)) AS i) c
GROUP BY u, k
""")
_view("frequencies", """
SELECT vec_id, r.u AS u, c.u AS v, sum(x * r.w * c.w) AS f
FROM (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e
JOIN v_cosines r ON r.k = e.i // 8 JOIN v_cosines c ON c.k = e.i % 8 GROUP BY vec_id, r.u, c.u
""")
_oracle("phash", """
SELECT vec_id, string_agg(digit, '' ORDER BY g) AS phash
FROM (SELECT vec_id, g, substr('0123456789abcdef', CAST(sum(bit) AS INTEGER) + 1, 1) AS digit
  FROM (SELECT f.vec_id, (u * 8 + v) // 4 AS g, CASE WHEN f > m THEN CASE (u * 8 + v) % 4 WHEN 0 THEN 8
      WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END ELSE 0 END AS bit
    FROM v_frequencies f JOIN (SELECT vec_id, median(f) AS m FROM v_frequencies GROUP BY vec_id) q
    ON q.vec_id = f.vec_id) GROUP BY vec_id, g)
GROUP BY vec_id
""")
_oracle("hamming", """
SELECT a.image_id, CAST(bit_count(xor(a.image_hash, b.image_hash)) AS INTEGER) AS distance,
  CASE WHEN b.image_id % 5 = 0 THEN 999
    ELSE CAST(bit_count(xor(a.image_hash, b.image_hash)) AS INTEGER) END AS hex_distance
FROM v_images a JOIN v_images b ON b.image_id = a.image_id + 1
""")
_oracle("embed_texts", r"""
SELECT content_id, 512 AS size, CAST(CASE WHEN regexp_matches(text, '\S') THEN 1 ELSE 0 END
  AS DOUBLE) AS norm FROM v_gateway_content
""")
_oracle("vector_upsert", """
SELECT key, max(version) AS version, arg_max(decision, version) AS decision FROM (
  SELECT reason || '/' || (entry_id % 20) AS key, entry_id AS version, decision FROM v_vectors
  UNION ALL
  SELECT reason || '/' || (entry_id % 20), entry_id + 100000, 'review' FROM v_vectors
  WHERE entry_id % 3 = 0)
WHERE key NOT LIKE 'like label 9/%' GROUP BY key
""")
_oracle("cache_stats", """
SELECT (SELECT count(DISTINCT key) FROM v_decisions) AS entries, count(l.e) AS hits,
  count(*) - count(l.e) AS misses, round(count(l.e) / CAST(count(*) AS DOUBLE), 4) AS hit_rate
FROM v_requests r LEFT JOIN v_local_hit l ON l.content_id = r.content_id
""")
_oracle("latest_state", """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
  arg_max(value, event_id) AS value
FROM events GROUP BY user_id
""")
_oracle("batch_dedup", """
SELECT content_id, min(content_id) OVER (PARTITION BY text) AS first_id,
  min(content_id) OVER (PARTITION BY text) <> content_id AS is_copy
FROM v_content
""")

# --- gateway, funnel, decision ----------------------------------------------------------------

_view("gw_requests", "SELECT content_id, sha256(text) AS key, ts FROM v_gateway_content")
_view("gw_local", _as_of("v_gw_requests", 3600))
_view("gw_shared", _as_of("v_gw_requests", 7200))
_view("gw_early", r"""
SELECT g.content_id, g.text, g.image_hash IS NOT NULL AS hashed,
  g.image_ref IS NOT NULL AS img, regexp_matches(g.text, '\S') AS has_text,
  m.k.category AS category, h AS h, f AS f, l.e AS l, s.e AS s, k.label, k.confidence AS kc,
  CASE WHEN g.image_ref IS NOT NULL THEN
      CASE WHEN m.k IS NOT NULL THEN 'known_hash' WHEN h.decision IS NOT NULL THEN 'image_hash'
        WHEN f.decision IS NOT NULL THEN 'image_ref' ELSE 'escalated' END
    WHEN NOT regexp_matches(g.text, '\S') THEN 'empty'
    WHEN l.e IS NOT NULL THEN 'memory' WHEN s.e IS NOT NULL THEN 'shared'
    WHEN k.whitelist_hit THEN 'whitelist' WHEN k.confidence > 0.99 THEN 'keyword'
    WHEN k.confidence >= 0.4 THEN 'ambiguous' WHEN n.b IS NOT NULL THEN 'semantic'
    ELSE 'escalated' END AS resolved_by,
  -n.b.o AS near_id
FROM v_gateway_content g
LEFT JOIN v_known_match m ON m.image_hash = g.image_hash
LEFT JOIN v_hash_store h ON h.image_hash = g.image_hash
LEFT JOIN v_ref_store f ON f.image_ref = g.image_ref
LEFT JOIN v_gw_local l ON l.content_id = g.content_id
LEFT JOIN v_gw_shared s ON s.content_id = g.content_id
LEFT JOIN v_gw_verdict k ON k.content_id = g.content_id
LEFT JOIN v_near n ON n.query_id = g.content_id
""")


def _pick(column: str, known: str, empty: str, whitelist: str, keyword: str) -> str:
    return f"""CASE resolved_by WHEN 'known_hash' THEN {known} WHEN 'image_hash' THEN h.{column}
    WHEN 'image_ref' THEN f.{column} WHEN 'empty' THEN {empty} WHEN 'memory' THEN l.{column}
    WHEN 'shared' THEN s.{column} WHEN 'whitelist' THEN {whitelist} WHEN 'keyword' THEN {keyword}
    WHEN 'semantic' THEN v.{column} END AS {column}"""


_ONE = "CAST(1 AS DOUBLE)"
_view("gw", f"""
SELECT content_id, text, img, hashed, has_text, resolved_by, g.label AS kw_label, kc,
  {_pick("decision", "'block'", "'pass'", "'pass'", "'block'")},
  {_pick("confidence", _ONE, _ONE, _ONE, _ONE)},
  {_pick("reason", "'Perceptual hash match: ' || category", "'empty content'",
         "'Whitelist match — known false positive phrase'",
         "'Hot-path keyword match: ' || g.label")},
  {_pick("tier", "'L0_phash'", "'L0_empty'", "'L0_whitelist'", "'L1_keyword'")},
  resolved_by IN ('whitelist', 'keyword', 'semantic', 'ambiguous')
    OR (resolved_by = 'escalated' AND NOT img) AS keyword_prefiltered,
  CASE WHEN resolved_by IN ('keyword', 'ambiguous') THEN g.label END AS keyword_label,
  CASE WHEN resolved_by IN ('keyword', 'ambiguous') THEN kc ELSE CAST(0 AS DOUBLE) END
    AS keyword_confidence
FROM v_gw_early g LEFT JOIN v_vectors v ON v.entry_id = g.near_id AND g.resolved_by = 'semantic'
""")
_oracle("gateway", """
SELECT content_id, resolved_by, decision, confidence, reason, tier, keyword_prefiltered,
  keyword_label, keyword_confidence FROM v_gw
""")


def _rate(*stages: str) -> str:
    names = ", ".join(f"'{s}'" for s in stages)
    return f"round(count(*) FILTER (resolved_by IN ({names})) / CAST(count(*) AS DOUBLE), 4)"


_HITS = ("image_hash", "image_ref", "memory", "shared", "keyword", "known_hash", "whitelist", "semantic")
_oracle("gateway_stats", f"""
SELECT count(*) AS total_requests, {_rate("image_hash", "image_ref")} AS image_cache_hit_rate,
  {_rate("memory")} AS memory_cache_hit_rate, {_rate("shared")} AS redis_cache_hit_rate,
  {_rate("keyword", "known_hash")} AS keyword_hit_rate,
  {_rate("whitelist")} AS whitelist_hit_rate, {_rate("semantic")} AS chroma_cache_hit_rate,
  {_rate(*_HITS)} AS hot_path_rate, {_rate("escalated")} AS escalated_rate,
  count(*) FILTER (resolved_by IN ({", ".join(f"'{s}'" for s in _HITS)}))
    AS cold_path_calls_saved
FROM v_gw
""")
_oracle("traffic_split", """
SELECT CASE WHEN img THEN 'image' ELSE 'text' END AS kind, CASE WHEN decision IS NULL
    THEN 'cold_escalated' WHEN decision = 'block' THEN 'hot_block' ELSE 'hot_pass' END AS outcome,
  count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM v_gw) AS DOUBLE), 4) AS share
FROM v_gw GROUP BY 1, 2
""")
_view("steps", """
SELECT content_id, CASE WHEN img THEN
    CASE resolved_by WHEN 'known_hash' THEN 'image_phash_block' WHEN 'image_hash'
      THEN 'image_phash_cache' ELSE (CASE WHEN hashed THEN 'image_phash_ok' ELSE 'image_no_bytes'
      END) || '>' || CASE WHEN resolved_by = 'image_ref' THEN 'image_url_cache_hit'
      ELSE 'image_escalate' END END
  WHEN resolved_by = 'empty' THEN NULL
  WHEN resolved_by = 'memory' THEN 'L0_memory_hit'
  WHEN resolved_by = 'shared' THEN 'L0_memory_miss>L0b_redis_hit'
  ELSE 'L0_memory_miss>L0b_redis_miss>' || CASE resolved_by WHEN 'whitelist' THEN 'whitelist_pass'
    WHEN 'keyword' THEN 'keyword_block' WHEN 'ambiguous' THEN 'keyword_ambiguous'
    WHEN 'semantic' THEN 'keyword_miss>L1_chroma_hit' ELSE 'keyword_miss>L1_chroma_miss' END
  END AS s
FROM v_gw
""")
_oracle("trace_concat", """
SELECT content_id, CAST(len(string_split(concat_ws('>', s, 'final'), '>')) AS INTEGER) AS n_steps,
  concat_ws('>', s, 'final') AS steps
FROM v_steps
""")
_oracle("skip_audit", """
SELECT content_id, score_confidence >= 0.95 AS skips, score_confidence < 0.4 AS unsure
FROM v_signals
""")


def _funnel_view(name: str, rows: str, keyword: str, blank: str) -> None:
    _view(name, f"""
SELECT * EXCLUDE (p_label, p_conf, stage), CASE stage WHEN 0 THEN 'safe' WHEN 1 THEN {keyword}
    WHEN 3 THEN audit_label ELSE p_label END AS f_label,
  CASE stage WHEN 0 THEN {_ONE} WHEN 1 THEN kc WHEN 3 THEN audit_confidence ELSE p_conf END
    AS f_conf,
  CASE stage WHEN 3 THEN audit_reason WHEN 4 THEN 'LLM timeout, using BERT result' END AS f_reason,
  CASE stage WHEN 0 THEN 'L0_empty' WHEN 1 THEN 'L1_keyword' WHEN 2 THEN 'L2_bert'
    ELSE 'L3_llm' END AS f_tier,
  CASE stage WHEN 0 THEN 'zero' WHEN 1 THEN 'zero' WHEN 2 THEN 'low' ELSE 'high' END AS f_cost,
  CASE WHEN stage >= 3 THEN p_label END AS f_preliminary
FROM (SELECT *, CASE WHEN {blank} THEN 0 WHEN sure THEN 1 WHEN p_conf >= 0.95 THEN 2
    WHEN audit_label IS NOT NULL THEN 3 ELSE 4 END AS stage
  FROM (SELECT *, CASE WHEN score_confidence < 0.95 AND second_confidence >= 0.95
      THEN second_label ELSE score_label END AS p_label,
    CASE WHEN score_confidence < 0.95 AND second_confidence >= 0.95
      THEN second_confidence ELSE score_confidence END AS p_conf
    FROM ({rows})))
""")


_funnel_view("funnel", """
SELECT s.*, k.label AS kw_label, k.confidence AS kc, k.confidence > 0.99 AS sure
FROM v_signals s JOIN v_verdict k ON k.content_id = s.content_id
""", "kw_label", "false")
_oracle("text_funnel", """
SELECT content_id, f_label AS label, f_conf AS confidence, f_reason AS reason, f_tier AS tier,
  f_cost AS cost, f_preliminary AS preliminary
FROM v_funnel
""")

_SEVERITY = """CASE {0} WHEN 'safe' THEN 0.0 WHEN 'normal' THEN 0.0 WHEN 'spam' THEN 0.3
  WHEN 'toxic' THEN 0.5 WHEN 'gambling' THEN 0.6 WHEN 'porn' THEN 0.8 WHEN 'nsfw' THEN 0.85
  WHEN 'violence' THEN 0.9 WHEN 'politics' THEN 1.0 WHEN 'unsafe' THEN 0.7 END::DOUBLE"""


def _decide_views(prefix: str, rows: str, placeholder: bool) -> None:
    """Score, label and ruling over rows with the signal and override columns."""
    label = "coalesce(image_label, 'normal')" if placeholder else "image_label"
    conf = (
        "CASE WHEN image_label IS NULL THEN CAST(1 AS DOUBLE) ELSE image_confidence END"
        if placeholder
        else "image_confidence"
    )
    w = "CAST(0.4 AS DOUBLE) / (CAST(0.4 AS DOUBLE) + CAST(0.35 AS DOUBLE))"
    u = "CAST(0.35 AS DOUBLE) / (CAST(0.4 AS DOUBLE) + CAST(0.35 AS DOUBLE))"
    _view(f"{prefix}score", f"""
SELECT *, CASE WHEN text_label IS NOT NULL AND i_label IS NOT NULL
    THEN ts_ * ({w}) + is_ * ({u})
    WHEN text_label IS NOT NULL THEN ts_ WHEN i_label IS NOT NULL THEN is_
    ELSE CAST(0 AS DOUBLE) END AS score,
  least(CAST(1 AS DOUBLE), CASE WHEN text_label IS NOT NULL THEN text_confidence END,
    CASE WHEN i_label IS NOT NULL THEN i_conf END) AS agg_confidence
FROM (SELECT *, {_SEVERITY.format("text_label")} * text_confidence AS ts_,
    {_SEVERITY.format("i_label")} * i_conf AS is_
  FROM (SELECT *, {label} AS i_label, {conf} AS i_conf FROM ({rows})))
""")
    _view(f"{prefix}scored", f"""
SELECT *, CASE WHEN score >= 0.85 THEN 'politics' WHEN score >= 0.65 THEN 'porn'
  WHEN score >= 0.45 THEN 'gambling' WHEN score >= 0.25 THEN 'toxic' WHEN score >= 0.1 THEN 'spam'
  ELSE 'safe' END AS agg_label FROM v_{prefix}score
""")
    has_image = "true" if placeholder else "image_label IS NOT NULL"
    _view(f"{prefix}ruled", f"""
SELECT * EXCLUDE (rule_), CASE rule_ WHEN 'cache_reuse' THEN cached_decision
    WHEN 'zero_tolerance_keyword' THEN 'block' WHEN 'keyword_high_conf' THEN 'block'
    WHEN 'image_nsfw' THEN 'block' WHEN 'zero_tolerance' THEN 'block' WHEN 'block' THEN 'block'
    WHEN 'grey_zone' THEN 'review' ELSE 'pass' END AS decision,
  CASE rule_ WHEN 'cache_reuse' THEN cached_confidence WHEN 'zero_tolerance_keyword'
    THEN CAST(1 AS DOUBLE) WHEN 'keyword_high_conf' THEN CAST(1 AS DOUBLE)
    WHEN 'image_nsfw' THEN image_confidence
    WHEN 'image_normal' THEN coalesce(image_confidence, CAST(1 AS DOUBLE))
    WHEN 'fallback' THEN CAST(0.5 AS DOUBLE) ELSE agg_confidence END AS confidence,
  CASE rule_ WHEN 'cache_reuse' THEN coalesce(cached_reason, 'Cache hit')
    WHEN 'zero_tolerance_keyword' THEN 'Zero-tolerance policy'
    WHEN 'keyword_high_conf' THEN 'High-confidence keyword match: ' || keyword_label
    WHEN 'image_nsfw' THEN 'Image NSFW detected (conf=' || printf('%.2f', image_confidence) || ')'
    WHEN 'image_normal' THEN 'Image appears normal'
    WHEN 'fallback' THEN 'No text moderation result'
    WHEN 'zero_tolerance' THEN coalesce(text_reason, 'Zero-tolerance: ' || agg_label)
    WHEN 'safe' THEN coalesce(text_reason, 'Content classified as safe')
    WHEN 'grey_zone' THEN coalesce(text_reason, 'Grey zone — needs human review')
    WHEN 'low_confidence_pass' THEN 'Low confidence (' || printf('%.2f', agg_confidence)
      || ') — passing to avoid false positive'
    ELSE coalesce(text_reason, 'Classified as: ' || agg_label) END AS reason,
  rule_ AS rule
FROM (SELECT *, CASE WHEN cached_decision IS NOT NULL THEN 'cache_reuse'
    WHEN keyword_confidence > 0.99 AND list_contains(zero, keyword_label)
      THEN 'zero_tolerance_keyword'
    WHEN keyword_confidence > 0.99 THEN 'keyword_high_conf'
    WHEN text_label IS NULL AND {has_image} AND image_label = 'nsfw' AND image_confidence > 0.5
      THEN 'image_nsfw'
    WHEN text_label IS NULL AND {has_image} THEN 'image_normal'
    WHEN text_label IS NULL THEN 'fallback'
    WHEN list_contains(zero, agg_label) THEN 'zero_tolerance'
    WHEN agg_label = 'safe' THEN 'safe'
    WHEN agg_confidence BETWEEN low AND high THEN 'grey_zone'
    WHEN agg_confidence < low THEN 'low_confidence_pass' ELSE 'block' END AS rule_
  FROM v_{prefix}scored)
""")


_ZERO = "['politics', 'violence'] AS zero, CAST(0.3 AS DOUBLE) AS low, CAST(0.7 AS DOUBLE) AS high"
_view("inputs", f"""
SELECT content_id, audit_label AS text_label, audit_confidence AS text_confidence,
  audit_reason AS text_reason, image_label, image_confidence, {_ZERO},
  CASE WHEN content_id % 10 = 9 THEN 'review' END AS cached_decision,
  CASE WHEN content_id % 10 = 9 THEN CAST(0.8 AS DOUBLE) END AS cached_confidence,
  CASE WHEN content_id % 20 = 9 THEN 'seen before' END AS cached_reason,
  CASE content_id % 12 WHEN 5 THEN 'politics' WHEN 7 THEN 'toxic' END AS keyword_label,
  CASE WHEN content_id % 12 IN (5, 7) THEN CAST(1 AS DOUBLE) WHEN content_id % 12 = 3
    THEN CAST(0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS keyword_confidence
FROM v_signals
""")
_NO_OVERRIDES = """CAST(NULL AS VARCHAR) AS cached_decision,
  CAST(NULL AS DOUBLE) AS cached_confidence, CAST(NULL AS VARCHAR) AS cached_reason,
  CAST(NULL AS VARCHAR) AS keyword_label, CAST(0 AS DOUBLE) AS keyword_confidence"""
_decide_views("plain_", "SELECT * FROM v_inputs", False)
_decide_views("graph_", "SELECT * FROM v_inputs", True)
_decide_views("tenant_", f"""
SELECT i.* REPLACE (NULL AS cached_decision, CAST(0 AS DOUBLE) AS keyword_confidence,
    CASE WHEN lang = 'fr' THEN ['porn'] ELSE zero END AS zero,
    CASE WHEN lang = 'en' THEN CAST(0.2 AS DOUBLE) ELSE low END AS low,
    CASE WHEN lang = 'fr' THEN CAST(0.9 AS DOUBLE) ELSE high END AS high), lang
FROM v_inputs i JOIN v_content c ON c.content_id = i.content_id
""", False)
_oracle("score_aggregate", """
SELECT content_id, round(score, 6) AS score, agg_label, agg_confidence FROM v_graph_scored
""")
_oracle("score_label", """
SELECT content_id, CASE WHEN s >= 0.85 THEN 'politics' WHEN s >= 0.65 THEN 'porn'
    WHEN s >= 0.45 THEN 'gambling' WHEN s >= 0.25 THEN 'toxic' WHEN s >= 0.1 THEN 'spam'
    ELSE 'safe' END AS label,
  CASE WHEN s >= 0.7 THEN 'politics' WHEN s >= 0.65 THEN 'porn' WHEN s >= 0.45 THEN 'gambling'
    WHEN s >= 0.25 THEN 'toxic' WHEN s >= 0.2 THEN 'spam' ELSE 'safe' END AS label_lower
FROM (SELECT content_id, content_id % 1000 / CAST(1000 AS DOUBLE) AS s FROM v_signals)
""")
_oracle("decide", """
SELECT content_id, decision, confidence, reason, rule, 'signals' AS mode FROM v_plain_ruled
UNION ALL SELECT content_id, decision, confidence, reason, rule, 'placeholder' FROM v_graph_ruled
""")
_oracle("config_overrides", """
SELECT content_id, lang, decision, confidence, rule FROM v_tenant_ruled
""")
_oracle("action_outputs", """
SELECT 'entries' AS output, decision, count(*) AS n FROM v_plain_ruled
WHERE cached_decision IS NULL GROUP BY 2
UNION ALL SELECT 'reviews', decision, count(*) FROM v_plain_ruled WHERE decision = 'review' GROUP BY 2
UNION ALL SELECT 'events', decision, count(*) FROM v_plain_ruled GROUP BY 2
""")
_oracle("review_enqueue", """
SELECT substr(sha256(r.content_id || ':' || c.ts), 1, 16) AS review_id, r.content_id,
  'pending' AS status, CAST(0.5 AS DOUBLE) AS priority, r.decision AS ai_decision,
  r.confidence AS ai_confidence
FROM v_plain_ruled r JOIN v_content c ON c.content_id = r.content_id WHERE r.decision = 'review'
""")
_oracle("review_pending", """
SELECT review_id, priority, enqueued_at FROM v_reviews WHERE status = 'pending'
ORDER BY priority DESC, enqueued_at, review_id LIMIT 50
""")
_oracle("review_stats", """
SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending,
  count(*) FILTER (status = 'reviewed') AS reviewed,
  round(count(*) FILTER (status = 'pending') / CAST(count(*) AS DOUBLE), 4) AS pending_rate
FROM v_reviews
""")
_view("resolved", """
SELECT w.*, s.human_decision AS said, s.reviewer, s.reason AS why, s.resolved_at
FROM v_reviews w JOIN v_resolutions s ON s.review_id = w.review_id
WHERE s.human_decision IN ('pass', 'block')
""")
_oracle("review_resolve", """
SELECT review_id, said AS human_decision, reviewer AS reviewed_by, CAST(NULL AS VARCHAR) AS error
FROM v_resolved
UNION ALL
SELECT review_id, human_decision, reviewer, CASE WHEN human_decision NOT IN ('pass', 'block')
    THEN 'human_decision must be ''pass'' or ''block'''
    ELSE 'Review ' || review_id || ' not found' END
FROM v_resolutions WHERE human_decision NOT IN ('pass', 'block')
  OR review_id NOT IN (SELECT review_id FROM v_reviews)
""")
_oracle("review_feedback", """
SELECT key, x.decision, x.confidence, x.reason, x.tier FROM (
  SELECT key, arg_max(struct_pack(decision := decision, confidence := confidence,
    reason := reason, tier := tier), struct_pack(a := decided_at, o := entry_ord)) AS x
  FROM (SELECT key, decision, confidence, reason, tier, decided_at, entry_ord FROM v_decisions
    UNION ALL SELECT sha256(text), said, CAST(1 AS DOUBLE), why, 'human_review', resolved_at,
      CAST(0 AS BIGINT) FROM v_resolved)
  GROUP BY key)
""")
_oracle("human_events", """
SELECT content_id, decision, confidence, reason, source_label, ai_decision, tier FROM v_human
""")


def _moderated_views(prefix: str, gateway: str, text: str) -> None:
    """Cold path behind a gateway view, results shared between copies of a text."""
    _funnel_view(f"{prefix}cold", f"""
SELECT s.*, g.kw_label, g.kc, g.kc > 0.99 AND NOT g.keyword_prefiltered AS sure, g.has_text
FROM v_signals s JOIN {gateway} g ON g.content_id = s.content_id WHERE g.decision IS NULL
""", "kw_label", "NOT has_text")
    _decide_views(f"{prefix}cold_", f"""
SELECT content_id, CASE WHEN has_text THEN f_label END AS text_label, f_conf AS text_confidence,
  f_reason AS text_reason, image_label, image_confidence, f_tier, has_text, {_ZERO},
  {_NO_OVERRIDES}
FROM v_{prefix}cold
""", True)
    _view(f"{prefix}judged_all", f"""
SELECT content_id, decision, confidence, reason, tier, 'hot' AS path, resolved_by FROM {gateway}
WHERE decision IS NOT NULL
UNION ALL
SELECT content_id, decision, confidence, reason,
  CASE WHEN has_text THEN f_tier ELSE 'L3_llm' END, 'cold', 'cold_path'
FROM v_{prefix}cold_ruled
""")
    _view(f"{prefix}moderated", f"""
SELECT m.content_id, decision, confidence, reason, tier, path, resolved_by,
  m.first_id <> m.content_id AS shared
FROM (SELECT content_id, min(content_id) OVER (PARTITION BY {text}) AS first_id
  FROM {gateway}) m
JOIN v_{prefix}judged_all j ON j.content_id = m.first_id
""")


_moderated_views("b_", "v_gw", "CASE WHEN img THEN '#' || content_id ELSE sha256(text) END")
_oracle("moderate_batch", """
SELECT content_id, decision, confidence, reason, tier, path, resolved_by, shared FROM v_b_moderated
""")
_oracle("moderate_traces", """
SELECT content_id, CAST(CASE WHEN steps = '' THEN 0 ELSE len(string_split(steps, '>')) END AS INTEGER) AS n_steps, steps
FROM (SELECT m.content_id, concat_ws('>', s.s, CASE WHEN c.content_id IS NOT NULL THEN concat_ws('>',
      CASE WHEN c.has_text THEN CASE c.f_tier WHEN 'L0_empty' THEN 'empty' WHEN 'L2_bert' THEN 'L1_keyword>L2_bert'
        WHEN 'L3_llm' THEN 'L1_keyword>L2_bert>L3_llm' ELSE 'L1_keyword' END END,
      CASE WHEN c.image_label IS NOT NULL THEN 'nsfw' END,
      CASE WHEN c.rule IN ('zero_tolerance', 'safe', 'grey_zone', 'low_confidence_pass', 'block') THEN 'aggregate' END,
      CASE WHEN c.rule IN ('zero_tolerance', 'safe', 'block') THEN 'final'
        WHEN c.rule = 'zero_tolerance_keyword' THEN 'zero_tolerance'
        WHEN c.rule IN ('image_nsfw', 'image_normal') THEN 'image_only' ELSE c.rule END,
      CASE WHEN c.decision = 'review' THEN 'human_review_queue' END, 'execute') END,
    CASE WHEN m.first_id <> m.content_id THEN 'inflight_dedup' END) AS steps
  FROM (SELECT content_id, min(content_id) OVER (PARTITION BY CASE WHEN img THEN '#' || content_id
      ELSE sha256(text) END) AS first_id FROM v_gw) m
  JOIN v_steps s ON s.content_id = m.first_id LEFT JOIN v_b_cold_ruled c ON c.content_id = m.first_id)
""")
_view("left_behind", """
SELECT m.decision, m.path, g.text FROM v_b_moderated m JOIN v_gateway_content g ON g.content_id = m.content_id
""")
_oracle("moderate_outputs", r"""
SELECT 'entries' AS output, decision, count(*) AS n FROM v_left_behind
WHERE path <> 'hot' AND regexp_matches(text, '\S') GROUP BY 2
UNION ALL SELECT 'reviews', decision, count(*) FROM v_left_behind WHERE decision = 'review' GROUP BY 2
UNION ALL SELECT 'events', decision, count(*) FROM v_left_behind GROUP BY 2
""")
_oracle("batch_summary", """
SELECT count(*) AS total, count(*) FILTER (decision = 'pass') AS passed,
  count(*) FILTER (decision = 'block') AS blocked,
  count(*) FILTER (decision = 'review') AS reviewed, count(*) FILTER (path = 'hot') AS hot_path,
  count(*) FILTER (path = 'cold') AS cold_path,
  round(count(*) FILTER (path = 'hot') / CAST(count(*) AS DOUBLE), 4) AS hot_path_rate,
  round(count(*) FILTER (tier = 'L3_llm') / CAST(count(*) AS DOUBLE), 4) AS llm_call_rate,
  (SELECT string_agg(l, ';' ORDER BY l) FROM (SELECT tier || '=' || count(*) AS l
    FROM v_b_moderated GROUP BY tier)) AS tier_distribution
FROM v_b_moderated
""")

# --- feedback and monitoring ------------------------------------------------------------------

_oracle("events_union", """
SELECT content_id, source_label, decision, confidence, tier, ai_decision, event_id FROM v_events
""")
_view("samples", """
SELECT *, CASE WHEN source_label = 'human' THEN 'gold' WHEN confidence >= 0.9 THEN 'silver'
    ELSE 'skipped' END AS sample,
  CASE WHEN source_label = 'human' THEN decision WHEN decision = 'pass' THEN 'safe'
    ELSE 'unsafe' END AS label
FROM v_events
""")
_oracle("labelled_dataset", """
SELECT substr(sha256(text), 1, 12) AS id, label, confidence,
  CASE sample WHEN 'gold' THEN 'human_review' ELSE 'ai_high_conf' END AS source,
  CASE WHEN sample <> 'gold' THEN tier END AS model_tier,
  CASE WHEN sample <> 'gold' THEN reason END AS ai_reason
FROM v_samples WHERE sample <> 'skipped'
""")
_oracle("labelled_summary", """
SELECT sample, CASE WHEN sample <> 'skipped' THEN label END AS label, count(*) AS n
FROM v_samples GROUP BY 1, 2
""")
_oracle("dataset_latest", """
SELECT '20240102_000000' AS run, substr(sha256(text), 1, 12) AS id, label, confidence,
  CASE sample WHEN 'gold' THEN 'human_review' ELSE 'ai_high_conf' END AS source
FROM v_samples WHERE sample <> 'skipped'
""")
_view("terms", """
SELECT term, count(*) AS frequency, min(first_seen) AS first_seen,
  arg_min(substr(text, 1, 100), first_seen) AS example_text,
  arg_min(reason, first_seen) AS example_reason
FROM (SELECT text, reason, unnest(terms) AS term, place * 100 + unnest(range(len(terms))) AS first_seen
  FROM (SELECT *, regexp_extract_all(reason, '[''"「『](.+?)[''"」』]', 1) AS terms
    FROM (SELECT text, reason, event_id AS place FROM v_mod_events WHERE decision = 'block'
      UNION ALL SELECT text, reason, 1000000000000 + content_id FROM v_human WHERE decision = 'block')))
WHERE length(term) >= 2 AND term NOT IN (SELECT word FROM v_kw_dict)
GROUP BY term
""")
_oracle("kw_discovery", """
SELECT term, frequency, example_text, example_reason FROM v_terms
ORDER BY frequency DESC, first_seen LIMIT 50
""")
_oracle("false_positives", """
SELECT content_id, ai_decision, ai_confidence, human_reason FROM v_events
WHERE ai_decision = 'block' AND human_decision = 'pass'
""")
_view("hard", """
SELECT content_id, CASE WHEN confidence BETWEEN 0.3 AND 0.7 THEN CASE WHEN decision = 'pass'
    THEN 'safe' ELSE 'unsafe' END WHEN human_decision = 'block' THEN 'unsafe' ELSE 'safe' END
    AS label,
  confidence, CASE WHEN confidence BETWEEN 0.3 AND 0.7 THEN 'grey_zone' ELSE 'ai_wrong' END
    AS difficulty
FROM v_events
WHERE confidence BETWEEN 0.3 AND 0.7 OR ai_decision IS DISTINCT FROM human_decision
""")
_oracle("hard_cases", "SELECT content_id, label, confidence, difficulty FROM v_hard")
_oracle("report_distributions", """
SELECT 'tier' AS dimension, tier AS value, count(*) AS n FROM v_events GROUP BY 2
UNION ALL SELECT 'decision', decision, count(*) FROM v_events GROUP BY 2
""")
_view("rates", """
SELECT count(*) AS total_events, count(*) FILTER (ai_decision = 'review') AS human_reviewed,
  count(*) FILTER (ai_decision <> human_decision) AS overrides,
  round(count(*) FILTER (ai_decision = 'review') / CAST(count(*) AS DOUBLE), 4)
    AS human_review_rate,
  round(count(*) FILTER (ai_decision <> human_decision)
    / CAST(greatest(count(*) FILTER (ai_decision = 'review'), 1) AS DOUBLE), 4)
    AS human_override_rate
FROM v_events
""")
_oracle("report_overrides", "SELECT * FROM v_rates")
_view("agreement", """
SELECT count(*) AS audited, count(*) FILTER (bert_preliminary = text_label) AS agreed,
  round(count(*) FILTER (bert_preliminary = text_label) / CAST(count(*) AS DOUBLE), 4)
    AS bert_llm_agreement
FROM v_events WHERE text_tier = 'L3_llm' AND bert_preliminary IS NOT NULL
""")
_oracle("report_agreement", "SELECT * FROM v_agreement")
_oracle("report_conf_bins", """
SELECT '0.0-0.3' AS bin, count(*) FILTER (confidence > 0 AND confidence < 0.3) AS n FROM v_events
UNION ALL SELECT '0.3-0.7', count(*) FILTER (confidence >= 0.3 AND confidence < 0.7) FROM v_events
UNION ALL SELECT '0.7-0.9', count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) FROM v_events
UNION ALL SELECT '0.9-1.0', count(*) FILTER (confidence >= 0.9) FROM v_events
""")
_view("drift", """
SELECT records, round(r, 4) AS recent_avg, round(b, 4) AS baseline_avg, round(b - r, 4) AS drop,
  b - r > 0.05 AS drift
FROM (SELECT count(*) AS records, avg(accuracy) FILTER (k <= 7) AS r,
    avg(accuracy) FILTER (k > 7) AS b
  FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM v_history) WHERE k <= 60)
""")
_oracle("drift_detect", "SELECT * FROM v_drift")
_oracle("accuracy_history", "SELECT * FROM v_history ORDER BY date DESC LIMIT 60")


def _trigger(days: str, threshold: int) -> str:
    return f"""
SELECT day, new_labels, labels_since_reset, labels_since_reset >= {threshold} AS should_retrain,
  CASE WHEN labels_since_reset >= {threshold} THEN labels_since_reset
    || ' labels accumulated (threshold={threshold}) — ready for fine-tuning'
  ELSE labels_since_reset || '/{threshold} labels ('
    || printf('%.1f', (labels_since_reset * 1000 // {threshold}) / CAST(10 AS DOUBLE))
    || '%) — need ' || ({threshold} - labels_since_reset) || ' more' END AS message
FROM (SELECT day, count(*) AS new_labels,
    CAST(sum(count(*)) OVER (ORDER BY day) AS BIGINT) AS labels_since_reset
  FROM ({days}) GROUP BY day)
"""


_oracle("finetune_trigger", _trigger("""
SELECT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'purchase'
""", 1500))
_view("calibrated", """
SELECT round(a, 4) AS accuracy, CAST(CASE WHEN total_events < 100 THEN 0.95 WHEN a > 0.95 THEN 0.93
    WHEN 1 - a > 0.2 THEN 0.98 ELSE 0.95 END AS DOUBLE) AS bert_high,
  CAST(0.4 AS DOUBLE) AS bert_low, CAST(0.3 AS DOUBLE) AS grey_low,
  CAST(CASE WHEN total_events >= 100 AND 1 - a > 0.2 THEN 0.75 ELSE 0.7 END AS DOUBLE) AS grey_high
FROM (SELECT total_events, CASE WHEN human_override_rate = 0 THEN CAST(0.95 AS DOUBLE)
  ELSE 1 - human_override_rate END AS a FROM v_rates)
""")
_oracle("calibrate", "SELECT * FROM v_calibrated")
_view("status", """
SELECT n AS labels_since_reset, d.drift, d.drop, c.bert_high, c.grey_high,
  n >= 5000 AS should_retrain, CASE WHEN n >= 5000 THEN n
    || ' labels accumulated (threshold=5000) — ready for fine-tuning' ELSE n || '/5000 labels ('
    || printf('%.1f', (n * 1000 // 5000) / CAST(10 AS DOUBLE)) || '%) — need ' || (5000 - n)
    || ' more' END AS message
FROM (SELECT count(*) AS n FROM v_human), v_drift d, v_calibrated c
""")
_oracle("health_status", "SELECT * FROM v_status")
_view("run_history", """
SELECT * FROM (SELECT date, accuracy, sample_size FROM v_history
  UNION ALL SELECT '2024-03-01', round(1 - human_override_rate, 4), total_events FROM v_rates)
ORDER BY date DESC LIMIT 60
""")
_view("run_drift", """
SELECT round(b - r, 4) AS drop, b - r > 0.05 AS drift
FROM (SELECT avg(accuracy) FILTER (k <= 7) AS r, avg(accuracy) FILTER (k > 7) AS b
  FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM v_run_history))
""")
_view("bins", """
SELECT CASE WHEN confidence < 0.3 THEN '0.0-0.3' WHEN confidence < 0.7 THEN '0.3-0.7'
  WHEN confidence < 0.9 THEN '0.7-0.9' ELSE '0.9-1.0' END AS bin FROM v_events WHERE confidence <> 0
""")
_oracle("feedback_run", """
SELECT 'samples_' || sample AS figure, CAST(count(*) AS DOUBLE) AS value FROM v_samples GROUP BY 1
UNION ALL SELECT 'tier_' || tier, count(*) FROM v_events GROUP BY 1
UNION ALL SELECT 'decision_' || decision, count(*) FROM v_events GROUP BY 1
UNION ALL SELECT 'confidence_' || bin, count(*) FROM v_bins GROUP BY 1
UNION ALL SELECT 'terms', least(count(*), 50) FROM v_terms
UNION ALL SELECT 'false_positives', count(*) FROM v_events
  WHERE ai_decision = 'block' AND human_decision = 'pass'
UNION ALL SELECT 'hard_cases', count(*) FROM v_hard
UNION ALL SELECT 'human_review_rate', human_review_rate FROM v_rates
UNION ALL SELECT 'human_override_rate', human_override_rate FROM v_rates
UNION ALL SELECT 'bert_llm_agreement', bert_llm_agreement FROM v_agreement
UNION ALL SELECT 'new_labels', count(*) FROM v_human
UNION ALL SELECT 'should_retrain', CASE WHEN count(*) >= 5000 THEN 1 ELSE 0 END FROM v_human
UNION ALL SELECT 'accuracy', round(1 - human_override_rate, 4) FROM v_rates
UNION ALL SELECT 'bert_high', bert_high FROM v_calibrated
UNION ALL SELECT 'drop', drop FROM v_run_drift
UNION ALL SELECT 'drift', CASE WHEN drift THEN 1 ELSE 0 END FROM v_run_drift
""")
_oracle("feedback_history", "SELECT date, accuracy, sample_size FROM v_run_history")
_oracle("labelled_recent", f"""
SELECT sample, CASE WHEN sample <> 'skipped' THEN label END AS label, count(*) AS n
FROM v_samples WHERE ts >= {START} AND ts < {START} + 86400 GROUP BY 1, 2
""")
_oracle("assets_write", """
SELECT asset, '20240101_000000' AS run, n FROM (
  SELECT 'labelled' AS asset, count(*) AS n FROM v_samples WHERE sample <> 'skipped'
  UNION ALL SELECT 'summary', count(*) FROM (SELECT DISTINCT sample,
    CASE WHEN sample <> 'skipped' THEN label END FROM v_samples)
  UNION ALL SELECT 'keywords', least(count(*), 50) FROM v_terms
  UNION ALL SELECT 'false_positives', count(*) FROM v_events
    WHERE ai_decision = 'block' AND human_decision = 'pass'
  UNION ALL SELECT 'hard_cases', count(*) FROM v_hard
  UNION ALL SELECT 'report', 1)
""")

# --- evaluation -------------------------------------------------------------------------------


def _confusion(source: str) -> str:
    return f"""
SELECT total, tp, tn, fp, fn, round((tp + tn) / CAST(total AS DOUBLE), 4) AS accuracy,
  round(p, 4) AS precision, round(r, 4) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS p,
    CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS r
  FROM (SELECT count(*) AS total,
      count(*) FILTER (expected = 'unsafe' AND decision <> 'pass') AS tp,
      count(*) FILTER (expected = 'safe' AND decision = 'pass') AS tn,
      count(*) FILTER (expected = 'safe' AND decision <> 'pass') AS fp,
      count(*) FILTER (expected = 'unsafe' AND decision = 'pass') AS fn
    FROM {source}))
"""


_view("confusion", _confusion("v_results"))
_oracle("eval_confusion", "SELECT * FROM v_confusion")
_view("l_gw", "SELECT * FROM v_gw WHERE content_id IN (SELECT doc_id FROM labels)")
_moderated_views("l_", "v_l_gw", "CASE WHEN img THEN '#' || content_id ELSE sha256(text) END")
_view("judged_cases", """
SELECT m.*, c.lang AS corpus, c.expected, c.source FROM v_l_moderated m JOIN v_cases c ON c.content_id = m.content_id
""")
_view("cases_twice", """
SELECT * FROM v_judged_cases UNION ALL SELECT * REPLACE ('all' AS corpus) FROM v_judged_cases
""")
_view("run_counts", """
SELECT corpus, count(*) AS total, count(*) FILTER (expected = 'unsafe' AND decision <> 'pass') AS tp,
  count(*) FILTER (expected = 'safe' AND decision = 'pass') AS tn,
  count(*) FILTER (expected = 'safe' AND decision <> 'pass') AS fp,
  count(*) FILTER (expected = 'unsafe' AND decision = 'pass') AS fn,
  round(count(*) FILTER (tier = 'L3_llm') / CAST(count(*) AS DOUBLE), 4) AS llm_call_rate,
  round(count(*) FILTER (tier = 'L2_bert') / CAST(count(*) AS DOUBLE), 4) AS bert_intercept_rate,
  round(count(*) FILTER (tier = 'L1_keyword') / CAST(count(*) AS DOUBLE), 4) AS keyword_intercept_rate,
  round(count(*) FILTER (tier IN ('L0_memory', 'L0_redis', 'L0_phash', 'L0_empty', 'L0_whitelist',
    'L1_chroma')) / CAST(count(*) AS DOUBLE), 4) AS cache_hit_rate,
  round(count(*) FILTER (path = 'hot') / CAST(count(*) AS DOUBLE), 4) AS hot_path_rate
FROM v_cases_twice GROUP BY corpus
""")
_view("run_measured", """
SELECT *, round(a, 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1
FROM (SELECT *, (tp + tn) / CAST(total AS DOUBLE) AS a,
    CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS p,
    CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS r FROM v_run_counts)
""")
_RUN_FIGURES = (
    "total tp tn fp fn accuracy precision recall f1 llm_call_rate bert_intercept_rate keyword_intercept_rate "
    "cache_hit_rate hot_path_rate"
).split()
_RUN_LIMITS = {"llm_call_rate": "< 0.2", "bert_intercept_rate": "> 0.3", "f1": "> 0.9", "cache_hit_rate": "> 0.15"}
_oracle("eval_run", "\nUNION ALL ".join(
    [f"SELECT corpus, '{c}' AS figure, CAST({c} AS DOUBLE) AS value FROM v_run_measured" for c in _RUN_FIGURES]
    + [f"SELECT corpus, 'accepted_{c}', CASE WHEN {c} {x} THEN 1 ELSE 0 END FROM v_run_measured" for c, x in _RUN_LIMITS.items()]
    + ["""SELECT corpus, 'errors_' || source, n FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, source) AS k
  FROM (SELECT corpus, source, count(*) AS n FROM v_judged_cases WHERE (expected = 'unsafe') <> (decision <> 'pass') GROUP BY 1, 2))
WHERE k <= 5"""]
))
_oracle("eval_run_errors", """
SELECT corpus, content_id, expected, decision, confidence, tier, reason
FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY content_id) AS k FROM v_judged_cases
  WHERE (expected = 'unsafe') <> (decision <> 'pass')) WHERE k <= 8
""")
_view("rates_by_tier", """
SELECT count(*) AS total,
  round(count(*) FILTER (tier = 'L3_llm') / CAST(count(*) AS DOUBLE), 4) AS llm_call_rate,
  round(count(*) FILTER (tier = 'L2_bert') / CAST(count(*) AS DOUBLE), 4) AS bert_intercept_rate,
  round(count(*) FILTER (tier = 'L1_keyword') / CAST(count(*) AS DOUBLE), 4)
    AS keyword_intercept_rate,
  round(count(*) FILTER (tier IN ('L0_memory', 'L0_redis', 'L0_phash', 'L0_empty', 'L0_whitelist',
    'L1_chroma')) / CAST(count(*) AS DOUBLE), 4) AS cache_hit_rate,
  round(count(*) FILTER (path = 'hot') / CAST(count(*) AS DOUBLE), 4) AS hot_path_rate
FROM v_results
""")
_oracle("eval_funnel", "SELECT * FROM v_rates_by_tier")


def _ranked(q: str) -> str:
    return f"max(v) FILTER (k = CAST(floor(c * {q}) AS BIGINT) + 1)"


def _latency(group: str) -> str:
    return f"""
SELECT {group} AS grp, count(*) AS n, {_ranked('CAST(0.5 AS DOUBLE)')} AS p50,
  {_ranked('CAST(0.95 AS DOUBLE)')} AS p95, {_ranked('CAST(0.99 AS DOUBLE)')} AS p99,
  round(avg(latency_ms), 2) AS avg, max(v) AS max
FROM (SELECT *, round(latency_ms, 2) AS v,
    row_number() OVER (PARTITION BY {group} ORDER BY latency_ms) AS k,
    count(*) OVER (PARTITION BY {group}) AS c FROM v_results)
GROUP BY 1
"""


_view("latency_path", _latency("path"))
_view("latency_source", _latency("source"))
_view("latency_all", _latency("1"))
_oracle("eval_latency", "SELECT grp AS path, n, p50, p95, p99, avg, max FROM v_latency_path")
_oracle("eval_per_class", """
SELECT quality, total, round((tp + tn) / CAST(total AS DOUBLE), 4) AS accuracy,
  CASE WHEN tp + fn > 0 THEN round(tp / CAST(tp + fn AS DOUBLE), 4) ELSE CAST(0 AS DOUBLE) END
    AS recall, tp, tn, fp, fn
FROM (SELECT quality, count(*) AS total,
    count(*) FILTER (expected = 'unsafe' AND decision <> 'pass') AS tp,
    count(*) FILTER (expected = 'safe' AND decision = 'pass') AS tn,
    count(*) FILTER (expected = 'safe' AND decision <> 'pass') AS fp,
    count(*) FILTER (expected = 'unsafe' AND decision = 'pass') AS fn
  FROM v_results GROUP BY quality)
""")
_oracle("eval_top_errors", """
SELECT source, count(*) AS errors FROM v_graded WHERE NOT correct GROUP BY 1
ORDER BY errors DESC, source LIMIT 5
""")
_oracle("eval_by_group", """
SELECT lang, count(*) AS total,
  round(count(*) FILTER (correct) / CAST(count(*) AS DOUBLE), 4) AS accuracy,
  coalesce(round(count(*) FILTER (correct AND expected = 'safe')
    / CAST(nullif(count(*) FILTER (expected = 'safe'), 0) AS DOUBLE), 4), 0) AS safe_accuracy,
  coalesce(round(count(*) FILTER (correct AND expected = 'unsafe')
    / CAST(nullif(count(*) FILTER (expected = 'unsafe'), 0) AS DOUBLE), 4), 0) AS unsafe_accuracy,
  round(avg(confidence) FILTER (expected = 'safe'), 6) AS avg_safe_conf,
  round(avg(confidence) FILTER (expected = 'unsafe'), 6) AS avg_unsafe_conf,
  round(count(*) FILTER (confidence >= 0.95) / CAST(count(*) AS DOUBLE), 4) AS skip_rate
FROM v_graded GROUP BY lang
""")
_view("scored", """
SELECT c.content_id, c.expected, s.score_label, s.score_confidence AS confidence, s.audit_label,
  s.score_label = c.expected AS ok
FROM v_cases c JOIN v_signals s ON s.content_id = c.content_id
""")
_view("bins", """
SELECT bin, count(*) AS n, round(count(*) FILTER (ok) / CAST(count(*) AS DOUBLE), 6) AS accuracy,
  round(avg(confidence), 6) AS avg_confidence,
  round(avg(confidence) - count(*) FILTER (ok) / CAST(count(*) AS DOUBLE), 6) AS gap
FROM (SELECT *, CASE WHEN confidence < 0.5 THEN '0.00-0.50' WHEN confidence < 0.7 THEN '0.50-0.70'
  WHEN confidence < 0.8 THEN '0.70-0.80' WHEN confidence < 0.9 THEN '0.80-0.90'
  WHEN confidence < 0.95 THEN '0.90-0.95' ELSE '0.95-1.00' END AS bin FROM v_scored)
GROUP BY bin
""")
_oracle("eval_reliability", "SELECT * FROM v_bins")
_oracle("eval_ece", """
SELECT n, ece, CASE WHEN ece < 0.05 THEN 'well-calibrated' WHEN ece < 0.1
  THEN 'marginally calibrated' ELSE 'poorly calibrated' END AS verdict
FROM (SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(gap)) / sum(n), 4) AS ece FROM v_bins)
""")
_oracle("eval_overconfident", """
SELECT content_id, expected, score_label, confidence FROM v_scored WHERE confidence >= 0.9 AND NOT ok
""")
_oracle("eval_disagreement", """
SELECT count(*) AS total, count(*) FILTER (score_label <> b) AS disagreements,
  round(count(*) FILTER (score_label = b) / CAST(count(*) AS DOUBLE), 4) AS agreement_rate,
  round(count(*) FILTER (score_label = expected) / CAST(count(*) AS DOUBLE), 4) AS accuracy_a,
  round(count(*) FILTER (b = expected) / CAST(count(*) AS DOUBLE), 4) AS accuracy_b
FROM (SELECT *, CASE WHEN audit_label = 'safe' THEN 'safe' ELSE 'unsafe' END AS b FROM v_scored)
""")
_oracle("eval_consistency", """
SELECT c.source, count(*) AS runs, count(DISTINCT audit_label) AS unique_labels,
  min(audit_confidence) AS min_confidence, max(audit_confidence) AS max_confidence
FROM v_content c JOIN v_signals s ON s.content_id = c.content_id
WHERE audit_label IS NOT NULL GROUP BY 1
""")
_oracle("service_breakdown", """
SELECT r.source, count(*) AS total, count(*) FILTER (path = 'hot' AND decision = 'block')
    AS hot_block,
  count(*) FILTER (path = 'hot' AND decision <> 'block') AS hot_pass,
  count(*) FILTER (path <> 'hot') AS cold_escalated,
  round(count(*) FILTER (path = 'hot') / CAST(count(*) AS DOUBLE), 4) AS hot_rate,
  any_value(l.avg) AS avg_latency_ms, any_value(l.p99) AS p99_latency_ms
FROM v_results r JOIN v_latency_source l ON l.grp = r.source GROUP BY 1
""")
_oracle("cost_by_tier", """
SELECT tier, count(*) AS calls, round(count(*) * CAST(CASE tier WHEN 'L2_bert' THEN 0.0001
    WHEN 'L3_llm' THEN 0.002 ELSE 0 END AS DOUBLE), 6) AS cost,
  round(CASE WHEN tier = 'L3_llm' THEN count(*) * 300 / CAST(1000 AS DOUBLE)
    * CAST(0.002 AS DOUBLE) ELSE 0 END, 6) AS token_cost
FROM v_results GROUP BY tier
""")
_oracle("latency_hist", """
SELECT CAST(floor(log10(greatest(latency_ms, 1)) * 10) AS INTEGER) AS bucket, count(*) AS n
FROM v_results GROUP BY 1
""")
_oracle("funnel_ordered", """
SELECT CASE tier WHEN 'L0_memory' THEN 1 WHEN 'L0_redis' THEN 2 WHEN 'L0_empty' THEN 3
    WHEN 'L0_whitelist' THEN 4 WHEN 'L1_keyword' THEN 5 WHEN 'L1_chroma' THEN 6
    WHEN 'L2_bert' THEN 7 WHEN 'L3_llm' THEN 8 ELSE 9 END AS position,
  tier, count(*) AS n,
  round(count(*) / CAST((SELECT count(*) FROM v_results) AS DOUBLE), 4) AS share
FROM v_results GROUP BY tier
""")
_view("avg_latency", "SELECT round(avg(latency_ms), 2) AS avg_latency_ms FROM v_results")
_oracle("eval_acceptance", """
SELECT criterion, value, CAST(target AS DOUBLE) AS target,
  CASE WHEN above THEN value > target ELSE value < target END AS passed
FROM (
  SELECT 'llm_call_rate' AS criterion, llm_call_rate AS value, 0.2 AS target, false AS above
  FROM v_rates_by_tier
  UNION ALL SELECT 'bert_intercept_rate', bert_intercept_rate, 0.3, true FROM v_rates_by_tier
  UNION ALL SELECT 'f1', f1, 0.9, true FROM v_confusion
  UNION ALL SELECT 'cache_hit_rate', cache_hit_rate, 0.15, true FROM v_rates_by_tier
  UNION ALL SELECT 'avg_latency_ms', avg_latency_ms, 500, false FROM v_avg_latency)
""")
_oracle("ops_alerts", """
SELECT metric, value, CAST(lim AS DOUBLE) AS limit_value,
  CASE WHEN below THEN value < lim ELSE value > lim END AS alert
FROM (
  SELECT 'hot_path_rate' AS metric, hot_path_rate AS value, 0.3 AS lim, true AS below
  FROM v_rates_by_tier
  UNION ALL SELECT 'chroma_cache_hit_rate', cache_hit_rate, 0.1, true FROM v_rates_by_tier
  UNION ALL SELECT 'llm_call_rate', llm_call_rate, 0.3, false FROM v_rates_by_tier
  UNION ALL SELECT 'latency_p99_ms', p99, 3000, false FROM v_latency_all)
""")
_oracle("eval_misclassified", """
SELECT content_id, expected, decision, tier FROM v_graded WHERE NOT correct
ORDER BY content_id LIMIT 20
""")


def _balanced(unsafe: str, safe: str) -> str:
    return f"""
SELECT content_id, expected FROM (
  SELECT content_id, expected, row_number() OVER (PARTITION BY expected
    ORDER BY md5('42:' || content_id)) AS k,
    count(*) FILTER (expected = 'unsafe') OVER () AS u
  FROM v_cases)
WHERE k <= CASE WHEN expected = 'unsafe' THEN {unsafe} ELSE {safe} END
"""


_oracle("balanced_sample", _balanced("greatest(5, least(u, 50))", "150 - greatest(5, least(u, 50))"))
_oracle("balanced_sample_full", _balanced("u", "u * 3"))
_oracle("train_prepare", """
SELECT CASE WHEN CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) % 10 = 0 THEN 'test'
    ELSE 'train' END AS part, CASE WHEN expected = 'unsafe' THEN 1 ELSE 0 END AS label,
  count(*) AS n
FROM v_cases GROUP BY 1, 2
""")
_oracle("train_ready", """
SELECT count(*) AS samples, count(*) FILTER (expected = 'safe') AS safe_count,
  count(*) FILTER (expected = 'unsafe') AS unsafe_count, count(*) >= 100 AS ready FROM v_cases
""")

# --- streaming --------------------------------------------------------------------------------

_view("st_gw", """
SELECT r.content_id, c.text, false AS img, true AS has_text, k.label AS kw_label,
  k.confidence AS kc,
  CASE WHEN l.e IS NOT NULL THEN 'memory' WHEN s.e IS NOT NULL THEN 'shared'
    WHEN k.whitelist_hit THEN 'whitelist' WHEN k.confidence > 0.99 THEN 'keyword'
    WHEN k.confidence >= 0.4 THEN 'ambiguous' ELSE 'escalated' END AS resolved_by,
  CASE WHEN l.e IS NOT NULL THEN l.e.decision WHEN s.e IS NOT NULL THEN s.e.decision
    WHEN k.whitelist_hit THEN 'pass' WHEN k.confidence > 0.99 THEN 'block' END AS decision,
  CASE WHEN l.e IS NOT NULL THEN l.e.confidence WHEN s.e IS NOT NULL THEN s.e.confidence
    ELSE CAST(1 AS DOUBLE) END AS confidence,
  CASE WHEN l.e IS NOT NULL THEN l.e.reason WHEN s.e IS NOT NULL THEN s.e.reason
    WHEN k.whitelist_hit THEN 'Whitelist match — known false positive phrase'
    ELSE 'Hot-path keyword match: ' || k.label END AS reason,
  CASE WHEN l.e IS NOT NULL THEN l.e.tier WHEN s.e IS NOT NULL THEN s.e.tier
    WHEN k.whitelist_hit THEN 'L0_whitelist' ELSE 'L1_keyword' END AS tier,
  l.e IS NULL AND s.e IS NULL AS keyword_prefiltered
FROM v_requests r JOIN v_content c ON c.content_id = r.content_id
LEFT JOIN v_local_hit l ON l.content_id = r.content_id
LEFT JOIN v_shared_hit s ON s.content_id = r.content_id
LEFT JOIN v_verdict k ON k.content_id = r.content_id
""")
_moderated_views("s_", "v_st_gw", "sha256(text)")
_oracle("stream_moderate", """
SELECT content_id, decision, confidence, reason, tier, path, resolved_by, shared FROM v_s_moderated
""")
_oracle("stream_reviews", """
SELECT substr(sha256(m.content_id || ':' || c.ts), 1, 16) AS review_id, m.content_id, 'pending' AS status,
  c.ts AS enqueued_at, CAST(0.5 AS DOUBLE) AS priority, decision AS ai_decision,
  confidence AS ai_confidence, reason AS ai_reason
FROM v_s_moderated m JOIN v_content c ON c.content_id = m.content_id WHERE decision = 'review'
""")
_oracle("stream_outcomes", """
SELECT c.ts AS timestamp, strftime(make_timestamp(c.ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_iso,
  m.content_id, c.source, decision, confidence, reason, tier, 'ai' AS source_label
FROM v_s_moderated m JOIN v_content c ON c.content_id = m.content_id
""")
_view("cache_lives", """
SELECT content_id, key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts) AS life
FROM (SELECT content_id, key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) < 36000
  THEN 0 ELSE 1 END AS fresh FROM v_requests)
""")
_view("cache_answers", """
SELECT content_id, key, first_value(content_id) OVER (PARTITION BY key, life ORDER BY ts) AS answered_by
FROM v_cache_lives
""")
_oracle("stream_ttl_cache", """
SELECT a.content_id, a.key, a.answered_by <> a.content_id AS hit, a.answered_by, d.decision, d.confidence,
  d.reason, d.tier
FROM v_cache_answers a JOIN v_decisions d ON d.entry_ord = a.answered_by
""")
_oracle("stream_cache_lives", """
SELECT key, min(ts) AS started, count(*) AS requests, count(*) - 1 AS hits
FROM (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts) AS life
  FROM (SELECT key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) < 36000
    THEN 0 ELSE 1 END AS fresh FROM v_requests))
GROUP BY key, life
""")
_oracle("stream_dedup", "SELECT DISTINCT key FROM v_requests")
_oracle("stream_stats", """
SELECT w AS window_start, w + 3600 AS window_end, event_type, count(*) AS n
FROM (SELECT event_type, unnest([q, q - 900, q - 1800, q - 2700]) AS w
  FROM (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) // 900 * 900 AS q FROM events))
GROUP BY 1, 2, 3
""")
_oracle("stream_events", "SELECT content_id, key, ts FROM v_requests")
_oracle("stream_trigger", _trigger(
    "SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day FROM v_content", 200))
