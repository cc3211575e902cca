"""SQL counterparts of the corpus queries, where SQL can express them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {}

# Words in order of their count; a pair of lines that reaches 4/5 shares a word of both prefixes.
ORACLE["op1_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), numbered AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS n FROM split
), sets AS (
  SELECT doc_id, n, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words FROM numbered
), lines AS (
  SELECT doc_id, n, words, len(words) AS size, row_number() OVER (ORDER BY doc_id, n) AS id FROM sets WHERE len(words) > 0
), firsts AS (
  SELECT id, words, size, row_number() OVER (PARTITION BY words ORDER BY id) AS copy FROM lines
), tokens AS (
  SELECT id, size, unnest(words) AS word FROM firsts WHERE copy = 1
), counts AS (
  SELECT word, count(*) AS df FROM tokens GROUP BY word
), ranked AS (
  SELECT id, size, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS place FROM tokens JOIN counts USING (word)
), prefix AS (
  SELECT id, size, word FROM ranked WHERE place <= size - CAST(ceil(size * 4 / 5) AS BIGINT) + 1
), pairs AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b
  ON a.word = b.word AND a.id < b.id AND 5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size)
), later AS (
  SELECT DISTINCT y FROM pairs JOIN lines a ON a.id = x JOIN lines b ON b.id = y
  WHERE 9 * len(list_intersect(a.words, b.words)) >= 4 * (a.size + b.size)
), gone AS (
  SELECT doc_id, n FROM lines WHERE id IN (SELECT y FROM later) OR id IN (SELECT id FROM firsts WHERE copy > 1)
), by_doc AS (
  SELECT doc_id, array_to_string(list_sort(list(CAST(n AS INTEGER))), ',') AS removed, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT s.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM split s LEFT JOIN by_doc g ON s.doc_id = g.doc_id
"""

ORACLE["op2_pca_tiles"] = r"""
WITH RECURSIVE wide AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v FROM embeddings
), good AS (
  SELECT vec_id, v FROM wide WHERE len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(v, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least_of l ON e.vec_id = l.a LEFT JOIN degree d ON e.vec_id = d.a
"""

ORACLE["op5_host_quality"] = rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER () AS r FROM base
), windows AS (
  SELECT r, unnest(list_transform(range(1, len(words) - 6), lambda i: [CAST(i AS VARCHAR), array_to_string(words[i:i + 7], ' ')])) AS w FROM numbered
), twice AS (
  SELECT r, CAST(w[1] AS BIGINT) AS i, count(*) OVER (PARTITION BY r, w[2]) AS n FROM windows
), covered AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS place FROM twice WHERE n > 1) GROUP BY r
), figures AS (
  SELECT doc_id, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM numbered LEFT JOIN covered c USING (r)
), failed AS (
  SELECT *, unnest([CAST(n_words < 20 AS INTEGER), CAST(100 * n_repeat_words > 30 * n_words AS INTEGER),
    CAST(10 * n_symbols > 8 * n_words AS INTEGER), CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS INTEGER)]) AS f,
    unnest([1, 2, 3, 4]) AS rule FROM figures
), hosts AS (
  SELECT source, rule, count(*) AS n, sum(f) AS k FROM failed GROUP BY source, rule
), moments AS (
  SELECT rule, sum(n) AS n, count(*) AS h, sum(k) / CAST(sum(n) AS DOUBLE) AS m, sum(k / CAST(n AS DOUBLE) * k) / sum(n) AS sq FROM hosts GROUP BY rule
), spread AS (
  SELECT rule, m, m * (1 - m) AS noise, sq - m * m - m * (1 - m) * h / n AS s FROM moments
), prior AS (
  SELECT rule, m, CASE WHEN s > 0 THEN least(greatest(noise / s - 1, 1.0), 1000.0) ELSE 1000.0 END AS w FROM spread
), rates AS (
  SELECT source, max((k + m * w) / (n + w)) AS rate FROM hosts JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND rate <= 0.5 AS kept, f.source, round(rate, 6) AS host_rate
FROM figures f JOIN rates r ON f.source IS NOT DISTINCT FROM r.source
"""

ORACLE["op6_perspective_rotation"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), turns AS (
  SELECT s.conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), named AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name FROM turns
), headed AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM named
), rendered AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS seq, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rendered WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text)
)
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, role, name, segment, CAST(start AS BIGINT) AS start,
  CAST(start + length(segment) AS BIGINT) AS end_, role = 'assistant' AS trained,
  CAST(CASE WHEN role = 'assistant' THEN start + length(head) END AS BIGINT) AS mask_start,
  CAST(CASE WHEN role = 'assistant' THEN start + length(segment) END AS BIGINT) AS mask_end
FROM placed
"""

ORACLE["op8_fair_queue_mix"] = rf"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS}) AS size,
    CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3, 1, 2][place % 3 + 1] AS weight, 2 * source_size AS cap FROM sources
), levels AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighted
), level AS (
  SELECT level FROM levels WHERE level * weight < cap ORDER BY cap / CAST(weight AS DOUBLE), place LIMIT 1
), targets AS (
  SELECT source, source_size, CAST(CASE WHEN (SELECT count(*) FROM level) = 0 THEN cap ELSE least(CAST(cap AS DOUBLE), (SELECT level FROM level) * weight) END AS DOUBLE) AS target
  FROM weighted
), queued AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized
), turns AS (
  SELECT q.doc_id, q.source, h, size, before, t.turn, (t.turn * source_size + before + size) / target AS finish
  FROM queued q JOIN targets g ON q.source IS NOT DISTINCT FROM g.source, (SELECT unnest([0, 1]) AS turn) t WHERE size > 0
), used AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, h, doc_id, size, before, turn ROWS UNBOUNDED PRECEDING) AS used FROM turns
), taken AS (
  SELECT doc_id, source, before, size, count(*) AS copies FROM used WHERE used <= (SELECT sum(size) * 1.5 FROM sized) GROUP BY ALL
)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(coalesce(copies, 0) * q.size AS BIGINT) AS taken
FROM queued q JOIN targets g ON q.source IS NOT DISTINCT FROM g.source
LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.source IS NOT DISTINCT FROM t.source AND q.before = t.before AND q.size = t.size
"""

# CRC 32 bit by bit over the digits of doc_id.
CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END), 4294967295)"""

# Equal words of a text at the same lag, one after the other, are stretches of a diagonal.
ORACLE["op11_online_periodic_runs"] = rf"""
WITH texts AS (
  SELECT doc_id, {WORDS} AS given, {CRC32} AS h FROM documents
), places AS (
  SELECT doc_id, given, h, len(given) AS n, (h // 10) % len(given) AS a FROM texts WHERE h % 10 = 0 AND len(given) > 0
), periods AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM places
), planted AS (
  SELECT doc_id, list_transform(range(n), lambda i: CASE WHEN i < a THEN given[i + 1] ELSE given[a + (i - a) % p + 1] END) AS words FROM periods
), docs AS (
  SELECT t.doc_id, coalesce(p.words, t.given) AS words FROM texts t LEFT JOIN planted p ON t.doc_id = p.doc_id
), words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM docs
), matched AS (
  SELECT x.doc_id, y.i AS i, y.i - x.i AS lag FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), islands AS (
  SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM matched
), diagonals AS (
  SELECT doc_id, lag, min(i) - lag AS start, count(*) + lag AS length FROM islands GROUP BY doc_id, lag, island
), runs AS (
  SELECT doc_id, start, length, min(lag) AS period FROM diagonals WHERE length >= greatest(12, 2 * lag) GROUP BY doc_id, start, length
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM words w LEFT JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i
  WHERE d.i IS NULL GROUP BY w.doc_id
), listed AS (
  SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), longest AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS place FROM runs
)
SELECT d.doc_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_runs, CAST(r.start AS BIGINT) AS start, CAST(r.length AS BIGINT) AS length,
  CAST(r.period AS BIGINT) AS period, CAST(1000 * r.length // r.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
LEFT JOIN (SELECT * FROM longest WHERE place = 1) r ON d.doc_id = r.doc_id
"""


def _field(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# Levels of all languages, then of their subroots, one number of the tree (`tree`) after the other.
_UP = """
  SELECT level + 1, lang, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), count(*) OVER (PARTITION BY lang)
  FROM {nodes} WHERE n > 1 GROUP BY level, lang, idx // 8
"""
_SIBLINGS = """
  SELECT x.level, x.lang, x.idx, coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (WHERE y.idx < x.idx), '') AS before,
    coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (WHERE y.idx > x.idx), '') AS after
  FROM {nodes} x JOIN {nodes} y ON x.level = y.level AND x.lang IS NOT DISTINCT FROM y.lang AND x.idx // 8 = y.idx // 8
  WHERE x.n > 1 GROUP BY x.level, x.lang, x.idx
"""
ORACLE["op12_cogrouped_merkle"] = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf, {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other,
    {CRC32} % 3 = 0 AS tampered FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM rows
), nodes(level, lang, idx, digest, n) AS (
  SELECT 0, lang, idx, leaf, n FROM leaves
  UNION ALL
  {_UP.format(nodes="nodes")}
), subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), top(level, lang, idx, digest, n) AS (
  SELECT 0, '', idx, digest, n FROM subroots
  UNION ALL
  {_UP.format(nodes="top")}
), inner_siblings AS ({_SIBLINGS.format(nodes="nodes")}
), outer_siblings AS ({_SIBLINGS.format(nodes="top")}
), steps AS (
  SELECT l.doc_id, l.leaf, 0 AS part, s.level, s.before, s.after FROM leaves l JOIN inner_siblings s
    ON s.lang IS NOT DISTINCT FROM l.lang AND s.idx = l.idx // CAST(power(8, s.level) AS BIGINT)
  UNION ALL
  SELECT l.doc_id, l.leaf, 1, s.level, s.before, s.after FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
    JOIN outer_siblings s ON s.idx = r.idx // CAST(power(8, s.level) AS BIGINT)
), proofs AS (
  SELECT doc_id, leaf, sha256(string_agg(before || after, '' ORDER BY part, level)) AS proof_sha256,
    list([before, after] ORDER BY part, level) AS path FROM steps GROUP BY doc_id, leaf
), folded AS (
  SELECT p.*, l.lang, list_reduce(list_prepend([CASE WHEN tampered THEN other ELSE l.leaf END, ''], path),
    lambda s, x: [sha256(x[1] || s[1] || x[2]), ''])[1] AS folded_root
  FROM proofs p JOIN leaves l ON p.doc_id = l.doc_id AND p.leaf = l.leaf
)
SELECT f.doc_id, f.leaf, s.digest AS subroot, t.digest AS root, proof_sha256, folded_root, folded_root = t.digest AS verified
FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang JOIN top t ON t.n = 1
"""

ORACLE["op13_segment_topk"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
