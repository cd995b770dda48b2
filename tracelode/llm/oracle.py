"""DuckDB SQL that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

CHAT_FORMATTING = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, coalesce(lag(role) OVER w <> role, TRUE) AS opens,
    length(replace(replace(text, '\', '\b'), '<|', '\l|')) AS escaped,
    length(replace(replace(role, '\', '\b'), '<|', '\l|')) AS role_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE WHEN opens THEN 8 + role_chars + 1 + 8 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row_id, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    string_split(text, chr(10)) AS rows FROM d
), windows AS (
  SELECT row_id, i, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), shared AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n FROM shared, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY row_id
), lines AS (
  SELECT row_id, unnest(range(1, len(rows) + 1)) AS i, unnest(rows) AS line FROM w
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row_id, line ORDER BY i) AS copy,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_line_words FROM lines
), judged AS (
  SELECT *, n_line_words > 0 AND (
      copy > 1
      OR 2 * length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) >= n_line_words
      OR (n_line_words >= 3 AND length(regexp_replace(line, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(line, '[^\p{Ll}]+', '', 'g')))
      OR (n_line_words >= 3 AND 2 * len(regexp_extract_all(line, '!+(?:[\x20\x09-\x0D]|$)')) >= n_line_words)
      OR length(regexp_replace(line, '[^|]+', '', 'g')) >= 2
      OR (n_line_words <= 3 AND regexp_matches(line, '(?i)^\W*(home|menu|login|log in|sign in|sign up|register|search|share|next|previous|back to top|read more|skip to content|contact|about us|sitemap)\b'))
      OR regexp_matches(line, '(?i)(all rights reserved|^\W*licensed under|^\W*released under the|is licensed under the|terms of use|terms of service|privacy policy|cookie policy|uses cookies|accept cookies|enable javascript|subscribe to our newsletter|lorem ipsum|powered by wordpress|^\W*copyright|©)')
    ) AS bad FROM ranked
), per_line AS (
  SELECT row_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_removed_lines,
    count(*) FILTER (WHERE n_line_words > 0 AND copy > 1) AS n_dup_lines,
    coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (WHERE NOT bad), 0) AS kept_chars
  FROM judged GROUP BY row_id
), figures AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, n_lines, n_removed_lines, kept_chars
  FROM w JOIN per_line USING (row_id) LEFT JOIN covered USING (row_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars >= (1 - 0.7::DOUBLE) * word_chars AS kept,
  n_lines, n_removed_lines
FROM figures
"""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, root) AS (
  SELECT a, a FROM edges UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.node
), grouped AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN grouped ON node = doc_id
"""

SUBSTRING_DEDUP = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM grams) WHERE first < doc_id
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM late, (SELECT unnest(range(0, 13)) AS k)
), flat AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM flat ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

LINE_DEDUP = r"""
WITH rows AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents
), held AS (
  SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS idx,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_words
  FROM rows WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT doc_id, idx, 1 AS k, line AS gram, n_words AS words FROM held
  UNION ALL
  SELECT doc_id, idx, 2, line || chr(10) || lead(line) OVER w, n_words + lead(n_words) OVER w
  FROM held WINDOW w AS (PARTITION BY doc_id ORDER BY idx)
  UNION ALL
  SELECT doc_id, idx, 3, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w, 50
  FROM held WINDOW w AS (PARTITION BY doc_id ORDER BY idx)
), late AS (
  SELECT doc_id, idx, k FROM (
    SELECT *, min(doc_id * 10000000 + idx) OVER (PARTITION BY k, gram) AS first FROM windows WHERE gram IS NOT NULL
  ) WHERE words >= 50 AND first < doc_id * 10000000 + idx
), gone AS (
  SELECT DISTINCT doc_id, idx + s AS idx FROM late, (SELECT unnest(range(0, 3)) AS s) WHERE s < k
), lost AS (
  SELECT doc_id, line_no FROM held JOIN gone USING (doc_id, idx)
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM rows ANTI JOIN lost USING (doc_id, line_no) GROUP BY doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM lost GROUP BY doc_id
)
SELECT doc_id, CAST(len(string_split(coalesce(documents.text, ''), chr(10))) AS BIGINT) AS n_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_removed_lines, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS width, array_to_string(words[i:i + 9], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), widths AS (
  SELECT DISTINCT width FROM item_windows
), doc_windows AS (
  SELECT doc_id, i, width, array_to_string(words[i:i + width - 1], ' ') AS gram
  FROM (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS i FROM d, widths WHERE len(words) >= width)
), found AS (
  SELECT doc_id, i, width, item_id FROM doc_windows JOIN item_windows USING (width, gram)
), hits AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, width FROM found), (SELECT unnest(range(0, 10)) AS k)
  WHERE k < width GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SPELLING_VARIANTS = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS step
  FROM (SELECT unnest(range(256)) AS b)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_key, run, count(*) AS n
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), spelled AS (
  SELECT run, n, hex(encode(doc_key || ':' || run)) AS code FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(length(code) // 2), lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, step[1 + (xor(c, x) & 255)])), 4294967295) AS h
  FROM spelled, crc_table
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word,
    CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), shortened AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM shortened a JOIN shortened b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shortened a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shortened a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM near
), judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (word)
), walk AS (
  SELECT word, word AS root FROM judged
  UNION ALL SELECT walk.word, judged.form FROM walk JOIN judged ON walk.root = judged.word WHERE judged.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM judged JOIN (SELECT walk.word, walk.root FROM walk JOIN judged ON walk.root = judged.word WHERE judged.form IS NULL) USING (word)
"""

RANKED_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), totals AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d
), postings AS (
  SELECT row_id, doc_id, n, term, count(*) AS tf
  FROM (SELECT row_id, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
), b AS (
  SELECT row_number() OVER () AS item_no, item_id,
    list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM benchmark
), asked AS (
  SELECT item_no, item_id, unnest(terms) AS term FROM b
), scored AS (
  SELECT item_no, item_id, row_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

SQL: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op3_minhash_near_dedup": NEAR_DEDUP,
    "op6_chat_formatting": CHAT_FORMATTING,
    "op7_quality_rules": QUALITY_RULES,
    "op9_benchmark_decontamination": DECONTAMINATION,
    "op10_line_dedup": LINE_DEDUP,
    "op12_spelling_variants": SPELLING_VARIANTS,
    "op13_ranked_lexical_search": RANKED_SEARCH,
}
