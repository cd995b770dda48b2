"""Conversation and text queries over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode import views
from tracelode.functions import rules, text
from tracelode.operators import conversations as conv
from tracelode.plans.registry import query

WITH = "WITH " + views.MESSAGES_SQL
BUDGET = 120

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TOOL_START = " OR ".join(
    f"starts_with(ltrim(text), {views._sql_text(p)})" for p in text.TOOL_RESULT_PREFIXES
)
_FOLLOW = " OR ".join(
    [f"starts_with(lower(last_task), {views._sql_text(p)})" for p in text.FOLLOW_UP_PREFIXES]
    + [f"contains(lower(last_task), {views._sql_text(p)})" for p in text.FOLLOW_UP_MARKERS]
)
USERS_SQL = f"""
users AS (SELECT * FROM (SELECT conv_id, turn, {STRIP.format('content')} AS text FROM messages
  WHERE role = 'user') WHERE text <> '')
"""
TASKS_SQL = rf"""{USERS_SQL},
bodied AS (SELECT conv_id, turn, text, ({_TOOL_START}) AS from_tool,
  list_filter(list_transform(regexp_extract_all(text, '(?s)<task>\s*(.*?)\s*</task>', 1),
    lambda b: {STRIP.format('b')}), lambda b: b <> '') AS bodies FROM users),
kinds AS (SELECT conv_id, bool_or(NOT from_tool AND len(bodies) > 0) AS any_task,
  bool_or(NOT from_tool) AS any_plain FROM bodied GROUP BY conv_id),
tasks AS (
  SELECT conv_id, turn, unnest(range(len(picked))) AS part, unnest(picked) AS text FROM (
    SELECT b.conv_id, turn, CASE WHEN any_task THEN CASE WHEN from_tool THEN []::VARCHAR[] ELSE bodies END
      WHEN NOT from_tool OR NOT any_plain THEN [text] ELSE []::VARCHAR[] END AS picked
    FROM bodied b JOIN kinds k ON b.conv_id = k.conv_id))
"""
LAST_SQL = f"""{TASKS_SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, part DESC) AS nth FROM tasks),
pairs AS (SELECT conv_id, max(text) FILTER (nth = 1) AS last_task, max(text) FILTER (nth = 2) AS previous
  FROM placed WHERE nth <= 2 GROUP BY conv_id)
"""


@query("content_text", WITH + "SELECT conv_id, turn, content AS text FROM messages")
def _content_text(spark, sf_dir):
    parts = F.array(
        F.struct(F.lit("text").alias("type"), F.col("content").alias("text")),
        F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
    )
    listed = views.messages(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 2 == 0, F.col("content")).alias("content"),
        F.when(F.col("turn") % 2 == 1, parts).alias("content_parts"),
    )
    return conv.with_text(listed).select("conv_id", "turn", "text")


@query("user_texts", f"{WITH}, {USERS_SQL} SELECT conv_id, turn, text FROM users")
def _user_texts(spark, sf_dir):
    return conv.user_texts(views.messages(spark, sf_dir))


@query("task_texts", f"{WITH}, {TASKS_SQL} SELECT conv_id, turn, part, text FROM tasks")
def _task_texts(spark, sf_dir):
    return conv.task_texts(views.messages(spark, sf_dir)).withColumn("part", F.col("part").cast("bigint"))


@query("last_task", f"{WITH}, {LAST_SQL} SELECT conv_id, last_task FROM pairs")
def _last_task(spark, sf_dir):
    return conv.last_tasks(views.messages(spark, sf_dir)).select("conv_id", "last_task")


@query(
    "context_query",
    rf"""{WITH}, {LAST_SQL} SELECT conv_id, CASE WHEN previous IS NOT NULL AND ({_FOLLOW})
    THEN previous || chr(10) || chr(10) || last_task ELSE last_task END AS query FROM pairs""",
)
def _context_query(spark, sf_dir):
    return conv.last_tasks(views.messages(spark, sf_dir)).select("conv_id", "query")


TOKENS_SQL = f"""
counted AS (SELECT *, length(content) // 4 + coalesce(length(name) // 4, 0)
  + CASE WHEN call_id IS NOT NULL THEN {len('read_file')} // 4 + {len(views.TOOL_ARGUMENTS)} // 4 ELSE 0 END
  AS tokens FROM messages)
"""


@query("token_estimate", f"{WITH}, {TOKENS_SQL} SELECT conv_id, turn, tokens FROM counted")
def _token_estimate(spark, sf_dir):
    return conv.message_tokens(views.messages(spark, sf_dir)).select("conv_id", "turn", "tokens")


@query(
    "truncate_tool_result",
    f"""{WITH}, last AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS last_user FROM messages GROUP BY 1)
    SELECT m.conv_id, turn, CASE WHEN turn = last_user AND ({_TOOL_START.replace('text', 'content')})
      AND length(content) > 100
      THEN left(content, 100 - {len(text.TRUNCATION_MARKER)}) || {views._sql_text(text.TRUNCATION_MARKER)}
      ELSE content END AS text
    FROM messages m JOIN last l ON m.conv_id = l.conv_id""",
)
def _truncate(spark, sf_dir):
    return conv.truncate_tool_result(views.messages(spark, sf_dir), 25).select("conv_id", "turn", "text")


def _intent_sql() -> str:
    word = r"[\p{L}\p{N}_]"
    ranks = [
        rf"WHEN regexp_matches(c, '(^|[^\p{{L}}\p{{N}}_])refactor(ing)?\s+(investigation|plan|recommendation|analysis)($|[^\p{{L}}\p{{N}}_])') THEN 'REFACTOR:refactor'",
        rf"WHEN regexp_matches(c, '(^|[^\p{{L}}\p{{N}}_])(implementation\s+task|modify\s+files)($|[^\p{{L}}\p{{N}}_])') THEN 'IMPLEMENT:implement'",
    ]
    for intent, keyword in rules.KEYWORD_ORDER:
        test = (
            f"contains(c, '{keyword}')" if " " in keyword else f"list_contains(words, '{keyword}')"
        )
        ranks.append(f"WHEN {test} THEN '{intent}:{keyword}'")
    return rf"""{WITH}, {TASKS_SQL},
    joined AS (SELECT conv_id, string_agg(lower(text), ' ' ORDER BY turn, part) AS c0 FROM tasks GROUP BY conv_id),
    cleaned AS (SELECT conv_id, regexp_replace(c0,
      '(^|[^\p{{L}}\p{{N}}_])(?:do\s+not|don''t|dont|never)\s+{word}+', '\1 ', 'g') AS c FROM joined),
    worded AS (SELECT conv_id, c, regexp_extract_all(c, '{word}+') AS words FROM cleaned),
    hit AS (SELECT conv_id, CASE {' '.join(ranks)} ELSE 'DEFAULT:' END AS h FROM worded)
    SELECT conv_id, split_part(h, ':', 1) AS intent, split_part(h, ':', 2) AS keyword FROM hit"""


@query("intent_label", _intent_sql())
def _intent_label(spark, sf_dir):
    return conv.intent_label(views.messages(spark, sf_dir))


def _profile_sql() -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(t, '{p}')" for p in patterns) + f" THEN '{profile}'"
        for _, profile, patterns in rules.PROFILE_RULES
    )
    return f"""{WITH}, {LAST_SQL}, lowered AS (SELECT conv_id, lower(last_task) AS t FROM pairs)
    SELECT conv_id, CASE {cases} ELSE 'DEFAULT' END AS profile FROM lowered"""


@query("retrieval_profile", _profile_sql())
def _retrieval_profile(spark, sf_dir):
    tasks = conv.last_tasks(views.messages(spark, sf_dir))
    return tasks.select("conv_id", rules.retrieval_profile(F.col("last_task")).alias("profile"))


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in (*text.STOP_WORDS, *text.CODE_WORDS)) + "]"
TOKENISE_SQL = rf"""
raws AS (SELECT id, t, regexp_extract_all(t, '[a-zA-Z0-9_]+') AS raw FROM source),
formed AS (SELECT id, t, raw, list_transform(flatten(list_transform(raw, lambda w: list_concat([w],
  list_concat(list_filter(string_split(w, '_'), lambda p: p <> ''),
  regexp_extract_all(w, '[A-Z][a-z0-9]*|[A-Z]+|[a-z0-9]+'))))), lambda f: lower(f)) AS forms FROM raws),
useful AS (SELECT id, t, raw, list_filter(forms, lambda f, i: list_position(forms, f) = i
  AND NOT list_contains({_STOP_SQL}, f) AND length(f) > 1) AS kept FROM formed),
plain AS (SELECT *, list_filter(string_split_regex(lower(t), '\s+'), lambda w: w <> '') AS p FROM useful),
tokenised AS (SELECT id, CASE WHEN len(kept) > 0 THEN kept
  WHEN len(raw) > 0 THEN list_filter(p, lambda w, i: list_position(p, w) = i)
  ELSE []::VARCHAR[] END AS tokens FROM plain)
"""


@query(
    "query_tokens",
    f"""{WITH}, source AS (SELECT conv_id * 1000 + turn AS id, content AS t FROM messages WHERE role = 'user'),
    {TOKENISE_SQL} SELECT id, array_to_string(tokens, '|') AS tokens FROM tokenised""",
)
def _query_tokens(spark, sf_dir):
    users = views.messages(spark, sf_dir).where(F.col("role") == "user")
    return users.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.array_join(text.query_tokens(F.col("content")), "|").alias("tokens"),
    )


@query(
    "query_normalise",
    rf"""{WITH} SELECT conv_id, turn, regexp_replace({STRIP.format('content')}, '\s+', ' ', 'g') AS text,
    greatest(turn - 3, 0) AS max_symbols FROM messages""",
)
def _query_normalise(spark, sf_dir):
    return views.messages(spark, sf_dir).select(
        "conv_id",
        "turn",
        text.normalise_query(F.col("content")).alias("text"),
        text.clamp_limit(F.col("turn") - 3).alias("max_symbols"),
    )


@query(
    "module_refs",
    rf"""{WITH} SELECT conv_id, turn, array_to_string(list_transform(
      regexp_extract_all(content, '[\p{{L}}\p{{N}}_./\\-]+\.py'),
      lambda m: left(m, length(m) - 3)), '|') AS refs FROM messages""",
)
def _module_refs(spark, sf_dir):
    refs = text.module_refs(F.col("content"))
    return views.messages(spark, sf_dir).select("conv_id", "turn", F.array_join(refs, "|").alias("refs"))


@query(
    "import_refs",
    """SELECT p_partkey, CASE p_partkey % 3
      WHEN 0 THEN lower(p_type) || '/' || replace(p_name, ' ', '_')
      WHEN 1 THEN lower(p_type) || '|' || replace(p_name, ' ', '/') ELSE '' END AS refs FROM part""",
)
def _import_refs(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    kind, name = F.lower("p_type"), F.col("p_name")
    statement = (
        F.when(
            F.col("p_partkey") % 3 == 0,
            F.concat(F.lit("from "), kind, F.lit("."), F.translate(name, " ", "_"), F.lit(" import x, y")),
        )
        .when(
            F.col("p_partkey") % 3 == 1,
            F.concat(F.lit("import "), kind, F.lit(" as a, "), F.translate(name, " ", ".")),
        )
        .otherwise(F.concat(F.lit("# imports "), name))
    )
    return part.select("p_partkey", F.array_join(text.import_refs(statement), "|").alias("refs"))


GROUPS_SQL = """
ends AS (SELECT conv_id, turn, call_id AS id, true AS is_call FROM messages WHERE call_id IS NOT NULL
  UNION ALL SELECT conv_id, turn, tool_call_id, false FROM messages WHERE tool_call_id IS NOT NULL),
bounds AS (SELECT conv_id, id, min(turn) FILTER (is_call) AS first_call,
  max(turn) FILTER (NOT is_call) AS last_result FROM ends GROUP BY 1, 2),
grouped AS (SELECT m.*, coalesce(b.first_call, m.turn) AS group_turn FROM messages m
  LEFT JOIN bounds b ON b.conv_id = m.conv_id AND b.first_call < b.last_result
    AND ((m.call_id = b.id AND m.turn < b.last_result) OR (m.tool_call_id = b.id AND m.turn > b.first_call)))
"""


@query("tool_groups", f"{WITH}, {GROUPS_SQL} SELECT conv_id, turn, group_turn FROM grouped")
def _tool_groups(spark, sf_dir):
    return conv.tool_groups(views.messages(spark, sf_dir))


CAP_SQL = f"""{GROUPS_SQL}, {TOKENS_SQL},
last AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS last_user FROM messages GROUP BY 1),
marked AS (SELECT g.conv_id, g.turn, g.role, c.tokens, g.group_turn,
  g.role = 'system' OR coalesce(g.turn = l.last_user, false) AS always
  FROM grouped g JOIN counted c ON c.conv_id = g.conv_id AND c.turn = g.turn JOIN last l ON l.conv_id = g.conv_id),
sizes AS (SELECT conv_id, group_turn, sum(tokens) AS t, max(turn) AS newest FROM marked WHERE NOT always GROUP BY 1, 2),
spent AS (SELECT conv_id, group_turn, sum(t) OVER (PARTITION BY conv_id ORDER BY newest DESC) AS spent FROM sizes),
capped AS (SELECT m.conv_id, m.turn, m.role, m.tokens, always OR s.spent <= {BUDGET} AS kept
  FROM marked m LEFT JOIN spent s ON s.conv_id = m.conv_id AND s.group_turn = m.group_turn)
"""


@query("history_cap", f"{WITH}, {CAP_SQL} SELECT conv_id, turn, role, tokens, kept FROM capped")
def _history_cap(spark, sf_dir):
    return conv.history_cap(views.messages(spark, sf_dir), BUDGET).drop("group_turn")


@query(
    "history_cap_summary",
    f"""{WITH}, {CAP_SQL} SELECT conv_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped,
    sum(CASE WHEN kept THEN tokens ELSE 0 END)::BIGINT AS tokens_after FROM capped GROUP BY conv_id""",
)
def _history_cap_summary(spark, sf_dir):
    return conv.history_cap_summary(conv.history_cap(views.messages(spark, sf_dir), BUDGET))


@query(
    "cap_budget",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 500
      WHEN p_size * 300 - CASE WHEN p_partkey % 3 = 0 THEN 2048 ELSE 1000 END - 1536 > 0
      THEN p_size * 300 - CASE WHEN p_partkey % 3 = 0 THEN 2048 ELSE 1000 END - 1536 END AS budget FROM part""",
)
def _cap_budget(spark, sf_dir):
    override = F.when(F.col("p_partkey") % 4 == 0, 500).otherwise(0)
    asked = F.when(F.col("p_partkey") % 3 != 0, 1000)
    budget = conv.cap_budget(override, F.col("p_size") * 300, asked)
    return views.table(spark, sf_dir, "part").select("p_partkey", budget.alias("budget"))


_KEYS_SQL = """, users AS (SELECT conv_id, turn, (row_number() OVER w - 1) || chr(0) || content || chr(0) AS piece
    FROM messages WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  prefixed AS (SELECT conv_id, turn,
    string_agg(piece, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
    string_agg(piece, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM users WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(
    "conversation_key",
    f"""{WITH}{_KEYS_SQL} SELECT conv_id, turn,
    CASE WHEN earlier IS NULL THEN '__new__' ELSE sha256(earlier) END AS conversation_key FROM prefixed""",
)
def _conversation_key(spark, sf_dir):
    keys = conv.conversation_keys(views.messages(spark, sf_dir))
    return keys.select("conv_id", "turn", "conversation_key")


@query("store_key", f"{WITH}{_KEYS_SQL} SELECT conv_id, turn, sha256(upto) AS store_key FROM prefixed")
def _store_key(spark, sf_dir):
    return conv.conversation_keys(views.messages(spark, sf_dir)).select("conv_id", "turn", "store_key")


_DELTA_SQL = f"""WITH {views.SENT_SQL},
once AS (SELECT conv_id, turn, symbol, min(rank) AS rank FROM sent GROUP BY 1, 2, 3),
marked AS (SELECT *, rank = 1 OR turn = min(turn) OVER (PARTITION BY conv_id, symbol) AS kept FROM once)
"""


@query("delta_suppress", f"{_DELTA_SQL} SELECT conv_id, turn, rank, symbol, kept FROM marked")
def _delta_suppress(spark, sf_dir):
    return conv.delta_suppress(views.sent_symbols(spark, sf_dir))


@query(
    "delta_counts",
    f"""{_DELTA_SQL} SELECT conv_id, turn, count(*) FILTER (kept) AS symbols_new,
    count(*) FILTER (NOT kept) AS symbols_suppressed FROM marked GROUP BY 1, 2""",
)
def _delta_counts(spark, sf_dir):
    return conv.delta_counts(conv.delta_suppress(views.sent_symbols(spark, sf_dir)))


@query(
    "turn_redundancy",
    f"""WITH {views.SENT_SQL}, once AS (SELECT DISTINCT conv_id, turn, symbol FROM sent),
    flagged AS (SELECT *, turn = min(turn) OVER (PARTITION BY conv_id, symbol) AS fresh FROM once),
    turns AS (SELECT conv_id, turn, count(*) AS symbols, count(*) FILTER (fresh) AS new_symbols FROM flagged GROUP BY 1, 2),
    run AS (SELECT *, (sum(symbols) OVER w)::BIGINT AS total_symbols, (sum(new_symbols) OVER w)::BIGINT AS total_new
      FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT *, round((total_symbols - total_new) * 100.0::DOUBLE / total_symbols, 6) AS redundancy_pct FROM run""",
)
def _turn_redundancy(spark, sf_dir):
    return conv.turn_redundancy(views.sent_symbols(spark, sf_dir))


@query(
    "valid_messages",
    f"""{WITH} SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'missing content'
    WHEN role NOT IN ('system', 'user', 'assistant') THEN 'invalid role' END AS reject_reason FROM messages""",
)
def _valid_messages(spark, sf_dir):
    content = F.when(F.col("turn") % 5 != 4, F.col("content"))
    rows = views.messages(spark, sf_dir).withColumn("content", content)
    return conv.valid_messages(rows).select("conv_id", "turn", "reject_reason")
