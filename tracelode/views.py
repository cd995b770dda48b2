"""Adapters: the driver's tables read as the library's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_requests_from(events: DataFrame) -> DataFrame:
    """Events in the nested shape of the request log, optional parts left null as logs have them."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    value = F.col("value")
    source = events.select("event_id", "ts", "user_id", "event_type", "value", "props", k.alias("k"))
    k = F.col("k")
    intent = (
        F.when(F.col("event_type") == "signup", "IMPLEMENT")
        .when(F.col("event_type") == "error", "DEBUG")
        .when(F.col("event_type") == "click", "SEARCH")
        .when(F.col("event_type") == "view", "EXPLAIN")
    )
    failed = F.col("event_type") == "error"
    return source.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.when(k % 10 != 9, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias(
            "conversation_key"
        ),
        F.when(k % 2 == 0, "small").otherwise("large").alias("model"),
        F.lit(None).cast("string").alias("backend_model"),
        (k % 2 == 0).alias("stream"),
        (k % 9 + 1).alias("n_messages"),
        F.concat_ws(" ", "event_type", "props").alias("last_user_message"),
        F.struct(
            F.when(k % 3 == 0, "assembled").when(k % 3 == 1, "empty").alias("status"),
            (k % 7 + k % 5).alias("symbols_selected"),
            (k % 7).alias("symbols_new"),
            (k % 5).alias("symbols_suppressed"),
            (k * 40).alias("estimated_tokens"),
            F.when(k % 4 != 3, F.lit(2048).cast("bigint")).alias("max_tokens"),
            F.lit(None).cast("string").alias("primary_symbol"),
        ).alias("context"),
        intent.alias("intent"),
        F.struct(
            F.when(k % 11 != 0, k * 1000).alias("prompt_tokens"),
            (k * 10).alias("completion_tokens"),
        ).alias("usage"),
        F.struct(
            value.alias("total_ms"),
            F.when(k % 2 == 0, value * 0.1).alias("ttft_ms"),
            F.when(k % 6 != 5, value * 0.1).alias("pipeline_ms"),
            F.when(k % 8 != 7, value * 0.9).alias("provider_wait_ms"),
            F.create_map(
                F.lit("provider"),
                value * 0.9,
                F.lit("planning"),
                value * 0.02,
                F.lit("repository_context"),
                value * 0.05,
            ).alias("stages"),
        ).alias("timing"),
        F.when(
            k % 5 != 0,
            F.struct(
                (k % 2 == 0).alias("cap_enabled"),
                (k % 4 == 0).alias("cap_applied"),
                (k * 100).alias("budget"),
                (k % 6).alias("dropped_count"),
                (k * 90).alias("tokens_after"),
            ),
        ).alias("history"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, F.concat(F.lit("failure code "), k.cast("string"))).alias("error"),
        F.lit(None).cast("string").alias("answer_preview"),
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_requests_from(table(spark, sf_dir, "events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelode.operators.sessions import clean_requests

    return clean_requests(raw_requests(spark, sf_dir))


# The same adapters for the check database, as leading CTEs of an oracle query.
REQUESTS_SQL = """
base AS (SELECT *, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events),
requests AS (
  SELECT 'r' || event_id AS request_id, ts,
    CASE WHEN k % 10 <> 9 THEN 'u' || user_id ELSE '__new__' END AS conversation_key,
    CASE WHEN k % 2 = 0 THEN 'small' ELSE 'large' END AS model,
    CASE event_type WHEN 'signup' THEN 'IMPLEMENT' WHEN 'error' THEN 'DEBUG'
      WHEN 'click' THEN 'SEARCH' WHEN 'view' THEN 'EXPLAIN' ELSE 'DEFAULT' END AS intent,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN event_type = 'error' THEN 'failure code ' || k END AS error,
    CASE k % 3 WHEN 0 THEN 'assembled' WHEN 1 THEN 'empty' ELSE 'disabled' END AS context_status,
    k % 7 + k % 5 AS symbols_selected, k % 7 AS symbols_new, k % 5 AS symbols_suppressed,
    k * 40 AS estimated_tokens, CASE WHEN k % 4 <> 3 THEN 2048 END AS max_tokens,
    CASE WHEN k % 11 <> 0 THEN k * 1000 END AS prompt_tokens, k * 10 AS completion_tokens,
    value AS total_ms, CASE WHEN k % 2 = 0 THEN value * 0.1::DOUBLE END AS ttft_ms,
    CASE WHEN k % 6 <> 5 THEN value * 0.1::DOUBLE END AS pipeline_ms,
    CASE WHEN k % 8 <> 7 THEN value * 0.9::DOUBLE END AS provider_wait_ms,
    value * 0.9::DOUBLE AS stage_provider, value * 0.02::DOUBLE AS stage_planning,
    value * 0.05::DOUBLE AS stage_context,
    k % 5 <> 0 AS has_history,
    k % 5 <> 0 AND k % 2 = 0 AS cap_enabled, k % 5 <> 0 AND k % 4 = 0 AS cap_applied,
    CASE WHEN k % 5 <> 0 THEN k * 100 ELSE 0 END AS budget,
    CASE WHEN k % 5 <> 0 THEN k % 6 ELSE 0 END AS dropped_count,
    CASE WHEN k % 5 <> 0 THEN k * 90 ELSE 0 END AS tokens_after,
    event_type || ' ' || props AS last_user_message, k, event_id, user_id, value
  FROM base)
"""


# --- conversations -----------------------------------------------------------------------------

# Openings put before user texts, by (conv_id * 3 + turn) % 8, so that every text rule is met.
USER_OPENINGS = (
    "<task>\nexplain how does it work </task> ",
    "[read_file for a.py] Result: ",
    "do not explain, please fix packages/core/app.py ",
    "same thing above ",
    "",
    "add tests for ProviderFactory and load_settings ",
    "<task> find </task> and <task>refactor plan</task> ",
    "for that never ",
)
TOOL_ARGUMENTS = '{"path": "x.py"}'


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with openings on user texts, and tool calls in every second conversation.

    Every sixth conversation reuses one call id for all its calls.
    """
    source = table(spark, sf_dir, "conversations")
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    opening = F.get(
        F.array(*[F.lit(o) for o in USER_OPENINGS]), ((conv * 3 + turn) % 8).cast("int")
    )
    called = (role == "assistant") & (turn % 4 == 1) & (conv % 2 == 0)
    answers = (role == "user") & (turn % 4 == 2) & (conv % 2 == 0)

    def call_id(at):
        return F.when(conv % 6 == 0, "c").otherwise(F.concat(F.lit("c"), at.cast("string")))

    call = F.struct(
        call_id(turn).alias("id"),
        F.struct(F.lit("read_file").alias("name"), F.lit(TOOL_ARGUMENTS).alias("arguments")).alias(
            "function"
        ),
    )
    return source.select(
        "conv_id",
        "turn",
        F.when(answers, "tool").otherwise(role).alias("role"),
        F.when(role == "user", F.concat(opening, "text")).otherwise(F.col("text")).alias("content"),
        F.lit(None).cast("array<struct<type:string,text:string>>").alias("content_parts"),
        F.when(role == "assistant", "helper").alias("name"),
        F.lit(None).cast("string").alias("reasoning_content"),
        F.when(called, F.array(call)).alias("tool_calls"),
        F.when(answers, call_id(turn - 1)).alias("tool_call_id"),
    )


def sent_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ranked symbols offered per conversation (user) and turn (day)."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conv_id"),
        F.dayofyear("ts").cast("bigint").alias("turn"),
        (F.col("event_id") % 5 + 1).alias("rank"),
        F.concat(F.lit("s"), (k % 20).cast("string")).alias("symbol"),
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_OPENINGS_SQL = " ".join(
    f"WHEN {i} THEN {_sql_text(opening)}" for i, opening in enumerate(USER_OPENINGS)
)
MESSAGES_SQL = f"""
messages AS (
  SELECT conv_id, turn,
    CASE WHEN role = 'user' AND turn % 4 = 2 AND conv_id % 2 = 0 THEN 'tool' ELSE role END AS role,
    CASE WHEN role = 'user' THEN CASE (conv_id * 3 + turn) % 8 {_OPENINGS_SQL} END || text
      ELSE text END AS content,
    CASE WHEN role = 'assistant' THEN 'helper' END AS name,
    CASE WHEN role = 'assistant' AND turn % 4 = 1 AND conv_id % 2 = 0
      THEN CASE WHEN conv_id % 6 = 0 THEN 'c' ELSE 'c' || turn END END AS call_id,
    CASE WHEN role = 'user' AND turn % 4 = 2 AND conv_id % 2 = 0
      THEN CASE WHEN conv_id % 6 = 0 THEN 'c' ELSE 'c' || (turn - 1) END END AS tool_call_id
  FROM conversations)
"""
SENT_SQL = """
sent AS (SELECT user_id AS conv_id, dayofyear(ts) AS turn, event_id % 5 + 1 AS rank,
  's' || (CAST(props::JSON->>'$.k' AS BIGINT) % 20) AS symbol FROM events)
"""


# --- repository graph --------------------------------------------------------------------------


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as code symbols: modules in tests, at the root and in a package; few short names."""
    key = F.col("p_partkey")
    folder = F.when(key % 10 == 0, "tests/").when(key % 10 == 1, "").otherwise("pkg/")
    kind = F.when(key % 4 == 0, "class").when(key % 4 == 2, "method").otherwise("function")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("n"), key.cast("string")).alias("qualified_name"),
        F.when(key % 50 == 1, "main").otherwise(F.translate("p_name", " ", "_")).alias("name"),
        kind.alias("symbol_type"),
        F.concat(folder, F.translate("p_brand", "#", ""), F.lit(".py")).alias("module"),
        F.col("p_size").cast("bigint").alias("lineno"),
        F.when(key % 20 == 2, F.array(F.lit("abstractmethod")))
        .otherwise(F.array().cast("array<string>"))
        .alias("decorators"),
        key.alias("load_order"),
    )


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of the symbols, and one empty package marker per customer segment."""
    owned = symbols(spark, sf_dir).select(F.col("module").alias("path"))
    markers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("pkg/"), F.lower("c_mktsegment"), F.lit("/__init__.py")).alias("path")
    )
    empty = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("pkg/empty/"), F.lower("n_name"), F.lit(".py")).alias("path")
    )
    return owned.union(markers).union(empty).distinct()


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as edges from part to supplier in one node space, some twice; some ends lie outside it."""
    number = F.col("l_linenumber") % 4
    kind = (
        F.when(number == 0, "calls").when(number == 1, "imports").when(number == 2, "inherits")
    ).otherwise("defines")
    outside = F.when(F.col("l_quantity") >= 49, "ext").otherwise("n")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("source"),
        F.concat(outside, F.col("l_suppkey").cast("string")).alias("target"),
        kind.alias("type"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of order lines, each once."""
    return edge_rows(spark, sf_dir).distinct()


def module_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges lifted to modules."""
    owner = symbols(spark, sf_dir).select("qualified_name", "module")
    imports = edges(spark, sf_dir).where(F.col("type") == "imports")
    left = imports.join(owner, imports["source"] == owner["qualified_name"]).select(
        F.col("module").alias("source"), "target"
    )
    right = left.join(owner, left["target"] == owner["qualified_name"])
    return right.select("source", F.col("module").alias("target")).distinct()


def call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a sparse call graph: chains of four, some closed to rings, hung in a tree.

    Node c calls c + 1 inside its block of four; the last of a block calls the first when its
    nation is even; the first of a block calls node c / 4 - 1 of another block.
    """
    c = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    step = customers.where((c % 4 != 3)).select(c.alias("source"), (c + 1).alias("target"))
    ids = customers.select(c.alias("target"))
    step = step.join(ids, "target", "left_semi").select("source", "target")
    close = customers.where((c % 4 == 3) & (F.col("c_nationkey") % 2 == 0)).select(
        c.alias("source"), (c - 3).alias("target")
    )
    parent = customers.where((c % 4 == 0) & (c >= 8)).select(
        c.alias("source"), (F.floor(c / 4) - 1).alias("target")
    )
    return step.union(close).union(parent).select(
        "source", "target", F.lit("calls").alias("type")
    )


def call_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))


GRAPH_SQL = """
symbols AS (SELECT 'n' || p_partkey AS qualified_name,
  CASE WHEN p_partkey % 50 = 1 THEN 'main' ELSE replace(p_name, ' ', '_') END AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 2 THEN 'method' ELSE 'function' END AS symbol_type,
  CASE p_partkey % 10 WHEN 0 THEN 'tests/' WHEN 1 THEN '' ELSE 'pkg/' END || replace(p_brand, '#', '') || '.py' AS module,
  p_size::BIGINT AS lineno, p_partkey % 20 = 2 AS is_abstract, p_partkey FROM part),
modules AS (SELECT module AS path FROM symbols
  UNION SELECT 'pkg/' || lower(c_mktsegment) || '/__init__.py' FROM customer
  UNION SELECT 'pkg/empty/' || lower(n_name) || '.py' FROM nation),
edges AS (SELECT DISTINCT 'n' || l_partkey AS source,
  CASE WHEN l_quantity >= 49 THEN 'ext' ELSE 'n' END || l_suppkey AS target,
  CASE l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'inherits' ELSE 'defines' END AS type
  FROM lineitem),
module_imports AS (SELECT DISTINCT a.module AS source, b.module AS target FROM edges e
  JOIN symbols a ON a.qualified_name = e.source JOIN symbols b ON b.qualified_name = e.target
  WHERE e.type = 'imports')
"""
CHAIN_SQL = """
chain AS (
  SELECT c_custkey AS source, c_custkey + 1 AS target FROM customer
    WHERE c_custkey % 4 <> 3 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT c_custkey, c_custkey - 3 FROM customer WHERE c_custkey % 4 = 3 AND c_nationkey % 2 = 0
  UNION ALL SELECT c_custkey, c_custkey // 4 - 1 FROM customer WHERE c_custkey % 4 = 0 AND c_custkey >= 8)
"""


# --- source files ------------------------------------------------------------------------------

FILE_SUFFIXES = (".py", ".PY", ".js", ".md", ".bashrc", ".txt", "", "_test.py")
FILE_FOLDERS = ("pkg", "tests", "node_modules/x", "build", "docs/.hidden", "pkg/__pycache__", "lib/gen")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a source tree, path made of folder, language, source and id."""
    key = F.col("doc_id")
    folder = F.get(F.array(*[F.lit(f) for f in FILE_FOLDERS]), (key % len(FILE_FOLDERS)).cast("int"))
    suffix = F.get(F.array(*[F.lit(s) for s in FILE_SUFFIXES]), (key % len(FILE_SUFFIXES)).cast("int"))
    stem = F.concat(F.col("source"), F.lit("_"), key.cast("string"))
    return table(spark, sf_dir, "documents").select(
        F.concat(folder, F.lit("/"), "lang", F.lit("/"), stem, suffix).alias("relative_path"),
        F.col("n_chars").alias("size_bytes"),
    )


_FOLDERS_SQL = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FILE_FOLDERS))
_SUFFIX_SQL = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(FILE_SUFFIXES))
_LANGUAGE_SQL = (
    "CASE WHEN extension IN ('.py') THEN 'Python' WHEN extension = '.js' THEN 'JavaScript' "
    "WHEN extension = '.md' THEN 'Markdown' WHEN extension = '.bashrc' THEN 'Shell' ELSE 'Unknown' END"
)
FILES_SQL = f"""
named AS (SELECT CASE doc_id % {len(FILE_FOLDERS)} {_FOLDERS_SQL} END || '/' || lang AS directory,
  source || '_' || doc_id || CASE doc_id % {len(FILE_SUFFIXES)} {_SUFFIX_SQL} END AS name,
  n_chars AS size_bytes FROM documents),
suffixed AS (SELECT directory || '/' || name AS path, name, directory, size_bytes,
  CASE WHEN contains(name, '.') THEN '.' || split_part(name, '.', 2) ELSE '' END AS extension FROM named),
inventory AS (SELECT *, {_LANGUAGE_SQL} AS language FROM suffixed)
"""


# --- retrieval ---------------------------------------------------------------------------------


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as code symbols with text: packages by type and brand, some private, stubs and tests."""
    key = F.col("p_partkey")
    kind, short = F.lower("p_type"), F.translate("p_name", " ", "_")
    module = F.when(key % 17 == 0, F.concat(F.lit("tests/test_"), kind)).otherwise(
        F.concat(kind, F.lit("/"), F.lower(F.translate("p_brand", "#", "_")))
    )
    name = (
        F.when(key % 13 == 0, F.concat(F.lit("_"), short))
        .when(key % 19 == 0, F.concat(F.lit("stub_"), short))
        .otherwise(F.concat(short, F.lit("_"), (key % 7).cast("string")))
    )
    scope = F.when(key % 3 == 0, "Holder.").when(key % 3 == 1, "RingBox.").otherwise("")
    code = F.when(key % 4 == 0, "class").when(key % 4 == 1, "function").when(key % 4 == 2, "method").otherwise("constant")
    # The table is one row group. Its short rows are dealt out before they grow, so that all cores work on the texts.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(
        key.alias("symbol_id"),
        F.concat(module, F.lit("."), scope, name).alias("qualified_name"),
        module.alias("module"),
        code.alias("symbol_type"),
        F.concat(module, F.lit(".py")).alias("path"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Doc of "), "p_name")).alias("docstring"),
        F.repeat(F.lit("value = compute(1)\n"), F.col("p_size") * 4).alias("source"),
        F.concat(F.lit("def "), short, F.lit("()")).alias("signature"),
        (key % 23 == 0).alias("in_init"),
    )


def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark item, worded after the part of the same number."""
    key = F.col("item_id")
    kind = key % 5
    words = (
        F.when(kind == 0, F.concat_ws(" ", F.lit("where is"), "p_name", F.lit("in"), "p_type"))
        .when(kind == 1, F.concat(F.lit("explain "), F.translate("p_name", " ", "_"), F.lit(" for brand_1")))
        .when(kind == 2, F.concat(F.lit("tests for "), "p_name"))
        .when(kind == 3, F.concat(F.lit("compare economy/brand_1.py with "), F.lower("p_type"), F.lit("/brand_2.py")))
        .otherwise(F.concat_ws(" ", F.lit("shared helper for brand"), "p_name", "p_type"))
    )
    items = table(spark, sf_dir, "benchmark").select("item_id")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_type")
    return items.join(parts, "item_id").select(
        key.alias("query_id"),
        words.alias("text"),
        (key % 16 + 5).alias("max_symbols"),
        (key % 4 + 2).alias("max_modules"),
        (key * 50 + 300).alias("max_tokens"),
    )


def named_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as edges between the retrieval symbols."""
    names = candidates(spark, sf_dir).select("symbol_id", "qualified_name")
    number = F.col("l_linenumber") % 4
    kind = F.when(number == 0, "calls").when(number == 1, "imports").when(number == 2, "inherits").otherwise("defines")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", kind.alias("type")).distinct()
    left = names.select(F.col("symbol_id").alias("l_partkey"), F.col("qualified_name").alias("source"))
    right = names.select(F.col("symbol_id").alias("l_suppkey"), F.col("qualified_name").alias("target"))
    return lines.join(left, "l_partkey").join(right, "l_suppkey").select("source", "target", "type").distinct()


def retrieval_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, imported) between the retrieval symbols' modules."""
    homes = candidates(spark, sf_dir).select("symbol_id", "module")
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 4 == 1)
    lines = lines.select("l_partkey", "l_suppkey").distinct()
    left = homes.select(F.col("symbol_id").alias("l_partkey"), "module")
    right = homes.select(F.col("symbol_id").alias("l_suppkey"), F.col("module").alias("imported"))
    pairs = lines.join(left, "l_partkey").join(right, "l_suppkey").select("module", "imported")
    return pairs.where(F.col("module") != F.col("imported")).distinct()


CANDIDATES_SQL = """
c0 AS (SELECT *, lower(p_type) AS kind, replace(p_name, ' ', '_') AS short,
  CASE WHEN p_partkey % 17 = 0 THEN 'tests/test_' || lower(p_type)
    ELSE lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) END AS module FROM part),
cand AS (SELECT p_partkey AS symbol_id, module || '.' || CASE p_partkey % 3 WHEN 0 THEN 'Holder.' WHEN 1 THEN 'RingBox.' ELSE '' END
  || CASE WHEN p_partkey % 13 = 0 THEN '_' || short WHEN p_partkey % 19 = 0 THEN 'stub_' || short
    ELSE short || '_' || (p_partkey % 7) END AS qualified_name, module,
  CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'constant' END AS symbol_type,
  CASE WHEN p_size % 3 = 0 THEN 'Doc of ' || p_name END AS docstring,
  repeat('value = compute(1)' || chr(10), p_size * 4) AS source, p_size * 4 AS n_lines,
  'def ' || short || '()' AS signature, p_partkey % 23 = 0 AS in_init FROM c0),
query AS (SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN 'where is ' || p_name || ' in ' || p_type
  WHEN 1 THEN 'explain ' || replace(p_name, ' ', '_') || ' for brand_1' WHEN 2 THEN 'tests for ' || p_name
  WHEN 3 THEN 'compare economy/brand_1.py with ' || lower(p_type) || '/brand_2.py'
  ELSE 'shared helper for brand ' || p_name || ' ' || p_type END AS text,
  item_id % 16 + 5 AS max_symbols, item_id % 4 + 2 AS max_modules, item_id * 50 + 300 AS max_tokens
  FROM benchmark JOIN part ON p_partkey = item_id),
named_edges AS (SELECT DISTINCT a.qualified_name AS source, b.qualified_name AS target,
  CASE l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'inherits' ELSE 'defines' END AS type
  FROM lineitem JOIN cand a ON a.symbol_id = l_partkey JOIN cand b ON b.symbol_id = l_suppkey),
mod_imports AS (SELECT DISTINCT a.module, b.module AS imported FROM lineitem JOIN cand a ON a.symbol_id = l_partkey
  JOIN cand b ON b.symbol_id = l_suppkey WHERE l_linenumber % 4 = 1 AND a.module <> b.module)
"""
