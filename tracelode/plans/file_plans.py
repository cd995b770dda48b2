"""File inventory and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode import views
from tracelode.functions import rules
from tracelode.operators import catalogs
from tracelode.plans.registry import query
from tracelode.sources import files as src

WITH = "WITH " + views.FILES_SQL
PATTERNS = ("docs/", "*.txt", "**/lib", "/pkg/de", "src1*.md")


def _inventory(spark, sf_dir):
    return src.file_inventory(views.files(spark, sf_dir))


@query("file_inventory", f"{WITH} SELECT path, name, extension, language, directory, size_bytes FROM inventory")
def _file_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir)


@query("language_detect", f"{WITH} SELECT extension, language, count(*) AS n FROM inventory GROUP BY 1, 2")
def _language_detect(spark, sf_dir):
    return _inventory(spark, sf_dir).groupBy("extension", "language").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ignore_filter",
    rf"""{WITH} SELECT path FROM inventory WHERE NOT regexp_matches(path, '(^|/)(node_modules|build|__pycache__)/')
    AND NOT starts_with(path, 'docs/') AND NOT ends_with(path, '.txt') AND NOT starts_with(path, 'lib/')
    AND NOT starts_with(path, 'pkg/de/') AND NOT regexp_matches(name, '^src1.*\.md$')""",
)
def _ignore_filter(spark, sf_dir):
    return src.ignore_filter(_inventory(spark, sf_dir), PATTERNS).select("path")


@query(
    "module_filter",
    rf"""{WITH}, judged AS (SELECT CASE WHEN NOT ends_with(path, '.py') THEN 'not python'
      WHEN contains(path, '/.hidden') OR contains(path, '/__pycache__') THEN 'hidden'
      WHEN ends_with(name, '_test.py') THEN 'test'
      WHEN starts_with(path, 'lib/gen/') THEN 'excluded' ELSE 'kept' END AS outcome FROM inventory)
    SELECT outcome, count(*) AS files FROM judged GROUP BY 1""",
)
def _module_filter(spark, sf_dir):
    filtered = src.module_filter(_inventory(spark, sf_dir), exclude_tests=True, globs=("lib/gen*",))
    return src.module_filter_counts(filtered)


@query(
    "files_by_extension",
    f"{WITH} SELECT path, size_bytes FROM inventory WHERE lower(extension) = '.py'",
)
def _by_extension(spark, sf_dir):
    return src.files_by_extension(_inventory(spark, sf_dir), "PY").select("path", "size_bytes")


@query("files_by_language", f"{WITH} SELECT path, size_bytes FROM inventory WHERE language = 'Python'")
def _by_language(spark, sf_dir):
    return src.files_by_language(_inventory(spark, sf_dir), "Python").select("path", "size_bytes")


@query("file_lookup", f"{WITH} SELECT path, language, size_bytes FROM inventory WHERE path = 'pkg/fr/src0_0.py'")
def _lookup(spark, sf_dir):
    return src.file_lookup(_inventory(spark, sf_dir), "pkg/fr/src0_0.py").select(
        "path", "language", "size_bytes"
    )


@query(
    "file_statistics",
    f"""{WITH} SELECT language, count(*) AS file_count, sum(size_bytes)::BIGINT AS total_size_bytes
    FROM inventory GROUP BY language""",
)
def _file_statistics(spark, sf_dir):
    return src.language_summary(_inventory(spark, sf_dir))


@query(
    "file_totals",
    f"""{WITH} SELECT count(*) AS files, sum(size_bytes)::BIGINT AS total_size_bytes,
    count(DISTINCT directory) AS directories FROM inventory""",
)
def _file_totals(spark, sf_dir):
    return src.file_totals(_inventory(spark, sf_dir))


@query("largest_files", f"{WITH} SELECT path, size_bytes FROM inventory ORDER BY size_bytes DESC, path LIMIT 10")
def _largest_files(spark, sf_dir):
    return src.largest_files(_inventory(spark, sf_dir))


@query("directory_counts", f"{WITH} SELECT directory, count(*) AS file_count FROM inventory GROUP BY 1")
def _directory_counts(spark, sf_dir):
    return src.directory_counts(_inventory(spark, sf_dir))


# --- catalogues --------------------------------------------------------------------------------

CATALOG_SQL = """
catalog AS (SELECT s_suppkey AS entry,
  CASE WHEN s_suppkey % 19 = 3 THEN NULL ELSE 'm' || (s_suppkey % 70) END AS model,
  CASE s_nationkey % 4 WHEN 0 THEN 'vllm' WHEN 1 THEN 'openai' WHEN 2 THEN 'other' END AS provider,
  'http://h' || s_nationkey AS base_url,
  CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'b' || s_suppkey END AS backend_model,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey - 10 END AS context_window
  FROM supplier)
"""


def _catalog(spark, sf_dir):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    provider = F.when(nation % 4 == 0, "vllm").when(nation % 4 == 1, "openai").when(nation % 4 == 2, "other")
    return views.table(spark, sf_dir, "supplier").select(
        key.alias("entry"),
        F.when(key % 19 != 3, F.concat(F.lit("m"), (key % 70).cast("string"))).alias("model"),
        provider.alias("provider"),
        F.concat(F.lit("http://h"), nation.cast("string")).alias("base_url"),
        F.lit(None).cast("string").alias("api_key"),
        F.lit(None).cast("double").alias("timeout"),
        F.when(key % 2 != 0, F.concat(F.lit("b"), key.cast("string"))).alias("backend_model"),
        F.when(key % 3 != 0, key - 10).alias("context_window"),
        F.lit(None).cast("bigint").alias("max_output_tokens"),
    )


@query(
    "model_catalog_checks",
    f"""WITH {CATALOG_SQL} SELECT entry, 'missing model' AS problem FROM catalog WHERE model IS NULL
    UNION ALL SELECT entry, 'missing provider' FROM catalog WHERE provider IS NULL
    UNION ALL SELECT entry, 'unknown provider' FROM catalog WHERE provider NOT IN ('vllm', 'openai')
    UNION ALL SELECT entry, 'context_window not positive' FROM catalog WHERE context_window <= 0
    UNION ALL SELECT entry, 'duplicate model' FROM catalog c WHERE EXISTS
      (SELECT 1 FROM catalog d WHERE d.model = c.model AND d.entry < c.entry)""",
)
def _catalog_checks(spark, sf_dir):
    return catalogs.model_catalog_checks(_catalog(spark, sf_dir), ("vllm", "openai"))


@query(
    "backend_groups",
    f"""WITH {CATALOG_SQL} SELECT provider, base_url, count(DISTINCT model) AS models, min(model) AS first_model
    FROM catalog GROUP BY 1, 2""",
)
def _backend_groups(spark, sf_dir):
    return catalogs.backend_groups(_catalog(spark, sf_dir)).drop("api_key", "timeout")


@query(
    "backend_models",
    f"WITH {CATALOG_SQL} SELECT DISTINCT provider, base_url, model FROM catalog WHERE model IS NOT NULL",
)
def _backend_models(spark, sf_dir):
    return catalogs.backend_models(_catalog(spark, sf_dir)).drop("api_key", "timeout")


def _capability_values() -> str:
    cells = lambda row: ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row)
    rows = ", ".join(f"({cells(row)})" for row in rules.CAPABILITY_PROFILES)
    return f"(VALUES {rows}) AS p({', '.join(rules.CAPABILITY_COLUMNS)})"


@query(
    "capability_lookup",
    f"""WITH asked AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'explain' WHEN 'error' THEN 'debug'
      WHEN 'click' THEN 'refactor' WHEN 'signup' THEN 'architecture-review' ELSE 'none' END AS capability FROM events)
    SELECT event_id, a.capability, include_callers, include_callees, include_dependencies, include_dependents,
    include_tests, include_dead_code, include_diagnostics, relationship_depth, max_context_tokens
    FROM asked a LEFT JOIN {_capability_values()} ON p.capability = a.capability""",
)
def _capability_lookup(spark, sf_dir):
    kind = F.col("event_type")
    name = (
        F.when(kind == "view", "explain")
        .when(kind == "error", "debug")
        .when(kind == "click", "refactor")
        .when(kind == "signup", "architecture-review")
        .otherwise("none")
    )
    return catalogs.capability_lookup(
        views.table(spark, sf_dir, "events").select("event_id", name.alias("capability"))
    )


_ASKED = "asked AS (SELECT event_id, 'm' || (user_id % 90) AS model FROM events)"
_UNIQUE = """uniq AS (SELECT model, arg_min(backend_model, entry) AS b, min(entry) AS entry FROM catalog
  WHERE model IS NOT NULL GROUP BY 1),
known AS (SELECT u.model, coalesce(c.backend_model, c.model) AS backend_model, c.provider,
  coalesce(c.context_window, 131072) AS context_window FROM uniq u JOIN catalog c ON c.entry = u.entry)"""


def _asked(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("m"), (F.col("user_id") % 90).cast("string")).alias("model")
    )


def _known(spark, sf_dir):
    from tracelode.operators.records import first_per_id

    return first_per_id(_catalog(spark, sf_dir).where("model is not null"), "model", "entry")


@query(
    "model_resolve",
    f"""WITH {CATALOG_SQL}, {_ASKED}, {_UNIQUE} SELECT event_id, a.model, k.backend_model, k.provider, k.context_window,
    k.model IS NOT NULL AS resolved FROM asked a LEFT JOIN known k ON k.model = a.model""",
)
def _model_resolve(spark, sf_dir):
    return catalogs.model_resolve(_asked(spark, sf_dir), _known(spark, sf_dir))


@query(
    "unknown_models",
    f"""WITH {CATALOG_SQL}, {_ASKED} SELECT model, count(*) AS requests FROM asked
    WHERE model NOT IN (SELECT model FROM catalog WHERE model IS NOT NULL) GROUP BY 1""",
)
def _unknown_models(spark, sf_dir):
    return catalogs.unknown_models(_asked(spark, sf_dir), _known(spark, sf_dir))


def _plan_values() -> str:
    rows = []
    for rule in rules.PLAN_RULES:
        cells = [str(v) if isinstance(v, (bool, int)) else f"'{v}'" for v in rule]
        rows.append("(" + ", ".join(cells) + ")")
    return f"(VALUES {', '.join(rows)}) AS p({', '.join(rules.PLAN_COLUMNS)})"


@query(
    "plan_rule_lookup",
    f"""WITH asked AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'EXPLAIN' WHEN 'click' THEN 'SEARCH'
      WHEN 'error' THEN 'DEBUG' WHEN 'signup' THEN 'CUSTOM' ELSE 'TEST' END AS intent FROM events)
    SELECT event_id, a.intent, maximum_depth, include_callers, include_callees, include_modules,
    include_diagnostics, retrieval_profile FROM asked a JOIN {_plan_values()}
    ON p.intent = CASE WHEN a.intent = 'CUSTOM' THEN 'DEFAULT' ELSE a.intent END""",
)
def _plan_rule_lookup(spark, sf_dir):
    kind = F.col("event_type")
    intent = (
        F.when(kind == "view", "EXPLAIN")
        .when(kind == "click", "SEARCH")
        .when(kind == "error", "DEBUG")
        .when(kind == "signup", "CUSTOM")
        .otherwise("TEST")
    )
    asked = views.table(spark, sf_dir, "events").select("event_id", intent.alias("intent"))
    return catalogs.plan_rule_lookup(asked).select(
        "event_id", "intent", "maximum_depth", "include_callers", "include_callees",
        "include_modules", "include_diagnostics", "retrieval_profile",
    )


@query(
    "intent_budget",
    """SELECT event_id, CASE WHEN k % 10 = 0 THEN k + 1 WHEN event_type = 'view' THEN 2000 + user_id
      WHEN event_type = 'click' THEN 900 ELSE 4096 END AS budget
    FROM (SELECT *, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events)""",
)
def _intent_budget(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    setting = F.concat(
        F.lit("bad, View : "), (F.col("user_id") + 2000).cast("string"),
        F.lit(",error:x,signup:-5,click:100,:7,CLICK:900"),
    )
    override = F.when(k % 10 == 0, k + 1)
    budgets = catalogs.intent_budgets(setting)
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        catalogs.resolve_budget(override, F.col("event_type"), budgets, 4096).cast("bigint").alias("budget"),
    )


@query(
    "normalise_request",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'default' ELSE event_type END AS model,
    event_id % 4 = 1 AS stream, CASE WHEN event_id % 5 <> 0 THEN value END AS temperature,
    CASE WHEN event_id % 2 = 0 THEN event_id END AS max_tokens,
    CASE WHEN event_id % 7 = 0 THEN '[]' ELSE '[{"role":"user"}]' END AS messages,
    event_id::VARCHAR AS extra_user FROM events""",
)
def _normalise_request(spark, sf_dir):
    e = F.col("event_id")
    text = e.cast("string")
    body = F.concat(
        F.lit('{"model": '),
        F.when(e % 3 == 0, text).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))),
        F.lit(', "stream": '),
        F.when(e % 4 == 1, "true").when(e % 4 == 2, '"yes"').otherwise("false"),
        F.lit(', "temperature": '),
        F.when(e % 5 == 0, '"hot"').otherwise(F.col("value").cast("string")),
        F.lit(', "max_tokens": '),
        F.when(e % 2 == 0, text).otherwise(F.concat(text, F.lit(".5"))),
        F.when(e % 7 == 0, ', "messages": {}').otherwise(', "messages": [{"role":"user"}]'),
        F.lit(', "x_user": '), text, F.lit("}"),
    )
    bodies = views.table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return catalogs.normalise_request(bodies).select(
        "event_id", "model", "stream", "temperature", "max_tokens", "messages",
        F.col("extra")["x_user"].alias("extra_user"),
    )
