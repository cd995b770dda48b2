"""Record store, telemetry, lifecycle and run-control queries over events and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode import views
from tracelode.operators import records, telemetry
from tracelode.plans.registry import query
from tracelode.sources import logs

K_SQL = "base AS (SELECT *, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events)"
WITH = "WITH " + views.REQUESTS_SQL


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


# --- log lines and records ---------------------------------------------------------------------


def _lines(spark, sf_dir):
    """The request log as text: some lines blank, some cut in half."""
    rows = views.raw_requests(spark, sf_dir)
    whole = F.to_json(F.struct(*rows.columns))
    key = F.substring("request_id", 2, 20).cast("bigint")
    broken = F.substring(whole, F.lit(1), (F.length(whole) / 2).cast("int"))
    line = F.when(key % 13 == 5, "   ").when(key % 17 == 3, broken).otherwise(whole)
    return rows.select(line.alias("value"))


_SKIPPED = "event_id % 13 = 5 OR event_id % 17 = 3"


@query(
    "read_requests",
    f"""{WITH} SELECT request_id, status, prompt_tokens, total_ms, last_user_message FROM requests
    WHERE NOT ({_SKIPPED})""",
)
def _read_requests(spark, sf_dir):
    parsed, _ = logs.split_lines(logs.parse_lines(_lines(spark, sf_dir)))
    return parsed.select(
        "request_id", "status", F.col("usage.prompt_tokens").alias("prompt_tokens"),
        F.col("timing.total_ms").alias("total_ms"), "last_user_message",
    )


@query(
    "rejected_lines",
    "SELECT count(*) AS rejected FROM events WHERE event_id % 17 = 3 AND event_id % 13 <> 5",
)
def _rejected(spark, sf_dir):
    _, rejected = logs.split_lines(logs.parse_lines(_lines(spark, sf_dir)))
    return rejected.agg(F.count(F.lit(1)).alias("rejected"))


@query(
    "build_session_records",
    f"""{WITH} SELECT request_id AS session_id, 'gateway_session' AS workflow_name,
    model || ' / ' || CASE WHEN event_id IN (SELECT event_id FROM events WHERE event_type = 'purchase') THEN ''
      ELSE intent END || ' / ' || status AS request_summary,
    CASE WHEN conversation_key = '__new__' THEN '' ELSE conversation_key END AS transaction_id,
    CASE WHEN status = 'ok' THEN 'COMPLETE' ELSE 'FAIL' END AS controller_decision,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS completed_at FROM requests""",
)
def _build_records(spark, sf_dir):
    return records.build_session_records(views.raw_requests(spark, sf_dir)).drop("metadata")


STORE_SQL = f"""
{K_SQL},
rows AS (SELECT event_id, user_id * 100 + k AS session_id, event_type AS workflow_name, k, value, ts FROM base),
store AS (SELECT DISTINCT session_id FROM rows WHERE event_type = 'signup'),
""".replace("event_type = 'signup'", "workflow_name = 'signup'")


def _rows(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") * 100 + _k()).alias("session_id"),
        F.col("event_type").alias("workflow_name"),
        _k().alias("k"),
        "value",
        "ts",
    )


@query(
    "ingest_new_records",
    f"""WITH {STORE_SQL.rstrip().rstrip(',')} SELECT session_id, arg_min(workflow_name, event_id) AS workflow_name,
    min(event_id) AS event_id FROM rows WHERE workflow_name <> 'signup'
    AND session_id NOT IN (SELECT session_id FROM store) GROUP BY session_id""",
)
def _ingest(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    store = rows.where("workflow_name = 'signup'")
    batch = rows.where("workflow_name <> 'signup'").select("session_id", "workflow_name", "event_id")
    return records.ingest_new_records(batch, store, "session_id", "event_id")


@query(
    "validate_records",
    f"""{WITH} SELECT request_id AS session_id, CASE WHEN k % 9 = 0 AND k % 6 = 0 THEN 'transaction_id|completed_at'
    WHEN k % 9 = 0 THEN 'transaction_id' WHEN k % 6 = 0 THEN 'completed_at' ELSE '' END AS missing FROM requests""",
)
def _validate(spark, sf_dir):
    built = records.build_session_records(views.raw_requests(spark, sf_dir))
    k = F.regexp_extract(F.col("metadata")["last_user_message"], r'"k": (\d+)', 1).cast("bigint")
    holed = built.withColumn("transaction_id", F.when(k % 9 != 0, F.col("transaction_id"))).withColumn(
        "completed_at", F.when(k % 6 != 0, F.col("completed_at"))
    )
    checked = records.validate_records(holed)
    return checked.select("session_id", F.array_join("missing_fields", "|").alias("missing"))


@query(
    "delete_records",
    f"""WITH {K_SQL} SELECT event_id FROM base WHERE user_id NOT IN (SELECT user_id FROM base WHERE k = 7)""",
)
def _delete(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", _k().alias("k")
    )
    return records.delete_records(rows, rows.where("k = 7")).select("event_id")


def _register_filter(name, choose, where):
    @query(
        name,
        f"""{WITH} SELECT request_id AS session_id FROM requests WHERE {where}""",
    )
    def _job(spark, sf_dir):
        raw = views.raw_requests(spark, sf_dir)
        built = records.build_session_records(raw).withColumn(
            "modules", F.array(F.col("metadata")["model"], F.col("metadata")["intent"])
        )
        return choose(built).select("session_id")


_register_filter("records_by_workflow", lambda df: records.by_workflow(df, "gateway_session"), "true")
_register_filter("records_successful", records.successful, "status = 'ok'")
_register_filter("records_failed", records.failed, "status <> 'ok'")
_register_filter(
    "records_by_module",
    lambda df: records.by_module(df, "SEARCH"),
    "intent = 'SEARCH'",
)


@query(
    "recent_records",
    f"""{WITH} SELECT request_id AS session_id, status = 'ok' AS ok FROM requests
    ORDER BY ts DESC, request_id DESC LIMIT 10""",
)
def _recent(spark, sf_dir):
    built = records.build_session_records(views.raw_requests(spark, sf_dir))
    newest = records.recent_records(built, 10)
    return newest.select("session_id", (F.col("controller_decision") == "COMPLETE").alias("ok"))


@query(
    "record_statistics",
    f"""WITH {K_SQL} SELECT count(*) AS total_sessions, count(*) FILTER (event_type <> 'error') AS successful_sessions,
    count(*) FILTER (event_type = 'error') AS failed_sessions, round(avg(k / 100.0::DOUBLE) FILTER (k % 7 <> 0), 6) AS average_evaluation_score,
    round(avg(k % 4), 6) AS average_iterations,
    round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 6) AS success_rate FROM base""",
)
def _record_statistics(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "FAIL").otherwise("COMPLETE").alias("controller_decision"),
        F.when(_k() % 7 != 0, _k() / 100).alias("evaluation_score"),
        (_k() % 4).alias("iteration_count"),
    )
    return records.record_statistics(rows)


@query("workflow_usage", "SELECT event_type AS workflow_name, count(*) AS sessions FROM events GROUP BY 1")
def _workflow_usage(spark, sf_dir):
    return records.workflow_usage(_rows(spark, sf_dir))


@query(
    "decide_outcome",
    f"""WITH {K_SQL} SELECT event_id, CASE WHEN event_type = 'error' THEN 'FAIL'
    WHEN event_type = 'click' AND k % 5 < 3 THEN 'RETRY' WHEN event_type = 'click' THEN 'FAIL'
    WHEN k % 10 = 0 OR k >= 70 THEN 'COMPLETE' WHEN k >= 50 THEN 'REQUEST_REVIEW' ELSE 'FAIL' END AS decision FROM base""",
)
def _decide(spark, sf_dir):
    kind = F.col("event_type")
    score = F.when(_k() % 10 != 0, _k() / 100)
    decision = records.decide_outcome(kind == "error", kind == "click", score, _k() % 5)
    return views.table(spark, sf_dir, "events").select("event_id", decision.alias("decision"))


# --- lifecycle ---------------------------------------------------------------------------------

_STATUS_SQL = """CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'view' THEN 'PLANNING' WHEN 'click' THEN 'EXECUTING'
  WHEN 'purchase' THEN 'VERIFYING' ELSE 'FAILED' END"""


def _status_events(spark, sf_dir):
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "CREATED")
        .when(kind == "view", "PLANNING")
        .when(kind == "click", "EXECUTING")
        .when(kind == "purchase", "VERIFYING")
        .otherwise("FAILED")
    )
    return views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("position"),
        status.alias("status"),
        F.when(_k() % 3 == 0, F.col("props")).alias("artifact"),
    )


@query(
    "lifecycle_violations",
    f"""WITH s AS (SELECT user_id AS session_id, event_id AS position, {_STATUS_SQL} AS status FROM events),
    p AS (SELECT *, lag(status) OVER (PARTITION BY session_id ORDER BY position) AS before FROM s)
    SELECT session_id, position, before, status FROM p WHERE before IS NOT NULL AND NOT (
      (before = 'CREATED' AND status = 'PLANNING') OR (before = 'PLANNING' AND status = 'EXECUTING')
      OR (before = 'EXECUTING' AND status = 'VERIFYING') OR (before <> 'FAILED' AND status = 'FAILED'))""",
)
def _violations(spark, sf_dir):
    return records.lifecycle_violations(_status_events(spark, sf_dir))


@query(
    "current_status",
    f"""WITH {K_SQL} SELECT user_id AS session_id, arg_max({_STATUS_SQL}, event_id) AS status,
    count(*) FILTER (k % 3 = 0) AS artifacts FROM base GROUP BY 1""",
)
def _current_status(spark, sf_dir):
    return records.current_status(_status_events(spark, sf_dir))


def _iterations(spark, sf_dir):
    from tracelode.functions.ordered import row_ordinal

    rows = views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        "event_id",
        F.when(_k() % 7 != 0, _k() / 110).alias("evaluation_score"),
        F.when(_k() % 2 == 0, "PASSED").otherwise("FAILED").alias("verification_status"),
        F.when(_k() % 3 == 0, "COMPLETED").otherwise("FAILED").alias("status"),
        F.col("value").alias("duration_ms"),
        (_k() % 10 == 1).alias("policy_stop"),
    )
    return row_ordinal(rows, ["session_id"], "event_id", "position")


@query(
    "iteration_stats",
    f"""WITH {K_SQL} SELECT user_id AS session_id, count(*) AS total_iterations,
    count(*) FILTER (k % 3 = 0) AS successful_iterations, count(*) FILTER (k % 3 <> 0) AS failed_iterations,
    round(sum(value), 6) AS total_duration_ms,
    round(coalesce(avg(k / 110.0::DOUBLE) FILTER (k % 7 <> 0), 0), 6) AS average_evaluation_score FROM base GROUP BY 1""",
)
def _iteration_stats(spark, sf_dir):
    return records.iteration_stats(_iterations(spark, sf_dir))


@query(
    "stop_conditions",
    f"""WITH {K_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM base),
    f AS (SELECT user_id, max(k / 110.0::DOUBLE) FILTER (k % 7 <> 0) AS best, max(k) FILTER (back = 1) AS last_k, count(*) AS n,
      count(*) FILTER (back <= 3 AND k % 3 <> 0) AS bad FROM p GROUP BY 1)
    SELECT user_id AS session_id, concat_ws('|', CASE WHEN best >= 0.8 THEN 'goal achieved' END,
      CASE WHEN last_k % 2 = 0 THEN 'verification successful' END,
      CASE WHEN n >= user_id % 60 + 20 THEN 'maximum iterations reached' END,
      CASE WHEN n >= 3 AND bad = 3 THEN 'repeated failures' END,
      CASE WHEN last_k % 10 = 1 THEN 'policy requested stop' END) AS reasons FROM f""",
)
def _stop(spark, sf_dir):
    iterations = _iterations(spark, sf_dir)
    limits = views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), (F.col("user_id") % 60 + 20).alias("max_iterations")
    ).distinct()
    stops = records.stop_conditions(iterations, limits)
    return stops.select("session_id", F.array_join("reasons", "|").alias("reasons"))


@query(
    "plan_metrics",
    """WITH t AS (SELECT l_orderkey AS plan_id, l_partkey AS tokens, l_linenumber * 10 AS ms,
      CASE l_linenumber % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS rank,
      l_returnflag AS c FROM lineitem)
    SELECT plan_id, sum(tokens)::BIGINT AS estimated_tokens, sum(ms)::BIGINT AS estimated_duration_ms,
    ['LOW', 'MEDIUM', 'HIGH', 'VERY_HIGH'][max(rank) + 1] AS complexity, count(DISTINCT c) AS constraints
    FROM t GROUP BY plan_id""",
)
def _plan_metrics(spark, sf_dir):
    level = F.col("l_linenumber") % 5
    complexity = (
        F.when(level == 0, "LOW").when(level == 1, "MEDIUM").when(level == 2, "HIGH")
        .when(level == 3, "VERY_HIGH").otherwise("UNKNOWN")
    )
    tasks = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"),
        F.col("l_partkey").alias("tokens"),
        (F.col("l_linenumber") * 10).alias("duration_ms"),
        complexity.alias("complexity"),
        F.col("l_returnflag").alias("constraint"),
    )
    return records.plan_metrics(tasks)


# --- telemetry ---------------------------------------------------------------------------------


def _metrics(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("metric_id"),
        F.col("event_type").alias("name"),
        "value",
        F.create_map(F.lit("user"), (F.col("user_id") % 10).cast("string")).alias("labels"),
        F.col("ts").alias("timestamp"),
    )


def _tel_events(spark, sf_dir):
    types = telemetry.EVENT_TYPES + ("gateway.unknown",)
    kind = F.get(F.array(*[F.lit(t) for t in types]), (_k() % len(types)).cast("int"))
    home = F.substring_index(kind, ".", 1)
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        kind.alias("type"),
        F.when(F.col("event_id") % 11 == 0, "system").otherwise(home).alias("category"),
        F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("correlation_id"),
        F.col("ts").alias("timestamp"),
    )


def _traces(spark, sf_dir):
    step = lambda name, ms: F.struct(
        F.lit(name).alias("step_id"), F.lit(name[0]).alias("component"), ms.alias("duration_ms")
    )
    value = F.col("value")
    return views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trace_id"),
        F.array(step("plan", value * 0.25), step("call", value * 0.5), step("parse", value * 0.25)).alias("steps"),
        F.col("ts").alias("timestamp"),
    )


_TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in (*telemetry.EVENT_TYPES, "gateway.unknown")) + "]"
TEL_SQL = f"""
{K_SQL},
tel AS (SELECT event_id, {_TYPES_SQL}[k % {len(telemetry.EVENT_TYPES) + 1} + 1] AS type, user_id, ts, k FROM base),
tel_events AS (SELECT event_id, type, CASE WHEN event_id % 11 = 0 THEN 'system' ELSE split_part(type, '.', 1) END AS category,
  'c' || (user_id % 20) AS correlation_id FROM tel)
"""


@query(
    "telemetry_lookup",
    f"""WITH {TEL_SQL} SELECT event_id, type FROM tel_events
    WHERE category = 'provider' AND type = 'provider.error' AND correlation_id = 'c3'""",
)
def _telemetry_lookup(spark, sf_dir):
    rows = telemetry.events_where(
        _tel_events(spark, sf_dir), category="provider", type="provider.error", correlation_id="c3"
    )
    return rows.select("event_id", "type")


@query(
    "metric_lookup",
    "SELECT event_id AS metric_id, value FROM events WHERE event_type = 'view' AND user_id % 10 = 4",
)
def _metric_lookup(spark, sf_dir):
    return telemetry.metrics_where(_metrics(spark, sf_dir), "view", user="4").select("metric_id", "value")


@query(
    "validate_events",
    f"""WITH {TEL_SQL} SELECT event_id, type <> 'gateway.unknown' AND split_part(type, '.', 1) = category AS valid
    FROM tel_events""",
)
def _validate_events(spark, sf_dir):
    return telemetry.validate_events(_tel_events(spark, sf_dir)).select("event_id", "valid")


@query(
    "metric_stats",
    """SELECT event_type AS name, count(value) AS count, round(sum(value), 6) AS sum, min(value) AS min,
    max(value) AS max, round(avg(value), 6) AS avg FROM events GROUP BY 1""",
)
def _metric_stats(spark, sf_dir):
    return telemetry.metric_stats(_metrics(spark, sf_dir))


@query("latest_metric", "SELECT event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def _latest_metric(spark, sf_dir):
    return telemetry.latest_metric(_metrics(spark, sf_dir))


@query(
    "trace_steps",
    """SELECT event_id AS trace_id, 0::BIGINT AS ordinal, 'plan' AS step_id, value * 0.25::DOUBLE AS duration_ms FROM events
    UNION ALL SELECT event_id, 1, 'call', value * 0.5::DOUBLE FROM events
    UNION ALL SELECT event_id, 2, 'parse', value * 0.25::DOUBLE FROM events""",
)
def _trace_steps(spark, sf_dir):
    steps = telemetry.trace_steps(_traces(spark, sf_dir))
    return steps.select("trace_id", "ordinal", "step_id", "duration_ms")


@query(
    "component_times",
    """SELECT 'p' AS component, 2 * count(*) AS steps, round(sum(value * 0.5::DOUBLE), 6) AS total_ms FROM events
    UNION ALL SELECT 'c', count(*), round(sum(value * 0.5::DOUBLE), 6) FROM events""",
)
def _component_times(spark, sf_dir):
    return telemetry.component_times(telemetry.trace_steps(_traces(spark, sf_dir)))


@query(
    "telemetry_snapshot",
    """SELECT kind, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last
    FROM events, (VALUES ('events'), ('metrics'), ('traces')) AS k(kind) GROUP BY kind""",
)
def _snapshot(spark, sf_dir):
    snapshot = telemetry.telemetry_snapshot(
        _tel_events(spark, sf_dir), _metrics(spark, sf_dir), _traces(spark, sf_dir)
    )
    stamp = lambda name: F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
    return snapshot.select("kind", "n", stamp("first"), stamp("last"))


_SEVERITY_SQL = "['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'INFO', 'INFO', 'INFO'][l_linenumber % 8 + 1]"


@query(
    "verification_score",
    f"""WITH f AS (SELECT l_orderkey AS run_id, {_SEVERITY_SQL} AS s FROM lineitem),
    w AS (SELECT run_id, s, CASE s WHEN 'LOW' THEN 0.05 WHEN 'MEDIUM' THEN 0.15 WHEN 'HIGH' THEN 0.3 WHEN 'CRITICAL' THEN 0.5 ELSE 0 END::DOUBLE AS t FROM f),
    g AS (SELECT o_orderkey AS run_id, coalesce(sum(t), 0) AS t, count(s) AS executed, count(*) FILTER (s IN ('LOW', 'MEDIUM')) AS warnings,
      count(*) FILTER (s IN ('HIGH', 'CRITICAL')) AS failed, count(*) FILTER (s = 'MEDIUM') AS m
      FROM orders LEFT JOIN w ON w.run_id = o_orderkey GROUP BY 1)
    SELECT run_id, round(greatest(0, least(1, 1 - t)), 6) AS score, CASE WHEN executed = 0 THEN 'SKIPPED' WHEN failed > 0 THEN 'FAILED'
      WHEN m > 0 THEN 'WARNING' ELSE 'PASSED' END AS status, executed, executed - warnings - failed AS passed, warnings, failed FROM g""",
)
def _verification(spark, sf_dir):
    names = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL", "INFO", "INFO", "INFO"]
    severity = F.get(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber") % 8)
    findings = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), severity.alias("severity")
    )
    runs = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    return telemetry.verification_score(findings, runs)


@query(
    "health_status",
    """SELECT s_suppkey AS subject, CASE WHEN bool_or(l_linenumber = 7 AND l_quantity > 49) THEN 'UNHEALTHY'
    WHEN bool_or(l_linenumber = 6 AND l_quantity > 49) THEN 'DEGRADED' ELSE 'HEALTHY' END AS status
    FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""",
)
def _health(spark, sf_dir):
    heavy = F.col("l_quantity") > 49
    severity = (
        F.when(heavy & (F.col("l_linenumber") == 7), "CRITICAL")
        .when(heavy & (F.col("l_linenumber") == 6), "WARNING")
        .otherwise("INFO")
    )
    issues = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"), severity.alias("severity")
    )
    subjects = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"))
    return telemetry.health_status(issues, subjects)
