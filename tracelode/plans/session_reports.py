"""Request-log reports over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode import views
from tracelode.operators import sessions
from tracelode.plans.registry import operator_query, query

WITH = "WITH " + views.REQUESTS_SQL


def _report(name, operator, sql):
    operator_query(name, operator, views.requests, WITH + sql)


_report(
    "clean_requests",
    lambda df: df.select(
        "request_id", "conversation_key", "intent", "status", "context_status", "symbols_new",
        "symbols_suppressed", "prompt_tokens", "cap_enabled", "cap_applied", "budget",
        "dropped_count", "tokens_after",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("second"),
    ),
    """SELECT request_id, conversation_key, intent, status, context_status, symbols_new,
    symbols_suppressed, prompt_tokens, cap_enabled, cap_applied, budget, dropped_count, tokens_after,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS second FROM requests""",
)
_report(
    "status_counts",
    sessions.status_counts,
    """SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok,
    count(*) FILTER (status <> 'ok') AS error FROM requests""",
)
_report(
    "intent_distribution",
    sessions.intent_distribution,
    """SELECT intent, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct,
    intent = 'DEFAULT' AND count(*) = sum(count(*)) OVER () AS all_default
    FROM requests GROUP BY intent""",
)
_report(
    "context_status_distribution",
    sessions.context_status_distribution,
    """SELECT context_status, count(*) AS n,
    round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct
    FROM requests GROUP BY context_status""",
)
_report(
    "latency_summary",
    sessions.latency_summary,
    """SELECT count(total_ms) AS total_n, round(quantile_cont(total_ms, 0.5), 6) AS total_median,
    round(quantile_cont(total_ms, 0.9), 6) AS total_p90, round(avg(total_ms), 6) AS total_mean,
    round(min(total_ms), 6) AS total_min, round(max(total_ms), 6) AS total_max FROM requests""",
)
_report(
    "ttft_summary",
    sessions.ttft_summary,
    """SELECT count(ttft_ms) AS ttft_n, round(quantile_cont(ttft_ms, 0.5), 6) AS ttft_median,
    round(quantile_cont(ttft_ms, 0.9), 6) AS ttft_p90, round(avg(ttft_ms), 6) AS ttft_mean FROM requests""",
)
_report(
    "prompt_tokens_summary",
    sessions.prompt_tokens_summary,
    """SELECT count(p) AS prompt_n, round(quantile_cont(p, 0.5), 6) AS prompt_median,
    round(avg(p), 6) AS prompt_mean, round(min(p), 6) AS prompt_min, round(max(p), 6) AS prompt_max
    FROM (SELECT prompt_tokens::DOUBLE AS p FROM requests)""",
)
_report(
    "prompt_tokens_by_context_status",
    sessions.prompt_tokens_by_context_status,
    """SELECT context_status, count(p) AS prompt_n, round(quantile_cont(p, 0.5), 6) AS prompt_median,
    round(avg(p), 6) AS prompt_mean
    FROM (SELECT context_status, prompt_tokens::DOUBLE AS p FROM requests) WHERE p IS NOT NULL
    GROUP BY context_status""",
)
_report(
    "suppression_effect",
    sessions.suppression_effect,
    """, many AS (SELECT conversation_key FROM requests GROUP BY 1 HAVING count(*) > 1),
    r AS (SELECT symbols_suppressed / (symbols_new + symbols_suppressed)::DOUBLE AS ratio
      FROM requests WHERE conversation_key IN (SELECT conversation_key FROM many)
      AND symbols_new + symbols_suppressed > 0)
    SELECT count(*) AS n, round(avg(ratio), 6) AS mean, round(median(ratio), 6) AS median,
    round(min(ratio), 6) AS min, round(max(ratio), 6) AS max,
    (SELECT count(*) FROM many) AS multi_turn_conversations FROM r""",
)
_report(
    "turns_per_conversation",
    sessions.turns_per_conversation,
    """, t AS (SELECT count(*) AS turns FROM requests GROUP BY conversation_key)
    SELECT count(*) AS conversations, count(*) FILTER (turns > 1) AS multi_turn_conversations,
    round(median(turns::DOUBLE), 6) AS median_turns, max(turns) AS max_turns, min(turns) AS min_turns FROM t""",
)
_report(
    "timing_breakdown",
    sessions.timing_breakdown,
    """, parts AS (
      SELECT 'total: pipeline' AS part, pipeline_ms AS ms FROM requests
      UNION ALL SELECT 'total: provider', provider_wait_ms FROM requests
      UNION ALL SELECT 'provider', stage_provider FROM requests
      UNION ALL SELECT 'planning', stage_planning FROM requests
      UNION ALL SELECT 'repository_context', stage_context FROM requests)
    SELECT part, count(ms) AS n, round(quantile_cont(ms, 0.5), 6) AS median_ms,
    round(avg(ms), 6) AS mean_ms FROM parts WHERE ms IS NOT NULL GROUP BY part""",
)
_report(
    "latency_buckets",
    sessions.latency_buckets,
    """SELECT CASE WHEN prompt_tokens < 10000 THEN '<10k' WHEN prompt_tokens < 30000 THEN '10-30k'
      WHEN prompt_tokens < 60000 THEN '30-60k' ELSE '>60k' END AS bucket, count(*) AS n,
    round(quantile_cont(total_ms, 0.5), 6) AS median_ms, round(quantile_cont(total_ms, 0.9), 6) AS p90_ms,
    round(quantile_cont(coalesce(provider_wait_ms, 0), 0.5), 6) AS median_provider_ms
    FROM requests WHERE prompt_tokens IS NOT NULL AND total_ms IS NOT NULL GROUP BY 1""",
)
_report(
    "latency_correlation",
    sessions.latency_correlation,
    """SELECT round(coalesce(corr(prompt_tokens, total_ms), 0), 6) AS prompt_vs_total,
    round(coalesce(corr(prompt_tokens, provider_wait_ms), 0), 6) AS prompt_vs_provider FROM requests""",
)
_report(
    "history_cap_report",
    sessions.history_cap_report,
    """SELECT count(*) FILTER (cap_enabled) AS cap_enabled, count(*) FILTER (cap_applied) AS cap_applied,
    count(*) FILTER (dropped_count > 0) AS dropped_requests,
    round(coalesce(median(budget::DOUBLE) FILTER (budget <> 0), 0), 6) AS median_budget,
    round(coalesce(median(dropped_count::DOUBLE) FILTER (dropped_count > 0), 0), 6) AS median_dropped,
    round(median(tokens_after::DOUBLE), 6) AS median_tokens_after FROM requests""",
)
_COST = """, cost AS (SELECT intent, estimated_tokens::DOUBLE AS est,
      CASE WHEN prompt_tokens <> 0 THEN estimated_tokens * 100.0::DOUBLE / prompt_tokens END AS prompt_pct,
      max_tokens::DOUBLE AS budget,
      CASE WHEN max_tokens <> 0 THEN estimated_tokens * 100.0::DOUBLE / max_tokens END AS budget_pct
      FROM requests WHERE estimated_tokens > 0)"""
_MEDIANS = """count(*) AS n, round(median(est), 6) AS est_median,
    round(coalesce(median(prompt_pct), 0), 6) AS prompt_pct_median,
    round(coalesce(median(budget), 0), 6) AS budget_median,
    round(coalesce(median(budget_pct), 0), 6) AS budget_pct_median"""
_report(
    "context_cost",
    sessions.context_cost,
    f"""{_COST} SELECT {_MEDIANS}, round(avg(est), 6) AS est_mean, round(min(est), 6) AS est_min,
    round(max(est), 6) AS est_max FROM cost""",
)
_report(
    "context_cost_by_intent",
    sessions.context_cost_by_intent,
    f"{_COST} SELECT intent, {_MEDIANS} FROM cost GROUP BY intent",
)
_report(
    "context_cost_delta",
    sessions.context_cost_delta,
    """, placed AS (SELECT context_status, prompt_tokens,
      row_number() OVER (PARTITION BY context_status ORDER BY ts, request_id) AS i
      FROM requests WHERE prompt_tokens IS NOT NULL),
    d AS (SELECT (a.prompt_tokens - b.prompt_tokens)::DOUBLE AS delta FROM placed a JOIN placed b
      ON a.i = b.i AND a.context_status = 'assembled' AND b.context_status = 'empty')
    SELECT count(*) AS pairs, round(coalesce(median(delta), 0), 6) AS median_delta FROM d""",
)
_report(
    "stage_split",
    sessions.stage_split,
    """SELECT request_id, round(stage_planning + stage_context, 6) AS pipeline_ms,
    round(stage_provider, 6) AS provider_ms FROM requests""",
)
_report(
    "session_summary",
    sessions.session_summary,
    """SELECT count(*) AS total_records, count(*) FILTER (status = 'ok') AS success_count,
    count(*) FILTER (status <> 'ok') AS failure_count,
    round(count(*) FILTER (status = 'ok') / count(*)::DOUBLE, 6) AS success_rate,
    round(avg(total_ms), 6) AS avg_total_ms, round(avg(provider_wait_ms), 6) AS avg_provider_wait_ms,
    round(count(*) FILTER (cap_applied) / (count(*) FILTER (has_history))::DOUBLE, 6) AS history_cap_rate
    FROM requests""",
)
_report(
    "session_breakdowns",
    sessions.session_breakdowns,
    """SELECT dimension, item, count(*) AS n FROM (
      SELECT 'error' AS dimension, left(error, 80) AS item FROM requests WHERE error IS NOT NULL
      UNION ALL SELECT 'intent', intent FROM requests UNION ALL SELECT 'model', model FROM requests)
    GROUP BY dimension, item""",
)
_report(
    "slowest_requests",
    sessions.slowest_requests,
    """SELECT left(request_id, 12) AS request_id, total_ms, coalesce(prompt_tokens, 0) AS prompt_tokens,
    completion_tokens, pipeline_ms, context_status, left(last_user_message, 80) AS preview
    FROM requests ORDER BY total_ms DESC, request_id LIMIT 5""",
)
_report(
    "error_requests",
    sessions.error_requests,
    """SELECT left(request_id, 12) AS request_id, left(error, 120) AS error,
    left(last_user_message, 80) AS preview FROM requests WHERE status = 'error'""",
)


@query(
    "cap_run_comparison",
    WITH
    + """SELECT model AS label, count(*) AS requests, sum(dropped_count)::BIGINT AS dropped,
    count(*) FILTER (status <> 'ok') AS errors,
    round(median(prompt_tokens::DOUBLE), 6) AS median_tokens,
    round(median(total_ms), 6) AS median_latency, round(max(total_ms), 6) AS max_latency
    FROM requests GROUP BY model""",
)
def _cap_runs(spark, sf_dir):
    return sessions.cap_run_comparison(views.requests(spark, sf_dir).withColumnRenamed("model", "label"))


@query("approximate_latency", "SELECT true AS median_close, true AS p90_close")
def _approximate(spark, sf_dir):
    """Whether both estimates lie within the sketch's rank error of 1 / 10,000."""
    requests = views.requests(spark, sf_dir).where("total_ms IS NOT NULL").select("total_ms", F.lit(1).alias("one"))
    guess = sessions.approximate_latency(requests).withColumn("one", F.lit(1))
    ranked = requests.join(F.broadcast(guess), "one")

    def close(name: str, rank: float):
        below, upto = (F.avg(c.cast("double")) for c in (F.col("total_ms") < F.col(name), F.col("total_ms") <= F.col(name)))
        return ((below <= rank + 1e-4) & (upto >= rank - 1e-4)).alias(f"{name}_close")

    return ranked.agg(close("median", 0.5), close("p90", 0.9))
