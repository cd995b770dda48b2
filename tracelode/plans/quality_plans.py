"""Evaluation queries: facts over documents, probes and runs over events, sets over labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode import views
from tracelode.functions import text
from tracelode.operators import quality, records
from tracelode.plans.registry import query

K_SQL = "base AS (SELECT *, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events)"


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


# --- facts -------------------------------------------------------------------------------------


@query(
    "score_facts",
    r"""WITH answers AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS probe_id,
      replace(lower(text), '\', '/') AS a FROM documents),
    facts AS (SELECT item_id, 'passage' AS label, [text] AS v FROM benchmark
      UNION ALL SELECT item_id, 'ending', [right(text, 12), 'TION'] FROM benchmark
      UNION ALL SELECT item_id, 'opening', [left(text, 6)] FROM benchmark)
    SELECT doc_id AS answer_id, label,
      len(list_filter(v, lambda x: contains(a, replace(lower(x), '\', '/')))) > 0 AS hit
    FROM answers JOIN facts ON probe_id = item_id""",
)
def _score_facts(spark, sf_dir):
    bench = views.table(spark, sf_dir, "benchmark")
    items = bench.agg(F.count(F.lit(1))).scalar()
    answers = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("answer_id"),
        (F.col("doc_id") % items).alias("probe_id"),
        F.col("text").alias("answer"),
    )
    rows = F.array(
        F.struct(F.lit("passage").alias("label"), F.array("text").alias("variants")),
        F.struct(
            F.lit("ending").alias("label"),
            F.array(F.right("text", F.lit(12)), F.lit("TION")).alias("variants"),
        ),
        F.struct(F.lit("opening").alias("label"), F.array(F.left("text", F.lit(6))).alias("variants")),
    )
    facts = bench.select(F.col("item_id").alias("probe_id"), F.inline(rows))
    return quality.score_facts(answers, facts)


def _quote(parts):
    return "[" + ", ".join(views._sql_text(p) for p in parts) + "]"


@query(
    "style_flags",
    rf"""WITH a AS (SELECT doc_id, lower(regexp_replace(CASE doc_id % 9 WHEN 0 THEN ' I will ' WHEN 1 THEN 'First, '
      WHEN 2 THEN 'x <Thinking> ' WHEN 3 THEN 'LET ME </tool_call>' ELSE '' END || text, '^\s+|\s+$', '', 'g')) AS t
      FROM documents),
    f AS (SELECT doc_id, len(list_filter({_quote(text.REASONING_PREFIXES)}, lambda p: starts_with(t, p))) > 0 AS r,
      len(list_filter({_quote(text.CHATTER_MARKERS)}, lambda p: contains(t, p))) > 0 AS c FROM a)
    SELECT doc_id, CASE WHEN r AND c THEN 'reasoning_preamble|tool_chatter' WHEN r THEN 'reasoning_preamble'
      WHEN c THEN 'tool_chatter' ELSE '' END AS flags FROM f""",
)
def _style_flags(spark, sf_dir):
    kind = F.col("doc_id") % 9
    lead = (
        F.when(kind == 0, " I will ")
        .when(kind == 1, "First, ")
        .when(kind == 2, "x <Thinking> ")
        .when(kind == 3, "LET ME </tool_call>")
        .otherwise("")
    )
    flags = text.style_flags(F.concat(lead, "text"))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(flags, "|").alias("flags"))


@query(
    "truncation_flag",
    r"""SELECT doc_id, (doc_id % 60 >= 49) AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 20 AS truncated
    FROM documents""",
)
def _truncation(spark, sf_dir):
    flag = text.truncation_flag(F.col("text"), F.col("doc_id") % 60, F.lit(50))
    return views.table(spark, sf_dir, "documents").select("doc_id", flag.alias("truncated"))


# --- probes ------------------------------------------------------------------------------------

PROBE_SQL = f"""
{K_SQL},
report AS (SELECT event_id // 200 AS run_id, 'p' || (event_id % 100) AS id, event_id % 200 < 100 AS context,
  k % 4 AS score, k % 4 + k % 3 AS maximum, k % 4 AS h, k % 3 AS m, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS style_violations,
  CASE WHEN k % 11 = 0 THEN 0 ELSE k * 10 END AS prompt_tokens, value AS seconds, event_id, ts FROM base)
"""


def _results(spark, sf_dir):
    e = F.col("event_id")
    fact = lambda i: F.concat(F.lit("f"), i.cast("string"))
    empty = F.array().cast("array<string>")
    span = lambda a, n: F.when(
        n > 0, F.transform(F.sequence(a, a + F.greatest(n, F.lit(1)) - 1), fact)
    ).otherwise(empty)
    return views.table(spark, sf_dir, "events").select(
        F.floor(e / 200).alias("run_id"),
        F.concat(F.lit("p"), (e % 100).cast("string")).alias("id"),
        (e % 200 < 100).alias("context"),
        F.col("event_type").alias("intent"),
        span(F.lit(0).cast("bigint"), _k() % 4).alias("hits"),
        span(_k() % 4, _k() % 3).alias("misses"),
        F.when(_k() % 5 == 0, F.array(F.lit("tool_chatter"))).alias("style_violations"),
        F.when(_k() % 11 != 0, _k() * 10).alias("prompt_tokens"),
        F.col("value").alias("seconds"),
        F.lit(None).cast("string").alias("error"),
    )


def _arms(spark, sf_dir):
    results = _results(spark, sf_dir)
    on = quality.probe_report(results.where("context"))
    off = quality.probe_report(results.where("not context"))
    return on, off


@query(
    "probe_report",
    f"""WITH {PROBE_SQL} SELECT run_id, id, score, maximum, m AS missing, style_violations, prompt_tokens, seconds
    FROM report WHERE context""",
)
def _probe_report(spark, sf_dir):
    on, _ = _arms(spark, sf_dir)
    return on.select(
        "run_id", "id", "score", "maximum", F.size("missing_facts").cast("bigint").alias("missing"),
        "style_violations", "prompt_tokens", "seconds",
    )


_TOTALS_SQL = """count(*) AS probes, sum(score)::BIGINT AS total_score, sum(maximum)::BIGINT AS total_maximum,
    sum(prompt_tokens)::BIGINT AS total_prompt_tokens, round(sum(seconds), 6) AS total_seconds,
    count(*) FILTER (style_violations = 0) AS style_ok_count, sum(style_violations)::BIGINT AS total_style_violations"""


@query("probe_totals", f"WITH {PROBE_SQL} SELECT run_id, {_TOTALS_SQL} FROM report WHERE context GROUP BY run_id")
def _probe_totals(spark, sf_dir):
    return quality.probe_totals(_arms(spark, sf_dir)[0])


@query(
    "probe_deltas",
    f"""WITH {PROBE_SQL} SELECT a.run_id, a.id, a.score - b.score AS score_delta,
    a.prompt_tokens - b.prompt_tokens AS prompt_token_delta
    FROM report a JOIN report b ON a.run_id = b.run_id AND a.id = b.id AND a.context AND NOT b.context""",
)
def _probe_deltas(spark, sf_dir):
    return quality.probe_deltas(*_arms(spark, sf_dir))


@query(
    "probe_compare",
    f"""WITH {PROBE_SQL}, s AS (SELECT run_id, coalesce(sum(score) FILTER (context), 0) AS a,
      coalesce(sum(score) FILTER (NOT context), 0) AS b, coalesce(sum(prompt_tokens) FILTER (context), 0) AS c,
      coalesce(sum(prompt_tokens) FILTER (NOT context), 0) AS d FROM report GROUP BY 1)
    SELECT run_id, a::BIGINT AS score_on, b::BIGINT AS score_off, (a - b)::BIGINT AS total_score_delta,
    (c - d)::BIGINT AS total_prompt_token_delta FROM s""",
)
def _probe_compare(spark, sf_dir):
    on, off = _arms(spark, sf_dir)
    arms = on.withColumn("context", F.lit(True)).unionByName(off.withColumn("context", F.lit(False)))
    return quality.probe_compare(arms)


@query(
    "ab_question_report",
    f"""WITH {PROBE_SQL} SELECT id AS question_id, (sum(score) FILTER (context))::BIGINT AS score_on,
    (sum(score) FILTER (NOT context))::BIGINT AS score_off, (sum(prompt_tokens) FILTER (context))::BIGINT AS tokens_on,
    (sum(prompt_tokens) FILTER (NOT context))::BIGINT AS tokens_off, round(sum(seconds) FILTER (context), 6) AS seconds_on,
    round(sum(seconds) FILTER (NOT context), 6) AS seconds_off FROM report GROUP BY id""",
)
def _ab(spark, sf_dir):
    on, off = _arms(spark, sf_dir)
    arms = on.withColumn("context", F.lit(True)).unionByName(off.withColumn("context", F.lit(False)))
    return quality.ab_question_report(arms.withColumnRenamed("id", "question_id"))


@query(
    "probe_repeat_stats",
    f"""WITH {PROBE_SQL} SELECT id, sum(score)::BIGINT AS score_sum, max(score) AS score_max, min(score) AS score_min
    FROM report WHERE context GROUP BY id""",
)
def _repeat_stats(spark, sf_dir):
    return quality.probe_repeat_stats(_arms(spark, sf_dir)[0])


@query(
    "fact_hit_rates",
    f"""WITH {PROBE_SQL}, facts AS (SELECT id, unnest(range(0, h + m)) AS i, h FROM report)
    SELECT id, 'f' || i AS fact, count(*) AS runs, (sum(CASE WHEN i < h THEN 1 ELSE 0 END))::BIGINT AS hits,
    round(avg(CASE WHEN i < h THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM facts GROUP BY 1, 2""",
)
def _hit_rates(spark, sf_dir):
    return quality.fact_hit_rates(_results(spark, sf_dir))


@query(
    "build_probe_records",
    f"""WITH {PROBE_SQL} SELECT 'quality_harness-' || run_id AS session_id, 'quality_harness' AS workflow_name,
    'COMPLETE' AS controller_decision, sum(score)::BIGINT AS total_score, sum(maximum)::BIGINT AS total_maximum,
    sum(prompt_tokens)::BIGINT AS total_prompt_tokens FROM report WHERE context GROUP BY run_id""",
)
def _probe_records(spark, sf_dir):
    built, _ = records.build_probe_records(_arms(spark, sf_dir)[0])
    return built.select(
        "session_id", "workflow_name", "controller_decision", "total_score", "total_maximum",
        "total_prompt_tokens",
    )


@query(
    "probe_run_export",
    f"""WITH {PROBE_SQL} SELECT a.run_id, a.id, a.score, a.maximum, a.score - b.score AS score_delta,
    a.prompt_tokens - b.prompt_tokens AS prompt_token_delta FROM report a
    LEFT JOIN report b ON a.run_id = b.run_id AND a.id = b.id AND NOT b.context WHERE a.context""",
)
def _probe_export(spark, sf_dir):
    on, off = _arms(spark, sf_dir)
    _, rows = records.probe_run_export(on, quality.probe_deltas(on, off))
    return rows.select("run_id", "id", "score", "maximum", "score_delta", "prompt_token_delta")


RUNS_SQL = f"""
{PROBE_SQL},
runs AS (SELECT 's' || run_id AS session_id, CASE WHEN run_id % 3 = 0 THEN 'quality_harness_compare' ELSE 'quality_harness' END AS workflow_name,
  strftime(max(ts), '%Y-%m-%d %H') AS completed_at, sum(score) AS total_score, sum(maximum) AS total_maximum,
  sum(prompt_tokens) AS total_prompt_tokens, sum(score) FILTER (context) - sum(score) FILTER (NOT context) AS total_score_delta
  FROM report GROUP BY run_id)
"""


def _runs(spark, sf_dir):
    e = F.col("event_id")
    run = F.floor(e / 200)
    on = e % 200 < 100
    score = _k() % 4
    folded = views.table(spark, sf_dir, "events").groupBy(run.alias("run")).agg(
        F.date_format(F.max("ts"), "yyyy-MM-dd HH").alias("completed_at"),
        F.sum(score).alias("total_score"),
        F.sum(_k() % 4 + _k() % 3).alias("total_maximum"),
        F.sum(F.when(_k() % 11 != 0, _k() * 10).otherwise(0)).alias("total_prompt_tokens"),
        (F.sum(F.when(on, score)) - F.sum(F.when(~on, score))).alias("total_score_delta"),
    )
    return folded.withColumn("session_id", F.concat(F.lit("s"), F.col("run").cast("string"))).withColumn(
        "workflow_name",
        F.when(F.col("run") % 3 == 0, "quality_harness_compare").otherwise("quality_harness"),
    )


@query(
    "quality_history",
    f"""WITH {RUNS_SQL} SELECT workflow_name, count(*) AS run_count,
    arg_max(session_id, (completed_at, session_id)) AS latest_session_id, max(completed_at) AS latest_completed_at,
    arg_max(total_score_delta, (completed_at, session_id))::BIGINT AS latest_score_delta,
    round(max(total_score / total_maximum::DOUBLE), 6) AS best_score_ratio,
    round(min(total_score / total_maximum::DOUBLE), 6) AS worst_score_ratio,
    round(avg(total_score / total_maximum::DOUBLE), 6) AS average_score_ratio,
    round(avg(total_prompt_tokens), 6) AS average_prompt_tokens FROM runs GROUP BY 1""",
)
def _quality_history(spark, sf_dir):
    return quality.quality_history(_runs(spark, sf_dir))


@query(
    "latest_run",
    f"""WITH {RUNS_SQL} SELECT workflow_name, arg_max(session_id, (completed_at, session_id)) AS session_id,
    max(completed_at) AS completed_at FROM runs GROUP BY 1""",
)
def _latest_run(spark, sf_dir):
    return records.latest_run(_runs(spark, sf_dir))


@query(
    "recent_missing_facts",
    f"""WITH {PROBE_SQL}, {K_SQL.replace('base', 'b2')} SELECT 's' || (event_id // 200) AS session_id, event_id % 200 AS position,
    'p' || (event_id % 100) AS probe_id, k % 3 AS missing FROM b2 WHERE k % 3 > 0
    ORDER BY event_id // 200 DESC, 's' || (event_id // 200) DESC, event_id % 200 LIMIT 20""",
)
def _recent_missing(spark, sf_dir):
    e = F.col("event_id")
    runs = views.table(spark, sf_dir, "events").select(
        F.floor(e / 200).alias("completed_at"),
        F.concat(F.lit("s"), F.floor(e / 200).cast("string")).alias("session_id"),
        (e % 200).alias("position"),
        F.concat(F.lit("p"), (e % 100).cast("string")).alias("probe_id"),
        F.array_repeat(F.lit("f"), (_k() % 3).cast("int")).alias("missing_facts"),
    )
    newest = quality.recent_missing_facts(runs)
    return newest.select(
        "session_id", "position", "probe_id", F.size("missing_facts").cast("bigint").alias("missing")
    )


# --- sets --------------------------------------------------------------------------------------

SETS_SQL = """
docs AS (SELECT d.doc_id, lang || '-' || source AS case_id, lang, d.n_chars, l.quality FROM documents d
  LEFT JOIN labels l ON l.doc_id = d.doc_id),
retrieved AS (SELECT case_id, 'symbol' AS kind, 'd' || doc_id AS item FROM docs WHERE n_chars > 900
  UNION SELECT case_id, 'module', 'n' || n_chars % 40 FROM docs WHERE n_chars > 900),
expected AS (SELECT case_id, 'symbol' AS kind, 'd' || doc_id AS item FROM docs WHERE quality = 1
  UNION SELECT case_id, 'module', 'n' || n_chars % 40 FROM docs WHERE quality = 1
  UNION SELECT case_id, 'relationship', 'r' || doc_id FROM docs WHERE quality = 0),
cases AS (SELECT DISTINCT case_id, kind FROM docs, (VALUES ('symbol'), ('module'), ('relationship')) AS k(kind)),
counted AS (SELECT c.case_id, c.kind, (SELECT count(*) FROM retrieved r WHERE r.case_id = c.case_id AND r.kind = c.kind) AS retrieved,
  (SELECT count(*) FROM expected r WHERE r.case_id = c.case_id AND r.kind = c.kind) AS expected,
  (SELECT count(*) FROM retrieved r JOIN expected e ON e.case_id = r.case_id AND e.kind = r.kind AND e.item = r.item
    WHERE r.case_id = c.case_id AND r.kind = c.kind) AS common FROM cases c),
rated AS (SELECT *, CASE WHEN retrieved = 0 THEN CASE WHEN expected > 0 THEN 0.0::DOUBLE ELSE 1.0 END ELSE common::DOUBLE / retrieved END AS p,
  CASE WHEN expected = 0 THEN 1.0::DOUBLE ELSE common::DOUBLE / expected END AS q FROM counted),
metrics AS (SELECT case_id, kind, retrieved, expected, common, round(p, 6) AS precision, round(q, 6) AS recall,
  round(CASE WHEN p + q = 0 THEN 0.0 ELSE 2.0::DOUBLE * p * q / (p + q) END, 6) AS f1 FROM rated)
"""


def _sets(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").join(
        views.table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    docs = docs.withColumn("case_id", F.concat_ws("-", "lang", "source"))
    name = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    item = {
        "symbol": name("d", F.col("doc_id")),
        "module": name("n", F.col("n_chars") % 40),
        "relationship": name("r", F.col("doc_id")),
    }
    pick = lambda rows, kinds: rows.select(
        "case_id",
        F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), item[k].alias("item")) for k in kinds])),
    )
    retrieved = pick(docs.where("n_chars > 900"), ["symbol", "module"])
    expected = pick(docs.where("quality = 1"), ["symbol", "module"]).unionByName(
        pick(docs.where("quality = 0"), ["relationship"])
    )
    cases = docs.select("case_id", F.explode(F.array(*[F.lit(k) for k in item])).alias("kind"))
    return quality.set_metrics(retrieved, expected, cases), docs


@query("set_metrics", f"WITH {SETS_SQL} SELECT * FROM metrics")
def _set_metrics(spark, sf_dir):
    return _sets(spark, sf_dir)[0]


SCORE_SQL = f"""
{SETS_SQL},
budgets AS (SELECT case_id, (sum(n_chars) // 4)::BIGINT AS estimated, 8000 AS limit_tokens FROM docs GROUP BY 1),
wide AS (SELECT case_id, max(f1) FILTER (kind = 'symbol') AS s, max(f1) FILTER (kind = 'module') AS m,
  max(f1) FILTER (kind = 'relationship') AS r, bool_or(kind = 'symbol' AND expected > 0 AND f1 < 0.1) AS ps,
  bool_or(kind = 'module' AND expected > 0 AND f1 < 0.1) AS pm FROM metrics GROUP BY 1),
scores AS (SELECT w.case_id, round(0.2::DOUBLE * (estimated <= limit_tokens)::INT + 0.4::DOUBLE * s + 0.2::DOUBLE * m + 0.2::DOUBLE * r, 6) AS score,
  concat_ws('|', CASE WHEN ps THEN 'symbol precision too low' END, CASE WHEN pm THEN 'module precision too low' END,
    CASE WHEN estimated > limit_tokens THEN 'token budget exceeded' END) AS failures,
  NOT (ps OR pm OR estimated > limit_tokens) AS passed, estimated FROM wide w JOIN budgets b ON b.case_id = w.case_id)
"""


def _scores(spark, sf_dir):
    metrics, docs = _sets(spark, sf_dir)
    budgets = docs.groupBy("case_id").agg(
        F.floor(F.sum("n_chars") / 4).alias("estimated_tokens"), F.lit(8000).alias("max_context_tokens")
    )
    return quality.benchmark_score(metrics, budgets), budgets


@query("benchmark_score", f"WITH {SCORE_SQL} SELECT case_id, score, failures, passed FROM scores")
def _benchmark_score(spark, sf_dir):
    return _scores(spark, sf_dir)[0].withColumn("failures", F.array_join("failures", "|"))


@query(
    "benchmark_report",
    f"""WITH {SCORE_SQL} SELECT count(*) AS executed, count(*) FILTER (passed) AS passed,
    count(*) FILTER (NOT passed) AS failed, round(avg(score), 6) AS average_score,
    round(avg(estimated), 2) AS average_duration_ms FROM scores""",
)
def _benchmark_report(spark, sf_dir):
    scores, budgets = _scores(spark, sf_dir)
    timed = budgets.select("case_id", F.col("estimated_tokens").alias("duration_ms"))
    return quality.benchmark_report(scores.join(timed, "case_id"))


@query(
    "run_consistency",
    f"""WITH {K_SQL}, rows AS (SELECT user_id AS case_id, dayofyear(ts) % 4 AS run, k % 3 AS output,
      event_id AS position FROM base),
    outputs AS (SELECT DISTINCT case_id, run, output FROM rows),
    folded AS (SELECT case_id, run, string_agg(output, ',' ORDER BY output) AS o FROM outputs GROUP BY 1, 2),
    firsts AS (SELECT case_id, arg_min(o, run) AS f, count(*) AS runs FROM folded GROUP BY 1)
    SELECT f.case_id, runs, round(CASE WHEN runs < 2 THEN 1.0::DOUBLE
      ELSE (count(*) FILTER (o = f.f) - 1)::DOUBLE / (runs - 1) END, 6) AS consistency
    FROM folded g JOIN firsts f ON f.case_id = g.case_id GROUP BY f.case_id, runs""",
)
def _run_consistency(spark, sf_dir):
    outputs = views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"),
        (F.dayofyear("ts") % 4).alias("run"),
        (_k() % 3).alias("position"),
        (_k() % 3).cast("string").alias("output"),
    )
    return quality.run_consistency(outputs.distinct())


METRIC_SQL = f"""
{K_SQL},
runs AS (SELECT event_id AS run_id, k % 5 AS symbols, k % 4 AS modules, (k % 50) * 40 AS estimated, k * 20 AS prompt,
  k * 2 AS completion, value AS duration_ms, event_type <> 'error' AS success, k % 6 AS steps, least(k % 3, k % 6) AS failed,
  k % 3 AS diagnostics FROM base),
raw AS (
  SELECT run_id, 'selected_symbols_count' AS name, symbols::DOUBLE AS value, 0.25 AS weight, true AS passed FROM runs WHERE symbols > 0
  UNION ALL SELECT run_id, 'selected_modules_count', modules, 0.25, true FROM runs WHERE modules > 0
  UNION ALL SELECT run_id, 'context_compression_ratio', least(prompt::DOUBLE / estimated, 1.0), 0.5, least(prompt::DOUBLE / estimated, 1.0) >= 0.5 FROM runs WHERE estimated > 0
  UNION ALL SELECT run_id, 'context_utilization', prompt::DOUBLE / estimated, 0.5, prompt::DOUBLE / estimated BETWEEN 0.5 AND 1.5 FROM runs WHERE estimated > 0
  UNION ALL SELECT run_id, 'execution_duration_ms', duration_ms, 0.3, duration_ms < 300000 FROM runs WHERE steps > 0
  UNION ALL SELECT run_id, 'total_tokens', prompt + completion, 0.3, prompt + completion < 100000 FROM runs WHERE prompt + completion > 0
  UNION ALL SELECT run_id, 'workflow_completeness', c, 0.4, c >= 0.8 FROM (SELECT run_id, CASE WHEN success OR steps <= 0 THEN 1.0::DOUBLE ELSE (steps - failed)::DOUBLE / steps END AS c FROM runs)
  UNION ALL SELECT run_id, 'diagnostics_collected', diagnostics, 0.3, true FROM runs WHERE diagnostics > 0
  UNION ALL SELECT run_id, 'architecture_findings_count', diagnostics, 0.3, true FROM runs WHERE diagnostics > 0
  UNION ALL SELECT run_id, 'throughput', (prompt + completion) / (duration_ms / 1000.0), 0.5, true FROM runs WHERE prompt + completion > 0 AND duration_ms > 0
  UNION ALL SELECT run_id, 'execution_consistency', 1.0, 0.5, true FROM runs
  UNION ALL SELECT run_id, 'identifier_stability', 1.0, 0.5, true FROM runs),
metrics AS (SELECT run_id, name, round(value, 6) AS value, weight::DOUBLE AS weight, passed FROM raw),
members AS (SELECT * FROM (VALUES {', '.join(str(pair) for pair in quality.CATEGORY_METRICS)}) AS m(category, name)),
cats AS (SELECT run_id, category, round(greatest(0.0, least(1.0::DOUBLE, sum(value * weight) / sum(weight))), 6) AS score
  FROM metrics JOIN members USING (name) GROUP BY 1, 2),
weights AS (SELECT * FROM (VALUES {', '.join(str(pair) for pair in quality.CATEGORY_WEIGHTS.items())}) AS w(category, cw))
"""


def _eval(spark, sf_dir):
    runs = views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        (_k() % 5).alias("symbols"),
        (_k() % 4).alias("modules"),
        ((_k() % 50) * 40).alias("estimated_tokens"),
        (_k() * 20).alias("prompt_tokens"),
        (_k() * 2).alias("completion_tokens"),
        F.col("value").alias("duration_ms"),
        (F.col("event_type") != "error").alias("success"),
        (_k() % 6).alias("steps"),
        F.least(_k() % 3, _k() % 6).alias("failed_steps"),
        (_k() % 3).alias("diagnostics"),
    )
    return quality.eval_metrics(runs)


@query("eval_metrics", f"WITH {METRIC_SQL} SELECT run_id, name, value, weight, passed FROM metrics")
def _eval_metrics(spark, sf_dir):
    return _eval(spark, sf_dir)


@query("category_scores", f"WITH {METRIC_SQL} SELECT run_id, category, score FROM cats")
def _category_scores(spark, sf_dir):
    return quality.category_scores(_eval(spark, sf_dir))


@query(
    "overall_score",
    f"""WITH {METRIC_SQL} SELECT run_id, round(sum(score * cw::DOUBLE) / sum(cw::DOUBLE), 6) AS overall
    FROM cats JOIN weights USING (category) GROUP BY run_id""",
)
def _overall_score(spark, sf_dir):
    return quality.overall_score(quality.category_scores(_eval(spark, sf_dir)))
