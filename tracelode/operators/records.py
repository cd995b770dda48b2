"""Session records: building, ingesting, filtering, statistics, lifecycle and run control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.ordered import previous_value
from tracelode.functions.stats import ratio

SESSION_WORKFLOW = "gateway_session"
PROBE_WORKFLOW = "quality_harness"
COMPARE_WORKFLOW = "quality_harness_compare"

# Required fields of a record, allowed status changes, decision thresholds.
REQUIRED_FIELDS = (
    "session_id", "workflow_name", "request_summary", "transaction_id", "controller_decision",
    "completed_at",
)
TRANSITIONS = (
    ("CREATED", "PLANNING"),
    ("PLANNING", "EXECUTING"),
    ("EXECUTING", "VERIFYING"),
    ("VERIFYING", "COMPLETED"),
)
OPEN_STATUSES = ("CREATED", "PLANNING", "EXECUTING", "VERIFYING")
CLOSING_STATUSES = ("FAILED", "CANCELLED")
EVALUATION_THRESHOLD, REVIEW_THRESHOLD, MAX_RETRIES = 0.7, 0.5, 3
GOAL_SCORE, FAILURE_RUN = 0.8, 3
SUCCESS_STATUSES = ("PASSED", "COMPLETED", "SUCCESS")
COMPLEXITY = ("LOW", "MEDIUM", "HIGH", "VERY_HIGH")


def build_session_records(raw: DataFrame) -> DataFrame:
    """Log rows as session records. A row without an id gets one from its content."""
    content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in raw.columns])), 256)
    blank = lambda name: F.coalesce(F.col(name), F.lit(""))
    return raw.select(
        F.coalesce(F.nullif(F.col("request_id"), F.lit("")), content).alias("session_id"),
        F.lit(SESSION_WORKFLOW).alias("workflow_name"),
        F.concat_ws(" / ", blank("model"), blank("intent"), blank("status")).alias("request_summary"),
        blank("conversation_key").alias("transaction_id"),
        F.when(F.col("status") == "ok", "COMPLETE").otherwise("FAIL").alias("controller_decision"),
        F.replace(blank("timestamp"), F.lit("Z"), F.lit("+00:00")).alias("completed_at"),
        F.create_map(
            F.lit("model"), blank("model"),
            F.lit("intent"), blank("intent"),
            F.lit("error"), F.col("error"),
            F.lit("context"), F.to_json("context"),
            F.lit("usage"), F.to_json("usage"),
            F.lit("timing"), F.to_json("timing"),
            F.lit("history"), F.to_json("history"),
            F.lit("last_user_message"), blank("last_user_message"),
        ).alias("metadata"),
    )


def first_per_id(batch: DataFrame, key: str, order: str) -> DataFrame:
    """First record of each id by an explicit order; folded on the map side."""
    rest = [name for name in batch.columns if name != key]
    kept = batch.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return kept.select(key, *[F.col(f"r.{name}").alias(name) for name in rest])


def ingest_new_records(batch: DataFrame, store: DataFrame, key: str, order: str) -> DataFrame:
    """Records whose id is in neither the store nor earlier in the batch."""
    return first_per_id(batch, key, order).join(store.select(key), key, "left_anti")


def append_records(new: DataFrame, path: str) -> None:
    """Append to the record store, one folder per workflow."""
    new.write.mode("append").partitionBy("workflow_name").parquet(path)


def validate_records(records: DataFrame) -> DataFrame:
    """Every record with the list of required fields it lacks."""
    lacking = [F.when(F.col(name).isNull(), F.lit(name)) for name in REQUIRED_FIELDS]
    return records.withColumn("missing_fields", F.array_compact(F.array(*lacking)))


def delete_records(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("session_id").distinct(), "session_id", "left_anti")


def by_workflow(records: DataFrame, workflow: str) -> DataFrame:
    return records.where(F.col("workflow_name") == workflow)


def successful(records: DataFrame) -> DataFrame:
    return records.where(F.col("controller_decision") == "COMPLETE")


def failed(records: DataFrame) -> DataFrame:
    return records.where(F.col("controller_decision") != "COMPLETE")


def by_module(records: DataFrame, module: str) -> DataFrame:
    return records.where(F.array_contains("modules", module))


def recent_records(records: DataFrame, limit: int = 10) -> DataFrame:
    return records.orderBy(F.desc("completed_at"), F.desc("session_id")).limit(limit)


def latest_run(records: DataFrame) -> DataFrame:
    """Newest record of each workflow, ties to the larger id."""
    newest = F.max_by("session_id", F.struct("completed_at", "session_id"))
    return records.groupBy("workflow_name").agg(
        newest.alias("session_id"), F.max("completed_at").alias("completed_at")
    )


def record_statistics(records: DataFrame) -> DataFrame:
    """Totals over all records. Input has evaluation_score and iteration_count columns."""
    total = F.count(F.lit(1))
    ok = F.count_if(F.col("controller_decision") == "COMPLETE")
    return records.agg(
        total.alias("total_sessions"),
        ok.alias("successful_sessions"),
        (total - ok).alias("failed_sessions"),
        F.round(F.coalesce(F.avg("evaluation_score"), F.lit(0.0)), 6).alias("average_evaluation_score"),
        F.round(F.coalesce(F.avg("iteration_count"), F.lit(0.0)), 6).alias("average_iterations"),
        F.round(ratio(ok, total), 6).alias("success_rate"),
    )


def workflow_usage(records: DataFrame) -> DataFrame:
    return records.groupBy("workflow_name").agg(F.count(F.lit(1)).alias("sessions"))


def build_probe_records(
    report: DataFrame, deltas: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(records, probe rows) from probe_report rows; with deltas the runs count as comparisons.

    A record holds the run's totals. Its probes stay rows keyed by session id rather than one nested
    value, so a run may have any number of them.
    """
    from tracelode.operators.quality import probe_totals

    workflow = PROBE_WORKFLOW if deltas is None else COMPARE_WORKFLOW
    session = F.concat_ws("-", F.lit(workflow), "run_id")
    records = probe_totals(report).select(
        session.alias("session_id"),
        F.lit(workflow).alias("workflow_name"),
        session.alias("transaction_id"),
        F.lit("COMPLETE").alias("controller_decision"),
        "total_score", "total_maximum", "total_prompt_tokens", "total_seconds", "style_ok_count",
        "total_style_violations",
    )
    probes = report if deltas is None else report.join(deltas, ["run_id", "id"], "left")
    return records, probes.withColumn("session_id", session)


def probe_run_export(report: DataFrame, deltas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(run summaries, probe rows) to write side by side; deltas fill the probe rows in compare mode."""
    from tracelode.operators.quality import probe_totals

    mode = "single" if deltas is None else "compare_context"
    runs = probe_totals(report).withColumn("mode", F.lit(mode))
    rows = report
    if deltas is not None:
        rows = report.join(deltas, ["run_id", "id"], "left")
    return runs, rows


def decide_outcome(
    execution_failed: Column,
    verification_failed: Column,
    score: Column,
    retries: Column,
) -> Column:
    """FAIL, RETRY, COMPLETE or REQUEST_REVIEW of a run."""
    return (
        F.when(execution_failed, "FAIL")
        .when(verification_failed & (retries < MAX_RETRIES), "RETRY")
        .when(verification_failed, "FAIL")
        .when(score.isNull() | (score >= EVALUATION_THRESHOLD), "COMPLETE")
        .when(score >= REVIEW_THRESHOLD, "REQUEST_REVIEW")
        .otherwise("FAIL")
    )


def transition_allowed(before: Column, after: Column) -> Column:
    allowed = before.isin(*OPEN_STATUSES) & after.isin(*CLOSING_STATUSES)
    for source, target in TRANSITIONS:
        allowed = allowed | ((before == source) & (after == target))
    return allowed


def lifecycle_violations(events: DataFrame) -> DataFrame:
    """Status changes outside the allowed set. Input: (session_id, position, status)."""
    placed = previous_value(events, ["session_id"], "position", F.col("status"), "before")
    changed = placed.where(F.col("before").isNotNull())
    return changed.where(~transition_allowed(F.col("before"), F.col("status"))).select(
        "session_id", "position", "before", "status"
    )


def current_status(events: DataFrame) -> DataFrame:
    """Latest status per session and how many events carry an artifact."""
    return events.groupBy("session_id").agg(
        F.max_by("status", "position").alias("status"),
        F.count_if(F.col("artifact").isNotNull()).alias("artifacts"),
    )


def iteration_stats(iterations: DataFrame) -> DataFrame:
    """Counts, total duration and mean score of the iterations of each session."""
    return iterations.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_iterations"),
        F.count_if(F.col("status") == "COMPLETED").alias("successful_iterations"),
        F.count_if(F.col("status") == "FAILED").alias("failed_iterations"),
        F.round(F.sum(F.coalesce("duration_ms", F.lit(0.0))), 6).alias("total_duration_ms"),
        F.round(F.coalesce(F.avg("evaluation_score"), F.lit(0.0)), 6).alias("average_evaluation_score"),
    )


def stop_conditions(iterations: DataFrame, limits: DataFrame) -> DataFrame:
    """Reasons to stop each session.

    Input: iterations(session_id, position from 1, evaluation_score, verification_status, status,
    policy_stop), limits(session_id, max_iterations). The last n rows in a row failed exactly when
    the last row that did not fail lies at least n places back, so plain aggregates suffice.
    """
    folded = iterations.groupBy("session_id").agg(
        F.max("evaluation_score").alias("best"),
        F.max_by("verification_status", "position").alias("verified"),
        F.max_by(F.coalesce("policy_stop", F.lit(False)), "position").alias("policy"),
        F.max("position").alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.coalesce(F.col("status") != "FAILED", F.lit(True)), F.col("position"))).alias(
            "last_good"
        ),
    )
    joined = folded.join(limits, "session_id")
    in_a_row = F.col("last") - F.coalesce("last_good", F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("best") >= GOAL_SCORE, "goal achieved"),
            F.when(F.col("verified").isin(*SUCCESS_STATUSES), "verification successful"),
            F.when(F.col("n") >= F.col("max_iterations"), "maximum iterations reached"),
            F.when((F.col("n") >= FAILURE_RUN) & (in_a_row >= FAILURE_RUN), "repeated failures"),
            F.when(F.col("policy"), "policy requested stop"),
        )
    )
    return joined.select("session_id", reasons.alias("reasons"), (F.size(reasons) > 0).alias("stop"))


def plan_metrics(tasks: DataFrame) -> DataFrame:
    """Per plan: tokens, duration, highest complexity and number of distinct constraints.

    Input: (plan_id, tokens, duration_ms, complexity, constraint). Unknown levels count as LOW.
    """
    levels = F.array(*[F.lit(level) for level in COMPLEXITY])
    rank = F.greatest(F.array_position(levels, F.col("complexity")).cast("int"), F.lit(1))
    folded = tasks.groupBy("plan_id").agg(
        F.sum(F.coalesce("tokens", F.lit(0))).alias("estimated_tokens"),
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("estimated_duration_ms"),
        F.max(rank).alias("rank"),
    )
    constraints = tasks.select("plan_id", "constraint").where("constraint is not null").distinct()
    counted = constraints.groupBy("plan_id").agg(F.count(F.lit(1)).alias("constraints"))
    return folded.join(counted, "plan_id", "left").select(
        "plan_id",
        "estimated_tokens",
        "estimated_duration_ms",
        F.element_at(levels, F.col("rank")).alias("complexity"),
        F.coalesce("constraints", F.lit(0)).alias("constraints"),
    )
