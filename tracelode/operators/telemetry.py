"""Telemetry events, metrics and traces, and roll-ups of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Event types; the part before the dot is the category.
EVENT_TYPES = (
    "gateway.request", "gateway.response",
    "pipeline.stage_start", "pipeline.stage_complete", "pipeline.stage_failed", "pipeline.complete",
    "workflow.plan_generated", "workflow.plan_executed", "workflow.step_started",
    "workflow.step_completed", "workflow.complete",
    "execution.step_start", "execution.step_complete", "execution.complete",
    "provider.call", "provider.response", "provider.error",
    "evaluation.started", "evaluation.completed",
    "patch.generated", "patch.applied",
    "modification.started", "modification.complete",
    "verification.started", "verification.completed",
    "autonomous.iteration_started", "autonomous.iteration_completed", "autonomous.goal_achieved",
    "autonomous.stopping_condition",
    "system.snapshot", "system.telemetry_record",
)
# What a finding of each severity takes off the score.
SEVERITY_WEIGHTS = {"INFO": 0.0, "LOW": 0.05, "MEDIUM": 0.15, "HIGH": 0.30, "CRITICAL": 0.50}


def events_where(events: DataFrame, **equals: str) -> DataFrame:
    """Events by category, type, correlation_id or request_id."""
    for name, value in equals.items():
        events = events.where(F.col(name) == value)
    return events


def metrics_where(metrics: DataFrame, name: str | None = None, **labels: str) -> DataFrame:
    """Metrics by name and label values."""
    if name is not None:
        metrics = metrics.where(F.col("name") == name)
    for key, value in labels.items():
        metrics = metrics.where(F.col("labels")[key] == value)
    return metrics


def validate_events(events: DataFrame) -> DataFrame:
    """Every event with whether its type is known and belongs to its category."""
    known = F.col("type").isin(*EVENT_TYPES)
    return events.withColumn(
        "valid", known & (F.substring_index("type", ".", 1) == F.col("category"))
    )


def metric_stats(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("name").agg(
        F.count("value").alias("count"),
        F.round(F.sum("value"), 6).alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.round(F.avg("value"), 6).alias("avg"),
    )


def latest_metric(metrics: DataFrame) -> DataFrame:
    """Last value per metric by (timestamp, metric_id)."""
    last = F.max_by("value", F.struct("timestamp", "metric_id"))
    return metrics.groupBy("name").agg(last.alias("value"))


def trace_steps(traces: DataFrame) -> DataFrame:
    """One row per step with its ordinal."""
    return traces.select("trace_id", F.posexplode("steps").alias("ordinal", "step")).select(
        "trace_id", F.col("ordinal").cast("bigint").alias("ordinal"), "step.*"
    )


def component_times(steps: DataFrame) -> DataFrame:
    return steps.groupBy("component").agg(
        F.count(F.lit(1)).alias("steps"), F.round(F.sum("duration_ms"), 6).alias("total_ms")
    )


def telemetry_snapshot(events: DataFrame, metrics: DataFrame, traces: DataFrame) -> DataFrame:
    """Row count, first and last time of each telemetry table."""

    def part(name: str, df: DataFrame) -> DataFrame:
        return df.agg(
            F.lit(name).alias("kind"),
            F.count(F.lit(1)).alias("n"),
            F.min("timestamp").alias("first"),
            F.max("timestamp").alias("last"),
        )

    return part("events", events).unionByName(part("metrics", metrics)).unionByName(part("traces", traces))


def verification_score(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Score, status and counts per verification run. Input: findings(run_id, severity)."""
    weight = F.lit(0.0)
    for name, taken in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == name, F.lit(taken)).otherwise(weight)
    has = lambda *names: F.count_if(F.col("severity").isin(*names))
    folded = findings.groupBy("run_id").agg(
        F.sum(weight).alias("taken"),
        F.count(F.lit(1)).alias("executed"),
        has("LOW", "MEDIUM").alias("warnings"),
        has("HIGH", "CRITICAL").alias("failed"),
        has("MEDIUM").alias("mediums"),
    )
    joined = runs.select("run_id").distinct().join(folded, "run_id", "left").na.fill(0)
    status = (
        F.when(F.col("executed") == 0, "SKIPPED")
        .when(F.col("failed") > 0, "FAILED")
        .when(F.col("mediums") > 0, "WARNING")
        .otherwise("PASSED")
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("taken")))
    return joined.select(
        "run_id",
        F.round(score, 6).alias("score"),
        status.alias("status"),
        "executed",
        (F.col("executed") - F.col("warnings") - F.col("failed")).alias("passed"),
        "warnings",
        "failed",
    )


def health_status(issues: DataFrame, subjects: DataFrame) -> DataFrame:
    """UNHEALTHY with an error, DEGRADED with a warning, else HEALTHY. Input: issues(subject, severity)."""
    folded = issues.groupBy("subject").agg(
        F.bool_or(F.col("severity").isin("ERROR", "CRITICAL")).alias("bad"),
        F.bool_or(F.col("severity") == "WARNING").alias("warned"),
    )
    status = F.when(F.col("bad"), "UNHEALTHY").when(F.col("warned"), "DEGRADED").otherwise("HEALTHY")
    return subjects.select("subject").distinct().join(folded, "subject", "left").select(
        "subject", status.alias("status")
    )
