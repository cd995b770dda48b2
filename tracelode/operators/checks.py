"""Consistency checks on change sets, requests, plans and reports.

A check gives rows that break a rule; nothing is gathered beyond one row per subject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.text import strip

# Fixed values.
PATCH_OPERATIONS = ("ADD", "MODIFY", "DELETE", "RENAME")
REPORT_STATUSES = ("PASSED", "FAILED", "WARNING", "SKIPPED")
MAX_REQUEST_ID, MAX_DESCRIPTION, MAX_CONTEXT_KEYS, MAX_METADATA_KEYS = 64, 10_000, 100, 50


def duplicate_changes(applied: DataFrame) -> DataFrame:
    """Paths applied more than once in an execution."""
    counts = applied.groupBy("execution_id", "path").agg(F.count(F.lit(1)).alias("times"))
    return counts.where(F.col("times") > 1)


def failed_changes(applied: DataFrame) -> DataFrame:
    """Per execution: files that failed to apply, and the severity that means."""
    counts = applied.groupBy("execution_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "FAILED").alias("failed")
    )
    return counts.withColumn("severity", F.when(F.col("failed") > 0, "MEDIUM").otherwise("INFO"))


def unexpected_changes(warnings: DataFrame) -> DataFrame:
    return warnings.where(F.col("warning").rlike("(?i)unexpected|untracked"))


def stats_mismatch(applied: DataFrame, reported: DataFrame) -> DataFrame:
    """Reported counts that differ from the applied files, and negative line counts.

    Output: (execution_id, field, reported, actual).
    """
    op = F.col("operation")
    actual = applied.groupBy("execution_id").agg(
        F.count_if(op == "MODIFY").alias("a_modified"),
        F.count_if(op == "ADD").alias("a_created"),
        F.count_if(op == "DELETE").alias("a_deleted"),
        F.count(F.lit(1)).alias("a_total"),
    )
    joined = reported.join(actual, "execution_id", "full").na.fill(0)
    pairs = [
        ("files_modified", F.col("a_modified")),
        ("files_created", F.col("a_created")),
        ("files_deleted", F.col("a_deleted")),
        ("total_operations", F.col("a_total")),
        ("lines_added", F.greatest("lines_added", F.lit(0))),
        ("lines_removed", F.greatest("lines_removed", F.lit(0))),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.col(name).cast("bigint").alias("reported"),
                value.cast("bigint").alias("actual"),
            )
            for name, value in pairs
        ]
    )
    return joined.select("execution_id", F.inline(rows)).where(F.col("reported") != F.col("actual"))


def conflicting_changes(applied: DataFrame) -> DataFrame:
    """Paths both added and deleted, or both renamed and modified."""
    has = lambda name: F.bool_or(F.col("operation") == name)
    folded = applied.groupBy("execution_id", "path").agg(
        (has("ADD") & has("DELETE")).alias("add_delete"),
        (has("RENAME") & has("MODIFY")).alias("rename_modify"),
    )
    kinds = F.array_compact(
        F.array(
            F.when(F.col("add_delete"), "ADD and DELETE"),
            F.when(F.col("rename_modify"), "RENAME and MODIFY"),
        )
    )
    return folded.select("execution_id", "path", F.explode(kinds).alias("conflict"))


def hunk_checks(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """Problems of a patch as (file_path, problem, n).

    Input: files(file_path, operation), hunks(file_path, old_start, old_count, new_start, new_count,
    diff_lines).
    """
    signature = ["file_path", "old_start", "old_count", "new_start", "new_count", "diff_lines"]
    repeated = hunks.groupBy(*signature).agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    repeated = repeated.groupBy("file_path").agg(F.sum("n").alias("n"))
    negative = F.lit(0)
    for name in ("old_start", "old_count", "new_start", "new_count"):
        negative = negative + F.when(F.col(name) < 0, 1).otherwise(0)
    ranges = hunks.groupBy("file_path").agg(F.sum(negative).alias("n")).where("n > 0")
    bad_op = F.coalesce(~F.col("operation").isin(*PATCH_OPERATIONS), F.lit(True))
    operations = files.where(bad_op).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    copies = files.groupBy("file_path").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    empty = files.select("file_path").distinct().join(hunks, "file_path", "left_anti")
    empty = empty.withColumn("n", F.lit(1))

    def problem(name: str, rows: DataFrame) -> DataFrame:
        return rows.select("file_path", F.lit(name).alias("problem"), F.col("n").cast("bigint").alias("n"))

    return (
        problem("duplicate hunk", repeated)
        .unionByName(problem("invalid range", ranges))
        .unionByName(problem("invalid operation", operations))
        .unionByName(problem("duplicate path", copies))
        .unionByName(problem("empty patch", empty))
    )


def patch_dedupe(hunks: DataFrame) -> DataFrame:
    """One patch id per distinct (path, hunks). Input: hunks(patch_id, file_path, position, ...).

    Hunk lists are compared by two sums of position-salted hashes, not by gathering them.
    """
    digest = lambda seed: F.sum(
        F.xxhash64(
            F.lit(seed), "position", "old_start", "old_count", "new_start", "new_count", "diff_lines"
        ).cast("decimal(38,0)")
    )
    patches = hunks.groupBy("patch_id", "file_path").agg(
        F.count(F.lit(1)).alias("hunks"), digest(1).alias("h1"), digest(2).alias("h2")
    )
    kept = patches.groupBy("file_path", "hunks", "h1", "h2").agg(F.min("patch_id").alias("patch_id"))
    return kept.select("patch_id", "file_path", "hunks")


def patch_stats(hunks: DataFrame) -> DataFrame:
    """Files, hunks, added and removed lines per patch set, file headers not counted."""
    starts = lambda line, mark: line.startswith(mark) & ~line.startswith(mark * 3)
    added = F.size(F.filter("diff_lines", lambda line: starts(line, "+")))
    removed = F.size(F.filter("diff_lines", lambda line: starts(line, "-")))
    per_file = hunks.groupBy("patch_set", "file_path").agg(
        F.count(F.lit(1)).alias("h"), F.sum(added).alias("a"), F.sum(removed).alias("r")
    )
    return per_file.groupBy("patch_set").agg(
        F.count(F.lit(1)).alias("files_changed"),
        F.sum("h").alias("hunks"),
        F.sum("a").alias("added_lines"),
        F.sum("r").alias("removed_lines"),
        F.count_if(F.col("h") > 0).alias("modified_files"),
    )


def changed_lines(hunks: DataFrame) -> DataFrame:
    """Distinct old line numbers a file's hunks touch."""
    last = F.col("old_start") + F.col("old_count") - 1
    spans = hunks.where(F.col("old_count") > 0).select("file_path", "old_start", last.alias("last"))
    lines = spans.distinct().select("file_path", F.explode(F.sequence("old_start", "last")).alias("line"))
    return lines.distinct()


def report_checks(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Rule breaks of verification reports as (report_id, problem).

    Input: reports(report_id, score, status, executed, passed, failed, warnings, duration_ms),
    findings(report_id, finding_id).
    """
    none = F.lit(None).cast("string")
    counts = [
        F.when(F.col(name).isNull(), f"{name} missing").when(F.col(name) < 0, f"{name} negative")
        for name in ("executed", "passed", "failed", "warnings", "duration_ms")
    ]
    rules = F.array_compact(
        F.array(
            F.when(F.col("score").isNull(), "score missing").when(
                (F.col("score") < 0) | (F.col("score") > 1), "score out of range"
            ),
            F.when(F.col("status").isNull(), "status missing").when(
                ~F.col("status").isin(*REPORT_STATUSES), "invalid status"
            ),
            *counts,
            F.when(
                F.col("executed") != F.col("passed") + F.col("failed") + F.col("warnings"),
                "counts do not add up",
            ).otherwise(none),
        )
    )
    broken = reports.select("report_id", F.explode(rules).alias("problem"))
    repeated = findings.groupBy("report_id", "finding_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = repeated.where("n > 1").select(
        "report_id", F.concat(F.lit("duplicate finding "), "finding_id").alias("problem")
    )
    return broken.unionByName(repeated)


def request_checks(requests: DataFrame, operations: tuple[str, ...]) -> DataFrame:
    """Errors of each request row and whether it is VALID.

    Input: (request_id, operation, description, workspace_path, context map, metadata map).
    """
    request_id, path = F.col("request_id"), F.col("workspace_path")
    blank = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    empty_id = F.coalesce(request_id == "", F.lit(True))
    needs_path = F.col("operation") != "EXPLAIN"
    no_path = F.coalesce(path == "", F.lit(True))
    errors = F.array_compact(
        F.array(
            F.when(empty_id, "request_id empty"),
            F.when(~empty_id & (F.length(request_id) > MAX_REQUEST_ID), "request_id too long"),
            F.when(~empty_id & ~request_id.rlike(r"^[\p{L}\p{N}_.-]*$"), "request_id characters"),
            F.when(~F.col("operation").isin(*operations), "unknown operation"),
            F.when(blank(F.col("description")), "description empty").when(
                F.length("description") > MAX_DESCRIPTION, "description too long"
            ),
            F.when(needs_path & no_path, "workspace_path required")
            .when(needs_path & blank(path), "workspace_path blank")
            .when(needs_path & path.rlike(r'[<>:"|?*]'), "workspace_path characters"),
            F.when(F.size(F.map_keys("context")) > MAX_CONTEXT_KEYS, "too many context keys"),
            F.when(F.size(F.map_keys("metadata")) > MAX_METADATA_KEYS, "too many metadata keys"),
        )
    )
    return requests.select(
        "request_id", errors.alias("errors"), F.when(F.size(errors) > 0, "INVALID").otherwise("VALID").alias("status")
    )


def step_order_checks(steps: DataFrame) -> DataFrame:
    """Plans whose step orders are not exactly 0..n-1: repeats, negatives and numbers left out.

    Distinct orders that are non-negative fill 0..n-1 exactly when their count is n and their
    maximum n-1, so no plan is laid out in full. Output: (plan_id, steps, repeated, negative,
    missing), missing being how many of 0..n-1 do not occur.
    """
    folded = steps.groupBy("plan_id", "step_order").agg(F.count(F.lit(1)).alias("copies"))
    total = folded.groupBy("plan_id").agg(F.sum("copies").alias("steps"))
    inside = folded.join(total, "plan_id")
    in_range = (F.col("step_order") >= 0) & (F.col("step_order") < F.col("steps"))
    checked = inside.groupBy("plan_id").agg(
        F.max("steps").alias("steps"),
        F.sum(F.col("copies") - 1).alias("repeated"),
        F.sum(F.when(F.col("step_order") < 0, F.col("copies")).otherwise(0)).alias("negative"),
        F.count_if(in_range).alias("present"),
    )
    missing = F.col("steps") - F.col("present")
    broken = checked.select("plan_id", "steps", "repeated", "negative", missing.alias("missing"))
    return broken.where((F.col("repeated") > 0) | (F.col("negative") > 0) | (F.col("missing") > 0))
