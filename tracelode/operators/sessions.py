"""Reports over the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.ordered import sorted_ordinal
from tracelode.functions.stats import distribution, percent, ratio, rounded, widen

NEW_CONVERSATION = "__new__"

# Prompt-size buckets, upper bound exclusive.
PROMPT_BUCKETS = (("<10k", 10_000), ("10-30k", 30_000), ("30-60k", 60_000), (">60k", None))


def clean_requests(raw: DataFrame) -> DataFrame:
    """One flat row per request, defaults filled in for the parts older logs lack."""
    flag = lambda name: F.coalesce(F.col(f"history.{name}"), F.lit(False)).alias(name)
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint")
    return raw.select(
        "request_id",
        F.try_to_timestamp("timestamp").alias("ts"),
        F.coalesce("conversation_key", F.lit(NEW_CONVERSATION)).alias("conversation_key"),
        "model",
        F.coalesce("intent", F.lit("DEFAULT")).alias("intent"),
        "status",
        "error",
        F.coalesce("context.status", F.lit("disabled")).alias("context_status"),
        count("context.symbols_selected").alias("symbols_selected"),
        count("context.symbols_new").alias("symbols_new"),
        count("context.symbols_suppressed").alias("symbols_suppressed"),
        F.col("context.estimated_tokens").alias("estimated_tokens"),
        F.col("context.max_tokens").alias("max_tokens"),
        F.col("usage.prompt_tokens").alias("prompt_tokens"),
        F.col("usage.completion_tokens").alias("completion_tokens"),
        F.col("timing.total_ms").alias("total_ms"),
        F.col("timing.ttft_ms").alias("ttft_ms"),
        F.col("timing.pipeline_ms").alias("pipeline_ms"),
        F.col("timing.provider_wait_ms").alias("provider_wait_ms"),
        F.col("timing.stages").alias("stages"),
        F.col("history").isNotNull().alias("has_history"),
        flag("cap_enabled"),
        flag("cap_applied"),
        count("history.budget").alias("budget"),
        count("history.dropped_count").alias("dropped_count"),
        count("history.tokens_after").alias("tokens_after"),
        F.coalesce("last_user_message", F.lit("")).alias("last_user_message"),
    )


def status_counts(requests: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") == "ok")
    total = F.count(F.lit(1))
    return requests.agg(
        total.alias("total"), ok.alias("ok"), (total - ok).alias("error")
    )


def value_distribution(requests: DataFrame, column: str) -> DataFrame:
    """Count and share per value. The total comes from the counts, not from a second scan."""
    counts = requests.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select(
        column, "n", rounded(percent(F.col("n"), total)).alias("pct")
    )


def intent_distribution(requests: DataFrame) -> DataFrame:
    """Share per intent, with a flag telling that no request got any intent."""
    shares = value_distribution(requests, "intent")
    return shares.withColumn(
        "all_default", (F.col("intent") == "DEFAULT") & (F.col("pct") == 100.0)
    )


def context_status_distribution(requests: DataFrame) -> DataFrame:
    return value_distribution(requests, "context_status")


def _spread(metric: str, prefix: str, *statistics: str) -> dict[str, tuple[str, str]]:
    return {f"{prefix}_{name}": (metric, name) for name in statistics}


def latency_summary(requests: DataFrame) -> DataFrame:
    long = distribution(requests, [], {"total": F.col("total_ms")})
    return widen(long, [], _spread("total", "total", "n", "median", "p90", "mean", "min", "max"))


def ttft_summary(requests: DataFrame) -> DataFrame:
    long = distribution(requests, [], {"ttft": F.col("ttft_ms")})
    return widen(long, [], _spread("ttft", "ttft", "n", "median", "p90", "mean"))


def approximate_latency(requests: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One-pass sketch version of the latency summary, for when an estimate will do."""
    sketch = F.percentile_approx("total_ms", [0.5, 0.9], accuracy)
    return requests.agg(sketch.alias("q")).select(
        F.col("q")[0].alias("median"), F.col("q")[1].alias("p90")
    )


def prompt_tokens_summary(requests: DataFrame) -> DataFrame:
    long = distribution(requests, [], {"prompt": F.col("prompt_tokens")})
    return widen(long, [], _spread("prompt", "prompt", "n", "median", "mean", "min", "max"))


def prompt_tokens_by_context_status(requests: DataFrame) -> DataFrame:
    long = distribution(requests, ["context_status"], {"prompt": F.col("prompt_tokens")})
    return widen(long, ["context_status"], _spread("prompt", "prompt", "n", "median", "mean"))


def suppression_effect(requests: DataFrame) -> DataFrame:
    """Share of symbols suppressed per turn, over conversations with more than one turn.

    Turns are folded per conversation into ratio counts before anything is joined, so one key
    holding a third of all turns stays a small row set (a turn has few distinct ratios).
    """
    offered = F.col("symbols_new") + F.col("symbols_suppressed")
    folded = requests.groupBy(
        "conversation_key", F.when(offered > 0, F.col("symbols_suppressed") / offered).alias("ratio")
    ).agg(F.count(F.lit(1)).alias("turns"))
    many = (
        folded.groupBy("conversation_key")
        .agg(F.sum("turns").alias("turns"))
        .where(F.col("turns") > 1)
        .select("conversation_key")
    )
    kept = folded.join(many, "conversation_key", "left_semi")
    long = distribution(kept, [], {"ratio": F.col("ratio")}, {"median": 0.5}, F.col("turns"))
    parts = {name: ("ratio", name) for name in ("n", "mean", "median", "min", "max")}
    summary = widen(long, [], parts)
    conversations = many.agg(F.count(F.lit(1))).scalar()
    return summary.withColumn("multi_turn_conversations", conversations)


def turns_per_conversation(requests: DataFrame) -> DataFrame:
    """Turn counts per conversation; conversations of more than one turn are counted apart."""
    sizes = requests.groupBy("conversation_key").agg(F.count(F.lit(1)).alias("turns"))
    shapes = sizes.groupBy("turns").agg(F.count(F.lit(1)).alias("conversations"))
    weight = F.col("conversations")
    long = distribution(shapes, [], {"turns": F.col("turns")}, {"median": 0.5}, weight)
    summary = widen(long, [], {name: ("turns", name) for name in ("n", "median", "min", "max")})
    several = shapes.where(F.col("turns") > 1).agg(
        F.coalesce(F.sum("conversations"), F.lit(0))
    ).scalar()
    return summary.select(
        F.col("n").alias("conversations"),
        several.alias("multi_turn_conversations"),
        F.col("median").alias("median_turns"),
        F.col("max").cast("bigint").alias("max_turns"),
        F.col("min").cast("bigint").alias("min_turns"),
    )


def timing_breakdown(requests: DataFrame) -> DataFrame:
    """Pipeline against provider time, and every named stage, as one row per part."""
    parts = requests.select(
        F.explode(
            F.map_concat(
                F.map_from_arrays(
                    F.array(F.lit("total: pipeline"), F.lit("total: provider")),
                    F.array("pipeline_ms", "provider_wait_ms"),
                ),
                F.coalesce("stages", F.create_map().cast("map<string,double>")),
            )
        ).alias("part", "ms")
    )
    long = distribution(parts, ["part"], {"ms": F.col("ms")}, {"median": 0.5})
    return long.select(
        "part", "n", rounded(F.col("median")).alias("median_ms"), rounded(F.col("mean")).alias("mean_ms")
    )


def prompt_bucket(tokens: Column) -> Column:
    expression = None
    for label, bound in PROMPT_BUCKETS:
        if bound is None:
            return expression.otherwise(label)
        test = tokens < bound
        expression = F.when(test, label) if expression is None else expression.when(test, label)
    raise ValueError("the last bucket must be open")


def latency_buckets(requests: DataFrame) -> DataFrame:
    """Latency by prompt size; a missing provider time counts as zero."""
    sized = requests.where(F.col("prompt_tokens").isNotNull() & F.col("total_ms").isNotNull())
    sized = sized.withColumn("bucket", prompt_bucket(F.col("prompt_tokens")))
    long = distribution(
        sized,
        ["bucket"],
        {
            "total": F.col("total_ms"),
            "provider": F.coalesce("provider_wait_ms", F.lit(0.0)),
        },
    )
    return widen(
        long,
        ["bucket"],
        {
            "n": ("total", "n"),
            "median_ms": ("total", "median"),
            "p90_ms": ("total", "p90"),
            "median_provider_ms": ("provider", "median"),
        },
    )


def latency_correlation(requests: DataFrame) -> DataFrame:
    def pearson(other: str) -> Column:
        return rounded(F.coalesce(F.nanvl(F.corr("prompt_tokens", other), F.lit(0.0)), F.lit(0.0)))

    return requests.agg(
        pearson("total_ms").alias("prompt_vs_total"),
        pearson("provider_wait_ms").alias("prompt_vs_provider"),
    )


def history_cap_report(requests: DataFrame) -> DataFrame:
    long = distribution(
        requests,
        [],
        {
            "budget": F.when(F.col("budget") != 0, F.col("budget")),
            "dropped": F.when(F.col("dropped_count") > 0, F.col("dropped_count")),
            "after": F.col("tokens_after"),
        },
        {"median": 0.5},
    )
    medians = widen(
        long,
        [],
        {
            "dropped_requests": ("dropped", "n"),
            "median_budget": ("budget", "median"),
            "median_dropped": ("dropped", "median"),
            "median_tokens_after": ("after", "median"),
        },
    )
    flags = requests.agg(
        F.count_if("cap_enabled").alias("enabled"), F.count_if("cap_applied").alias("applied")
    )
    return medians.select(
        flags.select("enabled").scalar().alias("cap_enabled"),
        flags.select("applied").scalar().alias("cap_applied"),
        "*",
    )


def _cost_distribution(requests: DataFrame, by: list[str]) -> DataFrame:
    estimated = F.col("estimated_tokens")
    spent = requests.where(estimated > 0)
    share = F.when(F.col("prompt_tokens") != 0, estimated * 100.0 / F.col("prompt_tokens"))
    used = F.when(F.col("max_tokens") != 0, estimated * 100.0 / F.col("max_tokens"))
    return distribution(
        spent,
        by,
        {
            "est": estimated,
            "prompt_pct": share,
            "budget": F.when(F.col("max_tokens") != 0, F.col("max_tokens")),
            "budget_pct": used,
        },
        {"median": 0.5},
    )


_COST_MEDIANS = {
    "n": ("est", "n"),
    "est_median": ("est", "median"),
    "prompt_pct_median": ("prompt_pct", "median"),
    "budget_median": ("budget", "median"),
    "budget_pct_median": ("budget_pct", "median"),
}


def context_cost(requests: DataFrame) -> DataFrame:
    extra = _spread("est", "est", "mean", "min", "max")
    return widen(_cost_distribution(requests, []), [], {**_COST_MEDIANS, **extra})


def context_cost_by_intent(requests: DataFrame) -> DataFrame:
    named = requests.withColumn(
        "intent", F.upper(F.coalesce(F.nullif(F.col("intent"), F.lit("")), F.lit("DEFAULT")))
    )
    return widen(_cost_distribution(named, ["intent"]), ["intent"], _COST_MEDIANS)


def time_ordinals(df: DataFrame, groups: list[str], ts: str, tie: str) -> DataFrame:
    """Position 1..n of each row within its group by (ts, tie): the largest ordered set is one
    group's hours, one hour's seconds, or one second's rows."""
    hour, second = F.date_trunc("hour", F.col(ts)), F.date_trunc("second", F.col(ts))
    return sorted_ordinal(
        df, groups, [(hour, False), (second, False)], [F.col(ts), F.col(tie)], "ordinal"
    )


def context_cost_delta(requests: DataFrame) -> DataFrame:
    """Median of assembled minus baseline prompt tokens, paired by position in the log.

    The baseline is the `empty` turns, or the `disabled` ones where there are no empty turns.
    """
    sized = requests.where(F.col("prompt_tokens").isNotNull()).select(
        "context_status", "ts", "request_id", "prompt_tokens"
    )
    empties = sized.where(F.col("context_status") == "empty").agg(F.count(F.lit(1))).scalar()
    baseline = F.when(empties > 0, F.lit("empty")).otherwise(F.lit("disabled"))
    role = F.when(F.col("context_status") == "assembled", "assembled").when(
        F.col("context_status") == baseline, "baseline"
    )
    placed = time_ordinals(
        sized.withColumn("role", role).where(F.col("role").isNotNull()), ["role"], "ts", "request_id"
    )
    left = placed.where(F.col("role") == "assembled").select(
        "ordinal", F.col("prompt_tokens").alias("with_context")
    )
    right = placed.where(F.col("role") == "baseline").select(
        "ordinal", F.col("prompt_tokens").alias("without")
    )
    delta = F.col("with_context") - F.col("without")
    long = distribution(left.join(right, "ordinal"), [], {"delta": delta}, {"median": 0.5})
    return widen(long, [], {"pairs": ("delta", "n"), "median_delta": ("delta", "median")})


def stage_split(requests: DataFrame, provider_stage: str = "provider") -> DataFrame:
    """Sum of all stages but the provider's, and the provider's own time, per request."""
    others = F.map_values(F.map_filter("stages", lambda name, _: name != provider_stage))
    return requests.select(
        "request_id",
        rounded(F.aggregate(others, F.lit(0.0), lambda total, ms: total + ms)).alias("pipeline_ms"),
        rounded(F.coalesce(F.col("stages")[provider_stage], F.lit(0.0))).alias("provider_ms"),
    )


def session_summary(requests: DataFrame) -> DataFrame:
    """Success rate, mean times and cap rate of the whole log, in one pass."""
    ok = F.count_if(F.col("status") == "ok")
    total = F.count(F.lit(1))
    present = F.count_if("has_history")
    return requests.agg(
        total.alias("total_records"),
        ok.alias("success_count"),
        (total - ok).alias("failure_count"),
        rounded(ratio(ok, total)).alias("success_rate"),
        rounded(F.avg("total_ms")).alias("avg_total_ms"),
        rounded(F.avg("provider_wait_ms")).alias("avg_provider_wait_ms"),
        rounded(ratio(F.count_if(F.col("has_history") & F.col("cap_applied")), present)).alias(
            "history_cap_rate"
        ),
    )


def session_breakdowns(requests: DataFrame) -> DataFrame:
    """Counts per error text (first 80 characters), intent and model, as (dimension, item, n)."""
    items = F.array(
        F.struct(F.lit("error").alias("dimension"), F.substring("error", 1, 80).alias("item")),
        F.struct(F.lit("intent").alias("dimension"), F.col("intent").alias("item")),
        F.struct(F.lit("model").alias("dimension"), F.col("model").alias("item")),
    )
    return (
        requests.select(F.inline(items))
        .where(F.coalesce("item", F.lit("")) != "")
        .groupBy("dimension", "item")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def slowest_requests(requests: DataFrame, limit: int = 5) -> DataFrame:
    """The slowest requests with a preview; ties go to the smaller request id."""
    return (
        requests.select(
            F.substring("request_id", 1, 12).alias("request_id"),
            F.coalesce("total_ms", F.lit(0.0)).alias("total_ms"),
            F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
            F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"),
            F.col("pipeline_ms"),
            "context_status",
            F.substring("last_user_message", 1, 80).alias("preview"),
        )
        .orderBy(F.desc("total_ms"), "request_id")
        .limit(limit)
    )


def error_requests(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("status") == "error").select(
        F.substring("request_id", 1, 12).alias("request_id"),
        F.substring(F.coalesce("error", F.lit("unknown")), 1, 120).alias("error"),
        F.substring("last_user_message", 1, 80).alias("preview"),
    )


def cap_run_comparison(runs: DataFrame) -> DataFrame:
    """Per cap setting: median tokens and latency, worst latency, dropped rows and errors."""
    long = distribution(
        runs,
        ["label"],
        {"tokens": F.col("prompt_tokens"), "latency": F.col("total_ms")},
        {"median": 0.5},
    )
    medians = widen(
        long,
        ["label"],
        {
            "median_tokens": ("tokens", "median"),
            "median_latency": ("latency", "median"),
            "max_latency": ("latency", "max"),
        },
    )
    totals = runs.groupBy("label").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("dropped_count").alias("dropped"),
        F.count_if(F.col("status") != "ok").alias("errors"),
    )
    return totals.join(medians, "label", "left")
