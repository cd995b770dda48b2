"""Evaluation of answers, probes, benchmark cases and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text
from tracelode.functions.stats import ratio

# Weights of a benchmark score and of the evaluation categories.
BENCHMARK_WEIGHTS = {"symbol": 0.4, "module": 0.2, "relationship": 0.2, "budget": 0.2}
CATEGORY_WEIGHTS = {
    "Context Quality": 0.25,
    "Execution Quality": 0.20,
    "Engineering Quality": 0.30,
    "Performance": 0.10,
    "Determinism": 0.15,
}
CATEGORY_METRICS = (
    ("Context Quality", "context_compression_ratio"),
    ("Context Quality", "context_utilization"),
    ("Context Quality", "selected_symbols_count"),
    ("Context Quality", "selected_modules_count"),
    ("Execution Quality", "execution_duration_ms"),
    ("Execution Quality", "total_tokens"),
    ("Execution Quality", "throughput"),
    ("Engineering Quality", "diagnostics_collected"),
    ("Engineering Quality", "architecture_findings_count"),
    ("Engineering Quality", "workflow_completeness"),
    ("Performance", "throughput"),
    ("Performance", "execution_duration_ms"),
    ("Determinism", "execution_consistency"),
    ("Determinism", "identifier_stability"),
)
# Metric weights.
METRIC_WEIGHTS = {
    "selected_symbols_count": 0.25,
    "selected_modules_count": 0.25,
    "context_compression_ratio": 0.50,
    "context_utilization": 0.50,
    "execution_duration_ms": 0.30,
    "total_tokens": 0.30,
    "workflow_completeness": 0.40,
    "diagnostics_collected": 0.30,
    "architecture_findings_count": 0.30,
    "throughput": 0.50,
    "execution_consistency": 0.50,
    "identifier_stability": 0.50,
}


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def score_facts(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Which expected facts each answer holds.

    Input: answers(answer_id, probe_id, answer), facts(probe_id, label, variants). Output:
    (answer_id, label, hit), one row per answer and fact of its probe.
    """
    normal = answers.select("answer_id", "probe_id", text.normalise_answer(F.col("answer")).alias("a"))
    variants = F.transform("variants", text.normalise_answer)
    wanted = facts.select("probe_id", "label", variants.alias("v"))
    hit = F.exists("v", lambda variant: F.col("a").contains(variant))
    return normal.join(wanted, "probe_id").select("answer_id", "label", hit.alias("hit"))


def probe_report(results: DataFrame) -> DataFrame:
    """One evaluated row per probe result: score, maximum, style, error, tokens, seconds.

    Input: (run_id, id, intent, hits[], misses[], style_violations[], prompt_tokens, seconds, error).
    """
    size = lambda name: F.size(F.coalesce(name, F.array().cast("array<string>")))
    return results.select(
        "run_id",
        "id",
        F.coalesce("intent", F.lit("")).alias("intent"),
        size("hits").cast("bigint").alias("score"),
        (size("hits") + size("misses")).cast("bigint").alias("maximum"),
        F.coalesce("misses", F.array().cast("array<string>")).alias("missing_facts"),
        size("style_violations").cast("bigint").alias("style_violations"),
        F.coalesce("prompt_tokens", F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.coalesce("seconds", F.lit(0.0)).alias("seconds"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("probes"),
        F.sum("score").alias("total_score"),
        F.sum("maximum").alias("total_maximum"),
        F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.round(F.sum("seconds"), 6).alias("total_seconds"),
        F.count_if(F.col("style_violations") == 0).alias("style_ok_count"),
        F.sum("style_violations").alias("total_style_violations"),
    ]


def probe_totals(report: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return report.groupBy(*by).agg(*_totals())


def probe_deltas(with_context: DataFrame, without: DataFrame) -> DataFrame:
    """Score and token deltas of probes present in both arms. Input: probe_report rows."""
    off = without.select(
        "run_id", "id", F.col("score").alias("score_off"), F.col("prompt_tokens").alias("tokens_off")
    )
    return with_context.join(off, ["run_id", "id"]).select(
        "run_id",
        "id",
        (F.col("score") - F.col("score_off")).alias("score_delta"),
        (F.col("prompt_tokens") - F.col("tokens_off")).alias("prompt_token_delta"),
    )


def probe_compare(arms: DataFrame) -> DataFrame:
    """Per run: totals of each arm over all its probes, and their difference.

    Input: probe_report rows with `context` true or false. One pass: each arm is a conditional sum.
    """
    on = F.col("context")

    def total(name: str, arm: Column) -> Column:
        return F.coalesce(F.sum(F.when(arm, F.col(name))), F.lit(0))

    return arms.groupBy("run_id").agg(
        total("score", on).alias("score_on"),
        total("score", ~on).alias("score_off"),
        (total("score", on) - total("score", ~on)).alias("total_score_delta"),
        (total("prompt_tokens", on) - total("prompt_tokens", ~on)).alias("total_prompt_token_delta"),
    )


def ab_question_report(results: DataFrame) -> DataFrame:
    """Per question, context on and off side by side: score, tokens, seconds.

    Input: (question_id, context, score, prompt_tokens, seconds).
    """

    def side(name: str, arm: Column) -> Column:
        return F.sum(F.when(arm, F.col(name)))

    on = F.col("context")
    return results.groupBy("question_id").agg(
        side("score", on).alias("score_on"),
        side("score", ~on).alias("score_off"),
        side("prompt_tokens", on).alias("tokens_on"),
        side("prompt_tokens", ~on).alias("tokens_off"),
        F.round(side("seconds", on), 6).alias("seconds_on"),
        F.round(side("seconds", ~on), 6).alias("seconds_off"),
    )


def probe_repeat_stats(report: DataFrame) -> DataFrame:
    """Sum, best and worst score per probe over repeated runs."""
    return report.groupBy("id").agg(
        F.sum("score").alias("score_sum"),
        F.max("score").alias("score_max"),
        F.min("score").alias("score_min"),
    )


def fact_hit_rates(results: DataFrame) -> DataFrame:
    """Per probe and fact: in how many runs it was asked and found."""
    facts = results.select(
        "id",
        F.explode(
            F.concat(
                F.transform("hits", lambda f: F.struct(f.alias("fact"), F.lit(1).alias("hit"))),
                F.transform("misses", lambda f: F.struct(f.alias("fact"), F.lit(0).alias("hit"))),
            )
        ).alias("f"),
    )
    return facts.groupBy("id", F.col("f.fact").alias("fact")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("f.hit").alias("hits"),
        F.round(F.avg("f.hit"), 6).alias("hit_rate"),
    )


def quality_history(runs: DataFrame) -> DataFrame:
    """Per workflow: runs, the latest run, best, worst and mean score ratio, mean prompt tokens.

    Input: (session_id, workflow_name, completed_at, total_score, total_maximum,
    total_prompt_tokens, total_score_delta); for comparison runs the totals of the context arm.
    """
    share = ratio(F.coalesce("total_score", F.lit(0)), F.coalesce("total_maximum", F.lit(0)))
    latest = F.max_by(
        F.struct("session_id", "completed_at", "total_score_delta"),
        F.struct("completed_at", "session_id"),
    )
    return (
        runs.withColumn("share", share)
        .groupBy("workflow_name")
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            latest.alias("latest"),
            F.round(F.max("share"), 6).alias("best_score_ratio"),
            F.round(F.min("share"), 6).alias("worst_score_ratio"),
            F.round(F.avg("share"), 6).alias("average_score_ratio"),
            F.round(F.avg(F.coalesce("total_prompt_tokens", F.lit(0))), 6).alias(
                "average_prompt_tokens"
            ),
        )
        .select(
            "workflow_name",
            "run_count",
            F.col("latest.session_id").alias("latest_session_id"),
            F.col("latest.completed_at").alias("latest_completed_at"),
            F.col("latest.total_score_delta").alias("latest_score_delta"),
            "best_score_ratio",
            "worst_score_ratio",
            "average_score_ratio",
            "average_prompt_tokens",
        )
    )


def recent_missing_facts(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs first: probes with missing facts.

    Input: (session_id, completed_at, workflow_name, position, probe_id, missing_facts[]), position
    being the probe's place in its run.
    """
    missing = runs.where(F.size("missing_facts") > 0)
    return missing.orderBy(F.desc("completed_at"), F.desc("session_id"), "position").limit(limit)


def set_metrics(retrieved: DataFrame, expected: DataFrame, cases: DataFrame) -> DataFrame:
    """Precision, recall and F1 of distinct (case_id, kind, item) sets, per case and kind.

    `cases(case_id, kind)` lists what to report, so that empty sides count: nothing retrieved gives
    precision 0 if something was expected, else 1; nothing expected gives recall 1.
    """
    got = retrieved.select("case_id", "kind", "item", F.lit(1).alias("r"), F.lit(0).alias("e"))
    want = expected.select("case_id", "kind", "item", F.lit(0).alias("r"), F.lit(1).alias("e"))
    items = (
        got.unionByName(want)
        .groupBy("case_id", "kind", "item")
        .agg(F.max("r").alias("r"), F.max("e").alias("e"))
    )
    counts = items.groupBy("case_id", "kind").agg(
        F.sum("r").alias("retrieved"),
        F.sum("e").alias("expected"),
        F.sum(F.col("r") * F.col("e")).alias("common"),
    )
    counts = cases.select("case_id", "kind").distinct().join(counts, ["case_id", "kind"], "left")
    counts = counts.na.fill(0, ["retrieved", "expected", "common"])
    precision = F.when(
        F.col("retrieved") == 0, F.when(F.col("expected") > 0, 0.0).otherwise(1.0)
    ).otherwise(F.col("common") / F.col("retrieved"))
    recall = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("common") / F.col("expected"))
    scored = counts.withColumn("p", precision).withColumn("q", recall)
    both = F.col("p") + F.col("q")
    f1 = F.when(both == 0, 0.0).otherwise(2.0 * F.col("p") * F.col("q") / both)
    return scored.select(
        "case_id", "kind", "retrieved", "expected", "common",
        F.round("p", 6).alias("precision"), F.round("q", 6).alias("recall"), F.round(f1, 6).alias("f1"),
    )


def benchmark_score(metrics: DataFrame, budgets: DataFrame) -> DataFrame:
    """Weighted score of a case from its F1 values and its token budget, and why it fails.

    Input: set_metrics rows with kinds symbol, module, relationship; budgets(case_id,
    estimated_tokens, max_context_tokens). A case fails on an F1 under 0.1 where symbols or modules
    were expected, or over budget.
    """

    def f1(kind: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("f1"))), F.lit(1.0))

    def poor(kind: str) -> Column:
        bad = (F.col("kind") == kind) & (F.col("expected") > 0) & (F.col("f1") < 0.1)
        return F.coalesce(F.bool_or(bad), F.lit(False))

    wide = metrics.groupBy("case_id").agg(
        f1("symbol").alias("symbol"),
        f1("module").alias("module"),
        f1("relationship").alias("relationship"),
        poor("symbol").alias("poor_symbols"),
        poor("module").alias("poor_modules"),
    )
    joined = budgets.join(wide, "case_id")
    within = F.col("estimated_tokens") <= F.col("max_context_tokens")
    budget = F.when(within, 1.0).otherwise(0.0)
    score = budget * BENCHMARK_WEIGHTS["budget"]
    for kind in ("symbol", "module", "relationship"):
        score = score + F.col(kind) * BENCHMARK_WEIGHTS[kind]
    failures = F.array_compact(
        F.array(
            F.when(F.col("poor_symbols"), "symbol precision too low"),
            F.when(F.col("poor_modules"), "module precision too low"),
            F.when(~within, "token budget exceeded"),
        )
    )
    return joined.select(
        "case_id",
        F.round(clamp(score), 6).alias("score"),
        failures.alias("failures"),
        (F.size(failures) == 0).alias("passed"),
    )


def benchmark_report(scores: DataFrame) -> DataFrame:
    executed = F.count(F.lit(1))
    passed = F.count_if("passed")
    return scores.agg(
        executed.alias("executed"),
        passed.alias("passed"),
        (executed - passed).alias("failed"),
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("average_score"),
        F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 2).alias("average_duration_ms"),
    )


def run_consistency(outputs: DataFrame) -> DataFrame:
    """Share of later runs of a case whose ordered outputs equal the first run's.

    Input: (case_id, run, position, output). A run is folded to sums of position-salted hashes, so a
    run of any length is compared without being gathered.
    """
    digest = lambda seed: F.xxhash64(F.lit(seed), "position", "output").cast("decimal(38,0)")
    runs = outputs.groupBy("case_id", "run").agg(
        F.count(F.lit(1)).alias("n"), F.sum(digest(1)).alias("h1"), F.sum(digest(2)).alias("h2")
    )
    print_ = F.struct("n", "h1", "h2")
    first = runs.groupBy("case_id").agg(
        F.min_by(print_, "run").alias("first"), F.count(F.lit(1)).alias("runs")
    )
    same = runs.join(first, "case_id").groupBy("case_id").agg(
        F.max("runs").alias("runs"), F.count_if(print_ == F.col("first")).alias("equal")
    )
    share = F.when(F.col("runs") < 2, 1.0).otherwise((F.col("equal") - 1) / (F.col("runs") - 1))
    return same.select("case_id", "runs", F.round(share, 6).alias("consistency"))


def eval_metrics(runs: DataFrame) -> DataFrame:
    """Evaluation metrics of each run in long form: (run_id, name, value, weight, passed).

    Input: (run_id, symbols, modules, estimated_tokens, prompt_tokens, completion_tokens,
    duration_ms, success, steps, failed_steps, diagnostics). Metrics a run has no data for are left
    out. Consistency and stability are 1 unless repeated runs say otherwise.
    """
    estimated, prompt = F.col("estimated_tokens"), F.col("prompt_tokens")
    total = F.coalesce(prompt, F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    used = prompt / estimated
    sized = (estimated > 0) & prompt.isNotNull()
    done = F.col("steps") - F.col("failed_steps")
    complete = F.when(F.col("success"), 1.0).when(F.col("steps") <= 0, 1.0)
    complete = complete.otherwise(clamp(done / F.col("steps")))
    speed = total / (F.col("duration_ms") / 1000.0)
    some = lambda name: F.when(F.col(name) > 0, F.col(name).cast("double"))
    values = {
        "selected_symbols_count": (some("symbols"), lambda v: v > 0),
        "selected_modules_count": (some("modules"), lambda v: v > 0),
        "context_compression_ratio": (F.when(sized, clamp(used)), lambda v: v >= 0.5),
        "context_utilization": (F.when(sized, used), lambda v: (v >= 0.5) & (v <= 1.5)),
        "execution_duration_ms": (
            F.when(F.col("steps") > 0, F.col("duration_ms").cast("double")),
            lambda v: v < 300000,
        ),
        "total_tokens": (F.when(total > 0, total.cast("double")), lambda v: v < 100000),
        "workflow_completeness": (complete, lambda v: v >= 0.8),
        "diagnostics_collected": (some("diagnostics"), lambda v: v > 0),
        "architecture_findings_count": (some("diagnostics"), lambda v: v >= 0),
        "throughput": (
            F.when((total > 0) & (F.col("duration_ms") > 0), speed),
            lambda v: v > 0,
        ),
        "execution_consistency": (F.lit(1.0), lambda v: v >= 0),
        "identifier_stability": (F.lit(1.0), lambda v: v >= 0),
    }
    rows = [
        F.struct(
            F.lit(name).alias("name"),
            F.round(value, 6).alias("value"),
            F.lit(METRIC_WEIGHTS[name]).alias("weight"),
            passes(value).alias("passed"),
        )
        for name, (value, passes) in values.items()
    ]
    return runs.select("run_id", F.inline(F.array(*rows))).where(F.col("value").isNotNull())


def category_scores(metrics: DataFrame) -> DataFrame:
    """Weighted mean of the metrics of each category, clamped to [0, 1]."""
    named = F.coalesce(
        *[
            F.when(
                F.col("name") == name,
                F.array(*[F.lit(c) for c, metric in CATEGORY_METRICS if metric == name]),
            )
            for name in METRIC_WEIGHTS
        ]
    )
    placed = metrics.select("run_id", F.explode(named).alias("category"), "value", "weight")
    sums = placed.groupBy("run_id", "category").agg(
        F.sum(F.col("value") * F.col("weight")).alias("v"), F.sum("weight").alias("w")
    )
    return sums.select(
        "run_id", "category", F.round(clamp(ratio(F.col("v"), F.col("w"))), 6).alias("score")
    )


def overall_score(scores: DataFrame) -> DataFrame:
    """Weighted mean of the category scores of each run."""
    weight = F.coalesce(
        *[F.when(F.col("category") == name, F.lit(w)) for name, w in CATEGORY_WEIGHTS.items()],
        F.lit(0.0),
    )
    weighed = scores.withColumn("w", weight).groupBy("run_id").agg(
        F.sum(F.col("score") * F.col("w")).alias("v"), F.sum("w").alias("w")
    )
    return weighed.select("run_id", F.round(clamp(ratio(F.col("v"), F.col("w"))), 6).alias("overall"))


def target_rank(ranked: DataFrame, targets: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Per query: 0-based place of each target (-1 if absent), repeats and unwanted names in the list.

    Input: ranked(query_id, rank from 1, name), targets(query_id, name), unwanted(prefix).
    """
    listed = ranked.groupBy("query_id", "name").agg(
        F.min("rank").alias("rank"), F.count(F.lit(1)).alias("copies")
    )
    places = targets.join(listed.select("query_id", "name", "rank"), ["query_id", "name"], "left")
    places = places.select("query_id", "name", F.coalesce(F.col("rank") - 1, F.lit(-1)).alias("place"))
    # Every beginning of a name is a row, so names meet prefixes by equality, however many prefixes there are.
    length = F.explode(F.sequence(F.lit(0), F.char_length("name"))).alias("n")
    starts = listed.select("name").distinct().select("name", length)
    starts = starts.select("name", F.left("name", F.col("n")).alias("prefix"))
    bad_names = starts.join(unwanted.select("prefix"), "prefix", "left_semi").select("name").distinct()
    bad = listed.join(bad_names, "name", "left_semi")
    bad = bad.groupBy("query_id").agg(F.count(F.lit(1)).alias("unwanted"))
    repeats = listed.groupBy("query_id").agg(F.count_if(F.col("copies") > 1).alias("repeated"))
    return (
        places.join(repeats, "query_id", "left").join(bad, "query_id", "left").na.fill(0)
    )


