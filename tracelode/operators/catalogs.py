"""Model catalogues, request normalisation and budgets per intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import rules

# Defaults of a model entry; fields of a request that have a slot of their own.
DEFAULT_CONTEXT_WINDOW, DEFAULT_MAX_OUTPUT = 131072, 8192
KNOWN_FIELDS = (
    "messages", "model", "stream", "tools", "tool_choice", "stop", "temperature", "top_p",
    "max_tokens", "frequency_penalty", "presence_penalty",
)
NUMBER_FIELDS = ("temperature", "top_p", "frequency_penalty", "presence_penalty")


def normalise_request(bodies: DataFrame, body: str = "body") -> DataFrame:
    """JSON request bodies as typed columns; wrong types become defaults, unknown keys go to `extra`."""
    parsed = bodies.withColumn("_v", F.try_parse_json(F.col(body)))
    value = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    kind = lambda name: F.schema_of_variant(value(name))
    get = lambda name, to: F.try_variant_get("_v", f"$.{name}", to)
    numeric = lambda name: kind(name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
    listed = lambda name: kind(name).startswith("ARRAY")
    as_json = lambda name: F.to_json(value(name))
    extra = F.map_filter(
        F.from_json(F.col(body), "map<string,string>"), lambda key, _: ~key.isin(*KNOWN_FIELDS)
    )
    return parsed.select(
        *bodies.columns,
        F.when(listed("messages"), as_json("messages")).otherwise("[]").alias("messages"),
        F.when(kind("model") == "STRING", get("model", "string")).otherwise("default").alias("model"),
        F.when(kind("stream") == "BOOLEAN", get("stream", "boolean")).otherwise(False).alias("stream"),
        F.when(listed("tools"), as_json("tools")).alias("tools"),
        as_json("tool_choice").alias("tool_choice"),
        as_json("stop").alias("stop"),
        *[F.when(numeric(name), get(name, "double")).alias(name) for name in NUMBER_FIELDS],
        F.when(kind("max_tokens") == "BIGINT", get("max_tokens", "bigint")).alias("max_tokens"),
        extra.alias("extra"),
    )


def with_defaults(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn(
        "context_window", F.coalesce("context_window", F.lit(DEFAULT_CONTEXT_WINDOW))
    ).withColumn("max_output_tokens", F.coalesce("max_output_tokens", F.lit(DEFAULT_MAX_OUTPUT)))


def model_resolve(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests with their model's definition; the backend name defaults to the model's own.

    A model not in the catalogue gives `resolved` false.
    """
    known = with_defaults(catalog).select(
        "model",
        F.coalesce("backend_model", "model").alias("backend_model"),
        "provider",
        "context_window",
        F.lit(True).alias("known"),
    )
    return requests.join(known, "model", "left").withColumn(
        "resolved", F.coalesce("known", F.lit(False))
    ).drop("known")


def unknown_models(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Models asked for that the catalogue lacks, with how often."""
    counts = requests.groupBy("model").agg(F.count(F.lit(1)).alias("requests"))
    return counts.join(catalog.select("model"), "model", "left_anti")


def model_catalog_checks(catalog: DataFrame, providers: tuple[str, ...]) -> DataFrame:
    """Rule breaks of catalogue entries as (entry, problem)."""
    window = F.coalesce("context_window", F.lit(DEFAULT_CONTEXT_WINDOW))
    output = F.coalesce("max_output_tokens", F.lit(DEFAULT_MAX_OUTPUT))
    missing = [F.when(F.col(k).isNull(), f"missing {k}") for k in ("model", "provider", "base_url")]
    broken = F.array_compact(
        F.array(
            *missing,
            F.when(~F.col("provider").isin(*providers), "unknown provider"),
            F.when(window <= 0, "context_window not positive"),
            F.when(output <= 0, "max_output_tokens not positive"),
            F.when(F.col("timeout") <= 0, "timeout not positive"),
            F.when(F.col("backend_model") == "", "backend_model empty"),
        )
    )
    rules_broken = catalog.select("entry", F.explode(broken).alias("problem"))
    names = catalog.where("model is not null")
    first = names.groupBy("model").agg(F.min("entry").alias("first"))
    repeated = names.join(first, "model").where(F.col("entry") > F.col("first"))
    return rules_broken.unionByName(
        repeated.select("entry", F.lit("duplicate model").alias("problem"))
    )


def backend_groups(catalog: DataFrame) -> DataFrame:
    """Models per (provider, base_url, api_key, timeout): how many, and the first by name."""
    return catalog.groupBy("provider", "base_url", "api_key", "timeout").agg(
        F.countDistinct("model").alias("models"), F.min("model").alias("first_model")
    )


def backend_models(catalog: DataFrame) -> DataFrame:
    """Models of each backend group as rows."""
    named = catalog.where(F.col("model").isNotNull())
    return named.select("provider", "base_url", "api_key", "timeout", "model").distinct()


def capability_lookup(requests: DataFrame) -> DataFrame:
    """What the named capability of each request takes along; nulls for a name that is not known."""
    kinds = ["string"] + ["boolean"] * 7 + ["int"] * 2
    schema = ", ".join(f"`{name}` {kind}" for name, kind in zip(rules.CAPABILITY_COLUMNS, kinds))
    table = requests.sparkSession.createDataFrame([tuple(row) for row in rules.CAPABILITY_PROFILES], schema)
    return requests.join(F.broadcast(table), "capability", "left")


def plan_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [tuple(rule) for rule in rules.PLAN_RULES],
        "intent string, relationship_expansion boolean, maximum_depth int, include_callers boolean,"
        " include_callees boolean, include_modules boolean, include_diagnostics boolean,"
        " estimated_complexity string, retrieval_profile string",
    )


def plan_rule_lookup(requests: DataFrame) -> DataFrame:
    """Retrieval flags of each request's intent, those of DEFAULT for an unknown intent."""
    known = [rule[0] for rule in rules.PLAN_RULES]
    intent = F.when(F.col("intent").isin(*known), F.col("intent")).otherwise("DEFAULT")
    table = F.broadcast(plan_rules(requests.sparkSession)).withColumnRenamed("intent", "rule")
    return requests.withColumn("rule", intent).join(table, "rule")


def intent_budgets(setting: Column) -> Column:
    """`A:1,B:2` as a map; bad items are ignored, the last of a repeated intent wins."""
    items = F.filter(F.split(setting, ","), lambda item: item.contains(":"))
    pairs = F.transform(
        items,
        lambda item: F.struct(
            F.upper(F.trim(F.substring_index(item, ":", 1))).alias("k"),
            F.regexp_extract(item, r"^[^:]*:\s*\+?(-?\d+)\s*$", 1).try_cast("bigint").alias("v"),
        ),
    )
    good = F.filter(pairs, lambda pair: (pair["k"] != "") & F.coalesce(pair["v"] > 0, F.lit(False)))
    last = F.filter(
        good,
        lambda pair, i: ~F.exists(
            F.slice(good, i + 2, F.size(good)), lambda later: later["k"] == pair["k"]
        ),
    )
    return F.map_from_entries(last)


def resolve_budget(override: Column, intent: Column, budgets: Column, default: int) -> Column:
    chosen = F.coalesce(F.try_element_at(budgets, F.upper(intent)), F.lit(default))
    return F.when(override > 0, override).otherwise(chosen)
