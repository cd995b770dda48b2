"""Exact distribution summaries that never gather one group's values in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_E_FOLD = 1024
CELLS_PER_BIN = 16384


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rounded(column: Column, digits: int = 6) -> Column:
    return F.round(column.cast("double"), digits)


def round_half_even(column: Column, digits: int) -> Column:
    """Round a double in [0, 1] by its exact binary value, ties to even.

    `bround` works on the shortest decimal text of a double and takes 0.475, stored as slightly
    less, for a tie. Scaled by 2^60 the double is a whole number, so the comparison is exact.
    """
    unit = F.lit(2**60).cast("decimal(38,0)")
    whole = (column * F.lit(float(2**60))).cast("bigint").cast("decimal(20,0)") * F.lit(10**digits)
    rest = whole % unit
    down = ((whole - rest) / unit).cast("bigint")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (down % 2 == 1))
    return (down + F.when(up, 1).otherwise(0)) / F.lit(float(10**digits))


def distribution(
    df: DataFrame,
    by: Sequence[str],
    values: Mapping[str, Column],
    probabilities: Mapping[str, float] | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """n, mean, min, max and interpolated quantiles of several value columns per group.

    Output: one row per group and metric (`metric`, `n`, `mean`, `min`, `max`, one column per
    probability). Nulls are dropped per metric, so a metric without values has no row. With `weight`
    a row stands for that many equal ones.

    Exactness without a gather: values are counted per (group, value) first, then per
    order-preserving logarithmic bin. A running sum over the few bins of a group tells which bins
    hold the wanted ranks. Those are cut once more, evenly between their own smallest and largest
    value, so that values of a narrow range or near zero part as well, and only the distinct values
    of the cells that hold the ranks are ordered.
    """
    probabilities = probabilities or {"median": 0.5, "p90": 0.9}
    keys = [*by, "metric"]
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), column.cast("double").alias("value"))
            for name, column in values.items()
        ]
    )
    times = F.lit(1) if weight is None else weight
    long = df.select(*by, times.cast("bigint").alias("times"), F.inline(pairs))
    long = long.where(F.col("value").isNotNull())
    fine = F.floor(F.log1p(F.abs("value")) * BINS_PER_E_FOLD)
    counted = (
        long.groupBy(*keys, "value")
        .agg(F.sum("times").alias("cnt"))
        .withColumn("bin", F.when(F.col("value") < 0, -fine).otherwise(fine))
    )
    bins = counted.groupBy(*keys, "bin").agg(
        F.sum("cnt").alias("bin_n"),
        F.sum(F.col("value") * F.col("cnt")).alias("bin_total"),
        F.min("value").alias("bin_min"),
        F.max("value").alias("bin_max"),
    )
    group = Window.partitionBy(*keys)
    running = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = (
        bins.withColumn("n", F.sum("bin_n").over(group))
        .withColumn("total", F.sum("bin_total").over(group))
        .withColumn("lowest", F.min("bin_min").over(group))
        .withColumn("highest", F.max("bin_max").over(group))
        .withColumn("before", F.sum("bin_n").over(running) - F.col("bin_n"))
    )
    ranks = {name: (F.col("n") - 1) * F.lit(p) for name, p in probabilities.items()}

    def holds(rank: Column, start: Column, count: Column) -> Column:
        return (start <= rank) & (rank < start + count)

    wanted = F.lit(False)
    for rank in ranks.values():
        for edge in (F.floor(rank), F.ceil(rank)):
            wanted = wanted | holds(edge, F.col("before"), F.col("bin_n"))
    bins = bins.where(wanted).select(
        *keys, "bin", "n", "total", "lowest", "highest", "before", "bin_min", "bin_max"
    )
    width = F.col("bin_max") - F.col("bin_min")
    place = F.floor((F.col("value") - F.col("bin_min")) / width * CELLS_PER_BIN)
    celled = counted.join(bins, [*keys, "bin"]).withColumn(
        "cell", F.when(F.col("bin_max") > F.col("bin_min"), place).otherwise(F.lit(0)).cast("bigint")
    )
    cells = celled.groupBy(*keys, "bin", "cell").agg(
        F.sum("cnt").alias("cell_n"), F.max("before").alias("before"), F.max("n").alias("n")
    )
    step = (
        Window.partitionBy(*keys, "bin").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    )
    cells = cells.withColumn("cell_before", F.col("before") + F.sum("cell_n").over(step) - F.col("cell_n"))
    wanted = F.lit(False)
    for rank in ranks.values():
        for edge in (F.floor(rank), F.ceil(rank)):
            wanted = wanted | holds(edge, F.col("cell_before"), F.col("cell_n"))
    cells = cells.where(wanted).select(*keys, "bin", "cell", "cell_before")
    inside = (
        Window.partitionBy(*keys, "bin", "cell")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    located = celled.join(cells, [*keys, "bin", "cell"]).withColumn(
        "start", F.col("cell_before") + F.sum("cnt").over(inside) - F.col("cnt")
    )
    picks = []
    for name, rank in ranks.items():
        for label, edge in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            hit = holds(edge, F.col("start"), F.col("cnt"))
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"{name}_{label}"))
    summary = located.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("total").alias("total"),
        F.max("lowest").alias("min"),
        F.max("highest").alias("max"),
        *picks,
    )
    quantiles = []
    for name, rank in ranks.items():
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        quantiles.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return summary.select(
        *keys, "n", (F.col("total") / F.col("n")).alias("mean"), "min", "max", *quantiles
    )


def widen(long: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Turn `distribution` rows into columns: output name -> (metric, statistic); gaps become 0."""
    columns = []
    for output, (metric, statistic) in wanted.items():
        kind = "bigint" if statistic == "n" else "double"
        picked = F.max(F.when(F.col("metric") == metric, F.col(statistic)))
        filled = F.coalesce(picked, F.lit(0)).cast(kind)
        columns.append((filled if kind == "bigint" else rounded(filled)).alias(output))
    return long.groupBy(*by).agg(*columns)
