"""Statistics of samples: nearest-rank percentiles, median and MAD, permutation test, break-even."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, median, mad, p95 (with 20 values or more), p99 (with 100 or more)."""
    rows = df.where(F.col(value).isNotNull()).withColumnRenamed(value, "value")
    medians = rows.groupBy(*by).agg(F.median("value").alias("median"), F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY value)").alias("p99"))
    spread = rows.join(medians.select(*by, "median"), by).groupBy(*by).agg(F.median(F.abs(F.col("value") - F.col("median"))).alias("mad"))
    return medians.join(spread, by).select(*by, "n", "median", "mad", F.when(F.col("n") >= 20, F.col("p95")).alias("p95"), F.when(F.col("n") >= 100, F.col("p99")).alias("p99"))


def permutation_p(blocks: DataFrame) -> DataFrame:
    """One row: observed mean difference and the share of all sign swaps of the blocks that reach it.

    `blocks` has block (0..n-1, n at most 16) and diff; 2^n swaps are enumerated.
    """
    diffs = [float(r["diff"]) for r in blocks.orderBy("block").limit(17).collect()]
    n = len(diffs)
    if not 1 <= n <= 16:
        raise ValueError("a permutation test needs 1 to 16 blocks")
    signed = [F.expr(f"CASE WHEN (shiftright(id, {i}) & 1) = 1 THEN {-d!r}D ELSE {d!r}D END") for i, d in enumerate(diffs)]
    sums = blocks.sparkSession.range(1 << n).select(sum(signed[1:], signed[0]).alias("s"))
    observed = sum(diffs)
    return sums.agg(F.round(F.lit(observed / n), 9).alias("mean_difference"), F.round(F.avg(F.when(F.abs("s") >= abs(observed) - 1e-9, 1.0).otherwise(0.0)), 9).alias("p_value"))


def break_even(fixed: float, variable: float, other_fixed: float, other_variable: float) -> float | None:
    """Units from which the first way costs no more than the other; 0 if it never costs more, None if it always does."""
    if fixed <= other_fixed and variable <= other_variable:
        return 0.0
    if variable >= other_variable:
        return None
    return (fixed - other_fixed) / (other_variable - variable)
