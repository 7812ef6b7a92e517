"""Evaluation: gold spans against predictions, conformance, span coverage, slices, annotation passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SPAN = ["document", "entity_id", "start", "end"]
IDENTITY = ["entity_id", "name_id", "pattern_id"]


def exact_matches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold spans with the prediction of the same span, one to one, an equal identity first: `found`, `same_identity`."""
    g = gold.withColumn("_g", F.row_number().over(W.partitionBy(*SPAN).orderBy("name_id", "pattern_id")))
    p = predicted.select(*SPAN, F.col("name_id").alias("p_name"), F.col("pattern_id").alias("p_pattern")).distinct()
    both = g.join(p, SPAN, "left").withColumn("same_identity", F.coalesce((F.col("name_id") == F.col("p_name")) & (F.col("pattern_id") == F.col("p_pattern")), F.lit(False)))
    best = F.row_number().over(W.partitionBy(*SPAN, "_g").orderBy(F.desc("same_identity"), "p_name", "p_pattern"))
    return both.withColumn("_n", best).where("_n = 1").select(*SPAN, "name_id", "pattern_id", F.col("p_pattern").isNotNull().alias("found"), "same_identity")


def overlap_pairs(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairs of gold and predicted spans of a document that share a character, with the shared length."""
    p = predicted.select("document", F.col("entity_id").alias("p_entity"), F.col("start").alias("p_start"), F.col("end").alias("p_end")).distinct()
    both = gold.join(p, "document").where((F.col("start") < F.col("p_end")) & (F.col("p_start") < F.col("end")))
    return both.select("document", "entity_id", "start", "end", "p_entity", "p_start", "p_end", (F.least("end", "p_end") - F.greatest("start", "p_start")).alias("shared"))


def union_length(spans: DataFrame, by: list[str]) -> DataFrame:
    """by, islands, covered: merged length of half-open spans; spans that touch are one island."""
    own = W.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(reach, F.col("start"))), F.lit(0))
    return spans.select(*by, "start", "end", opens.alias("o"), fresh.alias("f")).groupBy(*by).agg(F.sum("o").alias("islands"), F.sum("f").alias("covered"))


def conformance(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected matches with `status` correct, wrong_canonical or missed.

    First all exact ones are reserved, by rank within equal spans and identities; of those left an actual match
    of the same span with another identity makes wrong_canonical, again by rank.
    """
    key = ["document", "start", "end"]
    full = [*key, *IDENTITY]
    rank = lambda df, cols, name: df.withColumn(name, F.row_number().over(W.partitionBy(*cols).orderBy(*[c for c in full if c not in cols] or [F.lit(0)])))
    e, a = rank(expected.select(*full), full, "_r"), rank(actual.select(*full), full, "_r")
    correct = e.join(a, [*full, "_r"], "left_semi")
    e_rest = rank(e.join(a, [*full, "_r"], "left_anti").drop("_r"), key, "_r")
    a_rest = rank(a.join(e, [*full, "_r"], "left_anti").drop("_r"), key, "_r").select(*key, "_r", F.lit(True).alias("_hit"))
    rest = e_rest.join(a_rest, [*key, "_r"], "left").withColumn("status", F.when(F.col("_hit"), "wrong_canonical").otherwise("missed"))
    return correct.select(*full, F.lit("correct").alias("status")).union(rest.select(*full, "status"))


def metrics(df: DataFrame, by: list[str], tp: Column, fp: Column, fn: Column) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1; null, never zero, without support."""
    rows = df.groupBy(*by).agg(F.sum(tp.cast("long")).alias("tp"), F.sum(fp.cast("long")).alias("fp"), F.sum(fn.cast("long")).alias("fn"))
    return rows.withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6)).withColumn("f1", F.round(F.try_divide(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")), 6))


def symmetric_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Spans that only one of two passes has, with the pass."""
    left, right = a.select(*on).distinct().withColumn("_a", F.lit(True)), b.select(*on).distinct().withColumn("_b", F.lit(True))
    return left.join(right, on, "full_outer").where("_a is null or _b is null").select(*on, F.when(F.col("_a").isNull(), "second").otherwise("first").alias("pass"))


def best_pattern(gold: DataFrame, patterns: DataFrame, fits: Column) -> DataFrame:
    """Gold spans with the active pattern of their entity that fits and has the lowest (priority, name, pattern)."""
    both = gold.join(patterns, "entity_id").where(fits)
    order = F.struct("priority", patterns["name_id"], patterns["pattern_id"])
    low = both.groupBy("document", "entity_id", "start", "end").agg(F.min(order).alias("m"))
    return low.select("document", "entity_id", "start", "end", F.col("m.name_id").alias("name_id"), F.col("m.pattern_id").alias("pattern_id"))


def lowest_hashes(df: DataFrame, by: list[str], key: Column, n: int) -> DataFrame:
    """The n rows of lowest hash in each group: a sample that is the same on every run."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.sha2(key, 256), key))
    return df.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


#: Rows that a last bucket may have and be ordered in one task.
LAST_BUCKET = 1000


def share_of_hashes(df: DataFrame, key: Column, share: float) -> DataFrame:
    """ceil(share * n) rows of lowest hash of all.

    The hash that ends the share is found by counts of hash prefixes (at most 4,096 rows a round), each round inside the
    bucket that the share ends in; all below are in, and only of that last, small bucket rows are ordered."""
    hashed = df.withColumn("_h", F.sha2(key, 256)).withColumn("_k", key)
    prefix, left, counts = "", None, {}
    while left is None or (counts[prefix] > LAST_BUCKET and len(prefix) < 60):
        rows = hashed.where(F.startswith("_h", F.lit(prefix))).groupBy(F.substring("_h", 1, len(prefix) + 3).alias("p")).count().collect()
        counts = {r["p"]: r["count"] for r in rows}
        if left is None:
            left = -(-int(sum(counts.values()) * share * 10**9) // 10**9)
        for p in sorted(counts):
            prefix = p
            if counts[p] >= left:
                break
            left -= counts[p]
        if not counts:
            return hashed.drop("_h", "_k")
    below = hashed.where(F.substring("_h", 1, len(prefix)) < prefix)
    return below.union(hashed.where(F.startswith("_h", F.lit(prefix))).orderBy("_h", "_k").limit(left)).drop("_h", "_k")
