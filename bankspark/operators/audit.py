"""Digests, coverage, floors, budgets and samples that stand between a corpus and a release: all aggregates over whole tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bankspark.model import BankError
from bankspark.operators.corpus import quotas


def suite_hash(records: DataFrame, suite: str, key: str, content: list[str]) -> DataFrame:
    """suite, entries, suite_hash: SHA-256 over the digests of a suite's entries in order of their keys.

    A suite is bounded by the limits of evaluation sources; entries travel as digests of 64 characters."""
    row = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *content)])), 256)
    per = records.select(F.coalesce(F.col(suite), F.lit("none")).alias("suite"), F.struct(F.col(key), row.alias("h")).alias("e")).groupBy("suite").agg(F.count(F.lit(1)).alias("entries"), F.array_sort(F.collect_list("e")).alias("es"))
    return per.select("suite", "entries", F.sha2(F.array_join(F.transform("es", lambda e: e["h"]), ""), 256).alias("suite_hash"))


def ordered_digest(records: DataFrame, document: str, order: list[str], per_slice: int = 1000) -> DataFrame:
    """One row (documents, records, digest) that changes with any record or the order of two.

    Three levels keep every group small: the records of a document, the documents of a slice of ids, the slices."""
    line = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]), 256)
    rows = records.select(F.col(document).alias("d"), F.struct(*order, line.alias("h")).alias("r"))
    fold = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"]), ""), 256)
    documents = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), fold("r").alias("h"))
    slices = documents.select(F.floor(F.col("d") / per_slice).alias("slice"), "n", F.struct("d", "h").alias("r")).groupBy("slice").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"), fold("r").alias("h"))
    return slices.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), fold(F.struct("slice", "h")).alias("digest"))


def tag_coverage(records: DataFrame, by: Column, tag: Column, required: list[str]) -> DataFrame:
    """by, missing, unexpected, covered: whether a group's tags are exactly the required ones."""
    per = records.groupBy(by.alias("by")).agg(F.collect_set(tag).alias("tags"))
    need = F.array(*map(F.lit, required))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    rows = per.select("by", text(F.array_except(need, "tags")).alias("missing"), text(F.array_except("tags", need)).alias("unexpected"))
    return rows.withColumn("covered", (F.col("missing") == "") & (F.col("unexpected") == ""))


def support(counts: DataFrame, floors: Mapping[str, int]) -> DataFrame:
    """The counts (part, groups, records) with the floor of their part (default under "") and whether they reach it."""
    floor = F.coalesce(*[F.when(F.col("part") == k, F.lit(v)) for k, v in floors.items() if k], F.lit(floors.get("", 0)))
    return counts.withColumn("floor", floor.cast("long")).withColumn("supported", F.col("records") >= F.col("floor"))


def with_support(counts: DataFrame, floors: Mapping[str, int]) -> DataFrame:
    """The supported counts; BankError if a part is below its floor or is missing."""
    checked = support(counts, floors)
    short = [r["part"] for r in checked.where(~F.col("supported")).select("part").limit(20).collect()]
    known = {r["part"] for r in checked.select("part").where(F.col("part").isin(*[k for k in floors if k])).collect()}
    if short or known != {k for k in floors if k}:
        raise BankError(f"too little support: {sorted(short)}, without any: {sorted({k for k in floors if k} - known)}")
    return checked


def emissions(keyed: DataFrame, by: list[str]) -> DataFrame:
    """One row: the pairs that an equi join of a table with itself on the keys would emit."""
    n = F.col("count")
    return keyed.groupBy(*by).count().agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0)).alias("emissions"))


def within_budget(keyed: DataFrame, by: list[str], most: int) -> DataFrame:
    """The table, if its self join keeps to the budget; else BankError, before anything is joined."""
    found = emissions(keyed, by).first()["emissions"]
    if found > most:
        raise BankError(f"{found} pairs are more than the budget of {most}")
    return keyed


def first_rows(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows of a source in a stated order: a feature for trials, not a cap."""
    return df.orderBy(*order).limit(most)


def examples(df: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each group in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def margin_sample(df: DataFrame, key: str, stratum: Column, margins: list[Column], size: int, seed: str = "margin") -> DataFrame:
    """key, stratum, reserved: the record of lowest hash of each stratum and of each value of each margin, and the rest of
    `size` by largest remainders over what the strata have left.

    Minima combine before the shuffle; of the rest each task keeps at most `size` rows of a stratum."""
    rank = F.sha2(F.concat_ws("\u0001", F.lit(seed), F.col(key).cast("string")), 256)
    rows = df.select(F.col(key), stratum.alias("stratum"), rank.alias("rank"), *[F.coalesce(m.cast("string"), F.lit("")).alias(f"m{i}") for i, m in enumerate(margins)])
    sides = F.array(F.struct(F.lit(-1).alias("i"), F.col("stratum").alias("v")), *[F.struct(F.lit(i).alias("i"), F.col(f"m{i}").alias("v")) for i in range(len(margins))])
    lowest = rows.select(key, "rank", F.explode(sides).alias("s")).groupBy("s").agg(F.min(F.struct("rank", key)).alias("low"))
    reserved = lowest.select(F.col(f"low.{key}").alias(key)).distinct().withColumn("reserved", F.lit(True))
    rows = rows.join(reserved, key, "left").withColumn("reserved", F.coalesce("reserved", F.lit(False)))
    taken = rows.where("reserved").select(key, "stratum", "reserved")
    left = rows.where("not reserved")
    wanted = quotas(left.groupBy("stratum").agg(F.count(F.lit(1)).alias("population")), max(0, size - taken.count()))
    ranked = left.join(F.broadcast(wanted), "stratum").withColumn("n", F.row_number().over(W.partitionBy("stratum").orderBy("rank", key)))
    return taken.union(ranked.where((F.col("n") <= size) & (F.col("n") <= F.col("quota"))).select(key, "stratum", "reserved"))


def sealed_sample(df: DataFrame, key: str, group: Column, stratum: Column, size: int, seed: str = "sealed") -> DataFrame:
    """key, stratum: one representative of lowest hash of each group, then quotas over the strata of representatives.

    Groups keep copies out of the sample; the strata's populations are those of groups."""
    rank = F.sha2(F.concat_ws("\u0001", F.lit(seed), F.col(key).cast("string")), 256)
    rows = df.select(group.alias("g"), F.struct(rank.alias("rank"), F.col(key).alias("key"), stratum.alias("stratum")).alias("r"))
    chosen = rows.groupBy("g").agg(F.min("r").alias("r")).select("r.*")
    wanted = quotas(chosen.groupBy("stratum").agg(F.count(F.lit(1)).alias("population")), size)
    ranked = chosen.join(F.broadcast(wanted), "stratum").withColumn("n", F.row_number().over(W.partitionBy("stratum").orderBy("rank", "key")))
    return ranked.where((F.col("n") <= size) & (F.col("n") <= F.col("quota"))).select(F.col("key").alias(key), "stratum")


def cover(labels: DataFrame, bindings: DataFrame, on: list[str]) -> DataFrame:
    """on, labels, bindings, status: exact where each key has one of both, else missing, extra or duplicate."""
    count = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    both = count(labels, "labels").join(count(bindings, "bindings"), on, "full_outer").na.fill(0, ["labels", "bindings"])
    status = F.when(F.col("bindings") == 0, "missing").when(F.col("labels") == 0, "extra").when((F.col("labels") > 1) | (F.col("bindings") > 1), "duplicate").otherwise("exact")
    return both.select(*on, "labels", "bindings", status.alias("status"))


def exactly_covered(labels: DataFrame, bindings: DataFrame, on: list[str]) -> DataFrame:
    """The labels with their bindings; BankError unless they cover one another exactly."""
    wrong = {r["status"]: r["n"] for r in cover(labels, bindings, on).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect() if r["status"] != "exact"}
    if wrong:
        raise BankError(f"labels and bindings do not cover one another: {wrong}")
    return labels.join(bindings, on)


def inventory(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by, n, total, least, median, p95, most of a size or density; nulls count in none."""
    rows = df.select(*by, value.alias("value")).where("value is not null")
    kind = rows.schema["value"].dataType.simpleString()
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").cast(kind)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("value").alias("most"))


def gates(measured: DataFrame, rules: Mapping[str, tuple[str, float]]) -> DataFrame:
    """gate, value, bound, passed: each measured name (name, value) against its rule ("least" or "most", bound); a rule without a value fails."""
    spark = measured.sparkSession
    wanted = spark.createDataFrame([(k, side, float(bound)) for k, (side, bound) in rules.items()], "name string, side string, bound double")
    rows = F.broadcast(wanted).join(measured.select("name", F.col("value").cast("double").alias("value")), "name", "left")
    holds = F.when(F.col("side") == "least", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return rows.select(F.col("name").alias("gate"), "value", "bound", F.coalesce(holds, F.lit(False)).alias("passed"))


def decide_iterations(metrics: list[Mapping[str, Any]], least_support: int = 1) -> list[dict[str, Any]]:
    """Of frozen iterations in order (name, support, precision, recall on validation) which one stands, and why not the others.

    Fail closed: one without support or a value is refused; the first sound one stands until a later one has more recall at
    no less precision. None stands if none is sound."""
    out, best = [], None
    for m in metrics:
        sound = m.get("support", 0) >= least_support and m.get("precision") is not None and m.get("recall") is not None
        better = sound and (best is None or (m["precision"] >= best["precision"] and m["recall"] > best["recall"]))
        best = m if better else best
        out.append({"name": m["name"], "reason": "unsupported" if not sound else "stands" if better else "no gain"})
    for row in out:
        row["selected"] = best is not None and row["name"] == best["name"]
        if row["reason"] == "stands" and not row["selected"]:
            row["reason"] = "superseded"
    return out
