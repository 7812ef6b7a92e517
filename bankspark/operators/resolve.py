"""Reports over records: overlap groups, priority winners, context, counts, missing expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

ORDER = ("start", "end", "entity_id", "name_id", "pattern_id", "string")


def overlap_groups(records: DataFrame, document: str = "document_id") -> DataFrame:
    """Records with `group_no` (from 0 within the document, in record order) and `group_size`.

    Gaps and islands: a record opens a group where it starts at or after the largest end before it.
    """
    own = W.partitionBy(document).orderBy(*ORDER)
    reach = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    numbered = records.withColumn("_opens", opens).withColumn("group_no", F.sum("_opens").over(own.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return numbered.withColumn("group_size", F.count(F.lit(1)).over(W.partitionBy(document, "group_no"))).drop("_opens")


def resolve(records: DataFrame, patterns: DataFrame, document: str = "document_id") -> DataFrame:
    """Grouped records with `overlap_id` (null for groups of one) and `winner`: lowest priority value, then longest, then first.

    `patterns` has entity_id, name_id, pattern_id, priority; a record without one has priority 0.
    """
    ids = ["entity_id", "name_id", "pattern_id"]
    ranked = overlap_groups(records, document).join(patterns.select(*ids, "priority"), ids, "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    order = W.partitionBy(document, "group_no").orderBy("priority", F.col("start") - F.col("end"), *[F.col(c) for c in ("start", "entity_id", "name_id", "pattern_id", "string")])
    ranked = ranked.withColumn("winner", F.row_number().over(order) == 1)
    several = F.sum(F.when((F.col("group_size") > 1) & (F.col("_first") == 1), 1).otherwise(0)).over(W.partitionBy(document).orderBy("group_no", "_first").rowsBetween(W.unboundedPreceding, 0))
    ranked = ranked.withColumn("_first", F.row_number().over(W.partitionBy(document, "group_no").orderBy(*ORDER)))
    named = ranked.withColumn("_nth", several)
    nth = F.max("_nth").over(W.partitionBy(document, "group_no"))
    return named.withColumn("overlap_id", F.when(F.col("group_size") > 1, F.concat(F.lit("overlap_"), (nth - 1).cast("string")))).drop("_first", "_nth")


def grouped_counts(records: DataFrame) -> DataFrame:
    """entity_id, name_id, records: by entity and name, by entity, and in all."""
    out = records.rollup("entity_id", "name_id").agg(F.count(F.lit(1)).alias("records"), F.grouping_id().alias("level"))
    return out.select(F.when(F.col("level") <= 1, F.col("entity_id")).alias("entity_id"), F.when(F.col("level") == 0, F.col("name_id")).alias("name_id"), "level", "records")


def context(records: DataFrame, documents: DataFrame, document: str, text: str, chars: int = 80) -> DataFrame:
    """Records with `before`, `match`, `after`: up to `chars` characters around the match; byte offsets are turned into character ones."""
    rows = records.join(documents.select(document, F.col(text).alias("_text")), document)
    at = lambda c: F.when(F.col("offset_unit") == "byte", F.length(F.decode(F.substring(F.encode("_text", "UTF-8"), F.lit(1), F.col(c).cast("int")), "UTF-8"))).otherwise(F.col(c)).cast("int")
    rows = rows.withColumn("_s", at("start")).withColumn("_e", at("end"))
    low = F.greatest(F.col("_s") - chars, F.lit(0))
    rows = rows.withColumn("before", F.substring("_text", low + 1, F.col("_s") - low)).withColumn("match", F.substring("_text", F.col("_s") + 1, F.col("_e") - F.col("_s"))).withColumn("after", F.substring("_text", F.col("_e") + 1, F.lit(chars)))
    return rows.drop("_text", "_s", "_e")


def batch_summary(documents: DataFrame, records: DataFrame, document: str) -> DataFrame:
    """One row: documents, records, documents with records."""
    per = records.groupBy(document).agg(F.count(F.lit(1)).alias("n"))
    return documents.select(document).join(per, document, "left").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("n").alias("documents_with_records"))


def expected_missing(expected: DataFrame, records: DataFrame, on: list[str]) -> DataFrame:
    """Expected identities that no record has."""
    return expected.join(records.select(*on).distinct(), on, "left_anti")
