"""Banks from tables: rows are collected under the bank limits only."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark import model
from bankspark.model import BankError
from bankspark.operators import bank as banks
from bankspark.operators import scan as scans
from bankspark.runtime import table


def bank_from_table(patterns: DataFrame, statuses: tuple[str, ...] = ("active",)) -> dict[str, Any]:
    """The bank of a (dirty) pattern table's rows whose own chain has one of the statuses.

    Each row states its chain itself; an entity's flags are those of all its rows. BankError if the rows are more
    than a bank may have.
    """
    rows = banks.clean_patterns(patterns)
    flags = rows.select("bank_id", "entity_id", F.explode("entity_flags").alias("f")).groupBy("bank_id", "entity_id").agg(F.collect_set("f").alias("entity_flags"))
    kept = rows.where(banks.chain_active(statuses)).drop("entity_flags").join(flags, ["bank_id", "entity_id"], "left")
    found = [r.asDict() for r in kept.limit(model.LIMITS["bank_patterns"] + 1).collect()]
    if len(found) > model.LIMITS["bank_patterns"]:
        raise BankError("the table has more patterns than a bank may have")
    return banks.bank_of(found)


def load_detectors(spark: SparkSession, sf_dir: str, entity: str | None = None) -> list[dict[str, Any]]:
    """The detectors of the active patterns of `bank_patterns`."""
    return scans.detectors(bank_from_table(table(spark, sf_dir, "bank_patterns")), entity=entity)
