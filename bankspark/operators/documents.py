"""Document batches and envelopes of single requests, with the limits of one request."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark import model
from bankspark.model import BankError
from bankspark.operators import bank as banks
from bankspark.operators import scan as scans


def text_of(path: str) -> str:
    """A regular file's text, strictly UTF-8 and within the limit."""
    file = Path(path)
    if not file.is_file() or file.stat().st_size > model.LIMITS["text_bytes"]:
        raise BankError(f"{path} is no file of at most {model.LIMITS['text_bytes']} bytes")
    try:
        return file.read_bytes().decode("utf-8")
    except UnicodeDecodeError as error:
        raise BankError(f"{path} is not UTF-8") from error


def batch(items: list[Mapping[str, Any]]) -> list[tuple[str, str]]:
    """(document_id, text) of a bounded batch: ids given or `document_n`, exactly one of text and file_path each."""
    if len(items) > model.LIMITS["batch_documents"]:
        raise BankError("the batch has too many documents; scan a DataFrame instead")
    out, size = [], 0
    for n, item in enumerate(items):
        key = item.get("document_id", item.get("id", f"document_{n}"))
        if not isinstance(key, str) or not re.match(model.ID, key) or key in {k for k, _ in out}:
            raise BankError(f"document {n}: the id is not one or is used twice")
        if (item.get("text") is None) == (item.get("file_path") is None):
            raise BankError(f"{key}: exactly one of text and file_path is needed")
        text = item["text"] if item.get("text") is not None else text_of(item["file_path"])
        size += len(text.encode())
        if size > model.LIMITS["batch_bytes"]:
            raise BankError("the batch is too large")
        out.append((key, text))
    return out


def extract(bank: Mapping[str, Any], items: list[Mapping[str, Any]], statuses: tuple[str, ...] = ("active",)) -> dict[str, Any]:
    """Records of a batch in order, with a summary; refuses a bank whose own status is not among the statuses."""
    if bank.get("status") not in statuses:
        raise BankError(f"the bank's status is {bank.get('status')!r}")
    found = scans.detectors(bank, statuses)
    records, with_records = [], 0
    rows = batch(items)
    for key, text in rows:
        own = scans.scan_text(text, found)
        with_records += bool(own)
        records += [{"document_id": key, **r} for r in own]
    return {"bank": {"id": bank.get("id"), "hash": banks.bank_hash(bank)}, "records": records, "summary": {"documents": len(rows), "records": len(records), "documents_with_records": with_records}}


def documents(spark: SparkSession, items: list[Mapping[str, Any]]) -> DataFrame:
    return spark.createDataFrame(batch(items), "document_id string, text string")


def bad_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that are not accepted, or that more than one row has."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | F.col(key).isNull() | ~F.col(key).cast("string").rlike(model.ID))


#: Shapes that aggregates for publication must not hold: addresses, phone numbers, identity numbers, paths.
PRIVATE = r"[\w.+-]+@[\w-]+\.\w|\+?\d[\d ().-]{8,}\d|\b\d{3}-\d{2}-\d{4}\b|(?:^|\s)(?:/[\w.-]+){2,}|[A-Za-z]:\\"
FORBIDDEN = {"label", "labels", "prediction", "predictions", "score", "scores", "gold"}


def privacy_violations(df: DataFrame) -> DataFrame:
    """column, rows: text columns of an aggregate that hold private shapes."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, rows long")
    hits = F.filter(F.array(*[F.when(F.col(f"`{c}`").rlike(PRIVATE), F.lit(c)) for c in texts]), lambda x: x.isNotNull())
    return df.select(F.explode(hits).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("rows"))


def without_labels(df: DataFrame) -> DataFrame:
    """The table, if it has no column of labels or predictions; else BankError: samples are drawn before those are known."""
    known = sorted(c for c in df.columns if c.casefold() in FORBIDDEN)
    if known:
        raise BankError(f"labels or predictions before sampling: {known}")
    return df


def export_evidence(aggregates: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Aggregates as JSON lines, each checked for private shapes first; nothing is written if one has any."""
    for name, df in aggregates.items():
        if not privacy_violations(df).isEmpty():
            raise BankError(f"{name} holds private values")
    for name, df in aggregates.items():
        df.write.mode("errorifexists").json(f"{folder}/{name}")
    return sorted(aggregates)
