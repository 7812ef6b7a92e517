"""File sources: banks and detector rows in several forms, texts, mail, evaluations, annotations; and sinks.

Banks are read on the driver under their limits; whatever grows with a corpus is read by Spark with a closed
schema, and rows that do not fit it come out as error rows, never silently dropped.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark import model
from bankspark.model import BankError
from bankspark.operators.bank import canonical, canonical_json, strict_json

# --- banks and detector rows -----------------------------------------------------------------------------------


def detector_rows_from_map(config: dict[str, Any]) -> list[dict[str, Any]]:
    """Rows of the compact form {entity: {name: regex, "_flags": ...}}: entities sorted, patterns in their own order."""
    out = []
    for entity in sorted(config):
        names = config[entity]
        if not isinstance(names, dict):
            raise BankError(f"{entity}: a map of names to patterns is expected")
        flags = names.get("_flags") or []
        flags = [flags] if isinstance(flags, str) else flags
        if not isinstance(flags, list) or not all(isinstance(f, str) for f in flags):
            raise BankError(f"{entity}: _flags is a name or a list of names")
        for name, regex in names.items():
            if name == "_flags":
                continue
            if not isinstance(regex, str) or not regex:
                raise BankError(f"{entity}/{name}: a pattern is a non-empty text")
            out.append({"entity": entity, "name": name, "regex": regex, "flags": flags})
    if not out:
        raise BankError("there are no detectors")
    return out


def detector_rows_from_jsonl(text: str) -> list[dict[str, Any]]:
    """One JSON object a line; blank lines are skipped; the default priority is the place within the entity."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        if len(line.encode()) > model.LIMITS["jsonl_line_bytes"] or len(out) >= model.LIMITS["jsonl_rows"]:
            raise BankError(f"line {n}: too long or too many rows")
        row = strict_json(line)
        unknown = set(row) - {"entity", "name", "canonical_name", "regex", "flags", "priority"}
        if unknown or not {"entity", "name", "regex"} <= set(row):
            raise BankError(f"line {n}: unknown or missing fields {sorted(unknown)}")
        out.append(row)
    return out


def parse_config(text: str) -> dict[str, Any]:
    """YAML or JSON of the compact form."""
    try:
        return strict_json(text)
    except BankError:
        try:
            import yaml
        except ImportError as error:
            raise BankError("a YAML parser is not installed; write the detectors as JSON") from error
        value = yaml.safe_load(text)
        if not isinstance(value, dict):
            raise BankError("a map of entities is expected") from None
        return value


def sniff(text: str) -> str:
    """Which form a source has: bank, canonical, map, jsonl or yaml."""
    try:
        value = strict_json(text)
    except BankError:
        lines = [x for x in text.split("\n") if x.strip()]
        try:
            if lines and all(isinstance(strict_json(x), dict) for x in lines):
                return "jsonl"
        except BankError:
            pass
        return "yaml"
    if isinstance(value, dict) and "schema_version" in value:
        return "canonical" if text.strip() == canonical_json(canonical(value)) else "bank"
    return "jsonl" if isinstance(value, dict) and "regex" in value else "map"


def config_path(explicit: str | None = None, variable: str = "BANKSPARK_CONFIG") -> Path:
    """The path given, else that of the environment, else the user's configuration folder."""
    if explicit:
        return Path(explicit)
    if os.environ.get(variable):
        return Path(os.environ[variable])
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "bankspark" / "detectors.yaml"


def save_config(config: dict[str, Any], path: str) -> None:
    """Written beside and put in place at once."""
    detector_rows_from_map(config)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    part.write_text(json.dumps(config, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    part.replace(target)


def read_bank_text(spark: SparkSession, path: str, check: bool = True) -> dict[str, Any]:
    """A bank from a file of any file system that Spark reads, under the limits of a bank."""
    from bankspark.operators.bank import parse_bank

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("length", "content")
    found = files.where(F.col("length") <= model.LIMITS["bank_bytes"]).limit(2).collect()
    if len(found) != 1:
        raise BankError(f"{path} is not one file of a bank's size")
    return parse_bank(bytes(found[0]["content"]), path, check)


# --- corpus sources ----------------------------------------------------------------------------------------------


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """document_id, text, error: whole files as strict UTF-8; `error` names files that are too large or not UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    valid = F.is_valid_utf8("content")
    error = F.when(F.col("length") > model.LIMITS["text_bytes"], "too_large").when(~valid, "not_utf8")
    text = F.when(error.isNull(), F.decode("content", "UTF-8"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("document_id"), text.alias("text"), error.alias("error"))


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """Mail rows of JSON lines; blank and malformed lines are rows with `error`."""
    lines = spark.read.text(path)
    row = F.from_json("value", model.MAIL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.select("value", row.alias("r"))
    error = F.when(F.col("value").rlike(r"^\s*$"), "blank_line").when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "malformed_json")
    fields = [f for f in model.MAIL.fieldNames() if f != "_corrupt_record"]
    return parsed.select(*[F.when(error.isNull(), F.col(f"r.`{f}`")).alias(f) for f in fields], error.alias("error"))


def read_evals(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records of JSON lines with `error` for what breaks their form."""
    lines = spark.read.text(path).where("value <> ''")
    parsed = lines.select(F.from_json("value", model.EVALS, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    error = (
        F.when(F.col("_corrupt_record").isNotNull(), "malformed_json")
        .when(~F.coalesce(F.col("type"), F.lit("")).isin("positive", "negative", "provenance"), "unknown_type")
        .when((F.col("type") == "positive") & (F.col("text").isNull() | F.col("matches").isNull()), "positive_without_matches")
        .when((F.col("type") == "negative") & (F.col("text").isNull() | F.col("matches").isNotNull()), "negative_with_matches")
        .when((F.col("type") == "provenance") & F.col("source_type").isNull(), "provenance_without_source")
    )
    return parsed.withColumn("error", error).drop("_corrupt_record")


TAG = re.compile(r"</?([A-Za-z_]+)>")


def parse_annotated(text: str, names: tuple[str, ...] = ("true_name",)) -> tuple[str, list[tuple[str, int, int]]]:
    """Text without its inline tags, and (tag, start, end) spans in characters; BankError for tags that do not pair."""
    out, spans, open_tag, at = [], [], None, 0
    length = 0
    for m in TAG.finditer(text):
        if m.group(1) not in names:
            continue
        piece = text[at : m.start()]
        out.append(piece)
        length += len(piece)
        at = m.end()
        if m.group().startswith("</"):
            if open_tag is None or open_tag[0] != m.group(1) or open_tag[1] == length:
                raise BankError("an annotation closes that is not open, or is empty")
            spans.append((open_tag[0], open_tag[1], length))
            open_tag = None
        elif open_tag is not None:
            raise BankError("annotations do not nest")
        else:
            open_tag = (m.group(1), length)
    if open_tag is not None:
        raise BankError("an annotation is not closed")
    return "".join(out) + text[at:], spans


def read_annotated_archive(spark: SparkSession, path: str) -> DataFrame:
    """document_id, text, spans, error of the members of ZIP archives; nothing is unpacked to disk."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("tag", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in it:
            rows = []
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        if info.file_size > model.LIMITS["text_bytes"] or ".." in info.filename or info.filename.startswith("/"):
                            rows.append((info.filename, None, None, "not_accepted"))
                            continue
                        try:
                            text, spans = parse_annotated(z.read(info).decode("utf-8"))
                            rows.append((info.filename, text, [{"tag": t, "start": s, "end": e} for t, s, e in spans], None))
                        except (UnicodeDecodeError, BankError) as error:
                            rows.append((info.filename, None, None, str(error)))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], kind), pa.array(columns[3], pa.string())], ["document_id", "text", "spans", "error"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(batches, "document_id string, text string, spans array<struct<tag:string,start:long,end:long>>, error string")


# --- sinks ---------------------------------------------------------------------------------------------------------


def write_roles(df: DataFrame, path: str, role: str = "role") -> None:
    """Records by role; Spark's committer makes the folder whole or absent."""
    df.write.mode("errorifexists").partitionBy(role).parquet(path)


def write_records(df: DataFrame, path: str, form: str = "json") -> None:
    """Records as JSON lines or CSV in record order."""
    keys = [c for c in ("document_id", "doc_id", "start", "end", "entity_id", "name_id", "pattern_id") if c in df.columns]
    ordered = df.orderBy(*(keys or df.columns))
    (ordered.write.mode("errorifexists").json if form == "json" else ordered.write.mode("errorifexists").option("header", True).csv)(path)


def write_version(df: DataFrame, folder: str, expected: int) -> int:
    """The next version of a table in a folder of versions, if the last is the expected one; else BankError."""
    spark = df.sparkSession
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    last = current_version(spark, folder)
    if last != expected:
        raise BankError(f"the table has version {last}, not {expected}")
    part = f"{folder}/.v-{uuid.uuid4().hex}"
    df.write.parquet(part)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(f"{folder}/v{last + 1}")):
        raise BankError("another writer was first")
    return last + 1


def current_version(spark: SparkSession, folder: str) -> int:
    """The last whole version; 0 if there is none."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return max((int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)), default=0)
