"""Schemas, limits and fixed vocabularies of banks, records and documents."""

from __future__ import annotations

from pyspark.sql import types as T

ID = r"^[a-z][a-z0-9_]{0,79}$"
STATUSES = ("draft", "active", "inactive", "deprecated")
FLAGS = ("ASCII", "IGNORECASE", "MULTILINE", "DOTALL", "VERBOSE")
BOUNDARIES = ("none", "word")
NORMALISATIONS = ("none", "NFC", "NFKC")

#: Limits that decide what is accepted.
LIMITS = {
    "text_bytes": 10 * 1024 * 1024,
    "batch_documents": 100,
    "batch_bytes": 25 * 1024 * 1024,
    "matches": 1_000_000,
    "pattern_chars": 10_000,
    "entity_patterns": 50_000,
    "bank_patterns": 100_000,
    "bank_pattern_bytes": 10_000_000,
    "entities": 100_000,
    "description_chars": 2_000,
    "eval_refs": 1_000,
    "metadata_warning": 16 * 1024,
    "metadata_error": 1024 * 1024,
    "bank_bytes": 64 * 1024 * 1024,
    "jsonl_rows": 100_000,
    "jsonl_line_bytes": 256 * 1024,
    "json_depth": 128,
    "replacement_db_bytes": 10 * 1024 * 1024,
    "reverse_entities": 1_000,
    "eval_bytes": 100 * 1024 * 1024,
}

_text = lambda name: T.StructField(name, T.StringType())
_long = lambda name: T.StructField(name, T.LongType())
_texts = lambda name: T.StructField(name, T.ArrayType(T.StringType()))
_flag = lambda name: T.StructField(name, T.BooleanType())

PATTERNS = T.StructType(
    [
        *map(_text, ("bank_id", "entity_id", "entity_status")), _texts("entity_flags"), *map(_text, ("name_id", "canonical", "name_status", "pattern_id", "kind", "value", "status")), _long("priority"), _texts("regex_flags"),
        *map(_flag, ("case_sensitive", "normalize_whitespace")), *map(_text, ("left_boundary", "right_boundary", "metadata")),
    ]
)
DETECTORS = T.StructType([_text("entity"), _long("detector_index"), _long("pattern_order"), *map(_text, ("canonical_name", "surface_name", "regex")), _texts("flags"), _long("priority"), *map(_text, ("stable_id", "entity_id", "name_id", "pattern_id", "pattern_kind"))])
RECORDS = T.StructType(
    [*map(_text, ("document_id", "entity", "canonical_name", "surface_name", "string")), _long("start"), _long("end"), *map(_text, ("offset_unit", "entity_id", "name_id", "pattern_id", "pattern_kind")), T.StructField("captures", T.MapType(T.StringType(), T.StringType()))]
)
MAIL = T.StructType([*map(_text, ("message_id", "subject", "from")), *map(_texts, ("to", "cc", "bcc")), *map(_text, ("date", "body", "file_name", "_corrupt_record"))])
EVALS = T.StructType(
    [
        *map(_text, ("type", "text")),
        T.StructField("matches", T.ArrayType(T.StructType([_text("string"), _long("start"), _long("end"), *map(_text, ("entity_id", "name_id", "pattern_id"))]))),
        *map(_text, ("reason", "metadata", "source_type", "observed_at", "evidence", "_corrupt_record")),
    ]
)


class BankError(ValueError):
    """A bank, pattern, patch or replacement set that is not accepted; `diagnostics` say why."""

    def __init__(self, message: str, diagnostics: list[dict] | None = None):
        super().__init__(message)
        self.diagnostics = diagnostics or []
