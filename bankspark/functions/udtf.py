"""SQL surface: a table function over one text, for lateral joins."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from bankspark.operators.scan import _scanner


def register_scan(spark: SparkSession, found: list[dict[str, Any]], name: str = "scan_entities") -> None:
    """Register `name`(text) -> entity, name_id, pattern_id, string, start, end in bytes."""
    payload = json.dumps(found)

    @udtf(returnType="entity string, name_id string, pattern_id string, string string, start long, end long")
    class ScanEntities:
        def eval(self, text: str | None) -> Iterator[tuple]:
            scanner = _scanner(payload)
            for s, e, i in scanner.matches(text or ""):
                d = scanner.found[i]
                yield d["entity"], d["name_id"], d["pattern_id"], text[s:e], len(text[:s].encode()), len(text[:e].encode())

    spark.udtf.register(name, ScanEntities)
