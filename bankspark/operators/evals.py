"""Regression gates, benchmarks and synthetic banks."""

from __future__ import annotations

import random
import time
from typing import Any

from pyspark.sql import SparkSession

from bankspark.operators import scan as scans
from bankspark.operators.bank import bank_hash

PROFILES = ("small", "literal_heavy", "regex_heavy", "mixed", "adversarial_smoke")
TIERS = {"baseline": 1, "target": 4, "stress": 16}


def synthetic_bank(entities: int, names: int, patterns: int, regex_share: float = 0.2, seed: int = 7) -> dict[str, Any]:
    """A bank of invented literals and regexes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(3)).capitalize()
    out: dict[str, Any] = {}
    for e in range(entities):
        kept = {}
        for n in range(names):
            canonical = f"{word()} {word()}"
            values = {}
            for p in range(patterns):
                common = {"description": "", "status": "active", "priority": 100, "metadata": {}}
                if rng.random() < regex_share:
                    values[f"p{p}"] = {"kind": "regex", "value": rf"\b{word().upper()}-\d{{{3 + p % 3}}}\b", "regex_flags": [], **common}
                else:
                    values[f"p{p}"] = {"kind": "literal", "value": f"{canonical} {word()}" if p else canonical, "case_sensitive": False, "normalize_whitespace": True, "left_boundary": "word", "right_boundary": "word", **common}
            kept[f"n{n}"] = {"canonical": canonical, "description": "", "status": "active", "patterns": values, "metadata": {}}
        out[f"e{e}"] = {"description": "", "status": "active", "regex_flags": [], "names": kept, "metadata": {}}
    return {"schema_version": "own.bank.v1", "id": "synthetic", "name": "synthetic", "description": "", "version": "1", "status": "active", "created_at": "", "updated_at": "", "unicode_normalization": "none", "default_regex_flags": [], "entities": out, "metadata": {}}


def profile(name: str) -> dict[str, Any]:
    shapes = {"small": (2, 3, 2, 0.2), "literal_heavy": (4, 50, 4, 0.0), "regex_heavy": (4, 20, 3, 1.0), "mixed": (4, 30, 3, 0.4), "adversarial_smoke": (2, 10, 6, 0.5)}
    return synthetic_bank(*shapes[name][:3], regex_share=shapes[name][3])


def benchmark(spark: SparkSession, bank: dict[str, Any], texts: list[str], tiers: tuple[str, ...] = tuple(TIERS)) -> dict[str, Any]:
    """Seconds to compile and to scan the texts at each tier, with documents, bytes and records a second."""
    begun = time.perf_counter()
    found = scans.detectors(bank)
    scans.Scanner(found)
    cold = time.perf_counter() - begun
    begun = time.perf_counter()
    scans.Scanner(found)
    out: dict[str, Any] = {"bank_hash": bank_hash(bank), "detectors": len(found), "cold_compile_s": cold, "warm_compile_s": time.perf_counter() - begun, "tiers": {}}
    for tier in tiers:
        rows = [(i, t) for i, t in enumerate(texts * TIERS[tier])]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        begun = time.perf_counter()
        records = scans.scan(df, "doc_id", "text", found).count()
        took = time.perf_counter() - begun
        out["tiers"][tier] = {"seconds": took, "documents_per_s": len(rows) / took, "bytes_per_s": sum(len(t.encode()) for _, t in rows) / took, "records_per_s": records / took}
    return out


def quality_delta(before: dict[str, int], after: dict[str, int]) -> dict[str, int]:
    return {k: after.get(k, 0) - before.get(k, 0) for k in sorted({*before, *after})}


def performance_delta(before: float, after: float) -> dict[str, float | None]:
    return {"difference": after - before, "ratio": after / before if before else None}


def regress(before: dict[str, Any], after: dict[str, Any], most_failures: int = 0, most_ratio: float | None = None) -> dict[str, Any]:
    """Whether a change may go in: evaluations ran, the suite is the same, no more failures than allowed, not too slow.

    Both sides have `suite_hash`, `passed`, `failed` and, for the last gate, `seconds`.
    """
    reasons = []
    if not after.get("passed") and not after.get("failed"):
        reasons.append("no evaluation ran")
    if before.get("suite_hash") != after.get("suite_hash"):
        reasons.append("the suites differ")
    if after.get("failed", 0) - before.get("failed", 0) > most_failures:
        reasons.append("more evaluations fail")
    if most_ratio is not None:
        ratio = performance_delta(before["seconds"], after["seconds"])["ratio"]
        if ratio is None or ratio > most_ratio:
            reasons.append("it is slower than allowed")
    return {"accepted": not reasons, "reasons": reasons, "quality": quality_delta({k: before.get(k, 0) for k in ("passed", "failed")}, {k: after.get(k, 0) for k in ("passed", "failed")})}
