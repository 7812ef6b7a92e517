"""The modules of queries of the core."""

from __future__ import annotations

from types import ModuleType


def modules() -> list[ModuleType]:
    from bankspark.plans import audit_queries, bank_queries, core_queries, corpus_queries, quality_queries, source_queries, stream_queries

    return [core_queries, bank_queries, corpus_queries, quality_queries, audit_queries, source_queries, stream_queries]
