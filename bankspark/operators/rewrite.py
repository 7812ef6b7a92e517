"""Redaction and pseudonyms over resolved records, and their inverse.

Edits are rows (document, start, end, replacement) in characters, not overlapping within a document; texts are
rewritten by expressions over the document's sorted edits, so nothing leaves the JVM.
"""

from __future__ import annotations

import copy
import hashlib
import json
import os
import tempfile
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bankspark.functions.text import assignment_digest, redaction_token
from bankspark.model import LIMITS, BankError
from bankspark.runtime import ranked

SCOPES = {"name": "name_id", "canonical": "canonical_name", "surface": "string"}
TEMPLATE = "[{ENTITY}_{ordinal:04d}]"


def assignment_key(scope: str = "name") -> Column:
    """entity | scope | digest of scope, entity and value."""
    value = F.col(SCOPES[scope])
    return F.concat_ws("|", "entity_id", F.lit(scope), F.sha2(F.to_json(F.array(F.lit(scope), F.col("entity_id"), value)), 256))


def without_overlap(records: DataFrame, document: str) -> DataFrame:
    """Records that the greedy choice keeps: longest first, then by start, entity and pattern; each disjoint from all kept before.

    The fold runs over the sorted spans of one document.
    """
    span = F.struct((F.col("start") - F.col("end")).alias("size"), "start", "end", "entity_id", F.coalesce("name_id", F.lit("")).alias("name_id"), "pattern_id", "string")
    spans = records.groupBy(document).agg(F.array_sort(F.collect_set(span)).alias("s"))
    kind = spans.schema["s"].dataType.simpleString()
    free = lambda acc, x: ~F.exists(acc, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"]))
    kept = F.aggregate("s", F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    return spans.select(document, F.explode(kept).alias("k")).select(document, "k.entity_id", "k.name_id", "k.pattern_id", "k.string", "k.start", "k.end")


def redaction_ordinals(records: DataFrame, document: str, scope: str = "name", known: DataFrame | None = None) -> DataFrame:
    """assignment_key, entity_id, ordinal, token: the next numbers of each entity in order of first appearance.

    `known` (assignment_key, entity_id, ordinal) keeps its numbers; new keys go on after the entity's largest.
    Only distinct keys are ordered: of names and canonicals, which a bank bounds, within the entity; of surfaces by ranges.
    """
    first = records.withColumn("assignment_key", assignment_key(scope)).groupBy("assignment_key", "entity_id").agg(F.min(F.struct(document, "start", "end")).alias("at"))
    if known is not None:
        old = known.select("assignment_key", "entity_id", "ordinal")
        base = old.groupBy("entity_id").agg(F.max("ordinal").alias("base"))
        first = first.join(old, ["assignment_key"], "left_anti").join(base, "entity_id", "left")
    else:
        first = first.withColumn("base", F.lit(0))
    if scope == "surface":
        first = ranked(first, "entity_id", "at", "assignment_key")
        first = first.join(first.groupBy("entity_id").agg((F.min("n") - 1).alias("others")), "entity_id").withColumn("n", F.col("n") - F.col("others"))
    else:
        first = first.withColumn("n", F.row_number().over(W.partitionBy("entity_id").orderBy("at", "assignment_key")))
    new = first.select("assignment_key", "entity_id", (F.coalesce("base", F.lit(0)) + F.col("n")).cast("long").alias("ordinal"))
    every = new if known is None else new.union(old)
    return every.withColumn("token", redaction_token(TEMPLATE, F.col("entity_id"), F.col("ordinal")))


def pseudonyms(records: DataFrame, document: str, candidates: DataFrame, scope: str = "name") -> DataFrame:
    """assignment_key, candidate_id, value: the n-th new key gets the n-th unused candidate; null where candidates run out.

    `candidates` has position, id, value of one set without reuse.
    """
    first = records.withColumn("assignment_key", assignment_key(scope)).groupBy("assignment_key").agg(F.min(F.struct(document, "start", "end")).alias("at"))
    keys = ranked(first, "at", "assignment_key")
    places = ranked(candidates.select("position", F.col("id").alias("candidate_id"), "value"), "position", "candidate_id", "value")
    return keys.join(places, "n", "left").select("assignment_key", "candidate_id", "value")


def allocate_with_reuse(keys: list[str], candidates: list[Mapping[str, str]], taken: Mapping[str, str] | None = None) -> dict[str, str | None]:
    """Key to candidate id in a set that may be reused: from the key's hash on, the first whose value no other key has."""
    values = dict(taken or {})
    out: dict[str, str | None] = {}
    for key in keys:
        start = int(hashlib.sha256(key.encode()).hexdigest(), 16) % len(candidates) if candidates else 0
        out[key] = None
        for c in [*candidates[start:], *candidates[:start]]:
            if values.get(c["value"], key) == key:
                values[c["value"]], out[key] = key, c["id"]
                break
    return out


def apply_edits(documents: DataFrame, edits: DataFrame, document: str, text: str) -> DataFrame:
    """document, text: every document with its edits applied; documents without any stay as they are."""
    per = edits.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("_e"))
    rows = documents.select(document, F.col(text).alias("_t")).join(per, document, "left")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_e", i - 1)["end"])
    piece = lambda e, i: F.concat(F.substring("_t", (before(i) + 1).cast("int"), (e["start"] - before(i)).cast("int")), e["replacement"])
    tail = F.expr("substring(_t, cast(element_at(_e, -1)['end'] + 1 as int))")
    return rows.select(document, F.when(F.col("_e").isNull(), F.col("_t")).otherwise(F.concat(F.array_join(F.transform("_e", piece), ""), tail)).alias(text))


def shifted_spans(edits: DataFrame, document: str) -> DataFrame:
    """Edits with new_start, new_end: spans of the replacements in the rewritten text, by the running change of length."""
    delta = F.length("replacement") - (F.col("end") - F.col("start"))
    run = W.partitionBy(document).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    rows = edits.withColumn("_d", F.coalesce(F.sum(delta).over(run), F.lit(0)))
    return rows.withColumn("new_start", F.col("start") + F.col("_d")).withColumn("new_end", F.col("start") + F.col("_d") + F.length("replacement")).drop("_d")


def ambiguous_tokens(assignments: DataFrame) -> DataFrame:
    """Replacement values that stand for more than one key: a reverse bank cannot be built with them."""
    return assignments.groupBy("token").agg(F.countDistinct("assignment_key").alias("keys")).where("keys > 1")


def restore(documents: DataFrame, assignments: DataFrame, document: str, text: str, pattern: str = r"\[[A-Z0-9_]+_\d{4,}\]") -> DataFrame:
    """Tokens of the redaction template put back to their originals. `assignments` has token, original; unknown tokens stay.

    Tokens of a text are found by their shape, joined with the assignments and replaced together.
    """
    pieces = F.split(F.col(text), pattern, -1)
    rows = documents.select(document, pieces.alias("_p"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("_m"))
    found = rows.select(document, F.posexplode("_m").alias("i", "token")).join(assignments.select("token", "original"), "token", "left")
    back = found.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("original", "token").alias("v")))).alias("_b"))
    joined = rows.join(back, document, "left")
    woven = F.transform("_p", lambda p, i: F.concat(p, F.coalesce(F.get("_b", i)["v"], F.lit(""))))
    return joined.select(document, F.array_join(woven, "").alias(text))


# --- the replacement store: a versioned document, written with an optimistic check ----------------------------------


def new_store(policy: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return {"version": 0, "defaults": {"replacement_mode": "redact", "scope": "name", **(policy or {})}, "entities": {}, "replacement_sets": {}, "assignments": {}}


def policy_of(store: Mapping[str, Any], entity: str) -> dict[str, Any]:
    """The defaults overlaid by the entity's own policy."""
    return {**store["defaults"], **store["entities"].get(entity, {})}


def check_store(store: Mapping[str, Any]) -> list[str]:
    """What breaks the store: repeated ordinals or values, keys that do not fit their entity, unknown candidates."""
    out, ordinals, values = [], set(), {}
    for key, a in store["assignments"].items():
        if not key.startswith(a["entity_id"] + "|"):
            out.append(f"{key}: the key is not of entity {a['entity_id']}")
        if (r := a.get("redaction")) is not None:
            if (a["entity_id"], r["ordinal"]) in ordinals or r["ordinal"] < 1:
                out.append(f"{key}: ordinal {r['ordinal']} is used or below 1")
            ordinals.add((a["entity_id"], r["ordinal"]))
        if (v := a.get("replacement", {}).get("value")) is not None and values.setdefault(v, key) != key:
            out.append(f"{key}: value {v!r} stands for another key")
        if (s := a.get("replacement", {}).get("set_id")) is not None and s not in store["replacement_sets"]:
            out.append(f"{key}: unknown set {s}")
    return out


def with_set(store: Mapping[str, Any], set_id: str, values: list[str], reuse: bool = False) -> dict[str, Any]:
    out = copy.deepcopy(dict(store))
    if set_id in out["replacement_sets"]:
        raise BankError(f"set {set_id} is there already")
    out["replacement_sets"][set_id] = {"reuse": reuse, "candidates": [{"id": f"c{i}", "value": v} for i, v in enumerate(values)]}
    return out


def store_hash(store: Mapping[str, Any]) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(store, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def load_store(path: str) -> dict[str, Any]:
    data = Path(path).read_bytes()
    if len(data) > LIMITS["replacement_db_bytes"]:
        raise BankError("the replacement store is too large")
    store = json.loads(data)
    if errors := check_store(store):
        raise BankError("the replacement store is not sound", [{"message": e} for e in errors])
    return store


def save_store(store: Mapping[str, Any], path: str, expected: str | None) -> dict[str, Any]:
    """Write the next version if the stored one still has the expected hash (None: there is none); else BankError."""
    target = Path(path)
    if (store_hash(json.loads(target.read_bytes())) if target.exists() else None) != expected:
        raise BankError("the replacement store has changed since it was read")
    out = {**store, "version": store["version"] + 1}
    if errors := check_store(out):
        raise BankError("the replacement store is not sound", [{"message": e} for e in errors])
    handle, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, sort_keys=True)
    os.chmod(name, 0o600)
    os.replace(name, target)
    return out


# --- one text with a store -------------------------------------------------------------------------------------------


def allocate(store: Mapping[str, Any], record: Mapping[str, Any]) -> tuple[dict[str, Any], dict[str, Any] | None]:
    """(store, assignment) of a record: the known one, or a new one by the entity's policy; None where candidates are exhausted."""
    policy = policy_of(store, record["entity_id"])
    scope, mode = policy.get("scope", "name"), policy.get("replacement_mode", "redact")
    value = record.get(SCOPES[scope])
    if not value:
        raise BankError(f"the scope {scope} needs {SCOPES[scope]}")
    key = assignment_digest(scope, record["entity_id"], value)
    known = store["assignments"].get(key)
    if known is not None and mode in known["modes"]:
        return dict(store), known
    out = {**store, "assignments": dict(store["assignments"])}
    made = copy.deepcopy(known) if known else {"entity_id": record["entity_id"], "original": record["string"], "modes": []}
    if mode == "redact":
        ordinal = 1 + max((a["redaction"]["ordinal"] for a in store["assignments"].values() if a["entity_id"] == record["entity_id"] and "redaction" in a), default=0)
        made["redaction"] = {"ordinal": ordinal, "token": f"[{record['entity_id'].upper()}_{ordinal:04d}]"}
    else:
        pool = store["replacement_sets"].get(policy.get("replacement_set_id"))
        if pool is None:
            raise BankError("pseudonyms need a replacement set")
        used = {a["replacement"]["value"]: k for k, a in store["assignments"].items() if "replacement" in a}
        if pool["reuse"]:
            chosen = allocate_with_reuse([key], pool["candidates"], used)[key]
            candidate = next((c for c in pool["candidates"] if c["id"] == chosen), None)
        else:
            candidate = next((c for c in pool["candidates"] if c["value"] not in used), None)
        if candidate is None:
            return dict(store), None
        made["replacement"] = {"set_id": policy["replacement_set_id"], "candidate_id": candidate["id"], "value": candidate["value"]}
    made["modes"] = sorted({*made["modes"], mode})
    out["assignments"][key] = made
    return out, made


def anonymise_text(text: str, records: list[Mapping[str, Any]], store: Mapping[str, Any], missing: str = "fail") -> tuple[str, dict[str, Any], list[dict[str, Any]]]:
    """(text, store, edits): resolved records (bytes, no overlap) replaced in order; `missing` is fail or skip."""
    raw, out, edits, end = text.encode(), [], [], 0
    for r in sorted(records, key=lambda r: (r["start"], r["end"])):
        if r["start"] < end or raw[r["start"] : r["end"]] != r["string"].encode():
            raise BankError("records overlap or do not fit the text")
        store, made = allocate(store, r)
        if made is None:
            if missing == "fail":
                raise BankError("no candidate is left")
            continue
        mode = policy_of(store, r["entity_id"]).get("replacement_mode", "redact")
        value = made["redaction"]["token"] if mode == "redact" else made["replacement"]["value"]
        out.append(raw[end : r["start"]] + value.encode())
        edits.append({"start": r["start"], "end": r["end"], "replacement": value})
        end = r["end"]
    return (b"".join(out) + raw[end:]).decode(), dict(store), edits


def reverse_entries(store: Mapping[str, Any], pseudonyms_too: bool = False) -> list[dict[str, str]]:
    """What can be put back: value, original, mode and key; BankError if a value stands for two originals or there are too many."""
    out: dict[str, dict[str, str]] = {}
    for key, a in sorted(store["assignments"].items()):
        if a.get("original") is None:
            continue
        values = [("redact", a["redaction"]["token"])] if "redaction" in a else []
        values += [("pseudonym", a["replacement"]["value"])] if pseudonyms_too and "replacement" in a else []
        for mode, value in values:
            entry = out.setdefault(value, {"value": value, "original": a["original"], "mode": mode, "key": key})
            if entry["original"] != a["original"]:
                raise BankError(f"{value!r} stands for more than one original")
    if len(out) > LIMITS["reverse_entities"]:
        raise BankError("too many values for one reverse bank")
    return list(out.values())


def restore_one(text: str, store: Mapping[str, Any], pseudonyms_too: bool = False) -> str:
    """A text with its tokens put back: longest first, tokens before pseudonyms, pseudonyms only where no word goes on."""
    found = []
    for entry in reverse_entries(store, pseudonyms_too):
        value, at = entry["value"], text.find(entry["value"])
        while at >= 0:
            end = at + len(value)
            word = lambda c: c.isalnum() or c == "_"
            glued = (at and word(value[0]) and word(text[at - 1])) or (end < len(text) and word(value[-1]) and word(text[end]))
            if entry["mode"] == "redact" or not glued:
                found.append((at - end, entry["mode"] != "redact", entry["key"], at, end, entry["original"]))
            at = text.find(value, at + 1)
    kept: list[tuple[int, int, str]] = []
    for _, _, _, a, b, original in sorted(found):
        if all(b <= s or e <= a for s, e, _ in kept):
            kept.append((a, b, original))
    for a, b, original in sorted(kept, reverse=True):
        text = text[:a] + original + text[b:]
    return text


def public_view(store: Mapping[str, Any]) -> dict[str, Any]:
    """The store without originals and keys."""
    hidden = [{k: v for k, v in a.items() if k != "original"} for a in store["assignments"].values()]
    return {**{k: v for k, v in store.items() if k != "assignments"}, "assignments": hidden}
