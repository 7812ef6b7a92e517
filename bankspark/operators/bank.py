"""Bank algebra: checking, canonical form, hash, statistics, filters, differences, patches, lints.

A bank is a small dictionary kept on the driver (LIMITS bound it); what is compared over many banks or joined
with records is the flattened pattern table of `flatten`.
"""

from __future__ import annotations

import copy
import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from bankspark import model
from bankspark.model import BankError

TOP = ("schema_version", "id", "name", "description", "version", "status", "created_at", "updated_at", "unicode_normalization", "default_regex_flags", "entities", "metadata")
LEVELS = {
    "bank": (TOP, ("eval_refs",)),
    "entity": (("description", "status", "regex_flags", "names", "metadata"), ("eval_refs",)),
    "name": (("canonical", "description", "status", "patterns", "metadata"), ("eval_refs",)),
    "pattern": (("kind", "value", "description", "status", "priority", "metadata"), ("eval_refs", "regex_flags", "case_sensitive", "normalize_whitespace", "left_boundary", "right_boundary")),
}
LITERAL_ONLY = ("case_sensitive", "normalize_whitespace", "left_boundary", "right_boundary")
CHILDREN = {"bank": ("entities", "entity"), "entity": ("names", "name"), "name": ("patterns", "pattern")}


def pointer(*parts: Any) -> str:
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in parts)


def finding(severity: str, code: str, path: str, message: str) -> dict[str, str]:
    return {"severity": severity, "code": code, "path": path, "message": message}


def strict_json(text: str, depth: int = model.LIMITS["json_depth"]) -> Any:
    """JSON without duplicate keys, non-finite numbers or excessive depth."""

    def pairs(items: list[tuple[str, Any]]) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise BankError("duplicate JSON key")
        return out

    def constant(name: str) -> Any:
        raise BankError(f"non-finite JSON number {name}")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except (json.JSONDecodeError, RecursionError) as error:
        raise BankError(f"not JSON: {error}") from error
    level = [value]
    for _ in range(depth):
        level = [c for v in level for c in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        if not level:
            return value
    raise BankError("JSON is nested too deeply")


def parse_bank(data: bytes, name: str, check: bool = True) -> dict[str, Any]:
    """A bank from strict JSON in UTF-8, under the limit of its size; BankError if it is not valid."""
    if len(data) > model.LIMITS["bank_bytes"]:
        raise BankError("the bank is too large")
    bank = strict_json(data.decode("utf-8"))
    if check and (errors := [d for d in validate(bank) if d["severity"] == "error"]):
        raise BankError(f"{name} is no valid bank", errors)
    return bank


def read_bank(path: str, check: bool = True) -> dict[str, Any]:
    return parse_bank(Path(path).read_bytes(), path, check)


# --- checks -----------------------------------------------------------------------------------------------


def validate(bank: Any) -> list[dict[str, str]]:
    """Diagnostics of a bank's shape, ids, flags and sizes, in order of path, severity, code and message."""
    out: list[dict[str, str]] = []
    if not isinstance(bank, dict):
        return [finding("error", "schema.type", "", "a bank is an object")]
    _check(bank, "bank", (), out)
    return sorted(out, key=lambda d: (d["path"], d["severity"], d["code"], d["message"]))


def _check(node: dict, level: str, path: tuple, out: list) -> None:
    say = lambda code, key, text, severity="error": out.append(finding(severity, code, pointer(*path, *([key] if key else [])), text))
    required, optional = LEVELS[level]
    if level == "pattern":
        required += LITERAL_ONLY if node.get("kind") == "literal" else ("regex_flags",) if node.get("kind") == "regex" else ()
        for k in ("regex_flags",) if node.get("kind") == "literal" else LITERAL_ONLY if node.get("kind") == "regex" else ():
            if k in node:
                say("schema.additional_property", k, f"a {node['kind']} pattern has no {k}")
    for k in required:
        if k not in node:
            say("schema.required", "", f"{k} is missing")
    for k in node:
        if k not in required + optional:
            say("schema.additional_property", k, "unknown property")
    kinds: dict[str, Callable[[Any], bool]] = {
        **dict.fromkeys(("id", "name", "version", "created_at", "updated_at", "canonical"), lambda v: isinstance(v, str)),
        "schema_version": lambda v: isinstance(v, str) and re.fullmatch(r"[a-z]+\.bank\.v1", v) is not None,
        "description": lambda v: isinstance(v, str) and len(v) <= model.LIMITS["description_chars"],
        "status": lambda v: v in model.STATUSES,
        "unicode_normalization": lambda v: v in model.NORMALISATIONS,
        "kind": lambda v: v in ("literal", "regex"),
        "value": lambda v: isinstance(v, str) and 1 <= len(v) <= model.LIMITS["pattern_chars"],
        "priority": lambda v: isinstance(v, int) and not isinstance(v, bool),
        "case_sensitive": lambda v: isinstance(v, bool),
        "normalize_whitespace": lambda v: isinstance(v, bool),
        "left_boundary": lambda v: v in model.BOUNDARIES,
        "right_boundary": lambda v: v in model.BOUNDARIES,
        "metadata": lambda v: isinstance(v, dict) and _is_json(v),
        "eval_refs": lambda v: isinstance(v, list) and all(isinstance(x, str) and x for x in v),
        "regex_flags": lambda v: isinstance(v, list) and all(x in model.FLAGS for x in v if isinstance(x, str)) and all(isinstance(x, str) for x in v),
        **dict.fromkeys(("entities", "names", "patterns"), lambda v: isinstance(v, dict) and bool(v)),
    }
    kinds["default_regex_flags"] = kinds["regex_flags"]
    for k, v in node.items():
        if k in kinds and not kinds[k](v):
            say("schema.type", k, f"{k} has a value of the wrong kind")
    if level == "bank" and isinstance(node.get("id"), str) and not re.match(model.ID, node["id"]):
        say("id.invalid", "id", "ids are lower-case letters, digits and underscores")
    for k in ("regex_flags", "default_regex_flags"):
        if isinstance(v := node.get(k), list) and len({*map(str, v)}) < len(v):
            say("flags.duplicate", k, "a flag is given twice")
    if isinstance(v := node.get("eval_refs"), list) and len(v) > model.LIMITS["eval_refs"]:
        say("eval_refs.large", "eval_refs", "too many references", "warning")
    if isinstance(v := node.get("metadata"), dict) and _is_json(v):
        size = len(json.dumps(v, ensure_ascii=False, separators=(",", ":")).encode())
        if size > model.LIMITS["metadata_error"]:
            say("metadata.too_large", "metadata", "metadata is too large")
        elif size > model.LIMITS["metadata_warning"]:
            say("metadata.large", "metadata", "metadata is large", "warning")
    if level in CHILDREN and isinstance(children := node.get(CHILDREN[level][0]), dict):
        for k, v in children.items():
            if not re.match(model.ID, k):
                out.append(finding("error", "id.invalid", pointer(*path, CHILDREN[level][0], k), "ids are lower-case letters, digits and underscores"))
            if isinstance(v, dict):
                _check(v, CHILDREN[level][1], (*path, CHILDREN[level][0], k), out)
            else:
                out.append(finding("error", "schema.type", pointer(*path, CHILDREN[level][0], k), "an object is expected"))


def _is_json(v: Any) -> bool:
    if isinstance(v, dict):
        return all(isinstance(k, str) and _is_json(x) for k, x in v.items())
    if isinstance(v, list):
        return all(map(_is_json, v))
    return v is None or isinstance(v, (str, bool, int)) or (isinstance(v, float) and math.isfinite(v))


# --- canonical form and hash ---------------------------------------------------------------------------------


def ordered_flags(flags: list[str]) -> list[str]:
    return sorted(dict.fromkeys(flags), key=lambda f: (model.FLAGS.index(f) if f in model.FLAGS else len(model.FLAGS), f))


def canonical(value: Any, key: str = "") -> Any:
    """Keys sorted, references sorted, flags without repeats in their fixed order; nothing is invented."""
    if isinstance(value, Mapping):
        return {k: canonical(value[k], k) for k in sorted(value)}
    if isinstance(value, list):
        items = [canonical(v) for v in value]
        if key == "eval_refs":
            return sorted(items)
        return ordered_flags(items) if key in ("regex_flags", "default_regex_flags") else items
    return value


def canonical_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def bank_hash(bank: Mapping[str, Any]) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(canonical(bank)).encode()).hexdigest()


def stable_id(kind: str, *fields: str) -> str:
    """Digest of length-prefixed fields."""
    digest = hashlib.sha256()
    for f in (kind, *fields):
        raw = f.encode()
        digest.update(len(raw).to_bytes(8, "big") + raw)
    return f"{kind}:sha256:{digest.hexdigest()}"


# --- flattening ----------------------------------------------------------------------------------------------


def each_pattern(bank: Mapping[str, Any]) -> Iterator[tuple[str, dict, str, dict, str, dict]]:
    for e, entity in sorted(bank.get("entities", {}).items()):
        for n, name in sorted(entity.get("names", {}).items()):
            for p, pattern in sorted(name.get("patterns", {}).items()):
                yield e, entity, n, name, p, pattern


def flatten(spark: SparkSession, bank: Mapping[str, Any]) -> DataFrame:
    """The pattern table of a bank."""
    rows = [
        (bank.get("id"), e, entity.get("status"), entity.get("regex_flags"), n, name.get("canonical"), name.get("status"), p, x.get("kind"), x.get("value"), x.get("status"), x.get("priority"), x.get("regex_flags"), x.get("case_sensitive"), x.get("normalize_whitespace"), x.get("left_boundary"), x.get("right_boundary"), canonical_json(x.get("metadata", {})))
        for e, entity, n, name, p, x in each_pattern(bank)
    ]
    return spark.createDataFrame(rows, model.PATTERNS)


def bank_of(rows: list[Mapping[str, Any]], bank_id: str = "bank") -> dict[str, Any]:
    """The bank of a pattern table's rows (bounded by LIMITS); repeated rows are one, unknown statuses stay."""
    entities: dict[str, Any] = {}
    for r in rows:
        entity = entities.setdefault(r["entity_id"], {"description": "", "status": r["entity_status"], "regex_flags": ordered_flags(r["entity_flags"] or []), "names": {}, "metadata": {}})
        entity["regex_flags"] = ordered_flags([*entity["regex_flags"], *(r["entity_flags"] or [])])
        name = entity["names"].setdefault(r["name_id"], {"canonical": r["canonical"] or r["name_id"], "description": "", "status": r["name_status"], "patterns": {}, "metadata": {}})
        pattern = {"kind": r["kind"], "value": r["value"], "description": "", "status": r["status"], "priority": r["priority"], "metadata": json.loads(r["metadata"] or "{}")}
        pattern |= {"regex_flags": r["regex_flags"] or []} if r["kind"] == "regex" else {k: r[k] for k in LITERAL_ONLY}
        name["patterns"][r["pattern_id"]] = pattern
    return {"schema_version": "own.bank.v1", "id": bank_id, "name": bank_id, "description": "", "version": "1", "status": "active", "created_at": "", "updated_at": "", "unicode_normalization": "none", "default_regex_flags": [], "entities": entities, "metadata": {}}


def clean_patterns(df: DataFrame) -> DataFrame:
    """A dirty pattern table with statuses in lower case, one canonical name a name and repeats dropped.

    A name without a canonical one has its id for it. Of rows with one id, the one with the smallest (status rank, value, kind) stays.
    """
    rows = df.select(*[F.lower(F.trim(c)).alias(c) if c in ("status", "name_status", "entity_status") else F.col(c) for c in df.columns])
    rows = rows.withColumn("canonical", F.coalesce(F.max("canonical").over(W.partitionBy("bank_id", "entity_id", "name_id")), "name_id"))
    ids = ["bank_id", "entity_id", "name_id", "pattern_id"]
    rank = F.row_number().over(W.partitionBy(*ids).orderBy(F.coalesce(F.array_position(F.array(*map(F.lit, ("active", "draft", "inactive", "deprecated"))), F.col("status")), F.lit(0)) == 0, "status", "value", "kind", F.coalesce("priority", F.lit(0)), F.coalesce("metadata", F.lit(""))))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def chain_active(statuses: tuple[str, ...] = ("active",)) -> Column:
    """A pattern counts where its entity, name and own status are all among the statuses."""
    return F.col("entity_status").isin(*statuses) & F.col("name_status").isin(*statuses) & F.col("status").isin(*statuses)


def filter_status(bank: Mapping[str, Any], statuses: tuple[str, ...] = ("active",)) -> dict[str, Any] | None:
    """The bank with the patterns whose whole chain has one of the statuses; None if none is left."""
    out = {**bank, "entities": {}}
    for e, entity, n, name, p, pattern in each_pattern(bank):
        if entity.get("status") in statuses and name.get("status") in statuses and pattern.get("status") in statuses:
            kept = out["entities"].setdefault(e, {**entity, "names": {}})["names"].setdefault(n, {**name, "patterns": {}})
            kept["patterns"][p] = pattern
    return out if out["entities"] else None


def stats(bank: Mapping[str, Any]) -> dict[str, Any]:
    """Counts by level, status and kind; active ones have an active chain up to the bank."""
    levels = ("entities", "names", "patterns")
    total, active = dict.fromkeys(levels, 0), dict.fromkeys(levels, 0)
    by_status = {s: dict.fromkeys(levels, 0) for s in model.STATUSES}
    by_kind = {"literal": 0, "regex": 0}

    def count(level: str, node: Mapping, alive: bool) -> bool:
        total[level] += 1
        if node.get("status") in by_status:
            by_status[node["status"]][level] += 1
        alive = alive and node.get("status") == "active"
        active[level] += alive
        return alive

    for entity in bank.get("entities", {}).values():
        e = count("entities", entity, bank.get("status") == "active")
        for name in entity.get("names", {}).values():
            n = count("names", name, e)
            for pattern in name.get("patterns", {}).values():
                count("patterns", pattern, n)
                if pattern.get("kind") in by_kind:
                    by_kind[pattern["kind"]] += 1
    return {"totals": total, "active_totals": active, "by_status": by_status, "by_kind": by_kind}


# --- difference and patch ---------------------------------------------------------------------------------


def diff(old: Mapping[str, Any], new: Mapping[str, Any]) -> dict[str, Any]:
    """RFC 6902 operations from old to new (removals, additions, then common keys) and a count by level."""
    a, b = canonical(old), canonical(new)
    operations = list(_operations(a, b, ""))
    ids = {k: [set(_ids(x, k)) for x in (a, b)] for k in ("entities", "names", "patterns")}
    summary = {}
    for k, (before, after) in ids.items():
        summary |= {f"{k}_added": len(after - before), f"{k}_removed": len(before - after), f"{k}_changed": sum(_at(a, i) != _at(b, i) for i in before & after)}
    summary["top_level_fields_changed"] = sum(a.get(k) != b.get(k) for k in {*a, *b} - {"entities"})
    return {"patch": operations, "summary": summary | {"patch_operations": len(operations)}}


def _operations(a: Any, b: Any, path: str) -> Iterator[dict[str, Any]]:
    """What turns a into b, member by member; a stack holds the members still to be compared, the next one on top."""
    todo = [(path, a, b)]
    while todo:
        at, x, y = todo.pop()
        if not (isinstance(x, dict) and isinstance(y, dict)):
            if x != y or type(x) is not type(y):
                yield {"op": "replace", "path": at, "value": copy.deepcopy(y)}
            continue
        members = {k: at + pointer(k) for k in sorted({*x, *y})}
        for k, place in members.items():
            if k not in y:
                yield {"op": "remove", "path": place}
        for k, place in members.items():
            if k not in x:
                yield {"op": "add", "path": place, "value": copy.deepcopy(y[k])}
        todo += [(place, x[k], y[k]) for k, place in reversed(members.items()) if k in x and k in y]


def _ids(bank: Mapping, level: str) -> Iterator[tuple[str, ...]]:
    for e, entity in bank.get("entities", {}).items():
        if level == "entities":
            yield ("entities", e)
            continue
        for n, name in entity.get("names", {}).items():
            if level == "names":
                yield ("entities", e, "names", n)
            else:
                yield from (("entities", e, "names", n, "patterns", p) for p in name.get("patterns", {}))


def _at(value: Any, path: tuple[str, ...]) -> Any:
    for p in path:
        value = value[p]
    return value


def patch(bank: Mapping[str, Any], operations: list[Mapping[str, Any]]) -> dict[str, Any]:
    """RFC 6902 applied to a copy, which is then checked."""
    root = {"": copy.deepcopy(dict(bank))}
    for op in operations:
        try:
            _apply(root, op)
        except (KeyError, IndexError, ValueError, TypeError) as error:
            raise BankError("the patch does not apply", [finding("error", "patch.invalid", str(op.get("path")), str(error))]) from error
    if errors := [d for d in validate(root[""]) if d["severity"] == "error"]:
        raise BankError("the patched bank is not valid", errors)
    return root[""]


def _apply(root: dict, op: Mapping[str, Any]) -> None:
    def find(path: str) -> tuple[Any, Any]:
        if path and not path.startswith("/"):
            raise ValueError("a pointer begins with /")
        parts = ["", *(p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:])]
        node: Any = root
        for p in parts[:-1]:
            node = node[int(p)] if isinstance(node, list) else node[p]
        return node, parts[-1]

    def get(path: str) -> Any:
        node, key = find(path)
        return node[int(key)] if isinstance(node, list) else node[key]

    def remove(path: str) -> Any:
        node, key = find(path)
        return node.pop(int(key)) if isinstance(node, list) else node.pop(key)

    def add(path: str, value: Any) -> None:
        node, key = find(path)
        if isinstance(node, list):
            at = len(node) if key == "-" else int(key)
            if not 0 <= at <= len(node):
                raise IndexError("no such place in the list")
            node.insert(at, value)
        else:
            node[key] = value

    kind, path = op["op"], op["path"]
    if kind == "test":
        if canonical_json(get(path)) != canonical_json(op["value"]):
            raise ValueError("the test failed")
    elif kind == "add":
        add(path, copy.deepcopy(op["value"]))
    elif kind == "remove":
        remove(path)
    elif kind == "replace":
        node, key = find(path)
        get(path)
        node[int(key) if isinstance(node, list) else key] = copy.deepcopy(op["value"])
    elif kind == "move":
        if path.startswith(op["from"] + "/"):
            raise ValueError("a value cannot move into itself")
        add(path, remove(op["from"]))
    elif kind == "copy":
        add(path, copy.deepcopy(get(op["from"])))
    else:
        raise ValueError(f"no such operation: {kind}")


def add_pattern(bank: Mapping[str, Any], e: str, n: str, p: str, pattern: Mapping[str, Any], replace: bool = False) -> dict[str, Any]:
    out = copy.deepcopy(dict(bank))
    patterns = out["entities"].setdefault(e, {"description": "", "status": "active", "regex_flags": [], "names": {}, "metadata": {}})["names"].setdefault(n, {"canonical": n, "description": "", "status": "active", "patterns": {}, "metadata": {}})["patterns"]
    if p in patterns and not replace:
        raise BankError(f"{e}/{n}/{p} is there already")
    patterns[p] = dict(pattern)
    return out


def remove_pattern(bank: Mapping[str, Any], e: str, n: str, p: str) -> dict[str, Any]:
    """Without the pattern, and without its name and entity where they become empty."""
    out = copy.deepcopy(dict(bank))
    try:
        del out["entities"][e]["names"][n]["patterns"][p]
    except KeyError as error:
        raise BankError(f"there is no {e}/{n}/{p}") from error
    if not out["entities"][e]["names"][n]["patterns"]:
        del out["entities"][e]["names"][n]
    if not out["entities"][e]["names"]:
        del out["entities"][e]
    return out


# --- lints of patterns as columns ----------------------------------------------------------------------------


#: Risks and from how many on they count.
MOST_ALTERNATIVES, MOST_LOOKAROUNDS, MOST_GROUPS, SHORT = 20, 3, 50, 4
LOOKAROUNDS = ("(?=", "(?!", "(?<=", "(?<!")


def lint_columns(value: Column) -> dict[str, Column]:
    """Static risks of a regex, one boolean column each.

    `bare` is the pattern with a letter for each escape and class, so that what is left are operators. A group with a
    quantifier inside and one behind it is seen where the pattern is split at closing brackets: the piece before opens
    a group and has a quantifier after that, the piece behind begins with one.
    """
    bare = F.regexp_replace(F.regexp_replace(value, r"\\.", "E"), r"\[[^\]]*\]", "K")
    times = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x)))) / len(x)
    pieces = F.split(value, r"\)", -1)
    nested = F.exists(F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("a"), F.slice(pieces, 2, F.size(pieces) - 1).alias("b")), lambda p: p["a"].rlike(r"(?s)\(.*[*+]") & p["b"].rlike(r"^\s*[*+{]"))
    bounded = F.contains(value, F.lit("\\b")) | F.startswith(F.trim(value), F.lit("^")) | F.endswith(F.trim(value), F.lit("$"))
    return {
        "nested_quantifier": F.when(F.size(pieces) > 1, nested).otherwise(False),
        "unbounded_dot_star": F.contains(bare, F.lit(".*")),
        "huge_alternation": times(bare, "|") + 1 >= MOST_ALTERNATIVES,
        "repeated_lookaround": sum((times(value, x) for x in LOOKAROUNDS), F.lit(0)) >= MOST_LOOKAROUNDS,
        "excessive_groups": times(bare, "(") - times(bare, "(?") > MOST_GROUPS,
        "short_unbounded": (F.length(F.trim(value)) < SHORT) & ~bounded,
        "literal_candidate": ~value.rlike(r"[\\^$.|?*+()\[\]{}]") & (F.trim(value) != ""),
    }


def matches_empty(pattern: str, flags: list[str]) -> bool:
    """Whether a pattern matches nothing at some place of the probes."""
    from bankspark.operators.patterns import compile_pattern

    compiled = compile_pattern(pattern, flags)
    return any(m.start() == m.end() for probe in ("", "a", " ", "a b") for m in compiled.finditer(probe))
