"""Scanning of documents with a bank.

The bank is compiled to detectors on the driver and broadcast (LIMITS bound it). A worker finds with one
automaton pass which detectors' certain fragments a text holds, and runs the exact fold only for those: within
an entity the leftmost match wins, at one place the first detector in canonical order, and the cursor goes on
at the match's end. Entities are independent of one another.
"""

from __future__ import annotations

import functools
import json
from collections import defaultdict
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bankspark import model
from bankspark.model import BankError
from bankspark.operators import bank as banks
from bankspark.operators.patterns import compile_pattern, fold, fragment, literal_pattern, merge_flags, word_bounded
from bankspark.runtime import spread

MODES = ("entity_independent", "global_leftmost", "all_overlaps")


def detectors(bank: Mapping[str, Any], statuses: tuple[str, ...] = ("active",), word_boundaries: bool = False, entity: str | None = None) -> list[dict[str, Any]]:
    """The compiled, ordered detectors of a bank's patterns with an active chain; BankError for an ambiguous or repeated one."""
    kept = banks.filter_status(bank, statuses)
    if kept is None:
        return []
    default, out, identities = bank.get("default_regex_flags") or [], [], {}
    for e, ent, n, name, p, x in banks.each_pattern(kept):
        if entity is not None and e != entity:
            continue
        if not isinstance(x.get("priority"), int) or x["priority"] < 0:
            raise BankError(f"{e}/{n}/{p}: the priority has to be 0 or more")
        literal = x["kind"] == "literal"
        flags = merge_flags(default, ent.get("regex_flags"), (["IGNORECASE"] if not x["case_sensitive"] else []) if literal else x.get("regex_flags"))
        pattern = literal_pattern(x["value"], x["normalize_whitespace"], x["left_boundary"], x["right_boundary"], "VERBOSE" in flags) if literal else x["value"]
        pattern = word_bounded(pattern) if word_boundaries else pattern
        surface = x["value"] if literal else p
        canonical = name.get("canonical") or ""
        if identities.setdefault((e, canonical, surface), (n, p)) != (n, p):
            raise BankError(f"{e}/{canonical}/{surface} names more than one detector")
        out.append({"entity": e, "canonical_name": canonical, "surface_name": surface, "regex": pattern, "flags": flags, "priority": x["priority"], "entity_id": e, "name_id": n, "pattern_id": p, "pattern_kind": x["kind"], "value": x["value"]})
        if not literal:  # escaped literals always compile
            compile_pattern(pattern, flags)
    out.sort(key=lambda d: (d["entity"], d["priority"], d["canonical_name"], d["surface_name"], d["regex"], d["flags"]))
    if len(out) > model.LIMITS["bank_patterns"]:
        raise BankError("the bank has too many patterns")
    order: dict[str, int] = defaultdict(int)
    for i, d in enumerate(out):
        d |= {"detector_index": i, "pattern_order": order[d["entity"]], "stable_id": banks.stable_id("pattern", d["entity"], d["canonical_name"], d["surface_name"], d["regex"], str(word_boundaries).lower(), "none", *d["flags"])}
        order[d["entity"]] += 1
    return out


def detector_table(spark: SparkSession, found: list[dict[str, Any]]) -> DataFrame:
    return spark.createDataFrame([tuple(d[f.name] for f in model.DETECTORS) for d in found], model.DETECTORS)


def ordered_alternatives(spark: SparkSession, rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Detector rows of the compact form (entity, name, regex, flags[, priority]): order within the entity is the default priority."""
    out, seen = [], defaultdict(int)
    for r in rows:
        out.append({"entity": r["entity"], "canonical_name": r.get("canonical_name", r["name"]), "surface_name": r["name"], "regex": r["regex"], "flags": merge_flags(r.get("flags")), "priority": r.get("priority", seen[r["entity"]]), "entity_id": r["entity"], "name_id": r["name"], "pattern_id": r["name"], "pattern_kind": "regex", "value": r["regex"]})
        seen[r["entity"]] += 1
    out.sort(key=lambda d: (d["entity"], d["priority"], d["canonical_name"], d["surface_name"], d["regex"], d["flags"]))
    order: dict[str, int] = defaultdict(int)
    for i, d in enumerate(out):
        compile_pattern(d["regex"], d["flags"])
        d |= {"detector_index": i, "pattern_order": order[d["entity"]], "stable_id": ""}
        order[d["entity"]] += 1
    return out


class _Compiled(dict):
    """Detector to compiled pattern, made when first needed: most texts need few of a large bank's patterns."""

    def __init__(self, found: list[dict[str, Any]]):
        super().__init__()
        self.found = found

    def __missing__(self, i: int) -> Any:
        d = self.found[i]
        self[i] = compile_pattern(d["regex"], d["flags"])
        return self[i]


class Scanner:
    """A worker's compiled bank."""

    def __init__(self, found: list[dict[str, Any]]):
        self.found = found
        self.compiled = _Compiled(found)
        self.always = [i for i, d in enumerate(found) if fragment(d) is None]
        by_text: dict[str, list[int]] = defaultdict(list)
        for i, d in enumerate(found):
            if (f := fragment(d)) is not None:
                by_text[f].append(i)
        self.by_text = by_text
        try:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for f, where in by_text.items():
                self.automaton.add_word(f, where)
            if by_text:
                self.automaton.make_automaton()
        except ImportError:
            self.automaton = None

    def possible(self, text: str) -> list[int]:
        """Detectors that may match."""
        out = set(self.always)
        if self.by_text:
            low = fold(text)
            if self.automaton is not None:
                for _, where in self.automaton.iter(low):
                    out.update(where)
            else:
                for f, where in self.by_text.items():
                    if f in low:
                        out.update(where)
        return sorted(out)

    def fold(self, text: str, which: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, end, detector): leftmost, then first in order, then on from its end."""
        nexts = {i: self.compiled[i].search(text) for i in which}
        cursor = 0
        while True:
            best = None
            for i in which:
                m = nexts[i]
                if m is not None and m.start() < cursor:
                    m = nexts[i] = self.compiled[i].search(text, cursor)
                if m is not None and (best is None or (m.start(), i) < best[:2]):
                    best = (m.start(), i, m.end())
            if best is None:
                return
            start, i, end = best
            yield start, end, i
            cursor = end if end > start else end + 1

    def matches(self, text: str, mode: str = MODES[0]) -> list[tuple[int, int, int]]:
        which = self.possible(text)
        if not which:
            return []
        if mode == "global_leftmost":
            return list(self.fold(text, which))
        if mode == "all_overlaps":
            out = set()
            for i in which:
                at = 0
                while (m := self.compiled[i].search(text, at)) is not None:
                    out.add((m.start(), m.end(), i))
                    at = m.start() + 1
            return sorted(out)
        by_entity = defaultdict(list)
        for i in which:
            by_entity[self.found[i]["entity"]].append(i)
        return sorted(x for own in by_entity.values() for x in self.fold(text, own))


@functools.lru_cache(8)
def _scanner(payload: str) -> Scanner:
    """One compiled bank a worker and bank."""
    return Scanner(json.loads(payload))


COLUMNS = ("entity", "canonical_name", "surface_name", "string", "start", "end", "entity_id", "name_id", "pattern_id", "pattern_kind")


def scan_all(df: DataFrame, key: str, text: str, found: list[dict[str, Any]], mode: str = MODES[0], offsets: str = "byte", most_bytes: int = model.LIMITS["text_bytes"], most: int = model.LIMITS["matches"]) -> DataFrame:
    """The records of `scan` with a last column `error`: null in records; of a text over a limit there is one row with the
    key, the error (text_too_large or too_many_matches) and nothing else. The limits hold alike with and without matches,
    and no text ends the job."""
    if mode not in MODES or offsets not in ("byte", "char"):
        raise BankError("unknown mode or offset unit")
    shared = df.sparkSession.sparkContext.broadcast(json.dumps(found))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared.value)
        for b in it:
            keys, rows = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                if len(t) > most_bytes // 4 and len(t.encode()) > most_bytes:
                    error = "text_too_large"
                else:
                    hits = scanner.matches(t, mode)
                    error = "too_many_matches" if len(hits) > most else None
                if error:
                    keys.append(k)
                    rows.append((*[None] * len(COLUMNS), error))
                    continue
                plain = t.isascii() or offsets == "char"
                at = byte = 0
                for s, e, i in hits:
                    d = scanner.found[i]
                    if plain:
                        bs, be = s, e
                    else:  # offsets grow with the starts: count on from the last one
                        byte += len(t[at:s].encode())
                        at, bs = s, byte
                        be = bs + len(t[s:e].encode())
                    keys.append(k)
                    rows.append((d["entity"], d["canonical_name"], d["surface_name"], t[s:e], bs, be, d["entity_id"], d["name_id"], d["pattern_id"], d["pattern_kind"], None))
            columns = list(zip(*rows)) if rows else [()] * (len(COLUMNS) + 1)
            kinds = [pa.int64() if c in ("start", "end") else pa.string() for c in (*COLUMNS, "error")]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema[0].type), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["k", *COLUMNS, "error"])

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = f"k {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"`{c}` {'long' if c in ('start', 'end') else 'string'}" for c in (*COLUMNS, "error"))
    rows = rows if df.isStreaming else spread(rows)
    out = rows.mapInArrow(batches, schema).withColumnRenamed("k", key)
    return out.select(key, *COLUMNS[:6], F.lit(offsets).alias("offset_unit"), *COLUMNS[6:], F.create_map().cast("map<string,string>").alias("captures"), "error")


def scan(df: DataFrame, key: str, text: str, found: list[dict[str, Any]], mode: str = MODES[0], offsets: str = "byte") -> DataFrame:
    """One record per match: key, the detector's names and ids, the matched string and its half-open span.

    Null and empty texts have none; texts over a limit have none either and come out of `rejected_texts`.
    """
    return scan_all(df, key, text, found, mode, offsets).where("error is null").drop("error")


def rejected_texts(df: DataFrame, key: str, text: str, found: list[dict[str, Any]], mode: str = MODES[0], **limits: int) -> DataFrame:
    """key, error: the texts that `scan` refuses."""
    return scan_all(df, key, text, found, mode, **limits).where("error is not null").select(key, "error")


def scan_text(text: str, found: list[dict[str, Any]], mode: str = MODES[0], offsets: str = "byte") -> list[dict[str, Any]]:
    """Records of one text, in public order, without Spark."""
    out = []
    for s, e, i in Scanner(found).matches(text, mode):
        d = found[i]
        bs, be = (s, e) if offsets == "char" else (len(text[:s].encode()), len(text[:e].encode()))
        out.append({k: d[k] for k in ("entity", "canonical_name", "surface_name", "entity_id", "name_id", "pattern_id", "pattern_kind")} | {"string": text[s:e], "start": bs, "end": be, "offset_unit": offsets, "captures": {}})
    return sorted(out, key=lambda r: (r["start"], r["end"], r["entity_id"], r["name_id"], r["pattern_id"], r["string"]))


def dictionary_join(df: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """Candidates of large banks of word-bounded literals: word n-grams joined with the folded literals.

    key, entity, pattern key columns and the word position; an equi join, so the bank may outgrow a broadcast.
    `patterns` has entity, name_id, pattern_id, value; words are letters, digits and dots that end an initial.
    N-grams are made of the lengths that the literals have, whatever they are.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    bank = patterns.select("entity_id", "name_id", "pattern_id", words(F.col("value")).alias("l")).where(F.size("l") > 0)
    lengths = sorted(r[0] for r in bank.select(F.size("l")).distinct().collect())
    bank = bank.select("entity_id", "name_id", "pattern_id", F.array_join("l", " ").alias("gram"))

    def grams(n: int) -> Column:
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("position"), F.array_join(F.slice("w", i, n), " ").alias("gram")))

    rows = df.select(F.col(key), words(F.col(text)).alias("w"))
    rows = rows.select(key, F.explode(F.flatten(F.array(*map(grams, lengths or [1])))).alias("g")).select(key, "g.position", "g.gram")
    return rows.join(bank, "gram").select(key, "entity_id", "name_id", "pattern_id", "position")
