"""Pattern lints: compiling, static risks, timed probes, empty matches, normalisation; validation at three levels."""

from __future__ import annotations

import re
import time
import unicodedata
from collections.abc import Iterator, Mapping
from typing import Any

from bankspark.model import BankError
from bankspark.operators import bank as banks
from bankspark.operators import scan as scans
from bankspark.operators.bank import finding, pointer
from bankspark.operators.patterns import compile_pattern, merge_flags

LEVELS = ("basic", "standard", "deep")
PROBES = {"standard": 5, "deep": 25}
PROBE_SECONDS = 0.25


def regexes(bank: Mapping[str, Any]) -> Iterator[tuple[str, str, list[str]]]:
    """(pointer, value, flags) of a bank's regex patterns."""
    for e, entity, n, name, p, x in banks.each_pattern(bank):
        if x.get("kind") == "regex" and isinstance(x.get("value"), str):
            yield pointer("entities", e, "names", n, "patterns", p, "value"), x["value"], merge_flags(bank.get("default_regex_flags"), entity.get("regex_flags"), x.get("regex_flags"))


def tokens(pattern: str) -> Iterator[tuple[str, int, bool]]:
    """(text, depth of groups, inside a class) of each character or escape of a pattern."""
    depth, inside, i = 0, False, 0
    while i < len(pattern):
        piece = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if piece == "[":
            inside = True
        elif piece == "(" and not inside:
            depth += 1
        yield piece, depth, inside
        if piece == "]":
            inside = False
        elif piece == ")" and not inside:
            depth -= 1
        i += len(piece)


def branches(pattern: str) -> list[list[str]]:
    """The alternatives of each group, and of the whole, that has more than one."""
    stack: list[list[str]] = [[""]]
    out = []
    for piece, _, inside in tokens(pattern):
        if inside or len(piece) > 1:
            stack[-1][-1] += piece
        elif piece == "(":
            stack.append([""])
        elif piece == ")" and len(stack) > 1:
            group = stack.pop()
            out.append(group)
            stack[-1][-1] += "|".join(group) if len(group) == 1 else ""
        elif piece == "|":
            stack[-1].append("")
        else:
            stack[-1][-1] += piece
    out += stack
    return [[re.sub(r"^\?(?::|P?<\w+>)", "", b) for b in g] for g in out if len(g) > 1]


def quantified_twice(pattern: str) -> bool:
    """Whether a group with a quantifier inside has one behind it."""
    pieces = pattern.split(")")
    return any({"*", "+"} & set(before.partition("(")[2]) and behind.lstrip()[:1] in ("*", "+", "{") for before, behind in zip(pieces, pieces[1:]))


def risks(pattern: str) -> list[str]:
    """Static risks of one pattern."""
    whole = list(tokens(pattern))
    plain = [t for t, _, inside in whole if not inside]
    opened = [b for a, b in zip(plain, [*plain[1:], ""]) if a == "("]
    text, groups = pattern.strip(), branches(pattern)
    yes = []
    if quantified_twice(pattern):
        yes.append("nested_quantifier")
    if ".*" in "".join("E" if inside or len(t) > 1 else t for t, _, inside in whole):
        yes.append("unbounded_dot_star")
    if any(a and b != a and b.startswith(a) for g in groups for a in g for b in g):
        yes.append("ambiguous_alternation")
    if plain.count("|") + 1 >= banks.MOST_ALTERNATIVES:
        yes.append("huge_alternation")
    if sum(map(pattern.count, banks.LOOKAROUNDS)) >= banks.MOST_LOOKAROUNDS:
        yes.append("repeated_lookaround")
    if len(opened) - opened.count("?") > banks.MOST_GROUPS:
        yes.append("excessive_groups")
    if len(text) < banks.SHORT and not (r"\b" in text or text[:1] == "^" or text[-1:] == "$"):
        yes.append("short_unbounded")
    if text and not set(pattern) & set(r"\^$.|?*+()[]{}"):
        yes.append("literal_candidate")
    return yes


def probe_inputs(n: int) -> list[str]:
    """Texts that make bad patterns slow: runs, near misses, separators."""
    made = ["", "a", "a" * 24 + "!", "abc abc abc", "1" * 20, " " * 24, "ab" * 16 + "c", "A" * 32 + "!", "x" * 64, "a_b-c.d", "\t" * 12, "Acme Corporation", "a@b" * 8, "0-" * 12, "é" * 16, "(" * 12, "a,b;c|d", "a\nb\nc", "aA1 " * 8, "." * 20, "/" * 20, "=" * 30, "日本" * 8, "ab12" * 10 + "!", "z" * 128]
    return made[:n]


def slow(pattern: str, flags: list[str], level: str, limit: float = PROBE_SECONDS) -> bool:
    """Whether a probe takes longer than the limit."""
    compiled = compile_pattern(pattern, flags)
    for text in probe_inputs(PROBES[level]):
        begun = time.perf_counter()
        try:
            compiled.search(text, timeout=limit)
        except TimeoutError:
            return True
        if time.perf_counter() - begun > limit:
            return True
    return False


def validate(bank: Mapping[str, Any], level: str = "standard", strict: bool = False) -> dict[str, Any]:
    """Schema, compiling and, from `standard` on, risks, empty matches and probes; `strict` makes warnings errors."""
    if level not in LEVELS:
        raise BankError(f"unknown level {level!r}")
    out = banks.validate(dict(bank))
    soft = "error" if strict else "warning"
    if not any(d["severity"] == "error" for d in out):
        form = bank.get("unicode_normalization", "none")
        for path, value, flags in regexes(bank):
            try:
                compile_pattern(value, flags)
            except BankError as error:
                out.append(finding("error", "regex.compile_error", path, str(error)))
                continue
            if form != "none" and unicodedata.normalize(form, value) != value:
                out.append(finding("warning", "regex.normalized_changed", path, f"the pattern changes under {form}"))
            if level == "basic":
                continue
            for risk in risks(value):
                code = {"short_unbounded": "regex.short_unbounded", "literal_candidate": "regex.literal_candidate"}.get(risk, "regex.expensive_static")
                out.append(finding("info" if risk == "literal_candidate" else soft, code, path, risk))
            if banks.matches_empty(value, flags):
                out.append(finding("error", "regex.matches_empty", path, "the pattern matches nothing at some place"))
            if slow(value, flags, level):
                out.append(finding(soft, "regex.expensive_probe", path, "a probe took too long"))
    out.sort(key=lambda d: (d["path"], d["severity"], d["code"], d["message"]))
    return {"valid": not any(d["severity"] == "error" for d in out), "diagnostics": out, "bank_hash": banks.bank_hash(bank) if not any(d["code"].startswith("schema") for d in out) else None}


def test_detector(regex: str, text: str, flags: list[str] | None = None) -> list[dict[str, Any]]:
    """Matches of one detector in one text, with what speaks against it."""
    rows = scans.ordered_alternatives(None, [{"entity": "test", "name": "test", "regex": regex, "flags": flags or []}])
    return scans.scan_text(text, rows)


def doctor(rows: list[dict[str, Any]]) -> list[dict[str, str]]:
    """Findings over detector rows: what does not compile, matches nothing, or is risky."""
    out = []
    for r in rows:
        path = pointer(r["entity"], r["name"])
        try:
            if banks.matches_empty(r["regex"], merge_flags(r.get("flags"))):
                out.append(finding("error", "regex.matches_empty", path, "the pattern matches nothing at some place"))
        except BankError as error:
            out.append(finding("error", "regex.compile_error", path, str(error)))
            continue
        out += [finding("warning", "regex.expensive_static", path, k) for k in risks(r["regex"])]
    return out


# --- generated conformance cases -----------------------------------------------------------------------------------


def conformance_cases(bank: Mapping[str, Any], witnesses: Mapping[tuple[str, str, str], str] | None = None) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """(positives, negatives) of the active patterns: exact, other case, in context, other spacing; glued words must not match.

    A regex needs a witness, given by (entity, name, pattern); one without any is refused.
    """
    positives, negatives = [], []
    kept = banks.filter_status(bank) or {"entities": {}}
    for e, entity, n, name, p, x in banks.each_pattern(kept):
        ids = {"entity_id": e, "name_id": n, "pattern_id": p}
        witness = x["value"] if x["kind"] == "literal" else (witnesses or {}).get((e, n, p))
        if witness is None:
            raise BankError(f"{e}/{n}/{p}: a regex needs a witness")
        flags = merge_flags(bank.get("default_regex_flags"), entity.get("regex_flags"), x.get("regex_flags"))
        texts = [(witness, witness, "exact")]
        if "IGNORECASE" in flags or (x["kind"] == "literal" and not x["case_sensitive"]):
            texts.append((witness.swapcase(), witness.swapcase(), "casing"))
        texts.append((f"Regards, ({witness}).", witness, "context"))
        if x["kind"] == "literal" and x["normalize_whitespace"] and re.search(r"\s", witness):
            spaced = re.sub(r"\s+", " \t ", witness)
            texts.append((spaced, spaced, "whitespace"))
        for text, string, tag in texts:
            start = len(text[: text.index(string)].encode())
            positives.append({"text": text, "tag": tag, "matches": [{"string": string, "start": start, "end": start + len(string.encode()), **ids}]})
        if x["kind"] == "literal" and x["left_boundary"] == x["right_boundary"] == "word":
            negatives.append({"text": f"x{witness}y", "tag": "boundary", **ids})
    return positives, negatives
