"""Lowering of bank patterns to the dialect of the worker's regex engine.

The accept set is that of a linear-time engine: lookaround, backreferences, atomic groups and possessive
quantifiers are rejected. Word, space, digit and boundary escapes are spelled out as Unicode classes (or
ASCII ones under ASCII), so that combining marks, joiners and connector punctuation are word characters and
superscripts and control separators are not.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping

import regex as rx

from bankspark.model import FLAGS, BankError

WORD, SPACE, DIGIT = r"\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍", r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　", r"\p{Nd}"
ASCII_WORD, ASCII_SPACE, ASCII_DIGIT = "A-Za-z0-9_", r" \t\n\r\f\x0b", "0-9"


def merge_flags(*sets: list[str] | None) -> list[str]:
    """Union in the fixed order; names may be written `re.X` and in any case."""
    out = []
    for flag in (f for s in sets for f in s or ()):
        name = flag.strip().removeprefix("re.").upper()
        if name not in FLAGS:
            raise BankError(f"unknown regex flag {flag!r}")
        out.append(name)
    return [f for f in FLAGS if f in out]


def literal_pattern(value: str, normalise: bool, left: str, right: str, verbose: bool = False) -> str:
    """A literal as a pattern: whitespace runs as one \\s+ when normalised, boundaries where asked for."""
    escape = lambda s: "".join(f"\\x{{{ord(c):X}}}" if verbose and (c.isspace() or c == "#") else re.escape(c) if c in r"\.+*?()|[]{}^$#&-~" else c for c in s)
    body = "".join(r"\s+" if part.isspace() else escape(part) for part in re.split(r"(\s+)", value) if part) if normalise else escape(value)
    for side in (left, right):
        if side not in ("none", "word"):
            raise BankError(f"unknown boundary {side!r}")
    a, b = (r"\b" if s == "word" else "" for s in (left, right))
    return f"{a}(?:{body}){b}" if a or b else body


def word_bounded(pattern: str) -> str:
    return rf"\b(?:{pattern})\b"


def lower(pattern: str, ascii_only: bool = False) -> str:
    """The pattern with its shorthand classes and boundaries spelled out; BankError for what is not accepted."""
    word, space, digit = (ASCII_WORD, ASCII_SPACE, ASCII_DIGIT) if ascii_only else (WORD, SPACE, DIGIT)
    classes = {"w": word, "s": space, "d": digit}
    boundary = f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"
    inside = f"(?:(?<=[{word}])(?=[{word}])|(?<![{word}])(?![{word}]))"
    out, i, in_class, n = [], 0, False, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            e = pattern[i + 1]
            i += 2
            if e in classes:
                out.append(classes[e] if in_class else f"[{classes[e]}]")
            elif e.lower() in classes:
                if in_class:
                    raise BankError(f"\\{e} inside a class is not supported")
                out.append(f"[^{classes[e.lower()]}]")
            elif e == "b" and not in_class:
                out.append(boundary)
            elif e == "B" and not in_class:
                out.append(inside)
            elif e in "123456789" or (e in "gk" and pattern[i : i + 1] in ("<", "{")):
                raise BankError("backreferences are not supported")
            elif e == "x" and pattern[i : i + 1] == "{":
                end = pattern.index("}", i)
                out.append(f"\\U{int(pattern[i + 1 : end], 16):08x}")
                i = end + 1
            elif e == "z":
                out.append(r"\Z")
            else:
                out.append("\\" + e)
            continue
        if in_class:
            in_class = c != "]" or pattern[i - 1] == "[" or pattern[i - 2 : i] == "[^"
        elif c == "[":
            in_class = True
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            head = pattern[i + 2 : i + 4]
            if head[:1] in ("=", "!", ">", "(", "|", "#", "R", "&") or head in ("<=", "<!", "P=", "P>"):
                raise BankError("lookaround, atomic groups and backreferences are not supported")
            if head[:1] == "<":
                out.append("(?P")
                i += 2
                continue
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise BankError("possessive quantifiers are not supported")
        out.append(c)
        i += 1
    return "".join(out)


@functools.lru_cache(20_000)
def _compiled(pattern: str, flags: tuple[str, ...]) -> rx.Pattern:
    bits = rx.V0 | sum(getattr(rx, f) for f in flags if f != "ASCII")
    try:
        return rx.compile(lower(pattern, "ASCII" in flags), bits)
    except (rx.error, ValueError, IndexError) as error:
        raise BankError(f"the pattern does not compile: {error}") from error


def compile_pattern(pattern: str, flags: list[str] | tuple[str, ...] | None = None) -> rx.Pattern:
    return _compiled(pattern, tuple(flags or ()))


def fragment(detector: Mapping) -> str | None:
    """Text that every match holds, in lower case; None where none is certain."""
    if detector["pattern_kind"] == "literal":
        words = [w for w in re.split(r"\s+", detector["value"]) if w]
        return fold(max(words, key=len)) if words else None
    if "VERBOSE" in detector["flags"]:
        return None
    head = re.match(r"(?:\\b)?((?:[A-Za-z0-9_ ,:;/@-]|\\[-./])+)", detector["regex"])
    if head is None or "|" in detector["regex"]:
        return None
    text, rest = head.group(1), detector["regex"][head.end() :]
    text = re.sub(r"\\(.)", r"\1", text[:-1] if rest[:1] in ("*", "?", "+", "{") else text)
    return fold(text) if len(text) >= 2 else None


def fold(text: str) -> str:
    """Lower case with the two letters that fold to ASCII; of the text's length in all that matters to a search."""
    return text.lower().replace("ſ", "s").replace("K", "k")
