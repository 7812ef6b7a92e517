"""Mixed timestamp formats and time zones to one instant in UTC microseconds.

Method: every text is turned into a character-class shape mask (digits keep their width, words become
their lexical class); each distinct mask is mapped to a parser once; the rows of one mask are taken apart by one
compiled expression over an Arrow array and converted together with numpy, local clock times through zone
transition tables read from the tz database, whose version is part of the table. No step goes row by row but the
masks, and those once a distinct text of a batch.

Defined results (`utc_us` is null in all of these)
- null, blank or free text, a date without a time of day, an impossible date or time, 24:00 and second 60;
- a clock time without a zone where the row has no home zone or an unknown one;
- a clock time that its named or home zone skips or has twice.
Slashed dates put the month first, dotted ones the day; two-digit years lie in 1970..2069; missing seconds
are zero; bare numbers count from 1970 in s, ms, us or ns by their size. A numeric offset outranks zone
letters beside it. White space around and between the parts does not matter, however much there is; a text of any
length is read whole.
"""

from __future__ import annotations

import functools
import importlib.metadata
import re
import struct
import unicodedata
import zoneinfo
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Characters of the longest mask that any parser takes, and more: weekday, day, month, year, clock with nine digits of
#: fraction, half of the day, zone and a name in brackets come to 62.
LONGEST_MASK = 80
MONTHS = {w: i % 12 + 1 for i, w in enumerate("jan feb mar apr may jun jul aug sep oct nov dec january february march april may june july august september october november december januar februar märz april mai juni juli august september oktober november dezember".split())} | {"sept": 9, "mär": 3, "mrz": 3, "okt": 10, "dez": 12}
DAYS = set("mon tue tues wed thu thur thurs fri sat sun monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag".split())
#: Minutes east of Greenwich of the zone letters of North America and Britain.
LETTERS = {"utc": 0, "gmt": 0, "ut": 0, "z": 0, "bst": 60, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600}

WORD = re.compile(r"[^\W\d_]+(?:[/_][^\W\d_]+)*")
DATE = {
    "9999-9?9-9?9": ("y", "m", "d"),
    "9?9/9?9/(?:9999|99)": ("m", "d", "y"),
    r"9?9\.9?9\.(?:9999|99)": ("d", "m", "y"),
    r"(?:W,? )?9?9[.]? M,? (?:9999|99)": ("d", "m", "y"),
    r"(?:W,? )?M 9?9,? (?:9999|99)": ("m", "d", "y"),
    "9?9-M-(?:9999|99)": ("d", "m", "y"),
}
CLOCK = r"9?9:99(?::99(?:[.,]9{1,9})?)?(?: ?P)?"
ZONE = r"(?: ?Z| ?[+-]99:?99| ?[+-]99| O| I| \(O\))"


def word_class(match: re.Match) -> str:
    """P day half, M month, W weekday, T and Z themselves, O zone letters, I zone name, A any other word."""
    w = match.group().lower()
    if w in ("am", "pm"):
        return "P"
    if w in MONTHS:
        return "M"
    if w in DAYS:
        return "W"
    if w in ("t", "z"):
        return w.upper()
    if w in LETTERS:
        return "O"
    return "I" if "/" in w else "A"


def mask_of(text: str) -> str:
    """The shape of one normalised text."""
    return re.sub(r"\d", "9", WORD.sub(word_class, text))


#: Where a mask has a word, what no other part of a date is.
WORD_PART = r"[^\d\s/_(),.:+-]+"


@functools.lru_cache(4096)
def parser_of(mask: str) -> str | None:
    """For one mask: the expression that takes its texts apart into named parts; None if it is no instant's."""
    if re.fullmatch(r"-?9{1,19}(?:\.9{1,9})?", mask):
        return r"^(?P<epoch>-?\d+)(?:\.(?P<frac>\d+))?$"
    word, day = WORD_PART, r"\d{1,2}"
    kinds = {"y": r"(?P<y>\d{4}|\d\d)", "m": rf"(?P<m>{day}|{word})", "d": rf"(?P<d>{day})"}
    clock = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<frac>\d{1,9}))?)?" + (r"(?: ?(?P<half>[AaPp][Mm]))?" if "P" in mask else "")  # no word of another class is cut
    zones = (r"(?P<z>[Zz])|" if "Z" in mask else "") + r"(?P<off>[+-]\d\d(?::?\d\d)?)|" + rf"(?P<name>{word}(?:[/_]{word})+)"
    zone = rf"(?: ?(?:{zones}|\(?(?P<letters>{word})\)?)(?: \([^)]*\))?)?"
    for shape, order in DATE.items():
        if re.fullmatch(rf"{shape},?[ T]T?{CLOCK}(?:{ZONE}(?: \((?:O|A)\))?)?", mask) or re.fullmatch(rf"{shape}T{CLOCK}(?:{ZONE})?", mask):
            head = rf"(?:{word}, |{word} )?" if "W" in shape else ""
            return f"^{head}{'[-/., ]+'.join(kinds[k] for k in order)},?[ Tt]{clock}{zone}$"
    if re.fullmatch(rf"(?:W )?M 9?9 {CLOCK}(?: (?:O|[+-]9999|Z|I))? 9999", mask):
        head = rf"{word} " if mask.startswith("W ") else ""
        return rf"^{head}(?P<m>{word}) (?P<d>\d{{1,2}}) {clock}(?: (?:{zones}|(?P<letters>{word})))? (?P<y>\d{{4}})$"
    if re.fullmatch(r"9{8}T9{4}(?:99)?(?:[.,]9{1,9})?(?:Z|[+-]99:?99)?", mask):
        return r"^(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)[Tt](?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?(?:[.,](?P<frac>\d{1,9}))?(?:(?P<z>[Zz])|(?P<off>[+-]\d\d:?\d\d))?$"
    return None


@functools.lru_cache(1024)
def zone_table(zone: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    """(tz version, transition instants in s, offsets in s: one more than instants); None for an unknown name."""
    try:
        rules = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    at, offsets = [], []
    for root in map(Path, zoneinfo.TZPATH):
        if (path := root / zone).is_file():
            at, offsets = _tzif(path.read_bytes())
            break
    utc = lambda s: datetime.fromtimestamp(0, timezone.utc) + timedelta(seconds=int(s))
    offset = lambda s: int(utc(s).astimezone(rules).utcoffset().total_seconds())
    # beyond the table the file has a rule: follow it to 2100 in steps of a week, each change found by bisection
    start, end, step = (at[-1] + 1 if at else -2_208_988_800), 4_102_444_800, 7 * 86400
    if not at:
        offsets = [offset(start)]
    low, known = start, offsets[-1]
    while low < end:
        high = min(low + step, end)
        if (new := offset(high)) != known:
            a, b = low, high
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset(mid) == known else (a, mid)
            at.append(b)
            offsets.append(new)
            known = new
        low = high
    return tz_version(), np.array(at, np.int64), np.array(offsets, np.int64)


@functools.lru_cache(1)
def tz_version() -> str:
    for root in map(Path, zoneinfo.TZPATH):
        for name in ("tzdata.zi", "+VERSION"):
            if (path := root / name).is_file():
                return path.open().readline().strip("# \n").removeprefix("version ")
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "unknown"


def _tzif(data: bytes) -> tuple[list[int], list[int]]:
    """Transitions of a version 2+ TZif file (RFC 8536); the first offset holds before all of them."""
    if data[:4] != b"TZif" or data[4:5] < b"2":
        return [], []
    isut, isstd, leap, times, types, chars = struct.unpack(">6l", data[20:44])
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut
    isut, isstd, leap, times, types, chars = struct.unpack(">6l", data[at + 20 : at + 44])
    at += 44
    instants = list(struct.unpack(f">{times}q", data[at : at + 8 * times]))
    index = data[at + 8 * times : at + 9 * times]
    at += 9 * times
    offset = [struct.unpack(">lbb", data[at + 6 * i : at + 6 * i + 6])[0] for i in range(types)]
    return (instants, [offset[0], *(offset[i] for i in index)]) if instants else ([], [])


def local_to_utc(local_s: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    """(UTC seconds, valid): not valid where the zone is unknown, skips the clock time or has it twice."""
    found = zone_table(zone)
    if found is None:
        return local_s, np.zeros(len(local_s), bool)
    _, at, offsets = found
    offset = lambda s: offsets[np.searchsorted(at, s, "right")]
    before, after = local_s - offset(local_s - 86400), local_s - offset(local_s + 86400)
    fits_before, fits_after = offset(before) == local_s - before, offset(after) == local_s - after
    twice = fits_before & fits_after & (before != after)
    return np.where(fits_before, before, after), (fits_before | fits_after) & ~twice


def plain_digits(text: str) -> str:
    """Decimal digits of any script as ASCII."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def normalise(dates: pd.Series, homes: pd.Series) -> pd.Series:
    """UTC microseconds (nullable Int64) of date texts on the clocks of their home zones."""
    out, good = np.zeros(len(dates), np.int64), np.zeros(len(dates), bool)
    codes, texts = pd.factorize(dates)  # each distinct text is looked at once; nulls are -1
    clean = pd.Series(texts, dtype=object).str.strip().str.replace(r"\s+", " ", regex=True).map(plain_digits)
    masks = clean.map(mask_of)
    masks = masks.where(masks.str.len() <= LONGEST_MASK, "")  # a longer one is no date's
    kinds, distinct = pd.factorize(masks)
    kind = np.where(codes >= 0, kinds[codes] if len(kinds) else -1, -1)
    clean, homes = clean.to_numpy(object), homes.to_numpy(object)
    # masks that differ in the width of their numbers share an expression
    parsers, expressions = pd.factorize(np.array([parser_of(m) or "" for m in distinct], object))
    which = np.where(kind >= 0, parsers[kind] if len(parsers) else -1, -1)
    for k, parser in enumerate(expressions):
        at = np.flatnonzero(which == k)
        if parser and len(at):
            out[at], good[at] = _convert(parser, clean[codes[at]], homes[at])
    return pd.Series(pd.arrays.IntegerArray(out, ~good), index=dates.index)


def _convert(parser: str, texts: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTC microseconds, valid) of the texts of one mask."""
    n = len(texts)
    parts = pc.extract_regex(pa.array(texts, pa.string()), pattern=parser)
    ok = parts.is_valid().to_numpy(zero_copy_only=False)
    names = {f.name for f in parts.type}
    empty = pa.nulls(n, pa.string())

    def part(r: str) -> pa.Array:
        """One part; null where the text has none."""
        c = pc.struct_field(parts, r) if r in names else empty
        return pc.if_else(pc.fill_null(pc.equal(c, ""), True), None, c)

    integer = lambda c: pc.fill_null(pc.cast(c, pa.int64()), 0).to_numpy(zero_copy_only=False)
    given = lambda c: c.is_valid().to_numpy(zero_copy_only=False)
    micros = integer(pc.utf8_slice_codeunits(pc.utf8_rpad(part("frac"), 6, "0"), 0, 6))
    if "epoch" in names:
        text = part("epoch")
        small = pc.fill_null(pc.less_equal(pc.utf8_length(text), 18), False)  # of 19 digits int64 holds only some: those are nanoseconds
        v = integer(pc.if_else(small, text, None))
        long = pc.if_else(small, None, text)
        if long.null_count < n:
            big = np.array([int(x) if x is not None else 0 for x in long.to_pylist()], object)
            fits = np.array([abs(x) < 1 << 63 for x in big], bool)
            v, ok = np.where(fits & (big != 0), np.where(fits, big, 0).astype(np.int64), v), ok & fits
        size = np.abs(v)
        us = np.select([size < 10**11, size < 10**14, size < 10**17], [np.where(size < 10**11, v, 0) * 10**6 + micros, np.where(size < 10**14, v, 0) * 1000, v], v // 1000)
        return us, ok
    years = part("y")
    y = integer(years)
    y = np.where(pc.fill_null(pc.equal(pc.utf8_length(years), 2), False).to_numpy(zero_copy_only=False), np.where(y >= 70, 1900 + y, 2000 + y), y)
    months = part("m")
    written = pc.fill_null(pc.utf8_is_digit(months), False)
    m = np.where(written.to_numpy(zero_copy_only=False), integer(pc.if_else(written, months, None)), looked_up(pc.utf8_lower(months), MONTHS, 0))
    d, h, mi, s = (integer(part(r)) for r in ("d", "h", "mi", "s"))
    half = pc.fill_null(pc.utf8_lower(part("half")), "")
    am, pm = (pc.equal(half, x).to_numpy(zero_copy_only=False) for x in ("am", "pm"))
    ok &= ~(am | pm) | ((h >= 1) & (h <= 12))
    h = np.where(am, h % 12, np.where(pm, h % 12 + 12, h))
    ok &= (m >= 1) & (m <= 12) & (d >= 1) & (h < 24) & (mi < 60) & (s < 60) & (y >= 1) & (y <= 9999)
    month = np.where(ok, (y - 1970) * 12 + m - 1, 0).astype("datetime64[M]")
    first = month.astype("datetime64[D]").astype(np.int64)
    ok &= d <= (month + 1).astype("datetime64[D]").astype(np.int64) - first
    utc = local = (first + d - 1) * 86400 + h * 3600 + mi * 60 + s
    # an offset outranks a name, a name outranks letters
    z, off, name, letters = (part(r) for r in ("z", "off", "name", "letters"))
    done = given(z)
    by_offset = given(off) & ~done
    digits = pc.utf8_rpad(pc.replace_substring(pc.utf8_slice_codeunits(off, 1), ":", ""), 4, "0")
    hours, minutes = integer(pc.utf8_slice_codeunits(digits, 0, 2)), integer(pc.utf8_slice_codeunits(digits, 2, 4))
    east = np.where(pc.fill_null(pc.starts_with(off, "+"), False).to_numpy(zero_copy_only=False), 1, -1) * (hours * 60 + minutes)
    ok &= ~by_offset | ((minutes < 60) & (hours * 60 + minutes <= 18 * 60))
    by_name = given(name) & ~done & ~by_offset
    by_letters = given(letters) & ~done & ~by_offset & ~by_name
    lettered = looked_up(pc.utf8_lower(letters), LETTERS, UNKNOWN)
    ok &= ~by_letters | (lettered != UNKNOWN)
    utc = utc - np.where(by_offset, east, np.where(by_letters & ok, lettered, 0)) * 60
    todo = np.flatnonzero(ok & ~done & ~by_offset & ~by_letters)
    zone = np.where(by_name, name.to_numpy(zero_copy_only=False), homes)[todo]
    codes, zones = pd.factorize(zone)  # no zone is -1
    ok[todo[codes < 0]] = False
    for k, own in enumerate(zones):
        at = todo[codes == k]
        if isinstance(own, str):
            utc[at], ok[at] = local_to_utc(local[at], own.strip())
        else:
            ok[at] = False
    return utc * 10**6 + micros, ok


UNKNOWN = 1 << 20


def looked_up(words: pa.Array, values: dict[str, int], other: int) -> np.ndarray:
    """The number of each word; `other` for one without and for null."""
    place = pc.index_in(words, value_set=pa.array(list(values), pa.string()))
    numbers = pa.array(list(values.values()), pa.int64())
    return pc.fill_null(pc.take(numbers, place), other).to_numpy(zero_copy_only=False)


def to_utc(df: DataFrame, key: str, date: str, home_zone: str) -> DataFrame:
    """key, utc_us: the instants of `date`, read on the clock of `home_zone` where no zone is written."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame({"k": b["k"], "utc_us": normalise(b["d"], b["z"])})

    kind = df.select(F.col(key).alias("k")).schema[0].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(f"`{date}`").cast("string").alias("d"), F.col(home_zone).alias("z"))
    return rows.mapInPandas(batches, f"k {kind}, utc_us long").select(F.col("k").alias(key), "utc_us")
