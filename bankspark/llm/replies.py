"""Quoted history, signatures and notices in mail bodies: the lines that the sender newly wrote.

Method: explicit marks (quote signs, headings of earlier messages, signature blocks) are taken off by layout.
The lines left over are winnowed into fingerprints, and an inverted index over the whole corpus finds, without
thread identifiers, which of them other senders' messages hold too: fingerprints shared with one earlier message
make it an ancestor, and the lines that it has word by word are a verified span of history. A line that many
senders share is a recurring closing (a notice or device line): how often it recurs decides, not its words; only
for lines of fewer than four words, where greetings recur too, its words are asked as well. A separator goes with
the closing, signature or history that it opens or closes.

Scale: bodies are read once; only line hashes and fingerprints (8 bytes, row and sender) are shuffled. Recurring
closings are counted exactly over distinct (line, sender) pairs, then taken out before any fingerprint is looked
up, so no group holds more than `RECURRING_SHARE` of the senders; spans are verified by an equi join on ancestor
and line, which spreads an ancestor that many messages quote over its lines. What is broadcast is counted first.

Defined results: a null, empty or blank body has no lines; lines end at a line feed, a carriage return before
it belongs to the ending; a row without a sender or message id counts as of a sender or message of its own, but
not among the senders that share a closing; a message all of whose lines an ancestor has keeps them (it is a
copy); line numbers count all lines from 1; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from bankspark.runtime import broadcast_if_small, cut, spread

QUOTED = re.compile(r"\s*(?:>|\|(?:\s|$)|[A-Z]{1,3}>)")
SEPARATOR = re.compile(r"\s*(?:-{2,}|={3,}|_{3,}|\*(?:\s?\*)+|~{3,}|#{3,}|\+{3,})\s*$")
#: Headings after which all is an earlier message.
HISTORY = re.compile(
    r"\s*(?:-{2,}\s*(?:original message|ursprüngliche nachricht|message d.origine|mensaje original|forwarded message|weitergeleitete nachricht)\b.*|begin forwarded message\s*:?\s*|-{2,}\s*forwarded by\b.*|-{2,}\s*message from\b.*|_{3,}\s*original message.*)$",
    re.I,
)
FIELD = re.compile(r"\s*(?:from|sent|date|to|cc|subject|von|gesendet|datum|an|betreff|de|envoyé|à|objet|asunto|para|fecha)\s*:(?:\s|$)", re.I)
FROM_FIELD = re.compile(r"\s*(?:from|von|de)\s*:\s", re.I)
SENT_FIELD = re.compile(r"\s*(?:sent|date|gesendet|datum|envoyé|fecha)\s*:\s", re.I)
TO_FIELD = re.compile(r"\s+to\s*:", re.I)
ATTRIBUTION = re.compile(
    r"\s*(?:-{2,}\s*)?(?:.{0,200}\b(?:wrote|said|writes)(?: on .{4,60})?\s*:|(?:am|on|le|el)\b.{4,200}\b(?:schrieb|wrote|a .{0,4}crit|escribi.{1,4})\b.{0,200}:)\s*(?:-{2,})?\s*$", re.I
)
ATTRIBUTION_LEAD = re.compile(r"\s*(?:on|am|le|el)\b.{0,60}\d.{0,40}$", re.I)
PHONE = r"[+(]?\d[\d\s().-]{5,}\d(?:\s*(?:ext\.?|x)\s*\d+)?"
CONTACT = re.compile(
    rf"(?:(?:t|tel|telephone|phone|ph|mobile|mob|cell|fax|f|m|direct)\b[.:]?\s*{PHONE}|{PHONE}|(?:(?:e|e-?mail|mail)\s*[:.]\s*)?<?[\w.+'-]+@[\w.-]+>?|(?:p\.?\s?o\.?\s+box\s+\d+|\d+(?:[-/]\d+)?\s?[a-z]?\s+(?:[nsew]\.\s+)?(?:\w[\w.'’-]*\s+){{0,3}}(?:street|st|road|rd|lane|ln|avenue|ave|boulevard|blvd|court|ct|place|pl|drive|dr|way|square|sq|close|terrace)\b\.?|\d+,?\s+rue\s+.{{2,40}}|.{{2,40}}(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee)\s+\d+\s?[a-z]?).{{0,40}}|(?:www\.|https?://)\S+)\s*$",
    re.I,
)
TITLE_WORDS = r"(?:lead|agent|handler|reviewer|scheduler|supervisor|assistant|manager|engineer|clerk|support|director|officer|analyst|president|counsel|coordinator|specialist|trader|accountant|head|chief|secretary|operator|consultant|controller|planner|administrator|technician|associate|representative|attorney|buyer|dispatcher|advisor)"
TITLE = re.compile(rf"(?:[A-Z][\w'’&.-]*\s+){{0,4}}{TITLE_WORDS}\b(?:\s+(?:of|for|on)\b[\w\s]{{1,30}})?(?:\s*[,|/–-]\s*.{{1,80}})?$", re.I)
NAME = re.compile(r"(?:[^\W\d_a-z][\w'’.&-]*[,]?)(?:\s+(?:[^\W\d_a-z][\w'’.&-]*|&|of|de|van|von|and)){1,4}$")
#: A short line that may be one of a device.
DEVICE = re.compile(r"\bsent (?:from|on|via)\b|\bgesendet\b|\benvoyé d|\benviado desde\b|\binviato da\b", re.I)


def own_lines(lines: list[str]) -> list[int]:
    """Indexes of the non-blank lines that by their marks are neither history nor signature."""
    n = len(lines)
    bare = [x.strip() for x in lines]
    state = ["blank" if not x else "quoted" if QUOTED.match(x) else "own" for x in bare]
    end = n
    for i, x in enumerate(bare):
        if state[i] != "own":
            continue
        if HISTORY.match(x):
            end = i
            break
        if FROM_FIELD.match(x) and i + 1 < n and SENT_FIELD.match(bare[i + 1] or " ") and any(FIELD.match(b) for b in bare[i + 2 : i + 4]):
            end = i
            break
        if lines[i][:1].isspace() and TO_FIELD.match(lines[i]) and i + 2 < n and FIELD.match(bare[i + 1] or " ") and FIELD.match(bare[i + 2] or " "):
            end = max(0, i - 2)
            break
    while end and end < n and (not bare[end - 1] or (SEPARATOR.match(bare[end - 1]) and FROM_FIELD.match(bare[end]))):
        end -= 1
    for i in range(end, n):
        state[i] = "history"
    for i in range(end):
        if state[i] == "own" and bare[i].endswith((":",)) and ATTRIBUTION.match(bare[i]):
            following = next((state[j] for j in range(i + 1, n) if state[j] != "blank"), None)
            if following in ("quoted", "history", None):
                state[i] = "heading"
                if i and state[i - 1] == "own" and ATTRIBUTION_LEAD.match(bare[i - 1]):
                    state[i - 1] = "heading"
        elif state[i] == "own" and bare[i].startswith("---") and ATTRIBUTION.match(bare[i]):
            state[i] = "heading"
    _signatures(bare, state, end)
    _separators(bare, state, end)
    return [i for i in range(n) if state[i] == "own"]


def _parts(line: str) -> list[str]:
    return [p.strip() for p in re.split(r"\s+[/|]\s+", line) if p.strip()]


def signature_start(bare: list[str], i: int, end: int) -> bool:
    """Whether line i opens a block of a full name or organisation with title or contact data."""
    x = bare[i]
    if len(x) > 200:
        return False
    parts = _parts(x)
    if len(parts) > 1:
        return bool(NAME.match(parts[0])) and any(TITLE.match(p) or CONTACT.match(p) for p in parts[1:])
    if not NAME.match(x) or x.endswith((",", ":", "!", "?")):
        return False
    following = bare[i + 1] if i + 1 < end else ""
    return bool(following) and len(following) <= 120 and any(TITLE.match(p) or CONTACT.match(p) for p in _parts(following)[:2])


def _signatures(bare: list[str], state: list[str], end: int) -> None:
    i = 0
    while i < end:
        if state[i] != "own":
            i += 1
            continue
        opened = SEPARATOR.match(bare[i]) is not None
        first = i + 1 if opened else i
        if first < end and state[first] == "own" and (signature_start(bare, first, end) or (opened and NAME.match(bare[first]) and len(bare[first]) < 60)):
            if opened:
                state[i] = "signature"
            j = first
            while j < end and state[j] == "own" and (j == first or CONTACT.match(bare[j]) or any(TITLE.match(p) or CONTACT.match(p) for p in _parts(bare[j]))):
                state[j] = "signature"
                j += 1
            i = j
            continue
        i += 1


def _separators(bare: list[str], state: list[str], end: int) -> None:
    """A separator goes with the signature or history that it opens."""
    for i in range(end):
        if state[i] == "own" and SEPARATOR.match(bare[i]):
            after = next((state[j] for j in range(i + 1, len(state)) if state[j] != "blank"), None)
            if after in ("signature", "history", "heading", "quoted", None):
                state[i] = "signature"


#: Words of a shingle; shingles of a winnowing window; words of a verified span of two full lines or more, and of one,
#: which two people may write by chance.
SHINGLE, WINDOW, SPAN_WORDS, LINE_WORDS = 5, 4, 8, 24
#: Share of the senders, and least number of them, that a recurring closing has; words of one that needs no more evidence.
RECURRING_SHARE, RECURRING_LEAST, CLOSING_WORDS = 0.02, 8, 4
WORD = re.compile(r"[a-z0-9]+")


def line_words(line: str) -> list[str]:
    """ASCII words of a line: what a wrong decoding leaves alone."""
    return WORD.findall(line.lower())


def winnow(words: list[str]) -> set[int]:
    """Fingerprints of one line: the least shingle hash of every window, as signed 64-bit numbers."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return set()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE])) - (1 << 63) for i in range(n)]
    return {min(h[i : i + WINDOW]) for i in range(max(1, n - WINDOW + 1))}


LINES = pa.list_(pa.struct([("n", pa.int32()), ("h", pa.int64()), ("w", pa.int32()), ("closing", pa.bool_()), ("prints", pa.list_(pa.int64()))]))
SEPARATORS = pa.list_(pa.struct([("n", pa.int32()), ("above", pa.int64()), ("below", pa.int64()), ("below_n", pa.int32())]))


def line_hash(line: str, words: list[str]) -> int:
    """A line by its words, or as it is without any."""
    return xxhash.xxh64_intdigest(" ".join(words) if words else line.strip()) - (1 << 63)


def _layout(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        kept, between = [], []
        for body in b.column(4).to_pylist():
            text = body.split("\n")
            lines, separators = [], []
            for i in own_lines(text):
                words = line_words(text[i])
                if not words and SEPARATOR.match(text[i].strip()):
                    separators.append(i)
                lines.append({"n": i + 1, "h": line_hash(text[i], words), "w": len(text[i].split()) if words else 0, "closing": len(words) >= CLOSING_WORDS or DEVICE.search(text[i]) is not None, "prints": list(winnow(words))})
            kept.append(lines)
            wordy = [x for x in lines if x["w"]]
            between.append([{"n": i + 1, "above": next((x["h"] for x in reversed(wordy) if x["n"] <= i), None), "below": (after := next((x for x in wordy if x["n"] > i), {})).get("h"), "below_n": after.get("n")} for i in separators])
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(kept, LINES), pa.array(between, SEPARATORS)], ["k", "s", "m", "t", "lines", "separators"])


def new_lines(df: DataFrame, key: str, body: str, sender: Column, message: Column, when: Column) -> DataFrame:
    """key, line_no: the lines that the sender newly wrote. `when` orders messages; nulls come last."""
    kind = df.schema[key].dataType.simpleString()
    last = F.lit("9999-12-31").cast("timestamp")
    alone = F.xxhash64(F.lit("row"), F.col(key))  # a row without a sender or message id is one of its own
    mail = df.where(F.col(body).isNotNull()).select(F.col(key).alias("k"), F.coalesce(F.when(sender.isNotNull(), F.xxhash64(sender)), alone).alias("s"), F.coalesce(F.when(F.trim(message) != "", F.xxhash64(message)), alone).alias("m"), F.unix_micros(F.coalesce(when.cast("timestamp"), last)).alias("t"), F.col(body).cast("string").alias("b"))
    layout = cut(spread(mail).mapInArrow(_layout, f"k {kind}, s long, m long, t long, lines array<struct<n:int,h:long,w:int,closing:boolean,prints:array<long>>>, separators array<struct<n:int,above:long,below:long,below_n:int>>"))
    lines = layout.select("k", "s", "m", "t", F.size("lines").alias("total"), F.posexplode("lines").alias("o", "x")).select("k", "s", "m", "t", "total", "o", "x.*")

    # closings: lines that many senders share, counted over distinct pairs of line and sender; of each sender's lines at
    # most 1 / RECURRING_SHARE times as many are closings, however many senders there are
    named = F.col("s") != F.xxhash64(F.lit("row"), F.col("k"))  # rows without a sender may all be of one
    least = max(RECURRING_LEAST, math.ceil(layout.where(named).select("s").distinct().count() * RECURRING_SHARE))
    shares = lines.where("closing").select("h", "s", F.when(named, F.col("s")).alias("sender")).distinct().groupBy("h").agg(F.count("sender").alias("senders"), F.count("s").alias("all")).where("all > 1")
    shares = cut(shares.select("h", (F.col("senders") >= least).alias("often")))
    often = broadcast_if_small(shares.where("often").select("h"))
    own = lines.join(often.withColumn("closing", F.lit(True)), ["h", "closing"], "left_anti")

    # ancestors: of each fingerprint that several senders have the first earlier message of another sender and message id;
    # a line that nobody else wrote cannot be verified, so its fingerprints are not looked up.
    # c1 is the first of all, c2 and d2 the first of another sender or id than c1, c3 and d3 where these have the row's own
    several = broadcast_if_small(shares.where("not often").select("h"))
    prints = lines.join(several, "h", "left_semi").select("k", "s", "m", "t", F.explode("prints").alias("f")).distinct()
    prints = cut(prints)
    row = F.struct("t", "k", "s", "m")
    shared = prints.join(prints.groupBy("f").agg(F.min(row).alias("c1")), "f")
    second = shared.groupBy("f").agg(F.min(F.when(F.expr("s <> c1.s"), row)).alias("c2"), F.min(F.when(F.expr("m <> c1.m"), row)).alias("d2"))
    shared = shared.join(second, "f")
    third = shared.groupBy("f").agg(F.min(F.when(F.expr("s <> c1.s and m <> c2.m"), row)).alias("c3"), F.min(F.when(F.expr("m <> c1.m and s <> d2.s"), row)).alias("d3"))
    other = [F.when((F.col("s") != F.col(f"{c}.s")) & (F.col("m") != F.col(f"{c}.m")), F.col(c)) for c in ("c1", "c2", "c3", "d2", "d3")]
    shared = shared.join(third, "f").select("k", "t", F.least(*other).alias("a")).where("a.t < t or (a.t = t and a.k < k)")
    pairs = cut(shared.select("k", F.col("a.k").alias("ancestor")).distinct())  # a line of 5 to 8 words has one fingerprint

    # verified spans: the lines that the ancestor has too, word by word and equally far apart, and not all of the message
    asked = own.select("k", "o", "n", "h", "w", "total").join(broadcast_if_small(pairs), "k")
    held = own.where("w > 0").join(broadcast_if_small(pairs.select("ancestor").distinct()).withColumnRenamed("ancestor", "k"), "k", "left_semi")
    held = held.groupBy(F.col("k").alias("ancestor"), "h", F.col("w").alias("aw")).agg(F.min("o").alias("ao"))
    spans = asked.join(held, ["ancestor", "h"]).where("w = aw").groupBy("k", "ancestor", F.expr("o - ao")).agg(F.sum("w").alias("words"), F.count_if(F.col("w") >= CLOSING_WORDS).alias("full"), F.collect_list("n").alias("ns"), F.max("total").alias("total"))
    long_enough = F.col("words") >= F.when(F.col("full") > 1, SPAN_WORDS).otherwise(LINE_WORDS)
    history = cut(spans.where(long_enough & (F.size("ns") < F.col("total"))).select("k", F.explode("ns").alias("n")).distinct())

    # separators that open history, or open or close a closing
    separators = layout.where(F.size("separators") > 0).select("k", F.explode("separators").alias("x")).select("k", "x.*")
    beside = separators.select("k", "n", F.explode(F.array("above", "below")).alias("h")).join(often, "h", "left_semi").select("k", "n")
    opens = separators.join(history.select("k", F.col("n").alias("below_n")), ["k", "below_n"]).select("k", "n")
    dropped = history.union(beside).union(opens).distinct()
    return own.select("k", "n").join(dropped, ["k", "n"], "left_anti").select(F.col("k").alias(key), F.col("n").cast("long").alias("line_no"))
