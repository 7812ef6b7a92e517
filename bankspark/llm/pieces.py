"""Splitting of oversized texts at natural boundaries, sizes in tokens of a public tokenizer.

Method: recursive bisection. A span of more than limit - overlap tokens is cut at the strongest boundary
near its midpoint (paragraph, line, sentence, clause, word, then any character), the halves go on in the
same way, and then each piece after the first is led by up to `overlap` tokens of the text before it,
from the first natural boundary in that reach. A text is encoded once: the size of a piece by itself is told from the
tokens inside it, and only what its ends may change, white space at the end or a cut pre-token, is encoded again.

Defined results: a null, empty or short text (at most `limit` tokens) is one piece as it is (empty text for
null); no piece has more than `limit` tokens when encoded by itself (one that would is cut again); the pieces without their overlaps give
the text back; repeated rows give repeated results.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bankspark.llm.bpe import Transducer, default_path, transducer
from bankspark.runtime import spread

LIMIT, OVERLAP = 512, 64
SCHEMA = pa.schema([("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_char", pa.int64()), ("own_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.int32()), ("piece", pa.string())])


def strength(text: str, at: int) -> int:
    """How natural a cut between two pre-tokens is: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 word, 0 none."""
    tail, head = text[at - 1], text[at]
    if head == " " and tail.isalnum():
        return 1
    if tail.isspace() and not head.isspace():
        lines, i = 0, at
        while i and text[i - 1].isspace():
            i -= 1
            lines += text[i] == "\n"
        return 5 if lines > 1 else 4 if lines else 1
    if head.isspace():
        if head in "\r\n" or tail.isspace():
            return 0  # a line end and a run of spaces stay whole
        if tail in ".!?…。！？":
            return 3
        return 2 if tail in ",;:—–" else 1
    return 3 if tail in "。！？" else 0


def boundaries(text: str, words: list[str], encoded: list[tuple[int, ...]], own: Transducer, inner: int) -> tuple[list[int], list[int], list[int]]:
    """(characters, tokens, strength) of each place where the text may be cut, ends included.

    A pre-token of more than `inner` tokens may be cut inside (-1), where a token ends with a character."""
    chars, tokens = [0, *accumulate(map(len, words))], [0, *accumulate(map(len, encoded))]
    marks = [6, *(strength(text, c) for c in chars[1:-1]), 6]
    long = [i for i, ids in enumerate(encoded) if len(ids) > inner and len(words[i]) > 1]
    for i in reversed(long):
        places, seen, raw = [], 0, b""
        for k, x in enumerate(encoded[i][:-1]):
            raw += own.bytes_of[x]
            try:
                seen += len(raw.decode())
            except UnicodeDecodeError:
                continue
            raw = b""
            places.append((chars[i] + seen, tokens[i] + k + 1))
        chars[i + 1 : i + 1], tokens[i + 1 : i + 1], marks[i + 1 : i + 1] = [p[0] for p in places], [p[1] for p in places], [-1] * len(places)
    return chars, tokens, marks


def bisect(tokens: list[int], marks: list[int], limit: int) -> list[int]:
    """Indexes of the boundaries where pieces begin and end."""
    cuts, todo = {0, len(tokens) - 1}, [(0, len(tokens) - 1)]
    while todo:
        a, b = todo.pop()
        size = tokens[b] - tokens[a]
        if size <= limit or b - a < 2:
            continue
        mid, reach = (tokens[a] + tokens[b]) / 2, size / 4
        near = range(max(a + 1, bisect_left(tokens, mid - reach, a, b)), min(b, bisect_right(tokens, mid + reach, a, b))) or range(a + 1, b)
        strongest = max(marks[near.start : near.stop])
        cut = min((i for i in near if marks[i] == strongest), key=lambda i: abs(tokens[i] - mid))
        cuts.add(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(cuts)


class Sizes:
    """Tokens of parts of a text when each is encoded by itself."""

    def __init__(self, text: str, own: Transducer, chars: list[int], tokens: list[int], marks: list[int]):
        self.text, self.own, self.chars, self.tokens, self.marks = text, own, chars, tokens, marks

    def alone(self, a: int, b: int) -> int:
        """Of the part between boundaries a and b.

        Pre-tokens are cut from left to right and look ahead only behind white space, so from a whole pre-token on they
        are those of the text up to the last one that ends without white space.
        """
        last = b if self.marks[a] >= 0 else a
        while last > a and (self.marks[last] < 0 or self.text[self.chars[last] - 1].isspace()):
            last -= 1
        tail = len(self.own.encode(self.text[self.chars[last] : self.chars[b]])) if last < b else 0
        return self.tokens[last] - self.tokens[a] + tail


def pieces_of(text: str, own: Transducer, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """(start with overlap, own start, end, tokens, text) of each piece, in characters."""
    words = own.split(text)
    encoded = list(map(own.word, words))
    whole = sum(map(len, encoded))
    if whole <= limit:
        return [(0, 0, len(text), whole, text)]
    chars, tokens, marks = boundaries(text, words, encoded, own, max(1, min(overlap, limit - overlap) // 4))
    sizes, out, before = Sizes(text, own, chars, tokens, marks), [], None
    cuts = bisect(tokens, marks, limit - overlap)
    todo = list(zip(cuts, cuts[1:]))[::-1]
    while todo:
        a, b = todo.pop()
        if b - a > 1 and sizes.alone(a, b) > limit:  # by itself it is encoded into more tokens than inside its text
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
            continue
        reach = range(bisect_left(tokens, tokens[a] - overlap, before, a), a) if before is not None else range(0)
        lead = [i for i in reach if marks[i] >= 1] or reach
        start, n = next((i, n) for i in [*lead, a] if (n := sizes.alone(i, b)) <= limit or i == a)
        out.append((chars[start], chars[a], chars[b], n, text[chars[start] : chars[b]]))
        before = a
    return out


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None) -> DataFrame:
    """key, piece_no, n_pieces, start_char, own_char, end_char, n_tokens, piece: one row per piece."""
    path = path or default_path()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for b in it:
            keys, rows = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                made = pieces_of(t or "", own, limit, overlap)
                keys += [k] * len(made)
                rows += [(i + 1, len(made), *p) for i, p in enumerate(made)]
            columns = list(zip(*rows)) if rows else [[]] * len(SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema[0].type), *(pa.array(x, f.type) for x, f in zip(columns, SCHEMA))], ["k", *SCHEMA.names])

    rows = spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    schema = f"k {rows.schema[0].dataType.simpleString()}, piece_no int, n_pieces int, start_char long, own_char long, end_char long, n_tokens int, piece string"
    return rows.mapInArrow(batches, schema).withColumnRenamed("k", key)
