"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: the merges are compiled into a finite-state transducer that is determinised lazily. A state is the
last token already emitted and the bytes still pending; reading a byte yields the next state and the tokens
that no later byte can change. A token is emitted as soon as every start that a longer token could still use
agrees on it, so the lookahead is bounded by the longest token. Which token ends at a position follows from
the fact that a sequence is the BPE encoding of its text exactly if each pair of neighbours is the encoding
of the two together. Arcs are kept per worker; whole pre-tokens met before are kept as composed arcs. Both
tables are emptied when they reach a bound, which changes speed only.

Defined results: a null and an empty text give an empty list; strings of special tokens are ordinary text;
repeated rows give repeated results; texts of any length are read whole.
"""

from __future__ import annotations

import base64
import codecs
import functools
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from bankspark.runtime import spread

#: Fixed value: how the vocabulary's text is cut into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ARCS, WORDS, NEVER = 2_000_000, 400_000, 1 << 60


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The vocabulary's place on this machine; a parameter of every operator."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


class Transducer:
    """Lazily determinised transducer of one BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.open = {b[:n] for b in ranks for n in range(1, len(b))}  # what a longer token begins with
        self.split = regex.compile(PATTERN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, bool], tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.states: list[tuple[int, bytes, tuple[int, ...]]] = [(-1, b"", ())]
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins to this one; None for a single byte."""
        text = self.bytes_of[token]
        parts = [text[i : i + 1] for i in range(len(text))]
        if len(parts) == 1:
            return None
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            parts[at : at + 2] = [self.bytes_of[rank]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def edge(self, token: int, right: bool) -> tuple[int, ...]:
        """The tokens that stand at one end of this one while it is merged, from the byte to itself."""
        known = self.edges.get((token, right))
        if known is None:
            inner = self.halves(token)
            known = self.edges[token, right] = (token,) if inner is None else (*self.edge(inner[right], right), token)
        return known

    def fit(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart when their bytes stand together: no merge over their border comes first.

        At any time one token of each one's edge stands at the border. The pair merges if its rank is below that of
        the next merge of either side (at equal ranks the one further left goes first).
        """
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > ARCS:
                self.fits.clear()
            x, y, i, j = self.edge(a, True), self.edge(b, False), 0, 0
            while True:
                over = self.ranks.get(self.bytes_of[x[i]] + self.bytes_of[y[j]], NEVER)
                left = x[i + 1] if i + 1 < len(x) else NEVER
                right = y[j + 1] if j + 1 < len(y) else NEVER
                if over < left and over <= right and over < NEVER:
                    known = False
                    break
                if left == right == NEVER:
                    known = True
                    break
                if left <= right:
                    i += 1
                else:
                    j += 1
            self.fits[a, b] = known
        return known

    def _last(self, prev: int, pending: bytes, starts: tuple[int, ...], at: int) -> int:
        """The token that ends at `at` of the pending bytes."""
        return prev if at == 0 else self.ranks[pending[starts[at - 1] : at]]

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one arc."""
        prev, pending, starts = self.states[state]
        text = pending + bytes((byte,))
        n = len(text)
        for s in range(n):
            token = self.ranks.get(text[s:])
            if token is not None and (s == 0 or starts[s - 1] >= 0):
                before = self._last(prev, pending, starts, s)
                if before < 0 or self.fit(before, token):
                    break
        else:
            raise ValueError("the vocabulary lacks a byte")
        starts += (s,)
        live = [j for j in range(n) if (j == 0 or starts[j - 1] >= 0) and text[j:] in self.open] + [n]
        common = None
        for j in live:
            chain = {j}
            while j:
                j = starts[j - 1]
                chain.add(j)
            common = chain if common is None else common & chain
        cut, out, j = max(common), [], max(common)
        while j:
            out.append(self.ranks[text[starts[j - 1] : j]])
            j = starts[j - 1]
        out.reverse()
        key = (out[-1] if out else prev, text[cut:])
        target = self.ids.get(key)
        if target is None:
            target = self.ids[key] = len(self.states)
            self.states.append((*key, tuple(x - cut if x >= cut else -1 for x in starts[cut:])))
        return target, tuple(out)

    def rest(self, state: int) -> tuple[int, ...]:
        """The tokens of the pending bytes at the end of a pre-token."""
        _, pending, starts = self.states[state]
        out, j = [], len(pending)
        while j:
            out.append(self.ranks[pending[starts[j - 1] : j]])
            j = starts[j - 1]
        return tuple(reversed(out))

    def word(self, word: str) -> tuple[int, ...]:
        known = self.words.get(word)
        if known is not None:
            return known
        if len(self.arcs) > ARCS:
            self.reset()
        state, out, arcs = 0, [], self.arcs
        for b in word.encode():
            arc = arcs.get(state << 8 | b)
            if arc is None:
                arc = arcs[state << 8 | b] = self.step(state, b)
            state = arc[0]
            if arc[1]:
                out.extend(arc[1])
        known = (*out, *self.rest(state))
        if len(word) <= 64:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for w in self.split(text or ""):
            out.extend(self.word(w))
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text piece by piece; bytes of a character that is not complete wait in the UTF-8 decoder's state."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := machine.decode(self.bytes_of[i]):
                yield piece
        if tail := machine.decode(b"", True):
            yield tail


@functools.lru_cache(4)
def transducer(path: str) -> Transducer:
    """One transducer a worker and vocabulary."""
    lines = Path(path).read_bytes().splitlines()
    return Transducer({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key, ids array<int>: one row per input row."""
    path = path or default_path()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for b in it:
            ids = pa.array([own.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["k", "ids"])

    rows = spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    return rows.mapInArrow(batches, f"k {rows.schema[0].dataType.simpleString()}, ids array<int>").select(F.col("k").alias(key), "ids")


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """key, text: the inverse of `encode`; a null list gives a null text."""
    path = path or default_path()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for b in it:
            texts = pa.array([None if x is None else "".join(own.decode(x)) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], ["k", "text"])

    rows = df.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    return rows.mapInArrow(batches, f"k {rows.schema[0].dataType.simpleString()}, text string").select(F.col("k").alias(key), "text")
