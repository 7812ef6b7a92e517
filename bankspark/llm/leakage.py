"""Evaluation texts that leak into training text.

Method: a generalised suffix automaton of the normalised test items. Every training text is streamed through it
word by word, which tracks the longest match that ends at each word; the suffix state that holds the last `SEED`
words names every place of every item where a match goes on. Matches that run on along one diagonal (place in
the text less place in the item) are merged to runs, and the runs of one item near one diagonal to a stretch.
Coverage decides: a stretch whose runs hold fewer than `COVER` of the item's words is none, one whose runs hold
`SHARE` of them densely is a leak. Only what lies between is confirmed by aligning the stretch with the item
word by word, where a typing error counts as the same word. Each leak is a span of the text, which `clean` removes.

The items are a stated set. They are cut into blocks of about `BLOCK_WORDS` words by a hash of their key; the
driver holds one block at a time, and a block's automaton (at most two states a word) meets all rows.

Defined results: null, empty or wordless texts and items match nothing; items with the same words are all
reported; a row is reported once for each item however often the item occurs in it, with all its spans in
`spans`; repeated keys give one row a key and item in `find_leaks`; `clean` keeps every row and nulls stay.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from bankspark.runtime import spread

#: Two fifths of the words, less the word or two that an alignment may lose at either end.
SEED, SHARE, BLOCK_WORDS = 3, 0.38, 200_000
#: Alignment: what a kept word adds; what a word changed, left out or put in takes off.
KEPT, CHANGED = 1.0, 1.5
#: The least share of kept words in a short stretch and in one of LONG or more of the item; texts made from the same
#: phrases with other words stay below the one and do not get as long as the other.
DENSITY, LONG, LONG_DENSITY = 0.92, 0.6, 0.8
#: The least share of the item's words in runs of SEED or more: two fifths of the words with every fourth one changed.
COVER = 0.28
#: Places of matches that are laid out at one time; texts that are looked at together.
LAID_OUT, TOGETHER = 1 << 20, 64
ARTICLES = {"a", "an", "the"}
WORD = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str | None) -> list[str]:
    """Words without case, marks, punctuation, spacing and layout."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        text = text.replace("’", "'").replace("‘", "'")
    return WORD.findall(text.casefold().replace("'", "").replace("-\n", ""))


class Automaton:
    """Suffix automaton of several word sequences; a state's places are the ends of its words in the items."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = items
        self.bits = max(16, max((len(words) for _, words in items), default=0).bit_length())  # of a place in its item
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[tuple[int, int]] = []  # (state, place)
        for n, (_, words) in enumerate(items):
            last = 0
            for i, w in enumerate(words):
                last = self._add(last, w)
                own.append((last, n << self.bits | i))
        # places in the order of a walk over the suffix links: those of a state are one stretch, from first to last
        by_state: dict[int, list[int]] = defaultdict(list)
        for state, place in own:
            by_state[state].append(place)
        children: dict[int, list[int]] = defaultdict(list)
        for state, parent in enumerate(self.link):
            if parent >= 0:
                children[parent].append(state)
        order: list[int] = []
        self.first, self.last = np.zeros(len(self.next), np.int64), np.zeros(len(self.next), np.int64)
        todo = [(0, False)]
        while todo:
            state, done = todo.pop()
            if done:
                self.last[state] = len(order)
                continue
            self.first[state] = len(order)
            order += by_state.get(state, ())
            todo.append((state, True))
            todo += [(c, False) for c in children.get(state, ())]
        self.order = np.array(order, np.int64)
        self.sizes = np.array([len(words) for _, words in items], np.int64)
        #: Of each state the shortest suffix state that still has SEED words (-1: none).
        self.top = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.top[self.link[state]]
            self.top[state] = above if above >= 0 else state if self.length[state] >= SEED else -1

    def _add(self, last: int, w: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # another item had this prefix
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def places(self, state: int) -> np.ndarray:
        return self.order[self.first[state] : self.last[state]]

    def seeds(self, words: list[str], least: int) -> Iterator[tuple[int, int, int]]:
        """(end in the text, length, state) of each match that does not go on."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            if to is not None:
                state, n = to, n + 1
                continue
            if n >= least:
                yield i - 1, n, state
            while to is None and state:
                state = link[state]
                to = nxt[state].get(w)
            if to is None:
                n = 0
            else:
                n, state = length[state] + 1, to
        if n >= least:
            yield len(words) - 1, n, state

    def walk(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(place in the text, state of the SEED words that end there) where the longest match has SEED words or more."""
        nxt, link, length, top = self.next, self.link, self.length, self.top
        state = n = 0
        at, states = [], []
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state, n = to, n + 1
            if n >= SEED:
                at.append(i)
                states.append(top[state])
        return at, states

    def _laid_out(self, states: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of the state, place in the items) of all matches, in parts of bounded size."""
        many = self.last[states] - self.first[states]
        ends, a = np.cumsum(many), 0
        while a < len(states):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LAID_OUT, "right")))
            n = many[a:b]
            which = np.repeat(np.arange(a, b), n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            yield which, self.order[self.first[states[which]] + inside]
            a = b

    def runs(self, texts: list[list[str]], cover: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(text and item as one number, end in the text, end in the item, length) of the matches of SEED words or more that
        do not go on, by diagonal. Items of whose words less than `cover` can be in matches are left out."""
        walks = [self.walk(words) for words in texts]
        at, states = (np.array([x for w in walks for x in w[side]], np.int64) for side in (0, 1))
        if not len(at):
            return None
        first = np.repeat(np.arange(len(texts)), [len(w[0]) for w in walks]) * len(self.items)  # key of the text's first item
        sizes, mask = np.tile(self.sizes, len(texts)), (1 << self.bits) - 1
        count = np.zeros(len(sizes), np.int64)
        for which, places in self._laid_out(states):
            count += np.bincount(first[which] + (places >> self.bits), minlength=len(count))
        likely = (count > 0) & (SEED * count >= cover * sizes)  # a run of n words has n - SEED + 1 ends, and SEED words or more
        if not likely.any():
            return None
        kept = []
        for which, places in self._laid_out(states):
            key = first[which] + (places >> self.bits)
            some = likely[key]
            kept.append((at[which[some]], key[some], (places & mask)[some]))
        j, key, i = (np.concatenate(x) for x in zip(*kept))
        wide, deep = int(j.max()) + 2, int(j.max()) + int(i.max()) + 2
        if len(sizes) * wide * deep < 1 << 63:  # one number a match: its text and item, its diagonal, its end
            whole = np.sort((key * deep + (j - i + int(i.max()))) * wide + j)
            diagonal, j = np.divmod(whole, wide)
            key, diagonal = np.divmod(diagonal, deep)
            i = j - diagonal + int(i.max())
        else:
            sort = np.lexsort((j, j - i, key))
            j, key, i = j[sort], key[sort], i[sort]
            whole = None
        breaks = np.diff(whole) != 1 if whole is not None else (key[1:] != key[:-1]) | (j[1:] - i[1:] != j[:-1] - i[:-1]) | (j[1:] != j[:-1] + 1)
        starts = np.flatnonzero(np.concatenate(([True], breaks)))
        ends = np.concatenate((starts[1:], [len(j)])) - 1
        return key[starts], j[ends], i[ends], ends - starts + SEED

    def matches(self, texts: list[list[str]]) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
        """(text, item) -> (end in the text, end in the item, length) of its matches."""
        out: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for k, *run in zip(*(x.tolist() for x in self.runs(texts) or ())):
            out[divmod(k, len(self.items))].append(tuple(run))
        return out

    def stretches(self, texts: list[list[str]]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(text, item, runs) of the runs near one diagonal that hold COVER of the item's words."""
        found = self.runs(texts, COVER)
        if found is None:
            return
        key, j, i, length = found
        size = self.sizes[key % len(self.items)]
        apart = np.concatenate(([True], (key[1:] != key[:-1]) | (np.diff(j - i) > np.maximum(4, size[1:] // 6))))
        starts = np.flatnonzero(apart)
        enough = np.add.reduceat(length, starts) >= COVER * size[starts]
        ends = np.concatenate((starts[1:], [len(key)]))
        for a, b in zip(starts[enough].tolist(), ends[enough].tolist()):
            runs = list(zip(j[a:b].tolist(), i[a:b].tolist(), length[a:b].tolist()))
            if covered(runs) >= COVER * int(size[a]):
                yield *divmod(int(key[a]), len(self.items)), runs

    def leaks(self, texts: list[list[str]]) -> list[tuple[int, int, float, int, int]]:
        """(text, item id, share of the item's words, first and last word of the text) of each stretch that holds an item."""
        out, same_as = [], {}
        for t, item, runs in self.stretches(texts):
            key, own = self.items[item]
            found = held(runs, len(own))
            if found is None:
                if t not in same_as:
                    same_as[t] = Alike(texts[t])
                slack = max(4, len(own) // 6)
                first, last = (f(r[0] - r[1] for r in runs) for f in (min, max))
                found = stretch(own, texts[t], first - slack, last + slack, same_as[t])
            if found[0] >= SHARE:
                out.append((t, key, *found))
        return out


def held(runs: list[tuple[int, int, int]], n: int) -> tuple[float, int, int] | None:
    """(share of the item's n words, first and last word of the text) of the longest stretch that runs alone cover densely enough."""
    spans = sorted((i - m + 1, i, j - m + 1, j) for j, i, m in runs)
    best = None
    for a in range(len(spans)):
        low, reach, kept, first, last = spans[a][0], spans[a][0] - 1, 0, spans[a][2], spans[a][3]
        for x, y, p, q in spans[a:]:
            if p < first:
                continue  # not in the item's order
            kept += max(0, y - max(reach, x - 1))
            reach, last = max(reach, y), max(last, q)
            share = (reach - low + 1) / n
            if share >= SHARE and kept >= (DENSITY if share < LONG else LONG_DENSITY) * (reach - low + 1) and (best is None or share > best[0]):
                best = (share, first, last)
    return best


def covered(seeds: list[tuple[int, int, int]]) -> int:
    """Words of the item, or of the text if less, that seeds hold; an alignment's own seeds share none."""
    sides = []
    for side in (0, 1):
        n, reach = 0, -1
        for start, end in sorted((s[side] - s[2] + 1, s[side]) for s in seeds):
            n += max(0, end - max(reach, start - 1))
            reach = max(reach, end)
        sides.append(n)
    return min(sides)


def possible(held: list[bool]) -> bool:
    """Whether a stretch may be dense enough, by which of the item's words stand anywhere in the window."""
    n = len(held)
    for share, density in ((SHARE, DENSITY), (LONG, LONG_DENSITY)):
        least, low, sums = max(1, math.floor(share * n)), math.inf, [0.0]
        for i, h in enumerate(held):
            sums.append(sums[-1] + h - density)
            if i + 1 >= least:
                low = min(low, sums[i + 1 - least])
                if sums[-1] - low > -1e-6:
                    return True
    return False


@functools.lru_cache(500_000)
def near(a: str, b: str) -> bool:
    """Whether two words are one but for a typing error: a letter more, less or other, or two swapped; articles are one."""
    if a in ARTICLES and b in ARTICLES:
        return True
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n < 3 or m - n > 1 or (a[0] != b[0] and a[-1] != b[-1]) or b.isdigit():
        return False
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


class Alike(dict):
    """Of a word of an item: the words of the text that are it, but for a typing error."""

    def __init__(self, text: list[str]):
        self.articles = ARTICLES.intersection(text)
        self.ends: dict[str, list[str]] = defaultdict(list)
        for x in set(text):
            self.ends[x[0]].append(x)
            if x[-1] != x[0]:
                self.ends["$" + x[-1]].append(x)

    def __missing__(self, w: str) -> set[str]:
        if w in ARTICLES:
            out = self.articles
        else:
            n, ends = len(w), self.ends
            out = {x for x in (*ends.get(w[0], ()), *ends.get("$" + w[-1], ()), *ends.get(w[-1], ())) if -2 < len(x) - n < 2 and (x == w or near(w, x))}
        self[w] = out
        return out


def stretch(item: list[str], text: list[str], first: int, last: int, same_as: Alike) -> tuple[float, int, int]:
    """(share of the item's words, first and last word of the text) of the best local alignment; a share of 0 if not dense enough.

    Cells lie on the diagonals first..last (place in the text less place in the item).
    """
    n, width = len(text), last - first + 1
    window = set(text[max(0, first) : last + len(item)])
    if not possible([not window.isdisjoint(same_as[w]) for w in item]):
        return 0.0, 0, 0
    nothing = (0.0, 0, 0, 0)  # score, where the alignment begins in the item and in the text, words kept
    above = [nothing] * (width + 1)
    best, span, begin, end = nothing, 0, 0, 0
    for i, w in enumerate(item):
        same, row, left = same_as[w], [], nothing
        for d in range(width):
            j = i + first + d
            if not 0 <= j < n:
                left = nothing
                row.append(nothing)
                continue
            corner = above[d]
            if text[j] in same:
                left = (corner[0] + KEPT, corner[1], corner[2], corner[3] + 1) if corner[0] > 0 else (KEPT, i, j, 1)
                if left[0] > best[0]:
                    best, span, begin, end = left, i + 1 - left[1], left[2], j
            else:
                up = above[d + 1]
                if up[0] > left[0]:
                    left = up
                if corner[0] > left[0]:
                    left = corner
                left = (left[0] - CHANGED, *left[1:]) if left[0] > CHANGED else nothing
            row.append(left)
        row.append(nothing)
        above = row
    share = span / len(item)
    return (share, begin, end) if span and best[3] >= (DENSITY if share < LONG else LONG_DENSITY) * span else (0.0, 0, 0)


def places_of(text: str) -> list[tuple[int, int]]:
    """(start, end) in characters of each of the words that words_of gives."""
    chars, origin = [], []
    for i, c in enumerate(text):
        for x in c if text.isascii() else unicodedata.normalize("NFKD", c):
            if text.isascii() or not unicodedata.combining(x):
                for y in ("'" if x in "’‘" else x).casefold():
                    chars.append(y)
                    origin.append(i)
    kept = [k for k, c in enumerate(chars) if c != "'"]
    chars, origin = [chars[k] for k in kept], [origin[k] for k in kept]
    kept = [k for k, c in enumerate(chars) if not (c == "-" and chars[k + 1 : k + 2] == ["\n"]) and not (c == "\n" and k and chars[k - 1] == "-")]
    chars, origin = [chars[k] for k in kept], [origin[k] for k in kept]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer("".join(chars))]


def spans(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """key, item_key, share, start_char, end_char: every stretch of a row that holds an item, whole or in part."""
    spark = df.sparkSession
    kind, item_kind = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    rows = spread(df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    asked = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("e"), F.col(item_text).cast("string").alias("x"))
    # about six characters a word
    size = asked.agg(F.coalesce(F.sum(F.length("x")), F.lit(0))).first()[0]
    n = max(1, -(-size // (6 * BLOCK_WORDS)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("e"), F.lit(n)))
    parts = []
    for block in range(n):
        words = [(r[0], words_of(r[1])) for r in asked.where(F.col("block") == block).select("e", "x").toLocalIterator()]
        shared = spark.sparkContext.broadcast([w for w in words if w[1]])

        def batches(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = compiled(shared)
            for b in it:
                out, keys, texts = [], b.column(0).to_pylist(), b.column(1).to_pylist()
                for a in range(0, len(keys), TOGETHER):
                    for t, e, share, i, j in own.leaks([words_of(t) for t in texts[a : a + TOGETHER]]):
                        places = places_of(texts[a + t])
                        out.append((keys[a + t], e, share, places[i][0], places[j][1]))
                columns = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema[0].type), pa.array(columns[1], ARROW.get(item_kind)), pa.array(columns[2], pa.float64()), *(pa.array(c, pa.int64()) for c in columns[3:])], ["k", "e", "share", "start_char", "end_char"])

        parts.append(rows.mapInArrow(batches, f"k {kind}, e {item_kind}, share double, start_char long, end_char long"))
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.withColumnsRenamed({"k": key, "e": item_key})


#: Arrow types of keys; others are told by their values.
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def find_leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """key, item_key, share: every row that holds an item, whole or a running stretch of it."""
    return spans(df, key, text, items, item_key, item_text).groupBy(key, item_key).agg(F.max("share").alias("share"))


def clean(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """key, text, removed: the text of every row without the spans that hold items, and the number of characters removed.

    Keys are unique, as spans come back by key."""
    found = spans(df, key, text, items, item_key, item_text)
    per = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("start_char").cast("int").alias("a"), F.col("end_char").cast("int").alias("b")))).alias("cuts"))
    rows = df.select(F.col(key), F.col(text).cast("string").alias("t")).join(per, key, "left")
    # spans in order of their starts: what stands before each and was not cut yet is kept
    state = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    fold = F.aggregate("cuts", state, lambda s, c: F.struct(F.concat(s["kept"], F.when(c["a"] > s["at"], F.substring(F.col("t"), s["at"] + 1, c["a"] - s["at"])).otherwise("")).alias("kept"), F.greatest(s["at"], c["b"]).alias("at")))
    rows = rows.withColumn("fold", fold)
    kept = F.when(F.col("cuts").isNull(), F.col("t")).otherwise(F.concat("fold.kept", F.expr("substring(t, fold.at + 1)")))
    return rows.select(key, kept.alias(text), F.coalesce(F.length("t") - F.length(kept), F.lit(0)).alias("removed"))


_COMPILED: dict[int, Automaton] = {}


def compiled(shared) -> Automaton:
    """One automaton a worker and broadcast."""
    known = _COMPILED.get(id(shared.value))
    if known is None:
        _COMPILED.clear()
        known = _COMPILED[id(shared.value)] = Automaton(shared.value)
    return known
