"""Text decoded with a wrong character encoding: which fields, and their original text where it can be had.

Method: expectation-maximisation with a latent encoding chain for each record. A chain says which bytes
were read as what (UTF-8 read as code page 1252, once or twice, code page 1252 read as Mac Roman, ...). Every
run of non-ASCII characters has a likelihood as it stands and under each chain that can be undone on it, by
a model of characters in their context. The E-step gives each record a posterior over chains, each run
being either sound or damaged by the record's chain; the M-step estimates the share of each chain for every
source and field and the character model from the posteriors. So weak evidence (one odd letter) is judged by
the record's other runs, by its source and field, and by what the corpus writes elsewhere. Each record is
then repaired by its posterior.

Scale: bodies are read twice; between, only runs with their contexts are kept. The character model has one
entry a Unicode character and context of two classes, whatever the size of the corpus, and is broadcast; so are the
shares of sources (one row a source and field) as long as a count shows them to be few, so that no text is shuffled;
beyond that they are joined. EM runs a fixed number of rounds over the kept runs.

Defined results: null and empty texts are not affected; U+FFFD and C1 control characters always are, also
where nothing can be restored; ASCII text (with it transfer-encoded words) never is; repeated rows give
repeated results.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bankspark.runtime import broadcast_if_small, cut, spread

ROUNDS, DAMAGED_SHARE, SURE = 3, 0.5, 2.0
RUN = re.compile(r"[^\x00-\x7f]+")
LOST, CONTROL = "�", re.compile("[\x80-\x9f]")
#: True encoding, then what it was read as; twice where the damage was saved and repeated.
CHAINS = (
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2), ("utf-8", "mac_roman", 1), ("utf-8", "cp437", 1),
    ("utf-8", "cp850", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp1250", 1), ("utf-8", "koi8-r", 1), ("cp1252", "mac_roman", 1), ("cp1252", "cp1251", 1), ("mac_roman", "cp1252", 1),
    ("cp1252", "cp850", 1), ("cp1252", "cp437", 1), ("cp850", "cp1252", 1), ("cp1252", "cp1250", 1), ("cp1251", "cp1252", 1), ("cp1252", "koi8-r", 1),
)
SOUND = len(CHAINS)


def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte; a byte that the code page leaves open is the control character of its number."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes((b,)).decode(codec)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


ENCODE = {c: _bytes_of(c) for c in {c for _, c, _ in CHAINS}}


def undo(run: str, chain: int) -> str | None:
    """The run before the damage; bytes that are missing or spoilt come out as U+FFFD; None if nothing of it can be undone.

    Characters that the code page lacks were not damaged and stay."""
    true, read, times = CHAINS[chain]
    table = ENCODE[read]
    for _ in range(times):
        out, raw, done = [], bytearray(), False
        for c in [*run, ""]:
            b = table.get(c)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                done = True
                if true == "utf-8":
                    part = raw.decode("utf-8", "replace")
                    if part.count(LOST) * 2 > len(part):
                        return None
                else:
                    try:
                        part = raw.decode(true)
                    except UnicodeDecodeError:
                        return None
                out.append(part)
                raw = bytearray()
            out.append(c)
        if not done:
            return None
        run = "".join(out)
    return run


def kind(c: str) -> str:
    """Class of a neighbour: space, lower, upper, digit, other."""
    if not c or c.isspace():
        return "s"
    if c.islower():
        return "l"
    if c.isupper():
        return "u"
    return "d" if c.isdigit() else "l" if c.isalpha() else "p"


@functools.lru_cache(100_000)
def oddity(before: str, c: str, after: str) -> float:
    """Fixed log-odds against a character in its context, whatever the corpus holds of it."""
    letters = (before in "lu") + (after in "lu")
    if c.isalpha():
        if letters and "LATIN" not in unicodedata.name(c, ""):
            return 5.0
        return 3.0 if c.isupper() and before in "lu" and after == "l" else 0.0
    if letters and (unicodedata.category(c) == "Sm" or "\u2500" <= c <= "\u25ff"):
        return 3.0  # signs of formulas and frames beside letters
    return 3.0 if letters == 2 and c not in "’‘·-–—…" else 0.0


def events(before: str, run: str, after: str) -> list[tuple[str, str, str]]:
    """(class before, character, class after) of each non-ASCII character of a run between two classes."""
    kinds = [before, *map(kind, run), after]
    return [(kinds[i], c, kinds[i + 2]) for i, c in enumerate(run) if c > "\x7f"]


def runs_of(text: str) -> Counter:
    """(class before, run, class after) -> times."""
    return Counter((kind(text[m.start() - 1 : m.start()]), m.group(), kind(text[m.end() : m.end() + 1])) for m in RUN.finditer(text))


#: Longer runs are scored each time, not kept.
MEMO_RUN = 4000


class Model:
    """Log-likelihood of characters in context, and of runs under the chains."""

    def __init__(self, counts: dict[tuple[str, str, str], float]):
        self.n = counts
        self.of_char: dict[str, float] = defaultdict(float)
        for (_, c, _), n in counts.items():
            self.of_char[c] += n
        self.total = math.log(sum(counts.values()) + 1.0) + 4.6  # of a hundred characters one is not ASCII
        self.known: dict[tuple[str, str, str], tuple[float, dict[int, tuple[float, str]]]] = {}

    def likelihood(self, before: str, run: str, after: str) -> float:
        out = 0.0
        for e in events(before, run, after):
            if e[1] == LOST or "\x7f" < e[1] < "\xa0":
                out -= self.total + 5.0
            else:
                out += math.log(self.n.get(e, 0.0) + 0.01 * self.of_char.get(e[1], 0.0) + 0.001) - self.total - oddity(*e)
        return out

    def scores(self, key: tuple[str, str, str]) -> tuple[float, dict[int, tuple[float, str]]]:
        """(as it stands, chain -> (under the chain, undone run)) of the chains that are not out of the question."""
        known = self.known.get(key)
        if known is None:
            if len(self.known) > 200_000:
                self.known.clear()
            before, run, after = key
            plain, chains = self.likelihood(before, run, after), {}
            for chain in range(SOUND):
                undone = undo(run, chain)
                if undone is not None and undone != run and (score := self.likelihood(before, undone, after)) > plain - 4.0:
                    chains[chain] = (score, undone)
            known = (plain, chains)
            if len(run) <= MEMO_RUN:
                self.known[key] = known
        return known

    def posterior(self, runs: Counter, prior: list[float]) -> tuple[list[float], dict[tuple[str, str, str], list[float]]]:
        """Of a record: over chains (the last is none); of its runs: that the chain did damage it, by chain."""
        scored = {k: self.scores(k) for k in runs}
        possible = {c for _, chains in scored.values() for c in chains}
        whole, parts = [-math.inf] * (SOUND + 1), {k: [0.0] * SOUND for k in runs}
        whole[SOUND] = math.log(prior[SOUND])
        for c in possible:
            total = math.log(prior[c])
            for k, n in runs.items():
                plain, chains = scored[k]
                if c in chains:
                    d = min(50.0, chains[c][0] - plain)
                    odds = math.exp(d) * DAMAGED_SHARE
                    total += n * math.log(1 - DAMAGED_SHARE + odds)
                    parts[k][c] = odds / (1 - DAMAGED_SHARE + odds)
                else:
                    total += n * math.log(1 - DAMAGED_SHARE)
            whole[c] = total
        top = max(whole)
        weights = [math.exp(x - top) for x in whole]
        norm = sum(weights)
        return [w / norm for w in weights], parts


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        made = [[{"a": k[0], "r": k[1], "z": k[2], "n": n} for k, n in runs_of(t).items()] for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, RUNS)], ["source", "field", "runs"])


RUNS = pa.list_(pa.struct([("a", pa.string()), ("r", pa.string()), ("z", pa.string()), ("n", pa.int64())]))
STATS = "what string, source string, field string, a string, c string, z string, n double"


def _e_step(shared) -> object:
    """Posterior counts of a partition: characters in context, and chains by source and field."""

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value) if shared is not None else None
        chars: dict[tuple[str, str, str], float] = defaultdict(float)
        chains: dict[tuple[str, str, int], float] = defaultdict(float)
        for b in it:
            for source, field, runs, prior in zip(*(c.to_pylist() for c in b.columns)):
                counts = Counter({(r["a"], r["r"], r["z"]): r["n"] for r in runs})
                if model is None:
                    for k, n in counts.items():
                        for e in events(*k):
                            chars[e] += n
                    continue
                whole, parts = model.posterior(counts, prior)
                for c, p in enumerate(whole):
                    if p > 1e-6:
                        chains[source, field, c] += p
                for k, n in counts.items():
                    plain = 1.0
                    for c, (_, undone) in model.scores(k)[1].items():
                        p = whole[c] * parts[k][c]
                        if p > 1e-6:
                            plain -= p
                            for e in events(k[0], undone, k[2]):
                                chars[e] += n * p
                    if plain > 1e-6:
                        for e in events(*k):
                            chars[e] += n * plain
        rows = [("char", None, None, *e, n) for e, n in chars.items()] + [("chain", s, f, None, str(c), None, n) for (s, f, c), n in chains.items()]
        columns = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in columns[:6]), pa.array(columns[6], pa.float64())], ["what", "source", "field", "a", "c", "z", "n"])

    return step


def _priors(stats: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """source, field, prior: shares of the chains, drawn towards those of the field and towards no damage."""
    base = [0.1 / SOUND] * SOUND + [0.9]
    if stats is None:
        return pairs.select("source", "field", F.array(*map(F.lit, base)).alias("prior"))
    chains = stats.where("what = 'chain'").select("source", "field", F.col("c").cast("int").alias("c"), "n")
    own = chains.groupBy("source", "field").pivot("c", list(range(SOUND + 1))).agg(F.sum("n"))
    pool = chains.groupBy("field").pivot("c", list(range(SOUND + 1))).agg(F.sum("n"))
    pool = pool.select("field", *[(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) + base[c] * 10).alias(f"p{c}") for c in range(SOUND + 1)])
    total = sum((F.col(f"p{c}") for c in range(SOUND + 1)), F.lit(0.0))
    pool = pool.select("field", *[(F.col(f"p{c}") / total * 20).alias(f"p{c}") for c in range(SOUND + 1)])
    mixed = own.join(pool, "field")
    weights = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) + F.col(f"p{c}") for c in range(SOUND + 1)]
    whole = sum(weights, F.lit(0.0))
    return mixed.select("source", "field", F.array(*[w / whole for w in weights]).alias("prior"))


def fields_of(df: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """k, source, field, text of the fields that are not plain ASCII."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields])
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.explode(F.filter(each, lambda x: x["text"].rlike(r"[^\x00-\x7f]"))).alias("f"))
    return rows.select("k", "source", "f.field", "f.text")


def find_and_repair(df: DataFrame, key: str, source: str, fields: list[str], rounds: int = ROUNDS) -> DataFrame:
    """key, field, chain, original, complete: the affected fields with their restored text; `chain` is null and `complete` false where only damage is known."""
    texts = spread(fields_of(df, key, source, fields))
    runs = cut(texts.select("source", "field", "text").mapInArrow(_runs, "source string, field string, runs array<struct<a:string,r:string,z:string,n:long>>"))
    pairs = runs.select("source", "field").distinct()
    priors, shared = broadcast_if_small(cut(_priors(None, pairs))), None
    spark = df.sparkSession
    for r in range(rounds + 1):
        stats = runs.join(priors, ["source", "field"]).select("source", "field", "runs", "prior").mapInArrow(_e_step(shared), STATS)
        stats = cut(stats.groupBy("what", "source", "field", "a", "c", "z").agg(F.sum("n").alias("n")))
        # bounded by Unicode characters and context classes
        counts = {(x["a"], x["c"], x["z"]): x["n"] for x in stats.where("what = 'char'").select("a", "c", "z", "n").toLocalIterator()}
        shared = spark.sparkContext.broadcast(counts)
        if r:
            priors = broadcast_if_small(cut(_priors(stats, pairs)))

    def decide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in it:
            out = []
            for k, field, text, prior in zip(*(c.to_pylist() for c in b.columns)):
                found = judge(model, text, prior)
                if found is not None:
                    out.append((k, field, *found))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema[0].type), *(pa.array(c, pa.string()) for c in columns[1:4]), pa.array(columns[4], pa.bool_())], ["k", "field", "chain", "original", "complete"])

    schema = f"k {df.schema[key].dataType.simpleString()}, field string, chain string, original string, complete boolean"
    return texts.join(priors, ["source", "field"]).select("k", "field", "text", "prior").mapInArrow(decide, schema).withColumnRenamed("k", key)


def judge(model: Model, text: str, prior: list[float], again: bool = True) -> tuple[str | None, str, bool] | None:
    """(chain, restored text, whether nothing is lost) of an affected text, None of a sound one."""
    runs = runs_of(text)
    whole, parts = model.posterior(runs, prior)
    chain = max(range(SOUND + 1), key=whole.__getitem__)
    lost = LOST in text or CONTROL.search(text) is not None
    if chain == SOUND and whole[SOUND] < 0.1:
        chain = max(range(SOUND), key=whole.__getitem__)
    if chain == SOUND:
        return (None, text, False) if lost else None
    # damage has to be clear: odds against no damage, and a run that is damaged rather than not
    if not lost and (math.log(max(1 - whole[SOUND], 1e-300)) - math.log(max(whole[SOUND], 1e-300)) < SURE or max(parts[k][chain] for k in runs) < 0.8):
        return None

    def mend(m: re.Match) -> str:
        k = (kind(text[m.start() - 1 : m.start()]), m.group(), kind(text[m.end() : m.end() + 1]))
        undone = model.scores(k)[1].get(chain)
        return undone[1] if undone and parts[k][chain] > 0.5 else m.group()

    original = RUN.sub(mend, text)
    for _ in range(2):  # damage below the damage
        below = judge(model, original, prior, again=False) if again and original.isascii() is False else None
        if below is None or below[1] == original:
            break
        original = below[1]
    true, read, times = CHAINS[chain]
    return f"{true}>{read}" + (f"*{times}" if times > 1 else ""), original, LOST not in original and CONTROL.search(original) is None
