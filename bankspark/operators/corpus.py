"""Corpus pipeline: source checks, duplicates, near duplicates, leakage groups, temporal splits, cohorts, samples.

Tables that the operators share, by name of their key columns:
features(node, family, feature): what links records; families are exact_plaintext, same_message_id,
message_id_reference, thread_shared_participant and near_duplicate. groups(node, group). roles(group, role).

Two forms of near duplicates stand here. Signatures (`near_features` to `near_classes`) keep the engine's definition:
three-word shingles, 64-bit majority, at most three differing bits. `similar_pairs` and `similar_classes` are exact:
five-word shingles with a Jaccard similarity of 0.8 or more, found by prefixes of the rarest shingles, which lose no pair.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bankspark.functions import text as T
from bankspark.model import BankError
from bankspark.operators.components import components
from bankspark.runtime import broadcast_if_small, cut, spread

ROLES = ("train", "validation", "test")
SHINGLE, LEAST_TOKENS, LEAST_SHINGLES, MOST_SHINGLES, HAMMING = 3, 12, 8, 4096, 3
#: Five bands of a 64-bit signature; two of them are alike in any two signatures of a distance of at most 3.
BANDS = (13, 13, 13, 13, 12)
HEAD_GROUPS = 10


# --- source checks -------------------------------------------------------------------------------------------


def rejection(mail: DataFrame) -> Column:
    """Why a source row cannot be prepared, the first reason that holds; null if it can."""
    return (
        F.when(F.col("body").isNull() & F.col("subject").isNull(), "empty_record")
        .when(F.col("body").isNull(), "missing_body")
        .when(F.col("body").rlike(r"^\s*$"), "blank_body")
        .when(F.col("message_id").isNull() | F.col("message_id").rlike(r"^[\s<>]*$"), "missing_message_id")
        .when(F.col("from").isNull() | F.col("from").rlike(r"^\s*$"), "missing_sender")
    )


def rejection_ledger(mail: DataFrame) -> DataFrame:
    """reason, rows, and whether a rejected row had text."""
    return mail.select(rejection(mail).alias("reason"), F.col("body").isNotNull().alias("had_text")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("had_text").cast("int")).cast("boolean").alias("had_text"))


CONTENT = ("message_id", "subject", "from", "to", "cc", "bcc", "date", "body")


def content_hash(columns: tuple[str, ...] = CONTENT) -> Column:
    """SHA-256 of a record's content fields."""
    parts = [F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def distinct_records(mail: DataFrame, key: str = "row_id") -> DataFrame:
    """One row per content: its smallest key and how often it occurs."""
    return mail.groupBy(content_hash().alias("content")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("occurrences"))


def duplicate_histogram(sizes: DataFrame, size: str) -> DataFrame:
    """bucket, groups, rows, redundant rows of a table of group sizes."""
    return sizes.groupBy(T.group_size_bucket(F.col(size)).alias("bucket")).agg(F.count(F.lit(1)).alias("groups"), F.sum(size).alias("rows"), F.sum(F.greatest(F.col(size) - 1, F.lit(0))).alias("redundant"))


def multiset_hash(df: DataFrame, leaf: Column, count: Column) -> DataFrame:
    """Order-independent digest: the sum of SHA-512 leaves times their counts modulo 2^512, hashed with the total.

    Sums run over 32 limbs of 16 bits, so they stay partial aggregates in the JVM; only 33 numbers reach the driver's row.
    """
    digest = F.sha2(leaf, 512)
    limbs = [F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("long") for i in range(32)]
    sums = df.select(*[l.alias(f"l{i}") for i, l in enumerate(limbs)], count.cast("long").alias("c")).agg(*[F.coalesce(F.sum((F.col(f"l{i}") * F.col("c")).cast("decimal(38,0)")), F.lit(0)).alias(f"l{i}") for i in range(32)], F.coalesce(F.sum("c"), F.lit(0)).alias("total"))

    def finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in it:
            out = []
            for r in b.to_dict("records"):
                total = sum(int(r[f"l{i}"] or 0) << 16 * (31 - i) for i in range(32)) % (1 << 512)
                out.append((hashlib.sha256(total.to_bytes(64, "big") + str(int(r["total"] or 0)).encode()).hexdigest(), int(r["total"] or 0)))
            yield pd.DataFrame(out, columns=["digest", "total"])

    return sums.mapInPandas(finish, "digest string, total long")


# --- links -----------------------------------------------------------------------------------------------------


def features(mail: DataFrame, key: str = "row_id") -> DataFrame:
    """node, family, feature: distinct exact texts, own and referenced message ids, thread and participant together."""
    row = spread(mail.select(key, "message_id", "subject", "from", "to", "cc", "bcc", "body")).select(
        F.col(key).alias("node"),
        F.nullif(T.natural(F.col("body")), F.lit("")).alias("body"),
        T.message_id(F.col("message_id")).alias("own"),
        T.message_id_references(F.coalesce("body", F.lit(""))).alias("refs"),
        F.nullif(T.thread(F.col("subject")), F.lit("")).alias("thread"),
        T.addresses(F.array(F.col("from")), F.col("to"), F.col("cc"), F.col("bcc")).alias("people"),
    )
    digest = lambda c: F.sha2(c, 256)
    pair = lambda family, c: F.struct(F.lit(family).alias("family"), c.alias("feature"))
    each = F.flatten(
        F.array(
            F.when(F.col("body").isNotNull(), F.array(pair("exact_plaintext", digest(F.col("body"))))).otherwise(F.array().cast("array<struct<family:string,feature:string>>")),
            F.when(F.col("own").isNotNull(), F.array(pair("same_message_id", digest(F.col("own"))), pair("message_id_reference", digest(F.col("own"))))).otherwise(F.array().cast("array<struct<family:string,feature:string>>")),
            F.transform(F.col("refs"), lambda x: pair("message_id_reference", digest(x))),
            F.when(F.col("thread").isNotNull(), F.transform(F.col("people"), lambda p: pair("thread_shared_participant", digest(F.concat_ws("\u0001", "thread", p))))).otherwise(F.array().cast("array<struct<family:string,feature:string>>")),
        )
    )
    return row.select("node", F.explode(each).alias("f")).select("node", "f.family", "f.feature").distinct()


def near_family(mail: DataFrame, key: str = "row_id") -> DataFrame:
    """node, family, feature of records whose bodies are similar to another's."""
    classes = similar_texts(mail, key, "body")
    return classes.where("links > 0").select("node", F.lit("near_duplicate").alias("family"), F.col("class").cast("string").alias("feature"))


def star_edges(feats: DataFrame) -> DataFrame:
    """a, b, family: each node with the smallest node of its feature; never all pairs."""
    low = feats.groupBy("family", "feature").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return feats.join(low, ["family", "feature"]).where("node <> b").select(F.col("node").alias("a"), "b", "family").distinct()


# --- near duplicates ---------------------------------------------------------------------------------------------


def near_features(df: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """node, tokens, shingles, simhash: the bit majority of the smallest shingle hashes, ties set; null without tokens."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np
        import xxhash

        word = re.compile(r"\w+")
        for b in it:
            out = []
            for t in b.column(1).to_pylist():
                words = word.findall(T.grouping_text(t) or "")
                grams = {xxhash.xxh64_intdigest("\x1f".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))} if words else set()
                if not grams:
                    out.append((0, 0, None))
                    continue
                h = np.array(sorted(grams)[:MOST_SHINGLES], np.uint64)
                bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
                signature = int((np.where(bits >= (len(h) + 1) // 2, 1, 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())
                out.append((len(words), len(h), signature - (1 << 64) if signature >= 1 << 63 else signature))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["node", "tokens", "shingles", "simhash"])

    rows = spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    return rows.mapInArrow(batches, f"node {rows.schema[0].dataType.simpleString()}, tokens long, shingles long, simhash long")


def band_keys(simhash: Column) -> Column:
    """array<struct<pair,value>>: the values of each pair of bands."""
    bands, at = [], 0
    for bits in BANDS:
        bands.append(F.shiftrightunsigned(simhash, at).bitwiseAND(F.lit((1 << bits) - 1)))
        at += bits
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    return F.array(*[F.struct(F.lit(n).alias("pair"), (F.shiftleft(bands[i], BANDS[j]).bitwiseOR(bands[j])).alias("value")) for n, (i, j) in enumerate(pairs)])


def near_pairs(signatures: DataFrame, hamming: int = HAMMING, budget: int | None = None) -> DataFrame:
    """a, b, distance: distinct signatures at most `hamming` (3) bits apart, a < b; equal signatures are one class.

    `signatures` has node and simhash of eligible texts; copies of one signature stay a class and are not paired.
    With a budget, BankError before any join if the bands would emit more pairs.
    """
    if budget is not None and (found := candidate_budget(signatures).first()["emissions"]) > budget:
        raise BankError(f"{found} candidate pairs are more than the budget of {budget}")
    distinct = cut(signatures.select("simhash").distinct())
    keyed = distinct.select("simhash", F.explode(band_keys(F.col("simhash"))).alias("k")).select("simhash", "k.pair", "k.value")
    other = keyed.withColumnRenamed("simhash", "b")
    found = keyed.withColumnRenamed("simhash", "a").join(other, ["pair", "value"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= hamming)
    return found.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int").alias("distance")).distinct()


def candidate_budget(signatures: DataFrame) -> DataFrame:
    """One row: pairs that the bands would emit, known before any join."""
    keyed = signatures.select("simhash").distinct().select(F.explode(band_keys(F.col("simhash"))).alias("k"))
    n = F.col("count")
    return keyed.groupBy("k").count().agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0)).alias("emissions"))


def near_classes(nodes: DataFrame, hamming: int = HAMMING) -> DataFrame:
    """node, class, links: eligible texts by components of near signatures, with their number of near signatures."""
    eligible = nodes.where((F.col("tokens") >= LEAST_TOKENS) & (F.col("shingles") >= LEAST_SHINGLES) & F.col("simhash").isNotNull()).select("node", "simhash")
    pairs = cut(near_pairs(eligible, hamming))
    ends = pairs.select(F.col("a").alias("s"), "a", "b").union(pairs.select(F.col("b").alias("s"), "a", "b"))
    keyed = eligible.select("simhash").distinct().join(ends, eligible["simhash"] == ends["s"], "left").select(F.col("simhash"), F.concat_ws(":", "a", "b").alias("k"))
    classes = components(keyed, "simhash", {"near": F.nullif(F.col("k"), F.lit(""))})
    degree = ends.groupBy(F.col("s").alias("simhash")).agg(F.count(F.lit(1)).alias("links"))
    return eligible.join(classes, "simhash").join(degree, "simhash", "left").select("node", F.col("group").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


# --- similar texts, exactly ----------------------------------------------------------------------------------------

#: Words of a shingle, and the least share of two texts' shingles, in ten-thousandths, that both have.
WORDS, SIMILAR = 5, 8000
#: Shingles of their prefixes that similar sets have both.
ALIKE = 4
#: Bits of a shingle's hash that tell under which number its texts are counted; leading ones that name a range of numbers.
COUNTED, RANGE = 26, 6
#: Words, and shingles not yet counted, that a worker holds at once.
HELD_WORDS, HELD_SHINGLES = 2_000_000, 8_000_000
#: Pairs that a worker compares at once, and sets whose texts are looked up by a broadcast of their nodes.
HELD_PAIRS, LOOKED_UP = 2_000_000, 1_000_000


def shingle_sets(df: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """node, set, shingles: the distinct shingles of a text's words without case and punctuation, as hashes, and their digest.

    Texts of fewer words have one shingle of all of them; null and wordless texts are left out. Shingles are larger than
    the texts' files, so they are made again for each use rather than kept."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy())
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_WORDS, "right")))
                yield _shingled(b.slice(at, to - at), words)
                at = to

    w = F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.xxhash64(x))
    rows = spread(df.select(key, text)).select(F.col(key).alias("node"), w.alias("w"))
    return rows.mapInArrow(batches, f"node {rows.schema[0].dataType.simpleString()}, set long, shingles array<long>")


def _shingled(b: pa.RecordBatch, words: int) -> pa.RecordBatch:
    """node, set, shingles of a batch of nodes and their words' hashes."""
    b = b.filter(pc.greater(pc.fill_null(pc.list_value_length(b.column(1)), 0), 0))
    n = pc.list_value_length(b.column(1)).to_numpy().astype(np.int64)
    h = b.column(1).flatten().to_numpy().view(np.uint64)
    starts = np.cumsum(n) - n
    count = np.maximum(n - (words - 1), 1)
    ends = np.cumsum(count)
    x = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for length in range(1, words + 1):  # the full shingles, and the texts that have fewer words
        some = n >= words if length == words else n == length
        many = count[some]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first, x_at = (np.repeat(v[some], many) + nth for v in (starts, ends - count))
        mixed = np.full(len(first), length, np.uint64)
        for i in range(length):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[first + i]
        for _ in range(2):
            mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x[x_at] = mixed ^ (mixed >> np.uint64(33))
    for s, e in zip(ends - count, ends):
        x[s:e].sort()
    row = np.repeat(np.arange(len(n)), count)
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    x, offsets = x[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))]).astype(np.int32)
    digests = b"".join(hashlib.sha256(x[s:e]).digest()[:8] for s, e in zip(offsets, offsets[1:]))
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(digests, np.int64)), pa.ListArray.from_arrays(offsets, x.view(np.int64))], ["node", "set", "shingles"])


def _numbers(x: np.ndarray, skip: int = 0) -> np.ndarray:
    """The COUNTED bits of each hash that follow its first `skip` ones."""
    return ((x.view(np.uint64) << np.uint64(skip)) >> np.uint64(64 - COUNTED)).astype(np.uint32)


def _table(steps: dict[int, bytes]) -> np.ndarray:
    table = np.zeros(1 << COUNTED, np.uint8)
    for r, packed in steps.items():
        table[r << (COUNTED - RANGE) : (r + 1) << (COUNTED - RANGE)] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return table


def frequencies(sets: DataFrame, skip: int = 0) -> dict[int, bytes]:
    """How many texts have a shingle, for every number of COUNTED bits: by its first RANGE bits, a compressed byte for each
    number: 0 for no text, 1 for one, then two steps for each doubling.

    Shingles of one number count together, so a shingle of a number that counts one is in no other text. Each task sends
    its numbers as sorted differences, about two bytes each; the result has 64 MB before compression, for any input."""
    size = 1 << (COUNTED - RANGE)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def parts() -> pa.RecordBatch:
            numbers, often = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bounds = np.searchsorted(numbers, np.arange((1 << RANGE) + 1, dtype=np.int64) * size)
            rows = []
            for r, (s, e) in enumerate(zip(bounds, bounds[1:])):
                steps = np.diff(numbers[s:e].astype(np.uint32), prepend=np.uint32(r * size))
                rows.append((r, zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1), zlib.compress(np.minimum(often[s:e], 65535).astype(np.uint16).tobytes(), 1)))
            ranges, steps, often = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(steps, pa.binary()), pa.array(often, pa.binary())], ["range", "steps", "often"])

        for b in it:
            held.append(_numbers(b.column(0).flatten().to_numpy(), skip))
            if sum(map(len, held)) > HELD_SHINGLES:
                yield parts()
        if held:
            yield parts()

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in it:
            for r, steps, often in zip(*(c.to_pylist() for c in b.columns)):
                at = np.cumsum(np.frombuffer(zlib.decompress(steps), np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0], dtype=np.int64)
                sums.setdefault(r, np.zeros(size, np.uint32))[at] += np.frombuffer(zlib.decompress(often), np.uint16)
        for r, n in sums.items():
            step = np.where(n < 2, n, 1 + np.ceil(2 * np.log2(np.maximum(n, 1)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([zlib.compress(step.tobytes(), 1)], pa.binary())], ["range", "steps"])

    parts = sets.select("shingles").mapInArrow(count, "range int, steps binary, often binary")
    return {r["range"]: bytes(r["steps"]) for r in parts.repartition("range").mapInArrow(total, "range int, steps binary").collect()}


def prefixes(sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """node, set, n, prefix, b0 to b3: of n shingles in order of frequency, the first ones that another text may have, and the
    parities of all shingles by their last eight bits.

    Of a set of n shingles in any one order, the first n - ceil(n * similarity) + ALIKE hold ALIKE of any similar set's first
    ones (all that both have, if those are fewer). The order is by `frequencies`, then by hash: a phrase of many texts is in
    no prefix that can do without, and most shingles of a prefix are in one text only, so they pair nothing and are left out."""
    steps = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(steps.value)
        for b in it:
            n = pc.list_value_length(b.column(2)).to_numpy().astype(np.int64)
            x = b.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            often = table[_numbers(x)]
            order = np.argsort(row * 256 + often, kind="stable")  # shingles of a row are sorted already
            least = -(-n * similar // 10_000)
            first = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(n - least + np.minimum(ALIKE, least), n)
            kept = order[first & (often[order] > 1)]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(n)))]).astype(np.int32)
            odd = np.bincount(row * 256 + (x & 255), minlength=256 * len(n)).reshape(-1, 256) & 1
            bits = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, x[kept]), *(pa.array(bits[:, i].copy()) for i in range(4))], ["node", "set", "n", "prefix", "b0", "b1", "b2", "b3"])

    return sets.mapInArrow(batches, f"node {sets.schema['node'].dataType.simpleString()}, set long, n int, prefix array<long>, b0 long, b1 long, b2 long, b3 long")


def _shared(known: DataFrame) -> DataFrame:
    """set, n, prefix, b0 to b3 of the sets whose prefixes have shingles that other prefixes have too, without the others."""
    own = known.where(F.size("prefix") > 0).select("set", "n", "prefix", "b0", "b1", "b2", "b3")
    steps = own.sparkSession.sparkContext.broadcast(frequencies(own.select(F.col("prefix").alias("shingles")), COUNTED))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(steps.value)
        for b in it:
            x = b.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy())
            kept = table[_numbers(x, COUNTED)] > 1
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, x[kept]), *b.columns[3:]], b.schema.names)

    return own.mapInArrow(batches, own.schema).where(F.size("prefix") > 0)


def _candidates(keyed: DataFrame, similar: int) -> DataFrame:
    """a, b, n: pairs of sets, once for each x that both have, whose sizes (the greater is n) and parities allow the similarity.

    keyed (x, set, n, b0 to b3) is moved once and sorted; a task takes each x with its sets by size, in bounded blocks."""

    def block(x: np.ndarray, sets: np.ndarray, n: np.ndarray, bits: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(x))
        place = np.cumsum(np.diff(x, prepend=x[:1]) != 0) << 32
        many = np.searchsorted(place + n, place + n * 10_000 // similar, "right") - at - 1  # partners of each, all after it
        ends = np.cumsum(many)
        s = 0
        while s < len(x):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + HELD_PAIRS, "right")))
            i = np.repeat(at[s:e], many[s:e])
            j = i + 1 + np.arange(len(i)) - np.repeat(ends[s:e] - many[s:e] - (ends[s] - many[s]), many[s:e])
            differ = np.zeros(len(i), np.int64)
            for v in bits:
                differ += np.bitwise_count(v[i] ^ v[j])
            near = (differ * (10_000 + similar) <= (n[i] + n[j]) * (10_000 - similar)) & (sets[i] != sets[j])
            i, j = i[near], j[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sets[i], sets[j])), pa.array(np.maximum(sets[i], sets[j])), pa.array(n[j])], ["a", "b", "n"])
            s = e

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = []  # rows of the last x so far, which may go on in the next batch
        for b in it:
            rest.append([c.to_numpy() for c in b.columns])
            if not b.num_rows or rest[0][0][0] == rest[-1][0][-1]:
                rest = rest if b.num_rows else rest[:-1]
                continue
            held = [np.concatenate(c) for c in zip(*rest)]
            end = int(np.searchsorted(held[0], held[0][-1]))
            yield from block(held[0][:end], held[1][:end], held[2][:end], [c[:end].view(np.uint64) for c in held[3:]])
            rest = [[c[end:] for c in held]]
        if rest:
            held = [np.concatenate(c) for c in zip(*rest)]
            yield from block(*held[:3], [c.view(np.uint64) for c in held[3:]])

    rows = keyed.select("x", "set", F.col("n").cast("long").alias("n"), "b0", "b1", "b2", "b3")
    return rows.repartition("x").sortWithinPartitions("x", "n").mapInArrow(batches, "a long, b long, n long")


def similar_pairs(sets: DataFrame, similar: int = SIMILAR, known: DataFrame | None = None, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """a, b, both, either: pairs of distinct sets (set, shingles) that are similar, a < b, with the sizes of their intersection and union.

    Sets are paired on the shingles of their prefixes (`known`, if those are made already), where their sizes and parities
    allow the similarity: no more parities differ than shingles do. Pairs that have ALIKE of them are checked exactly.
    Copies are one set, so a text that a third of all rows repeat is one row here. Only sets of such pairs move their
    shingles; `again` makes them for a table of nodes alone.
    """
    known = cut(prefixes(sets, similar)) if known is None else known
    least = lambda n: F.ceil(n * similar / 10_000).cast("int")
    own = _shared(known).dropDuplicates(["set"])
    found = _candidates(own.select("set", "n", "b0", "b1", "b2", "b3", F.explode("prefix").alias("x")), similar)
    found = found.groupBy("a", "b", "n").count().where(F.col("count") >= F.least(F.lit(ALIKE), least(F.col("n"))))
    found = cut(found.select("a", "b"))
    ends = broadcast_if_small(cut(found.select(F.explode(F.array("a", "b")).alias("set")).distinct()), LOOKED_UP)
    if again is not None:
        sets = again(broadcast_if_small(cut(known.join(ends, "set", "left_semi").groupBy("set").agg(F.min("node").alias("node")).select("node")), LOOKED_UP))
    whole = cut(sets.select("set", "shingles").join(ends, "set", "left_semi").dropDuplicates(["set"]))
    found = found.join(whole.toDF("a", "sa"), "a").join(whole.toDF("b", "sb"), "b")
    found = found.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
    return found.where(F.col("both") * 10_000 >= (F.col("total") - F.col("both")) * similar).select("a", "b", "both", (F.col("total") - F.col("both")).alias("either"))


def similar_classes(sets: DataFrame, similar: int = SIMILAR, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node, class, links: every text (node, set, shingles) with the smallest node of its component of similar texts and the
    number of other sets that are similar to its own; copies are in one class without links of their own."""
    known = cut(prefixes(sets, similar))
    pairs = cut(similar_pairs(sets, similar, known, again).select("a", "b"))
    ends = pairs.select(F.col("a").alias("set"), "a", "b").union(pairs.select(F.col("b").alias("set"), "a", "b"))
    keyed = ends.select("set", F.concat_ws(":", "a", "b").alias("k"))
    groups = components(keyed, "set", {"near": F.col("k")})
    links = ends.groupBy("set").agg(F.count(F.lit(1)).alias("links"))
    near = broadcast_if_small(cut(groups.join(links, "set")))
    rows = known.select("node", "set").join(near, "set", "left").select("node", F.coalesce("group", "set").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    low = rows.groupBy("g").agg(F.min("node").alias("class"))
    return rows.join(low, "g").select("node", "class", "links")


def similar_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The same of a table of texts; of those that are checked exactly, only their own texts are taken apart again."""
    return similar_classes(shingle_sets(df, key, text), again=lambda nodes: shingle_sets(df.select(key, text).join(nodes.withColumnRenamed("node", key), key, "left_semi"), key, text))


# --- leakage groups and splits -----------------------------------------------------------------------------------


def leakage_groups(feats: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, group: components over all families of features."""
    keyed = nodes.select("node").join(feats, "node", "left").select("node", F.concat_ws(":", F.when(F.col("family") == "message_id_reference", F.lit("id")).when(F.col("family") == "same_message_id", F.lit("id")).otherwise(F.col("family")), "feature").alias("k"))
    return components(keyed, "node", {"k": F.nullif(F.col("k"), F.lit(""))})


def edge_families(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """group, families: which kinds of link hold a group together."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "family").distinct()
    return ends.join(groups, "node").groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))


def group_table(groups: DataFrame, records: DataFrame) -> DataFrame:
    """group, records, anchor: size and latest eligible time of each group. `records` has node, at, eligible."""
    return groups.join(records, "node").groupBy("group").agg(F.count(F.lit(1)).alias("records"), F.max(F.when(F.col("eligible"), F.col("at"))).alias("anchor"))


def temporal_split(table: DataFrame, train: float = 0.8, validation: float = 0.1, slices: int = 512) -> DataFrame:
    """group, role: groups by time, cut where the cumulative records come closest to the shares; undated ones by hash.

    The running sum is taken in two levels (time slices, then groups within a slice), so no task holds all groups.
    """
    dated = cut(table.where("anchor is not null").withColumn("slice", F.col("anchor").cast("date")))
    per = dated.groupBy("slice").agg(F.sum("records").alias("n"))
    per = per.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("slice").orderBy("anchor", "group").rowsBetween(W.unboundedPreceding, 0)
    running = cut(dated.join(per.select("slice", "before"), "slice").withColumn("cum", F.col("before") + F.sum("records").over(inside)))
    total = running.agg(F.sum("records").alias("t"), F.count(F.lit(1)).alias("c")).first()
    if not total["c"]:
        bounds = (0, 0)
    elif total["c"] < 3:
        first = running.agg(F.min("cum")).first()[0]
        bounds = (first, first if total["c"] == 1 else total["t"])
        if total["c"] == 2:
            bounds = (first, first)
    else:
        closest = lambda frame, goal: frame.agg(F.min_by("cum", F.struct(F.abs(F.col("cum") - F.lit(goal)), "cum"))).first()[0]
        ordered = running.select("cum").orderBy("cum")
        last = running.agg(F.max("cum")).first()[0]
        second = running.where(F.col("cum") < last).agg(F.max("cum")).first()[0]
        a = closest(ordered.where(F.col("cum") < second), total["t"] * train)
        b = closest(ordered.where((F.col("cum") > a) & (F.col("cum") < last)), total["t"] * (train + validation))
        bounds = (a, b)
    role = lambda c: F.when(c <= bounds[0], "train").when(c <= bounds[1], "validation").otherwise("test")
    by_time = running.select("group", role(F.col("cum")).alias("role"))
    return by_time.union(hash_split(table.where("anchor is null"), train, validation))


def hash_split(table: DataFrame, train: float = 0.8, validation: float = 0.1, seed: str = "split") -> DataFrame:
    """group, role by a seeded hash."""
    value = T.hash_fraction(F.sha2(F.concat_ws("\u0001", F.lit(seed), F.col("group").cast("string")), 256))
    return table.select("group", F.when(value < train, "train").when(value < train + validation, "validation").otherwise("test").alias("role"))


def allocation(roles: DataFrame, table: DataFrame, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """role, groups, records, target: what each role has and should have."""
    total = table.agg(F.sum("records")).first()[0] or 0
    share = F.when(F.col("role") == "train", train).when(F.col("role") == "validation", validation).otherwise(1 - train - validation)
    return roles.join(table, "group").groupBy("role").agg(F.count(F.lit(1)).alias("groups"), F.sum("records").alias("records")).select("role", "groups", "records", F.round(F.lit(total) * share, 6).alias("target"))


def leaks(assigned: DataFrame) -> DataFrame:
    """group, roles: groups that more than one role holds; none where the split is sound. `assigned` has group, role."""
    return assigned.groupBy("group").agg(F.countDistinct("role").alias("roles")).where("roles > 1")


# --- cohorts -------------------------------------------------------------------------------------------------------


def identity_support(identities: DataFrame, assigned: DataFrame) -> DataFrame:
    """node, identity, train_groups: each identity with the number of training groups that know it."""
    joined = identities.join(assigned, "node")
    known = joined.where("role = 'train'").groupBy("identity").agg(F.countDistinct("group").alias("train_groups"))
    return identities.join(known, "identity", "left").select("node", "identity", F.coalesce("train_groups", F.lit(0)).alias("train_groups"))


def frequency(train_groups: Column) -> Column:
    return F.when(train_groups == 0, "novel").when(train_groups == 1, "tail").when(train_groups < HEAD_GROUPS, "mid").otherwise("head")


def recurrence(support: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, recurrence, identities, frequencies of every record."""
    per = support.groupBy("node").agg(F.count(F.lit(1)).alias("identities"), F.count_if(F.col("train_groups") > 0).alias("known"), F.array_join(F.array_sort(F.collect_set(frequency(F.col("train_groups")))), ",").alias("frequencies"))
    kind = F.when(F.col("identities").isNull(), "unavailable").when(F.col("known") == F.col("identities"), "all_known").when(F.col("known") == 0, "all_novel").otherwise("mixed")
    return nodes.select("node").join(per, "node", "left").select("node", kind.alias("recurrence"), F.coalesce("identities", F.lit(0)).alias("identities"), F.coalesce("frequencies", F.lit("")).alias("frequencies"))


# --- samples -------------------------------------------------------------------------------------------------------


def representatives(df: DataFrame, group: str, key: str, rank: Column) -> DataFrame:
    """The record of smallest (rank, key) of each group."""
    low = df.groupBy(group).agg(F.min(F.struct(rank.alias("rank"), F.col(key).alias(key))).alias("m"))
    return low.select(group, F.col(f"m.{key}").alias(key), F.col("m.rank").alias("rank"))


def quotas(populations: DataFrame, size: int, base: int = 0) -> DataFrame:
    """stratum, population, quota: min(base, population) each, the rest by largest remainders of what is left.

    Strata are few; the window orders them, not the records.
    """
    start = populations.select("stratum", "population", F.least(F.lit(base), F.col("population")).alias("b"))
    all_ = start.agg(F.coalesce(F.sum("population"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    rest, room = max(0, min(size, all_[0]) - all_[1]), max(1, all_[0] - all_[1])
    num = F.lit(rest) * (F.col("population") - F.col("b"))
    rows = start.withColumn("floor", F.floor(num / room)).withColumn("remainder", num % room)
    rows = rows.withColumn("residual", F.lit(rest) - F.sum("floor").over(W.partitionBy(F.lit(1))))
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("remainder"), "stratum"))
    return rows.select("stratum", "population", (F.col("b") + F.col("floor") + F.when(rank <= F.col("residual"), 1).otherwise(0)).cast("long").alias("quota"))


def stratified_sample(df: DataFrame, key: str, stratum: Column, size: int, seed: str = "sample", base: int = 0) -> DataFrame:
    """key, stratum: the records of lowest hash in each stratum, as many as its quota."""
    rows = df.select(F.col(key), stratum.alias("stratum"), F.sha2(F.concat_ws("\u0001", F.lit(seed), F.col(key).cast("string")), 256).alias("rank"))
    wanted = quotas(rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("population")), size, base)
    # no quota is above the size, so each task keeps that many rows of a stratum before the shuffle
    ranked = rows.join(F.broadcast(wanted), "stratum").withColumn("n", F.row_number().over(W.partitionBy("stratum").orderBy("rank", key)))
    return ranked.where((F.col("n") <= size) & (F.col("n") <= F.col("quota"))).select(key, "stratum")
