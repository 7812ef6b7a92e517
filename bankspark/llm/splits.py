"""Train, validation and test splits that keep related records together.

Method: rows that share a key (sender, thread, message) are one component. Each key hooks its rows to its
smallest row, which leaves a graph over those smallest rows only; then parallel rounds over joined parent
tables follow: every node hooks to its smallest neighbour, parents are shortcut until they are roots, and the
edges are contracted to edges between roots. Rounds end when no edge is left; each works on what the one before
left over. For the splits, bitsets of reachable subset sums over (size, multiplicity) choose how many
components of each size a split takes so that its total is closest to its share.

Scale: keys travel as 16-byte digests; minima are combined before each shuffle, so a key or root held by a
third of all rows sends one row a task; joins against it are equi joins whose other side has one row a key,
which adaptive execution splits. Only the (size, multiplicity) table goes to the driver: at most
sqrt(2 * rows) rows. Lineage is cut with checkpoints in the shared folder.

Defined results: null and blank keys link nothing; a row without keys is its own group; repeated ids are one
row; a null id has a null group; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from bankspark.operators.components import components  # noqa: F401
from bankspark.runtime import cut

#: Bits of the reachable-sum sets: above so many rows sums are counted in units of rows / UNITS, and what that leaves open is
#: filled up or taken back in single rows with the sizes at hand; it stays open only where no size fits it.
UNITS = 1 << 18
#: Slices of one size among which its components are ranked.
SLICES = 1024


def address_key(sender: Column) -> Column:
    """The mail address of a sender, without case; null without one."""
    found = F.regexp_extract(F.lower(sender), r"([\p{L}\p{N}._%+'&=/~-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*)", 1)
    return F.nullif(F.regexp_replace(found, r"^['.]+", ""), F.lit(""))


def thread_key(subject: Column) -> Column:
    """The subject as written without leading Re, Fw, Fwd, without case and spacing."""
    bare = F.regexp_replace(subject, r"(?i)^(?:[\s ]*(?:re|fwd|fw)\s*(?:\[\s*\d+\s*\])?\s*:)+", "")
    return F.nullif(F.lower(F.regexp_replace(bare, r"[\s  -  　]+", "")), F.lit(""))


def message_key(message_id: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(message_id, r"[\s<>()\[\] ]+", "")), F.lit(""))


def choose(multiplicity: dict[int, int], share: float) -> dict[int, int]:
    """size -> how many components of it, so that their rows are closest to the share of all rows."""
    total = sum(s * m for s, m in multiplicity.items())
    unit = max(1, -(-total // UNITS))
    goal = round(total * share / unit)
    steps: list[tuple[int, int, int]] = []  # (size, components in the lump, reachable sums before it)
    reach, mask = 1, (1 << 2 * goal + 2) - 1
    for size, m in sorted(multiplicity.items(), reverse=True):
        lump = 1
        while m > 0:
            n = min(lump, m)
            steps.append((size, n, reach))
            reach |= (reach << max(1, round(size * n / unit))) & mask
            m, lump = m - n, lump * 2
    best = next(x for d in range(goal + 2) for x in (goal - d, goal + d) if x >= 0 and reach >> x & 1)
    taken: dict[int, int] = {}
    for size, n, before in reversed(steps):
        if not before >> best & 1:
            best -= max(1, round(size * n / unit))
            taken[size] = taken.get(size, 0) + n
    return taken if unit == 1 else filled(multiplicity, taken, round(total * share))


def filled(multiplicity: dict[int, int], taken: dict[int, int], goal: int) -> dict[int, int]:
    """`taken` with components put in or taken back, largest first, until no size is nearer to the goal."""
    out = dict(taken)
    open_ = goal - sum(s * n for s, n in out.items())
    for size in sorted(multiplicity, reverse=True):
        if open_ < 0:
            n = min(out.get(size, 0), -open_ // size)
            out[size], open_ = out.get(size, 0) - n, open_ + n * size
    for size in sorted(multiplicity, reverse=True):
        if open_ > 0:
            n = min(multiplicity[size] - out.get(size, 0), open_ // size)
            out[size], open_ = out.get(size, 0) + n, open_ - n * size
    return {s: n for s, n in out.items() if n}


def assign(groups: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """key, group, split: whole groups to splits of the given shares; the first split gets what the others leave."""
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    sizes = cut(sizes.withColumn("slice", F.pmod(F.xxhash64("group"), F.lit(SLICES))))
    left = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds, names = [], list(shares)
    begin = dict.fromkeys(left, 0)
    whole = sum(s * m for s, m in left.items())
    for name in names[1:]:
        rest = sum(s * m for s, m in left.items())
        for size, n in choose(left, shares[name] * whole / max(1, rest)).items():
            bounds.append((size, begin[size], begin[size] + n, name))
            begin[size] += n
            left[size] -= n
    spark = groups.sparkSession
    # rank within a size: slices of it are counted first, so no task sorts a whole size
    slices = sizes.groupBy("size", "slice").count()
    slices = slices.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("size", "slice").orderBy("group")) - 1
    ranked = sizes.withColumn("inside", inside).join(slices.drop("count"), ["size", "slice"]).select("group", "size", (F.col("before") + F.col("inside")).alias("rank"))
    rules = spark.createDataFrame(bounds, "size long, low long, high long, split string")
    named = ranked.join(rules, "size", "left").groupBy("group").agg(F.max(F.when((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), F.col("split"))).alias("split"))
    return groups.join(named, "group").select(key, "group", F.coalesce("split", F.lit(names[0])).alias("split"))
