"""Variant spellings of names: all spellings of one correspondent linked, different ones apart.

Method: metric-space partitioning. Every spelling becomes a set of folded names (given, family, firm). All distinct
names are assigned to their nearest pivot by edit distance and replicated to every pivot that is at most twice the
radius further away (by the triangle inequality no pair within the radius is lost). A pivot's cell is split further
by segments: of three segments of a name, two errors leave one as it is, so names within the radius share one at
nearly the same place. Inside each cell an exact radius join with the true edit metric runs. What is joined is kept if
it is one typing error (a letter more, less or other, two swapped) and not two names that addresses or many partners
confirm as names of their own. Two spellings are one correspondent if each of their names is equal or has one such
error, so both names may be mistyped. Equal names, addresses with names that agree, initials and nicknames with only
one bearer add links; connected components are the correspondents.

Scale: work is on distinct spellings, the metric join on distinct names; their number sets the number of pivots (at
most MOST_PIVOTS strings with the smallest hashes are collected). A name that many spellings have is one name in the
join, and the tables that bring it back to spellings are equi joins on the whole name.

Defined results: null, blank and address-only values have no spelling; one spelling alone gives no pair; the
same spelling under two correspondents is one spelling; repeated rows change nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bankspark.llm.splits import components
from bankspark.operators.split_values import values_of
from bankspark.runtime import cut

RADIUS, LEAST_PART, SEGMENTS = 2, 3, 3
#: Names a pivot, by their square root, and the most pivots.
PER_PIVOT, MOST_PIVOTS = 16, 128
#: Parts that a part stands with before it is taken for a name of its own, and how many times fewer than its neighbour's make it an error.
PARTNERS, FEWER = 4, 8
ADDRESS = r"[\p{L}\p{N}._%+'&=/~-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*"
#: Nicknames and the given names they may stand for.
NICKNAMES = {
    k: v.split()
    for k, v in {
        "abby": "abigail", "al": "albert alan alfred", "alex": "alexander alexandra alexis", "andy": "andrew", "barb": "barbara", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "bert": "albert herbert",
        "bess": "elizabeth", "beth": "elizabeth bethany", "bill": "william", "bob": "robert", "cathy": "catherine", "charlie": "charles charlotte", "chris": "christopher christine christina", "dan": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah",
        "dick": "richard", "dima": "dmitri", "dot": "dorothea dorothy", "dottie": "dorothea dorothy", "ed": "edward edgar edmund", "eddie": "edward", "ellie": "eleanor", "essie": "esther", "fran": "francesca frances", "frankie": "francesca frances", "fred": "frederick", "freddie": "frederick",
        "gabi": "gabriela gabriele", "gabby": "gabriela", "greg": "gregory", "hal": "harold henry", "harry": "harold henry", "hetty": "henrietta", "izzy": "isabella", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jim": "james", "joe": "joseph", "joey": "joseph",
        "jo": "josephine joanna", "josie": "josephine", "johnny": "jonathan john", "jon": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "liz": "elizabeth", "lottie": "charlotte", "lou": "louis louise", "lucy": "lucia",
        "maggie": "margaret", "matt": "matthew", "max": "maximilian maxwell", "meg": "margaret", "mick": "michael", "mike": "michael", "nat": "natalia nathaniel", "natasha": "natalia", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "nora": "eleanor", "ollie": "oliver", "pam": "pamela",
        "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pete": "peter", "phil": "philip philippa", "pip": "philippa philip", "quin": "quentin", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel samantha", "seb": "sebastian", "steve": "stephen",
        "sue": "susannah susan", "susie": "susannah susan", "ted": "theodore edward", "terry": "terence theresa", "theo": "theodore", "thea": "dorothea theodora", "tim": "timothy", "tina": "christina", "tom": "thomas", "tony": "anthony", "tricia": "patricia", "trish": "patricia", "vic": "victor victoria", "vicky": "victoria",
        "wally": "walter", "walt": "walter", "will": "william", "zach": "zachary", "zack": "zachary", "bastian": "sebastian", "kim": "kimberly", "gus": "august augustus", "wes": "wesley", "hank": "henry", "jack": "john", "cindy": "cynthia", "sandy": "alexandra sandra alexander", "xen": "xenia",
    }.items()
}
TITLES = set("dr mr mrs ms miss prof sir dipl ing jr sr ii iii iv phd md esq".split())
#: Abbreviated words of firms; legal forms.
FIRM_WORDS = {"intl": "international", "svcs": "services", "svc": "service", "serv": "services", "ptnrs": "partners", "assoc": "association", "assn": "association", "exch": "exchange", "dept": "department", "mfg": "manufacturing", "log": "logistics", "logs": "logistics", "eng": "engineering", "engrg": "engineering", "mgmt": "management", "mgt": "management", "auth": "authority", "bros": "brothers", "ins": "insurance", "tech": "technology", "grp": "group", "natl": "national", "univ": "university", "sup": "supply", "stor": "storage", "brk": "brokers", "corp": "corporation", "cr": "credit"}
LEGAL = set("inc llc llp ltd limited co company corporation plc gmbh ag sa the and".split())
FIRM = set(FIRM_WORDS.values()) | set("services service partners freight grid marine power gas grain rail timber steel pipeline brokers board group lines legal credit port supply storage yard desk trading energy".split())


#: Words of firms without their vowels.
SKELETONS = {w[0] + "".join(c for c in w[1:] if c not in "aeiou"): w for w in sorted(FIRM)}


def parts_of(spelling: str) -> tuple[str, list[str], list[str]]:
    """(kind, parts, alternatives): kind is person, initial, nick, firm or other; alternatives are given names a nickname may mean."""
    text = re.sub(r"\s*/\s*\w+$", "", spelling)
    text = re.sub(r"(?<=[^\W\d_])['’](?=[^\W\d_]\b)", "", text)
    text = re.sub(r"([^\W\d_A-Z])([A-Z])", r"\1 \2", text) if " " not in text.strip() else text
    folded = "".join(FOLD.get(c, c) for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    words = [w for w in re.findall(r"[^\W\d_]+", folded) if w not in TITLES]
    full = [w for w in words if len(w) > 1]
    expanded = [FIRM_WORDS.get(w) or SKELETONS.get(w, w) for w in full]
    if any(w in FIRM or w in LEGAL for w in expanded):
        kept = [w for w in expanded if w not in LEGAL] or expanded
        return "firm", kept, []
    initials = [w for w in words if len(w) == 1]
    if len(full) == 2:
        for i in (0, 1):
            formal = NICKNAMES.get(full[i], [])
            if len(formal) == 1:
                full = [formal[0], full[1 - i]]
                break
            if formal:
                return "nick", [full[1 - i]], [*formal, full[i]]
        return "person", sorted(full), []
    if len(full) == 1 and initials:
        return "initial", full, initials[:1]
    if len(full) > 2:  # several given names, or particles before the family name
        return "person", sorted(full), []
    return "other", full, []


FOLD = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "Ae", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "œ": "oe"}


def spelling_of(value: Column) -> Column:
    """The value without address, its brackets and one pair of outer quotes; null if nothing is left."""
    has = value.rlike(ADDRESS)
    bare = F.regexp_replace(value, rf"<\s*(?:mailto:)?{ADDRESS}\s*>|\[\s*mailto:{ADDRESS}\s*\]|\(\s*(?:mailto:)?{ADDRESS}\s*\)|\[\s*{ADDRESS}\s*\]", "")
    bare = F.regexp_replace(bare, ADDRESS, "")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    bare = F.when(has, F.regexp_replace(bare, r"^(?:\((.*)\)|\[(.*)\])$", "$1$2")).otherwise(bare)
    bare = F.regexp_replace(bare, r"""^(?:"(.*)"|'(.*)')$""", "$1$2")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    return F.when(bare.rlike(r"[\p{L}\p{N}]"), bare)


def spellings(df: DataFrame, one: str, many: str) -> DataFrame:
    """spelling, address, n: the distinct spellings of a column of one value and a column of packed ones."""
    # equal elements first, so that each is taken apart once
    single = df.select(F.explode(F.concat(F.array(F.struct(F.col(f"`{one}`").alias("v"), F.lit(False).alias("packed"))), F.transform(F.coalesce(F.col(f"`{many}`"), F.array().cast("array<string>")), lambda x: F.struct(x.alias("v"), F.lit(True).alias("packed"))))).alias("e"))
    single = single.select("e.*").where("v is not null").groupBy("v", "packed").count()
    rows = single.select(F.explode(F.when(F.col("packed"), values_of(F.col("v"))).otherwise(F.array("v"))).alias("v"), "count")
    rows = rows.select(spelling_of(F.col("v")).alias("spelling"), F.lower(F.nullif(F.regexp_extract("v", ADDRESS, 0), F.lit(""))).alias("address"), "count")
    return rows.where("spelling is not null").groupBy("spelling", "address").agg(F.sum("count").alias("n"))


def _take_apart(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        made = [parts_of(s) for s in b.column(0).to_pylist()]
        lists = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], lists), pa.array([m[2] for m in made], lists)], ["spelling", "kind", "parts", "alternatives"])


def segment(name: Column, size: Column, i: Column, shift: Column, own: Column) -> Column:
    """Key of the i-th of SEGMENTS segments of a name of `size` letters, read `shift` letters further on in this name; null beyond its ends."""
    start, end = F.floor(i * size / SEGMENTS).cast("int"), F.floor((i + 1) * size / SEGMENTS).cast("int")
    inside = (start + shift >= 0) & (end + shift <= own) & (size >= SEGMENTS)
    return F.when(inside, F.concat_ws(":", size.cast("string"), i.cast("string"), F.substring(name, start + shift + 1, end - start)))


#: (letters that the other name has less, segment, places it stands further on): all that at most RADIUS errors can do to it.
SHIFTS = [(less, i, shift) for less in range(RADIUS + 1) for i in range(SEGMENTS) for shift in range(-RADIUS, RADIUS + 1) if abs(shift) + abs(less - shift) <= RADIUS]


def radius_join(names: DataFrame) -> DataFrame:
    """x, y: pairs of the distinct names of the column `name` with an edit distance of at most RADIUS, x < y.

    Names have SEGMENTS letters or more. Of a pair the shorter name is looked up in the home cell."""
    n = names.count()
    pivots = [r[0] for r in names.orderBy(F.xxhash64("name"), "name").limit(min(MOST_PIVOTS, max(1, round(n**0.5 / PER_PIVOT)))).collect()]
    if not pivots:
        return names.select(F.col("name").alias("x"), F.col("name").alias("y")).limit(0)
    far = F.array(*[F.struct(F.levenshtein("name", F.lit(p)).alias("d"), F.lit(i).alias("p")) for i, p in enumerate(pivots)])
    rows = names.select("name", F.length("name").alias("size"), far.alias("far")).withColumn("home", F.array_min("far"))
    own = F.array(*[segment(F.col("name"), F.col("size"), F.lit(i), F.lit(0), F.col("size")) for i in range(SEGMENTS)])
    home = rows.select(F.col("name").alias("x"), F.col("size").alias("m"), F.col("home.p").alias("p"), F.col("home.d").alias("ring"), F.explode(own).alias("cell")).where("cell is not null")
    cells = F.filter("far", lambda f: f["d"] <= F.col("home.d") + 2 * RADIUS)
    seen = F.array_distinct(F.array(*[segment(F.col("name"), F.col("size") - less, F.lit(i), F.lit(shift), F.col("size")) for less, i, shift in SHIFTS]))
    all_of = rows.select(F.col("name").alias("y"), "size", F.explode(cells).alias("c"), seen.alias("seen")).select("y", "size", F.col("c.p").alias("p"), F.col("c.d").alias("d"), F.explode("seen").alias("cell")).where("cell is not null")
    pairs = home.join(all_of, ["p", "cell"]).where((F.col("x") != F.col("y")) & (F.abs(F.col("ring") - F.col("d")) <= RADIUS))
    pairs = pairs.where(F.levenshtein("x", "y", RADIUS) >= 0)
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def one_error(x: Column, y: Column) -> Column:
    """One letter more, less or other, or two swapped."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    d = F.levenshtein(x, y)
    return (d == 1) | ((d == 2) & (F.length(x) == F.length(y)) & (letters(x) == letters(y)))


def link(df: DataFrame, one: str, many: str) -> DataFrame:
    """spelling, entity: every distinct spelling with the smallest spelling of its correspondent."""
    seen = cut(spellings(df, one, many))
    names = cut(seen.select("spelling").distinct().mapInArrow(_take_apart, "spelling string, kind string, parts array<string>, alternatives array<string>"))
    key = F.concat_ws(" ", F.array_sort("parts"))
    exact = names.where("kind in ('person', 'firm')").select("spelling", F.concat_ws("|", "kind", key).alias("k"))
    joined = names.where("kind = 'firm'").select("spelling", F.concat(F.lit("joined|"), F.concat_ws("", "parts")).alias("k"))

    # parts that addresses confirm, and given names by their partners
    local = F.regexp_replace(F.substring_index("address", "@", 1), r"[^\p{L}]", "")
    at = cut(seen.where("address is not null").join(names, "spelling").select("spelling", "address", "n", "kind", "parts"))
    confirmed = at.where("kind in ('person', 'firm')").select(F.explode("parts").alias("part"), local.alias("local")).where(F.expr("contains(local, part)")).select("part")
    persons = names.where("kind = 'person' and size(parts) = 2").select(F.col("parts")[0].alias("a"), F.col("parts")[1].alias("b")).distinct()
    both = cut(persons.union(persons.select("b", "a")))
    partners = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select(F.col("a").alias("part"), "n")
    known = partners.join(confirmed.distinct().withColumn("c", F.lit(True)), "part", "left").select("part", "n", F.coalesce("c", F.lit(False)).alias("c"))

    # one radius join over the names of persons and, with their words put together, of firms
    firms = names.where("kind = 'firm'").select("spelling", "parts", key.alias("whole"), F.concat_ws("", F.array_sort("parts")).alias("glued"))
    vocabulary = both.select(F.col("a").alias("name")).union(firms.select("glued")).where(F.length("name") >= LEAST_PART).distinct()
    near = cut(radius_join(cut(vocabulary)).where(one_error(F.col("x"), F.col("y"))))

    # typing errors in one name of a person, or in both
    own = lambda c, n, other: F.col(c) | ((F.col(n) >= PARTNERS) & (F.col(n) * FEWER > F.col(other)))
    parts = near.join(known.toDF("x", "nx", "cx"), "x").join(known.toDF("y", "ny", "cy"), "y").select("x", "y", own("cx", "nx", "ny").alias("sx"), own("cy", "ny", "nx").alias("sy")).where("not (sx and sy)")
    parts = cut(parts.union(parts.select("y", "x", "sy", "sx")))
    name = lambda p, q: F.concat_ws(" ", F.array_sort(F.array(p, q)))
    one_off = both.toDF("anchor", "x").join(parts, "x").join(both.toDF("anchor", "y"), ["anchor", "y"])
    one_off = one_off.select(name("anchor", "x").alias("k"), name("anchor", "y").alias("other"), F.col("anchor"), F.col("x").alias("part"), F.col("sy").alias("s"))
    # an unconfirmed name with two confirmed neighbours says nothing
    torn = one_off.groupBy("anchor", "part").agg(F.count_if("s").alias("torn")).where("torn > 1").select("anchor", "part")
    sound = one_off.join(torn, ["anchor", "part"], "left_anti").select("k", "other")
    one_off = cut(sound.join(sound.toDF("other", "k"), ["k", "other"], "left_semi").distinct())
    two_off = persons.toDF("x", "u").join(parts, "x").join(parts.toDF("u", "v", "su", "sv"), "u").join(both.toDF("y", "v"), ["y", "v"])
    two_off = two_off.select(name("x", "u").alias("k"), name("y", "v").alias("other"), (F.col("sy") & F.col("sv")).alias("s")).distinct()
    lonely = two_off.join(one_off.select("k").distinct(), "k", "left_anti").withColumn("n", F.lit(1))
    single = lonely.groupBy("k").agg(F.count_if("s").alias("n")).where("n <= 1").select("k")
    two_off = lonely.join(single, "k", "left_semi").select("k", "other")
    links = one_off.union(two_off).select(F.explode(F.array("k", "other")).alias("name"), F.concat_ws("|", F.lit("near"), F.least("k", "other"), F.greatest("k", "other")).alias("k"))
    errors = exact.join(links.select(F.concat(F.lit("person|"), "name").alias("exact"), F.col("k").alias("link")).distinct(), exact["k"] == F.col("exact")).select("spelling", F.col("link").alias("k"))

    # typing errors in a firm; firms whose words are those of another and more
    off = near.select(F.explode(F.array("x", "y")).alias("glued"), F.concat_ws("|", F.lit("firm"), "x", "y").alias("k"))
    off = firms.select("spelling", "glued").join(off, "glued").select("spelling", "k")
    longer = firms.where("size(parts) >= 3").select("spelling", F.concat_ws(" ", F.array_sort(F.slice("parts", 1, 2))).alias("k"))
    shorter = firms.where("size(parts) = 2").select(F.col("whole").alias("k")).distinct()
    heads = longer.join(shorter, "k").select("spelling", F.concat(F.lit("firm|"), "k").alias("k"))

    # one address, if the names agree with the one most often shown there
    top = at.groupBy("address").agg(F.max_by(F.col("parts"), F.struct(F.col("kind").isin("person", "firm"), "n", "spelling")).alias("lead"))
    at = at.join(top, "address")
    agree = F.exists("parts", lambda p: F.exists("lead", lambda q: one_error(p, q) | (p == q)))
    same = at.where(agree).select("spelling", F.concat(F.lit("at|"), F.col("address")).alias("k"))

    keys = cut(exact.union(joined).union(errors).union(off).union(heads).union(same).distinct())
    first = cut(_clusters(names, keys))

    # initials and nicknames: the only correspondent of that family whose given name fits
    full = names.where("kind = 'person' and size(parts) = 2").join(first, "spelling").select("entity", F.explode(F.array(F.struct(F.col("parts")[0].alias("given"), F.col("parts")[1].alias("family")), F.struct(F.col("parts")[1].alias("given"), F.col("parts")[0].alias("family")))).alias("n"))
    full = cut(full.select("entity", "n.given", "n.family").distinct())
    short = names.where("kind in ('initial', 'nick')").select("spelling", "kind", F.col("parts")[0].alias("family"), "alternatives")
    fits = F.when(F.col("kind") == "nick", F.array_contains("alternatives", F.col("given"))).otherwise(F.col("given").startswith(F.col("alternatives")[0]))
    fitting = cut(short.join(full, "family").where(fits).select("spelling", "entity").distinct())
    bearers = fitting.groupBy("spelling").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("entity")).where("n = 1")
    # a nickname before a family name with a typing error
    unknown = short.where("kind = 'nick'").join(bearers.select("spelling"), "spelling", "left_anti").select("spelling", F.col("family").alias("typed"), F.explode("alternatives").alias("given"))
    bent = unknown.join(full, "given").where(one_error(F.col("typed"), F.col("family")) & (F.length("typed") >= LEAST_PART))
    bent = bent.groupBy("spelling").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("entity")).where("n = 1")
    bearers = cut(bearers.union(bent.select(*bearers.columns)))
    # short forms alike, without a full one
    alike = short.where("kind = 'initial'").join(bearers.select("spelling"), "spelling", "left_anti").join(fitting.select("spelling").distinct(), "spelling", "left_anti")
    alike = alike.select("spelling", F.concat_ws("|", F.lit("initial"), "family", F.col("alternatives")[0]).alias("k"))
    # correspondents, not spellings, are joined now: only those that a short form touches
    more = bearers.select("spelling", F.concat(F.lit("short|"), "entity").alias("k")).union(alike).join(first, "spelling").select("entity", "k")
    more = more.union(bearers.select("entity", F.concat(F.lit("short|"), "entity").alias("k"))).distinct()
    merged = components(cut(more), "entity", {"link": F.col("k")}).withColumnRenamed("group", "whole")
    return first.join(merged, "entity", "left").select("spelling", F.coalesce("whole", "entity").alias("entity"))


def _clusters(names: DataFrame, keys: DataFrame) -> DataFrame:
    linked = components(names.select("spelling").join(keys, "spelling", "left"), "spelling", {"link": F.col("k")})
    return linked.withColumnRenamed("group", "entity")


def pairs(df: DataFrame, one: str, many: str) -> DataFrame:
    """name_a, name_b: each pair of spellings of one correspondent, smaller first."""
    linked = cut(link(df, one, many))
    other = linked.select("entity", F.col("spelling").alias("name_b"))
    return linked.select("entity", F.col("spelling").alias("name_a")).join(other, "entity").where("name_a < name_b").select("name_a", "name_b")
