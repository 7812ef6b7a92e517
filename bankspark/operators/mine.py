"""Candidates for a bank from mail headers: projection, evidence, curation, funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ADDRESS = r"[\p{L}\p{N}._%+'-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*"
#: Evidence that a candidate needs, and how many may be active and draft.
LEAST_DOCUMENTS, LEAST_GROUPS, ACTIVE_CAP, DRAFT_CAP = 3, 2, 200, 400


def header_values(mail: DataFrame) -> DataFrame:
    """row_id, mailbox, at, source, value: single header values, one a row."""
    none = F.array().cast("array<string>")
    tagged = lambda name, c: F.transform(F.coalesce(c, none), lambda x: F.struct(F.lit(name).alias("source"), x.alias("value")))
    every = F.flatten(F.array(tagged("from", F.array("from")), tagged("to", F.col("to")), tagged("cc", F.col("cc")), tagged("bcc", F.col("bcc"))))
    return mail.select("row_id", "mailbox", F.col("loaded_at").alias("at"), F.explode(every).alias("v")).select("row_id", "mailbox", "at", "v.source", "v.value").where("value is not null")


def candidates(values: DataFrame) -> DataFrame:
    """Observations (kind contact, domain or display_name; candidate; row, mailbox, source, time) of header values."""
    address = F.lower(F.nullif(F.regexp_extract("value", ADDRESS, 0), F.lit("")))
    name = F.trim(F.regexp_replace(F.regexp_replace("value", rf"<[^>]*>|\[mailto:[^\]]*\]|{ADDRESS}", ""), r"""^[\s"'(]+|[\s"')]+$""", ""))
    rows = values.select("row_id", "mailbox", "at", "source", address.alias("address"), F.when(F.lower(name).rlike(r"^\p{L}[\p{L}.'-]*(?: \p{L}[\p{L}.'-]*){1,3}$"), name).alias("name"))
    kinds = F.filter(F.array(F.struct(F.lit("contact").alias("kind"), F.col("address").alias("candidate")), F.struct(F.lit("domain").alias("kind"), F.substring_index("address", "@", -1).alias("candidate")), F.struct(F.lit("display_name").alias("kind"), F.when(F.col("address").isNotNull(), F.col("name")).alias("candidate"))), lambda x: x["candidate"].isNotNull())
    return rows.select("row_id", "mailbox", "at", "source", "address", F.explode(kinds).alias("k")).select("row_id", "mailbox", "at", "source", "address", "k.kind", "k.candidate")


def evidence(observed: DataFrame) -> DataFrame:
    """kind, candidate, occurrences, documents, groups, owners, from_header, first_month, last_month."""
    return observed.groupBy("kind", "candidate").agg(
        F.count(F.lit(1)).alias("occurrences"), F.countDistinct("row_id").alias("documents"), F.countDistinct("mailbox").alias("groups"), F.countDistinct("address").alias("owners"),
        F.count_if(F.col("source") == "from").alias("from_header"), F.date_format(F.min("at"), "yyyy-MM").alias("first_month"), F.date_format(F.max("at"), "yyyy-MM").alias("last_month"),
    )


def curate(found: DataFrame, active: int = ACTIVE_CAP, draft: int = DRAFT_CAP) -> DataFrame:
    """Evidence with decision and reason: thresholds, ambiguous owners, then ranks against the caps.

    Ranks run within a kind over the candidates that pass; beyond a cap a candidate is rejected as over capacity.
    """
    reason = F.when((F.col("kind") == "display_name") & (F.col("owners") > 1), "ambiguous_owner").when(F.col("documents") < LEAST_DOCUMENTS, "few_documents").when(F.col("groups") < LEAST_GROUPS, "few_groups")
    rows = found.withColumn("why", reason)
    passed, failed = rows.where("why is null"), rows.where("why is not null")
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("groups"), F.desc("documents"), "candidate"))
    # beyond both caps the rank does not matter: each task keeps that many rows of a kind before the shuffle
    ranked = passed.select("kind", "candidate", rank.alias("n")).where(F.col("n") <= active + draft)
    decided = passed.join(ranked, ["kind", "candidate"], "left").withColumn("decision", F.when(F.col("n") <= active, "active").when(F.col("n").isNotNull(), "draft").otherwise("rejected"))
    decided = decided.withColumn("reason", F.when(F.col("decision") == "rejected", "over_capacity").otherwise("supported")).drop("n", "why")
    return decided.unionByName(failed.withColumn("decision", F.lit("rejected")).withColumnRenamed("why", "reason"))


#: The frozen policies of curation, each on top of the one before: what is active beside the curated catalog.
ITERATIONS = (("catalog", ()), ("email_fallback", ("email",)), ("phone_fallback", ("email", "phone")))
PHONE = r"(?:^|[^\d])(?:\+?\d[\d ().-]{7,}\d)(?:[^\d]|$)"


def iterations(curated: DataFrame, held_out: DataFrame) -> DataFrame:
    """iteration, labelled, found, missed, recall, fallback_hits of each policy on held-out header values (of `header_values`).

    Labelled are the values with a mail address; the catalog finds those whose address is an active contact, the e-mail
    fallback every address of its shape, the phone fallback values with a number in them, which nothing labels. The
    catalog's side of the join has one row a contact; counts of all policies come from one pass.
    """
    address = F.lower(F.nullif(F.regexp_extract("value", ADDRESS, 0), F.lit("")))
    known = curated.where("kind = 'contact' and decision = 'active'").select(F.col("candidate").alias("address"), F.lit(1).alias("known")).distinct()
    rows = held_out.select("value", address.alias("address")).join(known, "address", "left")
    n = rows.agg(F.count("address").alias("labelled"), F.count("known").alias("catalog"), F.count_if(F.col("value").rlike(PHONE)).alias("phones"))
    per = [F.struct(F.lit(i).alias("no"), F.lit(name).alias("iteration"), F.col("labelled"), (F.col("labelled") if "email" in extra else F.col("catalog")).alias("found"), (F.col("phones") if "phone" in extra else F.lit(0).cast("long")).alias("fallback_hits")) for i, (name, extra) in enumerate(ITERATIONS)]
    rows = n.select(F.explode(F.array(*per)).alias("r")).select("r.*")
    return rows.select("no", "iteration", "labelled", "found", (F.col("labelled") - F.col("found")).alias("missed"), F.round(F.try_divide("found", "labelled"), 6).alias("recall"), "fallback_hits")


def decisions(measured: DataFrame) -> DataFrame:
    """The iterations with `selected` and `reason`: fail closed.

    A fallback that hits values which nothing labels is refused; of the others the one that misses least is selected, the
    earliest of equals, and only if something was labelled. Iterations are few; the window orders them, not the corpus."""
    refused = F.col("fallback_hits") > 0
    best = F.min(F.when(~refused & (F.col("labelled") > 0), F.struct("missed", "no"))).over(W.partitionBy(F.lit(1)))
    rows = measured.withColumn("best", best)
    selected = F.coalesce(F.col("no") == F.col("best.no"), F.lit(False))
    reason = F.when(F.col("labelled") == 0, "nothing_labelled").when(refused, "no_negative_evidence").when(selected, "fewest_misses").otherwise("superseded")
    return rows.select("iteration", "labelled", "found", "missed", "recall", "fallback_hits", selected.alias("selected"), reason.alias("reason"))


def priorities(curated: DataFrame, base: int = 20_000) -> DataFrame:
    """kind, candidate, priority of active candidates: longest first, then by groups and value."""
    order = W.partitionBy("kind").orderBy(F.desc(F.length("candidate")), F.desc("groups"), "candidate")
    return curated.where("decision = 'active'").select("kind", "candidate", (F.row_number().over(order) + base - 1).cast("long").alias("priority"))


def funnel(curated: DataFrame) -> DataFrame:
    """level, kind, decision, reason, candidates: by decision, by kind and by reason, and all."""
    sets = curated.groupingSets([("decision",), ("kind",), ("reason",), ()], "decision", "kind", "reason").agg(F.count(F.lit(1)).alias("candidates"), F.grouping_id("decision", "kind", "reason").alias("level"))
    return sets.select("level", "kind", "decision", "reason", "candidates")


def compatible(name: Column, address: Column) -> Column:
    """Whether a display name fits an address: a name part, the parts together, or initial and part."""
    local = F.regexp_replace(F.lower(F.substring_index(address, "@", 1)), r"[^\p{L}]", "")
    words = F.filter(F.split(F.lower(name), r"[^\p{L}]+"), lambda w: w != "")
    part = F.exists(words, lambda w: (F.length(w) > 2) & F.contains(local, w))
    return part | (local == F.array_join(words, "")) | (local == F.concat(F.substring(F.try_element_at(words, F.lit(1)), 1, 1), F.try_element_at(words, F.lit(-1))))


def sender_aliases(mail: DataFrame) -> DataFrame:
    """row_id, address, alias: names read from the sender's address that stand in the last twelve lines of the own text.

    Only senders without a display name count, with two to four parts of two or more letters before the @.
    """
    address = F.lower(F.nullif(F.regexp_extract("from", ADDRESS, 0), F.lit("")))
    bare = F.trim("from") == F.regexp_extract("from", ADDRESS, 0)
    parts = F.filter(F.split(F.substring_index("address", "@", 1), r"[._-]+"), lambda p: p != "")
    rows = mail.where(bare).select("row_id", address.alias("address"), "body").where("address is not null and body is not null").withColumn("parts", parts)
    rows = rows.where((F.size("parts") >= 2) & (F.size("parts") <= 4) & F.forall("parts", lambda p: p.rlike("^[a-z]{2,}$")))
    own = F.split(F.substring_index("body", "\n>", 1), "\n")
    tail = F.array_join(F.slice(own, F.greatest(F.size(own) - 11, F.lit(1)), F.lit(12)), "\n")
    pattern = F.concat(F.lit(r"(?i)(?<!\w)("), F.array_join("parts", r"\s+"), F.lit(r")(?!\w)"))
    found = rows.select("row_id", "address", F.call_function("regexp_extract", tail, pattern, F.lit(1)).alias("alias"))
    return found.where("alias <> ''")
