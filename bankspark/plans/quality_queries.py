"""Queries of rewriting, evaluation, mining, statistics and streams, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark.functions import stats as S
from bankspark.functions.text import hash_fraction, redaction_token
from bankspark.operators import mine as M
from bankspark.operators import quality as Q
from bankspark.operators import rewrite as R
from bankspark.operators import scan as scans
from bankspark.plans.bank_queries import CLEAN, DETECTORS, REC, _documents, _patterns, _records
from bankspark.runtime import cut, table
from bankspark.sources.tables import load_detectors

EVAL = DETECTORS.replace("FROM documents JOIN", "FROM (SELECT eval_id AS doc_id, text FROM eval_records WHERE text IS NOT NULL) JOIN")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-overlapping records of the documents, in characters."""
    return R.without_overlap(scans.scan(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir), offsets="char"), "doc_id")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected matches of the evaluation records, in bytes."""
    rows = table(spark, sf_dir, "eval_records").where("type = 'positive'").select(F.col("eval_id").alias("document"), "suite", F.explode("matches").alias("m"))
    return rows.select("document", "suite", "m.entity_id", "m.name_id", "m.pattern_id", "m.string", "m.start", "m.end")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "eval_records").where("text is not null").select("eval_id", "text")
    return scans.scan(texts, "eval_id", "text", load_detectors(spark, sf_dir)).withColumnRenamed("eval_id", "document").select("document", "entity_id", "name_id", "pattern_id", "string", "start", "end")


# --- rewriting ---------------------------------------------------------------------------------------------------


def redaction_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the names of each entity in order of first appearance."""
    spans = _spans(spark, sf_dir)
    names = spans.withColumn("assignment_key", R.assignment_key()).select("assignment_key", "name_id").distinct()
    return R.redaction_ordinals(spans, "doc_id").join(names, "assignment_key").select("entity_id", "name_id", "ordinal", "token")


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spans = cut(_spans(spark, sf_dir).withColumn("assignment_key", R.assignment_key()))
    tokens = R.redaction_ordinals(spans.drop("assignment_key"), "doc_id")
    return spans.join(tokens.select("assignment_key", "token"), "assignment_key").select("doc_id", "start", "end", "string", F.col("token").alias("replacement")), tokens


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every kept record replaced by its token."""
    return R.apply_edits(_documents(spark, sf_dir), _edits(spark, sf_dir)[0], "doc_id", "text")


def shifted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shifted_spans(_edits(spark, sf_dir)[0], "doc_id").select("doc_id", "start", "end", "new_start", "new_end")


def pseudonym_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to suppliers in order of first appearance."""
    spans = cut(_spans(spark, sf_dir))
    names = spans.withColumn("assignment_key", R.assignment_key()).select("assignment_key", "name_id").distinct()
    candidates = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("value"))
    return R.pseudonyms(spans, "doc_id", candidates).join(names, "assignment_key").select("name_id", "candidate_id", "value")


def restore_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents redacted by surface and restored again."""
    spans = cut(_spans(spark, sf_dir).withColumn("assignment_key", R.assignment_key("surface")))
    tokens = R.redaction_ordinals(spans.drop("assignment_key"), "doc_id", "surface")
    known = cut(spans.select("assignment_key", F.col("string").alias("original")).distinct().join(tokens, "assignment_key"))
    edits = spans.join(known.select("assignment_key", "token"), "assignment_key").select("doc_id", "start", "end", F.col("token").alias("replacement"))
    redacted = R.apply_edits(_documents(spark, sf_dir), edits, "doc_id", "text")
    return R.restore(redacted, known, "doc_id", "text")


def ambiguous_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a template without numbers would give to several names: they could not be put back."""
    tokens = _edits(spark, sf_dir)[1]
    return R.ambiguous_tokens(tokens.withColumn("token", redaction_token("[{ENTITY}]", F.col("entity_id"), F.col("ordinal"))))


# --- evaluation --------------------------------------------------------------------------------------------------


def eval_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive records: whether the expected and the found matches of the expected names are the same list."""
    span = F.struct("string", "start", "end", "name_id")
    gold = _gold(spark, sf_dir)
    want = gold.groupBy("document", "suite").agg(F.array_sort(F.collect_list(span)).alias("want"))
    have = _predicted(spark, sf_dir).join(gold.select("document", "entity_id", "name_id").distinct(), ["document", "entity_id", "name_id"], "left_semi").groupBy("document").agg(F.array_sort(F.collect_list(span)).alias("have"))
    both = want.join(have, "document", "left")
    return both.select(F.col("document").alias("eval_id"), "suite", F.size("want").alias("expected"), F.coalesce(F.size("have"), F.lit(0)).alias("found"), F.coalesce(F.col("want") == F.col("have"), F.lit(False)).alias("passed"))


def eval_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative records without any match."""
    rows = table(spark, sf_dir, "eval_records").where("type = 'negative'").select(F.col("eval_id").alias("document"), "suite")
    return rows.join(_predicted(spark, sf_dir), "document", "left_anti").withColumnRenamed("document", "eval_id")


def eval_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected matches and how many were found exactly: in all, by entity, name and pattern."""
    rows = Q.exact_matches(_gold(spark, sf_dir), _predicted(spark, sf_dir))
    sets = [("entity_id", "name_id", "pattern_id"), ("entity_id", "name_id"), ("entity_id",), ()]
    out = rows.groupingSets(sets, "entity_id", "name_id", "pattern_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if("same_identity").alias("matched"), F.grouping_id("entity_id", "name_id", "pattern_id").alias("level"))
    return out.where("expected > 0")


def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_records").where("type = 'provenance'").rollup("source_type").agg(F.count(F.lit(1)).alias("records"), F.grouping_id().alias("level"))


def eval_record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with members of the wrong type or spans that do not hold their string, by origin and rule: the stored records,
    and copies of them with a letter put before the text and positive and negative turned round, which break every rule."""
    rows = table(spark, sf_dir, "eval_records").select("type", "text", "matches")
    turned = F.when(F.col("type") == "positive", "negative").when(F.col("type") == "negative", "positive").otherwise("provenance")
    broken = rows.select(turned.alias("type"), F.concat(F.lit("x"), F.coalesce("text", F.lit(""))).alias("text"), "matches")
    rows = rows.withColumn("origin", F.lit("stored")).union(broken.withColumn("origin", F.lit("broken")))
    held = lambda m: F.decode(F.substring(F.encode("text", "UTF-8"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")), "UTF-8") == m["string"]
    rules = {
        "no_matches": (F.col("type") == "positive") & F.col("matches").isNull(),
        "matches": (F.col("type") == "negative") & F.col("matches").isNotNull(),
        "text": (F.col("type") == "provenance") & F.col("text").isNotNull(),
        "span": F.exists(F.coalesce("matches", F.array().cast(rows.schema["matches"].dataType)), lambda m: ~held(m)),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select("origin", F.explode(found).alias("rule")).groupBy("origin", "rule").agg(F.count(F.lit(1)).alias("records"))


def gold_pred_exact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.exact_matches(_gold(spark, sf_dir), _predicted(spark, sf_dir))


def overlap_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.overlap_pairs(_gold(spark, sf_dir).select("document", "entity_id", "start", "end"), _predicted(spark, sf_dir))


def interval_union_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged length of the span records of each document."""
    return Q.union_length(_records(spark, sf_dir).where("offset_unit = 'byte'").select("document_id", "start", "end"), ["document_id"])


def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that each user's events cover when an event lasts one hour."""
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    rows = table(spark, sf_dir, "events").where("ts is not null and user_id is not null").select("user_id", hour.alias("start"), (hour + 2).alias("end"))
    return Q.union_length(rows, ["user_id"])


def quality_slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the bank on each suite."""
    gold, found = cut(_gold(spark, sf_dir)), cut(_predicted(spark, sf_dir))
    suites = table(spark, sf_dir, "eval_records").where("text is not null").select(F.col("eval_id").alias("document"), F.coalesce("suite", F.lit("none")).alias("suite"))
    key = ["document", "entity_id", "start", "end"]
    g, p = gold.select(*key).distinct().withColumn("g", F.lit(1)), found.select(*key).distinct().withColumn("p", F.lit(1))
    both = g.join(p, key, "full_outer").join(suites, "document")
    one = lambda c: F.coalesce(F.col(c), F.lit(0))
    return Q.metrics(both, ["suite"], one("g") * one("p"), (1 - one("g")) * one("p"), one("g") * (1 - one("p")))


def conformance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.conformance(_gold(spark, sf_dir), _predicted(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("name_id").alias("names"))


def annotation_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that only the stored records or only the scan has, in bytes; spans in characters are counted in bytes first."""
    stored = _records(spark, sf_dir).select("document_id", "entity_id", "start", "end", "offset_unit")
    texts = _documents(spark, sf_dir).select(F.concat(F.lit("document_"), "doc_id").alias("document_id"), "text")
    in_bytes = lambda c: F.expr(f"cast(octet_length(substring(text, 1, cast(`{c}` as int))) as bigint)").alias(c)
    chars = stored.where("offset_unit = 'char'").join(texts, "document_id").select("document_id", "entity_id", in_bytes("start"), in_bytes("end"))
    stored = stored.where("offset_unit = 'byte'").drop("offset_unit").union(chars)
    scanned = scans.scan(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir)).select(F.concat(F.lit("document_"), "doc_id").alias("document_id"), "entity_id", "start", "end")
    return Q.symmetric_difference(stored, scanned, ["document_id", "entity_id", "start", "end"])


def catalog_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected spans with the active pattern of their entity that takes them whole, literals without case, best by priority."""
    active = "entity_status = 'active' and name_status = 'active' and status = 'active'"
    found = scans.detector_table(spark, load_detectors(spark, sf_dir)).select("entity_id", "name_id", "pattern_id", F.when(F.array_contains("flags", "IGNORECASE"), "(?i)").otherwise("").alias("mode"))
    patterns = _patterns(spark, sf_dir).where(active).select("entity_id", "name_id", "pattern_id", "priority", "kind", "value").join(found, ["entity_id", "name_id", "pattern_id"])
    gold = _gold(spark, sf_dir).select("document", "entity_id", "start", "end", "string")
    fits = F.when(F.col("kind") == "literal", F.lower("string") == F.lower("value")).otherwise(F.expr("string rlike concat(mode, '^(?:', value, ')$')"))
    return Q.best_pattern(gold, patterns, fits)


def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 records of lowest hash of each entity."""
    rows = _records(spark, sf_dir)
    return Q.lowest_hashes(rows, ["entity_id"], F.concat_ws("|", "document_id", "name_id", "pattern_id", F.col("start").cast("string"), "offset_unit"), 20).select("document_id", "entity_id", "pattern_id", "start")


def agreement_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the evaluation records, by lowest hash."""
    return Q.share_of_hashes(table(spark, sf_dir, "eval_records").select("eval_id", "type"), F.col("eval_id").cast("string"), 0.2)


# --- mining --------------------------------------------------------------------------------------------------------


def curation_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three policies of curation, curated on four fifths of the mail and measured on the rest, with the decision."""
    mail = table(spark, sf_dir, "enron_preparation").withColumn("f", hash_fraction(F.sha2(F.col("row_id").cast("string"), 256)))
    curated = M.curate(M.evidence(M.candidates(M.header_values(mail.where("f < 0.8")))))
    return M.decisions(M.iterations(curated, M.header_values(mail.where("f >= 0.8"))))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.evidence(M.candidates(M.header_values(table(spark, sf_dir, "enron_preparation"))))


def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).where("kind <> 'display_name'")


def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).where("kind = 'display_name'")


def curation_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.curate(_evidence(spark, sf_dir)).select("kind", "candidate", "groups", "documents", "decision", "reason")


def candidate_funnel_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.funnel(M.curate(_evidence(spark, sf_dir)))


def candidate_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.priorities(M.curate(_evidence(spark, sf_dir)))


def sender_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sender_aliases(table(spark, sf_dir, "enron_preparation"))


# --- statistics ------------------------------------------------------------------------------------------------------


def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, MAD, p95 and p99 of quantities by return flag."""
    return S.summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two event types over ten blocks of users."""
    rows = table(spark, sf_dir, "events").where("user_id is not null and value is not null").select((F.col("user_id") % 10).alias("block"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 2 == 1, F.col("value")).alias("b"))
    return S.permutation_p(rows.groupBy("block").agg(F.round(F.avg("a") - F.avg("b"), 6).alias("diff")))


QUERIES = {
    f.__name__: f
    for f in (redaction_ordinals, redact_text, shifted_spans, pseudonym_assign, restore_text, ambiguous_tokens, eval_positive, eval_negative, eval_grouping_sets, provenance_counts, eval_record_checks, gold_pred_exact_join, overlap_range_join, interval_union_chars, event_islands, quality_slice_metrics, conformance_status, annotation_difference, catalog_qualification, audit_sample, agreement_audit, candidate_evidence, candidate_names, curation_decisions, candidate_funnel_sets, candidate_priorities, curation_iterations, sender_aliases, nearest_rank_percentiles, permutation_test)
}

# the greedy choice keeps all spans where, as here, overlapping ones of two entities are settled by length, start, entity and pattern
KEPT = (
    DETECTORS
    + """,
ranked AS (SELECT doc_id, entity_id, name_id, pattern_id, string, cs AS s, ce AS e, row_number() OVER (PARTITION BY doc_id ORDER BY ce - cs DESC, cs, ce, entity_id, name_id, pattern_id, string) AS rk FROM won),
kept AS (SELECT * FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE a.doc_id = b.doc_id AND b.rk < a.rk AND a.s < b.e AND b.s < a.e)),
ord AS (SELECT entity_id, name_id, row_number() OVER (PARTITION BY entity_id ORDER BY first_at) AS ordinal FROM (SELECT entity_id, name_id, min((doc_id, s, e)) AS first_at FROM kept GROUP BY 1, 2)),
edit AS (SELECT k.*, '[' || upper(entity_id) || '_' || lpad(CAST(ordinal AS VARCHAR), CAST(greatest(4, length(CAST(ordinal AS VARCHAR))) AS INTEGER), '0') || ']' AS token FROM kept k JOIN ord USING (entity_id, name_id))"""
)
GOLD = "gold AS (SELECT document, suite, m.entity_id, m.name_id, m.pattern_id, m.string, m.start AS s, m.\"end\" AS e FROM (SELECT eval_id AS document, suite, unnest(matches) AS m FROM eval_records WHERE type = 'positive'))"
PRED = "pred AS (SELECT doc_id AS document, entity_id, name_id, pattern_id, string, CAST(bs AS BIGINT) AS s, CAST(be AS BIGINT) AS e FROM won)"
EXACT = """ex AS (SELECT document, entity_id, s, e, name_id, pattern_id, pp IS NOT NULL AS found, same AS same_identity FROM (
  SELECT g.*, p.pattern_id AS pp, coalesce(g.name_id = p.name_id AND g.pattern_id = p.pattern_id, false) AS same,
    row_number() OVER (PARTITION BY g.document, g.entity_id, g.s, g.e, gi ORDER BY coalesce(g.name_id = p.name_id AND g.pattern_id = p.pattern_id, false) DESC, p.name_id, p.pattern_id) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY document, entity_id, s, e ORDER BY name_id, pattern_id) AS gi FROM gold) g
  LEFT JOIN (SELECT DISTINCT document, entity_id, s, e, name_id, pattern_id FROM pred) p ON g.document = p.document AND g.entity_id = p.entity_id AND g.s = p.s AND g.e = p.e) WHERE n = 1)"""
ADDRESS = r"[\p{L}\p{N}._%+''-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*"
MINED = rf"""v AS (SELECT row_id, mailbox, loaded_at AS tm, 'from' AS source, "from" AS value FROM enron_preparation UNION ALL SELECT row_id, mailbox, loaded_at, 'to', unnest("to") FROM enron_preparation UNION ALL SELECT row_id, mailbox, loaded_at, 'cc', unnest(cc) FROM enron_preparation UNION ALL SELECT row_id, mailbox, loaded_at, 'bcc', unnest(bcc) FROM enron_preparation),
  a AS (SELECT *, nullif(lower(regexp_extract(value, '{ADDRESS}')), '') AS address FROM v WHERE value IS NOT NULL),
  o AS (SELECT row_id, mailbox, tm, source, address, 'contact' AS kind, address AS candidate FROM a WHERE address IS NOT NULL UNION ALL SELECT row_id, mailbox, tm, source, address, 'domain', string_split(address, '@')[-1] FROM a WHERE address IS NOT NULL),
  ev AS (SELECT kind, candidate, count(*) AS occurrences, count(DISTINCT row_id) AS documents, count(DISTINCT mailbox) AS groups, count(DISTINCT address) AS owners, count(*) FILTER (source = 'from') AS from_header, strftime(min(tm), '%Y-%m') AS first_month, strftime(max(tm), '%Y-%m') AS last_month FROM o GROUP BY 1, 2)"""
ORACLE = {
    "redaction_ordinals": f"WITH {KEPT} SELECT DISTINCT entity_id, name_id, ordinal, token FROM edit JOIN ord USING (entity_id, name_id)",
    "redact_text": f"""WITH {KEPT}, g AS (SELECT e.*, coalesce(lag(e.e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM edit e), p AS (SELECT g.doc_id, string_agg(substring(text, CAST(prev + 1 AS BIGINT), CAST(s - prev AS BIGINT)) || token, '' ORDER BY s) AS head, max(e) AS last FROM g JOIN documents USING (doc_id) GROUP BY 1)
        SELECT d.doc_id, CASE WHEN head IS NULL THEN text ELSE head || substring(text, CAST(last + 1 AS BIGINT)) END AS text FROM documents d LEFT JOIN p USING (doc_id) WHERE text IS NOT NULL""",
    "shifted_spans": f"""WITH {KEPT}, d AS (SELECT *, coalesce(sum(length(token) - (e - s)) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM edit) SELECT doc_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", CAST(s + shift AS BIGINT) AS new_start, CAST(s + shift + length(token) AS BIGINT) AS new_end FROM d""",
    "restore_text": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL",
    "ambiguous_tokens": f"WITH {KEPT} SELECT '[' || upper(entity_id) || ']' AS token, count(DISTINCT name_id) AS keys FROM kept GROUP BY entity_id HAVING count(DISTINCT name_id) > 1",
    "eval_positive": f"""WITH {EVAL}, {GOLD}, {PRED}, w AS (SELECT document, suite, list_sort(list((string, s, e, name_id))) AS want FROM gold GROUP BY 1, 2),
        h AS (SELECT document, list_sort(list((string, s, e, name_id))) AS have FROM pred p WHERE EXISTS (SELECT 1 FROM gold g WHERE g.document = p.document AND g.entity_id = p.entity_id AND g.name_id = p.name_id) GROUP BY 1)
        SELECT document AS eval_id, suite, len(want) AS expected, coalesce(len(have), 0) AS found, coalesce(want = have, false) AS passed FROM w LEFT JOIN h USING (document)""",
    "eval_negative": f"WITH {EVAL} SELECT eval_id, suite FROM eval_records WHERE type = 'negative' AND eval_id NOT IN (SELECT doc_id FROM won)",
    "eval_grouping_sets": f"WITH {EVAL}, {GOLD}, {PRED}, {EXACT} SELECT entity_id, name_id, pattern_id, count(*) AS expected, count(*) FILTER (same_identity) AS matched, CAST(grouping(entity_id, name_id, pattern_id) AS BIGINT) AS level FROM ex GROUP BY GROUPING SETS ((entity_id, name_id, pattern_id), (entity_id, name_id), (entity_id), ())",
    "provenance_counts": "SELECT source_type, count(*) AS records, CAST(grouping(source_type) AS BIGINT) AS level FROM eval_records WHERE type = 'provenance' GROUP BY ROLLUP (source_type)",
    "eval_record_checks": """WITH r AS (SELECT 'stored' AS origin, type, text, matches FROM eval_records UNION ALL SELECT 'broken', CASE type WHEN 'positive' THEN 'negative' WHEN 'negative' THEN 'positive' ELSE 'provenance' END, 'x' || coalesce(text, ''), matches FROM eval_records)
        SELECT origin, rule, count(*) AS records FROM (SELECT origin, 'no_matches' AS rule FROM r WHERE type = 'positive' AND matches IS NULL UNION ALL SELECT origin, 'matches' FROM r WHERE type = 'negative' AND matches IS NOT NULL UNION ALL SELECT origin, 'text' FROM r WHERE type = 'provenance' AND text IS NOT NULL
        UNION ALL SELECT origin, 'span' FROM r WHERE len(list_filter(matches, lambda m: decode(encode(text)[m.start + 1 : m."end"]) <> m.string)) > 0) GROUP BY 1, 2""",
    "gold_pred_exact_join": f"""WITH {EVAL}, {GOLD}, {PRED}, {EXACT} SELECT document, entity_id, s AS "start", e AS "end", name_id, pattern_id, found, same_identity FROM ex""",
    "overlap_range_join": f"""WITH {EVAL}, {GOLD}, {PRED} SELECT g.document, g.entity_id, g.s AS "start", g.e AS "end", p.entity_id AS p_entity, p.s AS p_start, p.e AS p_end, least(g.e, p.e) - greatest(g.s, p.s) AS shared FROM gold g JOIN (SELECT DISTINCT document, entity_id, s, e FROM pred) p ON g.document = p.document AND g.s < p.e AND p.s < g.e""",
    "interval_union_chars": f"""WITH {REC}, r AS (SELECT *, max("end") OVER (PARTITION BY document_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rec WHERE offset_unit = 'byte')
        SELECT document_id, CAST(sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) AS BIGINT) AS islands, CAST(sum(greatest("end" - greatest("start", coalesce(reach, "start")), 0)) AS BIGINT) AS covered FROM r GROUP BY 1""",
    "event_islands": """WITH r AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS s FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), w AS (SELECT user_id, s, s + 2 AS e, max(s + 2) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r)
        SELECT user_id, CAST(sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) AS BIGINT) AS islands, CAST(sum(greatest(e - greatest(s, coalesce(reach, s)), 0)) AS BIGINT) AS covered FROM w GROUP BY 1""",
    "quality_slice_metrics": f"""WITH {EVAL}, {GOLD}, {PRED}, g AS (SELECT DISTINCT document, entity_id, s, e FROM gold), p AS (SELECT DISTINCT document, entity_id, s, e FROM pred),
        b AS (SELECT coalesce(g.document, p.document) AS document, g.s IS NOT NULL AS ig, p.s IS NOT NULL AS ip FROM g FULL JOIN p ON g.document = p.document AND g.entity_id = p.entity_id AND g.s = p.s AND g.e = p.e),
        c AS (SELECT coalesce(suite, 'none') AS suite, count(*) FILTER (ig AND ip) AS tp, count(*) FILTER (NOT ig AND ip) AS fp, count(*) FILTER (ig AND NOT ip) AS fn FROM b JOIN eval_records ON document = eval_id GROUP BY 1)
        SELECT suite, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp * 2 / nullif(tp * 2 + fp + fn, 0), 6) AS f1 FROM c""",
    "annotation_difference": f"""WITH {DETECTORS}, {REC}, a AS (SELECT DISTINCT document_id, entity_id, "start" AS s, "end" AS e FROM rec WHERE offset_unit = 'byte' UNION SELECT document_id, entity_id, strlen(substring(text, 1, "start")), strlen(substring(text, 1, "end")) FROM rec JOIN documents ON document_id = 'document_' || doc_id WHERE offset_unit = 'char' AND text IS NOT NULL), b AS (SELECT DISTINCT 'document_' || doc_id AS document_id, entity_id, CAST(bs AS BIGINT) AS s, CAST(be AS BIGINT) AS e FROM won)
        SELECT document_id, entity_id, s AS "start", e AS "end", 'first' AS pass FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT document_id, entity_id, s, e, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "catalog_qualification": f"""WITH {DETECTORS}, {GOLD}, j AS (SELECT document, g.entity_id, s, e, min((priority, d.name_id, d.pattern_id)) AS m FROM gold g JOIN det d ON g.entity_id = d.entity_id AND CASE WHEN kind = 'literal' THEN lower(g.string) = lower(value) ELSE regexp_full_match(g.string, rx) END GROUP BY 1, 2, 3, 4)
        SELECT document, entity_id, s AS "start", e AS "end", m[2] AS name_id, m[3] AS pattern_id FROM j""",
    "audit_sample": f"""WITH {REC}, k AS (SELECT *, concat_ws('|', document_id, name_id, pattern_id, "start", offset_unit) AS k FROM rec) SELECT document_id, entity_id, pattern_id, "start" FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY sha256(k), k) AS n FROM k) WHERE n <= 20""",
    "agreement_audit": "SELECT eval_id, type FROM eval_records ORDER BY sha256(CAST(eval_id AS VARCHAR)), CAST(eval_id AS VARCHAR) LIMIT (SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) FROM eval_records)",
    "candidate_evidence": f"WITH {MINED} SELECT * FROM ev",
    "nearest_rank_percentiles": """WITH m AS (SELECT l_returnflag, count(*) AS n, median(l_quantity) AS median, quantile_disc(l_quantity, 0.95) AS p95, quantile_disc(l_quantity, 0.99) AS p99 FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1), d AS (SELECT l_returnflag, median(abs(l_quantity - median)) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1)
        SELECT l_returnflag, n, median, mad, CASE WHEN n >= 20 THEN p95 END AS p95, CASE WHEN n >= 100 THEN p99 END AS p99 FROM m JOIN d USING (l_returnflag)""",
    "permutation_test": """WITH b AS (SELECT user_id % 10 AS block, round(avg(CASE WHEN event_id % 2 = 0 THEN value END) - avg(CASE WHEN event_id % 2 = 1 THEN value END), 6) AS diff FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1),
        s AS (SELECT id, sum(CASE WHEN (id >> (rk - 1)) & 1 = 1 THEN -diff ELSE diff END) AS s FROM (SELECT *, row_number() OVER (ORDER BY block) AS rk FROM b) b, (SELECT unnest(range(CAST(2 ** (SELECT count(*) FROM b) AS BIGINT))) AS id) GROUP BY 1), o AS (SELECT sum(diff) AS o, count(*) AS n FROM b)
        SELECT round(max(o) / max(n), 9) AS mean_difference, round(avg(CASE WHEN abs(s) >= abs(o) - 1e-9 THEN 1.0 ELSE 0.0 END), 9) AS p_value FROM s, o""",
}

# display names beside addresses join contacts and domains
NAMED = MINED.replace("ev AS (", r"""shown AS (SELECT *, trim(regexp_replace(regexp_replace(value, '<[^>]*>|\[mailto:[^\]]*\]|ADDR', '', 'g'), '^[\s"''(]+|[\s"'')]+$', '', 'g'), ' ') AS name FROM a WHERE address IS NOT NULL),
  o2 AS (SELECT * FROM o UNION ALL SELECT row_id, mailbox, tm, source, address, 'display_name', name FROM shown WHERE regexp_full_match(lower(name), '\p{L}[\p{L}.''-]*(?: \p{L}[\p{L}.''-]*){1,3}')),
  ev AS (""".replace("ADDR", ADDRESS)).replace("FROM o GROUP BY", "FROM o2 GROUP BY")
CURATED = f"""{NAMED}, why AS (SELECT *, CASE WHEN kind = 'display_name' AND owners > 1 THEN 'ambiguous_owner' WHEN documents < 3 THEN 'few_documents' WHEN groups < 2 THEN 'few_groups' END AS why FROM ev),
  cur AS (SELECT kind, candidate, groups, documents, CASE WHEN why IS NOT NULL OR n > 600 THEN 'rejected' WHEN n <= 200 THEN 'active' ELSE 'draft' END AS decision, coalesce(why, CASE WHEN n > 600 THEN 'over_capacity' ELSE 'supported' END) AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY kind, why IS NULL ORDER BY groups DESC, documents DESC, candidate) AS n FROM why))"""
_PART = "(SELECT * FROM enron_preparation WHERE CAST(('0x' || substr(sha256(CAST(row_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 {side} 0.8)"
_CURATED = CURATED.replace("FROM enron_preparation", "FROM " + _PART.format(side="<"))
_HELD = MINED[: MINED.index("a AS (SELECT")].rstrip().rstrip(",").replace("v AS (", "hv AS (", 1).replace("FROM enron_preparation", "FROM " + _PART.format(side=">="))
ORACLE["curation_iterations"] = rf"""WITH {_CURATED}, {_HELD}, hc AS (SELECT DISTINCT candidate FROM cur WHERE kind = 'contact' AND decision = 'active'),
  hr AS (SELECT value, nullif(lower(regexp_extract(value, '{ADDRESS}')), '') AS address FROM hv WHERE value IS NOT NULL),
  n AS (SELECT count(address) AS labelled, count(candidate) AS known, count(*) FILTER (regexp_matches(value, '(?:^|[^\d])(?:\+?\d[\d ().-]{{7,}}\d)(?:[^\d]|$)')) AS phones FROM hr LEFT JOIN hc ON candidate = address),
  i AS (SELECT 'catalog' AS iteration, labelled, known AS found, CAST(0 AS BIGINT) AS fallback_hits, 0 AS no FROM n UNION ALL SELECT 'email_fallback', labelled, labelled, 0, 1 FROM n UNION ALL SELECT 'phone_fallback', labelled, labelled, phones, 2 FROM n),
  w AS (SELECT min_by(no, (labelled - found, no)) AS best FROM i WHERE fallback_hits = 0)
  SELECT iteration, labelled, found, labelled - found AS missed, round(found / labelled, 6) AS recall, fallback_hits, no = best AS selected, CASE WHEN fallback_hits > 0 THEN 'no_negative_evidence' WHEN no = best THEN 'fewest_misses' ELSE 'superseded' END AS reason FROM i, w"""
ORACLE["sender_aliases"] = rf"""WITH a AS (SELECT row_id, "from" AS v, body, lower(regexp_extract("from", '{ADDRESS}')) AS address FROM enron_preparation), b AS (SELECT row_id, address, body, list_filter(regexp_split_to_array(split_part(address, '@', 1), '[._-]+'), lambda p: p <> '') AS parts FROM a WHERE address <> '' AND trim(v, ' ') = regexp_extract(v, '{ADDRESS}') AND body IS NOT NULL),
  c AS (SELECT *, string_split(split_part(body, chr(10) || '>', 1), chr(10)) AS own FROM b WHERE len(parts) BETWEEN 2 AND 4 AND len(list_filter(parts, lambda p: NOT regexp_full_match(p, '[a-z]{{2,}}'))) = 0),
  d AS (SELECT row_id, address, regexp_extract(array_to_string(own[greatest(len(own) - 11, 1):], chr(10)), '(?i)(?:^|\W)(' || array_to_string(parts, '\s+') || ')(?:\W|$)', 1) AS alias FROM c) SELECT * FROM d WHERE alias <> ''"""
ORACLE |= {
    "candidate_names": f"WITH {NAMED} SELECT * FROM ev WHERE kind = 'display_name'",
    "curation_decisions": f"WITH {CURATED} SELECT kind, candidate, groups, documents, decision, reason FROM cur",
    "candidate_funnel_sets": f"WITH {CURATED} SELECT CAST(grouping(decision, kind, reason) AS BIGINT) AS level, kind, decision, reason, count(*) AS candidates FROM cur GROUP BY GROUPING SETS ((decision), (kind), (reason), ())",
    "candidate_priorities": f"WITH {CURATED} SELECT kind, candidate, 19999 + row_number() OVER (PARTITION BY kind ORDER BY length(candidate) DESC, groups DESC, candidate) AS priority FROM cur WHERE decision = 'active'",
    "pseudonym_assign": f"WITH {KEPT}, f AS (SELECT name_id, row_number() OVER (ORDER BY first_at) AS n FROM (SELECT entity_id, name_id, min((doc_id, s, e)) AS first_at FROM kept GROUP BY 1, 2)), c AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) SELECT name_id, CAST(s_suppkey AS VARCHAR) AS candidate_id, s_name AS value FROM f LEFT JOIN c USING (n)",
    "conformance_status": f"""WITH {EVAL}, {GOLD}, {PRED}, e AS (SELECT *, row_number() OVER (PARTITION BY document, s, e, entity_id, name_id, pattern_id) AS r FROM gold), p AS (SELECT *, row_number() OVER (PARTITION BY document, s, e, entity_id, name_id, pattern_id) AS r FROM pred),
        ok AS (SELECT e.document, e.s, e.e, e.entity_id, e.name_id, e.pattern_id, e.r, p.r IS NOT NULL AS hit FROM e LEFT JOIN p ON (e.document, e.s, e.e, e.entity_id, e.name_id, e.pattern_id, e.r) = (p.document, p.s, p.e, p.entity_id, p.name_id, p.pattern_id, p.r)),
        er AS (SELECT *, row_number() OVER (PARTITION BY document, s, e ORDER BY entity_id, name_id, pattern_id) AS k FROM ok WHERE NOT hit),
        pr AS (SELECT p.*, row_number() OVER (PARTITION BY p.document, p.s, p.e ORDER BY p.entity_id, p.name_id, p.pattern_id) AS k FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE (e.document, e.s, e.e, e.entity_id, e.name_id, e.pattern_id, e.r) = (p.document, p.s, p.e, p.entity_id, p.name_id, p.pattern_id, p.r))),
        st AS (SELECT name_id, 'correct' AS status FROM ok WHERE hit UNION ALL SELECT er.name_id, CASE WHEN pr.k IS NULL THEN 'missed' ELSE 'wrong_canonical' END FROM er LEFT JOIN pr ON er.document = pr.document AND er.s = pr.s AND er.e = pr.e AND er.k = pr.k)
        SELECT status, count(*) AS matches, count(DISTINCT name_id) AS names FROM st GROUP BY 1""",
}
