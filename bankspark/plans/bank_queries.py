"""Queries of bank algebra, scanning and reports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from bankspark.model import FLAGS
from bankspark.operators import bank as banks
from bankspark.operators import resolve as reports
from bankspark.operators import scan as scans
from bankspark.runtime import table
from bankspark.sources.tables import load_detectors

IDS = ["entity_id", "name_id", "pattern_id"]

# SQL shared by the twins: the cleaned pattern table, and the detectors with their regex in the oracle's dialect
CLEAN = """
clean AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT bank_id, entity_id, lower(trim(entity_status)) AS entity_status, entity_flags, name_id, coalesce(max(canonical) OVER (PARTITION BY bank_id, entity_id, name_id), name_id) AS canonical,
           lower(trim(name_status)) AS name_status, pattern_id, kind, value, lower(trim(status)) AS status, priority, regex_flags, case_sensitive,
           normalize_whitespace, left_boundary, right_boundary, metadata,
           row_number() OVER (PARTITION BY bank_id, entity_id, name_id, pattern_id ORDER BY
             coalesce(list_position(['active','draft','inactive','deprecated'], lower(trim(status))), 0) = 0, lower(trim(status)), value, kind, coalesce(priority, 0), coalesce(metadata, '')) AS rn
    FROM bank_patterns) WHERE rn = 1)"""
DETECTORS = (
    CLEAN
    + r""",
flagged AS (SELECT entity_id, bool_or(coalesce(list_contains(entity_flags, 'IGNORECASE'), false)) AS ci FROM clean GROUP BY 1),
det AS (
  SELECT c.*, CASE WHEN kind = 'literal' THEN value ELSE pattern_id END AS surface,
    (CASE WHEN f.ci OR (kind = 'literal' AND NOT case_sensitive) OR coalesce(list_contains(regex_flags, 'IGNORECASE'), false) THEN '(?i)' ELSE '' END) ||
    (CASE WHEN kind = 'regex' THEN value ELSE
      (CASE WHEN left_boundary = 'word' THEN '\b' ELSE '' END) || '(?:' ||
      (CASE WHEN normalize_whitespace THEN regexp_replace(regexp_replace(value, '([.()*+?\[\]{}^$|\\])', '\\\1', 'g'), '\s+', '\\s+', 'g') ELSE regexp_replace(value, '([.()*+?\[\]{}^$|\\])', '\\\1', 'g') END) || ')' ||
      (CASE WHEN right_boundary = 'word' THEN '\b' ELSE '' END) END) AS rx,
    row_number() OVER (ORDER BY c.entity_id, priority, canonical, CASE WHEN kind = 'literal' THEN value ELSE pattern_id END, value) AS ord
  FROM clean c JOIN flagged f USING (entity_id)
  WHERE entity_status = 'active' AND name_status = 'active' AND status = 'active'),
hits AS (
  SELECT doc_id, d.*, string_split_regex(text, rx) AS parts, regexp_extract_all(text, rx) AS found
  FROM documents JOIN det d ON regexp_matches(text, rx)),
places AS (
  SELECT * EXCLUDE (parts, found), found[i] AS string,
    list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS cs,
    list_sum(list_transform(parts[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: strlen(x))), 0) AS bs
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM hits)),
spans AS (SELECT *, cs + length(string) AS ce, bs + strlen(string) AS be FROM places),
won AS (
  SELECT a.* FROM spans a WHERE NOT EXISTS (
    SELECT 1 FROM spans b WHERE a.doc_id = b.doc_id AND a.entity_id = b.entity_id AND ((b.cs < a.cs AND b.ce > a.cs) OR (b.cs = a.cs AND b.ord < a.ord))))"""
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banks.clean_patterns(table(spark, sf_dir, "bank_patterns"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct span records with ids and lower-case entities."""
    rows = table(spark, sf_dir, "span_records").select("document_id", F.lower("entity_id").alias("entity_id"), F.coalesce("name_id", F.lit("")).alias("name_id"), "pattern_id", "string", "start", "end", "offset_unit")
    return rows.distinct()


# --- bank ------------------------------------------------------------------------------------------------


def bank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and patterns by entity and status, and how many of them have an active chain."""
    rows = _patterns(spark, sf_dir)
    per = rows.groupBy("entity_id", "status").agg(F.count(F.lit(1)).alias("patterns"), F.countDistinct("name_id").alias("names"), F.count_if(banks.chain_active()).alias("active_patterns"), F.count_if(F.col("kind") == "literal").alias("literals"))
    return per


def bank_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir).where(banks.chain_active()).select(*IDS, "kind", "value")


def bank_effective_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the entity and the pattern together, in their fixed order."""
    rows = _patterns(spark, sf_dir)
    none = F.array().cast("array<string>")
    entity = rows.select("entity_id", F.explode(F.coalesce("entity_flags", none)).alias("f")).groupBy("entity_id").agg(F.collect_set("f").alias("ef"))
    own = F.when(F.col("kind") == "regex", F.coalesce("regex_flags", none)).otherwise(F.when(~F.col("case_sensitive"), F.array(F.lit("IGNORECASE"))).otherwise(none))
    both = F.array_union(F.coalesce("ef", none), own)
    ordered = F.filter(F.array(*map(F.lit, FLAGS)), lambda f: F.array_contains(both, f))
    return rows.join(entity, "entity_id", "left").select(*IDS, F.array_join(ordered, ",").alias("flags"))


def bank_detector_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of an entity's active detectors: priority, canonical and surface name, value."""
    surface = F.when(F.col("kind") == "literal", F.col("value")).otherwise(F.col("pattern_id"))
    rows = _patterns(spark, sf_dir).where(banks.chain_active()).withColumn("surface_name", surface)
    order = W.partitionBy("entity_id").orderBy("priority", "canonical", "surface_name", "value")
    return rows.select(*IDS, "surface_name", (F.row_number().over(order) - 1).cast("long").alias("pattern_order"))


def bank_ambiguous_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector keys that more than one row of the raw table has: entity, canonical and surface name."""
    surface = F.when(F.col("kind") == "literal", F.col("value")).otherwise(F.col("pattern_id"))
    return table(spark, sf_dir, "bank_patterns").groupBy("entity_id", "canonical", surface.alias("surface_name")).agg(F.count(F.lit(1)).alias("detectors")).where("detectors > 1")


def bank_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _patterns(spark, sf_dir).where("kind = 'regex'")
    return rows.select(*IDS, *[c.alias(k) for k, c in banks.lint_columns(F.col("value")).items()])


def bank_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the raw table that break a rule, by rule."""
    raw = table(spark, sf_dir, "bank_patterns")
    known = ("draft", "active", "inactive", "deprecated")
    rules = {
        "id": ~F.col("entity_id").rlike(r"^[a-z][a-z0-9_]{0,79}$") | ~F.col("pattern_id").rlike(r"^[a-z][a-z0-9_]{0,79}$"),
        "status": ~F.coalesce(F.col("status"), F.lit("")).isin(*known),
        "canonical": F.col("canonical").isNull(),
        "metadata": F.octet_length(F.coalesce("metadata", F.lit(""))) > 16 * 1024,
        "flags": F.size(F.array_distinct("regex_flags")) < F.size("regex_flags"),
        "literal": (F.col("kind") == "literal") & (F.col("case_sensitive").isNull() | F.col("regex_flags").isNotNull()),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return raw.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def bank_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all patterns to those with an active chain: patterns kept, removed and changed in value, by entity."""
    old = _patterns(spark, sf_dir).select(*IDS, F.col("value").alias("old"))
    new = _patterns(spark, sf_dir).where(banks.chain_active()).select(*IDS, F.when(F.col("case_sensitive"), F.col("value")).otherwise(F.lower("value")).alias("new"))
    both = old.join(new, IDS, "full_outer")
    return both.groupBy("entity_id").agg(F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("old") != F.col("new")).alias("changed"), F.count_if(F.col("old") == F.col("new")).alias("same"))


# --- scan ------------------------------------------------------------------------------------------------


def scan_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the active bank in the documents, with byte offsets."""
    return scans.scan(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir)).drop("captures")


def scan_char_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.scan(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir), offsets="char")
    return rows.select("doc_id", "entity_id", "name_id", "pattern_id", "start", "end")


def scan_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and documents by entity: the flagship query."""
    return scan_spans(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("doc_id").alias("documents"))


def scan_selected_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.scan(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir, "vessel"))
    return rows.select("doc_id", "name_id", "pattern_id", "string", "start", "end")


def scan_global_leftmost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One winner a region over all entities."""
    return scans.scan(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir), "global_leftmost").groupBy("entity").agg(F.count(F.lit(1)).alias("records"))


def scan_all_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector's matches, overlapping ones too."""
    rows = scans.scan(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir), "all_overlaps")
    return rows.select("doc_id", "entity_id", "name_id", "pattern_id", "start", "end")


def scan_rejected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 8,000 bytes or with more than one match: what a scan with these limits refuses, and why."""
    return scans.rejected_texts(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir), most_bytes=8000, most=1)


def scan_dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the literals by n-gram join, without case."""
    literals = _patterns(spark, sf_dir).where(banks.chain_active() & (F.col("kind") == "literal"))
    return scans.dictionary_join(_documents(spark, sf_dir), "doc_id", "text", literals).groupBy(*IDS).agg(F.count(F.lit(1)).alias("candidates"))


# --- reports ---------------------------------------------------------------------------------------------


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every detector, overlapping ones too."""
    rows = scans.scan(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir), "all_overlaps")
    return rows.select(F.concat(F.lit("document_"), "doc_id").alias("document_id"), *IDS, "string", "start", "end")


def overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of overlapping records with their span and size."""
    rows = reports.overlap_groups(_overlapping(spark, sf_dir)).where("group_size > 1")
    return rows.groupBy("document_id", "group_no").agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.count(F.lit(1)).alias("size"))


def priority_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that win their group."""
    rows = reports.resolve(_overlapping(spark, sf_dir), _patterns(spark, sf_dir))
    return rows.where("winner").select("document_id", *IDS, "start", "end", "overlap_id", "group_size")


def grouped_counts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.grouped_counts(_records(spark, sf_dir))


def context_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 characters before and after each record."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("document_"), "doc_id").alias("document_id"), "text")
    rows = reports.context(_records(spark, sf_dir), docs, "document_id", "text", 20)
    return rows.select("document_id", "pattern_id", "start", "end", "before", "match", "after")


def docs_with_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("document_"), "doc_id").alias("document_id"))
    return docs.join(_records(spark, sf_dir), "document_id", "left_semi").select("doc_id", "lang")


def docs_without_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("document_"), "doc_id").alias("document_id"))
    return docs.join(_records(spark, sf_dir), "document_id", "left_anti").select("doc_id", "lang")


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("document_"), "doc_id").alias("document_id"))
    return reports.batch_summary(docs, _records(spark, sf_dir), "document_id")


def expected_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active names that no record has."""
    names = _patterns(spark, sf_dir).where(banks.chain_active()).select("entity_id", "name_id").distinct()
    return reports.expected_missing(names, _records(spark, sf_dir), ["entity_id", "name_id"])


def match_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their pattern's kind, value, priority and boundaries."""
    rows = _records(spark, sf_dir).join(_patterns(spark, sf_dir).select(*IDS, "kind", "value", "priority", "left_boundary", "right_boundary"), IDS)
    return rows.select("document_id", *IDS, "start", "kind", "value", "priority", "left_boundary", "right_boundary")


QUERIES = {f.__name__: f for f in (bank_stats, bank_status_filter, bank_effective_flags, bank_detector_order, bank_ambiguous_detectors, bank_lint, bank_checks, bank_diff_summary, scan_spans, scan_char_offsets, scan_entity_counts, scan_selected_entity, scan_global_leftmost, scan_all_overlaps, scan_rejected_texts, scan_dictionary_join, overlap_groups, priority_resolve, grouped_counts_rollup, context_snippets, docs_with_records, docs_without_records, batch_summary, expected_missing, match_explanation)}

REC = """rec AS (SELECT DISTINCT document_id, lower(entity_id) AS entity_id, coalesce(name_id, '') AS name_id, pattern_id, string, "start", "end", offset_unit FROM span_records)"""
GROUPS = (
    DETECTORS
    + """,
rec AS (SELECT 'document_' || doc_id AS document_id, entity_id, name_id, pattern_id, string, CAST(bs AS BIGINT) AS "start", CAST(be AS BIGINT) AS "end" FROM spans),
opened AS (SELECT *, CASE WHEN max("end") OVER w IS NULL OR "start" >= max("end") OVER w THEN 1 ELSE 0 END AS opens FROM rec
  WINDOW w AS (PARTITION BY document_id ORDER BY "start", "end", entity_id, name_id, pattern_id, string ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY document_id ORDER BY "start", "end", entity_id, name_id, pattern_id, string ROWS UNBOUNDED PRECEDING) - 1 AS group_no FROM opened),
sized AS (SELECT *, count(*) OVER (PARTITION BY document_id, group_no) AS group_size FROM numbered)"""
)
ORACLE = {
    "bank_stats": f"WITH {CLEAN} SELECT entity_id, status, count(*) AS patterns, count(DISTINCT name_id) AS names, count(*) FILTER (entity_status = 'active' AND name_status = 'active' AND status = 'active') AS active_patterns, count(*) FILTER (kind = 'literal') AS literals FROM clean GROUP BY ALL",
    "bank_status_filter": f"WITH {CLEAN} SELECT entity_id, name_id, pattern_id, kind, value FROM clean WHERE entity_status = 'active' AND name_status = 'active' AND status = 'active'",
    "bank_effective_flags": f"""WITH {CLEAN}, ef AS (SELECT entity_id, list(DISTINCT f) AS fs FROM (SELECT entity_id, unnest(entity_flags) AS f FROM clean) GROUP BY 1),
        own AS (SELECT c.entity_id, name_id, pattern_id, list_concat(coalesce(fs, []), CASE WHEN kind = 'regex' THEN coalesce(regex_flags, []) WHEN NOT case_sensitive THEN ['IGNORECASE'] ELSE [] END) AS fs FROM clean c LEFT JOIN ef USING (entity_id))
        SELECT entity_id, name_id, pattern_id, array_to_string(list_filter(['ASCII','IGNORECASE','MULTILINE','DOTALL','VERBOSE'], lambda f: list_contains(fs, f)), ',') AS flags FROM own""",
    "bank_detector_order": f"WITH {CLEAN}, s AS (SELECT *, CASE WHEN kind = 'literal' THEN value ELSE pattern_id END AS surface_name FROM clean WHERE entity_status = 'active' AND name_status = 'active' AND status = 'active') SELECT entity_id, name_id, pattern_id, surface_name, row_number() OVER (PARTITION BY entity_id ORDER BY priority, canonical, surface_name, value) - 1 AS pattern_order FROM s",
    "bank_ambiguous_detectors": "SELECT entity_id, canonical, CASE WHEN kind = 'literal' THEN value ELSE pattern_id END AS surface_name, count(*) AS detectors FROM bank_patterns GROUP BY ALL HAVING count(*) > 1",
    "bank_lint": rf"""WITH {CLEAN}, r AS (SELECT *, string_split(value, ')') AS p, regexp_replace(regexp_replace(value, '\\.', 'E', 'g'), '\[[^\]]*\]', 'K', 'g') AS bare FROM clean WHERE kind = 'regex')
        SELECT entity_id, name_id, pattern_id, len(list_filter(range(1, len(p)), lambda i: regexp_matches(p[i], '(?s)\(.*[*+]') AND regexp_matches(p[i + 1], '^\s*[*+{{]'))) > 0 AS nested_quantifier, contains(bare, '.*') AS unbounded_dot_star,
        len(string_split(bare, '|')) >= 20 AS huge_alternation, len(string_split(value, '(?=')) + len(string_split(value, '(?!')) + len(string_split(value, '(?<=')) + len(string_split(value, '(?<!')) - 4 >= 3 AS repeated_lookaround,
        len(string_split(bare, '(')) - len(string_split(bare, '(?')) > 50 AS excessive_groups, length(trim(value)) < 4 AND NOT (contains(value, '\b') OR starts_with(trim(value), '^') OR ends_with(trim(value), '$')) AS short_unbounded,
        NOT regexp_matches(value, '[\\^$.|?*+()\[\]{{}}]') AND trim(value) <> '' AS literal_candidate FROM r""",
    "bank_checks": """SELECT rule, count(*) AS rows FROM (
        SELECT 'id' AS rule FROM bank_patterns WHERE NOT regexp_matches(entity_id, '^[a-z][a-z0-9_]{0,79}$') OR NOT regexp_matches(pattern_id, '^[a-z][a-z0-9_]{0,79}$')
        UNION ALL SELECT 'status' FROM bank_patterns WHERE coalesce(status, '') NOT IN ('draft','active','inactive','deprecated')
        UNION ALL SELECT 'canonical' FROM bank_patterns WHERE canonical IS NULL
        UNION ALL SELECT 'metadata' FROM bank_patterns WHERE strlen(coalesce(metadata, '')) > 16384
        UNION ALL SELECT 'flags' FROM bank_patterns WHERE len(list_distinct(regex_flags)) < len(regex_flags)
        UNION ALL SELECT 'literal' FROM bank_patterns WHERE kind = 'literal' AND (case_sensitive IS NULL OR regex_flags IS NOT NULL)) GROUP BY 1""",
    "bank_diff_summary": f"""WITH {CLEAN}, n AS (SELECT entity_id, name_id, pattern_id, CASE WHEN case_sensitive THEN value ELSE lower(value) END AS new FROM clean WHERE entity_status = 'active' AND name_status = 'active' AND status = 'active')
        SELECT entity_id, count(*) FILTER (new IS NULL) AS removed, count(*) FILTER (c.value IS NULL) AS added, count(*) FILTER (c.value <> new) AS changed, count(*) FILTER (c.value = new) AS same
        FROM clean c FULL JOIN n USING (entity_id, name_id, pattern_id) GROUP BY 1""",
    "scan_spans": f"""WITH {DETECTORS} SELECT doc_id, entity_id AS entity, canonical AS canonical_name, surface AS surface_name, string, CAST(bs AS BIGINT) AS "start", CAST(be AS BIGINT) AS "end", 'byte' AS offset_unit, entity_id, name_id, pattern_id, kind AS pattern_kind FROM won""",
    "scan_char_offsets": f"""WITH {DETECTORS} SELECT doc_id, entity_id, name_id, pattern_id, CAST(cs AS BIGINT) AS "start", CAST(ce AS BIGINT) AS "end" FROM won""",
    "scan_entity_counts": f"WITH {DETECTORS} SELECT entity_id AS entity, count(*) AS records, count(DISTINCT doc_id) AS documents FROM won GROUP BY 1",
    "scan_selected_entity": f"""WITH {DETECTORS} SELECT doc_id, name_id, pattern_id, string, CAST(bs AS BIGINT) AS "start", CAST(be AS BIGINT) AS "end" FROM won WHERE entity_id = 'vessel'""",
    "scan_global_leftmost": f"""WITH {DETECTORS}, one AS (SELECT a.* FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE a.doc_id = b.doc_id AND ((b.cs < a.cs AND b.ce > a.cs) OR (b.cs = a.cs AND b.ord < a.ord)))) SELECT entity_id AS entity, count(*) AS records FROM one GROUP BY 1""",
    "scan_all_overlaps": f"""WITH {DETECTORS} SELECT doc_id, entity_id, name_id, pattern_id, CAST(bs AS BIGINT) AS "start", CAST(be AS BIGINT) AS "end" FROM spans""",
    "scan_rejected_texts": f"""WITH {DETECTORS} SELECT doc_id, 'text_too_large' AS error FROM documents WHERE strlen(text) > 8000
        UNION ALL SELECT doc_id, 'too_many_matches' FROM won JOIN documents USING (doc_id) WHERE strlen(text) <= 8000 GROUP BY doc_id HAVING count(*) > 1""",
    "scan_dictionary_join": rf"""WITH {CLEAN}, lit AS (SELECT entity_id, name_id, pattern_id, array_to_string(regexp_extract_all(lower(value), '[\p{{L}}\p{{N}}]+'), ' ') AS gram FROM clean WHERE entity_status = 'active' AND name_status = 'active' AND status = 'active' AND kind = 'literal'),
        w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        g AS (SELECT doc_id, i, array_to_string(w[i:i+n-1], ' ') AS gram FROM i, (SELECT unnest([1,2,3,4]) AS n) WHERE i + n - 1 <= len(w))
        SELECT entity_id, name_id, pattern_id, count(*) AS candidates FROM g JOIN lit USING (gram) WHERE gram <> '' GROUP BY ALL""",
    "overlap_groups": f"""WITH {GROUPS} SELECT document_id, CAST(group_no AS BIGINT) AS group_no, min("start") AS span_start, max("end") AS span_end, count(*) AS size FROM sized WHERE group_size > 1 GROUP BY document_id, group_no""",
    "priority_resolve": f"""WITH {GROUPS}, ranked AS (SELECT s.*, row_number() OVER (PARTITION BY document_id, group_no ORDER BY coalesce(priority, 0), s."start" - s."end", s."start", s.entity_id, s.name_id, s.pattern_id, s.string) AS rn,
        dense_rank() OVER (PARTITION BY document_id, group_size > 1 ORDER BY group_no) - 1 AS nth
        FROM sized s LEFT JOIN (SELECT entity_id, name_id, pattern_id, priority FROM clean) p USING (entity_id, name_id, pattern_id))
        SELECT document_id, entity_id, name_id, pattern_id, "start", "end", CASE WHEN group_size > 1 THEN 'overlap_' || nth END AS overlap_id, group_size FROM ranked WHERE rn = 1""",
    "grouped_counts_rollup": f"WITH {REC} SELECT entity_id, name_id, CAST(grouping(entity_id, name_id) AS BIGINT) AS level, count(*) AS records FROM rec GROUP BY ROLLUP (entity_id, name_id)",
    "context_snippets": f"""WITH {REC}, j AS (SELECT r.*, text FROM rec r JOIN documents d ON r.document_id = 'document_' || d.doc_id WHERE text IS NOT NULL),
        c AS (SELECT *, CASE WHEN offset_unit = 'byte' THEN length(decode(encode(text)[1:"start"])) ELSE "start" END AS s, CASE WHEN offset_unit = 'byte' THEN length(decode(encode(text)[1:"end"])) ELSE "end" END AS e FROM j)
        SELECT document_id, pattern_id, "start", "end", substring(text, CAST(greatest(s - 20, 0) + 1 AS BIGINT), CAST(s - greatest(s - 20, 0) AS BIGINT)) AS before, substring(text, s + 1, e - s) AS match, substring(text, e + 1, 20) AS after FROM c""",
    "docs_with_records": f"WITH {REC} SELECT doc_id, lang FROM documents WHERE 'document_' || doc_id IN (SELECT document_id FROM rec)",
    "docs_without_records": f"WITH {REC} SELECT doc_id, lang FROM documents WHERE 'document_' || doc_id NOT IN (SELECT document_id FROM rec)",
    "batch_summary": f"WITH {REC}, per AS (SELECT document_id, count(*) AS n FROM rec GROUP BY 1) SELECT count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS records, count(n) AS documents_with_records FROM documents LEFT JOIN per ON document_id = 'document_' || doc_id",
    "expected_missing": f"WITH {CLEAN}, {REC} SELECT DISTINCT entity_id, name_id FROM clean c WHERE entity_status = 'active' AND name_status = 'active' AND status = 'active' AND NOT EXISTS (SELECT 1 FROM rec r WHERE r.entity_id = c.entity_id AND r.name_id = c.name_id)",
    "match_explanation": f"""WITH {CLEAN}, {REC} SELECT document_id, entity_id, name_id, pattern_id, "start", kind, value, priority, left_boundary, right_boundary FROM rec JOIN clean USING (entity_id, name_id, pattern_id)""",
}
