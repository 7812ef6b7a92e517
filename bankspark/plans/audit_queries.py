"""Queries of the audit operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bankspark.functions import text as T
from bankspark.operators import audit as A
from bankspark.operators import corpus as C
from bankspark.operators import documents as D
from bankspark.operators import evals as V
from bankspark.operators import lint as L
from bankspark.operators import bank as banks
from bankspark.operators import scan as scans
from bankspark.plans.bank_queries import CLEAN, DETECTORS, _documents, _patterns
from bankspark.plans.corpus_queries import SIZE, SPLIT
from bankspark.plans.quality_queries import EVAL, EXACT, GOLD, PRED, _gold, _predicted
from bankspark.runtime import table
from bankspark.sources.tables import bank_from_table, load_detectors

SPANS = ["document", "start", "end"]


def suite_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every suite's evaluation records."""
    return A.suite_hash(table(spark, sf_dir, "eval_records"), "suite", "eval_id", ["type", "text", "reason"])


def prediction_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all records of a scan in order."""
    rows = scans.scan(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir))
    return A.ordered_digest(rows, "doc_id", ["start", "end", "entity_id", "name_id", "pattern_id"])


def suite_tag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every suite has records of exactly the required types."""
    return A.tag_coverage(table(spark, sf_dir, "eval_records"), F.coalesce("suite", F.lit("none")), F.col("type"), ["positive", "negative", "provenance", "adversarial"]).withColumnRenamed("by", "suite")


def split_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of the orders' temporal split against floors of support."""
    whole = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group")).agg(F.count(F.lit(1)).alias("records"), F.max("o_orderdate").alias("anchor"))
    counts = whole.join(C.temporal_split(whole), "group").groupBy(F.col("role").alias("part")).agg(F.count(F.lit(1)).alias("groups"), F.sum("records").alias("records"))
    return A.support(counts, {"train": 1000, "": 1800})


def join_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a self join of span records on document and entity would emit."""
    return A.emissions(table(spark, sf_dir, "span_records").select("document_id", F.lower("entity_id").alias("e")), ["document_id", "e"])


def source_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 mail rows by id: the trial form of a source."""
    return A.first_rows(table(spark, sf_dir, "enron_preparation").select("row_id", "mailbox"), ["row_id"], 100)


def pattern_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five active patterns of each entity in detector order."""
    surface = F.when(F.col("kind") == "literal", F.col("value")).otherwise(F.col("pattern_id"))
    rows = _patterns(spark, sf_dir).where(banks.chain_active()).select("entity_id", "name_id", "pattern_id", "priority", "canonical", surface.alias("surface"), "value")
    return A.examples(rows, "entity_id", ["priority", "canonical", "surface", "value"], 5).select("entity_id", "name_id", "pattern_id", "surface")


def _bucket() -> Column:
    return T.size_bucket(F.coalesce(F.octet_length("text"), F.lit(0)))


def margin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 documents by language and size, with one of every source and year reserved."""
    stratum = F.concat_ws("/", F.coalesce("lang", F.lit("?")), _bucket())
    return A.margin_sample(table(spark, sf_dir, "documents"), "doc_id", stratum, [F.col("source"), F.year("created_at")], 300)


def sealed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents by size, one of each group of equal texts at most."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return A.sealed_sample(docs, "doc_id", F.sha2("text", 256), _bucket(), 100)


def benchmark_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 documents of a benchmark: lowest hashes among texts of a kilobyte or more."""
    docs = table(spark, sf_dir, "documents").where(F.octet_length("text") >= 1024).select("doc_id", F.octet_length("text").alias("bytes"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return A.first_rows(docs, ["h", "doc_id"], 100).drop("h")


def binding_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the expected spans and those of the scan cover one another: keys by status."""
    return A.cover(_gold(spark, sf_dir), _predicted(spark, sf_dir), SPANS).groupBy("status").agg(F.count(F.lit(1)).alias("keys"), F.sum("labels").alias("labels"), F.sum("bindings").alias("bindings"))


def size_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents in bytes by language."""
    docs = table(spark, sf_dir, "documents").withColumn("lang", F.coalesce("lang", F.lit("?")))
    return A.inventory(docs, ["lang"], F.octet_length("text").cast("long"))


def density_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a document by entity, over the documents that have any."""
    rows = scans.scan(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir)).groupBy("entity", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return A.inventory(rows.withColumnRenamed("n", "hits"), ["entity"], F.col("hits"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.count("text").alias("texts"), (F.count("text") / F.count(F.lit(1))).alias("text_share"))
    evals = table(spark, sf_dir, "eval_records").agg(F.countDistinct("suite").alias("suites"), F.count_if(F.col("type") == "negative").alias("negatives"))
    pair = lambda c: F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
    both = docs.select(F.explode(F.array(*map(pair, docs.columns))).alias("m")).union(evals.select(F.explode(F.array(*map(pair, evals.columns))).alias("m")))
    return both.select("m.*")


def evidence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates recomputed from counts; one of them has nothing to be measured by and fails."""
    rules = {"documents": ("least", 50), "text_share": ("least", 0.9), "suites": ("most", 4), "negatives": ("least", 10), "reviewers": ("least", 2)}
    return A.gates(_measured(spark, sf_dir), rules)


def entity_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks of more and more entities as iterations over the evaluation records: which one stands."""
    gold, predicted = _gold(spark, sf_dir).select(*SPANS, "entity_id").distinct(), _predicted(spark, sf_dir).select(*SPANS, "entity_id").distinct()
    hit = gold.join(predicted, [*SPANS, "entity_id"], "left_semi")
    count = lambda df, name: df.groupBy("entity_id").agg(F.count(F.lit(1)).alias(name))
    per = {r["entity_id"]: r for r in count(gold, "g").join(count(predicted, "p"), "entity_id", "full_outer").join(count(hit, "h"), "entity_id", "left").na.fill(0).collect()}  # one row an entity of a bank
    metrics, total = [], sum(r["g"] for r in per.values())
    known = {"g": 0, "p": 0, "h": 0}
    for entity in sorted(per):
        known = {k: known[k] + per[entity][k] for k in known}
        metrics.append({"name": entity, "support": known["g"], "precision": known["h"] / known["p"] if known["p"] else None, "recall": known["h"] / total if total else None})
    rows = A.decide_iterations(metrics, 20)
    return spark.createDataFrame([(i, r["name"], r["reason"], r["selected"]) for i, r in enumerate(rows)], "iteration int, name string, reason string, selected boolean")


def privacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns of the documents that hold private shapes, with how many rows."""
    return D.privacy_violations(table(spark, sf_dir, "documents"))


def bad_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document ids of the span records that more than one row has or that are no ids."""
    return D.bad_ids(table(spark, sf_dir, "span_records"), "document_id")


def quality_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected spans found and missed by the bank of one entity and by the whole one, and the change."""
    gold = _gold(spark, sf_dir).select(*SPANS, "entity_id").distinct()
    texts = table(spark, sf_dir, "eval_records").where("text is not null").select("eval_id", "text")

    def counts(entity: str | None) -> dict[str, int]:
        found = scans.scan(texts, "eval_id", "text", load_detectors(spark, sf_dir, entity)).select(F.col("eval_id").alias("document"), "start", "end", "entity_id", F.lit(1).alias("hit")).distinct()
        row = gold.join(found, [*SPANS, "entity_id"], "left").agg(F.count("hit").alias("passed"), (F.count(F.lit(1)) - F.count("hit")).alias("failed")).first()
        return row.asDict()

    before, after = counts("vessel"), counts(None)
    delta = V.quality_delta(before, after)
    return spark.createDataFrame([(k, before[k], after[k], delta[k]) for k in sorted(delta)], "metric string, before long, after long, delta long")


def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the whole bank may follow the bank of one entity, and the other way round."""
    rows = {r["metric"]: r for r in quality_delta(spark, sf_dir).collect()}
    sides = {s: {"suite_hash": "x", **{k: rows[k][s] for k in ("passed", "failed")}} for s in ("before", "after")}
    out = [("forward", V.regress(sides["before"], sides["after"])), ("backward", V.regress(sides["after"], sides["before"]))]
    return spark.createDataFrame([(k, r["accepted"], ",".join(r["reasons"])) for k, r in out], "direction string, accepted boolean, reasons string")


def empty_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regexes of the bank as they are and made optional: whether they match nothing somewhere."""
    rows = [r["value"] for r in _patterns(spark, sf_dir).where("kind = 'regex'").select("value").distinct().collect()]  # bounded by the bank's limits
    out = [(v, form, banks.matches_empty(p, [])) for v in rows for form, p in (("stored", v), ("optional", f"(?:{v})?"))]
    return spark.createDataFrame(out, "value string, form string, empty boolean")


def risk_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static risks of the bank's regexes by name, from the single-pattern form of the lints: of their first three
    characters, and of the regexes repeated twice over."""
    rows = [r["value"] for r in _patterns(spark, sf_dir).where("kind = 'regex'").select("value").collect()]  # bounded by the bank's limits
    counts: dict[tuple[str, str], int] = {}
    for v in rows:
        for form, p in (("cut", v[:3]), ("nested", f"({v}+)*")):
            for k in L.risks(p):
                if k != "ambiguous_alternation":
                    counts[form, k] = counts.get((form, k), 0) + 1
    return spark.createDataFrame([(*k, n) for k, n in sorted(counts.items())], "form string, risk string, patterns long")


def conformance_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated conformance cases of the bank's active literals, by tag."""
    bank = bank_from_table(table(spark, sf_dir, "bank_patterns").where("kind = 'literal'"))
    positives, negatives = L.conformance_cases(bank)
    rows = [(c["tag"], 1) for c in (*positives, *negatives)]
    return spark.createDataFrame(rows, "tag string, n long").groupBy("tag").agg(F.sum("n").alias("cases"))


def synthetic_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the invented benchmark banks."""
    rows = []
    for name in V.PROFILES:
        total = banks.stats(V.profile(name))["totals"]
        rows.append((name, total["entities"], total["names"], total["patterns"]))
    return spark.createDataFrame(rows, "profile string, entities long, names long, patterns long")


_ALL = (suite_hashes, prediction_digest, suite_tag_coverage, split_support, join_budget, source_prefix, pattern_examples, margin_sample, sealed_sample, benchmark_documents, binding_cover, size_inventory, density_inventory, evidence_gates, entity_iterations, privacy_scan, bad_document_ids, quality_delta, regression_gate, empty_matches, risk_census, conformance_census, synthetic_profiles)
QUERIES = {f.__name__: f for f in _ALL}

COVER = """g AS (SELECT document, s, e, count(*) AS labels FROM gold GROUP BY ALL), p AS (SELECT document, s, e, count(*) AS bindings FROM pred GROUP BY ALL),
  c AS (SELECT coalesce(labels, 0) AS labels, coalesce(bindings, 0) AS bindings FROM g FULL JOIN p USING (document, s, e))"""
QUOTA = """p AS (SELECT stratum, count(*) AS population FROM {rows} GROUP BY 1), w AS (SELECT least({size}, sum(population)) AS rest, sum(population) AS room FROM p),
  q AS (SELECT *, CAST(floor(rest * population / room) AS BIGINT) AS f, CAST(rest * population AS BIGINT) % CAST(room AS BIGINT) AS r FROM p, w), z AS (SELECT *, rest - sum(f) OVER () AS residual, row_number() OVER (ORDER BY r DESC, stratum) AS rk FROM q),
  y AS (SELECT stratum, f + CASE WHEN rk <= residual THEN 1 ELSE 0 END AS quota FROM z)"""
BANKS = f"""WITH {EVAL}, {GOLD}, {PRED}, g AS (SELECT DISTINCT document, entity_id, s, e FROM gold), p AS (SELECT DISTINCT document, entity_id, s, e FROM pred),
  h AS (SELECT g.*, p.s IS NOT NULL AS hit FROM g LEFT JOIN p ON (g.document, g.entity_id, g.s, g.e) = (p.document, p.entity_id, p.s, p.e))"""
INVENTORY = "count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, quantile_disc(v, 0.5) AS median, quantile_disc(v, 0.95) AS p95, max(v) AS most"
ORACLE = {
    "suite_hashes": """SELECT suite, count(*) AS entries, sha256(string_agg(h, '' ORDER BY eval_id)) AS suite_hash FROM (SELECT coalesce(suite, 'none') AS suite, eval_id,
        sha256('[' || to_json(CAST(eval_id AS VARCHAR)) || ',' || to_json(coalesce(type, '')) || ',' || to_json(coalesce(text, '')) || ',' || to_json(coalesce(reason, '')) || ']') AS h FROM eval_records) GROUP BY 1""",
    "prediction_digest": f"""WITH {DETECTORS}, r AS (SELECT doc_id, bs, be, entity_id, name_id, pattern_id, sha256(concat_ws(chr(1), CAST(bs AS BIGINT), CAST(be AS BIGINT), entity_id, name_id, pattern_id)) AS h FROM won),
        d AS (SELECT doc_id, count(*) AS n, sha256(string_agg(h, '' ORDER BY bs, be, entity_id, name_id, pattern_id)) AS h FROM r GROUP BY 1), s AS (SELECT doc_id // 1000 AS slice, count(*) AS documents, sum(n) AS n, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM d GROUP BY 1)
        SELECT CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS records, sha256(string_agg(h, '' ORDER BY slice)) AS digest FROM s""",
    "suite_tag_coverage": """WITH t AS (SELECT coalesce(suite, 'none') AS suite, list(DISTINCT type) AS tags FROM eval_records GROUP BY 1), m AS (SELECT suite, array_to_string(list_sort(list_filter(['positive','negative','provenance','adversarial'], lambda x: NOT list_contains(tags, x))), ',') AS missing,
        array_to_string(list_sort(list_filter(tags, lambda x: x NOT IN ('positive','negative','provenance','adversarial'))), ',') AS unexpected FROM t) SELECT *, missing = '' AND unexpected = '' AS covered FROM m""",
    "split_support": f"""WITH whole AS (SELECT o_custkey AS g, count(*) AS records, max(o_orderdate) AS anchor FROM orders GROUP BY 1), {SPLIT}, r AS (SELECT CASE WHEN cum.c <= a.c THEN 'train' WHEN cum.c <= b.c THEN 'validation' ELSE 'test' END AS part, records FROM cum, a, b)
        SELECT part, count(*) AS groups, CAST(sum(records) AS BIGINT) AS records, CAST(CASE part WHEN 'train' THEN 1000 ELSE 1800 END AS BIGINT) AS floor, sum(records) >= CASE part WHEN 'train' THEN 1000 ELSE 1800 END AS supported FROM r GROUP BY 1""",
    "join_budget": "SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS emissions FROM (SELECT count(*) AS n FROM span_records GROUP BY document_id, lower(entity_id))",
    "source_prefix": "SELECT row_id, mailbox FROM enron_preparation ORDER BY row_id LIMIT 100",
    "pattern_examples": f"WITH {CLEAN}, s AS (SELECT *, CASE WHEN kind = 'literal' THEN value ELSE pattern_id END AS surface FROM clean WHERE entity_status = 'active' AND name_status = 'active' AND status = 'active') SELECT entity_id, name_id, pattern_id, surface FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY priority, canonical, surface, value) AS n FROM s) WHERE n <= 5",
    "margin_sample": f"""WITH d AS (SELECT doc_id, concat_ws('/', coalesce(lang, '?'), {SIZE}) AS stratum, sha256('margin' || chr(1) || doc_id) AS rank, coalesce(source, '') AS m0, coalesce(CAST(year(created_at) AS VARCHAR), '') AS m1 FROM (SELECT *, coalesce(strlen(text), 0) AS b FROM documents)),
        res AS (SELECT DISTINCT doc_id FROM (SELECT min_by(doc_id, (rank, doc_id)) AS doc_id FROM d GROUP BY stratum UNION ALL SELECT min_by(doc_id, (rank, doc_id)) FROM d GROUP BY m0 UNION ALL SELECT min_by(doc_id, (rank, doc_id)) FROM d GROUP BY m1)),
        lft AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM res)), {QUOTA.format(rows="lft", size="greatest(0, 300 - (SELECT count(*) FROM res))")}
        SELECT doc_id, stratum, true AS reserved FROM d WHERE doc_id IN (SELECT doc_id FROM res) UNION ALL SELECT doc_id, stratum, false FROM (SELECT lft.*, quota, row_number() OVER (PARTITION BY stratum ORDER BY rank, doc_id) AS n FROM lft JOIN y USING (stratum)) WHERE n <= quota""",
    "sealed_sample": f"""WITH d AS (SELECT doc_id, text, {SIZE} AS stratum, sha256('sealed' || chr(1) || doc_id) AS rank FROM (SELECT *, strlen(text) AS b FROM documents WHERE text IS NOT NULL)),
        c AS (SELECT doc_id, stratum, rank FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, doc_id) AS n FROM d) WHERE n = 1), {QUOTA.format(rows="c", size="100")}
        SELECT doc_id, stratum FROM (SELECT c.*, quota, row_number() OVER (PARTITION BY stratum ORDER BY rank, doc_id) AS n FROM c JOIN y USING (stratum)) WHERE n <= quota""",
    "benchmark_documents": "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes FROM documents WHERE strlen(text) >= 1024 ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100",
    "binding_cover": f"""WITH {EVAL}, {GOLD}, {PRED}, {COVER} SELECT CASE WHEN bindings = 0 THEN 'missing' WHEN labels = 0 THEN 'extra' WHEN labels > 1 OR bindings > 1 THEN 'duplicate' ELSE 'exact' END AS status, count(*) AS keys, CAST(sum(labels) AS BIGINT) AS labels, CAST(sum(bindings) AS BIGINT) AS bindings FROM c GROUP BY 1""",
    "size_inventory": f"SELECT lang, {INVENTORY} FROM (SELECT coalesce(lang, '?') AS lang, CAST(strlen(text) AS BIGINT) AS v FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "density_inventory": f"WITH {DETECTORS} SELECT entity, {INVENTORY} FROM (SELECT entity_id AS entity, doc_id, count(*) AS v FROM won GROUP BY 1, 2) GROUP BY 1",
    "evidence_gates": """WITH m AS (SELECT 'documents' AS gate, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'text_share', count(text) / count(*) FROM documents UNION ALL SELECT 'suites', count(DISTINCT suite) FROM eval_records UNION ALL SELECT 'negatives', count(*) FILTER (type = 'negative') FROM eval_records),
        r(gate, side, bound) AS (VALUES ('documents', 'least', 50.0::DOUBLE), ('text_share', 'least', 0.9::DOUBLE), ('suites', 'most', 4.0::DOUBLE), ('negatives', 'least', 10.0::DOUBLE), ('reviewers', 'least', 2.0::DOUBLE))
        SELECT gate, value, bound, coalesce(CASE side WHEN 'least' THEN value >= bound ELSE value <= bound END, false) AS passed FROM r LEFT JOIN m USING (gate)""",
    "privacy_scan": "SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS column, count(*) AS rows FROM documents WHERE regexp_matches({c}, '[\\w.+-]+@[\\w-]+\\.\\w|\\+?\\d[\\d ().-]{{8,}}\\d|\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b|(?:^|\\s)(?:/[\\w.-]+){{2,}}|[A-Za-z]:\\\\')""" for c in ("text", "lang", "source", "text_view", "subject", "author_address")) + ") WHERE rows > 0",
    "bad_document_ids": "SELECT document_id, count(*) AS rows FROM span_records GROUP BY 1 HAVING count(*) > 1 OR document_id IS NULL OR NOT regexp_matches(document_id, '^[a-z][a-z0-9_]{0,79}$')",
    "quality_delta": f"""{BANKS}, b AS (SELECT count(*) FILTER (hit AND entity_id = 'vessel') AS bp, count(*) FILTER (hit) AS ap, count(*) AS n FROM h)
        SELECT 'passed' AS metric, bp AS before, ap AS after, ap - bp AS delta FROM b UNION ALL SELECT 'failed', n - bp, n - ap, bp - ap FROM b""",
    "regression_gate": f"""{BANKS}, b AS (SELECT count(*) FILTER (hit AND entity_id = 'vessel') AS bp, count(*) FILTER (hit) AS ap FROM h)
        SELECT 'forward' AS direction, ap >= bp AS accepted, CASE WHEN ap >= bp THEN '' ELSE 'more evaluations fail' END AS reasons FROM b UNION ALL SELECT 'backward', bp >= ap, CASE WHEN bp >= ap THEN '' ELSE 'more evaluations fail' END FROM b""",
    "empty_matches": f"""WITH {CLEAN}, v AS (SELECT DISTINCT value FROM clean WHERE kind = 'regex') SELECT value, 'stored' AS form, regexp_full_match('', value) AS empty FROM v UNION ALL SELECT value, 'optional', regexp_full_match('', '(?:' || value || ')?') FROM v""",

    "conformance_census": f"""WITH {CLEAN}, f AS (SELECT entity_id, bool_or(list_contains(entity_flags, 'IGNORECASE')) AS ci FROM clean WHERE kind = 'literal' GROUP BY 1), a AS (SELECT c.*, coalesce(ci, false) AS ci FROM clean c JOIN f USING (entity_id) WHERE kind = 'literal' AND entity_status = 'active' AND name_status = 'active' AND status = 'active')
        SELECT tag, count(*) AS cases FROM (SELECT unnest(list_filter(['exact', CASE WHEN ci OR NOT case_sensitive THEN 'casing' END, 'context', CASE WHEN normalize_whitespace AND regexp_matches(value, '\\s') THEN 'whitespace' END, CASE WHEN left_boundary = 'word' AND right_boundary = 'word' THEN 'boundary' END], lambda x: x IS NOT NULL)) AS tag FROM a) GROUP BY 1""",
    "synthetic_profiles": "SELECT profile, CAST(e AS BIGINT) AS entities, CAST(e * n AS BIGINT) AS names, CAST(e * n * p AS BIGINT) AS patterns FROM (VALUES ('small', 2, 3, 2), ('literal_heavy', 4, 50, 4), ('regex_heavy', 4, 20, 3), ('mixed', 4, 30, 3), ('adversarial_smoke', 2, 10, 6)) AS t(profile, e, n, p)",
}


def _lint_twin(form: str, value: str) -> str:
    from bankspark.plans.bank_queries import ORACLE as BANK

    risks = ("nested_quantifier", "unbounded_dot_star", "huge_alternation", "repeated_lookaround", "excessive_groups", "short_unbounded", "literal_candidate")
    lint = BANK["bank_lint"].replace("FROM clean WHERE", f"FROM (SELECT * REPLACE ({value} AS value) FROM clean) WHERE")
    return f"SELECT '{form}' AS form, risk, count(*) AS patterns FROM (SELECT unnest([{', '.join(map(repr, risks))}]) AS risk, unnest([{', '.join(risks)}]) AS yes FROM ({lint})) WHERE yes GROUP BY 2"


ORACLE["risk_census"] = _lint_twin("cut", "substr(value, 1, 3)") + " UNION ALL " + _lint_twin("nested", "'(' || value || '+)*'")
