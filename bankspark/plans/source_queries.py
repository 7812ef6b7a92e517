"""Queries that send whole tables through the sources, sinks, stores and bank algebra and back, with SQL twins on the tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark import model
from bankspark.functions import text as T
from bankspark.functions.normal import normalised
from bankspark.model import BankError
from bankspark.operators import bank as banks
from bankspark.operators import corpus as C
from bankspark.operators import rewrite as R
from bankspark.operators import scan as scans
from bankspark.plans.bank_queries import CLEAN, DETECTORS, IDS, _documents, _patterns
from bankspark.plans.quality_queries import EVAL, KEPT
from bankspark.runtime import checkpoint_path, table
from bankspark.sources import files
from bankspark.sources.tables import bank_from_table, load_detectors


def _place(spark: SparkSession, name: str) -> str:
    """A new folder for files in the place that all executors share."""
    return f"{checkpoint_path(spark)}/{name}-{uuid.uuid4().hex}"


def _bank(spark: SparkSession, sf_dir: str, statuses: tuple[str, ...] = ("active",)) -> dict:
    return bank_from_table(table(spark, sf_dir, "bank_patterns"), statuses)


def _rows(spark: SparkSession, bank: dict) -> DataFrame:
    return banks.flatten(spark, bank).select(*IDS, "kind", "value", "priority")


def source_bank_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active bank written as canonical JSON, read strictly and checked, as rows."""
    at = _place(spark, "bank")
    spark.createDataFrame([(banks.canonical_json(banks.canonical(_bank(spark, sf_dir))),)], "value string").coalesce(1).write.text(at)
    return _rows(spark, files.read_bank_text(spark, at))


def source_detector_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank's active regexes as a compact map and as JSON lines, with the form told from the text, parsed again."""
    rows = [r.asDict() for r in _patterns(spark, sf_dir).where(banks.chain_active() & (F.col("kind") == "regex")).select(*IDS, "value").collect()]  # bounded by the bank's limits
    compact: dict[str, dict[str, str]] = {}
    for r in rows:
        compact.setdefault(r["entity_id"], {})[f"{r['name_id']}.{r['pattern_id']}"] = r["value"]
    lines = "\n".join(json.dumps({"entity": r["entity_id"], "name": f"{r['name_id']}.{r['pattern_id']}", "regex": r["value"]}) for r in rows)
    out = []
    for text in (json.dumps(compact), lines):
        form = files.sniff(text)
        found = files.detector_rows_from_jsonl(text) if form == "jsonl" else files.detector_rows_from_map(files.parse_config(text))
        out += [(form, r["entity"], r["name"], r["regex"]) for r in found]
    return spark.createDataFrame(out, "form string, entity string, name string, regex string")


def source_mail_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mail as JSON lines, with blank and broken lines between, read back: rows, subjects and recipients by error."""
    at = _place(spark, "mail")
    mail = table(spark, sf_dir, "enron_preparation").select(*[c for c in model.MAIL.fieldNames() if c != "_corrupt_record"])
    lines = mail.select(F.to_json(F.struct("*")).alias("value"))
    broken = spark.createDataFrame([("",), ("   ",), ('{"message_id": ',), ("no json",)], "value string")
    lines.union(broken).write.text(at)
    rows = files.read_mail(spark, at)
    return rows.groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("rows"), F.count("subject").alias("subjects"), F.coalesce(F.sum(F.size("to")), F.lit(0)).alias("recipients"))


def source_eval_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evaluation records as JSON lines, read back and checked: by type and error."""
    at = _place(spark, "evals")
    names = [c for c in model.EVALS.fieldNames() if c != "_corrupt_record"]
    rows = table(spark, sf_dir, "eval_records").select(*[F.col(c).cast("string").alias(c) if c == "observed_at" else F.col(c) for c in names])
    turned = rows.withColumn("type", F.when(F.col("type") == "positive", "negative").otherwise("unheard"))
    rows.union(turned).select(F.to_json(F.struct("*")).alias("value")).write.text(at)
    return files.read_evals(spark, at).groupBy("type", F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.size("matches")), F.lit(0)).alias("matches"))


def source_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each evaluation text, read as strict UTF-8: files and bytes by error."""
    at = _place(spark, "texts")
    table(spark, sf_dir, "eval_records").where("text is not null").select("eval_id", "text").repartition(8).write.partitionBy("eval_id").text(at)
    rows = files.read_texts(spark, f"{at}/*/*.txt")
    return rows.groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


def sink_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by role of their customer and read back by folder."""
    at = _place(spark, "roles")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    roles = C.hash_split(orders.select(F.col("o_custkey").alias("group")).distinct()).withColumnRenamed("group", "o_custkey")
    files.write_roles(orders.join(roles, "o_custkey"), at)
    return spark.read.parquet(at).groupBy("role").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys"))


def sink_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan records as JSON lines and as CSV, read back: records and starts by entity and form."""
    rows = scans.scan(_documents(spark, sf_dir), "doc_id", "text", load_detectors(spark, sf_dir)).select("doc_id", "start", "end", *IDS)
    out = []
    for form in ("json", "csv"):
        at = _place(spark, form)
        files.write_records(rows, at, form)
        reader = spark.read.schema("doc_id long, start long, `end` long, entity_id string, name_id string, pattern_id string")
        back = reader.json(at) if form == "json" else reader.option("header", True).csv(at)
        out.append(back.select(F.lit(form).alias("form"), "entity_id", "start"))
    return out[0].union(out[1]).groupBy("form", "entity_id").agg(F.count(F.lit(1)).alias("records"), F.sum("start").alias("starts"))


def sink_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written twice under an optimistic version and once under a stale one: version or refusal of each step."""
    at, rows = _place(spark, "versions"), table(spark, sf_dir, "supplier").select("s_suppkey")
    out = []
    for step, (expected, df) in enumerate(((0, rows), (1, rows.where("s_suppkey > 1")), (1, rows)), 1):
        try:
            version = files.write_version(df, at, expected)
            out.append((step, version, spark.read.parquet(f"{at}/v{version}").count(), False))
        except BankError:
            out.append((step, files.current_version(spark, at), None, True))
    return spark.createDataFrame(out, "step int, version int, rows long, refused boolean")


def store_anonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation texts anonymised in turn with one replacement store, which is checked and restores them: edits of each."""
    texts = table(spark, sf_dir, "eval_records").where("text is not null").select("eval_id", "text")
    kept = R.without_overlap(scans.scan(texts, "eval_id", "text", load_detectors(spark, sf_dir)), "eval_id")
    per = kept.groupBy("eval_id").agg(F.collect_list(F.struct("start", "end", "entity_id", "name_id", "string")).alias("records"))
    rows = texts.join(per, "eval_id", "left").orderBy("eval_id").collect()  # evaluation sources are bounded, and a store grows text by text
    store, out = R.new_store({"scope": "surface"}), []
    for r in rows:
        changed, store, edits = R.anonymise_text(r["text"], [x.asDict() for x in r["records"] or []], store)
        out.append((r["eval_id"], len(edits), R.restore_one(changed, store) == r["text"]))
    if R.check_store(store):
        raise BankError("the store is not sound")
    return spark.createDataFrame(out, "eval_id long, edits long, restored boolean")


def bank_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank of all statuses turned into the active one by its own patch, as rows."""
    old, new = _bank(spark, sf_dir, model.STATUSES), _bank(spark, sf_dir)
    return _rows(spark, banks.patch(old, banks.diff(old, new)["patch"]))


def bank_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members removed and changed by level, from the bank of all statuses to the active one."""
    found = banks.diff(_bank(spark, sf_dir, model.STATUSES), _bank(spark, sf_dir))["summary"]
    return spark.createDataFrame([(k, found[f"{k}_removed"], found[f"{k}_changed"], found[f"{k}_added"]) for k in ("entities", "names", "patterns")], "level string, removed long, changed long, added long")


def bank_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active bank with the first pattern of each entity taken out and one put in, as rows."""
    bank = _bank(spark, sf_dir)
    for e in sorted(bank["entities"]):
        n, p = min((n, p) for n, name in bank["entities"][e]["names"].items() for p in name["patterns"])
        bank = banks.remove_pattern(bank, e, n, p)
        bank = banks.add_pattern(bank, e, "added", "added", {"kind": "literal", "value": f"added to {e}", "description": "", "status": "active", "priority": 7, "metadata": {}, "case_sensitive": True, "normalize_whitespace": True, "left_boundary": "word", "right_boundary": "word"})
    return _rows(spark, bank)


def bank_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable id and digest of the canonical JSON of each pattern of all statuses."""
    rows = [r.asDict() for r in _rows(spark, _bank(spark, sf_dir, model.STATUSES)).collect()]  # bounded by the bank's limits
    import hashlib

    digest = lambda r: hashlib.sha256(banks.canonical_json([r[c] for c in (*IDS, "kind", "value", "priority")]).encode()).hexdigest()
    return spark.createDataFrame([(*[r[c] for c in IDS], banks.stable_id("pattern", *[r[c] for c in IDS]), digest(r)) for r in rows], "entity_id string, name_id string, pattern_id string, stable_id string, digest string")


def hash_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain-separated hash, its first 64 bits and its rest modulo 97 for every document id."""
    h = T.domain_hash("document", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("h")).select("doc_id", "h", T.hash64(F.col("h")).cast("string").alias("h64"), T.hash_mod(F.col("h"), 97).cast("int").alias("mod97"))


def entity_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made from the names of canonicals and documents' subjects."""
    raw = table(spark, sf_dir, "bank_patterns").select(F.col("canonical").alias("raw")).union(table(spark, sf_dir, "documents").select("subject")).union(table(spark, sf_dir, "bank_patterns").select("entity_id"))
    return raw.where("raw is not null").distinct().select("raw", T.entity_slug(F.col("raw")).alias("slug"))


def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 characters and 50 bytes of every text, cut between characters."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.cut_to(F.col("text"), 60, 50).alias("head"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFC of every text with origins: its digest and length, and that the whole span goes back to the whole text."""
    import pandas as pd

    def form(texts: pd.Series) -> pd.DataFrame:
        made = [normalised(t, "NFC") for t in texts]
        return pd.DataFrame({"form": [n.form for n in made], "whole": [n.span(0, len(n.form)) == (0, len(n.text)) for n in made]})

    form.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    made = F.pandas_udf(form, "form string, whole boolean")
    rows = table(spark, sf_dir, "documents").where("text is not null and text <> ''").select("doc_id", made("text").alias("n"))
    return rows.select("doc_id", F.sha2("n.form", 256).alias("digest"), F.length("n.form").alias("chars"), F.col("n.whole").alias("whole"))


_ALL = (source_bank_json, source_detector_forms, source_mail_jsonl, source_eval_jsonl, source_text_files, sink_roles, sink_records, sink_versions, store_anonymise, bank_patch, bank_diff_counts, bank_edits, bank_digests, hash_columns, entity_slugs, cut_texts, normal_forms)
QUERIES = {f.__name__: f for f in _ALL}

LIVE = "entity_status = 'active' AND name_status = 'active' AND status = 'active'"
KNOWN = "entity_status IN ('draft','active','inactive','deprecated') AND name_status IN ('draft','active','inactive','deprecated') AND status IN ('draft','active','inactive','deprecated')"
FRAMED = "unhex(printf('%016x', strlen({c}))) || encode({c})"
ORACLE = {
    "source_bank_json": f"WITH {CLEAN} SELECT entity_id, name_id, pattern_id, kind, value, priority FROM clean WHERE {LIVE}",
    "source_detector_forms": f"WITH {CLEAN} SELECT form, entity_id AS entity, name_id || '.' || pattern_id AS name, value AS regex FROM clean, (SELECT unnest(['map', 'jsonl']) AS form) WHERE {LIVE} AND kind = 'regex'",
    "source_mail_jsonl": """SELECT '' AS error, count(*) AS rows, count(subject) AS subjects, CAST(sum(len("to")) AS BIGINT) AS recipients FROM enron_preparation UNION ALL SELECT 'blank_line', 2, 0, 0 UNION ALL SELECT 'malformed_json', 2, 0, 0""",
    "source_eval_jsonl": """WITH r AS (SELECT type, text, matches, source_type FROM eval_records UNION ALL SELECT CASE type WHEN 'positive' THEN 'negative' ELSE 'unheard' END, text, matches, source_type FROM eval_records)
        SELECT type, CASE WHEN type = 'unheard' THEN 'unknown_type' WHEN type = 'positive' AND (text IS NULL OR matches IS NULL) THEN 'positive_without_matches' WHEN type = 'negative' AND (text IS NULL OR matches IS NOT NULL) THEN 'negative_with_matches'
          WHEN type = 'provenance' AND source_type IS NULL THEN 'provenance_without_source' ELSE '' END AS error, count(*) AS records, CAST(coalesce(sum(len(matches)), 0) AS BIGINT) AS matches FROM r GROUP BY 1, 2""",
    "source_text_files": "SELECT '' AS error, count(text) AS files, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM eval_records WHERE text IS NOT NULL",
    "sink_roles": "SELECT CASE WHEN f < 0.8 THEN 'train' WHEN f < 0.9 THEN 'validation' ELSE 'test' END AS role, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, CAST(('0x' || substr(sha256('split' || chr(1) || o_custkey), 1, 13)) AS BIGINT) / 4503599627370496.0 AS f FROM orders) GROUP BY 1",
    "sink_records": f"WITH {DETECTORS} SELECT form, entity_id, count(*) AS records, CAST(sum(bs) AS BIGINT) AS starts FROM won, (SELECT unnest(['json', 'csv']) AS form) GROUP BY 1, 2",
    "sink_versions": "WITH n AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey > 1) AS m FROM supplier) SELECT CAST(1 AS INTEGER) AS step, CAST(1 AS INTEGER) AS version, n AS rows, false AS refused FROM n UNION ALL SELECT 2, 2, m, false FROM n UNION ALL SELECT 3, 2, NULL, true",
    "store_anonymise": f"WITH {KEPT.replace(DETECTORS, EVAL)} SELECT eval_id, coalesce(n, 0) AS edits, true AS restored FROM eval_records LEFT JOIN (SELECT doc_id AS eval_id, count(*) AS n FROM kept GROUP BY 1) USING (eval_id) WHERE text IS NOT NULL",
    "bank_patch": f"WITH {CLEAN} SELECT entity_id, name_id, pattern_id, kind, value, priority FROM clean WHERE {LIVE}",
    "bank_edits": f"WITH {CLEAN}, a AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY name_id, pattern_id) AS n FROM clean WHERE {LIVE}) SELECT entity_id, name_id, pattern_id, kind, value, priority FROM a WHERE n > 1 UNION ALL SELECT DISTINCT entity_id, 'added', 'added', 'literal', 'added to ' || entity_id, CAST(7 AS BIGINT) FROM a",
    "bank_diff_counts": f"""WITH {CLEAN}, k AS (SELECT *, ({LIVE}) AS live FROM clean WHERE {KNOWN}), n AS (SELECT entity_id, name_id, bool_or(live) AS part, bool_and(live) AS whole FROM k GROUP BY ALL), e AS (SELECT entity_id, bool_or(live) AS part, bool_and(live) AS whole FROM k GROUP BY ALL)
        SELECT 'patterns' AS level, count(*) FILTER (NOT live) AS removed, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS added FROM k UNION ALL SELECT 'names', count(*) FILTER (NOT part), count(*) FILTER (part AND NOT whole), 0 FROM n UNION ALL SELECT 'entities', count(*) FILTER (NOT part), count(*) FILTER (part AND NOT whole), 0 FROM e""",
    "bank_digests": f"""WITH {CLEAN} SELECT entity_id, name_id, pattern_id, 'pattern:sha256:' || sha256({FRAMED.format(c="'pattern'")} || {FRAMED.format(c='entity_id')} || {FRAMED.format(c='name_id')} || {FRAMED.format(c='pattern_id')}) AS stable_id,
        sha256('[' || to_json(entity_id) || ',' || to_json(name_id) || ',' || to_json(pattern_id) || ',' || to_json(kind) || ',' || to_json(value) || ',' || priority || ']') AS digest FROM clean WHERE {KNOWN}""",
    "hash_columns": "WITH h AS (SELECT doc_id, sha256('document' || chr(0) || doc_id) AS h FROM documents) SELECT doc_id, h, CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) AS VARCHAR) AS h64, CAST(list_reduce(list_transform(range(1, 65), lambda i: CAST('0x' || substr(h, i, 1) AS BIGINT)), lambda a, d: (a * 16 + d) % 97) AS INTEGER) AS mod97 FROM h",
    "entity_slugs": r"""WITH r AS (SELECT canonical AS raw FROM bank_patterns UNION SELECT subject FROM documents UNION SELECT entity_id FROM bank_patterns), s AS (SELECT raw, regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS s FROM r WHERE raw IS NOT NULL)
        SELECT raw, CASE WHEN regexp_full_match(raw, '[a-z][a-z0-9_]{0,79}') THEN raw ELSE rtrim(substr(CASE WHEN s = '' THEN 'entity' WHEN regexp_matches(s, '^[0-9]') THEN 'entity_' || s ELSE s END, 1, 67), '_') || '_' || substr(sha256(raw), 1, 12) END AS slug FROM s""",
    "cut_texts": "SELECT doc_id, substring(text, 1, list_max(list_filter(range(0, 61), lambda i: strlen(substring(text, 1, i)) <= 50))) AS head FROM documents WHERE text IS NOT NULL",
    "normal_forms": "SELECT doc_id, sha256(nfc_normalize(text)) AS digest, CAST(length(nfc_normalize(text)) AS INTEGER) AS chars, true AS whole FROM documents WHERE text <> ''",
}
