"""Queries of the corpus pipeline, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark.functions import text as T
from bankspark.operators import corpus as C
from bankspark.operators.timestamps import to_utc
from bankspark.runtime import cut, table


def _mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "enron_preparation")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = _mail(spark, sf_dir)
    return C.features(mail).union(C.near_family(mail))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.leakage_groups(_features(spark, sf_dir), _mail(spark, sf_dir).select(F.col("row_id").alias("node")))


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, group table, roles), with load times as the time axis."""
    groups = cut(_groups(spark, sf_dir))
    at = _mail(spark, sf_dir).select(F.col("row_id").alias("node"), F.col("loaded_at").alias("at"), F.col("loaded_at").between("1990-01-01", "2010-12-31 23:59:59").alias("eligible"))
    whole = cut(C.group_table(groups, at.withColumn("eligible", F.coalesce("eligible", F.lit(False)))))
    return groups, whole, cut(C.temporal_split(whole))


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = T.addresses(F.array(F.col("from")), F.col("to"), F.col("cc"), F.col("bcc"))
    return _mail(spark, sf_dir).select(F.col("row_id").alias("node"), F.explode(people).alias("identity"))


def source_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rejection_ledger(_mail(spark, sf_dir))


def distinct_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per content with its smallest row_id and its occurrences."""
    return C.distinct_records(_mail(spark, sf_dir)).select("row_id", "occurrences")


def dup_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of groups of equal bodies."""
    sizes = _mail(spark, sf_dir).where("body is not null").groupBy(F.sha2("body", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return C.duplicate_histogram(sizes, "n")


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star edges of equal bodies: each row with the smallest row of its text."""
    body = _mail(spark, sf_dir).where("body is not null and body <> ''").select(F.col("row_id").alias("node"), F.lit("exact").alias("family"), F.sha2("body", 256).alias("feature"))
    return C.star_edges(body).select("a", "b")


def document_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text: class (smallest doc_id) and size."""
    docs = table(spark, sf_dir, "documents").where("text is not null and trim(text) <> ''")
    low = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("size"))
    return docs.select("doc_id", F.sha2("text", 256).alias("h")).join(low.where("size > 1"), "h").select("doc_id", "class", "size")


def feature_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have each field."""
    fields = ["message_id", "subject", "from", "date", "body", "file_name", "mailbox"]
    mail = _mail(spark, sf_dir)
    return mail.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(F.trim(F.col(f"`{f}`")), F.lit("")) != "").alias(f"has_{f}") for f in fields], F.count_if(F.size(F.coalesce("to", F.array())) > 0).alias("has_to"))


def corpus_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-independent digest of the mail's contents."""
    rows = C.distinct_records(_mail(spark, sf_dir))
    return C.multiset_hash(rows, F.col("content"), F.col("occurrences"))


def message_refs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct own and referenced message ids with the number of rows that have them."""
    mail = _mail(spark, sf_dir)
    own = mail.select("row_id", T.message_id(F.col("message_id")).alias("id")).where("id is not null")
    refs = mail.select("row_id", F.explode(T.message_id_references(F.coalesce("body", F.lit("")))).alias("id"))
    return own.union(refs).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("rows"))


def thread_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with their rows and distinct participants."""
    mail = _mail(spark, sf_dir).select("row_id", F.nullif(T.thread(F.col("subject")), F.lit("")).alias("thread"), T.addresses(F.array(F.col("from")), F.col("to"), F.col("cc"), F.col("bcc")).alias("people")).where("thread is not null")
    return mail.select("row_id", "thread", F.explode_outer("people").alias("p")).groupBy("thread").agg(F.countDistinct("row_id").alias("rows"), F.countDistinct("p").alias("participants"))


def near_dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by classes of near-equal signatures, with their number of near signatures."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return C.near_classes(cut(C.near_features(docs, "doc_id", "text"))).withColumnRenamed("node", "doc_id")


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct signatures at most three bits apart."""
    nodes = C.near_features(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")
    return C.near_pairs(nodes.where("tokens >= 12 and shingles >= 8"))


def near_dup_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = C.near_features(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")
    return C.candidate_budget(nodes.where("tokens >= 12 and shingles >= 8"))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by classes of texts that share four fifths of their five-word shingles, with their number of similar texts."""
    return C.similar_texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("node", "doc_id")


def similar_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of mail bodies."""
    return C.similar_texts(_mail(spark, sf_dir), "row_id", "body").withColumnRenamed("node", "row_id")


def leakage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the smallest row of its leakage group."""
    return _groups(spark, sf_dir).withColumnsRenamed({"node": "row_id", "group": "group_row"})


def leakage_edge_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = cut(_features(spark, sf_dir))
    groups = C.leakage_groups(feats, _mail(spark, sf_dir).select(F.col("row_id").alias("node")))
    return C.edge_families(C.star_edges(feats), groups).withColumnRenamed("group", "group_row")


def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups by time: role of every group."""
    return _roles(spark, sf_dir)[2].withColumnRenamed("group", "group_row")


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to roles by a seeded hash of the customer, so that a customer's orders stay together."""
    orders = table(spark, sf_dir, "orders")
    return C.hash_split(orders.select(F.col("o_custkey").alias("group")).distinct()).withColumnRenamed("group", "o_custkey")


def order_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by their latest order: the cut closest to 80 and 90 per cent of the orders."""
    whole = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group")).agg(F.count(F.lit(1)).alias("records"), F.max("o_orderdate").alias("anchor"))
    return C.temporal_split(whole).withColumnRenamed("group", "o_custkey")


def allocation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, whole, roles = _roles(spark, sf_dir)
    return C.allocation(roles, whole)


def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that two roles hold: none under the temporal split, and those that a split of single rows by hash would tear."""
    groups, _, roles = _roles(spark, sf_dir)
    rows = C.hash_split(groups.select(F.col("node").alias("group"))).withColumnRenamed("group", "node")
    temporal = C.leaks(groups.join(roles, "group")).select(F.lit("temporal").alias("split"), "group", "roles")
    return temporal.union(C.leaks(groups.join(rows, "node")).select(F.lit("rows").alias("split"), "group", "roles"))


def identity_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every row: whether training knows its people."""
    groups, _, roles = _roles(spark, sf_dir)
    nodes = _mail(spark, sf_dir).select(F.col("row_id").alias("node"))
    return C.recurrence(C.identity_support(_identities(spark, sf_dir), groups.join(roles, "group")), nodes).withColumnRenamed("node", "row_id")


def cohort_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role, cohort, rows over recurrence, frequency, folder, size and group size."""
    groups, whole, roles = _roles(spark, sf_dir)
    mail = _mail(spark, sf_dir)
    assigned = groups.join(roles, "group")
    kinds = C.recurrence(C.identity_support(_identities(spark, sf_dir), assigned), mail.select(F.col("row_id").alias("node")))
    rows = mail.select(F.col("row_id").alias("node"), F.coalesce(T.mailbox_folder(F.col("file_name")), F.lit("unavailable")).alias("folder"), T.size_bucket(F.octet_length(F.coalesce("body", F.lit("")))).alias("size"))
    rows = rows.join(assigned, "node").join(kinds, "node").join(whole.select("group", T.group_size_bucket(F.col("records")).alias("group_size")), "group")
    tags = F.array_union(F.array(F.concat(F.lit("identity:"), "recurrence"), F.concat(F.lit("folder:"), "folder"), F.concat(F.lit("size:"), "size"), F.concat(F.lit("group_size:"), "group_size")), F.transform(F.filter(F.split("frequencies", ","), lambda x: x != ""), lambda x: F.concat(F.lit("frequency:"), x)))
    return rows.select("role", F.explode(tags).alias("cohort")).groupBy("role", "cohort").agg(F.count(F.lit(1)).alias("rows"))


def customer_frequency_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of late orders by how many early months know them."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").alias("m"), (F.col("o_orderdate") < "1997-01-01").alias("train"))
    known = orders.where("train").groupBy("o_custkey").agg(F.countDistinct("m").alias("n"))
    late = orders.where("not train").select("o_custkey").distinct().join(known, "o_custkey", "left")
    return late.groupBy(C.frequency(F.coalesce("n", F.lit(0))).alias("cohort")).agg(F.count(F.lit(1)).alias("customers"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents by language and size, with largest remainders."""
    docs = table(spark, sf_dir, "documents")
    stratum = F.concat_ws("/", F.coalesce("lang", F.lit("?")), T.size_bucket(F.coalesce(F.octet_length("text"), F.lit(0))))
    return C.stratified_sample(docs, "doc_id", stratum, 100, base=1)


def hamilton_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of 500 customers over market segments, two each first."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count(F.lit(1)).alias("population"))
    return C.quotas(people, 100, 2)


def group_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer of lowest hash of each nation."""
    rows = table(spark, sf_dir, "customer")
    return C.representatives(rows, "c_nationkey", "c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256)).drop("rank")


def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(T.size_bucket(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bucket")).agg(F.count(F.lit(1)).alias("documents"))


def mailbox_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mail(spark, sf_dir).groupBy(T.mailbox_folder(F.col("file_name")).alias("folder")).agg(F.count(F.lit(1)).alias("rows"))


def natural_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects and bodies in one layout: characters before and after."""
    return _mail(spark, sf_dir).where("body is not null").select("row_id", F.length("body").alias("before"), F.length(T.natural(F.col("body"))).alias("after"), T.one_line(F.coalesce("subject", F.lit(""))).alias("subject"))


def body_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible, current and core view of every body: their lengths."""
    u = T.udfs()
    rows = _mail(spark, sf_dir).where("body is not null").select("row_id", u["visible_body"](F.col("body")).alias("v"))
    rows = rows.select("row_id", "v", T.current_body(F.col("v")).alias("c"))
    return rows.select("row_id", F.length("v").alias("visible"), F.length("c").alias("current"), F.length(T.core_body(F.col("c"))).alias("core"))


def body_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current and core part of every body in natural layout, by digest and length."""
    rows = _mail(spark, sf_dir).where("body is not null").select("row_id", T.current_body(T.natural(F.col("body"))).alias("c"))
    rows = rows.select("row_id", "c", T.core_body(F.col("c")).alias("core"))
    return rows.select("row_id", F.sha2("c", 256).alias("current"), F.sha2("core", 256).alias("core"), F.length("core").alias("chars"))


def thread_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded and grouped subjects with their rows."""
    u = T.udfs()
    rows = _mail(spark, sf_dir).where("subject is not null").select(u["thread_subject"](u["header_text"](F.col("subject"))).alias("thread"))
    return rows.groupBy("thread").agg(F.count(F.lit(1)).alias("rows"))


def prepared_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every date: missing, unparsed, out of range or eligible."""
    mail = _mail(spark, sf_dir)
    at = to_utc(mail.where("date is not null").withColumn("zone", F.lit("UTC")), "row_id", "date", "zone")
    status = F.when(F.col("date").isNull() | (F.trim("date") == ""), "missing").when(F.col("utc_us").isNull(), "unparsed").when(F.timestamp_micros("utc_us").between("1990-01-01", "2010-12-31 23:59:59.999999"), "eligible").otherwise("out_of_range")
    return mail.select("row_id", "date").join(at, "row_id", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("rows"))


_ALL = (source_rejections, distinct_records, dup_histogram, exact_dup_groups, document_dup_groups, feature_availability, corpus_multiset_hash, message_refs_union, thread_participants, near_dup_classes, near_dup_pairs, near_dup_budget, similar_documents, similar_bodies, leakage_components, leakage_edge_families, temporal_split, hash_split, order_time_split, allocation_audit, leakage_audit, identity_recurrence, cohort_counters, customer_frequency_cohorts, stratified_sample, hamilton_quotas, group_representative, size_buckets, mailbox_folders, natural_layout, body_views, body_segments, thread_subjects, prepared_dates)
QUERIES = {f.__name__: f for f in _ALL}

SIZE = "CASE WHEN b <= 0 THEN '0' WHEN b <= 255 THEN '1-255' WHEN b <= 1023 THEN '256-1023' WHEN b <= 4095 THEN '1024-4095' WHEN b <= 16383 THEN '4096-16383' WHEN b <= 65535 THEN '16384-65535' WHEN b <= 262143 THEN '65536-262143' WHEN b <= 1048575 THEN '262144-1048575' ELSE '1048576+' END"
GROUP_SIZE = "CASE WHEN n <= 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 4 THEN '3-4' WHEN n <= 9 THEN '5-9' WHEN n <= 99 THEN '10-99' ELSE '100+' END"
ADDRESSES = r"""regexp_extract_all(lower(v), '[\p{L}\p{N}._%+''-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*')"""
PEOPLE = f"""people AS (SELECT DISTINCT row_id, unnest({ADDRESSES}) AS p FROM (SELECT row_id, unnest(list_concat(["from"], coalesce("to", []), coalesce(cc, []), coalesce(bcc, []))) AS v FROM enron_preparation) WHERE v IS NOT NULL)"""
THREAD = r"""trim(regexp_replace(lower(regexp_replace(subject, '^(\s*(re|fw|fwd)\s*(\[\d+\])?\s*:\s*)+', '', 'i')), '\s+', ' ', 'g'))"""
MESSAGE = r"""lower(regexp_replace(message_id, '[\s<>()\[\]]+', '', 'g'))"""
SPLIT = """cum AS (SELECT g, records, sum(records) OVER (ORDER BY anchor, g ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (ORDER BY anchor, g) AS i, count(*) OVER () AS k, sum(records) OVER () AS t FROM whole),
      a AS (SELECT min_by(c, (abs(c - t * 0.8), i)) AS c FROM cum WHERE i <= k - 2),
      b AS (SELECT min_by(cum.c, (abs(cum.c - t * 0.9), i)) AS c FROM cum, a WHERE cum.c > a.c AND i <= k - 1)"""
ORACLE = {
    "source_rejections": r"""SELECT reason, count(*) AS rows, bool_or(body IS NOT NULL) AS had_text FROM (SELECT *, CASE WHEN body IS NULL AND subject IS NULL THEN 'empty_record' WHEN body IS NULL THEN 'missing_body' WHEN regexp_full_match(body, '\s*') THEN 'blank_body'
        WHEN message_id IS NULL OR regexp_full_match(message_id, '[\s<>]*') THEN 'missing_message_id' WHEN "from" IS NULL OR regexp_full_match("from", '\s*') THEN 'missing_sender' END AS reason FROM enron_preparation) WHERE reason IS NOT NULL GROUP BY 1""",
    "distinct_records": """SELECT min(row_id) AS row_id, count(*) AS occurrences FROM enron_preparation GROUP BY message_id, subject, "from", "to", cc, bcc, date, body""",
    "dup_histogram": f"SELECT {GROUP_SIZE} AS bucket, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS redundant FROM (SELECT count(*) AS n FROM enron_preparation WHERE body IS NOT NULL GROUP BY body) GROUP BY 1",
    "exact_dup_groups": "SELECT row_id AS a, low AS b FROM (SELECT row_id, min(row_id) OVER (PARTITION BY body) AS low FROM enron_preparation WHERE body IS NOT NULL AND body <> '') WHERE row_id <> low",
    "document_dup_groups": "SELECT * FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class, count(*) OVER (PARTITION BY text) AS size FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> '') WHERE size > 1",
    "feature_availability": "SELECT count(*) AS rows, " + ", ".join(f"count(*) FILTER (coalesce(trim(\"{f}\", ' '), '') <> '') AS has_{f}" for f in ("message_id", "subject", "from", "date", "body", "file_name", "mailbox")) + ', count(*) FILTER (len("to") > 0) AS has_to FROM enron_preparation',
    "message_refs_union": f"SELECT id, count(*) AS rows FROM (SELECT DISTINCT row_id, {MESSAGE} AS id FROM enron_preparation) WHERE id <> '' GROUP BY 1",
    "thread_participants": f"WITH {PEOPLE}, t AS (SELECT row_id, {THREAD} AS thread FROM enron_preparation) SELECT thread, count(DISTINCT t.row_id) AS rows, count(DISTINCT p) AS participants FROM t LEFT JOIN people USING (row_id) WHERE thread <> '' GROUP BY 1",
    "order_time_split": f"WITH whole AS (SELECT o_custkey AS g, count(*) AS records, max(o_orderdate) AS anchor FROM orders GROUP BY 1), {SPLIT} SELECT g AS o_custkey, CASE WHEN cum.c <= a.c THEN 'train' WHEN cum.c <= b.c THEN 'validation' ELSE 'test' END AS role FROM cum, a, b",
    "hash_split": r"""SELECT g AS o_custkey, CASE WHEN f < 0.8 THEN 'train' WHEN f < 0.9 THEN 'validation' ELSE 'test' END AS role FROM (SELECT DISTINCT o_custkey AS g, CAST(('0x' || substr(sha256('split' || chr(1) || o_custkey), 1, 13)) AS BIGINT) / 4503599627370496.0 AS f FROM orders)""",
    "customer_frequency_cohorts": "WITH o AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, o_orderdate < TIMESTAMP '1997-01-01' AS train FROM orders), k AS (SELECT o_custkey, count(DISTINCT m) AS n FROM o WHERE train GROUP BY 1), l AS (SELECT DISTINCT o_custkey FROM o WHERE NOT train) SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'novel' WHEN n = 1 THEN 'tail' WHEN n < 10 THEN 'mid' ELSE 'head' END AS cohort, count(*) AS customers FROM l LEFT JOIN k USING (o_custkey) GROUP BY 1",
    "hamilton_quotas": """WITH p AS (SELECT c_mktsegment AS stratum, count(*) AS population FROM customer GROUP BY 1), s AS (SELECT *, least(2, population) AS b FROM p), w AS (SELECT least(100, sum(population)) - sum(b) AS rest, sum(population) - sum(b) AS room FROM s),
        q AS (SELECT *, CAST(floor(rest * (population - b) / room) AS BIGINT) AS f, CAST(rest * (population - b) AS BIGINT) % CAST(room AS BIGINT) AS r FROM s, w), z AS (SELECT *, rest - sum(f) OVER () AS residual, row_number() OVER (ORDER BY r DESC, stratum) AS rk FROM q)
        SELECT stratum, population, CAST(b + f + CASE WHEN rk <= residual THEN 1 ELSE 0 END AS BIGINT) AS quota FROM z""",
    "stratified_sample": f"""WITH d AS (SELECT doc_id, concat_ws('/', coalesce(lang, '?'), {SIZE}) AS stratum, sha256('sample' || chr(1) || doc_id) AS rank FROM (SELECT doc_id, lang, coalesce(strlen(text), 0) AS b FROM documents)),
        p AS (SELECT stratum, count(*) AS population FROM d GROUP BY 1), s AS (SELECT *, least(1, population) AS b FROM p), w AS (SELECT least(100, sum(population)) - sum(b) AS rest, sum(population) - sum(b) AS room FROM s),
        q AS (SELECT *, CAST(floor(rest * (population - b) / room) AS BIGINT) AS f, CAST(rest * (population - b) AS BIGINT) % CAST(room AS BIGINT) AS r FROM s, w), z AS (SELECT *, rest - sum(f) OVER () AS residual, row_number() OVER (ORDER BY r DESC, stratum) AS rk FROM q),
        y AS (SELECT stratum, b + f + CASE WHEN rk <= residual THEN 1 ELSE 0 END AS quota FROM z)
        SELECT doc_id, stratum FROM (SELECT d.*, quota, row_number() OVER (PARTITION BY stratum ORDER BY rank, doc_id) AS n FROM d JOIN y USING (stratum)) WHERE n <= quota""",
    "group_representative": "SELECT c_nationkey, min_by(c_custkey, (sha256(CAST(c_custkey AS VARCHAR)), c_custkey)) AS c_custkey FROM customer GROUP BY 1",
    "size_buckets": f"SELECT {SIZE} AS bucket, count(*) AS documents FROM (SELECT coalesce(strlen(text), 0) AS b FROM documents) GROUP BY 1",
    "mailbox_folders": r"""WITH f AS (SELECT lower(string_split(replace(file_name, '\', '/'), '/')[-2]) AS f FROM enron_preparation) SELECT CASE WHEN regexp_matches(f, '^inbox|_inbox$') THEN 'inbox' WHEN f LIKE '%sent%' THEN 'sent' WHEN regexp_matches(f, 'deleted|trash') THEN 'deleted' WHEN regexp_matches(f, 'all_documents|archive|old_mail|^[0-9]{4}$') THEN 'archive' WHEN f IS NOT NULL THEN 'other' END AS folder, count(*) AS rows FROM f GROUP BY 1""",
}

# the layout, the leakage groups by reachability, and the temporal split, for the queries built on them
NATURAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\r\n|[\r\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'),
  '[\x{{ad}}\x{{34f}}\x{{61c}}\x{{115f}}\x{{1160}}\x{{17b4}}\x{{17b5}}\x{{180b}}-\x{{180f}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{206f}}\x{{3164}}\x{{fe00}}-\x{{fe0f}}\x{{feff}}\x{{ffa0}}\x{{fff0}}-\x{{fff8}}]', '', 'g'),
  '[\t\x{{b}}\x{{c}} \x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"""
def similar_sql(table: str, key: str, text: str) -> str:
    """Common table expressions ending in `sim` (k, class, links): similar texts by counting shared shingles of all pairs."""
    return rf"""sw AS (SELECT {key} AS k, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE {text} IS NOT NULL),
  sg AS (SELECT k, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS g FROM sw WHERE len(w) > 0),
  ss AS (SELECT min(k) AS s, g, len(g) AS n FROM sg GROUP BY g), sx AS (SELECT s, n, unnest(g) AS x FROM ss),
  sp AS (SELECT a.s AS a, b.s AS b FROM sx a JOIN sx b ON a.x = b.x AND a.s <> b.s GROUP BY a.s, b.s, a.n, b.n HAVING count(*) * 10 >= (a.n + b.n - count(*)) * 8),
  sr AS (SELECT s AS x, s AS y FROM ss UNION SELECT r.x, p.b FROM sr r JOIN sp p ON r.y = p.a), sc AS (SELECT x AS s, min(y) AS class FROM sr GROUP BY 1),
  sl AS (SELECT a AS s, count(*) AS links FROM sp GROUP BY 1),
  sim AS (SELECT sg.k, sc.class, coalesce(links, 0) AS links FROM sg JOIN ss USING (g) JOIN sc USING (s) LEFT JOIN sl USING (s))"""


LEAKAGE = f"""{PEOPLE}, {similar_sql("enron_preparation", "row_id", "body")}, feats AS (
    SELECT row_id, 'exact_plaintext' AS family, t AS f FROM (SELECT row_id, {NATURAL.format(c='body')} AS t FROM enron_preparation) WHERE t <> ''
    UNION SELECT row_id, unnest(['same_message_id', 'message_id_reference']), m FROM (SELECT row_id, {MESSAGE} AS m FROM enron_preparation) WHERE m <> ''
    UNION SELECT k, 'near_duplicate', CAST(class AS VARCHAR) FROM sim WHERE links > 0
    UNION SELECT row_id, 'thread_shared_participant', t || chr(1) || p FROM (SELECT row_id, {THREAD} AS t FROM enron_preparation) JOIN people USING (row_id) WHERE t <> ''),
  linked AS (SELECT DISTINCT a.row_id AS x, b.row_id AS y FROM feats a JOIN feats b USING (family, f)),
  reach AS (SELECT row_id AS x, row_id AS y FROM enron_preparation UNION SELECT r.x, e.y FROM reach r JOIN linked e ON r.y = e.x),
  lg AS (SELECT x AS row_id, min(y) AS g FROM reach GROUP BY 1)"""
DATED = "dated AS (SELECT row_id, loaded_at AS at_, coalesce(loaded_at BETWEEN TIMESTAMP '1990-01-01' AND TIMESTAMP '2010-12-31 23:59:59', false) AS ok FROM enron_preparation), whole AS (SELECT g, count(*) AS records, max(CASE WHEN ok THEN at_ END) AS anchor FROM lg JOIN dated USING (row_id) GROUP BY 1)"
ROLED = f"{LEAKAGE}, {DATED}, {SPLIT}, roles AS (SELECT g, CASE WHEN cum.c <= a.c THEN 'train' WHEN cum.c <= b.c THEN 'validation' ELSE 'test' END AS role FROM cum, a, b)"
RECURRING = f"""{ROLED}, known AS (SELECT p, count(DISTINCT g) AS n FROM people JOIN lg USING (row_id) JOIN roles USING (g) WHERE role = 'train' GROUP BY 1),
  per AS (SELECT row_id, count(*) AS identities, count(*) FILTER (coalesce(n, 0) > 0) AS k, array_to_string(list_sort(list(DISTINCT CASE WHEN coalesce(n, 0) = 0 THEN 'novel' WHEN n = 1 THEN 'tail' WHEN n < 10 THEN 'mid' ELSE 'head' END)), ',') AS frequencies FROM people LEFT JOIN known USING (p) GROUP BY 1),
  rec AS (SELECT row_id, CASE WHEN identities IS NULL THEN 'unavailable' WHEN k = identities THEN 'all_known' WHEN k = 0 THEN 'all_novel' ELSE 'mixed' END AS recurrence, coalesce(identities, 0) AS identities, coalesce(frequencies, '') AS frequencies FROM enron_preparation LEFT JOIN per USING (row_id))"""
FOLDER = r"""CASE WHEN regexp_matches(f, '^inbox|_inbox$') THEN 'inbox' WHEN f LIKE '%sent%' THEN 'sent' WHEN regexp_matches(f, 'deleted|trash') THEN 'deleted' WHEN regexp_matches(f, 'all_documents|archive|old_mail|^[0-9]{4}$') THEN 'archive' WHEN f IS NOT NULL THEN 'other' ELSE 'unavailable' END"""
FIELD = r"(?:from|sent|date|to|cc|subject):[ \t]*\S[^\n]*(?:\n[ \t][^\n]*)*"
SEGMENTS = rf"""nb AS (SELECT row_id, {NATURAL.format(c='body')} AS b FROM enron_preparation WHERE body IS NOT NULL), nl AS (SELECT row_id, b, string_split(b, chr(10)) AS l FROM nb),
  nh AS (SELECT *, list_transform(range(1, len(l) + 1), lambda i: regexp_extract(array_to_string(l[i + 1:i + 10], chr(10)), '(?i)^{FIELD}(?:\n{FIELD})*')) AS h FROM nl),
  np AS (SELECT *, coalesce(list_min(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '(?i)^\s*(?:-{{2,}}\s*original message\s*-{{2,}}|(?:-{{2,}}\s*)?(?:begin\s+)?forwarded message(?::|\s*-{{2,}})?)\s*$')
    OR (regexp_matches(l[i], '^\s*(?:_{{8,}}|-{{8,}})\s*$') AND regexp_matches(h[i], '(?im)^from:') AND regexp_matches(h[i], '(?im)^(?:sent|date):') AND regexp_matches(h[i], '(?im)^(?:to|subject):')))), len(l) + 1) AS stop FROM nh),
  nk AS (SELECT row_id, b, l, list_filter(l[1:stop - 1], lambda x: NOT regexp_matches(x, '^\s*>') AND NOT regexp_matches(x, '(?i)^\s*on\s+.{{1,240}}\s+wrote:\s*$')) AS kept FROM np),
  nj AS (SELECT row_id, b, len(kept) = len(l) AS same, array_to_string(kept, chr(10)) AS j FROM nk), nc AS (SELECT row_id, CASE WHEN same THEN b ELSE {NATURAL.format(c='j')} END AS c FROM nj), nm AS (SELECT row_id, c, string_split(c, chr(10)) AS l FROM nc),
  ns AS (SELECT row_id, c, l, list_min(list_filter(range(1, len(l) + 1), lambda i: (i >= greatest(2, len(l) - 15) AND l[i] = '--' AND len(list_filter(l[i + 1:], lambda x: x <> '')) > 0)
    OR (i >= len(l) - 29 AND (regexp_matches(l[i], '(?i)^(?:sent from my (?:iphone|ipad|android|mobile device)|get outlook for (?:ios|android)|sent from mail for windows)\.?$') OR regexp_matches(l[i], '(?i)^(?:confidentiality notice:|this (?:e-?mail|message)(?: and any attachments)? (?:is|may be) confidential)'))))) AS at_ FROM nm),
  nt AS (SELECT row_id, c, at_, array_to_string(l[1:at_ - 1], chr(10)) AS j FROM ns), nx AS (SELECT row_id, c, CASE WHEN at_ IS NULL THEN c ELSE {NATURAL.format(c='j')} END AS core FROM nt)"""
ORACLE["body_segments"] = f"WITH {SEGMENTS} SELECT row_id, sha256(c) AS current, sha256(core) AS core, CAST(length(core) AS INTEGER) AS chars FROM nx"
ORACLE |= {
    "similar_documents": f"WITH RECURSIVE {similar_sql('documents', 'doc_id', 'text')} SELECT k AS doc_id, class, links FROM sim",
    "similar_bodies": f"WITH RECURSIVE {similar_sql('enron_preparation', 'row_id', 'body')} SELECT k AS row_id, class, links FROM sim",
    "leakage_components": f"WITH RECURSIVE {LEAKAGE} SELECT row_id, g AS group_row FROM lg",
    "leakage_edge_families": f"WITH RECURSIVE {LEAKAGE}, low AS (SELECT family, f, min(row_id) AS b, count(*) AS n FROM feats GROUP BY 1, 2 HAVING count(*) > 1), ends AS (SELECT row_id, family FROM feats JOIN low USING (family, f)) SELECT g AS group_row, array_to_string(list_sort(list(DISTINCT family)), ',') AS families FROM ends JOIN lg USING (row_id) GROUP BY 1",
    "leakage_audit": f"""WITH RECURSIVE {LEAKAGE}, f AS (SELECT g, CAST(('0x' || substr(sha256('split' || chr(1) || row_id), 1, 13)) AS BIGINT) / 4503599627370496.0 AS f FROM lg)
        SELECT 'rows' AS split, g AS "group", count(DISTINCT CASE WHEN f < 0.8 THEN 'train' WHEN f < 0.9 THEN 'validation' ELSE 'test' END) AS roles FROM f GROUP BY g HAVING count(DISTINCT CASE WHEN f < 0.8 THEN 'train' WHEN f < 0.9 THEN 'validation' ELSE 'test' END) > 1""",
    "temporal_split": f"WITH RECURSIVE {ROLED} SELECT g AS group_row, role FROM roles",
    "allocation_audit": f"WITH RECURSIVE {ROLED} SELECT role, count(*) AS groups, CAST(sum(records) AS BIGINT) AS records, round((SELECT sum(records) FROM whole) * CASE role WHEN 'train' THEN 0.8 WHEN 'validation' THEN 0.1 ELSE 1 - 0.8 - 0.1 END, 6)::DOUBLE AS target FROM roles JOIN whole USING (g) GROUP BY 1",
    "identity_recurrence": f"WITH RECURSIVE {RECURRING} SELECT row_id, recurrence, identities, frequencies FROM rec",
    "cohort_counters": f"""WITH RECURSIVE {RECURRING}, tags AS (SELECT role, unnest(list_concat(['identity:' || recurrence, 'folder:' || {FOLDER}, 'size:' || {SIZE}, 'group_size:' || {GROUP_SIZE}], list_transform(list_filter(string_split(frequencies, ','), lambda x: x <> ''), lambda x: 'frequency:' || x))) AS cohort
        FROM (SELECT e.row_id, lower(string_split(replace(file_name, '\\', '/'), '/')[-2]) AS f, strlen(coalesce(body, '')) AS b FROM enron_preparation e) JOIN rec USING (row_id) JOIN lg USING (row_id) JOIN roles USING (g) JOIN (SELECT g, records AS n FROM whole) USING (g)) SELECT role, cohort, count(*) AS rows FROM tags GROUP BY 1, 2""",
    "natural_layout": f"""SELECT row_id, length(body) AS before, length({NATURAL.format(c='body')}) AS after, trim(regexp_replace({NATURAL.format(c="coalesce(subject, '')")}, '\\s+', ' ', 'g'), ' ') AS subject FROM enron_preparation WHERE body IS NOT NULL""",
}
