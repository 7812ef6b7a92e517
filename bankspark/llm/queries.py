"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark.llm import bpe, leakage, mojibake, names, pieces, pii, replies, splits
from bankspark.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of spellings of one correspondent in `from` and `to`."""
    return names.pairs(table(spark, sf_dir, "enron_preparation").select("from", "to"), "from", "to")


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the smallest spelling of its correspondent."""
    return names.link(table(spark, sf_dir, "enron_preparation").select("from", "to"), "from", "to")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject or body with characters that a wrong decoding left."""
    return p3_repaired(spark, sf_dir).select("row_id", "field")


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields with their restored text."""
    mail = table(spark, sf_dir, "enron_preparation").select("row_id", "mailbox", "subject", "body")
    return mojibake.find_and_repair(mail, "row_id", "mailbox", ["subject", "body"])


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = table(spark, sf_dir, "enron_preparation").select("row_id", "from", "subject", "message_id")
    links = {"sender": splits.address_key(F.col("from")), "thread": splits.thread_key(F.col("subject")), "message": splits.message_key(F.col("message_id"))}
    return splits.components(mail, "row_id", links)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the smallest row_id of its group."""
    return _groups(spark, sf_dir).withColumnRenamed("group", "group_row")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its group and split, near 80 : 10 : 10 of the rows."""
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    return splits.assign(_groups(spark, sf_dir), "row_id", shares).withColumnRenamed("group", "group_row")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each personal value of a subject or body, once per field and kind."""
    return pii.find(table(spark, sf_dir, "enron_preparation"), "row_id", ["subject", "body"])


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject and body with typed placeholders."""
    return pii.redact(table(spark, sf_dir, "enron_preparation"), "row_id", ["subject", "body"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a body that its sender newly wrote."""
    mail = table(spark, sf_dir, "enron_preparation").select("row_id", "body", "from", "message_id", "loaded_at")
    sender = F.coalesce(splits.address_key(F.col("from")), F.lower(F.trim("from")))
    message = F.coalesce(splits.message_key(F.col("message_id")), F.lit(""))
    return replies.new_lines(mail, "row_id", "body", sender, message, F.col("loaded_at"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds an evaluation record, whole or a running stretch, with that record."""
    docs, records = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_records")
    return leakage.find_leaks(docs, "doc_id", "text", records, "eval_id", "text").select("doc_id", "eval_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the stretches that hold evaluation records."""
    docs, records = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_records")
    return leakage.clean(docs, "doc_id", "text", records, "eval_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has to be cut."""
    return p10_pieces(spark, sf_dir).where("piece_no = 1 and n_pieces > 1").select("doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of at most 512 tokens with up to 64 tokens of overlap."""
    return pieces.split_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
}
ORACLE: dict[str, str] = {
    # components by plain reachability over rows and keys
    "p5_found": r"""WITH RECURSIVE keys AS (
        SELECT row_id, 'a' || k AS k FROM (SELECT row_id, regexp_extract(lower("from"), '([\p{L}\p{N}._%+''&=/~-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*)', 1) AS k FROM enron_preparation) WHERE k <> ''
        UNION ALL SELECT row_id, 's' || k FROM (SELECT row_id, lower(regexp_replace(regexp_replace(subject, '^(\s*(re|fwd|fw)\s*(\[\s*\d+\s*\])?\s*:)+', '', 'i'), '[\s\x{00a0}]+', '', 'g')) AS k FROM enron_preparation) WHERE k <> ''
        UNION ALL SELECT row_id, 'm' || k FROM (SELECT row_id, lower(regexp_replace(message_id, '[\s<>()\[\]]+', '', 'g')) AS k FROM enron_preparation) WHERE k <> ''),
      edges AS (SELECT DISTINCT a.row_id AS x, b.row_id AS y FROM keys a JOIN keys b USING (k)),
      reach AS (SELECT row_id AS x, row_id AS y FROM enron_preparation UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
      SELECT x AS row_id, min(y) AS group_row FROM reach GROUP BY 1""",
}
