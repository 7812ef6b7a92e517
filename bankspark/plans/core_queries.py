"""Queries of the core operators for training-data problems 2 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark.operators.split_values import split_values
from bankspark.operators.timestamps import to_utc
from bankspark.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of every recipient of an element of `to` or `cc` that holds two or more."""
    rows = split_values(table(spark, sf_dir, "enron_preparation"), "row_id", ["to", "cc"])
    return rows.where("n_values > 1").select("row_id", "field", "item_pos", "value_pos")


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recipient of `to` and `cc` on its own row."""
    return split_values(table(spark, sf_dir, "enron_preparation"), "row_id", ["to", "cc"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every date that denotes exactly one, on the clock of the row's mailbox where it names no zone."""
    mail = table(spark, sf_dir, "enron_preparation").where("date is not null").select("row_id", "date", "mailbox")
    # one zone a mailbox: rows of mailboxes that disagree leave it unknown
    zones = table(spark, sf_dir, "mailboxes").groupBy("mailbox").agg(F.min("home_zone").alias("lo"), F.max("home_zone").alias("hi"))
    zones = zones.select("mailbox", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("home_zone"))
    return to_utc(mail.join(zones, "mailbox", "left"), "row_id", "date", "home_zone").where("utc_us is not null")


QUERIES = {"p2_found": p2_found, "p2_values": p2_values, "p4_found": p4_found}

# elements taken apart step by step: quotes, then brackets, then delimiters, then pieces that belong together
_QUOTED = r"""regexp_replace(regexp_replace({c}, '(^|[,;|\n]\s*)''([^''\n]*)''(\s*(?:[<,;|\[(\n]|$))', '\1"\2"\3', 'g'), '(^|[,;|\n]\s*)''([^''\n]*)''(\s*(?:[<,;|\[(\n]|$))', '\1"\2"\3', 'g')"""
_OUTSIDE = r"""array_to_string(list_transform(regexp_extract_all({c}, '[^()\[\]]*[()\[\]]|[^()\[\]]+'), lambda y: CASE WHEN regexp_matches(y, '[)\]]$') THEN y ELSE regexp_replace({do}, '{what}', {by}, 'g') END), '')"""
_JOINS = r"""(regexp_matches(acc[-1], '^(?:[dD]e |[vV]an |[vV]on |[lL]a )?\p{Lu}(?:\p{Ll}|[''’-])*(?:[-''’]\p{Lu}\p{Ll}+)?$|^\p{Lu}{2,}$') AND regexp_matches(x[1], '^\p{L}[\p{L}''’.-]*(?: \p{L}[\p{L}''’.-]*)?\s*(?:<[^>]*>|\[[^\]]*\]|\([^)]*@[^)]*\))?$'))
  OR regexp_matches(x[1], '(?i)^(?:inc|llc|llp|ltd|limited|corp|co|plc|gmbh|ag|s\.?a|jr|sr|ii|iii|ph\.?d|m\.?d|esq)\.?\s*(?:<[^>]*>|\[[^\]]*\])?$')"""
_VALUES = rf"""WITH e AS (SELECT row_id, field, unnest(range(1, len(items) + 1)) AS item_pos, unnest(items) AS e FROM (SELECT row_id, 'to' AS field, "to" AS items FROM enron_preparation UNION ALL SELECT row_id, 'cc', cc FROM enron_preparation) WHERE items IS NOT NULL),
  t AS (SELECT row_id, field, item_pos, regexp_replace(e, '^\s+|\s+$', '', 'g') AS t FROM e WHERE e IS NOT NULL),
  q AS (SELECT *, string_split({_QUOTED.format(c="CASE WHEN regexp_matches(t, '^\\s*\"[^\"]*@[^\"]*[,;|\\n][^\"]*@[^\"]*\"\\s*$') THEN replace(t, '\"', '') ELSE t END")}, '"') AS p FROM t),
  m AS (SELECT row_id, field, item_pos, t, array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i % 2 = 0 AND (len(p) % 2 = 1 OR i < len(p)) THEN chr(3) || p[i] || chr(3)
    ELSE {_OUTSIDE.format(c=_OUTSIDE.format(c="p[i]", do="y", what=r"\s*,\s*", by="chr(1)"), do="y", what=r"[;|\r\n]+", by="chr(2)")} END), '') AS m FROM q),
  s AS (SELECT row_id, field, item_pos, t, list_transform(string_split(m, chr(2)), lambda g: list_transform(string_split(g, chr(1)), lambda x: [trim(x, ' ')])) AS g FROM m),
  f AS (SELECT row_id, field, item_pos, t, flatten(list_transform(g, lambda l: list_reduce(list_concat([CAST([] AS VARCHAR[])], l), lambda acc, x: CASE WHEN x[1] = '' THEN acc WHEN len(acc) > 0 AND ({_JOINS}) THEN list_concat(acc[1:len(acc) - 1], [acc[-1] || ', ' || x[1]]) ELSE list_concat(acc, x) END))) AS v FROM s),
  w AS (SELECT row_id, field, item_pos, list_filter(CASE WHEN regexp_matches(t, '[,;|\r\n]') THEN list_transform(v, lambda x: trim(replace(x, chr(3), '"'), ' ')) ELSE [t] END, lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS v FROM f),
  vals AS (SELECT row_id, field, item_pos, unnest(range(1, len(v) + 1)) AS value_pos, CAST(len(v) AS INTEGER) AS n_values, unnest(v) AS value FROM w)"""
ORACLE: dict[str, str] = {
    "p2_found": f"{_VALUES} SELECT row_id, field, item_pos, value_pos FROM vals WHERE n_values > 1",
    "p2_values": f"{_VALUES} SELECT row_id, field, item_pos, value_pos, n_values, value FROM vals",
}
