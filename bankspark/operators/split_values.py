"""Several values packed in one field: one row per value with the element's and the value's position.

Method: split the element on quote characters; odd pieces are literals, even pieces are split on
delimiters; array folds put the values together again and number them. All of it is a chain of
built-in expressions, so it runs inside the scan stage without a shuffle.

Defined results
- null or empty array, null element, blank element: no row.
- empty pieces (doubled, leading or trailing delimiters): not counted and not numbered.
- an odd number of quotes: the last quote is an ordinary character.
- an element that is one quoted list of two or more mail addresses is split inside its quotes.
- an unquoted comma between a family name and given names ("Last, First M <a@b>") or before a legal
  form ("Acme, Inc.") does not separate; neither do delimiters inside brackets.
- repeated rows give repeated results; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SOFT, HARD, QUOTE = "\u0001", "\u0002", "\u0003"

#: A lone family name, not two names written as one ("KwameSisdener").
FAMILY = r"^(?:[dD]e |[vV]an |[vV]on |[lL]a )?\p{Lu}(?:\p{Ll}|['’-])*(?:[-'’]\p{Lu}\p{Ll}+)?$|^\p{Lu}{2,}$"
#: Given names after the comma, then nothing or an address in brackets.
GIVEN = r"^\p{L}[\p{L}'’.-]*(?: \p{L}[\p{L}'’.-]*)?\s*(?:<[^>]*>|\[[^\]]*\]|\([^)]*@[^)]*\))?$"
LEGAL = r"(?i)^(?:inc|llc|llp|ltd|limited|corp|co|plc|gmbh|ag|s\.?a|jr|sr|ii|iii|ph\.?d|m\.?d|esq)\.?\s*(?:<[^>]*>|\[[^\]]*\])?$"


def _masked(element: Column) -> Column:
    """Delimiters outside literals become SOFT (a comma) or HARD (all others); quotes become QUOTE."""
    plain = F.when(
        element.rlike(r'^\s*"[^"]*@[^"]*[,;|\n][^"]*@[^"]*"\s*$'), F.regexp_replace(element, '"', "")
    ).otherwise(element)
    # single quotes count as quotes only where they stand around a whole name
    plain = F.regexp_replace(plain, r"(^|[,;|\n]\s*)'([^'\n]*)'(?=\s*(?:[<,;|\[(\n]|$))", '$1"$2"')
    pieces = F.split(plain, '"', -1)
    balanced = F.size(pieces) % 2 == 1

    def piece(x: Column, i: Column) -> Column:
        literal = (i % 2 == 1) & (balanced | (i < F.size(pieces) - 1))
        soft = F.regexp_replace(x, r"\s*,\s*(?![^()\[\]]*[)\]])", SOFT)
        hard = F.regexp_replace(soft, r"[;|\r\n]+(?![^()\[\]]*[)\]])", HARD)
        return F.when(literal, F.concat(F.lit(QUOTE), x, F.lit(QUOTE))).otherwise(hard)

    return F.array_join(F.transform(pieces, piece), "")


def _fold(segment: Column) -> Column:
    """Comma pieces to values: given names go back to their family name, a legal form to its firm."""
    empty = F.array().cast("array<string>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        goes_on = (F.size(acc) > 0) & ((last.rlike(FAMILY) & x.rlike(GIVEN)) | x.rlike(LEGAL))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(", ", last, x)))
        return F.when(x == "", acc).when(goes_on, joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.transform(F.split(segment, SOFT, -1), lambda x: F.trim(x)), empty, add)


def values_of(element: Column) -> Column:
    """array<string>: the values packed in one element, in order."""
    trimmed = F.regexp_replace(element, r"^\s+|\s+$", "")
    folded = F.flatten(F.transform(F.split(_masked(trimmed), HARD, -1), _fold))
    clean = F.transform(folded, lambda x: F.trim(F.regexp_replace(x, QUOTE, '"')))
    many = F.filter(clean, lambda x: x.rlike(r"[\p{L}\p{N}]"))
    one = F.filter(F.array(trimmed), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return F.when(trimmed.rlike(r"[,;|\r\n]"), many).otherwise(one)


def split_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, item_pos, value_pos, n_values, value: one row per value of the array columns `fields`."""
    def elements(field: str) -> Column:
        as_item = lambda x, i: F.struct(F.lit(field).alias("field"), (i + 1).cast("long").alias("item_pos"), x.alias("element"))
        return F.transform(F.coalesce(F.col(f"`{field}`"), F.array().cast("array<string>")), as_item)

    items = F.flatten(F.array(*[elements(f) for f in fields]))
    rows = df.select(F.col(key), F.explode(items).alias("item")).where("item.element is not null")
    rows = rows.select(key, "item.field", "item.item_pos", values_of(F.col("item.element")).alias("vals"))
    rows = rows.select(key, "field", "item_pos", F.size("vals").alias("n_values"), F.posexplode("vals").alias("p", "value"))
    return rows.select(key, "field", "item_pos", (F.col("p") + 1).cast("long").alias("value_pos"), "n_values", "value")
