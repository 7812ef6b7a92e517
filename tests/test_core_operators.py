from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bankspark.operators import timestamps
from bankspark.operators.components import components
from bankspark.operators.split_values import split_values

# --- packed values -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "element,values",
    [
        ("a@x.example, b@x.example", ["a@x.example", "b@x.example"]), ("a@x.example;b@x.example;", ["a@x.example", "b@x.example"]), ("a@x.example | Ines Marler <i@x.example>", ["a@x.example", "Ines Marler <i@x.example>"]),
        ("a@x.example,\n\tb@x.example", ["a@x.example", "b@x.example"]), ("a@x.example\nb@x.example", ["a@x.example", "b@x.example"]), ('"Marler, Ines" <i@x.example>, b@x.example', ['"Marler, Ines" <i@x.example>', "b@x.example"]),
        ("Marler, Ines <i@x.example>; Oskar Bendik", ["Marler, Ines <i@x.example>", "Oskar Bendik"]), ("Marler, Ines", ["Marler, Ines"]), ("Marler, I.", ["Marler, I."]), ('"a@x.example, b@x.example"', ["a@x.example", "b@x.example"]),
        ('"Halden Grid Services, Inc."', ['"Halden Grid Services, Inc."']), ('"Vero Freight; Desk 4"', ['"Vero Freight; Desk 4"']), ("Ines Marler/Ops", ["Ines Marler/Ops"]), ("Yardnet Int'l", ["Yardnet Int'l"]),
        ("'Ines Marler' <i@x.example>;'Oskar, B' <o@x.example>", ['"Ines Marler" <i@x.example>', '"Oskar, B" <o@x.example>']), ("a@x.example,, b@x.example", ["a@x.example", "b@x.example"]), ("a@x.example (Marler, Ines), b@x.example", ["a@x.example (Marler, Ines)", "b@x.example"]),
        ("b@x.example, KwameSisden", ["b@x.example", "KwameSisden"]), ("5\" pipe desk", ['5" pipe desk']), (" , ; ", []), ("", []), (None, []),
    ],
)
def test_values_of_an_element(spark, element, values):
    df = spark.createDataFrame([(1, [element])], "row_id long, to array<string>")
    rows = sorted(split_values(df, "row_id", ["to"]).collect(), key=lambda r: r.value_pos)
    assert [r.value for r in rows] == values
    assert [r.value_pos for r in rows] == list(range(1, len(values) + 1)) and all(r.n_values == len(values) and r.item_pos == 1 for r in rows)


def test_fields_positions_nulls_and_clashing_columns(spark):
    rows = [(1, [None, "a@x.example;b@x.example"], None), (1, [None, "a@x.example;b@x.example"], None), (2, [], ["c@x.example"]), (3, None, None)]
    df = spark.createDataFrame(rows, "row_id long, to array<string>, cc array<string>").withColumn("value", F.lit(0)).withColumn("item", F.lit(0))
    got = sorted(tuple(r) for r in split_values(df, "row_id", ["to", "cc"]).select("row_id", "field", "item_pos", "value_pos").collect())
    assert got == sorted([(1, "to", 2, 1), (1, "to", 2, 2)] * 2 + [(2, "cc", 1, 1)])
    assert split_values(df.limit(0), "row_id", ["to", "cc"]).count() == 0


def test_very_long_element(spark):
    df = spark.createDataFrame([(1, [", ".join(f"a{i}@x.example" for i in range(3000))])], "row_id long, to array<string>")
    assert split_values(df, "row_id", ["to"]).count() == 3000


# --- timestamps ----------------------------------------------------------------------------------------------------

US = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 10**6


@pytest.mark.parametrize(
    "text,home,want",
    [
        ("2002-01-23T01:05:03Z", None, US(2002, 1, 23, 1, 5, 3)), ("2002-01-23T01:05:03.25+05:30", None, US(2002, 1, 22, 19, 35, 3) + 250_000), ("Fri, 02 May 2003 11:49:08 -0400 (EDT)", None, US(2003, 5, 2, 15, 49, 8)),
        ("Fri, 4 Jan 2002 18:47:52 CST", None, US(2002, 1, 5, 0, 47, 52)), ("01/05/99 9:50 AM", "America/Chicago", US(1999, 1, 5, 15, 50)), ("12/31/1999 12:05 AM", "UTC", US(1999, 12, 31, 0, 5)), ("17.07.1998 12:46", "Europe/Berlin", US(1998, 7, 17, 10, 46)),
        ("Sonntag, 20. Juni 1999 10:25", "Europe/London", US(1999, 6, 20, 9, 25)), ("19 Dec 2003 03:50 UTC", None, US(2003, 12, 19, 3, 50)), ("991270242", None, 991270242 * 10**6), ("1020125988437", None, 1020125988437 * 1000),
        ("2000-03-18 18:14:07 America/New_York", "Asia/Tokyo", US(2000, 3, 18, 23, 14, 7)), ("Tue Feb 20 02:19:42 EST 2001", None, US(2001, 2, 20, 7, 19, 42)), ("Sun Mar  2 07:53:31 CST 2003", None, US(2003, 3, 2, 13, 53, 31)),
        ("Dec 24, 2000 8:00:33 AM", "America/New_York", US(2000, 12, 24, 13, 0, 33)), ("Sunday, April 05, 1998 9:58 PM", "UTC", US(1998, 4, 5, 21, 58)), ("19990128T201510Z", None, US(1999, 1, 28, 20, 15, 10)), ("2/15/1999 9:58:58 AM -06:00", None, US(1999, 2, 15, 15, 58, 58)),
        ("  2001-07-29T21:46-0500\t", None, US(2001, 7, 30, 2, 46)), ("9/9/70 1:00 PM", "UTC", US(1970, 9, 9, 13)), ("9/9/69 1:00 PM", "UTC", US(2069, 9, 9, 13)),
        # no case: skipped and doubled clock times, no zone, no time, impossible, free text
        ("2000-04-02 02:30:00 America/New_York", None, None), ("2000-10-29 01:30:00 America/New_York", None, None), ("2000-10-29 01:30:00", "America/New_York", None), ("2000-10-29 01:30:00", "America/Phoenix", US(2000, 10, 29, 8, 30)),
        ("1998-07-27 18:17:19", None, None), ("10/18/2001", "UTC", None), ("13 Aug 2002", "UTC", None), ("31/31/2001 9:00 AM", "UTC", None), ("2001-02-30 09:15:00 +0000", None, None), ("2001-01-01 25:00:00", "UTC", None), ("12/1/2001 13:00 PM", "UTC", None),
        ("yesterday", "UTC", None), ("n/a", "UTC", None), ("", "UTC", None), (None, "UTC", None), ("x" * 100_000, "UTC", None), ("2000-01-01 10:00:00", "No/Where", None), ("2000-01-01 10:00:00 XYZ", "UTC", None),
    ],
)
def test_instants(text, home, want):
    got = timestamps.normalise(pd.Series([text], dtype=object), pd.Series([home], dtype=object))[0]
    assert (None if pd.isna(got) else int(got)) == want


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Asia/Kolkata", "Australia/Lord_Howe", "Africa/Casablanca", "America/Phoenix"])
def test_zone_tables_equal_the_standard_library(zone):
    rules = ZoneInfo(zone)
    begin = datetime(1965, 1, 1)
    local = [begin + timedelta(hours=7 * i, minutes=13) for i in range(0, 60_000, 11)] + [datetime(2003, 4, 6, 2, 30), datetime(2003, 10, 26, 1, 30)]
    import numpy as np

    seconds = np.array([int(t.replace(tzinfo=timezone.utc).timestamp()) for t in local])
    utc, ok = timestamps.local_to_utc(seconds, zone)
    for t, u, good in zip(local, utc, ok):
        both = {t.replace(tzinfo=rules, fold=f).astimezone(timezone.utc) for f in (0, 1)}
        real = {x for x in both if x.astimezone(rules).replace(tzinfo=None) == t}
        assert good == (len(real) == 1) and (not good or real == {datetime.fromtimestamp(int(u), timezone.utc)})


def test_dates_in_spark_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "2002-01-23T01:05:03Z", None), (1, "2002-01-23T01:05:03Z", None), (2, None, "UTC")], "row_id long, date string, home_zone string").withColumns({"k": F.lit(1), "d": F.lit("x"), "z": F.lit("x")})
    assert [tuple(r) for r in timestamps.to_utc(df, "row_id", "date", "home_zone").orderBy("row_id").collect()] == [(1, US(2002, 1, 23, 1, 5, 3))] * 2 + [(2, None)]
    assert timestamps.to_utc(df.limit(0), "row_id", "date", "home_zone").count() == 0


# --- components ------------------------------------------------------------------------------------------------------


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(6)
    rows = [(i, f"a{rng.randint(0, 160)}" if rng.random() < 0.9 else None, f"b{rng.randint(0, 160)}" if rng.random() < 0.6 else None) for i in range(300)]
    rows += [(1000 + i, f"chain{i}", f"chain{i + 1}") for i in range(40)] + [(2000 + i, "hot", None) for i in range(200)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, *keys in rows:
        for n, k in enumerate(keys):
            if k is not None:
                a, b = find(i), find(("ab"[n] if not k.startswith("chain") else "c", k))
                parent[a] = b
    df = spark.createDataFrame(rows, "row_id long, a string, b string").withColumn("row", F.lit(0)).withColumn("keys", F.lit(0))
    chain = lambda c: F.when(c.startswith("chain"), F.concat(F.lit("c"), c)).otherwise(c)
    a, b = F.when(~F.col("a").startswith("chain"), F.col("a")), F.when(~F.col("b").startswith("chain"), F.col("b"))
    got = {r.row_id: r.group for r in components(df.union(df), "row_id", {"a": a, "b": b}).collect()}
    alone = [(i, x, y) for i, x, y in rows if not 1000 <= i < 2000]
    want: dict = {}
    for i, *_ in alone:
        want.setdefault(find(i), []).append(i)
    assert {i: min(g) for g in want.values() for i in g} == {i: g for i, g in got.items() if not 1000 <= i < 2000}
    linked = df.where("row_id between 1000 and 1999").select("row_id", F.explode(F.array("a", "b")).alias("k"))
    assert {r.group for r in components(linked, "row_id", {"k": chain(F.col("k"))}).collect()} == {1000}
    assert components(df.limit(0), "row_id", {"a": F.col("a")}).count() == 0


def test_a_row_with_many_keys_links_them_all(spark):
    rows = [(i, f"k{i}") for i in range(200)] + [(999, f"k{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, k string")
    got = components(df, "row_id", {"k": F.col("k")}).collect()
    assert len(got) == 201 and {r.group for r in got} == {0}


@pytest.mark.parametrize("pad", [" " * 70, " " * 5000, "\t \n" * 40])
def test_space_around_and_inside_a_date_does_not_matter(pad):
    got = timestamps.normalise(pd.Series([f"{pad}2001-02-03{pad}10:11:12{pad}Z{pad}", "x " * 50_000, "9" * 5000], dtype=object), pd.Series([None] * 3, dtype=object))
    assert got[0] == 981195072000000 and got[1] is pd.NA and got[2] is pd.NA


def test_texts_over_a_limit_come_out_as_errors_and_end_nothing(spark):
    from bankspark.operators import scan as scans

    found = scans.ordered_alternatives(None, [{"entity": "e", "name": "n", "regex": "ab", "flags": []}])
    df = spark.createDataFrame([(1, "ab ab ab"), (2, "ab"), (3, "x" * 40), (4, "ab" + "x" * 40), (5, None), (6, "")], "doc_id long, text string")
    rows = scans.scan_all(df, "doc_id", "text", found, most_bytes=20, most=2).collect()
    assert {(r.doc_id, r.error) for r in rows} == {(1, "too_many_matches"), (2, None), (3, "text_too_large"), (4, "text_too_large")} and len(rows) == 4


@pytest.mark.parametrize("text,us", [("٢٠٠١-٠٢-٠٣ 10:11:12Z", 981195072000000), ("2001-02-03 10:11:12 America/Chicago", 981216672000000), ("2001-02-03 10:11:12 AMT", None), ("2001-02-03 10:11:12.123456789 +0130", 981189672123456), ("9223372036854775807", 9223372036854775), ("99999999999999999999", None), ("-1", -1000000)])
def test_words_are_not_cut_and_digits_of_any_script_count(text, us):
    got = timestamps.normalise(pd.Series([text, text], dtype=object), pd.Series([None, "Europe/Berlin"], dtype=object))
    assert [None if x is pd.NA else int(x) for x in got] == [us, us]
