import pytest
from pyspark.sql import functions as F

from bankspark.model import BankError
from bankspark.operators import audit as A


def test_floors_budgets_and_covers_fail_closed(spark):
    counts = spark.createDataFrame([("train", 3, 30), ("test", 1, 2)], "part string, groups long, records long")
    assert A.with_support(counts, {"train": 30, "": 2}).count() == 2
    for floors in ({"train": 31}, {"": 3}, {"validation": 0}):
        with pytest.raises(BankError):
            A.with_support(counts, floors)
    keyed = spark.createDataFrame([(1,), (1,), (1,), (2,)], "k long")
    assert A.within_budget(keyed, ["k"], 3) is keyed
    with pytest.raises(BankError):
        A.within_budget(keyed, ["k"], 2)
    assert A.emissions(keyed.limit(0), ["k"]).first().emissions == 0
    labels, bound = spark.createDataFrame([(1, "a"), (2, "b")], "k long, l string"), spark.createDataFrame([(1, "x"), (2, "y")], "k long, b string")
    assert A.exactly_covered(labels, bound, ["k"]).count() == 2
    for wrong in (bound.limit(1), bound.union(bound), bound.union(spark.createDataFrame([(3, "z")], bound.schema))):
        with pytest.raises(BankError):
            A.exactly_covered(labels, wrong, ["k"])


def test_digests_change_with_any_record_and_order(spark):
    rows = [(d, i, f"e{i}") for d in range(2500) for i in range(d % 3)]
    digest = lambda r: A.ordered_digest(spark.createDataFrame(r, "doc long, start long, e string"), "doc", ["start", "e"]).first().digest
    assert digest(rows) == digest(rows[::-1]) != digest(rows[:-1])
    assert digest([*rows[:-1], (rows[-1][0], rows[-1][1], "other")]) != digest(rows)
    assert A.ordered_digest(spark.createDataFrame([], "doc long, start long, e string"), "doc", ["start", "e"]).first().records == 0


def test_iterations_fail_closed_and_the_best_sound_one_stands():
    m = lambda name, support, precision, recall: {"name": name, "support": support, "precision": precision, "recall": recall}
    out = A.decide_iterations([m("a", 5, 0.9, 0.5), m("b", 5, None, 0.9), m("c", 0, 1.0, 1.0), m("d", 5, 0.8, 0.9), m("e", 5, 0.9, 0.6)])
    assert [r["reason"] for r in out] == ["superseded", "unsupported", "unsupported", "no gain", "stands"] and [r["selected"] for r in out] == [False] * 4 + [True]
    assert not any(r["selected"] for r in A.decide_iterations([m("x", 0, 1.0, 1.0)], 3)) and A.decide_iterations([]) == []


def test_margin_sample_reserves_each_margin_and_keeps_the_size(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}", "rare" if i == 77 else "often") for i in range(400)], "id long, s string, m string").withColumn("rank", F.lit("clash")).select("id", "s", "m")
    out = A.margin_sample(df, "id", F.col("s"), [F.col("m")], 40).collect()
    assert len(out) == 40 and 77 in {r.id for r in out if r.reserved} and len({r.id for r in out}) == 40
    assert A.margin_sample(df.limit(0), "id", F.col("s"), [F.col("m")], 40).count() == 0
    assert {r.id for r in A.margin_sample(df, "id", F.col("s"), [], 10_000).collect()} == set(range(400))


def test_gates_without_a_value_fail(spark):
    measured = spark.createDataFrame([("a", 3.0), ("b", None)], "name string, value double")
    assert {r.gate: r.passed for r in A.gates(measured, {"a": ("least", 3), "b": ("most", 1), "c": ("most", 1)}).collect()} == {"a": True, "b": False, "c": False}


def test_near_pairs_keep_to_their_budget(spark):
    from bankspark.operators import corpus as C

    df = spark.createDataFrame([(i, i) for i in range(6)], "node long, simhash long")
    n = C.candidate_budget(df).first().emissions
    assert n > 0 and C.near_pairs(df, budget=n).count() == C.near_pairs(df).count() == 15
    with pytest.raises(BankError):
        C.near_pairs(df, budget=n - 1)
