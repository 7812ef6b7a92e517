import json

import pytest
from pyspark.sql import functions as F

from bankspark.model import BankError
from bankspark.operators import bank as B
from bankspark.operators import evals, patterns, resolve
from bankspark.operators import scan as S


def literal(value, **more):
    return {"kind": "literal", "value": value, "description": "", "status": "active", "priority": 100, "metadata": {}, "case_sensitive": False, "normalize_whitespace": True, "left_boundary": "word", "right_boundary": "word", **more}


def regex(value, flags=(), **more):
    return {"kind": "regex", "value": value, "description": "", "status": "active", "priority": 100, "metadata": {}, "regex_flags": list(flags), **more}


def bank(**entities):
    """bank(person={"sam": [patterns]})"""
    out = {}
    for e, names in entities.items():
        out[e] = {"description": "", "status": "active", "regex_flags": [], "metadata": {}, "names": {n: {"canonical": n.title(), "description": "", "status": "active", "metadata": {}, "patterns": {f"p{i}": p for i, p in enumerate(ps)}} for n, ps in names.items()}}
    return {"schema_version": "own.bank.v1", "id": "b", "name": "b", "description": "", "version": "1", "status": "active", "created_at": "", "updated_at": "", "unicode_normalization": "none", "default_regex_flags": [], "entities": out, "metadata": {}}


def spans(b, text, **options):
    return [(r["entity"], r["string"], r["start"], r["end"]) for r in S.scan_text(text, S.detectors(b), **options)]


# --- algebra -----------------------------------------------------------------------------------------------------------


def test_a_sound_bank_has_no_findings_and_broken_ones_have_them_in_order():
    good = bank(person={"sam": [literal("Sam"), regex("x+")]})
    assert B.validate(good) == []
    bad = json.loads(json.dumps(good))
    bad["entities"]["Person!"] = bad["entities"].pop("person")
    bad["entities"]["Person!"]["names"]["sam"]["patterns"]["p0"].pop("case_sensitive")
    bad["entities"]["Person!"]["names"]["sam"]["patterns"]["p1"]["regex_flags"] = ["ASCII", "ASCII", "NONE"]
    bad["extra"] = 1
    codes = [d["code"] for d in B.validate(bad)]
    assert {"id.invalid", "schema.required", "flags.duplicate", "schema.type", "schema.additional_property"} <= set(codes)
    assert [d["path"] for d in B.validate(bad)] == sorted(d["path"] for d in B.validate(bad))


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"a":NaN}', "[" * 200 + "]" * 200, "{"])
def test_strict_json_refuses(text):
    with pytest.raises(BankError):
        B.strict_json(text)


def test_canonical_form_and_hash_do_not_depend_on_order():
    a = bank(person={"sam": [literal("Sam", eval_refs=["b", "a"])]})
    b = json.loads(json.dumps(a, sort_keys=True))
    b["entities"]["person"]["names"]["sam"]["patterns"]["p0"]["eval_refs"] = ["a", "b"]
    b["default_regex_flags"] = []
    assert B.bank_hash(a) == B.bank_hash(b)
    assert B.canonical({"regex_flags": ["DOTALL", "ASCII", "DOTALL"]}) == {"regex_flags": ["ASCII", "DOTALL"]}


def test_diff_and_patch_are_inverse():
    old = bank(person={"sam": [literal("Sam")], "ann": [literal("Ann")]}, place={"x": [regex("x")]})
    new = bank(person={"sam": [literal("Samwise", priority=5)], "joe": [literal("Joe")]})
    new["version"] = "2"
    out = B.diff(old, new)
    assert B.canonical(B.patch(old, out["patch"])) == B.canonical(new)
    assert out["summary"] == {"entities_added": 0, "entities_removed": 1, "entities_changed": 1, "names_added": 1, "names_removed": 2, "names_changed": 1, "patterns_added": 1, "patterns_removed": 2, "patterns_changed": 1, "top_level_fields_changed": 1, "patch_operations": len(out["patch"])}
    with pytest.raises(BankError):
        B.patch(old, [{"op": "remove", "path": "/entities/none"}])
    with pytest.raises(BankError):
        B.patch(old, [{"op": "test", "path": "/id", "value": "other"}])
    moved = B.patch(old, [{"op": "copy", "from": "/entities/place", "path": "/entities/spot"}, {"op": "move", "from": "/entities/place", "path": "/entities/venue"}])
    assert set(moved["entities"]) == {"person", "spot", "venue"}


def test_status_filter_and_stats():
    b = bank(person={"sam": [literal("Sam"), literal("S", status="draft")]}, place={"x": [regex("x", status="draft")]})
    kept = B.filter_status(b)
    assert set(kept["entities"]) == {"person"} and set(kept["entities"]["person"]["names"]["sam"]["patterns"]) == {"p0"}
    assert B.stats(b)["active_totals"] == {"entities": 2, "names": 2, "patterns": 1} and B.stats(b)["by_kind"] == {"literal": 2, "regex": 1}
    b["entities"]["person"]["status"] = b["entities"]["place"]["status"] = "inactive"
    assert B.filter_status(b) is None and S.detectors(b) == []


def test_patterns_can_be_added_and_removed():
    b = B.add_pattern(bank(person={"sam": [literal("Sam")]}), "place", "x", "p0", literal("X"))
    with pytest.raises(BankError):
        B.add_pattern(b, "place", "x", "p0", literal("Y"))
    assert B.add_pattern(b, "place", "x", "p0", literal("Y"), replace=True)["entities"]["place"]["names"]["x"]["patterns"]["p0"]["value"] == "Y"
    assert "place" not in B.remove_pattern(b, "place", "x", "p0")["entities"]


def test_lints(spark):
    values = {"(a+)+": "nested_quantifier", "a.*b": "unbounded_dot_star", "|".join("abcdefghijklmnopqrstuvw"): "huge_alternation", "x+": "short_unbounded", "plain": "literal_candidate", "(?=a)(?!b)(?<=c)": "repeated_lookaround", "(a)" * 51: "excessive_groups"}
    df = spark.createDataFrame([(v,) for v in values], "value string")
    for row in df.select("value", *[c.alias(k) for k, c in B.lint_columns(F.col("value")).items()]).collect():
        assert row[values[row.value]], row
    assert B.matches_empty("a*", []) and not B.matches_empty("a+", [])


# --- scanning: the required categories ---------------------------------------------------------------------------------


def test_byte_offsets_after_non_ascii_text():
    b = bank(artist={"pf": [regex(r"Pink\sFloyd")]})
    assert spans(b, "Café Pink Floyd") == [("artist", "Pink Floyd", 6, 16)]
    assert spans(b, "Café Pink Floyd", offsets="char") == [("artist", "Pink Floyd", 5, 15)]


def test_cross_entity_overlap_and_nickname_inside_project():
    b = bank(person={"sam": [regex("Sam")]}, project={"samba": [regex("Samba")]})
    assert spans(b, "Samba ships") == [("person", "Sam", 0, 3), ("project", "Samba", 0, 5)]


def test_leftmost_first_within_an_entity_by_priority_then_order():
    low = bank(person={"a": [regex("Sam", priority=1)], "b": [regex("Samwise", priority=2)]})
    high = bank(person={"a": [regex("Sam", priority=2)], "b": [regex("Samwise", priority=1)]})
    assert spans(low, "Samwise") == [("person", "Sam", 0, 3)] and spans(high, "Samwise") == [("person", "Samwise", 0, 7)]
    assert spans(bank(x={"a": [regex("bc", priority=1)], "b": [regex("ab", priority=9)]}), "abc") == [("x", "ab", 0, 2)]


def test_ordered_alternation():
    assert spans(bank(p={"a": [regex("Sam|Samwise")]}), "Samwise") == [("p", "Sam", 0, 3)]
    assert spans(bank(p={"a": [regex("Samwise|Sam")]}), "Samwise Sam") == [("p", "Samwise", 0, 7), ("p", "Sam", 8, 11)]


def test_word_boundaries_are_unicode():
    b = bank(p={"a": [literal("caf")]})
    assert spans(b, "café caf") == [("p", "caf", 6, 9)]
    combining = bank(p={"a": [literal("cafe")]})
    assert spans(combining, "cafe\u0301 cafe") == [("p", "cafe", 7, 11)]
    assert spans(bank(p={"a": [regex(r"\w+²")]}), "m² x") == [("p", "m²", 0, 3)] and spans(bank(p={"a": [regex(r"^\w+$")]}), "²") == []


@pytest.mark.parametrize(
    "pattern,flags,text,found",
    [
        ("abc", ["IGNORECASE"], "ABC", ["ABC"]), ("^b$", ["MULTILINE"], "a\nb\nc", ["b"]), ("a.b", ["DOTALL"], "a\nb", ["a\nb"]), ("a b # no", ["VERBOSE"], "ab", ["ab"]), (r"\w+", ["ASCII"], "é ab", ["ab"]), (r"\bb", ["ASCII"], "éb", ["b"]), (r"\bb", [], "éb", []),
        (r"\d+", [], "٣4", ["٣4"]), (r"\d+", ["ASCII"], "٣4", ["4"]), (r"\S+", [], "a\u00a0b", ["a", "b"]), ("i", ["IGNORECASE"], "ı", []), ("k", ["IGNORECASE"], "\u212a", ["\u212a"]), (r"x\x{41}", [], "xA", ["xA"]), (r"[\w-]+", [], "a-b", ["a-b"]),
    ],
)
def test_flags(pattern, flags, text, found):
    assert [m.group() for m in patterns.compile_pattern(pattern, flags).finditer(text)] == found


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", r"(a)\1", "(?P<x>a)(?P=x)", "(?>a)", "a++", "a*+", "a{2}+", "(", "[a", r"[\W]"])
def test_patterns_that_are_not_accepted(pattern):
    with pytest.raises(BankError):
        patterns.compile_pattern(pattern)


def test_literals():
    b = bank(p={"a": [literal("Acme  Corp.", right_boundary="none")]})
    assert spans(b, "ACME\n\tcorp. acme corp") == [("p", "ACME\n\tcorp.", 0, 11)]
    exact = bank(p={"a": [literal("A (b)", case_sensitive=True, normalize_whitespace=False, left_boundary="none", right_boundary="none")]})
    assert spans(exact, "xA (b)y a (b)") == [("p", "A (b)", 1, 6)]
    assert patterns.literal_pattern("a #", False, "none", "none", True) == r"a\x{20}\x{23}"


def test_ambiguous_detectors_and_bad_priorities_are_refused():
    twice = bank(p={"a": [literal("X")], "b": [literal("X")]})
    twice["entities"]["p"]["names"]["b"]["canonical"] = "A"
    with pytest.raises(BankError):
        S.detectors(twice)
    with pytest.raises(BankError):
        S.detectors(bank(p={"a": [literal("X", priority=-1)]}))
    with pytest.raises(BankError):
        patterns.merge_flags(["UNICODE"])
    assert patterns.merge_flags(["re.VERBOSE"], ["ascii"]) == ["ASCII", "VERBOSE"]


def test_prefilter_changes_nothing():
    """Fragments only choose which patterns run: random banks give what every pattern on its own gives."""
    import random

    rng = random.Random(9)
    for _ in range(150):
        word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
        b = bank(**{f"e{i}": {f"n{j}": [rng.choice([literal(f"{word()} {word()}" if rng.random() < 0.3 else word(), priority=rng.randint(0, 3), left_boundary=rng.choice(["none", "word"])), regex(rng.choice([f"{word()}+", f"{word()}|{word()}", f"{word()}c?", r"\b" + word()]), priority=rng.randint(0, 3))])] for j in range(3)} for i in range(2)})
        found = S.detectors(b)
        text = "".join(rng.choice("abcABC  é") for _ in range(40))
        own = S.Scanner(found)
        slow = S.Scanner(found)
        slow.always, slow.by_text = list(range(len(found))), {}
        for mode in S.MODES:
            assert own.matches(text, mode) == slow.matches(text, mode)


def test_scan_in_spark_equals_scan_of_one_text(spark):
    b = bank(person={"sam": [literal("Sam"), regex(r"S\w+e")]}, place={"x": [literal("Über")]})
    texts = ["Sam über Samwise Sam", None, "", "Über — Sam", "Über — Sam", "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"string": F.lit("clash"), "start": F.lit(1)})
    got = sorted((r.doc_id, r.entity, r.string, r.start, r.end) for r in S.scan(df, "doc_id", "text", S.detectors(b)).collect())
    assert got == sorted((i, *s) for i, t in enumerate(texts) if t for s in spans(b, t))
    assert S.scan(df, "doc_id", "text", []).count() == 0 and S.scan(df.limit(0), "doc_id", "text", S.detectors(b)).count() == 0


def test_sql_table_function(spark):
    from bankspark.functions.udtf import register_scan

    register_scan(spark, S.detectors(bank(person={"sam": [literal("Sam")]})))
    spark.createDataFrame([(1, "Sam é Sam"), (2, None)], "doc_id long, text string").createOrReplaceTempView("some_docs")
    rows = spark.sql("SELECT doc_id, s.start FROM some_docs, LATERAL scan_entities(text) s ORDER BY 1, 2").collect()
    assert [tuple(r) for r in rows] == [(1, 0), (1, 7)]


# --- reports -----------------------------------------------------------------------------------------------------------


def test_groups_are_transitive_and_lower_priority_values_win(spark):
    rows = [("d", "e", "a", "p0", "abcdefgh", 0, 8), ("d", "e", "b", "p0", "ghijkl", 6, 12), ("d", "e", "c", "p0", "lmn", 11, 14), ("d", "e", "f", "p0", "x", 14, 15), ("d", "e", "g", "p0", "yy", 20, 22), ("d", "f", "g", "p0", "yy", 20, 22)]
    records = spark.createDataFrame(rows, "document_id string, entity_id string, name_id string, pattern_id string, string string, start long, end long")
    pats = spark.createDataFrame([("e", n, "p0", p) for n, p in [("a", 3), ("b", 2), ("c", 9), ("g", 5)]], "entity_id string, name_id string, pattern_id string, priority long")
    out = {(r.entity_id, r.name_id): r for r in resolve.resolve(records, pats).collect()}
    assert [k for k, r in out.items() if r.winner and r.group_size == 3] == [("e", "b")]
    assert out["e", "f"].winner and out["e", "f"].overlap_id is None
    assert out["e", "b"].overlap_id == "overlap_0" and out["f", "g"].overlap_id == "overlap_1" and out["f", "g"].winner  # no pattern: priority 0
    counts = {(r.entity_id, r.name_id): r.records for r in resolve.grouped_counts(records).collect()}
    assert counts[None, None] == 6 and counts["e", None] == 5 and counts["e", "g"] == 1
    docs = spark.createDataFrame([("d", "éabcdefghijklmnopqrstuvwxyz"), ("z", None)], "document_id string, text string")
    c = resolve.context(records.limit(1).withColumn("offset_unit", F.lit("char")), docs, "document_id", "text", 3).first()
    assert (c.before, c["match"], c.after) == ("", "éabcdefg", "hij")
    s = resolve.batch_summary(docs, records, "document_id").first()
    assert tuple(s) == (2, 6, 1)


# --- gates and benchmarks --------------------------------------------------------------------------------------------------


def test_regression_gates():
    before = {"suite_hash": "a", "passed": 9, "failed": 1, "seconds": 1.0}
    assert evals.regress(before, {**before, "seconds": 1.1}, most_ratio=1.2)["accepted"]
    assert evals.regress(before, {**before, "failed": 2})["reasons"] == ["more evaluations fail"]
    assert not evals.regress(before, {**before, "suite_hash": "b"})["accepted"] and not evals.regress(before, {"suite_hash": "a"})["accepted"]
    assert not evals.regress(before, {**before, "seconds": 9.0}, most_ratio=1.2)["accepted"]


@pytest.mark.parametrize("name", evals.PROFILES)
def test_synthetic_banks_are_sound(name):
    b = evals.profile(name)
    assert B.validate(b) == [] and len(S.detectors(b)) == B.stats(b)["totals"]["patterns"]


def test_literals_of_any_number_of_words_are_candidates(spark):
    from bankspark.operators.scan import dictionary_join

    long = "The Very Long Name Of A Harbour And Rail Company"
    bank = spark.createDataFrame([("a", "n", "p1", long), ("a", "n", "p2", "one two"), ("a", "n", "p3", "Solo"), ("a", "n", "p4", "--")], "entity_id string, name_id string, pattern_id string, value string")
    docs = spark.createDataFrame([(1, f"by {long.upper()}, one  two"), (2, None), (3, ""), (4, "solo")], "doc_id long, text string")
    got = {(r.doc_id, r.pattern_id, r.position) for r in dictionary_join(docs, "doc_id", "text", bank).collect()}
    assert got == {(1, "p1", 2), (1, "p2", 12), (4, "p3", 1)}
    assert dictionary_join(docs, "doc_id", "text", bank.limit(0)).count() == 0
