import pytest
from pyspark.sql import functions as F

from bankspark.functions.normal import normalised
from bankspark.model import BankError
from bankspark.operators import documents as D
from bankspark.operators import lint as L
from bankspark.operators import mine as M
from bankspark.operators import rewrite as R
from bankspark.operators import scan as S
from tests.test_bank import bank, literal, regex


@pytest.mark.parametrize("pattern,risk", [("(a+)+", "nested_quantifier"), ("a.*b", "unbounded_dot_star"), ("Sam|Samwise", "ambiguous_alternation"), ("x(ab|abc)y", "ambiguous_alternation"), ("a+", "short_unbounded"), ("plain", "literal_candidate"), ("|".join(chr(97 + i) + "x" for i in range(22)), "huge_alternation"), ("(a)" * 51, "excessive_groups")])
def test_risks(pattern, risk):
    assert risk in L.risks(pattern)


@pytest.mark.parametrize("pattern", [r"\bAB-\d{4}\b", r"a\.\*b", "[.*|]x", "(?:ab|cd)e", r"\(x\)"])
def test_patterns_without_risk(pattern):
    assert L.risks(pattern) == []


def test_validation_levels():
    good = bank(p={"a": [literal("Ann"), regex(r"\bA-\d{3}\b")]})
    assert L.validate(good, "deep")["valid"] and L.validate(good)["bank_hash"].startswith("sha256:")
    assert not L.validate(bank(p={"a": [regex("a*")]}))["valid"] and L.validate(bank(p={"a": [regex("a*")]}), "basic")["valid"]
    assert not L.validate(bank(p={"a": [regex(r"(x)\1")]}))["valid"]
    risky = bank(p={"a": [regex("ab.*cd")]})
    assert L.validate(risky)["valid"] and not L.validate(risky, strict=True)["valid"]
    changed = bank(p={"a": [regex("éx")]})
    changed["unicode_normalization"] = "NFC"
    assert any(d["code"] == "regex.normalized_changed" for d in L.validate(changed)["diagnostics"])
    with pytest.raises(BankError):
        L.validate(good, "none")


def test_detectors_by_hand():
    assert [r["string"] for r in L.test_detector("a.", "ab ac")] == ["ab", "ac"]
    codes = [(d["path"], d["code"]) for d in L.doctor([{"entity": "e", "name": "a", "regex": "a*"}, {"entity": "e", "name": "b", "regex": "("}, {"entity": "e", "name": "c", "regex": "x.*y"}])]
    assert {("/e/a", "regex.matches_empty"), ("/e/b", "regex.compile_error"), ("/e/c", "regex.expensive_static")} <= set(codes)


def test_generated_cases_hold():
    b = bank(p={"ann": [literal("Ann Bo")]}, q={"x": [regex(r"X-\d+")]})
    with pytest.raises(BankError):
        L.conformance_cases(b)
    positives, negatives = L.conformance_cases(b, {("q", "x", "p0"): "X-12"})
    found = S.detectors(b)
    for case in positives:
        want = case["matches"][0]
        assert any((r["string"], r["start"], r["end"], r["name_id"]) == (want["string"], want["start"], want["end"], want["name_id"]) for r in S.scan_text(case["text"], found)), case
    assert {c["tag"] for c in positives} == {"exact", "casing", "context", "whitespace"} and all(S.scan_text(c["text"], found) == [] for c in negatives)


@pytest.mark.parametrize("text,mode,form", [("éx", "NFC", "éx"), ("ﬁx", "NFKC", "fix"), ("aé", "none", "aé"), ("", "NFC", "")])
def test_normal_forms_know_their_origins(text, mode, form):
    n = normalised(text, mode)
    assert n.form == form and n.span(0, len(form)) == (0, len(text)) and len(n.origins) == len(form)
    assert normalised("ßA", "none", casefold=True).form == "ssa" and normalised("ßA", "none", casefold=True).span(1, 2) == (0, 1)
    with pytest.raises(ValueError):
        n.span(0, len(form) + 1)


def test_batches_and_envelopes(tmp_path):
    (tmp_path / "a.txt").write_text("Ann")
    b = bank(p={"ann": [literal("Ann")]})
    out = D.extract(b, [{"text": "no"}, {"document_id": "two", "file_path": str(tmp_path / "a.txt")}, {"id": "three", "text": "Ann Ann"}])
    assert [(r["document_id"], r["start"]) for r in out["records"]] == [("two", 0), ("three", 0), ("three", 4)]
    assert out["summary"] == {"documents": 3, "records": 3, "documents_with_records": 2}
    for bad in ([{"text": "a", "file_path": "b"}], [{}], [{"id": "Bad!", "text": ""}], [{"id": "a", "text": ""}] * 2, [{"text": ""}] * 101, [{"file_path": str(tmp_path)}]):
        with pytest.raises(BankError):
            D.extract(b, bad)
    with pytest.raises(BankError):
        D.extract({**b, "status": "draft"}, [{"text": "Ann"}])


def test_ids_labels_and_privacy(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("a",), ("B",), (None,)], "document_id string")
    assert {r.document_id for r in D.bad_ids(df, "document_id").collect()} == {"a", "B", None}
    with pytest.raises(BankError):
        D.without_labels(df.withColumn("Label", F.lit(1)))
    safe = spark.createDataFrame([("entity", 3)], "name string, n long")
    assert D.export_evidence({"counts": safe}, str(tmp_path / "e")) == ["counts"] and spark.read.json(str(tmp_path / "e/counts")).count() == 1
    for value in ("a@b.example", "+1 312 555 0199", "123-45-6789", "see /home/ann/mail"):
        with pytest.raises(BankError):
            D.export_evidence({"x": safe.withColumn("v", F.lit(value))}, str(tmp_path / "f"))


def test_anonymising_one_text_and_back():
    text = "Ánn met Bob and Ánn."
    records = [r for r in S.scan_text(text, S.detectors(bank(p={"ann": [literal("Ánn")], "bob": [literal("Bob")]})))]
    store = R.new_store()
    hidden, store, edits = R.anonymise_text(text, records, store)
    assert hidden == "[P_0001] met [P_0002] and [P_0001]." and len(edits) == 3 and R.check_store(store) == []
    assert R.restore_one(hidden, store) == text
    again, same, _ = R.anonymise_text(text, records, store)
    assert again == hidden and same["assignments"] == store["assignments"]
    pool = R.with_set(R.new_store({"replacement_mode": "pseudonym", "replacement_set_id": "s"}), "s", ["Xenia", "Yuri"])
    other, used, _ = R.anonymise_text(text, records, pool)
    assert other == "Xenia met Yuri and Xenia." and R.restore_one(other, used, pseudonyms_too=True) == text and R.restore_one(other, used) == other
    assert R.restore_one("Xeniana", used, pseudonyms_too=True) == "Xeniana"
    with pytest.raises(BankError):
        R.anonymise_text(text, records, R.with_set(R.new_store({"replacement_mode": "pseudonym", "replacement_set_id": "s"}), "s", ["Xenia"]))
    assert R.anonymise_text(text, records, R.with_set(R.new_store({"replacement_mode": "pseudonym", "replacement_set_id": "s"}), "s", ["Xenia"]), "skip")[0] == "Xenia met Bob and Xenia."
    assert "original" not in str(R.public_view(store)["assignments"])
    with pytest.raises(BankError):
        R.anonymise_text("Bob", records, R.new_store())


def test_sender_aliases(spark):
    rows = [(1, "ann.bo@x.example", "text\nregards\nAnn  Bo"), (2, "Ann <ann.bo@x.example>", "Ann Bo"), (3, "ann.bo@x.example", "> Ann Bo"), (4, "desk@x.example", "desk"), (5, None, None), (6, "ann.bo@x.example", "Ann Bo\n" + "x\n" * 20)]
    df = spark.createDataFrame(rows, "row_id long, from string, body string")
    assert [(r.row_id, r.alias) for r in M.sender_aliases(df).collect() if r.row_id != 3] == [(1, "Ann  Bo")]


@pytest.mark.parametrize("pattern,short", [("ab", True), ("a+", True), (r"\bab", False), ("^ab", False), ("ab$", False), (" ab ", True), ("abcd", False)])
def test_short_patterns_without_a_boundary_are_a_risk_both_ways(spark, pattern, short):
    from pyspark.sql import functions as F

    from bankspark.operators import bank as B

    assert ("short_unbounded" in L.risks(pattern)) is short
    row = spark.createDataFrame([(pattern,)], "v string").select(*[c.alias(k) for k, c in B.lint_columns(F.col("v")).items()]).first().asDict()
    assert {k for k, v in row.items() if v} == set(L.risks(pattern)) - {"ambiguous_alternation"}
