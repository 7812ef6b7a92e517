import json
import zipfile

import pytest
from pyspark.sql import functions as F

from bankspark import streaming
from bankspark.functions import stats, text as T
from bankspark.model import BankError
from bankspark.operators import corpus as C
from bankspark.operators import mine as M
from bankspark.operators import quality as Q
from bankspark.operators import rewrite as R
from bankspark.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# --- text ------------------------------------------------------------------------------------------------------------------


def test_layout(spark):
    raw = "  a\t b \r\n\r\n\r\n\r\nc\u2028d\u200b\n\n"
    assert one(spark, T.natural(F.lit(raw))) == "a b\n\nc\nd"
    assert T.visible_body(raw) == "a b\n\nc\nd" and T.visible_body(None) is None


@pytest.mark.parametrize("n,label", [(0, "0"), (1, "1-255"), (255, "1-255"), (256, "256-1023"), (1_048_575, "262144-1048575"), (1_048_576, "1048576+")])
def test_size_buckets(spark, n, label):
    assert one(spark, T.size_bucket(F.lit(n))) == label


def test_hashes(spark):
    import hashlib

    digest = hashlib.sha256(b"x").hexdigest()
    assert one(spark, T.hash_mod(F.lit(digest), 97)) == int(digest, 16) % 97
    assert int(one(spark, T.hash64(F.lit(digest)))) == int(digest[:16], 16)
    assert one(spark, T.hash_fraction(F.lit(digest))) == pytest.approx(int(digest, 16) / 2**256, abs=1e-12)
    assert one(spark, T.domain_hash("d", F.lit("v"))) == hashlib.sha256(b"d\0v").hexdigest()


@pytest.mark.parametrize("raw,want", [("person", "person"), ("My Entity!", "my_entity_"), ("9lives", "entity_9lives_"), ("", "entity_"), ("é", "entity_")])
def test_slugs(spark, raw, want):
    out = one(spark, T.entity_slug(F.lit(raw)))
    assert out.startswith(want) and len(out) <= 80 and (out == want or len(out) == len(want) + 12)


def test_tokens_of_a_template(spark):
    assert one(spark, T.redaction_token("{ENTITY}-{entity}-{ordinal}-{ordinal:04d}", F.lit("ab"), F.lit(7))) == "AB-ab-7-0007"
    assert one(spark, T.redaction_token("{ordinal:02d}", F.lit("ab"), F.lit(1234))) == "1234"


def test_message_ids_addresses_and_folders(spark):
    assert one(spark, T.message_id(F.lit(" <A.B@X> "))) == "a.b@x" and one(spark, T.message_id(F.lit(" <> "))) is None
    assert one(spark, T.message_id_references(F.lit("References: <a@x>\n <B@x>\nother <c@x>\nIn-Reply-To: <a@x>"))) == ["a@x", "b@x"]
    assert one(spark, T.addresses(F.array(F.lit("Ann <A@x.example>"), F.lit(None)), F.lit(None).cast("array<string>"), F.array(F.lit("a@x.example;b@y.example")))) == ["a@x.example", "b@y.example"]
    assert one(spark, T.mailbox_folder(F.lit("maildir\\ann\\inbox\\1."))) == "inbox" and one(spark, T.mailbox_folder(F.lit("x"))) is None


def test_plain_functions():
    assert T.grouping_text("  Ｃａｆé\u200b STRASSE ß ") == "café strasse ss" and T.grouping_text(None) is None
    assert T.thread_subject("RE: Fwd: [x] Hello") == "[x] hello"
    assert T.header_text("=?utf-8?q?caf=C3=A9?=") == "café" and T.header_text("=?no?x?y?=") == "=?no?x?y?="
    assert T.html_text("<html><script>x()</script><p>a<br>b</p><img alt='pic'></html>").split() == ["a", "b", "pic"]
    mime = "Content-Type: multipart/alternative; boundary=q\nMIME-Version: 1.0\n\n--q\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\nY2Fmw6k=\n--q\nContent-Type: text/html\n\n<p>no</p>\n--q--\n"
    assert T.mime_text(mime).strip() == "café" and T.mime_text("plain: text") == "plain: text"
    assert T.quoted_printable("a=3Db=20c=E9d") != "a=3Db=20c=E9d" and T.quoted_printable("a=b") == "a=b"
    assert T.person_name("Marler, Ines") == "Ines Marler" and T.person_name("Help Desk") is None and T.person_name("Ines") is None
    assert T.truncated("aé日", 3, 3) == "aé" and T.truncated(None, 1, 1) is None


# --- corpus ----------------------------------------------------------------------------------------------------------------


def test_near_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5))) for b in base] + base[:5]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "node long, simhash long")
    got = {(r.a, r.b): r.distance for r in C.near_pairs(df).collect()}
    mask = (1 << 64) - 1
    want = {(a, b): ((a & mask) ^ (b & mask)).bit_count() for a in set(signed) for b in set(signed) if a < b and ((a & mask) ^ (b & mask)).bit_count() <= 3}
    assert got == want


def test_near_features_and_classes(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (2, text.upper()), (3, "short one"), (4, None), (5, "")]
    nodes = {r.node: r for r in C.near_features(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert nodes[1].simhash == nodes[2].simhash and nodes[1].tokens == 40 and nodes[1].shingles == 38
    assert nodes[3].shingles == 1 and nodes[4].simhash is None and nodes[5].tokens == 0
    classes = {r.node: r for r in C.near_classes(C.near_features(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")).collect()}
    assert set(classes) == {1, 2} and classes[1]["class"] == classes[2]["class"] and classes[1].links == 0


def test_leakage_groups_join_all_families(spark):
    mail = [
        (1, "<a@x>", "one", "p@x.example", None, "same text"), (2, "<b@x>", "two", "q@x.example", None, "same text"), (3, "<c@x>", "RE: thread", "r@x.example", None, "x"), (4, "<d@x>", "thread", "s@x.example", ["R@x.example"], "y"),
        (5, "<e@x>", None, None, None, "References: <f@x>"), (6, " F@X ", None, None, None, "z"), (7, None, None, None, None, None),
    ]
    df = spark.createDataFrame(mail, "row_id long, message_id string, subject string, from string, to array<string>, body string").withColumns({"cc": F.lit(None).cast("array<string>"), "bcc": F.lit(None).cast("array<string>")})
    feats = C.features(df)
    groups = {r.node: r.group for r in C.leakage_groups(feats, df.select(F.col("row_id").alias("node"))).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    fam = {r.group: r.families for r in C.edge_families(C.star_edges(feats), C.leakage_groups(feats, df.select(F.col("row_id").alias("node")))).collect()}
    assert fam == {1: "exact_plaintext", 3: "thread_shared_participant", 5: "message_id_reference"}


def test_temporal_split_cuts_closest(spark):
    import random

    rng = random.Random(2)
    for n in (1, 2, 3, 10, 60):
        sizes = [rng.randint(1, 9) for _ in range(n)]
        df = spark.createDataFrame([(i, s, f"2001-01-{1 + i // 3:02d} 0{i % 3}:00:00") for i, s in enumerate(sizes)], "group long, records long, t string").select("group", "records", F.to_timestamp("t").alias("anchor"))
        roles = [r.role for r in sorted(C.temporal_split(df).collect())]
        assert sorted(roles, key=C.ROLES.index) == roles
        if n >= 3:
            cum = [sum(sizes[: i + 1]) for i in range(n)]
            a = min(range(n - 2), key=lambda i: (abs(cum[i] - cum[-1] * 0.8), i))
            b = min(range(a + 1, n - 1), key=lambda i: (abs(cum[i] - cum[-1] * 0.9), i))
            assert roles == ["train"] * (a + 1) + ["validation"] * (b - a) + ["test"] * (n - 1 - b)
    undated = spark.createDataFrame([(i, 1, None) for i in range(50)], "group long, records long, anchor timestamp")
    assert C.temporal_split(undated).count() == 50


def test_recurrence_and_frequencies(spark):
    people = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "b")], "node long, identity string")
    assigned = spark.createDataFrame([(1, 1, "train"), (2, 2, "train"), (3, 3, "test"), (4, 4, "test"), (5, 5, "test")], "node long, group long, role string")
    out = {r.node: (r.recurrence, r.frequencies) for r in C.recurrence(C.identity_support(people, assigned), assigned).collect()}
    assert out == {1: ("all_known", "mid"), 2: ("all_known", "mid"), 3: ("mixed", "mid,novel"), 4: ("all_novel", "novel"), 5: ("unavailable", "")}
    assert C.leaks(assigned.select("group", "role")).count() == 0


def test_quotas_add_up(spark):
    df = spark.createDataFrame([("a", 50), ("b", 30), ("c", 19), ("d", 1)], "stratum string, population long")
    for size, base in ((10, 0), (10, 2), (100, 2), (7, 1), (500, 0)):
        rows = C.quotas(df, size, base).collect()
        assert sum(r.quota for r in rows) == min(size, 100) and all(min(base, r.population) <= r.quota <= r.population for r in rows)


def test_multiset_hash_ignores_order_but_not_counts(spark):
    digest = lambda rows: C.multiset_hash(spark.createDataFrame(rows, "v string, n long"), F.col("v"), F.col("n")).first()
    assert digest([("a", 1), ("b", 2)]) == digest([("b", 1), ("a", 1), ("b", 1)]) and digest([("a", 1)]) != digest([("a", 2)])
    assert digest([("a", 1)]).total == 1 and C.multiset_hash(spark.createDataFrame([], "v string, n long"), F.col("v"), F.col("n")).first().total == 0


def test_rejections(spark):
    rows = [(None, None, "<m>", "f"), (None, "s", "<m>", "f"), (" \n", "s", "<m>", "f"), ("b", "s", " <> ", "f"), ("b", "s", "<m>", ""), ("b", "s", "<m>", "f")]
    df = spark.createDataFrame(rows, "body string, subject string, message_id string, from string")
    assert {r.reason: r.rows for r in C.rejection_ledger(df).collect()} == {"empty_record": 1, "missing_body": 1, "blank_body": 1, "missing_message_id": 1, "missing_sender": 1}


# --- rewriting -------------------------------------------------------------------------------------------------------------


def test_redaction_and_restoring_are_inverse(spark):
    text = "Ann met Bob; ann left."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = [(1, "p", "ann", "p0", "Ann", 0, 3), (1, "p", "bob", "p0", "Bob", 8, 11), (1, "p", "ann", "p0", "ann", 13, 16), (1, "q", "an", "p0", "An", 0, 2)]
    spans = R.without_overlap(spark.createDataFrame(rows, "doc_id long, entity_id string, name_id string, pattern_id string, string string, start long, end long"), "doc_id")
    assert spans.count() == 3
    for scope, tokens in (("name", ["[P_0001]", "[P_0002]"]), ("surface", ["[P_0001]", "[P_0002]", "[P_0003]"])):
        made = R.redaction_ordinals(spans, "doc_id", scope)
        assert sorted(r.token for r in made.collect()) == tokens
    keyed = spans.withColumn("assignment_key", R.assignment_key("surface"))
    edits = keyed.join(made, ["assignment_key", "entity_id"]).select("doc_id", "start", "end", F.col("token").alias("replacement"))
    hidden = R.apply_edits(docs, edits, "doc_id", "text")
    assert {r.doc_id: r.text for r in hidden.collect()} == {1: "[P_0001] met [P_0002]; [P_0003] left.", 2: None, 3: ""}
    known = keyed.select("assignment_key", F.col("string").alias("original")).join(made, "assignment_key")
    assert {r.doc_id: r.text for r in R.restore(hidden, known, "doc_id", "text").collect()} == {1: text, 2: None, 3: ""}
    new = {(r.start, r.new_start, r.new_end) for r in R.shifted_spans(edits, "doc_id").collect()}
    assert new == {(0, 0, 8), (8, 13, 21), (13, 23, 31)}
    old = spark.createDataFrame([("other", "p", 7)], "assignment_key string, entity_id string, ordinal long")
    assert sorted(r.ordinal for r in R.redaction_ordinals(spans, "doc_id", "name", old).collect()) == [7, 8, 9]


def test_pseudonyms_run_out_and_reuse_probes():
    candidates = [{"id": "a", "value": "X"}, {"id": "b", "value": "Y"}]
    made = R.allocate_with_reuse(["k1", "k2", "k3"], candidates)
    assert sorted(v for v in made.values() if v) == ["a", "b"] and list(made.values()).count(None) == 1
    assert R.allocate_with_reuse(["k1"], candidates, {"X": "k1"})["k1"] in ("a", "b") and R.allocate_with_reuse(["k"], [])["k"] is None


def test_store_has_versions_and_refuses_stale_writers(tmp_path):
    path = str(tmp_path / "store.json")
    first = R.save_store(R.with_set(R.new_store(), "s", ["X"]), path, None)
    assert first["version"] == 1 and R.policy_of(first, "p")["replacement_mode"] == "redact"
    R.save_store(first, path, R.store_hash(first))
    with pytest.raises(BankError):
        R.save_store(first, path, R.store_hash(first))
    assert R.load_store(path)["version"] == 2
    bad = {**first, "assignments": {"p|name|1": {"entity_id": "p", "redaction": {"ordinal": 1}}, "p|name|2": {"entity_id": "p", "redaction": {"ordinal": 1}}, "x": {"entity_id": "p"}}}
    assert len(R.check_store(bad)) == 2


# --- quality, mining, statistics ---------------------------------------------------------------------------------------------


def test_conformance_reserves_exact_matches_first(spark):
    kind = "document long, start long, end long, entity_id string, name_id string, pattern_id string"
    expected = spark.createDataFrame([(1, 0, 3, "e", "a", "p"), (1, 0, 3, "e", "b", "p"), (1, 5, 8, "e", "c", "p")], kind)
    actual = spark.createDataFrame([(1, 0, 3, "e", "b", "p"), (1, 0, 3, "e", "z", "p")], kind)
    out = {(r.name_id, r.status) for r in Q.conformance(expected, actual).collect()}
    assert out == {("b", "correct"), ("a", "wrong_canonical"), ("c", "missed")}


def test_union_length_merges_touching_spans(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 4, 6), (1, 1, 2), (1, 9, 10), (2, 3, 3)], "d long, start long, end long")
    assert {r.d: (r.islands, r.covered) for r in Q.union_length(df, ["d"]).collect()} == {1: (2, 7), 2: (1, 0)}


def test_metrics_are_null_without_support(spark):
    df = spark.createDataFrame([("a", 1, 0, 1), ("b", 0, 0, 0)], "s string, tp int, fp int, fn int")
    out = {r.s: r for r in Q.metrics(df, ["s"], F.col("tp"), F.col("fp"), F.col("fn")).collect()}
    assert out["a"].precision == 1.0 and out["a"].recall == 0.5 and out["b"].precision is None and out["b"].f1 is None


def test_symmetric_difference_and_samples(spark):
    a, b = spark.range(4).withColumnRenamed("id", "x"), spark.range(2, 6).withColumnRenamed("id", "x")
    assert {(r.x, r["pass"]) for r in Q.symmetric_difference(a, b, ["x"]).collect()} == {(0, "first"), (1, "first"), (4, "second"), (5, "second")}
    assert Q.share_of_hashes(spark.range(11), F.col("id").cast("string"), 0.2).count() == 3
    assert Q.lowest_hashes(spark.range(30).withColumn("g", F.col("id") % 2), ["g"], F.col("id").cast("string"), 4).count() == 8


def test_mining(spark):
    rows = [(i, f"m{i % 3}", f"Ines Marler <ines.marler@x.example>", ["Oskar Bendik <o@y.example>" if i < 2 else f"Oskar Bendik <o{i}@y.example>"]) for i in range(6)] + [(9, "m", None, [None, ""])]
    df = spark.createDataFrame(rows, "row_id long, mailbox string, from string, to array<string>").withColumns({"cc": F.lit(None).cast("array<string>"), "bcc": F.lit(None).cast("array<string>"), "loaded_at": F.lit("2001-01-01").cast("timestamp")})
    found = M.evidence(M.candidates(M.header_values(df)))
    curated = {(r.kind, r.candidate): (r.decision, r.reason) for r in M.curate(found).collect()}
    assert curated["contact", "ines.marler@x.example"] == ("active", "supported") and curated["display_name", "Oskar Bendik"] == ("rejected", "ambiguous_owner") and curated["contact", "o2@y.example"] == ("rejected", "few_documents")
    assert {r.decision for r in M.curate(found, 0, 1).where("reason = 'supported'").collect()} == {"draft"}
    assert M.funnel(M.curate(found)).where("level = 7").first().candidates == found.count()
    fit = lambda n, a: one(spark, M.compatible(F.lit(n), F.lit(a)))
    assert fit("Ines Marler", "imarler@x.example") and fit("Ines Marler", "ines@x.example") and not fit("Ines Marler", "desk@x.example")


def test_statistics(spark):
    row = stats.summary(spark.range(1, 101).withColumn("g", F.lit(1)), ["g"], "id").first()
    assert (row.n, row.median, row.p95, row.p99, row.mad) == (100, 50.5, 95, 99, 25.0)
    assert stats.summary(spark.range(5).withColumn("g", F.lit(1)), ["g"], "id").first().p95 is None
    p = stats.permutation_p(spark.createDataFrame([(i, 1.0) for i in range(10)], "block long, diff double")).first()
    assert p.mean_difference == 1.0 and p.p_value == pytest.approx(2 / 1024)
    assert stats.break_even(10, 1, 0, 2) == 10 and stats.break_even(0, 1, 1, 2) == 0 and stats.break_even(1, 2, 0, 1) is None


# --- files and streams -------------------------------------------------------------------------------------------------------


def test_detector_sources():
    config = {"B": {"x": "1", "_flags": "IGNORECASE"}, "A": {"z": "3", "y": "2"}}
    assert [(r["entity"], r["name"]) for r in files.detector_rows_from_map(config)] == [("A", "z"), ("A", "y"), ("B", "x")]
    assert len(files.detector_rows_from_jsonl('{"entity":"a","name":"n","regex":"x"}\n\n{"entity":"a","name":"m","regex":"y","priority":3}')) == 2
    for bad in ("{}", '{"entity":"a","name":"n","regex":"x","more":1}', "[]"):
        with pytest.raises(BankError):
            files.detector_rows_from_jsonl(bad)
    assert [files.sniff(x) for x in ('{"schema_version": 1}', '{"schema_version":1}', '{"A":{"x":"y"}}', '{"entity":"a","name":"n","regex":"x"}', '{"a":1}\n{"b":2}', "A:\n  x: y")] == ["bank", "canonical", "map", "jsonl", "jsonl", "yaml"]


def test_config_files(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    files.save_config({"A": {"x": "y"}}, str(path))
    assert files.parse_config(path.read_text()) == {"A": {"x": "y"}} and files.parse_config("A:\n  x: y") == {"A": {"x": "y"}}
    monkeypatch.setenv("BANKSPARK_CONFIG", str(path))
    assert files.config_path() == path and str(files.config_path("z")) == "z"


def test_corpus_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("é".encode())
    (tmp_path / "t" / "b.txt").write_bytes(b"\xff\xfe")
    got = {r.document_id: (r.text, r.error) for r in files.read_texts(spark, str(tmp_path / "t")).collect()}
    assert got == {"a.txt": ("é", None), "b.txt": (None, "not_utf8")}
    (tmp_path / "m.jsonl").write_text(json.dumps({"subject": "s", "to": ["a"], "body": "b"}) + "\n\n{broken\n")
    rows = files.read_mail(spark, str(tmp_path / "m.jsonl")).collect()
    assert sorted(str(r.error) for r in rows) == ["None", "blank_line", "malformed_json"] and {r.subject for r in rows} == {"s", None}
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps(x) for x in ({"type": "positive", "text": "a", "matches": [{"string": "a", "start": 0, "end": 1}]}, {"type": "positive", "text": "a"}, {"type": "negative", "text": "a"}, {"type": "x"}, {"type": "provenance"})))
    assert sorted(str(r.error) for r in files.read_evals(spark, str(tmp_path / "e.jsonl")).collect()) == ["None", "None", "positive_without_matches", "provenance_without_source", "unknown_type"]


def test_annotations(spark, tmp_path):
    assert files.parse_annotated("Hi <true_name>Ann B</true_name>, <b>x</b>") == ("Hi Ann B, <b>x</b>", [("true_name", 3, 8)])
    for bad in ("<true_name>a", "a</true_name>", "<true_name><true_name>a</true_name>", "<true_name></true_name>"):
        with pytest.raises(BankError):
            files.parse_annotated(bad)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "<true_name>Ann</true_name> left")
        z.writestr("y.txt", "<true_name>Ann")
        z.writestr("../z.txt", "no")
    rows = {r.document_id: r for r in files.read_annotated_archive(spark, str(tmp_path / "a.zip")).collect()}
    assert rows["x.txt"].text == "Ann left" and rows["x.txt"].spans[0].end == 3 and rows["y.txt"].error and rows["../z.txt"].error == "not_accepted"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id long, role string")
    files.write_roles(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/role=test")).count() == 1
    folder = f"file://{tmp_path}/v"
    assert files.current_version(spark, folder) == 0 and files.write_version(df, folder, 0) == 1 and files.write_version(df, folder, 1) == 2
    with pytest.raises(BankError):
        files.write_version(df, folder, 1)
    files.write_records(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("a", "2001-01-01 00:10:00"), ("a", "2001-01-01 00:20:00"), ("b", "2001-01-01 02:00:00"), ("a", "2001-01-01 02:00:00")], "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    counted = streaming.window_counts(streaming.read_parquet(spark, str(tmp_path / "e")), "ts", "1 hour", "1 hour", ["k"])
    rows = streaming.run_to_table(counted, "counted", "complete", str(tmp_path / "c1")).collect()
    assert sorted((r.k, r.window_start.hour, r.events) for r in rows) == [("a", 0, 2), ("a", 2, 1), ("b", 2, 1)]
    once = streaming.distinct_stream(streaming.read_parquet(spark, str(tmp_path / "e")), ["k"], "ts", "1 day")
    streaming.run_to_parquet(once, str(tmp_path / "o"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_share_of_hashes_is_exact_over_buckets_and_with_repeated_rows(spark, monkeypatch):
    import hashlib

    from bankspark.operators import quality as Q

    monkeypatch.setattr(Q, "LAST_BUCKET", 3)
    keys = [str(i % 700) for i in range(1000)]
    want = sorted(keys, key=lambda k: (hashlib.sha256(k.encode()).hexdigest(), k))
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for share in (0.0, 0.2, 0.5001, 1.0):
        n = -(-int(1000 * share * 10**9) // 10**9)
        assert sorted(r.k for r in Q.share_of_hashes(df, F.col("k"), share).collect()) == sorted(want[:n])
    assert Q.share_of_hashes(df.limit(0), F.col("k"), 0.5).count() == 0
    assert "TakeOrdered" not in Q.share_of_hashes(df, F.col("k"), 0.2).where("k > ''")._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]


def test_ranks_by_ranges_are_those_of_one_sort(spark):
    from bankspark.runtime import ranked

    values = [(i * 7919 % 1009, f"v{i}") for i in range(1500)]
    out = ranked(spark.createDataFrame(values, "a long, b string").repartition(7), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(out, key=lambda r: r.n)] == sorted(values) and sorted(r.n for r in out) == list(range(1, 1501))
    assert ranked(spark.createDataFrame([], "a long, b string"), "a", "b").count() == 0


def test_similar_texts_equal_brute_force(spark):
    import random

    from bankspark.operators import corpus as C

    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 5, 40, 90)))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(rng.randint(0, 1)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += ["", "!!", None, texts[0], texts[0].upper(), "one", "one"]
    grams = lambda t: frozenset(tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4)))
    sets = {i: grams(t) for i, t in enumerate(texts) if t and t != "!!"}
    near = lambda a, b: len(a & b) * 10 >= len(a | b) * 8
    group = {i: i for i in sets}

    def root(i):
        return i if group[i] == i else root(group[i])

    for i in sets:
        for j in sets:
            if i < j and near(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    links = {i: len({s for s in sets.values() if s != sets[i] and near(s, sets[i])}) for i in sets}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("set", F.lit("clash"))
    out = {r.node: (r["class"], r.links) for r in C.similar_classes(C.shingle_sets(df, "id", "text")).collect()}
    assert out == {i: (root(i), links[i]) for i in sets} and max(links.values()) > 2
    assert C.similar_classes(C.shingle_sets(df.limit(0), "id", "text")).count() == 0


def test_similar_documents_move_less_than_four_times_their_file(spark, tmp_path):
    """Common phrases, near copies about the bound, copies: right classes, and shuffles and checkpoints within the disk they may take."""
    import random
    from collections import Counter
    from itertools import combinations
    from pathlib import Path

    import pyarrow as pa
    import pyarrow.parquet as pq

    from bankspark.plans.corpus_queries import similar_documents
    from bankspark.runtime import checkpoint_path

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 9))) for _ in range(5000)]
    common = [rng.choices(words, k=12) for _ in range(40)]
    texts = [sum((rng.choice(common) if rng.random() < 0.3 else rng.choices(words, k=12) for _ in range(rng.choice((1, 4, 12, 60)))), []) for _ in range(1500)]
    for t in [rng.choice(texts) for _ in range(400)]:
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 40))):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t)
    sets = [frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    of: dict = {}
    for s in first:
        for x in s:
            of.setdefault(x, []).append(s)
    both = Counter(p for same in of.values() for p in combinations(sorted(same, key=first.get), 2))
    near = [(a, b) for (a, b), n in both.items() if n * 10 >= (len(a) + len(b) - n) * 8]
    links, group = Counter(s for p in near for s in p), {s: s for s in first}

    def root(s):
        return s if group[s] is s else root(group[s])

    for a, b in near:
        a, b = sorted((root(a), root(b)), key=first.get)
        group[b] = a
    path = tmp_path / "documents.parquet"
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": [" ".join(t) for t in texts]}), path)
    sc = spark.sparkContext._jsc.sc()

    def written() -> int:
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).head().totalShuffleWrite() + sum(p.stat().st_size for p in Path(checkpoint_path(spark).removeprefix("file:")).rglob("part-*"))

    before = written()
    out = {r.doc_id: (r["class"], r.links) for r in similar_documents(spark, str(tmp_path)).collect()}
    assert out == {i: (first[root(s)], links[s]) for i, s in enumerate(sets)} and len(near) > 100
    assert 0 < written() - before < 4 * path.stat().st_size


@pytest.mark.parametrize(
    "body,current,core",
    [
        ("new\n> old\nmore", "new\nmore", "new\nmore"), ("a\n--\nsig", "a\n--\nsig", "a"), ("--\nsig", "--\nsig", "--\nsig"), ("a\n--", "a\n--", "a\n--"), ("a\nOn Monday, B wrote:\n> b\n\nc", "a\n\nc", "a\n\nc"),
        ("a\n-----Original Message-----\nb", "a", "a"), ("a\nBegin forwarded message:\nb", "a", "a"), ("a\n________\nFrom: x\nSent: y\n z\nTo: w\n\nb", "a", "a"), ("a\n--------\nFrom: x\nTo: w\nb", "a\n--------\nFrom: x\nTo: w\nb", "a\n--------\nFrom: x\nTo: w\nb"),
        ("a\nSent from my iPad.", "a\nSent from my iPad.", "a"), ("a\nThis e-mail is confidential, so\nb", "a\nThis e-mail is confidential, so\nb", "a"), ("a\nSent from my desk", "a\nSent from my desk", "a\nSent from my desk"), ("", "", ""), (None, None, None),
    ],
)
def test_current_and_core_part_of_a_body(spark, body, current, core):
    row = spark.createDataFrame([(body,)], "b string").select(T.current_body(F.col("b")).alias("c")).select("c", T.core_body(F.col("c")).alias("d")).first()
    assert (row.c, row.d) == (current, core)
