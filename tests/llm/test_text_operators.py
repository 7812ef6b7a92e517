import itertools
import random

import pytest
from pyspark.sql import functions as F

from bankspark.llm import leakage, mojibake, names, pii, replies, splits

ITEM = "the revised tariff was sent to the north yard before noon and the crew counted every pallet twice while rain fell on the quay all day long"
PART = " ".join(ITEM.split()[:20])


# --- leaks ---------------------------------------------------------------------------------------------------


def test_whole_part_and_damaged_items_are_found_and_short_quotes_are_not():
    words = ITEM.split()
    automaton = leakage.Automaton([(7, leakage.words_of(ITEM)), (8, leakage.words_of("something else that nobody wrote into any of these texts at all today"))])
    found = lambda t: [e for _, e, *_ in automaton.leaks([leakage.words_of(t)])]
    assert found("Before. " + ITEM.upper().replace(" ", "\n ") + "! After") == [7]
    assert found("x y z " + " ".join(words[5:20]) + " q r s") == [7]
    typos = [w if i % 6 else w[:-1] + "x" for i, w in enumerate(words)]
    assert found("intro " + " ".join(typos) + " outro") == [7]
    assert found(" ".join(words[:6]) + " and then nothing of the kind happened to anybody") == []
    assert found("") == []


def test_automaton_finds_all_longest_matches_like_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        items = [(i, [rng.choice("abc") for _ in range(rng.randint(3, 9))]) for i in range(3)]
        text = [rng.choice("abcd") for _ in range(30)]
        own = leakage.Automaton(items)
        inside = lambda w: any(item[i : i + len(w)] == w for _, item in items for i in range(len(item)))
        for end, n, state in own.seeds(text, 1):
            piece = text[end - n + 1 : end + 1]
            places = {(p >> 16, p & 0xFFFF) for p in own.places(state).tolist()}
            assert places == {(k, i + n - 1) for k, (_, item) in enumerate(items) for i in range(len(item) - n + 1) if item[i : i + n] == piece}
            assert end + 1 == len(text) or not inside(text[end - n + 1 : end + 2])


def test_each_item_has_its_own_matches_like_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        items = [(i, [rng.choice("abc") for _ in range(rng.randint(3, 14))]) for i in range(4)]
        text = [rng.choice("abcd") for _ in range(40)]
        own, want = leakage.Automaton(items), set()
        for k, (_, item) in enumerate(items):
            for i, j in itertools.product(range(len(item)), range(len(text))):
                n = 0
                while n <= min(i, j) and item[i - n] == text[j - n]:
                    n += 1
                if n >= leakage.SEED and (i + 1 == len(item) or j + 1 == len(text) or item[i + 1] != text[j + 1]):
                    want.add((j, n, k, i))
        got = [(end, n, k, i) for (_, k), runs in own.matches([text]).items() for end, i, n in runs]
        assert len(got) == len(set(got)) and set(got) == want


def test_matches_in_small_parts_are_the_same(monkeypatch):
    rng = random.Random(11)
    items = [(i, [rng.choice("ab") for _ in range(30)]) for i in range(5)]
    text = [rng.choice("ab") for _ in range(300)]
    whole = leakage.Automaton(items).matches([text, [], text[:50]])
    monkeypatch.setattr(leakage, "LAID_OUT", 7)
    own = leakage.Automaton(items)
    assert own.matches([text, [], text[:50]]) == whole and own.matches([[], ["c"]]) == {}
    assert {k: v for k, v in whole.items() if k[0] == 2} == {(2, k): v for (_, k), v in own.matches([text[:50]]).items()}


def test_variants_items_inside_items_and_very_long_items_are_found():
    rng = random.Random(9)
    a = [f"w{rng.randint(0, 999)}x" for _ in range(60)]
    b = [{20: "other", 40: "words"}.get(i, w) for i, w in enumerate(a)]
    long = [f"v{i}" for i in range(70_000)]
    automaton = leakage.Automaton([(1, a), (2, b), (3, a[10:40]), (4, long), (5, long[66_000:66_050])])
    assert {e for _, e, *_ in automaton.leaks([["before", *a, "after"]])} == {1, 2, 3}
    assert automaton.leaks([[], ["before", *long, "after"]]) == [(1, 4, 1.0, 1, 70_000), (1, 5, 1.0, 66_001, 66_050)]


def test_coverage_decides_alone_or_asks_for_an_alignment():
    assert leakage.held([(59, 59, 60)], 60) == (1.0, 0, 59)
    assert leakage.held([(19, 19, 20), (39, 39, 19)], 60) == (40 / 60, 0, 39)
    assert leakage.held([(19, 19, 20)], 60) is None and leakage.held([(9, 9, 10), (30, 30, 10)], 60) is None


@pytest.mark.parametrize("text", ["", "It's a-\nb, élan ﬁn ’x’ I\u0307 don’t", "naïve\u0301 Straße - \n x'y"])
def test_places_are_those_of_the_words(text):
    places = leakage.places_of(text)
    assert ["".join(leakage.words_of(text[a:b])) for a, b in places] == leakage.words_of(text)


def test_leaks_in_blocks_with_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 10)
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(9, ITEM), (10, ITEM), (11, None), (12, "!!")], "eval_id long, text string")
    rows = leakage.find_leaks(docs, "doc_id", "text", items, "eval_id", "text").collect()
    assert {(r.doc_id, r.eval_id) for r in rows} == {(1, 9), (1, 10)} and len(rows) == 2
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 200_000)
    docs = spark.createDataFrame([(1, f"Before. {ITEM}! Between {PART} after"), (2, None), (3, ""), (4, "kept")], "doc_id long, text string").withColumn("share", F.lit(1)).withColumn("t", F.lit("clash"))
    found = leakage.spans(docs, "doc_id", "text", items.where("eval_id = 9"), "eval_id", "text").orderBy("start_char").collect()
    assert [(r.start_char, r.end_char) for r in found] == [(8, 8 + len(ITEM)), (18 + len(ITEM), 18 + len(ITEM) + len(PART))]
    out = {r.doc_id: (r.text, r.removed) for r in leakage.clean(docs, "doc_id", "text", items, "eval_id", "text").collect()}
    assert out == {1: ("Before. ! Between  after", len(ITEM) + len(PART)), 2: (None, 0), 3: ("", 0), 4: ("kept", 0)}
    assert leakage.find_leaks(docs, "doc_id", "text", items.limit(0), "eval_id", "text").count() == 0


# --- encodings -----------------------------------------------------------------------------------------------

CLEAN = ["Près du pré, l’équipe a compté 50 fûts – même à l’été", "A posição própria não saiu; são 5 caixas até amanhã", "Für die Prüfung fehlen 10 Stück, spätestens übermorgen", "Mañana llegará la compañía; ¿podría enviar la señal?"]


def damage(text, true, read):
    return "".join((c.encode(true).decode(read) if c > "\x7f" else c) for c in text)


@pytest.mark.parametrize("true,read", [("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251")])
def test_every_chain_can_be_undone(true, read):
    for text in CLEAN:
        broken = damage(text, true, read)
        chain = next(i for i, c in enumerate(mojibake.CHAINS) if c == (true, read, 1))
        assert "".join(mojibake.undo(x, chain) if x[0] > "\x7f" else x for x in ("".join(g) for _, g in itertools.groupby(broken, lambda c: c > "\x7f"))) == text


def test_affected_fields_are_found_and_restored(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(400):
        text = " ".join(rng.choice(CLEAN) for _ in range(2))
        broken = damage(text, *rng.choice([("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("cp1252", "mac_roman")])) if i % 10 == 0 else text
        rows.append((i, "box", "subject" if i % 2 else None, broken))
        if broken != text:
            want[i] = text
    rows += [(1000, None, None, None), (1001, "box", "", ""), (1002, "box", "caf�", "plain"), (1003, "other", "=?utf-8?q?caf=C3=A9?=", "plain")]
    df = spark.createDataFrame(rows, "row_id long, mailbox string, subject string, body string").withColumn("text", F.lit("clash"))
    out = mojibake.find_and_repair(df, "row_id", "mailbox", ["subject", "body"]).collect()
    found = {(r.row_id, r.field): r for r in out}
    assert {k[0] for k in found if k[1] == "body"} == set(want)
    assert sum(found[k, "body"].original == t for k, t in want.items()) >= 0.95 * len(want)
    assert (1002, "subject") in found and not found[1002, "subject"].complete and (1003, "subject") not in found


def test_a_very_long_damaged_run_is_found_and_restored(spark):
    rng = random.Random(3)
    sound = "".join(rng.choice("港务局今日通知各位船员请于明早八点前到码头集合检查货物，。、") for _ in range(20_000))
    rows = [(i, "box", None, rng.choice(CLEAN)) for i in range(60)] + [(100 + i, "box", None, damage(sound[: 20_000 - i], "utf-8", read)) for i, read in enumerate(("mac_roman", "mac_roman", "latin-1"))]
    df = spark.createDataFrame(rows, "row_id long, mailbox string, subject string, body string")
    out = {r.row_id: r.original for r in mojibake.find_and_repair(df, "row_id", "mailbox", ["subject", "body"]).collect()}
    assert set(out) == {100, 101, 102} and all(out[100 + i] == sound[: 20_000 - i] for i in range(3))


def test_empty_table_has_no_affected_fields(spark):
    df = spark.createDataFrame([], "row_id long, mailbox string, subject string, body string")
    assert mojibake.find_and_repair(df, "row_id", "mailbox", ["subject", "body"]).count() == 0


# --- names -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "value,spelling",
    [
        ('"Marler, Ines" <i.marler@a.example>', "Marler, Ines"), ("i.marler@a.example (Ines Marler)", "Ines Marler"), ("Ines Marler [mailto:i.marler@a.example]", "Ines Marler"),
        ("'INES MARLER'", "INES MARLER"), ("<i.marler@a.example>", None), ("i.marler@a.example", None), ("", None), ("  ", None), (None, None), ("Dr. Ines Marler/Ops", "Dr. Ines Marler/Ops"),
    ],
)
def test_spelling_of_a_value(spark, value, spelling):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(names.spelling_of(F.col("v")).alias("s")).first().s == spelling


@pytest.mark.parametrize("per_pivot", [16, 1])
def test_radius_join_equals_brute_force(spark, monkeypatch, per_pivot):
    monkeypatch.setattr(names, "PER_PIVOT", per_pivot)  # one pivot, and many
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(220)})
    got = [(r.x, r.y) for r in names.radius_join(spark.createDataFrame([(w,) for w in words], "name string")).collect()]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, above = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
        return row[-1]

    want = {(v, w) for v, w in itertools.combinations(words, 2) if distance(v, w) <= names.RADIUS}
    assert len(got) == len(set(got)) and set(got) == want
    assert names.radius_join(spark.createDataFrame([], "name string")).count() == 0


def test_errors_in_both_names_are_linked_and_three_words_are_a_person(spark):
    groups = [["Johannes Petterson", "Johanes Peterson"], ["Svetlana Kowalczyk", "Kowalczik, Svetlena"], ["Mary Ann Smithson", "SMITHSON, MARY ANN", "Dr. Mary Ann Smithson"], ["Jan van der Berg"], ["Brakel Rail Services"]]
    df = spark.createDataFrame([(s, None) for g in groups for s in g], "from string, to array<string>")
    linked = {r.spelling: r.entity for r in names.link(df, "from", "to").collect()}
    assert all(len({linked[s] for s in g}) == 1 for g in groups) and len(set(linked.values())) == len(groups)
    assert names.parts_of("Mary Ann Smithson")[0] == names.parts_of("Jan van der Berg")[0] == "person" and names.parts_of("Brakel Rail Svcs")[0] == "firm"


def test_variants_are_linked_and_others_apart(spark):
    groups = [
        ["Ines Marlerow", "Marlerow, Ines", "INES MARLEROW", "InesMarlerow", "I. Marlerow", "Inés Marlerow", "Ines Malrerow", "Ines Q. Marlerow", "Dr. Ines Marlerow"],
        ["Oskar Marlerow", "O. Marlerow"], ["Charlotte Bendik", "Lottie Bendik", "Charlotte Bendick"], ["Halden Grid Services", "HALDEN GRID SVCS", "Halden Grid Services, Inc.", "Grid Services Halden", "Halden Gird Services"], ["Vero Freight Company", "Vero Freight Co."],
    ]
    rows = [(f"{s} <{chr(97 + i)}x{i}.marler@h.example>" if s[0] == "I" and i == 0 else s, None) for i, g in enumerate(groups) for s in g]
    rows += [("Oskar Marlerow <oskar.marlerow@h.example>", ["Charlotte Bendik <bendik_charlotte@h.example>"]), (None, [None, ""]), ("a@b.example", [])]
    df = spark.createDataFrame(rows, "from string, to array<string>").withColumn("spelling", F.lit(1))
    linked = {r.spelling: r.entity for r in names.link(df, "from", "to").collect()}
    for g in groups:
        assert len({linked[s] for s in g}) == 1, g
    assert len(set(linked.values())) == len(groups)
    pairs = {(r.name_a, r.name_b) for r in names.pairs(df, "from", "to").collect()}
    assert len(pairs) == sum(len(g) * (len(g) - 1) // 2 for g in groups) and all(a < b for a, b in pairs)


def test_no_names_no_pairs(spark):
    assert names.pairs(spark.createDataFrame([], "from string, to array<string>"), "from", "to").count() == 0


# --- personal values --------------------------------------------------------------------------------------------


def test_held_out_lines():
    field, hit, extra, missed = pii.fitted(), 0, 0, 0
    for line, gold in pii.training_lines(600, seed=99):
        got, want = set(field.best(line)), set(gold)
        hit, extra, missed = hit + len(got & want), extra + len(got - want), missed + len(want - got)
    assert hit / (hit + extra) > 0.98 and hit / (hit + missed) > 0.98


@pytest.mark.parametrize(
    "line,values",
    [
        (" ".join(f"713-555-010{i}" for i in range(1, 6)), [("phone", f"713-555-010{i}") for i in range(1, 6)]),
        ("1 2 3 4 5 6 7 8 9 10 11 12 713-555-0155", [("phone", "713-555-0155")]),
        ("1 2 3 4 5 6 7 8 9 10 11 12 SSN 123-45-6789", [("id_number", "123-45-6789")]),
        (" ".join(f"713-555-010{i}" for i in range(1, 5)) + " 123-45-6789", [("phone", f"713-555-010{i}") for i in range(1, 5)] + [("id_number", "123-45-6789")]),
        ("+33 (0)1 23 45 67 89", [("phone", "+33 (0)1 23 45 67 89")]),
        ("00 33 1 23 45 67 89", [("phone", "00 33 1 23 45 67 89")]),
        ("1 2 3 4 5 6 7 8 9 10", []),
    ],
)
def test_numbers_of_many_groups_and_far_into_a_row(line, values):
    assert [(k, line[s:e]) for s, e, k in pii.fitted().best(line)] == values


@pytest.mark.parametrize("line,name", [("Zbigniew Kowalski wrote:", "Zbigniew Kowalski"), ("Dr. Ngozi Okafor called.", "Ngozi Okafor"), ("From: Svetlana Petrova <svetlana.petrova@x.example>", "Svetlana Petrova"), ("Jan van der Berg wrote:", "Jan van der Berg"), ("Mary Ann Smith said:", "Mary Ann Smith"), ("São Tomé is open", None), ("Halden Grid Services wrote:", None), ("RE: SITE VISIT, DRENZECK QUAY", None)])
def test_names_in_no_list_are_told_by_what_stands_around(line, name):
    assert [line[s:e] for s, e, k in pii.fitted().best(line) if k == "name"] == ([name] if name else [])


def test_held_out_frames_and_given_names():
    for m in range(4):  # frames that the field was not fitted on; half of their names have given names in no list
        field, hit, extra, missed = pii.Field(pii.defaultdict(float)), 0, 0, 0
        pii._fit(field, pii.training_lines(pii.TRAIN_LINES, part=(m, 4), own=False), pii.EPOCHS, False)
        for line, gold in pii.training_lines(1500, seed=7, part=(m, 4)):
            got, want = set(field.best(line)), set(gold)
            hit, extra, missed = hit + len(got & want), extra + len(got - want), missed + len(want - got)
        assert hit / (hit + missed) >= 0.95 and hit / (hit + extra) >= 0.92


def test_expectations_are_probabilities_and_equal_enumeration():
    import math

    found = [(0, 4, "x", ("a",)), (2, 6, "x", ("b",)), (4, 9, "y", ("c",)), (0, 9, "x", ("a", "c")), (11, 14, "x", ("b",)), (6, 9, "y", ("a",))]
    line = "abcdefghi, klm"
    field = pii.Field({"a": 0.7, "b": -0.3, "c": 0.2, "x>y:": 0.9, "y>x:, ": -0.6})

    def chain(s):
        s = sorted(s)
        return all(a[1] <= b[0] for a, b in zip(s, s[1:])) and s

    def weigh(s):
        s = sorted(s)
        return math.exp(sum(field.score(c[3]) for c in s) + sum(field.w.get(pii.transition(line, a, b), 0.0) for a, b in zip(s, s[1:]) if b[0] - a[1] <= pii.BESIDE))

    sets = [s for n in range(7) for s in itertools.combinations(found, n) if not s or chain(s)]
    total = sum(map(weigh, sets))
    single, pairs = field.expectations(line, found)
    for c, p in zip(found, single):
        assert p == pytest.approx(sum(weigh(s) for s in sets if c in s) / total)
    for (j, i), p in pairs.items():
        assert p == pytest.approx(sum(weigh(s) for s in sets if found[j] in s and found[i] in s and not any(found[j][1] <= c[0] and c[1] <= found[i][0] for c in s)) / total)


def test_best_is_the_segmentation_of_highest_score(monkeypatch):
    rng = random.Random(6)
    for _ in range(50):
        spans = sorted({(s, s + rng.randint(1, 5), rng.choice("xy")) for s in (rng.randint(0, 14) for _ in range(7))})
        found = [(*span, (f"f{i}",)) for i, span in enumerate(spans)]
        field = pii.Field({f"f{i}": rng.uniform(-1, 2) for i in range(7)} | {f"{a}>{b}:": rng.uniform(-2, 2) for a in "xy" for b in "xy"})
        monkeypatch.setattr(pii, "candidates", lambda line: found)
        line = ""  # what is between is empty: each transition has one weight

        def score(s):
            s = sorted(s)
            return sum(field.score(c[3]) for c in s) + sum(field.w[f"{a[2]}>{b[2]}:"] for a, b in zip(s, s[1:]) if b[0] - a[1] <= pii.BESIDE)

        sets = [s for n in range(8) for s in itertools.combinations(found, n) if all(a[1] <= b[0] for a, b in zip(sorted(s), sorted(s)[1:]))]
        got = [c for c in found if c[:3] in field.best(line)]
        assert score(got) == pytest.approx(max(map(score, sets)))


def test_values_and_placeholders(spark):
    text = "Ask Ines Marlerow or write to ines at marler dot example.\nCall (312) 555-0119 if late. SSN 123-45-6789.\nBill to: 19-21 Sundial Place, Suite 3\nPO 9178-03-45678 covers lot 2001-0478. Hi Oskar,"
    df = spark.createDataFrame([(1, None, text), (2, "", None), (1, None, text)], "row_id long, subject string, body string").withColumn("kind", F.lit("x"))
    got = {(r.field, r.kind, r.value) for r in pii.find(df, "row_id", ["subject", "body"]).collect()}
    assert got == {("body", *v) for v in (("name", "Ines Marlerow"), ("email", "ines at marler dot example"), ("phone", "(312) 555-0119"), ("id_number", "123-45-6789"), ("street", "19-21 Sundial Place"))}
    out = {r.row_id: r for r in pii.redact(df, "row_id", ["subject", "body"]).collect()}
    assert "[NAME]" in out[1].body and out[1].body.endswith("PO 9178-03-45678 covers lot 2001-0478. Hi Oskar,") and out[2].body is None and out[2].subject == ""


# --- replies ---------------------------------------------------------------------------------------------------------

BODY = """Hello Ines,
The first line is new.

Kind regards,
Oskar
--
Oskar Marlerow
Port Agent, Halden Grid Services
T 312.555.0101

CONFIDENTIAL: the contents may be privileged.

On 2001-02-03 10:11, Ines Marlerow wrote:
> An old line
One reply between.
> more old lines"""


def test_layout_keeps_what_is_new():
    lines = BODY.split("\n")
    assert [lines[i] for i in replies.own_lines(lines)] == ["Hello Ines,", "The first line is new.", "Kind regards,", "Oskar", "CONFIDENTIAL: the contents may be privileged.", "One reply between."]
    forwarded = "See below.\n\n-----Original Message-----\nFrom: A B\nSent: today\nTo: C\nSubject: x\n\nold text"
    assert replies.own_lines(forwarded.split("\n")) == [0]
    assert replies.own_lines(["From: north yard, pallet 3 is late.", "To: dock nine, 4 crates"]) == [0, 1]


def test_unmarked_history_is_found_through_the_corpus(spark):
    old = ["The quarterly ledger was moved to the upper depot because the spare hangar had no roof left", "Please count every crate of the second barge before the auditors come back on Friday morning"]
    rows = [
        (1, "\n".join(old), "a@x.example", "m1", "2001-01-01 00:00:00"),
        (2, "I agree with all of it.\n" + "\n".join(old), "b@x.example", "m2", "2001-01-02 00:00:00"),
        (3, "\n".join(old), "a@x.example", "m1", "2001-01-03 00:00:00"),
        (4, None, None, None, None), (5, "", "c@x.example", "", None), (6, "  \r\n\r\nx\r", None, None, None),
    ]
    df = spark.createDataFrame(rows, "row_id long, body string, who string, mid string, at string").withColumn("line_no", F.lit(0))
    out = {(r.row_id, r.line_no) for r in replies.new_lines(df, "row_id", "body", F.col("who"), F.col("mid"), F.to_timestamp("at")).collect()}
    assert out == {(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (6, 3)}


def test_history_without_sender_or_id_and_behind_an_own_first_carrier(spark):
    old = ["The quarterly ledger was moved to the upper depot because the spare hangar had no roof left", "Please count every crate of the second barge before the auditors come back on Friday morning"]
    new = ["Nobody told the painters about the ladder", "Both cranes are shut until the wind drops", "We shall ask the mayor for a longer lease"]
    rows = [(1, "\n".join(old), "a@x.example", "", "2001-01-01 00:00:00")]
    rows += [(2, "\n".join([new[0], *old]), None, None, "2001-01-02 00:00:00"), (3, "\n".join([new[1], *old]), "b@x.example", "", "2001-01-03 00:00:00"), (4, "\n".join([new[2], *old]), "a@x.example", "m4", "2001-01-04 00:00:00")]
    df = spark.createDataFrame(rows, "row_id long, body string, who string, mid string, at string")
    out = {(r.row_id, r.line_no) for r in replies.new_lines(df, "row_id", "body", F.col("who"), F.col("mid"), F.to_timestamp("at")).collect()}
    assert out == {(1, 1), (1, 2), (2, 1), (3, 1), (4, 1)}


def test_closings_that_many_senders_share_go(spark):
    closing = "Our harbour club wishes you a pleasant week"
    rows = [(i, f"Line number {i} was written by hand today by me\n{closing}", f"s{i}@x.example", f"m{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, body string, who string, mid string")
    out = {(r.row_id, r.line_no) for r in replies.new_lines(df, "row_id", "body", F.col("who"), F.col("mid"), F.lit(None)).collect()}
    assert out == {(i, 1) for i in range(12)}


def test_recurrence_and_not_the_words_of_a_line_makes_it_a_closing(spark):
    new = ["This contract is privileged and I disclose the terms to you now", "We must delete this row and the one below it before printing the report"]
    notice, device = "This text is confidential and meant only for its addressee", "Von unterwegs gesendet"
    rows = [(i, f"Line number {i} was written by hand today by me\nThanks\n*****\n{notice}\n{device}", f"s{i}@x.example", f"m{i}") for i in range(12)]
    rows += [(100, "\n".join(new), "a@x.example", "m100"), (101, f"*****\nHello\n---\n{new[0]}", None, "")]
    df = spark.createDataFrame(rows, "row_id long, body string, who string, mid string")
    out = {(r.row_id, r.line_no) for r in replies.new_lines(df, "row_id", "body", F.col("who"), F.col("mid"), F.lit(None)).collect()}
    assert out == {(i, n) for i in range(12) for n in (1, 2)} | {(100, 1), (100, 2), (101, 1), (101, 2), (101, 3), (101, 4)}


def test_short_unmarked_history_is_found_and_one_equal_line_is_none(spark):
    old = ["The ledger was moved to the depot", "Count every crate of the barge"]
    rows = [(1, "\n".join(old), "a@x.example", "m1", "2001-01-01 00:00:00"), (2, "\n".join(["Agreed, go on with it", *old]), "b@x.example", "m2", "2001-01-02 00:00:00"), (3, "\n".join(["Not by me", old[0]]), "c@x.example", "m3", "2001-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "row_id long, body string, who string, mid string, at string")
    out = {(r.row_id, r.line_no) for r in replies.new_lines(df, "row_id", "body", F.col("who"), F.col("mid"), F.to_timestamp("at")).collect()}
    assert out == {(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)}


# --- splits ----------------------------------------------------------------------------------------------------------


def test_choose_is_as_close_as_any_subset():
    rng = random.Random(8)
    for _ in range(60):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 9))]
        many = {s: sizes.count(s) for s in sizes}
        taken = splits.choose(many, 0.3)
        goal = round(sum(sizes) * 0.3)
        best = min(abs(sum(c) - goal) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n))
        assert abs(sum(s * n for s, n in taken.items()) - goal) == best and all(n <= many[s] for s, n in taken.items())


def test_shares_are_met_exactly_beyond_the_bitsets_units(monkeypatch):
    many = {1: 500_000, 7: 90_000, 1000: 300, 250_001: 3}
    for shares in (0.1, 0.37):
        goal = round(sum(s * n for s, n in many.items()) * shares)
        taken = splits.choose(many, shares)
        assert sum(s * n for s, n in taken.items()) == goal and all(n <= many[s] for s, n in taken.items())
    monkeypatch.setattr(splits, "UNITS", 64)
    taken = splits.choose({5: 100, 50: 20}, 0.3)
    assert abs(sum(s * n for s, n in taken.items()) - 450) < 5


def test_groups_stay_whole_and_shares_are_met(spark):
    rng = random.Random(1)
    rows = [(i, g) for i, g in enumerate(g for g in range(300) for _ in range(1 + (g % 7 == 0) * rng.randint(1, 20)))]
    df = spark.createDataFrame(rows, "row_id long, group long")
    out = splits.assign(df, "row_id", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    by = {}
    for r in out:
        by.setdefault(r.split, set()).add(r.group)
    assert len(out) == len(rows) and not by["train"] & by["test"] and not by["train"] & by["validation"] and not by["validation"] & by["test"]
    assert abs(sum(r.split == "test" for r in out) - len(rows) * 0.1) <= 1 and abs(sum(r.split == "validation" for r in out) - len(rows) * 0.1) <= 1


@pytest.mark.parametrize("subject,key", [("RE: Fwd: [x] A  b", "[x]ab"), ("re[2]:Hello", "hello"), ("FW: RE: ", None), ("Regarding x", "regardingx"), (None, None), ("  ", None)])
def test_thread_keys(spark, subject, key):
    assert spark.createDataFrame([(subject,)], "s string").select(splits.thread_key(F.col("s")).alias("k")).first().k == key
