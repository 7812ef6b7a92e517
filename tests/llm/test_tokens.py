import random

import pytest
from hypothesis import given, settings, strategies as st

from bankspark.llm import bpe, pieces

own = bpe.transducer(bpe.default_path())


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_equals_an_independent_encoder_and_round_trips(text):
    tiktoken = pytest.importorskip("tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids = own.encode(text)
    assert ids == encoder.encode_ordinary(text)
    assert "".join(own.decode(ids)) == text


@pytest.mark.parametrize("alphabet", ["ab", "a", "aA -=\n", "éñ日本語🔧", "=-"])
def test_long_runs(reference, alphabet):
    rng = random.Random(3)
    for n in (1, 40, 700, 4000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert own.encode(text) == reference.encode_ordinary(text)


def test_special_strings_are_text_and_empty_is_empty(spark):
    rows = [(1, "<|endoftext|>"), (2, ""), (3, None), (3, None), (4, "a" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as k", "1 as ids")
    out = [(r.doc_id, r.ids) for r in bpe.encode(df, "doc_id", "text").collect()]
    assert len(out) == 5 and dict(out)[2] == [] and dict(out)[3] == [] and len(dict(out)[1]) > 1
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back[1] == "<|endoftext|>" and back[4] == "a" * 50_000


def test_caches_may_be_emptied_at_any_time(monkeypatch):
    fresh = bpe.Transducer(own.ranks)
    monkeypatch.setattr(bpe, "ARCS", 20)
    monkeypatch.setattr(bpe, "WORDS", 5)
    text = "The quick brown fox — 日本 jumps over 12345 lazy dogs. " * 5
    assert fresh.encode(text) == own.encode(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n日é", min_size=0, max_size=900), st.integers(20, 60))
def test_pieces_hold_their_limits_and_give_the_text_back(text, limit):
    overlap = limit // 8
    made = pieces.pieces_of(text, own, limit, overlap)
    assert "".join(text[a:b] for _, a, b, _, _ in made) == text
    assert all(n <= limit and n == len(own.encode(piece)) and piece == text[s:e] for s, _, e, n, piece in made)
    assert (len(made) > 1) == (len(own.encode(text)) > limit)
    for (_, a, _, _, _), (s, b, _, _, _) in zip(made, made[1:]):
        assert a <= s <= b and len(own.encode(text[s:b])) <= overlap + 2


def test_cuts_are_at_paragraphs_where_there_are_any(spark):
    text = "\n\n".join(["word " * 90 + "end."] * 8)
    df = spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string")
    rows = pieces.split_texts(df, "doc_id", "text").collect()
    long = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece_no)
    assert len(long) > 1 and all(text[: r.own_char].endswith("\n\n") for r in long[1:])
    assert all(r.start_char < r.own_char for r in long[1:])
    assert {(r.doc_id, r.n_pieces, r.piece) for r in rows if r.doc_id != 1} == {(2, 1, ""), (3, 1, "short")}


def test_pairs_fit_exactly_if_merging_keeps_them_apart():
    def merged(text):
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((own.ranks.get(parts[i] + parts[i + 1], bpe.NEVER), i) for i in range(len(parts) - 1))
            if rank == bpe.NEVER:
                break
            parts[at : at + 2] = [own.bytes_of[rank]]
        return [own.ranks[p] for p in parts]

    rng = random.Random(1)
    ids = list(own.bytes_of)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(4000)]
    for t in rng.sample(ids, 1500):  # the parts of a token never fit
        text = own.bytes_of[t]
        pairs += [(own.ranks[text[:k]], own.ranks[text[k:]]) for k in range(1, len(text)) if text[:k] in own.ranks and text[k:] in own.ranks]
    for a, b in pairs:
        assert own.fit(a, b) == (merged(own.bytes_of[a] + own.bytes_of[b]) == [a, b])


def test_sizes_of_pieces_are_those_of_their_own_encoding():
    rng = random.Random(1)
    parts = ["a", "bc", " ", "  ", "\n", "\n\n", "\t", "'s", "12", "é", "日本", "!", " ", "xyzzyq", "q" * 90]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(5, 80)))
        made = pieces.pieces_of(text, own, 12, 3)
        assert "".join(text[a:b] for _, a, b, _, _ in made) == text
        assert all(len(own.encode(p)) == n <= 12 for *_, n, p in made)
