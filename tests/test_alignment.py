"""Alignment helpers: invariants and examples."""

from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.operators import alignment as A

tokens = st.lists(st.sampled_from(["a", "b", "C", "d"]), max_size=12)


@settings(max_examples=200, deadline=None)
@given(tokens, tokens)
def test_anchors_are_a_common_subsequence(a, b):
    pairs = A.lcs_anchors(a, b)
    assert all(a[i].lower() == b[j].lower() for i, j in pairs)
    assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    assert len(A.apply_aligned(a, b)) == len(a if len(a) != len(b) else b)


def test_apply_aligned():
    assert A.apply_aligned("we met in tema".split(), "We met in Tema".split()) == "We met in Tema".split()
    assert A.apply_aligned("we mett in tema now".split(), "We met in Tema".split()) == "We met in Tema now".split()


def test_anchors_among_equals_are_the_latest():
    assert A.lcs_anchors(["a", "a"], ["a"]) == [(1, 0)]
    assert A.lcs_anchors(["a"], ["a", "A"]) == [(0, 1)]
    assert A.lcs_anchors("x a b y".split(), "a z b".split()) == [(1, 0), (2, 2)]


def test_apply_aligned_to_merged_words():
    """A word of several tokens is written at its first one only."""
    assert A.apply_aligned(["the", "Tema East", "memberr", "spoke"], "The Tema East member spoke".split()) == ["The", "Tema East", "member", "spoke"]
    assert A.apply_aligned(["so", "tema east", "spoke"], "so Tema East spoke now".split()) == ["so", "Tema", "spoke"]
    assert A.apply_aligned(["a", "b", "c"], "a x y c".split()) == ["a", "b", "c"]  # gaps of unequal size stay


def test_retime():
    words = [("one", 0.0, 1.0, "a"), ("two", 1.0, 2.0, "a"), ("three", 2.0, 4.0, "b"), ("four", 4.0, 5.0, "b")]
    assert A.retime("One two new things, four more", words) == [
        ("One", 0.0, 1.0, "a"), ("two", 1.0, 2.0, "a"), ("new", 2.0, 4.0, "b"), ("things,", 2.0, 4.0, "b"), ("four", 4.0, 5.0, "b"), ("more", 5.0, 5.0, "b")
    ]
    assert A.retime("x y z", [("p", 1.0, 2.0), ("q", 9.0, 10.0)]) == [("x", 1.0, 2.0), ("y", 1.0, 2.0), ("z", 9.0, 10.0)]
    assert A.retime("now one", words[:1]) == [("now", 0.0, 0.0, "a"), ("one", 0.0, 1.0, "a")]
    assert A.retime("one four", words) == [("one", 0.0, 1.0, "a"), ("four", 4.0, 5.0, "b")]
    assert A.retime("", words) == A.retime("x", []) == []


@settings(max_examples=200, deadline=None)
@given(tokens, tokens)
def test_retimed_tokens_stay_in_time(a, b):
    """Every token of the text has one row; times never go back and come from the words."""
    got = A.retime(" ".join(a), [(w, float(k), k + 0.5, k % 2) for k, w in enumerate(b)])
    assert [g[0] for g in got] == (a if b else [])
    assert all(x[1] <= y[1] for x, y in zip(got, got[1:])) and all(g[2] - g[1] in (0.0, 0.5) for g in got)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(20, 60))
def test_split_text(text, most):
    chunks = A.split_text(text, most, 5)
    assert all(0 < len(c) <= most for c in chunks)
    assert {w for w in text.split() if len(w) < most} <= {w for c in chunks for w in c.split()} or any(len(w) > most // 2 for w in text.split())


def test_source_run_and_veto():
    assert A.source_run("Pram pram", "at pram, pram and pram pram.".split(), 3) == (4, 6)
    assert A.source_run("x", ["y"], 0) is None
    assert A.restore_vetoed("Tema and Tema", [("teamer", "Tema")]) == "teamer and Tema"
