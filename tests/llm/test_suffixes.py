from hypothesis import given, settings
from hypothesis import strategies as st

from inkweave.llm.suffixes import common, deep_shallow, matches

text = st.text(alphabet="ab", max_size=14).map(str.encode)


@settings(max_examples=400, deadline=None)
@given(st.lists(text | st.sampled_from([b"a" * 30, b"a" * 31, b"a" * 30 + b"b", b"\xff\x00"]), min_size=2, max_size=30), st.integers(0, 6))
def test_order(strings, shallow):
    order = deep_shallow(strings, shallow)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[k] for k in order] == sorted(strings)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(text, text), min_size=2, max_size=12), st.integers(1, 10))
def test_matches_cover_what_pairs_share(sides, length):
    lefts, rights = [a for a, _ in sides], [b for _, b in sides]
    for i, found in enumerate(matches(lefts, rights, length)):
        expected = set()
        for j in range(len(sides)):
            l, r = common(lefts[i], lefts[j]), common(rights[i], rights[j])
            if i != j and l + r >= length:
                expected.update(range(-l, r))
        assert {x for l, r in found for x in range(-l, r)} == expected
        assert all(l + r >= length for l, r in found)
