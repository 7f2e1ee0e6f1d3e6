"""Queries over whole tables: results by plain Python on small documents."""

import re

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from inkweave.functions.text import levenshtein
from inkweave.plans import queries


@pytest.fixture
def write(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def folded(text):
    return re.sub("([0-9]+)", " 0 ", re.sub(r"[\W_]+", " ", text.lower())).split()


def damaged(text):
    return re.sub("([a-z]{5})[a-z]", r"\1", text)


def test_rates_of_all_languages_and_lines(spark, write):
    long = [f"line {'abcdefghij'[k % 10] * (k % 3 + 1)} of something lengthening {'whatever ' * (k % 4)}" for k in range(47)]
    docs = {1: ("en", ".".join([*long, " ".join(f"word{'xyz'[k % 3]}" for k in range(45))])), 2: ("fr", "Élève déjà pendant\nle garçon mangeait.... !!\nla forêt entière\nune maison"), 3: ("de", "nur"), 4: ("en", None), 5: ("en", "")}
    folder = write("documents", [(i, lang, t) for i, (lang, t) in docs.items()], "doc_id bigint, lang string, text string")
    lines = {i: [x.strip() for x in re.split(r"[.\n]+", t or "") if folded(x)] for i, (_, t) in docs.items()}
    strict = {i: ["".join(x.replace(" ", "") for x in side) for side in (part, [damaged(x) for x in part])] for i, part in lines.items()}
    lines = {i: [(folded(x), folded(damaged(x))) for x in part] for i, part in lines.items() if part}
    assert {i: len(x) for i, x in lines.items()} == {1: 48, 2: 4, 3: 1}
    pairs, prose = ({r.page: r for r in f(spark, folder).collect()} for f in (queries.pair_rates, queries.prose_rates))
    offsets = {r.page: r for r in queries.best_offset(spark, folder).collect()}
    assert set(pairs) == set(prose) == set(lines) and set(offsets) == {1, 2}
    rates = []
    for i, part in lines.items():
        h, b = ("".join(w for x in part for w in x[k]) for k in (0, 1))
        edits, size = sum(distance(*x) for x in part), sum(len(x[1]) for x in part)
        assert tuple(pairs[i])[1:] == (len(part), sum(x == y for x, y in part), edits, size, round(edits / size, 9), round(distance(h, b) / max(len(h), len(b)), 9))
        assert (prose[i].hyp_lines, prose[i].ref_lines, prose[i].hyp_tokens, prose[i].folded_character_distance, prose[i].strict_character_distance) == (len(part), len(part), sum(len(x[0]) for x in part), distance(h, b), distance(*strict[i]))
        h, b = (" ".join(w for x in part for w in x[k]) for k in (0, 1))
        rates.append(distance(h, b) / max(len(h), len(b)))
    for i in (1, 2):
        hyp, ref = [" ".join(x) for x, _ in lines[i]], [" ".join(y) for _, y in lines[i][2:]]
        means = [sum(distance(a, b) / max(len(a), len(b)) for a, b in zip(hyp[k:], ref)) / len(ref) for k in range(3)]
        assert offsets[i].offset == min(range(3), key=lambda k: means[k]) and offsets[i].mean_cer == pytest.approx(min(means), abs=1e-8)
    total = queries.compare_sources(spark, folder).first()
    assert (total.n, total.line_mismatches, total.max_cer, total.median_cer) == (3, 0, max(rates), sorted(rates)[1])


@settings(max_examples=500, deadline=None)
@given(st.text("abé😀", max_size=40), st.text("abé😀", max_size=40))
def test_edit_distance(a, b):
    assert levenshtein(a, b) == levenshtein(list(a), list(b)) == distance(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abé😀", max_size=200), st.text("abé😀", max_size=200)), max_size=12), st.booleans(), st.booleans())
def test_edit_distances_of_many_pairs(pairs, as_words, alone):
    """Strings and arrays of words; in a few words of bits or, all larger ones, on their own."""
    import pyarrow as pa

    from inkweave.functions import edits

    pairs = [*pairs, ("", ""), ("", "ab"), ("abab" * 40, "baba" * 33), ("a" * 64, "a" * 63 + "b"), (None, "a")]
    columns = [pa.array([None if p[k] is None else list(p[k]) if as_words else p[k] for p in pairs], pa.list_(pa.string()) if as_words else pa.string()) for k in (0, 1)]
    kept, edits.WORDS = edits.WORDS, 1 if alone else edits.WORDS
    try:
        assert edits.distances(*columns).to_pylist() == [None if a is None else distance(a, b) for a, b in pairs]
    finally:
        edits.WORDS = kept


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé", max_size=12), min_size=1, max_size=8), st.lists(st.text("abcé", max_size=12), min_size=1, max_size=5))
def test_best_place(hyp, ref):
    import numpy as np

    from inkweave.functions.edits import best_place

    means = [sum(distance(a, b) / max(len(a), len(b), 1) for a, b in zip(hyp[k:], ref)) / len(ref) for k in range(len(hyp) - len(ref) + 1)]
    found = best_place((np.arange(len(hyp)), hyp), (np.arange(len(ref)), ref))
    assert found is None and not means or found[0] == pytest.approx(min(means), abs=1e-12) and means[found[1]] == pytest.approx(min(means), abs=1e-12)


def test_places_that_the_letters_rule_out_are_not_counted(monkeypatch):
    import numpy as np

    from inkweave.functions import edits

    counted = []
    monkeypatch.setattr(edits, "levenshtein", lambda a, b: counted.append((a, b)) or levenshtein(a, b))
    hyp = [chr(97 + k) * 30 for k in range(20)]
    assert edits.best_place((np.arange(20), hyp), (np.arange(3), hyp[7:10])) == (0.0, 7) and len(counted) == 3


def test_letters_lost_in_a_long_text_are_found_at_once():
    """A column of the table for each of 400,000 letters took minutes."""
    import time

    text, begun = "whatever comes of it all " * 16_000, time.process_time()
    assert levenshtein(text, text.replace("v", "")) == levenshtein(list(text.replace("v", "")), list(text)) == 16_000
    assert time.process_time() - begun < 5


def test_refrains_hold_for_all_lines(spark, write):
    shared = [f"verse {k} moon" for k in range(14)]
    texts = {1: shared, 2: [*shared[:11], "verse 11 sun", *shared[12:]], 8: shared[:8]}
    folder = write("documents", [(i, ".".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    assert {r.gid: r.radif for r in queries.refrains(spark, folder).collect()} == {1: "moon of 1", 2: "of 2", 8: "moon of 1"}
    assert {(r.radif, r.members, r.poets) for r in queries.refrain_families(spark, folder).collect()} == {("moon of 1", 2, 2), ("of 2", 1, 1)}
    assert queries.refrain_share(spark, folder).first().n == 7 + 7 + 4


def test_runs_of_whole_texts(spark, write):
    folder = write("documents", [(1, "\n".join("x" * k for k in (3, 1, 2, 2, 5, 4))), (2, ""), (3, None), (5000, "\n".join("y" * k for k in range(40)))], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in queries.increasing_runs(spark, folder).collect()) == [(1, 3, 6), (2, 1, 1), (5000, 40, 40)]


def test_states_by_the_whole_text(spark, write):
    folder = write("documents", [(0, " " * 40 + "end"), (1, "other" + " " * 30 + "end"), (11, "other"), (2, "x" * 50)], "doc_id bigint, text string")
    assert {r.page: r.state for r in queries.page_states(spark, folder).collect()} == {"p0": "complete", "p1": "edited", "p11": "complete", "p2": "unrecorded"}
    assert {r.state: r.pages for r in queries.state_counts(spark, folder).collect() if r.pages} == {"complete": 2, "edited": 1, "unrecorded": 1}


@pytest.mark.parametrize("name", ["page_states", "state_counts"])
def test_states_of_empty_and_missing_texts_by_the_sql(spark, write, name):
    import duckdb

    from inkweave.plans.oracles import ORACLE_SQL

    rows = [(k, None) for k in range(10)] + [(10 + k, "") for k in range(10)] + [(20 + k, " ") for k in range(10)] + [(30 + k, "other ") for k in range(10)]
    folder = write("documents", rows, "doc_id bigint, text string")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        assert sorted(map(tuple, getattr(queries, name)(spark, folder).collect())) == sorted(db.execute(ORACLE_SQL[name]).fetchall())


def test_votes_of_candidates_with_a_rare_word(spark, write):
    folder = write("documents", [(1, "the quiet lantern burns beside the water"), (2, "aa bb cc dd ee")], "doc_id bigint, text string")
    write("benchmark", [(2, "the quiet lantern burns beside the water"), (4, "aab bbc ccd dde ee")], "item_id bigint, text string")
    assert [tuple(r) for r in queries.restricted_votes(spark, folder).collect()] == [(1, 2, 1.0)]


def test_trigrams_of_many_reference_lines_still_match(spark, write):
    folder = write("documents", [(1, "the quiet lantern burns")], "doc_id bigint, text string")
    write("benchmark", [(i, "the quiet lantern burns") for i in range(70)], "item_id bigint, text string")
    assert [tuple(r) for r in queries.match_lines(spark, folder).collect()] == [(1, 0, 0, 0, 1.0)]


_SUNG = ["the quiet lantern burns beside", "seven geese are crossing over", "nobody answers when evening calls", "we count windows of houses", "and winter comes to every door", "a river runs below bridges"]
#: What each query finds of a page of six verses which 3,001 poems have.
_COMMON = {
    "match_lines": lambda rows: [tuple(r) for r in sorted(rows)] == [(1, i, 0, i, 1.0) for i in range(6)],
    "align": lambda rows: [(r.page, r.poem_id, r.tier, r.matched_lines) for r in rows] == [(1, 0, "gold", 6)],
    "align_totals": lambda rows: rows[0].matched_lines == 6,
    "align_quantiles": lambda rows: (rows[0].n, rows[0].q50) == (1, 1.0),
    "align_pages": lambda rows: [(r.page, r.gold, r.matched_lines) for r in rows] == [(1, 1, 6)],
    "negative_control": lambda rows: tuple(rows[0]) == (1, 1, 1, 6),
    "discover_gaps": lambda rows: {(r.page, r.poem_id, r.line, r.verse) for r in rows} == {(1, 0, 1, 1), (1, 0, 4, 4)},
    "line_votes": lambda rows: [(r.page, r.poem_id, r.votes) for r in rows] == [(1, 0, 6.0)],
    "restricted_votes": lambda rows: [(r.page, r.poem_id, r.votes) for r in rows] == [(1, 7, 7.0)],
}


@pytest.mark.parametrize("name", _COMMON)
def test_trigrams_of_thousands_of_reference_lines_count(spark, write, name):
    text, rare = ". ".join(_SUNG), ". lone" if name == "restricted_votes" else ""
    folder = write("documents", [(1, text + rare)], "doc_id bigint, text string")
    write("benchmark", [(i, text + rare * (i == 7)) for i in range(3001)], "item_id bigint, text string")
    rows = getattr(queries, name)(spark, folder).collect()
    assert _COMMON[name](rows), rows
