"""Matching and alignment on small inputs, with results worked out by hand or by plain Python."""

import bisect
import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkweave.functions.normalise import APPARATUS, APPARATUS_2, LATIN, agreement, profile_hash, profile_id, retrieval_merges, tokens
from inkweave.functions.text import cer, increasing_length, rounded, sequence_distance, trigrams, upper_quantile
from inkweave.operators import alignment, discovery, matching, scoring
from inkweave.streaming import pages as streaming

VERSES = ["the river runs below the old stone bridge", "a lantern burns beside the quiet water", "seven geese are crossing over the meadow", "nobody answers when the evening calls", "we count the windows of the empty house", "and winter comes to every open door"]


def words(c):
    return tokens(c, LATIN)


def frames(spark, page_lines, poems):
    query = spark.createDataFrame([(p, i, t) for p, lines in page_lines.items() for i, t in enumerate(lines)], "page string, line int, text string")
    index = spark.createDataFrame([(p, i, t) for p, lines in poems.items() for i, t in enumerate(lines)], "poem_id bigint, verse int, text string")
    return matching.with_trigrams(query, words), matching.with_trigrams(index, words)


def grams(t):
    s = "_".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    return {s[i : i + 3] for i in range(len(s) - 2)}


def test_best_match_by_plain_python_at_every_threshold(spark):
    lines = [v[k:] + " " + w[:9] for k, (v, w) in enumerate(itertools.permutations(VERSES, 2))]
    query, index = frames(spark, {"p": lines}, {1: VERSES[:3], 2: VERSES[2:]})
    refs = [(p, i, grams(t)) for p, part in ((1, VERSES[:3]), (2, VERSES[2:])) for i, t in enumerate(part)]
    for threshold in (0.0, 0.3, 0.55):
        got = {r.line: (r.poem_id, r.verse, round(r.score, 9)) for r in matching.best_matches(query, index, threshold=threshold).collect()}
        for i, t in enumerate(lines):
            q = grams(t)
            best = min((-len(q & g) / len(q | g), p, v) for p, v, g in refs)
            assert got.get(i) == ((best[1], best[2], round(-best[0], 9)) if -best[0] >= threshold and best[0] else None)


def test_ties_go_to_the_lowest_poem(spark):
    query, index = frames(spark, {"p": VERSES[:1]}, {9: VERSES[:1], 4: VERSES[:1]})
    assert [(r.poem_id, r.score) for r in matching.best_matches(query, index).collect()] == [(4, 1.0)]


def test_hot_trigrams_count_in_the_reference_only(spark):
    query, index = frames(spark, {"p": ["abcd"]}, {1: ["abce", "abcf", "abcd"]})
    assert [(r.verse, round(r.score, 6)) for r in matching.best_matches(query, index, cap=2).collect()] == [(2, 0.5)]


def test_alignment_tiers_spans_and_control(spark):
    page = VERSES[:3] + ["zzz qqq xxx", *VERSES[4:]]
    query, index = frames(spark, {"p1": page, "p2": [VERSES[5], VERSES[0]]}, {1: VERSES, 2: [v[::-1] for v in VERSES]})
    got = {r.page: r for r in alignment.align(query, index).collect()}
    a = got["p1"]
    assert (a.tier, a.matched_lines, a.distinct_verses, a.monotone_ratio, a.mean_jaccard, a.cer_matched_span) == ("gold", 5, 5, 1.0, 1.0, 0.0)
    assert (a.aligned_lines, a.hypothesis_span_lines, a.hypothesis_span_precision, a.reference_span_lines, a.span_f1) == (5, 6, 0.8333, 6, 0.8333)
    assert (got["p2"].tier, got["p2"].monotone_ratio, got["p2"].aligned_lines) == ("review", 0.5, 1)
    found = alignment.align(query, index)
    truth = found.where("tier = 'gold'").select("page", "poem_id")
    assert alignment.control(query, index, truth).count() == 0
    assert alignment.control_rates(alignment.control(query, index, truth), truth).first() == (1, 0, 0, 0)
    gaps = discovery.discover(found, query, index).collect()
    assert [(g.page, g.line, g.verse, g.exclusion, g.is_global_top) for g in gaps] == [("p1", 3, 3, "below_discovery_floor", False)]
    summary = {r.page: r for r in alignment.page_summary(found).collect()}
    assert summary["p1"].tiers == {"gold": 1} and summary["p2"].span_f1 is None


def test_gaps_of_lines_without_trigrams(spark):
    """A gap line and its verse may both be too short for a trigram, and are in neither frame."""
    page = [*VERSES[:3], "a", *VERSES[4:]]
    query, index = frames(spark, {"p1": page}, {1: [*VERSES[:3], "b", *VERSES[4:]]})
    gaps = discovery.discover(alignment.align(query, index), query, index).collect()
    assert [(g.line, g.verse, g.jaccard, g.exclusion, g.is_global_top, g.global_top) for g in gaps] == [(3, 3, 0.0, "below_discovery_floor", False, None)]
    capped = discovery.discover(alignment.align(query, index), query, index, cap=3).collect()
    assert [(g.line, g.jaccard) for g in capped] == [(3, 0.0)]


def test_sequence_expressions(spark):
    cases = [[3, 1, 2, 2, 5, 4], [], [1], [5, 4, 3], [1, 2, 3]]
    rows = spark.createDataFrame([(c,) for c in cases], "v array<bigint>").select(increasing_length(F.col("v")), upper_quantile(F.col("v"))).collect()
    for case, (longest, middle) in zip(cases, rows):
        tails = []
        for x in case:
            k = bisect.bisect_left(tails, x)
            tails[k : k + 1] = [x]
        assert longest == len(tails) and middle == (sorted(case)[len(case) // 2] if case else None)
    pair = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["a"]), (["😀"], ["😀"])], "a array<string>, b array<string>")
    assert [r[0] for r in pair.select(sequence_distance(F.col("a"), F.col("b"))).collect()] == [2, 1, 0]
    assert spark.range(1).select(cer(F.lit(""), F.lit("")), cer(F.lit("abc"), F.lit("abd"))).first() == (0.0, 1 / 3)
    assert spark.range(1).select(trigrams(F.array(F.lit("ab"), F.lit("c"))), trigrams(F.array(F.lit("ab")))).first() == (["ab_", "b_c"], [])


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.integers(0, 20001).map(lambda k: k / 20000), st.fractions(0, 2, max_denominator=999).map(float), st.floats(0, 3)), min_size=200, max_size=200))
def test_rounding_by_the_exact_value(spark, values):
    frame = spark.createDataFrame([(x,) for x in [0.71265, 0.65625, 0.5, 0.00005, 2.5, *values]], "x double")
    assert [(r.a, r.b) for r in frame.select("x", rounded(F.col("x"), 4).alias("a"), rounded(F.col("x"), 3).alias("b")).collect()] == [(round(r.x, 4), round(r.x, 3)) for r in frame.collect()]


def test_best_offset(spark):
    frame = lambda lines: spark.createDataFrame([("p", i, t.split()) for i, t in enumerate(lines)], "page string, line int, words array<string>")
    assert scoring.best_offset(frame(VERSES), frame([VERSES[3], VERSES[4][:-2]])).first().offset == 3
    assert scoring.best_offset(frame(VERSES[:1]), frame(VERSES)).count() == 0


def test_profiles(spark):
    pairs = [("كتاب", "کتاب", "encoding"), ("دیدۂ", "دیدہ", "orthographic"), ("گل، باغ", "گل باغ", "orthographic"), ("دِل", "دل", "vocalisation"), ("در خور", "درخور", "segmentation"), ("ہے", "ہی", None), ("گل", "گل", "identical"), ("[Urdu] گل", "گل", "encoding")]
    frame = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    rows = frame.select(agreement(F.col("a"), F.col("b")), retrieval_merges(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [x for *_, x in pairs] and rows[5][1] and rows[3][1]
    digits = spark.createDataFrame([("۱۴۸", "١٤٨")], "a string, b string")
    assert digits.select(agreement(F.col("a"), F.col("b"), APPARATUS), agreement(F.col("a"), F.col("b"), APPARATUS_2)).first() == (None, "encoding")
    assert len(profile_hash(APPARATUS)) == 12 and profile_id(APPARATUS).startswith("apparatus-v1+")
    assert spark.range(1).select(tokens(F.lit("مئے ۱۲ ٹال غالبؔ"))).first()[0] == ["می", "0", "تال", "غالب"]


def test_streamed_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_1.txt").write_text("\n".join(["## head", *VERSES]), encoding="utf-8")
    _, index = frames(spark, {"p": VERSES[:1]}, {1: VERSES})
    stream = streaming.page_stream(spark, str(tmp_path / "in"))
    streaming.start(stream, index, words, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.page, r.poem_id, r.tier, r.matched_lines) for r in rows] == [("a_1.txt", 1, "gold", 6)]


def test_a_reference_in_blocks_has_the_same_matches(spark, monkeypatch):
    lines = [v[k:] + " " + w[:9] for k, (v, w) in enumerate(itertools.permutations(VERSES, 2))]
    query, index = frames(spark, {"p": lines, "q": VERSES[:2]}, {1: VERSES[:3], 2: VERSES[2:], 3: VERSES[:3]})
    of = lambda threshold, cap: sorted(matching.best_matches(query, index, threshold=threshold, cap=cap).collect())
    cases = [(0.0, None), (0.3, None), (0.55, None), (0.1, 3)]
    whole = [of(*case) for case in cases]
    monkeypatch.setattr(matching, "BLOCK", 4)
    assert [of(*case) for case in cases] == whole and all(whole)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé😀_ ", max_size=30), max_size=12), st.lists(st.text("abé😀日_", max_size=30), max_size=12), st.sampled_from([0.0, 0.2, 0.3, 0.55, 1.0]), st.integers(0, 12))
def test_pairs_by_plain_python(lines, verses, threshold, common):
    """Also with no trigram or few of them in the product of matrices, and hot ones left out."""
    import pyarrow as pa

    from inkweave.functions import overlap

    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in verses]
    hot = {x for x in itertools.chain(*sets) if sum(x in s for s in sets) > 5}
    expected = {}
    for i, t in enumerate(lines):
        own = {t[k : k + 3] for k in range(len(t) - 2)} - hot
        expected |= {(i, j): len(own & s) / len(own | s) for j, s in enumerate(sets) if own & s and len(own & s) / len(own | s) >= threshold}
    rows = pa.table({"poem_id": list(range(len(verses))), "verse": [0] * len(verses), "words": pa.array([[v] for v in verses], pa.list_(pa.string()))})
    kept, overlap.COMMON = overlap.COMMON, common
    try:
        reference = overlap.Reference(rows, frozenset(hot))
        found = {(i, j): s for i, j, s in zip(*(x.tolist() for x in reference.pairs(pa.array(lines, pa.string()), threshold, False)))}
    finally:
        overlap.COMMON = kept
    assert found == expected
