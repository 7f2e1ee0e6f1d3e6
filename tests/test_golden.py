"""Results that are known beforehand: pairs of readings under the profiles, and records of a printed page."""

from pyspark.sql import functions as F

from inkweave.functions.normalise import MATCH, tokens
from inkweave.operators import alignment, matching
from inkweave.plans import queries
from inkweave.plans.cases import CASES

# --- fixed values: line, verse, jaccard, reading, reference ---
GOLD = (
    (36, 0, 0.6857, "اے روی تو بجلوه در آورده رنگ را", "ای روی تو به جلوه درآورده رنگ را"),
    (37, 1, 0.8276, "نقش تو تازه کرده بساط فرنگ را", "نقش تو تازه کرد بساط فرنگ را"),
    (38, 2, 0.7742, "از نالہ خیزی دل سخت تو در عجبم", "از ناله خیزی دل سخت تو در تبم"),
    (39, 3, 0.75, "در عطسہٴ شرر نگن مغز سنگ را", "در عطسه شرر مفگن مغز سنگ را"),
)
REVIEW = (
    (0, 16, 0.7586, "ہمین گداختنت آبروے ما غالب", "همین گداختن است آبروی ما غالب"),
    (1, 17, 0.6667, "گرچہ نازفروشد بہ پیش ژالہٴ ما", "گهر چه ناز فروشد به پیش ژاله ما"),
)
# --- end of fixed values ---


def test_readings_that_merge_and_that_stay_apart(spark):
    got = {r.id: r for r in queries.normalisation_cases(spark, "").collect()}
    for k, (a, b, profile, merge, latest) in enumerate(CASES):
        assert got[k].merged == merge, (a, b, profile)
        assert got[k].early_enough in ((True,) if latest else (None,)), (a, b, profile, latest)


def test_records_of_a_page(spark):
    words = lambda c: tokens(c, MATCH)
    lines = [("342", line, text) for line, _, _, text, _ in GOLD + REVIEW]
    verses = [(poem, verse, text) for poem, part in ((105843, GOLD), (105874, REVIEW)) for _, verse, _, _, text in part]
    query = matching.with_trigrams(spark.createDataFrame(lines, "page string, line int, text string"), words)
    index = matching.with_trigrams(spark.createDataFrame(verses, "poem_id bigint, verse int, text string"), words)
    got = {r.poem_id: r for r in alignment.align(query, index).collect()}
    for poem, part, tier, mean, rate in ((105843, GOLD, "gold", 0.7594, 0.0672), (105874, REVIEW, "review", 0.7127, 0.0984)):
        r = got[poem]
        assert (r.tier, r.matched_lines, r.monotone_ratio, r.mean_jaccard, r.cer_matched_span, r.span_f1) == (tier, len(part), 1.0, mean, rate, 1.0)
        #: 21 of 32 lies between two places; which one it is rounded to is a matter of the profile's author.
        assert [(p.line, p.verse) for p in r.pairs] == [x[:2] for x in part] and all(abs(p.jaccard - x[2]) <= 0.0001 for p, x in zip(r.pairs, part))


def test_dictionary_books(spark):
    assert {(r.id, r.headword, r.rule) for r in queries.dictionary_books(spark, "").collect()} >= {("a-017-001", "آپ آرٹ", "english_term"), ("b-275-002", "ترکیب بند", "ordered_heuristic"), ("c-017-001", "آزاد روپ", "direct_reference")}
    assert [(r.headword, r.needs_review) for r in queries.dictionary_recovery(spark, "").collect()] == [("اَبَتَث", True)]
    assert [r.id for r in queries.dictionary_validation(spark, "").orderBy("sequence").where(F.col("problem").isNull()).collect()] == ["farhang-017-001", "farhang-017-002", "farhang-018-001", "farhang-018-002"]
