"""Alignment: a page's line matches grouped by poem, tested for order, and put in tiers.

Scores are rounded to 4 places, by their exact values, before they are compared with the threshold. A poem is gold with enough distinct verses in
a mostly rising order, review with a few, and left out otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cer, f1, increasing_length, rounded
from . import order
from .matching import best_matches, withheld_matches

WEAK, STRONG, LINES, MONOTONE, REVIEW = 0.30, 0.55, 4, 0.80, 2
#: What a match takes along of its line, so that it needn't be looked up.
CARRY = ("text", "words")


def tier(distinct: Column, monotone: Column, lines: int = LINES, least: float = MONOTONE, review: int = REVIEW) -> Column:
    return F.when((distinct >= lines) & (monotone >= least), "gold").when(distinct >= review, "review").otherwise("reject")


def span_metrics(pairs: Column) -> dict[str, Column]:
    """How much of the span between the first and the last match is matched, on either side; zeros without a match. ``pairs``
    is an array of (line, verse, ...) in the order of lines."""
    aligned = increasing_length(F.transform(pairs, lambda p: p["verse"]))
    lines, verses = F.transform(pairs, lambda p: p["line"]), F.transform(pairs, lambda p: p["verse"])
    span = lambda x: F.coalesce(F.array_max(x) - F.array_min(x) + 1, F.lit(0))
    precision, recall = (F.when(span(x) > 0, aligned / span(x)).otherwise(F.lit(0.0)) for x in (lines, verses))
    return {
        "aligned_lines": aligned,
        "hypothesis_span_lines": span(lines),
        "hypothesis_span_precision": rounded(precision, 4),
        "reference_span_lines": span(verses),
        "reference_span_recall": rounded(recall, 4),
        "span_f1": rounded(f1(precision, recall), 4),
    }


def strong_pairs(matches: DataFrame, index: DataFrame, strong: float = STRONG) -> DataFrame:
    """page, poem_id, pairs: the strong ``matches`` (with the query's text and words) by line, with both sides' words."""
    rows = matches.withColumn("jaccard", rounded(F.col("score"), 4)).where(F.col("jaccard") >= strong)
    rows = rows.withColumnsRenamed({"text": "hyp", "words": "hyp_words"})
    rows = rows.join(index.select("poem_id", "verse", F.col("text").alias("ref"), F.col("words").alias("ref_words")), ["poem_id", "verse"])
    pair = F.struct("line", "verse", "jaccard", "hyp", "ref", "hyp_words", "ref_words")
    return rows.groupBy("page", "poem_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))


def tiered(pairs: DataFrame, lines: int = LINES, least: float = MONOTONE, review: int = REVIEW) -> DataFrame:
    """A record for each page and poem that isn't rejected."""
    verses = F.transform("pairs", lambda p: p["verse"])
    joined = lambda side: F.array_join(F.flatten(F.transform("pairs", lambda p: p[side])), " ")
    n = F.size("pairs")
    rows = pairs.withColumns({"_mono": increasing_length(verses) / n, "distinct_verses": F.size(F.array_distinct(verses)), "matched_lines": n})
    rows = rows.withColumn("tier", tier(F.col("distinct_verses"), F.col("_mono"), lines, least, review)).where("tier <> 'reject'")
    return rows.select(
        "page", "poem_id", "tier", "matched_lines", "distinct_verses",
        rounded(F.col("_mono"), 3).alias("monotone_ratio"),
        rounded(F.aggregate("pairs", F.lit(0.0), lambda s, p: s + p["jaccard"]) / n, 4).alias("mean_jaccard"),
        rounded(cer(joined("hyp_words"), joined("ref_words")), 4).alias("cer_matched_span"),
        *[c.alias(k) for k, c in span_metrics(F.col("pairs")).items()],
        F.transform("pairs", lambda p: F.struct(*[p[c].alias(c) for c in ("line", "verse", "jaccard", "hyp", "ref")])).alias("pairs"),
    )


def align(query: DataFrame, index: DataFrame, strong: float = STRONG, lines: int = LINES, least: float = MONOTONE, review: int = REVIEW, cap: int | None = None) -> DataFrame:
    """The records of all pages. Weak matches reach no output, so the join already prunes at the strong threshold, less
    what rounding may add; each line has one best match, which pruning can't change."""
    floor = max(WEAK, strong - 0.00005) if strong > WEAK else WEAK
    return tiered(strong_pairs(best_matches(query, index, threshold=floor, cap=cap, carry=CARRY), index, strong), lines, least, review)


def control(query: DataFrame, index: DataFrame, truth: DataFrame, strong: float = STRONG, cap: int | None = None) -> DataFrame:
    """Records found when each page's true poems are withheld: gold ones are false. Only pages that have a truth are asked."""
    asked = query.join(truth.select("page").distinct(), "page", "left_semi")
    return tiered(strong_pairs(withheld_matches(asked, index, truth, threshold=max(WEAK, strong - 0.00005), cap=cap, carry=CARRY), index, strong))


def control_rates(records: DataFrame, truth: DataFrame) -> DataFrame:
    """pages, false_pages, false_records, false_lines of a control run."""
    false = records.where("tier = 'gold'").agg(F.countDistinct("page").alias("false_pages"), F.count(F.lit(1)).alias("false_records"), F.coalesce(F.sum("matched_lines"), F.lit(0)).alias("false_lines"))
    return truth.agg(F.countDistinct("page").alias("pages")).crossJoin(false)


def totals(records: DataFrame) -> DataFrame:
    """Sums over gold records, and precision, recall and F1 of the sums."""
    sums = records.where("tier = 'gold'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched_lines", "aligned_lines", "hypothesis_span_lines", "reference_span_lines")])
    rate = lambda c: F.col("aligned_lines") / F.greatest(F.lit(1), F.col(c))
    p, r = rate("hypothesis_span_lines"), rate("reference_span_lines")
    return sums.withColumns({"hypothesis_span_precision": rounded(p, 4), "reference_span_recall": rounded(r, 4), "span_f1": rounded(f1(p, r), 4)})


def quantiles(records: DataFrame, value: str = "cer_matched_span") -> DataFrame:
    """n and the lower, middle and upper quantile by index, of gold records."""
    return order.quantiles(records.where("tier = 'gold'").select(value), value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def page_summary(records: DataFrame) -> DataFrame:
    """page, tiers (map), matched_lines, poems, and the coverage of the gold records (null without one)."""
    gold = F.col("tier") == "gold"
    sums = {c: F.sum(F.when(gold, F.col(c))) for c in ("aligned_lines", "hypothesis_span_lines", "reference_span_lines")}
    rows = records.groupBy("page").agg(
        F.sum("matched_lines").alias("matched_lines"), F.array_sort(F.collect_list(F.struct("poem_id", "tier"))).alias("poems"),
        F.array_sort(F.collect_list("tier")).alias("_t"), *[c.alias(k) for k, c in sums.items()],
    )
    kinds = F.array_distinct("_t")
    counts = F.map_from_arrays(kinds, F.transform(kinds, lambda t: F.size(F.filter("_t", lambda x: x == t))))
    p = F.col("aligned_lines") / F.greatest(F.lit(1), F.col("hypothesis_span_lines"))
    r = F.col("aligned_lines") / F.greatest(F.lit(1), F.col("reference_span_lines"))
    return rows.select("page", counts.alias("tiers"), "matched_lines", "poems", *sums, rounded(p, 4).alias("hypothesis_span_precision"), rounded(r, 4).alias("reference_span_recall"), F.when(F.col("aligned_lines").isNotNull(), rounded(f1(p, r), 4)).alias("span_f1"))


def ordered(records: DataFrame) -> DataFrame:
    """Records as a report lists them."""
    return records.orderBy("page", F.desc("distinct_verses"), "cer_matched_span", "poem_id")
