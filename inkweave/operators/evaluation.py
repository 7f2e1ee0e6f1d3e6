"""Rhyme families, and how well scores tell present references from absent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from . import order
from .lineage import cut

REFRAIN = 3


def refrain(lines: Column) -> Column:
    """The last words, three at most, that all non-empty lines at odd places share; none unless there are two such
    lines. ``lines`` is an array of arrays of words."""
    def of(last):
        first = F.get(last, F.lit(0))
        shared = F.filter(F.sequence(F.lit(1), F.size(first)), lambda k: F.forall(last, lambda x: F.slice(x, 1, k) == F.slice(first, 1, k)))
        n = F.least(F.lit(REFRAIN), F.coalesce(F.array_max(shared), F.lit(0)))
        return F.when(F.size(last) >= 2, F.reverse(F.slice(first, F.lit(1), n))).otherwise(F.array().cast("array<string>"))

    odd = F.filter(F.filter(lines, lambda _, i: i % 2 == 1), lambda x: F.size(x) > 0)
    return let(F.transform(odd, lambda x: F.reverse(x)), of)


def with_refrain(poems: DataFrame) -> DataFrame:
    """Adds radif to (gid, poet, lines of words)."""
    return poems.withColumn("radif", refrain(F.col("lines")))


def same_refrain(a: Column, b: Column) -> Column:
    return F.coalesce((F.size(a) > 0) & (a == b), F.lit(False))


def families(poems: DataFrame) -> DataFrame:
    """radif, members, poets of poems that have a radif."""
    return poems.where(F.size("radif") > 0).groupBy("radif").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("poet").alias("poets"))


def family_sizes(poems: DataFrame) -> DataFrame:
    """size, families: how many families have each size."""
    return families(poems).groupBy(F.col("members").alias("size")).agg(F.count(F.lit(1)).alias("families"))


def largest_families(poems: DataFrame, top: int = 10) -> DataFrame:
    return families(poems).orderBy(F.desc("members"), "radif").limit(top)


def refrain_share(poems: DataFrame) -> DataFrame:
    """n, median, p90 of the share of a rhyming line's words that is radif."""
    rows = poems.where(F.size("radif") > 0).select("radif", F.posexplode("lines").alias("i", "line")).where("i % 2 = 1").where(F.size("line") > F.size("radif"))
    return order.quantiles(rows.select((F.size("radif") / F.size("line")).alias("share")), "share", {"median": 0.5, "p90": 0.9})


def trial_pool(poems: DataFrame, least: int = 8) -> DataFrame:
    """Poems of ``least`` lines or more that share their radif with another."""
    shared = families(poems).where("members >= 2").select("radif")
    return poems.where(F.size("lines") >= least).join(shared, "radif", "left_semi")


def retrieval_report(scores: DataFrame, truth: DataFrame, refrains: DataFrame, score: str = "votes") -> DataFrame:
    """trials, top1, top5, decided, margin_median, decoys_with_refrain. ``scores`` (page, poem_id, score), ``truth`` (page, poem_id), ``refrains`` (poem_id, radif)."""
    place = Window.partitionBy("page").orderBy(F.desc(score), "poem_id")
    rows = scores.withColumn("rank", F.row_number().over(place)).join(truth.select("page", F.col("poem_id").alias("true_id")), "page")
    own = F.col("poem_id") == F.col("true_id")
    pages = rows.groupBy("page", "true_id").agg(
        F.min(F.when(own, F.col("rank"))).alias("rank"), F.max(F.when(own, F.col(score))).alias("true_score"),
        F.min_by(F.struct(F.col("poem_id"), F.col(score).alias("score")), F.when(~own, F.col("rank"))).alias("decoy"),
    )
    pages = truth.select("page").distinct().join(pages, "page", "left")
    of = lambda key, name: refrains.select(F.col("poem_id").alias(f"_{name}"), F.col("radif").alias(name))
    pages = pages.join(of("true_id", "r_true"), F.col("true_id") == F.col("_r_true"), "left").join(of("decoy", "r_decoy"), F.col("decoy.poem_id") == F.col("_r_decoy"), "left")
    decided = (F.col("true_score") > 0) & F.col("decoy").isNotNull()
    margin = (F.col("true_score") - F.col("decoy.score")) / F.col("true_score")
    same = same_refrain(F.col("r_true"), F.col("r_decoy"))
    pages = cut(pages.select("rank", decided.alias("decided"), F.when(decided, margin).alias("margin"), (decided & same).alias("same")))
    counts = pages.agg(
        F.count(F.lit(1)).alias("trials"), F.count(F.when(F.col("rank") == 1, 1)).alias("top1"), F.count(F.when(F.col("rank") <= 5, 1)).alias("top5"),
        F.count(F.when(F.col("decided"), 1)).alias("decided"), F.count(F.when(F.col("same"), 1)).alias("decoys_with_refrain"),
    )
    return counts.crossJoin(order.quantiles(pages, "margin", {"margin_median": 0.5}).select("margin_median")).select("trials", "top1", "top5", "decided", "margin_median", "decoys_with_refrain")


def best_normalised(scores: DataFrame, sizes: DataFrame, score: str = "votes") -> DataFrame:
    """page, score: the best candidate's score by the page's size (lines or distinct words); 0 without a candidate."""
    best = scores.groupBy("page").agg(F.max(score).alias("_s"))
    return sizes.join(best, "page", "left").select("page", F.coalesce(F.col("_s") / F.greatest(F.lit(1), F.col("size")), F.lit(0.0)).alias("score"))


def sweep(scores: DataFrame) -> DataFrame:
    """The one threshold of highest accuracy over (score, present): cut, acc, recall, fpr, and where the two sides' scores lie. Of equally good
    cuts the lowest. Counts run over the distinct scores, so rows are never paired, and no task holds all of them."""
    counts = scores.groupBy("score").agg(F.count(F.when(F.col("present"), 1)).alias("p"), F.count(F.when(~F.col("present"), 1)).alias("a"))
    ranked, totals = order.cumulated(counts, "score", ("p", "a"))
    rows = ranked.crossJoin(F.broadcast(totals)).where("p_all > 0 AND a_all > 0")
    tp, fp = (F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c) for c in "pa")
    accuracy = (tp + F.col("a_all") - fp) / (F.col("p_all") + F.col("a_all"))
    found = F.struct(F.col("score").alias("cut"), accuracy.alias("acc"), (tp / F.col("p_all")).alias("recall"), (fp / F.col("a_all")).alias("fpr"))
    told = rows.agg(
        F.min_by(found, F.struct(-accuracy, F.col("score"))).alias("_b"), order.at_share("score", "p", 0.05).alias("present_p05"), order.at_share("score", "p", 0.5).alias("present_med"),
        order.at_share("score", "a", 0.5).alias("absent_med"), F.max(F.when(F.col("a") > 0, F.col("score"))).alias("absent_max"),
    ).where("_b IS NOT NULL")
    over = rows.crossJoin(F.broadcast(told.select("present_p05"))).where("score >= present_p05").agg((F.coalesce(F.sum("a"), F.lit(0)) / F.max("a_all")).alias("absent_above_present_p05"))
    return told.crossJoin(over).select("_b.*", "present_p05", "present_med", "absent_med", "absent_max", "absent_above_present_p05")


def rising_steps(pages: DataFrame) -> DataFrame:
    """page_no, number, step: rising, falling or null, against the last page before that has a number. ``pages`` (book, page_no, number)."""
    before = F.last("number", ignorenulls=True).over(Window.partitionBy("book").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("step", F.when(before.isNull() | F.col("number").isNull(), F.lit(None)).when(F.col("number") > before, "rising").otherwise("falling"))
