"""Sequence discovery: lines between two matches that have as many verses between them.

Where a page's neighbouring gold matches lie n lines and n verses apart, the lines between are candidates for the verses
between, whatever their own score. Each is told with its score, the best match of the whole reference and why plain
matching leaves it out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, rounded, trigrams
from .matching import best_matches, hot_grams

FLOOR, ACCEPT = 0.30, 0.55


def gaps(records: DataFrame) -> DataFrame:
    """page, poem_id, line, verse, left and right anchor, for each line in a gap of gold records."""
    pairs = records.where("tier = 'gold'").select("page", "poem_id", F.explode("pairs").alias("left"))
    right = F.lead("left").over(Window.partitionBy("page", "poem_id").orderBy("left.line"))
    near = pairs.withColumn("right", right).where("right.line - left.line > 1 AND right.line - left.line = right.verse - left.verse")
    rows = near.withColumn("line", F.explode(F.sequence(F.col("left.line") + 1, F.col("right.line") - 1)))
    return rows.withColumn("verse", F.col("line") + F.col("left.verse") - F.col("left.line"))


def discover(records: DataFrame, query: DataFrame, index: DataFrame, floor: float = FLOOR, accept: float = ACCEPT, cap: int | None = None) -> DataFrame:
    """A row for each gap line: candidate, global_top (null if no line shares a trigram), anchors, exclusion."""
    found = gaps(records)
    asked = query.join(found.select("page", "line").distinct(), ["page", "line"], "left_semi")
    best = best_matches(asked, index, threshold=0.0, cap=cap)
    top = best.select("page", "line", F.struct("poem_id", "verse", rounded(F.col("score"), 4).alias("jaccard")).alias("global_top"))
    rows = found.join(query.select("page", "line", F.col("text").alias("hyp"), F.col("words").alias("_q")), ["page", "line"], "left")
    rows = rows.join(index.select("poem_id", "verse", F.col("text").alias("ref"), F.col("words").alias("_r")), ["poem_id", "verse"], "left").join(top, ["page", "line"], "left")
    left, right = trigrams(F.col("_q")), trigrams(F.col("_r"))
    if cap is not None:
        rows = rows.crossJoin(F.broadcast(hot_grams(index, cap).agg(F.collect_list("gram").alias("_hot"))))
        left = F.array_except(left, "_hot")
    rows = rows.withColumns({"_q": left, "_r": right}).withColumn("_o", F.size(F.array_intersect("_q", "_r")))
    rows = rows.withColumn("score", F.when(F.col("_o") > 0, jaccard(F.col("_o"), F.size("_q"), F.size("_r"))).otherwise(F.lit(0.0)))
    score = F.col("score")
    same = F.coalesce((F.col("global_top.poem_id") == F.col("poem_id")) & (F.col("global_top.verse") == F.col("verse")), F.lit(False))
    exclusion = F.when(score < floor, "below_discovery_floor").when(score < accept, "below_acceptance_threshold").otherwise("not_excluded")
    return rows.select("page", "poem_id", "line", "verse", rounded(score, 4).alias("jaccard"), "hyp", "ref", same.alias("is_global_top"), "global_top", "left", "right", exclusion.alias("exclusion"))
